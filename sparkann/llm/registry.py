"""All queries of this subpackage and their SQL."""

from sparkann.llm import langid, mtree, packing, pieces, pii, quality, repeats, sharding, simhash, warc

MODULES = (sharding, mtree, repeats, simhash, langid, pii, pieces, warc, quality, packing)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
