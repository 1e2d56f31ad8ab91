"""spark-submit entry: python -m sparkann build VECTORS INDEX [M EF CLUSTERS METHOD] | search INDEX QUERIES [K EF FLAGS]."""

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkann.plans.index import BuildConfig, Index, build_index, load_vectors


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("build", "search"):
        print(__doc__)
        return 1
    spark = SparkSession.builder.appName("sparkann").getOrCreate()
    if args[0] == "build":
        m, ef, clusters, method = [*args[3:7], *["16", "200", "0", "graph"][len(args[3:7]) :]]
        print(json.dumps(build_index(load_vectors(spark, args[1]), args[2], BuildConfig(int(m), int(ef), clusters=int(clusters), method=method))))
        return 0
    k, ef, flags = [*args[3:6], *["10", "50", ""][len(args[3:6]) :]]
    queries = load_vectors(spark, args[2]).select(F.col("node_id").alias("qid"), "vec")
    found, _ = Index.open(spark, args[1]).search(queries, int(k), int(ef), flags)
    found.orderBy("qid", "rank").show(int(k) * 5, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
