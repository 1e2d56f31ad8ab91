import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.functions import codes
from sparkann.operators import layout, pir, ring


def test_ring_products_wrap():
    a = np.array([[(1 << 32) - 1]], np.uint32)
    b = np.array([[(1 << 32) - 5]], np.uint32)
    assert ring.multiply(a, b)[0, 0] == 5
    x = np.random.default_rng(1).integers(-128, 128, (20, 30))
    y = ring.uniform(30, 10, 7)
    want = (x.astype(object) @ y.astype(object)) % (1 << 32)
    assert (ring.multiply(x, y) == want.astype(np.uint32)).all()


def test_squish_and_noise():
    m = np.random.default_rng(2).integers(0, 1024, (5, 7)).astype(np.uint32)
    assert (ring.unsquish(ring.squish(m), 7) == m).all()
    e = ring.gaussian(20_000, 3)
    assert abs(e).max() <= ring.TAIL and abs(e.std() - ring.SIGMA) < 0.2
    assert len(ring.secret(16)) == 16 and (ring.secret(16, 1) == ring.secret(16, 1)).all()


def test_blocks(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 32, s, dtype=np.uint32) for s in ((30, 20), (20, 25)))
    x, y = ring.to_blocks(spark, a, 8), ring.to_blocks(spark, b, 8)
    assert (ring.from_blocks(ring.multiply_blocks(x, y)) == ring.multiply(a, b)).all()
    assert (ring.from_blocks(ring.transpose_blocks(x)) == a.T).all()
    assert (ring.from_blocks(ring.add_blocks(x, x)) == a + a).all()


def test_simple_pir():
    params = ring.Params.pick(40, n=128)
    db = np.random.default_rng(5).integers(0, params.p, (12, 40))
    scheme, own = pir.SimplePIR(db, params), ring.secret(128, 9)
    for column in (0, 17, 39):
        got = scheme.recover(scheme.answer(scheme.query(column, own, ring.gaussian(40, column))), own)
        assert (got == db[:, column]).all()
    with pytest.raises(ValueError):
        pir.SimplePIR(db + params.p, params)


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(6)
    rows = [(c, i, [int(x) for x in rng.integers(-128, 128, 8)]) for c in range(4) for i in range(5 + c)]
    return spark.createDataFrame(rows, "cluster int, local_idx int, qvec array<smallint>").repartition(3)


@pytest.mark.parametrize("noisy", [False, True])
def test_embedding_products(members, noisy):
    scheme = pir.EmbeddingScheme(4, 8, n=32)
    rng = np.random.default_rng(8)
    wanted = [(i, c, rng.integers(-128, 128, 8)) for i, c in enumerate([0, 3, 3])]
    got = {(r.ct, r.local_idx): r.value for r in pir.private_products(members, scheme, wanted, seed=1, noisy=noisy).collect()}
    held = {(r.cluster, r.local_idx): np.array(r.qvec, int) for r in members.collect()}
    for ct, c, q in wanted:
        for i in range(5 + c):
            # The noise of a row comes from all clusters' vectors at its place.
            norm = np.sqrt(sum((held[x, i] ** 2).sum() for x in range(4) if (x, i) in held))
            off = got[ct, i] - int(q @ held[c, i])
            assert off == 0 if not noisy else abs(off) <= 6 * scheme.expected_noise(norm) + 1


def test_neighbour_columns_are_exact(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(20)], "node_id long, cluster int")
    e = spark.createDataFrame([(i, s, (i * 7 + 3 * (s + 1)) % 20) for i in range(20) for s in range(1 + i % 3)], "node_id long, slot int, nbr long")
    laid = layout.layout(a, 4).cache()
    sizes = layout.shape(laid, 4, 3)
    encoded = layout.encoded_neighbours(e, laid, sizes)
    cells = layout.database_cells(encoded, laid, sizes)
    scheme = pir.NeighbourScheme(sizes, n=32)
    got = pir.column_parts(pir.private_columns(cells, scheme, {c: c for c in range(sizes.columns)}, seed=2), sizes)
    codes_ = got.withColumn("code", codes.join_parts(F.col("parts"))).where("code is not null")
    back = {(r.new_id, r.slot, r.code) for r in codes_.join(laid.select(F.col("sg_col").alias("ct"), "idx_in_sg", "new_id"), ["ct", "idx_in_sg"]).collect()}
    assert back == {(r.new_id, r.slot, r.code) for r in encoded.collect()}
    with pytest.raises(ValueError):
        scheme.query(sizes.columns, ring.secret(32, 1))
