import math

import pytest

from sparkann.functions import codes
from sparkann.functions import vectors as vf
from sparkann.functions.quantizer import FIVE_BIT_SIGNED, UNSIGNED_BYTES, Quantizer, auto_scale, data_range, four_bit, from_four_bit
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, [3.0, 4.0], [1.0, 2.0]), (2, [0.0, 0.0], [1.0, 0.0])], "id int, a array<float>, b array<float>")


def test_distances(pairs):
    rows = pairs.orderBy("id").select(vf.norm("a"), vf.dot("a", "b"), vf.l2_squared("a", "b"), vf.distance("a", "b", "ip"), vf.distance("a", "b", "cosine")).collect()
    assert rows[0][0] == pytest.approx(5) and rows[0][1:4] == (11.0, 8.0, -11.0)
    assert rows[0][4] == pytest.approx(1 - 11 / (5 * math.sqrt(5)))
    assert rows[1][0] == pytest.approx(1e-5) and rows[1][4] == pytest.approx(1)  # a zero vector has the norm of the epsilon
    with pytest.raises(ValueError):
        vf.distance("a", "b", "manhattan")


def test_different_lengths_have_no_distance(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vf.dot("a", "b")).first()[0] is None


def test_sql_functions(spark, pairs):
    assert "vec_ip" in vf.register(spark)
    pairs.createOrReplaceTempView("pairs")
    row = spark.sql("SELECT vec_ip(a, b), vec_l2sq(a, b), vec_norm(a), vec_normalize(a), vec_quantize(b, 100, -128, 127) FROM pairs WHERE id = 1").first()
    assert row[0] == 11 and row[1] == 8 and row[2] == pytest.approx(5) and row[3][0] == pytest.approx(0.6) and row[4] == [100, 127]
    assert spark.sql("SELECT pir_delta(32, 16777216), pir_round(512 + 100, 256, 991), pir_recover_signed(CAST(4294967296 - 256 AS BIGINT), 0, 256)").first()[:] == (256, 2, -1)


def test_quantizer(spark):
    df = spark.createDataFrame([(0, [3.0, -4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "id int, embedding array<float>")
    assert data_range(df) == {"low": -4.0, "high": 3.0, "is_signed": True}
    q = Quantizer().fit(df)
    assert q.scale == pytest.approx(127 / (1.0 + 1e-6), rel=1e-6) and (q.low, q.high) == (-128, 127)
    assert [list(r[0]) for r in df.orderBy("id").select(q("embedding")).collect()] == [[76, -102], [0, 0], [127, 0]]
    assert Quantizer(scale=3.0).fit(df).scale == 3.0  # a given scale is kept
    assert Quantizer(is_unsigned=True).fit(df).scale == pytest.approx(255 / (2.0 + 1e-6), rel=1e-6)
    assert Quantizer(is_unsigned=True, normalize=False).trained(1, 5).scale == pytest.approx(255 / (4 + 1e-6))
    assert Quantizer.from_json(q.to_json()) == q
    assert (FIVE_BIT_SIGNED.low, FIVE_BIT_SIGNED.high, UNSIGNED_BYTES.high) == (-16, 15, 255)
    assert auto_scale(-2, 1) == 63.5 and auto_scale(0, 5) == 51
    with pytest.raises(ValueError):
        Quantizer()("embedding")
    with pytest.raises(ValueError):
        Quantizer().fit(df.limit(0))


def test_four_bits(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 1.0, 9.0],)], "v array<double>")
    assert df.select(four_bit("v")).first()[0] == [0, 7, 15, 15]
    assert df.select(from_four_bit(four_bit("v"))).first()[0][2] == 1.0


def test_codes(spark):
    df = spark.createDataFrame([(3, 5, 12345)], "c int, l int, n long")
    code = codes.pack_id(F.col("c"), F.col("l"), 4)
    row = df.select(code, codes.split_parts(code, 2), codes.split_parts(F.col("n"), 3), codes.join_parts(codes.split_parts(F.col("n"), 3)), *codes.unpack_id(code, 4)).first()
    assert row[:] == (53, [53, 0], [57, 96, 0], 12345, 3, 5)
    assert df.select(codes.join_parts(F.array(F.lit(127), F.lit(127)))).first()[0] is None
    digits = df.select(codes.base_digits(F.col("n"), 10, 5).alias("d"))
    assert digits.first()[0] == [5, 4, 3, 2, 1]
    assert digits.select(codes.from_base_digits(F.col("d"), 10)).first()[0] == 12345
    assert codes.digits_in_base(32, 991) == 4


@pytest.mark.parametrize("compat, want", [(False, [-1, -2, -3, -4, 7]), (True, [0, -1, -2, -3, 7])])
def test_signed_recovery(spark, compat, want):
    d = codes.delta(1 << 24)
    df = spark.createDataFrame([(i, (v * d) % codes.RING) for i, v in enumerate([-1, -2, -3, -4, 7])], "i int, x long")
    assert [r[0] for r in df.orderBy("i").select(codes.recover_signed(F.col("x"), F.lit(0), compat=compat)).collect()] == want


def test_sizes():
    assert codes.auto_clusters(10**6, 128) == 88 and codes.auto_clusters(5, 64) == 1
    assert codes.bits_for(88) == 7 and codes.bits_for(11931) == 14 and codes.parts_for(21) == 3
    assert codes.subgroup_size(10**6, 16, 3) == 120
    assert codes.prune_factor(100, True) == 0.85 and codes.prune_factor(6000, False) == 0.50 and codes.prune_factor(30_000, False) == 0.65
    t = codes.traffic(88, 128, 11931, 8800, 11520)
    assert t["embedding_query_bytes"] == 45056 and t["embedding_answer_bytes"] == 47724


def test_levels_fall_off(spark):
    counts = {r[0]: r[1] for r in spark.range(20_000).select(codes.hnsw_level(codes.uniform(F.col("id")), 16).alias("l")).groupBy("l").count().collect()}
    assert counts[0] > 14 * counts[1] and max(counts) <= 15
