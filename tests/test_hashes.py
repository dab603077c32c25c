"""Golden values of the hash functions and tuple ids."""

from pyspark.sql import functions as F

from kvjoin.functions import hashes as H

# key: glb, local, join, join2
GOLDEN = {
    1: (422304363, 0, 1359351956, 10338022),
    2: (1180826305, 0, 3355852812, 3469318313),
    3: (4060760068, 0, 2566934680, 899316653),
    100: (3737699799, 922755094, 1221984320, 3303938852),
    1000: (334435249, 2425356560, 299441138, 601082410),
    65535: (3088098351, 3020501182, 604022017, 2232509735),
    65536: (3620040168, 124634137, 1996959894, 552190131),
    123456789: (2044981827, 2677764100, 3470582554, 2195242050),
    2147483647: (2693159858, 1510429074, 3384288801, 1253333575),
}


def test_golden(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "k long")
    df = H.with_h_join2(H.with_h_glb(df, "k"), "k").select("k", "h_glb", H.h_local(F.col("k")), H.h_join(F.col("k")), "h_join2")
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == GOLDEN


def test_tids(spark):
    df = spark.createDataFrame([(31, 63, 2**21 - 1, 77), (0, 0, 0, 0), (3, 5, 9, 2**32 - 1)], "r long, b long, i long, key long")
    tid = H.tid_create(F.col("r"), F.col("b"), F.col("i"))
    packed = H.tid_key_pack(tid, F.col("key"))
    for r in df.select("*", tid.alias("t"), H.tid_owner(tid).alias("o"), H.tid_local(tid).alias("l"), H.tid_key_tid(packed).alias("pt"), H.tid_key_key(packed).alias("pk")).collect():
        assert r["t"] == r["i"] | r["r"] << 27 | r["b"] << 21
        assert (r["o"], r["l"], r["pt"], r["pk"]) == (r["r"] * 64 + r["b"], r["i"], r["t"], r["key"])


def test_low_bit(spark):
    assert [r[0] for r in spark.createDataFrame([(12,), (1,), (0,)], "k long").select(H.lowest_bit(F.col("k"))).collect()] == [2, 0, None]
