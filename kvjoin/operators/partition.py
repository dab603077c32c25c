"""Partitioning made visible: histograms, offsets, slots, packets and the exchange between ranks.

Input is a placed relation (lvalue, rvalue, pos, bank, rank); the target bank of a row is
its partition hash masked by the number of banks, a power of two. Rows with the reserved
key belong to no partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvjoin.functions.hashes import h_local, with_h_glb
from kvjoin.relation import BANKS, TUPLE_BYTES, nonzero

FILL, LEGACY_FILL = 1935, 2000  # rows of a local partition
PACKET = 16
PACKETS = (8, 16, 32, 64, 128)


def targets(placed: DataFrame, ranks: int) -> DataFrame:
    """placed with dst_bank and dst_rank."""
    h = with_h_glb(nonzero(placed), "lvalue", "_h")
    return h.withColumn("dst_bank", F.col("_h").bitwiseAND(F.lit(ranks * BANKS - 1))).withColumn("dst_rank", F.floor(F.col("dst_bank") / BANKS).cast("long")).drop("_h")


def histogram(placed: DataFrame, ranks: int) -> DataFrame:
    """(bank, dst_bank, n)."""
    return targets(placed, ranks).groupBy("bank", "dst_bank").agg(F.count(F.lit(1)).alias("n"))


def offsets(hist: DataFrame) -> DataFrame:
    """hist with the exclusive prefix sum of n over dst_bank, within each source bank."""
    w = Window.partitionBy("bank").orderBy("dst_bank").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def packet_histogram(placed: DataFrame, ranks: int, packet: int = PACKET) -> DataFrame:
    """(src_rank, dst_rank, n_rows, most, packets): packets for the fullest bank pair, one at least."""
    per = packet // TUPLE_BYTES
    banks = targets(placed, ranks).groupBy("rank", "dst_rank", "bank", "dst_bank").agg(F.count(F.lit(1)).alias("n"))
    sums = banks.groupBy(F.col("rank").alias("src_rank"), "dst_rank").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"))
    return sums.withColumn("packets", F.greatest(F.ceil(F.col("most") / per), F.lit(1)).cast("long"))


def slots(placed: DataFrame, ranks: int, packet: int = PACKET) -> DataFrame:
    """(bank, dst_bank, lvalue, rvalue, slot, packet_no): a slot for each row in its (source, target) run, by key and payload."""
    if packet not in PACKETS:
        raise ValueError(f"packet size: {packet}")
    w = Window.partitionBy("bank", "dst_bank").orderBy("lvalue", "rvalue", "pos")
    shift = (packet // TUPLE_BYTES).bit_length() - 1
    t = targets(placed, ranks).withColumn("slot", (F.row_number().over(w) - 1).cast("long"))
    return t.select("bank", "dst_bank", "lvalue", "rvalue", "slot", F.shiftright("slot", shift).alias("packet_no"))


def exchange(placed: DataFrame, ranks: int) -> DataFrame:
    """(src_rank, dst_rank, n_rows)."""
    return targets(placed, ranks).groupBy(F.col("rank").alias("src_rank"), "dst_rank").agg(F.count(F.lit(1)).alias("n_rows"))


def fan_out(rows: Column, fill: int = FILL) -> Column:
    """Local partitions of a bank: 1 below the fill, else the power of two above rows / fill."""
    q = F.floor(rows / fill).cast("long")
    return F.when(q == 0, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), F.length(F.bin(q))).cast("long"))


def local_numbers(placed: DataFrame, ranks: int, fill: int = FILL) -> DataFrame:
    """(dst_bank, n, parts)."""
    per = targets(placed, ranks).groupBy("dst_bank").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("parts", fan_out(F.col("n"), fill))


def local_histogram(placed: DataFrame, ranks: int, fill: int = FILL) -> DataFrame:
    """(dst_bank, part, n): second-level hash partitions of each bank."""
    t = targets(placed, ranks)
    parts = t.groupBy("dst_bank").agg(F.count(F.lit(1)).alias("rows")).select("dst_bank", fan_out(F.col("rows"), fill).alias("parts"))
    held = t.join(F.broadcast(parts), "dst_bank")  # a row for each bank: 64 * ranks
    return held.withColumn("part", h_local(F.col("lvalue")).bitwiseAND(F.col("parts") - 1)).groupBy("dst_bank", "part").agg(F.count(F.lit(1)).alias("n"))


def global_partition(df: DataFrame, n: int) -> DataFrame:
    """df without the reserved key, with part, its partition (the partition hash masked by n, a power of two), dealt out by it: the map side of a shuffle."""
    h = with_h_glb(nonzero(df), "lvalue", "_h")
    return h.withColumn("part", F.col("_h").bitwiseAND(F.lit(n - 1))).drop("_h").repartition(n, "part")


def global_partition_legacy(placed: DataFrame, ranks: int) -> DataFrame:
    """(dst_bank, n, n_reserved): counts that keep the reserved key, and flag it."""
    h = with_h_glb(placed.where("lvalue IS NOT NULL"), "lvalue", "_h").withColumn("dst_bank", F.col("_h").bitwiseAND(F.lit(ranks * BANKS - 1)))
    return h.groupBy("dst_bank").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lvalue") == 0).alias("n_reserved"))


def range_buckets(df: DataFrame) -> DataFrame:
    """(n_bytes, lead, n): rows by the number of significant bytes of the key and its leading byte."""
    k = F.col("lvalue")
    size = F.when(k < 1 << 8, 1).when(k < 1 << 16, 2).when(k < 1 << 24, 3).otherwise(4)
    lead = F.when(k < 1 << 8, k).when(k < 1 << 16, F.shiftright(k, 8)).when(k < 1 << 24, F.shiftright(k, 16)).otherwise(F.shiftright(k, 24))
    return nonzero(df).groupBy(size.cast("long").alias("n_bytes"), lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))


def skew(hist: DataFrame) -> DataFrame:
    """(n_rows, n_parts, most, fill_factor): how even a histogram (…, n) is."""
    return hist.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_parts"), F.max("n").alias("most"), F.round(F.sum("n") / (F.max("n") * F.count(F.lit(1))), 6).alias("fill_factor"))
