"""Linear probing made visible: where keys lie in the tables of a partitioned hash build, and what looking them up costs.

Keys are dealt over tables by the partition hash; a key's home is the join hash masked by the slots of a
table, and it takes the first free slot from there on, the table being a ring. Which slots are taken, and how
many extra probes all keys of a table need together, doesn't depend on the order of insertion; where a single key lies does, so
here keys are inserted by home, then key. Each table is one window of at most some thousand keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvjoin.functions.hashes import SLOTS, h_join, with_h_glb
from kvjoin.operators.partition import FILL
from kvjoin.relation import valid_key


def tables_for(n: int, fill: int = FILL) -> int:
    """Tables of a build side of n keys: 1 below the fill, else the power of two above n / fill."""
    return 1 if n < fill else 1 << (n // fill).bit_length()


def homes(keys: DataFrame, tables: int) -> DataFrame:
    """keys (lvalue, …), the valid ones, with part (the table) and home (the slot asked first)."""
    h = with_h_glb(keys.where(valid_key(F.col("lvalue"))), "lvalue", "_h").withColumn("part", F.col("_h").bitwiseAND(F.lit(tables - 1))).drop("_h")
    return h.withColumn("home", h_join(F.col("lvalue")).bitwiseAND(F.lit(SLOTS - 1)))


def _laps(build: DataFrame, tables: int) -> DataFrame:
    """(part, lvalue, home, lap, at): the ring is unrolled three times. The middle lap has what the first one pushes over its end, the last what a run that ends there needs."""
    keys = homes(build.select("lvalue").distinct(), tables)
    room = Window.partitionBy("part")
    keys = keys.withColumn("_n", F.count(F.lit(1)).over(room))
    full = F.raise_error(F.concat(F.lit("no empty slot in table "), F.col("part").cast("string"))).cast("long")
    laps = keys.withColumn("home", F.when(F.col("_n") < SLOTS, F.col("home")).otherwise(full)).drop("_n").withColumn("lap", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    x = F.col("home") + F.col("lap") * SLOTS
    order = Window.partitionBy("part").orderBy(x, "lvalue")
    i = F.row_number().over(order)
    ahead = laps.withColumn("_i", i).withColumn("_x", x)
    # The first free slot: as far behind the key before it as that one was pushed.
    pushed = F.max(F.col("_x") - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ahead.withColumn("at", (pushed + F.col("_i")).cast("long")).drop("_i", "_x")


def slots(build: DataFrame, tables: int) -> DataFrame:
    """(part, lvalue, home, slot, extra) for each distinct valid key of build; extra: slots asked in vain before its own. A table without an empty slot raises."""
    mid = _laps(build, tables).where("lap = 1")
    return mid.select("part", "lvalue", "home", F.col("at").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), (F.col("at") - F.col("home") - SLOTS).alias("extra"))


def probes(build: DataFrame, probe: DataFrame, tables: int) -> DataFrame:
    """(part, probed, hits, hit_extra, empty, empty_extra): look-ups of probe's valid keys by table. A look-up ends at its key (a hit) or at an empty slot; extra: slots asked before."""
    laps = _laps(build, tables)
    order = Window.partitionBy("part").orderBy("at")
    run = laps.withColumn("_run", F.col("at") - F.row_number().over(order))
    runs = run.withColumn("_end", F.max("at").over(Window.partitionBy("part", "_run"))).where(f"at >= {SLOTS} AND at < {2 * SLOTS}")
    taken = runs.select("part", (F.col("at") - SLOTS).alias("home"), (F.col("_end") + 1 - F.col("at")).alias("_miss"))
    found = slots(build, tables).select("part", "lvalue", F.col("extra").alias("_hit"))
    # Counted by key first: a hot probe key is one row of the joins.
    asked = homes(probe.select("lvalue").groupBy("lvalue").agg(F.count(F.lit(1)).alias("_n")), tables)
    out = asked.join(found, ["part", "lvalue"], "left").join(taken, ["part", "home"], "left")
    hit, n = F.col("_hit").isNotNull(), F.col("_n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return out.groupBy("part").agg(
        total(n).alias("probed"), total(F.when(hit, n)).alias("hits"), total(n * F.col("_hit")).alias("hit_extra"),
        total(F.when(~hit, n)).alias("empty"), total(F.when(~hit, n * F.coalesce("_miss", F.lit(0)))).alias("empty_extra"),
    )
