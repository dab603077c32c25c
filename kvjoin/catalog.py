"""Every query of the library, by name, with its oracle in SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvjoin.functions import hashes as H
from kvjoin.operators import aggregates, joins, partition, probing, projections, selections, sorts
from kvjoin.plans import steps
from kvjoin.relation import BANKS, load_column, nonzero, padding, placed, relation, violations
from kvjoin.sources import tables as blocks
from kvjoin.streaming.probe import run_probe

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
RANKS = 2  # of the placed relations in the partition queries

#: Join pairs: build table, key, payload, probe table, key, payload.
PAIRS = {
    "": ("orders", "o_orderkey", "o_custkey", "lineitem", "l_orderkey", "l_partkey"),
    "_customer_orders": ("customer", "c_custkey", "c_nationkey", "orders", "o_custkey", "o_orderkey"),
    "_part_lineitem": ("part", "p_partkey", "p_size", "lineitem", "l_partkey", "l_orderkey"),
    "_supplier_lineitem": ("supplier", "s_suppkey", "s_nationkey", "lineitem", "l_suppkey", "l_orderkey"),
    "_nation_customer": ("nation", "n_nationkey", "n_regionkey", "customer", "c_nationkey", "c_custkey"),
}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rel(spark: SparkSession, sf: str, name: str, key: str, payload: str) -> DataFrame:
    return load_column(spark, f"{sf}/{name}.parquet", key, payload)


def sides(spark: SparkSession, sf: str, pair: str = "") -> tuple[DataFrame, DataFrame]:
    a, ak, av, b, bk, bv = PAIRS[pair]
    return rel(spark, sf, a, ak, av), rel(spark, sf, b, bk, bv)


def failed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A build side with misses."""
    return relation(table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey", "o_custkey")


# Scans, sources, sinks
add("load_column", "SELECT o_orderkey AS lvalue, o_custkey AS rvalue FROM orders")(lambda s, d: rel(s, d, "orders", "o_orderkey", "o_custkey"))
add("send_data", "SELECT l_orderkey AS lvalue, l_partkey AS rvalue FROM lineitem")(lambda s, d: rel(s, d, "lineitem", "l_orderkey", "l_partkey").repartition(BANKS))
add("recv_data", "SELECT (h & 63) AS part, count(*) AS n FROM (SELECT o_orderkey AS h FROM orders WHERE o_orderkey <> 0) GROUP BY 1")(
    lambda s, d: nonzero(rel(s, d, "orders", "o_orderkey", "o_custkey")).groupBy(F.col("lvalue").bitwiseAND(F.lit(63)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
)

# The placed relation: orders dealt over RANKS ranks in the order of their keys
_PLACED = f"""SELECT o_orderkey AS lvalue, o_custkey AS rvalue, pos, pos // per AS bank, pos // per // {BANKS} AS rank FROM (
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS pos FROM orders),
  (SELECT (count(*) + {RANKS * BANKS} - count(*) % {RANKS * BANKS}) // {RANKS * BANKS} AS per FROM orders)"""


def place(spark: SparkSession, sf: str) -> DataFrame:
    r = rel(spark, sf, "orders", "o_orderkey", "o_custkey")
    return placed(r, RANKS, ["lvalue", "rvalue"], r.count())


add("load_placement", _PLACED)(place)


# Hashes in portable SQL: a sub-select for each step, on h
def _sql_steps(base: str, steps_: list[str]) -> str:
    for e in steps_:
        base = f"SELECT * EXCLUDE (h), {e} AS h FROM ({base})"
    return base


def _add(e: str) -> str:
    return f"(h + ({e})) & 4294967295"


def _xor(e: str) -> str:
    return f"xor(h, {e})"


_L = "((h << {}) & 4294967295)"
_GLB = [
    f"xor((h << 16) & 4294967295, xor((((lvalue >> 16) & 65535) << 11) & 4294967295, h))",
    _add("h >> 11"), _xor(_L.format(3)), _add("h >> 5"), _xor(_L.format(4)), _add("h >> 17"), _xor(_L.format(25)), _add("h >> 6"),
]


def _sql_glb(source: str) -> str:
    return _sql_steps(f"SELECT *, (lvalue & 65535) + {H.GLB_SEED} AS h FROM ({source})", _GLB)


_CRC = "[" + ",".join(map(str, H.crc_table())) + "]::BIGINT[]"


def _sql_table(k: str, mask: int) -> str:
    at = lambda i: f"t[(({k} >> {8 * i}) & 255) + 1]"
    return f"xor(xor(xor({mask} & {at(0)}, {at(1)}), {at(2)}), {at(3)})"


_ORDERS = "SELECT o_orderkey AS lvalue, o_custkey AS rvalue FROM orders"
_JOIN2 = [e for i in range(4) for e in (_add(f"(lvalue >> {8 * i}) & 255"), _add(_L.format(10)), _xor("(h >> 6)"))]
_JOIN2 += [_add(_L.format(3)), _xor("(h >> 11)"), _add(_L.format(15))]


def hashed(spark: SparkSession, sf: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return f(rel(spark, sf, "orders", "o_orderkey", "o_custkey").select("lvalue"))


def _column(name: str, of: Callable) -> Query:
    return lambda s, d: hashed(s, d, lambda x: x.withColumn(name, of(F.col("lvalue"))))


add("h_glb", f"SELECT lvalue, h AS h_glb FROM ({_sql_glb(_ORDERS)})")(lambda s, d: hashed(s, d, lambda x: H.with_h_glb(x, "lvalue")))
add("h_join2", f"SELECT lvalue, h AS h_join2 FROM ({_sql_steps(f'SELECT lvalue, 0::BIGINT AS h FROM ({_ORDERS})', _JOIN2)})")(lambda s, d: hashed(s, d, lambda x: H.with_h_join2(x, "lvalue")))
for _n in ("h_join", "h_tabulation"):
    add(_n, f"SELECT lvalue, {_sql_table('lvalue', H.JOIN_MASK)} AS {_n} FROM ({_ORDERS}), (SELECT {_CRC} AS t)")(_column(_n, H.h_join))
add("h_local", f"SELECT lvalue, {_sql_table('(lvalue >> 6)', H.LOCAL_MASK)} AS h_local FROM ({_ORDERS}), (SELECT {_CRC} AS t)")(_column("h_local", H.h_local))
add("h_double1", f"SELECT lvalue, lvalue % 4096 AS h_double1 FROM ({_ORDERS})")(_column("h_double1", H.h_double1))
add("h_double2", f"SELECT lvalue, 7 - lvalue % 7 AS h_double2 FROM ({_ORDERS})")(_column("h_double2", H.h_double2))
add("log2_lowest_bit", f"SELECT lvalue, (log2((lvalue & -lvalue)::DOUBLE))::BIGINT AS low FROM ({_ORDERS}) WHERE lvalue <> 0")(
    lambda s, d: hashed(s, d, lambda x: nonzero(x).withColumn("low", H.lowest_bit(F.col("lvalue")).cast("long")))
)
add("packet_tid", f"SELECT lvalue, (lvalue // 15) * 128 + 8 + (lvalue % 15) * 8 AS packet_tid FROM ({_ORDERS})")(_column("packet_tid", lambda k: H.packet_tid(F.floor(k / 15), k % 15)))

_TIDS = f"SELECT lvalue, pos, bank % {BANKS} AS b, rank, pos - bank * per AS i, ((pos - bank * per) | (rank << 27) | ((bank % {BANKS}) << 21)) AS tid FROM ({_PLACED}), (SELECT (count(*) + {RANKS * BANKS} - count(*) % {RANKS * BANKS}) // {RANKS * BANKS} AS per FROM orders)"


def tids(spark: SparkSession, sf: str) -> DataFrame:
    r = rel(spark, sf, "orders", "o_orderkey", "o_custkey")
    n = r.count()
    local = F.col("pos") - F.col("bank") * padding(n, RANKS)[1]
    return placed(r, RANKS, ["lvalue", "rvalue"], n).withColumn("tid", H.tid_create(F.col("rank"), F.col("bank") % BANKS, local))


add("tid_create", f"SELECT lvalue, tid FROM ({_TIDS})")(lambda s, d: tids(s, d).select("lvalue", "tid"))
add("tid_owner", f"SELECT lvalue, rank * {BANKS} + b AS owner FROM ({_TIDS})")(lambda s, d: tids(s, d).select("lvalue", H.tid_owner(F.col("tid")).alias("owner")))
add("tid_local", f"SELECT lvalue, i AS local FROM ({_TIDS})")(lambda s, d: tids(s, d).select("lvalue", H.tid_local(F.col("tid")).alias("local")))
add("tid_key_pack", f"SELECT lvalue, (tid << 32) | lvalue AS packed FROM ({_TIDS})")(lambda s, d: tids(s, d).select("lvalue", H.tid_key_pack(F.col("tid"), F.col("lvalue")).alias("packed")))


@add("tid_key_unpack", f"SELECT tid, lvalue AS key FROM ({_TIDS})")
def _unpack(s: SparkSession, d: str) -> DataFrame:
    p = H.tid_key_pack(F.col("tid"), F.col("lvalue"))
    return tids(s, d).select(p.alias("p")).select(H.tid_key_tid(F.col("p")).alias("tid"), H.tid_key_key(F.col("p")).alias("key"))


add("tid_partition", f"SELECT tid >> 21 AS owner, count(*) AS n FROM ({_TIDS}) GROUP BY 1")(lambda s, d: tids(s, d).groupBy(F.shiftright("tid", 21).alias("owner")).agg(F.count(F.lit(1)).alias("n")))
add("tid_squeeze", f"SELECT tid >> 21 AS part, count(*) AS n_rows, count(DISTINCT tid) AS n_tids FROM ({_TIDS}) GROUP BY 1")(lambda s, d: aggregates.squeeze(tids(s, d).withColumn("part", F.shiftright("tid", 21)), "part", "tid"))
add("encode_string", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part WHERE p_brand IS NOT NULL")(lambda s, d: selections.encode(table(s, d, "part"), "p_brand").select("p_partkey", "code"))

# Key domain
add("filter_nonzero_key", "SELECT l_orderkey AS lvalue, l_partkey AS rvalue FROM lineitem WHERE l_orderkey <> 0")(lambda s, d: nonzero(rel(s, d, "lineitem", "l_orderkey", "l_partkey")))
add("validate_key_range", "SELECT l_orderkey - 1 AS lvalue, l_partkey AS rvalue, CASE WHEN l_orderkey = 1 THEN 'reserved' ELSE 'negative' END AS reason FROM lineitem WHERE l_orderkey <= 1")(
    lambda s, d: violations(rel(s, d, "lineitem", "l_orderkey", "l_partkey").withColumn("lvalue", F.col("lvalue") - 1))
)


# Joins
def _sql_join(pair: str, where: str = "") -> str:
    a, ak, av, b, bk, bv = PAIRS[pair]
    return f"SELECT r.{av}::BIGINT AS lvalue, s.{bv}::BIGINT AS rvalue FROM {a} r JOIN {b} s ON r.{ak} = s.{bk} WHERE r.{ak} <> 0 {where}"


for _alg in ("phj", "smj", "nphj", "mpsm"):
    for _pair in PAIRS:
        add(f"join_{_alg}{_pair}", _sql_join(_pair))(lambda s, d, a=_alg, p=_pair: joins.join(*sides(s, d, p), a))
add("join_nl", _sql_join("_nation_customer"))(lambda s, d: joins.join(*sides(s, d, "_nation_customer"), "nl"))
add("join_theta", "SELECT n_regionkey::BIGINT AS lvalue, s_suppkey AS rvalue FROM nation JOIN supplier ON n_nationkey < s_nationkey WHERE n_nationkey <> 0 AND s_nationkey <> 0")(
    lambda s, d: joins.theta(rel(s, d, "nation", "n_nationkey", "n_regionkey"), rel(s, d, "supplier", "s_nationkey", "s_suppkey"), "rk < sk")
)
_F = "(SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <> 0)"
_L1 = "(SELECT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_orderkey <> 0)"
add("project_join_output", f"SELECT r.v AS lvalue, s.v AS rvalue FROM {_F} r JOIN {_L1} s USING (k)")(lambda s, d: joins.join(failed_orders(s, d), sides(s, d)[1]))
add("hash_build", "SELECT l_orderkey AS lvalue, count(*) AS n FROM lineitem WHERE l_orderkey <> 0 GROUP BY 1 HAVING count(*) > 1")(lambda s, d: joins.duplicates(sides(s, d)[1]))
add("hash_probe", f"SELECT s.k AS key, s.v AS rvalue, s.k IN (SELECT k FROM {_F}) AS hit FROM {_L1} s")(lambda s, d: joins.probe(failed_orders(s, d), sides(s, d)[1]))
_STATS = f"SELECT count(*) AS probed, count(*) FILTER (WHERE s.k IN (SELECT k FROM {_F})) AS hits, count(*) FILTER (WHERE s.k NOT IN (SELECT k FROM {_F})) AS unmatched FROM {_L1} s"
add("probe_stats", _STATS)(lambda s, d: joins.probe_stats(failed_orders(s, d), sides(s, d)[1]))
add("smj_inplace", f"SELECT coalesce(r.v, s.k) AS lvalue, s.v AS rvalue FROM {_L1} s LEFT JOIN {_F} r USING (k)")(lambda s, d: joins.in_place(failed_orders(s, d), sides(s, d)[1]))
add("finish_join", f"SELECT * FROM ({_sql_join('_nation_customer')})")(
    lambda s, d: joins.finish(joins.padded(joins.join(*sides(s, d, "_nation_customer")), BANKS))
)


# Slots of the linear-probing tables
def _sql_laps(keys: str, parts: str) -> str:
    return f"""SELECT part, lvalue, home, lap, max(x - i) OVER (PARTITION BY part ORDER BY i ROWS UNBOUNDED PRECEDING) + i AS z
      FROM (SELECT part, lvalue, home, lap, home + lap * {H.SLOTS} AS x, row_number() OVER (PARTITION BY part ORDER BY home + lap * {H.SLOTS}, lvalue) AS i
            FROM ({_sql_homes(f'SELECT DISTINCT lvalue FROM ({keys}) WHERE lvalue <> 0', parts)}), (SELECT unnest(range(3)) AS lap))"""


def _sql_homes(keys: str, parts: str) -> str:
    return f"SELECT * EXCLUDE (h, parts, t), h & (parts - 1) AS part, {_sql_table('lvalue', H.JOIN_MASK)} & {H.SLOTS - 1} AS home FROM ({_sql_glb(keys)}), (SELECT {parts}::BIGINT AS parts), (SELECT {_CRC} AS t)"


def _sql_slots(keys: str, parts: str) -> str:
    return f"SELECT part, lvalue, home, (z & {H.SLOTS - 1})::BIGINT AS slot, (z - home - {H.SLOTS})::BIGINT AS extra FROM ({_sql_laps(keys, parts)}) WHERE lap = 1"


_BUILD = "SELECT o_orderkey AS lvalue FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <> 0"
_TABLES = "(SELECT CASE WHEN count(*) < {0} THEN 1 ELSE 1 << length(bin(count(*) // {0})) END FROM ({1}))".format(partition.FILL, _BUILD)


def _tables(build: DataFrame) -> int:
    return probing.tables_for(nonzero(build).count())


add("hash_slots", _sql_slots(_BUILD, _TABLES))(lambda s, d: probing.slots(failed_orders(s, d), _tables(failed_orders(s, d))))
add(
    "hash_probe_cost",
    f"""WITH laps AS MATERIALIZED ({_sql_laps(_BUILD, _TABLES)}),
    runs AS (SELECT part, z, z - row_number() OVER (PARTITION BY part ORDER BY z) AS run FROM laps),
    taken AS (SELECT part, z - {H.SLOTS} AS home, last + 1 - z AS miss FROM (SELECT *, max(z) OVER (PARTITION BY part, run) AS last FROM runs) WHERE z BETWEEN {H.SLOTS} AND {2 * H.SLOTS - 1}),
    found AS (SELECT lvalue, z - home - {H.SLOTS} AS extra FROM laps WHERE lap = 1),
    asked AS ({_sql_homes('SELECT l_orderkey AS lvalue FROM lineitem WHERE l_orderkey <> 0', _TABLES)})
    SELECT part, count(*) AS probed, count(extra) AS hits, coalesce(sum(extra), 0)::BIGINT AS hit_extra, count(*) - count(extra) AS empty,
           coalesce(sum(CASE WHEN extra IS NULL THEN coalesce(miss, 0) END), 0)::BIGINT AS empty_extra
    FROM asked LEFT JOIN found USING (lvalue) LEFT JOIN taken USING (part, home) GROUP BY part""",
)(lambda s, d: probing.probes(failed_orders(s, d), sides(s, d)[1], _tables(failed_orders(s, d))))


# Named blocks, bucketed tables, streams
_blocks = itertools.count()


@add("store_retrieve", "SELECT o_orderkey AS lvalue, o_custkey AS rvalue FROM orders")
def _store(s: SparkSession, d: str) -> DataFrame:
    name = f"kvjoin_block_{next(_blocks)}"
    blocks.store(sides(s, d)[0], name)
    out = blocks.retrieve(s, name)
    blocks.free(s, name)
    return out


@add("join_bucketed", _sql_join(""))
def _bucketed(s: SparkSession, d: str) -> DataFrame:
    paths = [blocks.shared_path(s, f"kvjoin_{x}") for x in ("left", "right")]
    n = int(s.conf.get("spark.sql.shuffle.partitions"))
    left, right = (blocks.write_bucketed(df, p.rsplit("/", 1)[1], n, path=p) for df, p in zip(sides(s, d), paths, strict=True))
    return joins.join(left, right, "smj")


@add("probe_stream", _sql_join(""))
def _stream(s: SparkSession, d: str) -> DataFrame:
    left, right = sides(s, d)
    lines = table(s, d, "lineitem")
    stream = s.readStream.schema(lines.schema).parquet(f"{d}/lineitem.parque[t]")  # a stream wants a folder or a pattern
    return run_probe(left, relation(stream, "l_orderkey", "l_partkey"), blocks.shared_path(s, "kvjoin_stream"))


@add("join_chain", "SELECT c_nationkey::BIGINT AS lvalue, l_partkey AS rvalue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderkey <> 0 AND c_custkey <> 0")
def _chain(s: SparkSession, d: str) -> DataFrame:
    first = joins.join(*sides(s, d), "smj")  # (customer, part)
    return joins.join(rel(s, d, "customer", "c_custkey", "c_nationkey"), first, "phj")


# Partitioning
_T = f"SELECT *, (h & {RANKS * BANKS - 1}) AS dst_bank, (h & {RANKS * BANKS - 1}) // {BANKS} AS dst_rank FROM ({_sql_glb(f'SELECT * FROM ({_PLACED}) WHERE lvalue <> 0')})"
_FAN = "CASE WHEN {0} // {1} = 0 THEN 1 ELSE (1 << length(bin({0} // {1}))) END"
add("glb_partition", f"SELECT lvalue, rvalue, h & {BANKS - 1} AS part FROM ({_sql_glb('SELECT l_orderkey AS lvalue, l_partkey AS rvalue FROM lineitem WHERE l_orderkey <> 0')})")(lambda s, d: partition.global_partition(sides(s, d)[1], BANKS))
_HIST = f"SELECT bank, dst_bank, count(*) AS n FROM ({_T}) GROUP BY 1, 2"
add("partition_histogram", _HIST)(lambda s, d: partition.histogram(place(s, d), RANKS))
add("partition_offsets", f'SELECT *, coalesce(sum(n) OVER (PARTITION BY bank ORDER BY dst_bank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ({_HIST})')(
    lambda s, d: partition.offsets(partition.histogram(place(s, d), RANKS))
)
_PACK = f"SELECT rank AS src_rank, dst_rank, sum(n)::BIGINT AS n_rows, max(n) AS most, greatest((max(n) + 1) // 2, 1) AS packets FROM (SELECT rank, dst_rank, bank, dst_bank, count(*) AS n FROM ({_T}) GROUP BY ALL) GROUP BY 1, 2"
add("packet_histogram", _PACK)(lambda s, d: partition.packet_histogram(place(s, d), RANKS))
add("partition_slots", f"SELECT bank, dst_bank, lvalue, rvalue, slot, slot // 2 AS packet_no FROM (SELECT *, row_number() OVER (PARTITION BY bank, dst_bank ORDER BY lvalue, rvalue, pos) - 1 AS slot FROM ({_T}))")(
    lambda s, d: partition.slots(place(s, d), RANKS)
)
add("exchange_matrix", f"SELECT rank AS src_rank, dst_rank, count(*) AS n_rows FROM ({_T}) GROUP BY 1, 2")(lambda s, d: partition.exchange(place(s, d), RANKS))
add("local_partition_num", f"SELECT dst_bank, n, {_FAN.format('n', 20)}::BIGINT AS parts FROM (SELECT dst_bank, count(*) AS n FROM ({_T}) GROUP BY 1)")(lambda s, d: partition.local_numbers(place(s, d), RANKS, 20))
for _n, _fill in (("local_partition_histogram", 20), ("local_partition_legacy", 30)):
    _LOCAL = f"SELECT dst_bank, ({_sql_table('(lvalue >> 6)', H.LOCAL_MASK)} & (parts - 1))::BIGINT AS part, count(*) AS n FROM ({_T}) JOIN (SELECT dst_bank, {_FAN.format('count(*)', _fill)} AS parts FROM ({_T}) GROUP BY 1) USING (dst_bank), (SELECT {_CRC} AS t) GROUP BY 1, 2"
    add(_n, _LOCAL)(lambda s, d, fill=_fill: partition.local_histogram(place(s, d), RANKS, fill))
add("global_partition_legacy", f"SELECT (h & {RANKS * BANKS - 1}) AS dst_bank, count(*) AS n, count(*) FILTER (WHERE lvalue = 0) AS n_reserved FROM ({_sql_glb(_PLACED)}) GROUP BY 1")(
    lambda s, d: partition.global_partition_legacy(place(s, d), RANKS)
)
add("mpsm_range_partition", "SELECT n_bytes::BIGINT AS n_bytes, k >> (8 * (n_bytes - 1)) AS lead, count(*) AS n FROM (SELECT l_orderkey AS k, CASE WHEN l_orderkey < 256 THEN 1 WHEN l_orderkey < 65536 THEN 2 WHEN l_orderkey < 16777216 THEN 3 ELSE 4 END AS n_bytes FROM lineitem WHERE l_orderkey <> 0) GROUP BY 1, 2")(
    lambda s, d: partition.range_buckets(sides(s, d)[1])
)
add("attr_partition_packet", "SELECT part, pos // 15 AS packet_no, count(*) AS n FROM (SELECT o_orderkey & 63 AS part, row_number() OVER (PARTITION BY o_orderkey & 63 ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1, 2")(
    lambda s, d: projections.packets(
        table(s, d, "orders").select(F.col("o_orderkey").bitwiseAND(F.lit(63)).alias("part"), "o_orderkey").selectExpr("part", "row_number() OVER (PARTITION BY part ORDER BY o_orderkey) - 1L AS pos"), "part"
    ).groupBy("part", "packet_no").agg(F.count(F.lit(1)).alias("n"))
)

# Sorts
_SORT = "SELECT l_orderkey AS lvalue, l_partkey AS rvalue, row_number() OVER (ORDER BY l_orderkey, l_partkey) - 1 AS pos FROM lineitem"
for _n, _alg in (("sort_quick", "quick"), ("sort_radix", "radix"), ("sort_merge", "merge"), ("sort_dispatch", "other")):
    add(_n, _SORT)(lambda s, d, a=_alg: sorts.sort(sides(s, d)[1], a))
add(
    "sort_bucket_histogram",
    f"SELECT least((o_orderkey - lo) // w, b - 1)::BIGINT AS bucket, count(*) AS n FROM orders, (SELECT lo, b, greatest((hi - lo) // b, 1) AS w FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, greatest(floor(count(*) / {sorts.BUCKET_ROWS})::BIGINT, 1) AS b FROM orders WHERE o_orderkey <> 0)) WHERE o_orderkey <> 0 GROUP BY 1",
)(lambda s, d: sorts.bucket_histogram(sides(s, d)[0]))
for _n, _c, _dir in (("sort_int", "p_size", "ASC"), ("sort_int_desc", "p_size", "DESC"), ("sort_string", "p_name", "ASC"), ("sort_string_desc", "p_name", "DESC")):
    add(_n, f"SELECT row_number() OVER (ORDER BY {_c} {_dir}, p_partkey) - 1 AS pos, p_partkey AS tid FROM part")(lambda s, d, c=_c, up=_dir == "ASC": sorts.sort_tids(table(s, d, "part"), c, "p_partkey", up))
add("sort_date", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey AS tid FROM orders")(lambda s, d: sorts.sort_tids(table(s, d, "orders"), "o_orderdate", "o_orderkey"))
add("sort_date_desc", "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos, o_orderkey AS tid FROM orders")(lambda s, d: sorts.sort_tids(table(s, d, "orders"), "o_orderdate", "o_orderkey", False))
add("sort_int64_with_tid", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos, o_orderkey AS tid FROM orders")(lambda s, d: sorts.sort_tids(table(s, d, "orders"), "o_custkey", "o_orderkey"))


# Selections: (name, table, ids, filter, SQL condition)
def _select(name: str, of: str, ids: str, how: Callable[[], object], sql: str) -> None:
    cols = ", ".join(ids.split())
    add(name, f"SELECT {cols} FROM {of} WHERE {sql}")(lambda s, d: table(s, d, of).where(how()).select(*ids.split()))


_LI = "l_orderkey l_partkey l_suppkey l_linenumber"
_OPS = {1: "<=", 2: ">=", 3: "<", 4: ">"}
for _k, _op in _OPS.items():
    _sfx = {1: "", 2: "_ge", 3: "_lt", 4: "_gt"}[_k]
    _select(f"sel_date{_sfx}", "lineitem", _LI, lambda k=_k: selections.compare(F.col("l_shipdate"), k, F.lit("1996-01-01").cast("timestamp")), f"l_shipdate {_op} TIMESTAMP '1996-01-01'")
    _select(f"sel_double{_sfx}", "lineitem", _LI, lambda k=_k: selections.compare(F.col("l_quantity"), k, 24.0), f"l_quantity {_op} 24.0")
    _select(f"sel_int64{_sfx}", "part", "p_partkey", lambda k=_k: selections.compare(F.col("p_size"), k, 25, True), f"p_size {_op} 25")
_select("sel_int64_eq", "part", "p_partkey", lambda: selections.compare(F.col("p_size"), 0, 25, True), "p_size = 25")
_select("sel_in", "part", "p_partkey", lambda: selections.is_in(F.col("p_size"), [1, 5, 9, 30]), "p_size IN (1, 5, 9, 30)")
_select("sel_in_string", "orders", "o_orderkey", lambda: selections.is_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_select("sel_between_8b", "lineitem", _LI, lambda: selections.between(F.col("l_discount"), 0.02, 0.06, True), "l_discount > 0.02 AND l_discount < 0.06")
_select("sel_between_int64", "part", "p_partkey", lambda: selections.between(F.col("p_size"), 10, 20), "p_size BETWEEN 10 AND 20")
_select("sel_between_date", "orders", "o_orderkey", lambda: selections.between(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
_select("sel_string_contains", "part", "p_partkey", lambda: selections.contains(F.col("p_name"), "g"), "contains(p_name, 'g')")
_select("sel_string_prefix", "orders", "o_orderkey", lambda: selections.is_prefix_of(F.col("o_orderstatus"), "FO"), "starts_with('FO', o_orderstatus)")
add("sel_encoded_string", "SELECT p_partkey FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part WHERE p_brand IS NOT NULL) WHERE code <= 3")(
    lambda s, d: selections.encode(table(s, d, "part"), "p_brand").where(selections.compare(F.col("code"), 1, 3, True)).select("p_partkey")
)
add("sel_date_date", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(selections.compare(F.col("o_orderdate"), 3, F.col("l_shipdate"))).select(*_LI.split())
)
add("sel_or", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_retailprice > 1500")(
    lambda s, d: selections.either(table(s, d, "part").where("p_size < 5").select("p_partkey"), table(s, d, "part").where("p_retailprice > 1500").select("p_partkey"))
)
add("selection_return", "SELECT count(*) AS n_rows, count(*) * 4 AS n_bytes FROM lineitem WHERE l_quantity <= 24.0")(
    lambda s, d: table(s, d, "lineitem").where(selections.compare(F.col("l_quantity"), 1, 24.0)).agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * 4).alias("n_bytes"))
)


# Projections
def _tids(s: SparkSession, d: str) -> DataFrame:
    return sorts.sort_tids(table(s, d, "part").where("p_size < 20"), "p_retailprice", "p_partkey")


_GATHER = "SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos, p_partkey AS tid, {} FROM part WHERE p_size < 20"


def _gathered(s: SparkSession, d: str, column: str, cast: str | None = None) -> DataFrame:
    return projections.gather(_tids(s, d), table(s, d, "part").select(F.col("p_partkey").alias("tid"), F.col(column).alias("value")), cast=cast)


add("proj_by_tid", _GATHER.format("p_name AS value"))(lambda s, d: _gathered(s, d, "p_name"))
add("proj_1b", _GATHER.format("p_size::TINYINT AS value"))(lambda s, d: _gathered(s, d, "p_size", "tinyint"))
add("proj_1b_unsorted", "SELECT p_partkey AS tid, p_size::TINYINT AS value FROM part WHERE p_size < 20")(lambda s, d: _gathered(s, d, "p_size", "tinyint").drop("pos"))
add("proj_8b", _GATHER.format("p_size::BIGINT AS value"))(lambda s, d: _gathered(s, d, "p_size", "bigint"))
add("proj_packet", f"SELECT *, pos // 15 AS packet_no, pos % 15 AS slot FROM ({_GATHER.format('p_retailprice AS value')})")(lambda s, d: projections.packets(_gathered(s, d, "p_retailprice"), "value"))
add("arith_expr", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select(*_LI.split(), F.round(projections.postfix(["l_extendedprice", 1, "l_discount", "SUB", "MUL", 1, "l_tax", "ADD", "MUL"]), 6).alias("charge"))
)


# Group-bys; sums of integers, so that both engines agree to the last digit
def _group(name: str, of: str, keys: str, value: str, pre: str = "") -> None:
    ks = ", ".join(keys.split())
    source = f"(SELECT {pre}, * FROM {of})" if pre else of
    head = f"{ks}, " if ks else ""
    sql = f"SELECT {head}count({value}) AS n, sum({value})::BIGINT AS total, min({value}) AS low, max({value}) AS high FROM {source}" + (f" GROUP BY {ks}" if ks else "")
    add(name, sql)(lambda s, d: aggregates.group_by(table(s, d, of).selectExpr("*", pre) if pre else table(s, d, of), keys.split(), value))


_group("groupby_int8", "part", "k", "p_partkey", "CAST(p_size AS TINYINT) AS k")
_group("groupby_int32", "lineitem", "l_linenumber", "l_partkey")
_group("groupby_int64", "lineitem", "l_suppkey", "l_partkey")
_group("groupby_key1", "events", "event_type", "user_id")
_group("groupby_key2", "lineitem", "l_returnflag l_linestatus", "l_orderkey")
_group("groupby_key3", "lineitem", "l_returnflag l_linestatus l_linenumber", "l_orderkey")
_group("agg_nokey", "lineitem", "", "l_orderkey")
add("aggregation", "SELECT count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, round(avg(l_quantity), 6) AS mean FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.round(F.avg("l_quantity"), 6).alias("mean"))
)
add("groupby_aggregation", "SELECT l_returnflag, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
)
add("hash_unique", "SELECT DISTINCT l_orderkey FROM lineitem")(lambda s, d: aggregates.unique(table(s, d, "lineitem"), ["l_orderkey"]))

# Statistics
add("join_log", f"SELECT s.k & 1 AS rank, count(*) AS probed, count(*) FILTER (WHERE s.k IN (SELECT k FROM {_F})) AS hits, count(*) FILTER (WHERE s.k NOT IN (SELECT k FROM {_F})) AS unmatched FROM {_L1} s GROUP BY 1")(
    lambda s, d: joins.probe(failed_orders(s, d), sides(s, d)[1]).groupBy(F.col("key").bitwiseAND(F.lit(1)).alias("rank")).agg(F.count(F.lit(1)).alias("probed"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("unmatched"))
)
add("rns_log", f"SELECT src_rank, dst_rank, n_rows * 8 AS n_bytes, most * 8 AS most_bytes, packets FROM ({_PACK})")(
    lambda s, d: partition.packet_histogram(place(s, d), RANKS).selectExpr("src_rank", "dst_rank", "n_rows * 8 AS n_bytes", "most * 8 AS most_bytes", "packets")
)
add("miss_rate", f"SELECT round(unmatched / probed, 9) AS miss_rate FROM ({_STATS})")(lambda s, d: joins.probe_stats(failed_orders(s, d), sides(s, d)[1]).select(F.round(F.col("unmatched") / F.col("probed"), 9).alias("miss_rate")))
add("fill_factor", f"SELECT src_rank, dst_rank, round(n_rows * 8 / (packets * 128), 9) AS fill_factor FROM ({_PACK})")(
    lambda s, d: partition.packet_histogram(place(s, d), RANKS).select("src_rank", "dst_rank", F.round(F.col("n_rows") * 8 / (F.col("packets") * 128), 9).alias("fill_factor"))
)
add("partition_skew", f"SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_parts, max(n) AS most, round(sum(n) / (max(n) * count(*)), 6) AS fill_factor FROM ({_HIST})")(lambda s, d: partition.skew(partition.histogram(place(s, d), RANKS)))
add("timeline", "SELECT i::INTEGER AS step, ['phj', 'smj', 'nl', 'nphj', 'mpsm'][i + 1] AS op, n AS n_rows, TRUE AS in_order FROM (SELECT unnest(range(5)) AS i), (SELECT count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey <> 0)")(
    lambda s, d: steps.timeline(s, {a: (lambda a=a: joins.join(*sides(s, d, "_nation_customer"), a).count()) for a in joins.ALGORITHMS}).select(
        "step", "op", "n_rows", (F.col("start_s") <= F.col("stop_s")).alias("in_order")
    )
)
add("run_plan", f"SELECT r.v AS lvalue, s.v AS rvalue FROM {_F} r JOIN {_L1} s USING (k)")(
    lambda s, d: steps.run_plan(
        [
            {"operator": "nonzero", "inputs": ["left"], "output": "r"},
            {"operator": "nonzero", "inputs": ["right"], "output": "s"},
            {"operator": "sync", "inputs": ["r"]},
            {"operator": "partition", "inputs": ["r"], "output": "rp", "n": BANKS},
            {"operator": "partition", "inputs": ["s"], "output": "sp", "n": BANKS},
            {"operator": "free", "inputs": ["r", "s"]},
            {"operator": "join", "inputs": ["rp", "sp"], "output": "j", "algorithm": "phj"},
            {"operator": "project", "inputs": ["j"], "output": "result", "lvalue": "lvalue", "rvalue": "rvalue"},
        ],
        {"left": failed_orders(s, d), "right": sides(s, d)[1]},
    )
)

# Arithmetic kernels, over two columns of each type
for _op, _spark, _sql in (("add", "{a} + {b}", "{a} + {b}"), ("mul", "{a} * {b}", "{a} * {b}"), ("div", "{a} {div} {b}", "{a} {div} {b}")):
    for _t, _st, _dt in (("int32", "int", "INTEGER"), ("int64", "bigint", "BIGINT"), ("float", "float", "FLOAT"), ("double", "double", "DOUBLE")):
        _whole = _t.startswith("int")
        _a, _b = ("l_linenumber", "(l_suppkey % 7 + 1)") if _whole else ("l_quantity", "l_tax + 1")
        _se = _spark.format(a=f"CAST({_a} AS {_st})", b=f"CAST({_b} AS {_st})", div="div" if _whole else "/")
        _de = _sql.format(a=f"CAST({_a} AS {_dt})", b=f"CAST({_b} AS {_dt})", div="//" if _whole else "/")
        _digits = "" if _whole else ", 3"
        _out = "bigint" if _whole else "double"
        add(f"ops_{_op}_{_t}", f"SELECT l_orderkey, l_linenumber, round(CAST({_de} AS {'BIGINT' if _whole else 'DOUBLE'}){_digits or ', 0'}){'::BIGINT' if _whole else ''} AS r FROM lineitem")(
            lambda s, d, e=_se, o=_out, w=_whole: table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"CAST({e} AS {o}) AS r" if w else f"round(CAST({e} AS {o}), 3) AS r")
        )
for _t, _st in (("int32", "int"), ("int64", "bigint")):
    add(f"ops_shl_{_t}", f"SELECT l_orderkey, l_linenumber, (l_orderkey << 1)::{'INTEGER' if _t == 'int32' else 'BIGINT'} AS r FROM lineitem")(
        lambda s, d, t=_st: table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"CAST(shiftleft(CAST(l_orderkey AS {t}), 1) AS {t}) AS r")
    )
add("hash_bench", f"SELECT count(*) AS n_slots, sum(n)::BIGINT AS n_keys, sum(n - 1)::BIGINT AS n_collisions, max(n) AS most FROM (SELECT {_sql_table('lvalue', H.JOIN_MASK)} & 4095 AS slot, count(*) AS n FROM (SELECT * FROM ({_ORDERS}) WHERE lvalue BETWEEN 1 AND 2048), (SELECT {_CRC} AS t) GROUP BY 1)")(
    lambda s, d: rel(s, d, "orders", "o_orderkey", "o_custkey").where("lvalue BETWEEN 1 AND 2048").groupBy(H.h_join(F.col("lvalue")).bitwiseAND(F.lit(H.SLOTS - 1)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    .agg(F.count(F.lit(1)).alias("n_slots"), F.sum("n").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_collisions"), F.max("n").alias("most"))
)
_BENCH = "SELECT o_orderkey AS lvalue FROM orders WHERE o_orderkey BETWEEN 1 AND 2048"
add("hash_bench_misses", f"SELECT count(*) AS n_keys, {H.SLOTS} - count(*) AS n_empty, sum(extra)::BIGINT AS n_misses FROM ({_sql_slots(_BENCH, '1')})")(
    lambda s, d: probing.slots(rel(s, d, "orders", "o_orderkey", "o_custkey").where("lvalue BETWEEN 1 AND 2048"), 1)
    .agg(F.count(F.lit(1)).alias("n_keys"), (F.lit(H.SLOTS) - F.count(F.lit(1))).alias("n_empty"), F.sum("extra").alias("n_misses"))
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
