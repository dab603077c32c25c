"""Projections by row id and arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {"ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b, "DIV": lambda a, b: a / b}
MAX_NODES = 10


def gather(tids: DataFrame, columns: DataFrame, tid: str = "tid", cast: str | None = None) -> DataFrame:
    """tids (pos, tid) with the other columns of `columns` (tid, ...), as `cast` if given."""
    out = tids.join(columns, tid)
    return out if not cast else out.select(*[F.col(c) if c in tids.columns else F.col(c).cast(cast).alias(c) for c in out.columns])


def packets(gathered: DataFrame, value: str, packet: int = 128, width: int = 8) -> DataFrame:
    """gathered with packet_no and the slot in it: a packet has a header as wide as a value."""
    per = packet // width - 1
    return gathered.withColumn("packet_no", F.floor(F.col("pos") / per).cast("long")).withColumn("slot", (F.col("pos") % per).cast("long"))


def postfix(nodes: list) -> Column:
    """A column from a postfix list: column names, numbers and ADD, SUB, MUL, DIV; at most 10 nodes."""
    if len(nodes) > MAX_NODES:
        raise ValueError(f"at most {MAX_NODES} nodes")
    stack: list[Column] = []
    for n in nodes:
        if n in OPERATIONS:
            if len(stack) < 2:
                raise ValueError("an operation lacks operands")
            b, a = stack.pop(), stack.pop()
            stack.append(OPERATIONS[n](a, b))
        else:
            stack.append(F.col(n) if isinstance(n, str) else F.lit(n))
    if len(stack) != 1:
        raise ValueError("not one result")
    return stack[0]
