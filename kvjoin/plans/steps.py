"""Query plans as lists of steps, each a dict with an operator, its inputs and an output name.

Steps only build DataFrames; Catalyst sees the whole plan when the result is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvjoin.operators import joins, partition, sorts
from kvjoin.relation import nonzero

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "nonzero": nonzero,
    "filter": lambda df, condition: df.where(condition),
    "project": lambda df, **columns: df.select(*[F.expr(e).alias(n) for n, e in columns.items()]),
    "partition": lambda df, n: partition.global_partition(df, n),
    "join": lambda left, right, algorithm="phj": joins.join(left, right, algorithm),
    "join_in_place": joins.in_place,
    "probe_stats": joins.probe_stats,
    "pad": joins.padded,
    "finish": joins.finish,
    "sort": lambda df, algorithm="quick": sorts.sort(df, algorithm),
    "union": lambda a, b: a.union(b),
    "sync": lambda df: df,
}


class PlanError(ValueError):
    pass


def run_plan(steps: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """The result of the last step that has an output. Keys of a step: operator, inputs, output; all others are arguments. "free" drops names."""
    named, last = dict(tables), None
    for i, step in enumerate(steps):
        args = dict(step)
        operator, inputs, output = args.pop("operator"), args.pop("inputs", []), args.pop("output", None)
        missing = [x for x in inputs if x not in named]
        if missing:
            raise PlanError(f"step {i}, {operator}: no {', '.join(missing)}")
        if operator == "free":
            for x in inputs:
                named.pop(x)
            continue
        if operator not in OPERATORS:
            raise PlanError(f"step {i}: no operator {operator}")
        if output in named:
            raise PlanError(f"step {i}: {output} exists")
        last = OPERATORS[operator](*[named[x] for x in inputs], **args)
        if output:
            named[output] = last
    if last is None:
        raise PlanError("no result")
    return last


def timeline(spark, actions: dict[str, Callable[[], object]]) -> DataFrame:
    """(step, op, n_rows, start_s, stop_s): runs the actions in turn; n_rows is what an action returns."""
    began, rows = time.perf_counter(), []
    for i, (name, act) in enumerate(actions.items()):
        start = time.perf_counter() - began
        n = act()
        rows.append((i, name, n, start, time.perf_counter() - began))
    return spark.createDataFrame(rows, "step int, op string, n_rows long, start_s double, stop_s double")
