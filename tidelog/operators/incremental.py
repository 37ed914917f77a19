"""Incrementally maintained groups: counts, sums and last values from signed images.

Every image of a change is a signed row: +1 for what comes, -1 for what goes. count(*) is the sum of
signs, sum(c) the sum of signed values with null as 0, and a plain column that is not grouped by has
the last value set, null after a delete. So an update that moves a row between groups needs no case
of its own. Groups stay when their count reaches 0, unless they are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.table_plan import TablePlan


def signed(changes: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, sign, row): one row for each image."""
    images = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row")),
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("row")),
    )
    out = changes.select(F.col(order).alias("seq"), F.explode(images).alias("i"))
    return out.select("seq", "i.sign", "i.row").filter(F.col("row").isNotNull())


def partial(plan: TablePlan, changes: DataFrame, order: str = "seq") -> DataFrame:
    """A batch's share of the groups: keys, sums, and last values with when they were set."""
    keys = [F.col(f"row.`{k}`").alias(k) for k in plan.select.group_by]
    measures = []
    for i in plan.select.items:
        if i.kind == "count":
            measures.append(F.sum("sign").alias(i.alias))
        elif i.kind == "sum":
            measures.append(F.sum(F.col("sign") * F.coalesce(F.col(f"row.`{i.alias}`"), F.lit(0))).alias(i.alias))
        elif i.alias not in plan.select.group_by:
            at = F.struct("seq", "sign")
            measures.append(F.max_by(F.struct(F.when(F.col("sign") > 0, F.col(f"row.`{i.alias}`")).alias("v")), at).alias(i.alias))
    when = F.max(F.struct("seq", "sign")).alias("_at")
    return signed(changes, order).groupBy(*keys).agg(*measures, when)


def merged(plan: TablePlan, parts: DataFrame) -> DataFrame:
    """Shares of several batches made one: what a running aggregate folds."""
    measures = []
    for i in plan.select.items:
        if i.kind in ("count", "sum"):
            measures.append(F.sum(i.alias).alias(i.alias))
        elif i.alias not in plan.select.group_by:
            measures.append(F.max_by(i.alias, "_at").alias(i.alias))
    return parts.groupBy(*plan.select.group_by).agg(*measures, F.max("_at").alias("_at"))


def shown(plan: TablePlan, groups: DataFrame, prune_empty: bool = False) -> DataFrame:
    """The groups as the plan's select has them."""
    plain = {i.alias for i in plan.select.items if i.kind not in ("count", "sum") and i.alias not in plan.select.group_by}
    counts = [i.alias for i in plan.select.items if i.kind == "count"]
    if prune_empty:
        if not counts:
            raise ValueError("only a plan with count(*) knows which groups are empty")
        groups = groups.filter(F.col(counts[0]) > 0)
    return groups.select(*(F.col(f"{i.alias}.v").alias(i.alias) if i.alias in plain else F.col(i.alias) for i in plan.select.items))


def aggregate(plan: TablePlan, changes: DataFrame, prune_empty: bool = False, order: str = "seq") -> DataFrame:
    return shown(plan, partial(plan, changes, order), prune_empty)
