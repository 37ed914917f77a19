"""A task's rules over a log of many tables: routing, plans, and the states that they leave.

The log's images are JSON texts (what `binlog.decode` gives), for its tables differ. Each followed
table has one plan for each version of its schema; the plan's rule decides on filter, projection and
the target's database. Rows of excluded tables and of tables without a rule belong to no plan. Rows of
an online schema change's shadow tables count for the table behind them, if shadows are followed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.state import applied
from tidelog.plans.rules import Rule, base_table, route, route_column
from tidelog.plans.table_plan import TablePlan
from tidelog.sources.catalog import TableSpec


@dataclass
class Following:
    rules: list[Rule]
    tables: list[TableSpec]
    shadows: bool = False
    extended: bool = False
    #: (database, table, schema version) -> the rule and its plan; None for a table without one.
    plans: dict[tuple[str, str, int], tuple[Rule, TablePlan] | None] = field(default_factory=dict)

    def plan(self, spec: TableSpec) -> tuple[Rule, TablePlan] | None:
        """The rule and plan of a table, made once for each version of its schema."""
        at = (spec.db, spec.name, spec.version)
        if at not in self.plans:
            found = route(self.rules, spec.db, spec.name)
            rule = found[0] if found else None
            self.plans[at] = (rule, TablePlan.of(rule.select_text(spec.name), spec.schema, spec.key, self.extended, spec.db)) if rule else None
        return self.plans[at]

    def routed(self, log: DataFrame) -> DataFrame:
        """The row events that some rule follows, under the names of the tables that they are about."""
        rule = route_column(self.rules, F.col("db"), F.col("tbl"), self.shadows)
        names = [base_table(t.name) for t in self.tables] if self.shadows else []
        shadow = F.regexp_replace(F.regexp_replace("tbl", r"^_(.+)_(gho|ghc|del)$", "$1"), r"^_(.+)$", "$1")
        known = F.col("tbl").isin(*(t.name for t in self.tables))
        about = F.when(~known & shadow.isin(*names), shadow).otherwise(F.col("tbl")) if names else F.col("tbl")
        return log.filter((F.col("kind") == "row") & (rule >= 0)).withColumn("tbl", about)

    def changes(self, log: DataFrame, spec: TableSpec) -> DataFrame | None:
        """A table's changes as its plan has them, under the target's database; None if none follows it."""
        found = self.plan(spec)
        if found is None:
            return None
        images = {i: F.from_json(i, spec.schema) for i in ("before", "after")}
        typed = found[1].mine(self.routed(log)).withColumns(images)
        return found[1].changes(typed).withColumn("db", F.lit(found[0].target_dbname or spec.db))

    def states(self, log: DataFrame) -> dict[tuple[str, str], DataFrame]:
        """(target's database, table) -> what it holds after the log."""
        out = {}
        for spec in self.tables:
            found = self.plan(spec)
            if found is not None:
                typed = found[1].mine(self.routed(log)).withColumns({i: F.from_json(i, spec.schema) for i in ("before", "after")})
                out[found[0].target_dbname or spec.db, spec.name] = applied(found[1], typed)
        return out
