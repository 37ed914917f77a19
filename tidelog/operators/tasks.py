"""The task registry as a table: dispatching, paging, stale tasks, checks of a task's settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.errors import PlanError
from tidelog.plans.rules import Rule

STATES = ("init", "copying", "running", "paused", "stopped", "error")
DEFAULT_PORT, DEFAULT_RATE, DEFAULT_PAGE = 3306, 30_000, 10


@dataclass
class TaskSpec:
    """What a task is submitted with; `checked` fills in defaults and refuses what cannot run."""

    source: dict
    rules: list[Rule]
    dest: dict | None = None
    sink: dict | None = None
    rate_limit: int = 0
    incremental: bool = False
    state: str = field(default="init")

    def checked(self) -> TaskSpec:
        if not self.source.get("host"):
            raise PlanError("a task needs a source host")
        if not self.rules:
            raise PlanError("a task needs at least one rule")
        if (self.dest is None) == (self.sink is None):
            raise PlanError("a task goes to one database or to one message bus")
        if self.rate_limit < 0:
            raise PlanError("a rate limit is positive, or 0 for the default")
        filled = [{**x, "port": x.get("port") or DEFAULT_PORT} if x is not None else None for x in (self.source, self.dest)]
        return TaskSpec(filled[0], self.rules, filled[1], self.sink, self.rate_limit or DEFAULT_RATE, self.incremental, self.state)

    def moved(self, action: str) -> TaskSpec:
        """The task after pause, recover or delete; raises where the action makes no sense."""
        allowed = {"pause": ("init", "copying", "running"), "recover": ("paused", "error"), "delete": STATES}
        if action not in allowed or self.state not in allowed[action]:
            raise PlanError(f"cannot {action} a task that is {self.state}")
        after = {"pause": "paused", "recover": "running", "delete": "stopped"}[action]
        return TaskSpec(self.source, self.rules, self.dest, self.sink, self.rate_limit, self.incremental, after)


def loads(instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """(addr, tasks): tasks on each living instance, idle ones included."""
    counted = tasks.groupBy(F.col("service_addr").alias("addr")).agg(F.count(F.lit(1)).alias("tasks"))
    return instances.select("addr").distinct().join(counted, "addr", "left").select("addr", F.coalesce("tasks", F.lit(0)).alias("tasks"))


def least_loaded(instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """The instance that the next task goes to: fewest tasks, then the first address."""
    return loads(instances, tasks).orderBy("tasks", "addr").limit(1)


def idle(instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """Instances without any task."""
    return instances.select("addr").distinct().join(tasks.select(F.col("service_addr").alias("addr")), "addr", "left_anti")


def page(tasks: DataFrame, number: int, size: int = DEFAULT_PAGE) -> DataFrame:
    """One page of the registry, by id; pages begin at 1."""
    return tasks.orderBy("id").offset((max(number, 1) - 1) * size).limit(size)


def stale(tasks: DataFrame, now: int, seconds: int) -> DataFrame:
    """Running tasks that have not reported for some time."""
    return tasks.filter((F.col("state") == "running") & (F.lit(now) - F.col("updated_at") > seconds))


def to_take_over(tasks: DataFrame, instances: DataFrame) -> DataFrame:
    """Tasks whose owner is not alive."""
    return tasks.join(instances.select(F.col("addr").alias("service_addr")), "service_addr", "left_anti").filter(F.col("state").isin("copying", "running"))


def pending_tables(copy_state: DataFrame) -> DataFrame:
    """(repl_id, tables): how many tables of each task are still to be copied."""
    return copy_state.groupBy("repl_id").agg(F.count(F.lit(1)).alias("tables"))
