"""What must hold of any changelog: cuts, replays, batches, sets of positions."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import positions, stitch
from tidelog.operators.envelope import Sink, messages
from tidelog.operators.state import state
from tidelog.operators.tasks import TaskSpec
from tidelog.plans.errors import PlanError
from tidelog.plans.rules import Rule
from tidelog.queries import KEY, SIDS, log, planned
from tidelog.sources.changelog import full_images
from tidelog.streaming.folders import Folder
from tidelog.streaming.runner import Runner, in_files, run_to_state

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def changes(spark):
    return planned("select * from orders where o_orderstatus = 'F'").changes(log(spark, SF)).cache()


@pytest.fixture(scope="module")
def final(changes):
    return rows(state(changes, KEY))


@pytest.mark.parametrize("cut", [0, 1, 8 * 333 + 2, 10**9])
def test_any_cut_gives_the_same_state(changes, final, cut):
    at_cut = state(changes.filter(F.col("seq") <= cut), KEY)
    assert rows(stitch.stitched(at_cut, cut, changes, KEY)) == final


def test_replayed_changes_change_nothing(changes, final):
    assert rows(state(changes.unionByName(changes.filter("seq % 5 = 0")), KEY)) == final


def test_transitions_add_up(changes, final):
    n = {r.op: r["count"] for r in changes.groupBy("op").count().collect()}
    moved = changes.filter("op = 'UPDATE' and before.o_orderkey <> after.o_orderkey").count()
    assert n["INSERT"] - n["DELETE"] == len(final) and moved > 0


def test_copied_parts_and_copies_meet(spark, changes, final):
    """A prefix of the table copied early, the rest later: nothing lost, nothing twice."""
    last = {"o_orderkey": 400}
    early = stitch.copied_part(changes, KEY, last)
    assert stitch.copied_part(changes, KEY, None).count() == 0
    below = state(early, KEY)
    above = state(changes, KEY).filter(stitch.after_key(KEY, last))
    assert rows(below.unionByName(above)) == final


def test_stream_survives_a_failure(spark, final):
    folder = Folder.fresh(spark, "failing")
    source = log(spark, SF)
    in_files(source, folder.at("source"), 5)
    plan = planned("select * from orders where o_orderstatus = 'F'")
    runner = Runner(spark, folder, plan, compact_every=2)
    whole = runner.apply

    def failing(batch, batch_id):
        if batch_id == 3:
            raise RuntimeError("lost")
        whole(batch, batch_id)
        if batch_id == 1:
            whole(batch, batch_id)

    runner.apply = failing
    with pytest.raises(Exception, match="lost"):
        runner.run(folder.at("source"), source.schema)
    runner.apply = whole
    runner.run(folder.at("source"), source.schema)
    assert rows(runner.state()) == final
    assert runner.dead_letters() is None


ROW = "struct<id:long,part:long,grp:string,cents:long>"


def _small_log(spark, many):
    rows = [(k, k // 3, "shop", "t" if k % 5 else "u", "row", (k % 7, k % 2, None if k % 3 else "g", k)) for k in range(many)]
    return spark.createDataFrame(rows, f"seq long, txn_id long, db string, tbl string, kind string, after {ROW}").withColumn("before", F.lit(None).cast(ROW))


@pytest.mark.parametrize(("text", "key"), [
    ("select id as number, part, cents from t", ("number", "part")), ("select id + 10 * part as code, grp from t", ("code",)),
    ("select grp, count(*) as c, sum(cents) as s from t group by grp", ("grp",)), ("select id, grp from t group by id, grp", ()), ("select grp, cents from t", ()),
])
def test_streams_equal_batches(spark, text, key):
    """Aliased, computed and composite keys, null groups, tables without a key, beside another table's rows."""
    from tidelog.operators.state import applied
    from tidelog.plans.table_plan import TablePlan

    source = _small_log(spark, 60)
    plan = TablePlan.of(text, source.schema["after"].dataType, key)
    assert rows(run_to_state(spark, source, plan, 4)) == rows(applied(plan, source)) == rows(applied(plan, source.filter("tbl = 't'")))


def test_stop_takes_whole_transactions(spark):
    folder, source = Folder.fresh(spark, "stop"), _small_log(spark, 60)
    in_files(source, folder.at("source"), 5)
    from tidelog.plans.table_plan import TablePlan

    runner = Runner(spark, folder, TablePlan.of("select cents from t", source.schema["after"].dataType, ("cents",)), compact_every=2)
    runner.run(folder.at("source"), source.schema, stop=31)
    assert runner.state().agg(F.max("cents")).first()[0] == 32 and len(runner._live()) < 5


def test_bad_rows_become_dead_letters(spark):
    folder = Folder.fresh(spark, "letters")
    good = log(spark, SF).limit(20)
    bad = good.limit(1).withColumn("after", F.lit(None).cast(good.schema["after"].dataType)).withColumn("before", F.lit(None).cast(good.schema["before"].dataType))
    good.unionByName(bad).coalesce(1).write.parquet(folder.at("source"))
    plan = planned("select * from orders")
    runner = Runner(spark, folder, plan)
    runner.run(folder.at("source"), good.schema)
    assert [r.fault for r in runner.dead_letters().collect()] == ["partial row image"]
    with pytest.raises(ValueError, match="partial row image"):
        full_images(good, ["o_orderkey", "o_comment"])


def test_positions(spark):
    a = positions.parse(spark, "a", f"{SIDS[0]}:1-5:6-9:20,{SIDS[1]}:3")
    b = positions.parse(spark, "b", f"{SIDS[0]}:4-7")
    u = positions.union(a, b)
    assert positions.contains(u, a).first()[0] and positions.contains(u, b).first()[0] and not positions.contains(b, a).first()[0]
    assert rows(positions.union(b, a)) == rows(u) == rows(positions.union(u, u))
    assert positions.equal(u, a).first()[0]
    assert {r.gtid_set for r in positions.text(a).collect()} == {f"{SIDS[0]}:1-9:20,{SIDS[1]}:3"}
    assert positions.difference(a, a).count() == 0
    with pytest.raises(ValueError):
        positions.parse(spark, "x", "nope:1-2")


def test_envelopes_bring_the_images_back(spark):
    changes = planned("select * from orders").changes(log(spark, SF))
    out = messages(changes, KEY, Sink(form="maxwell"), 1)
    data = F.from_json(F.get_json_object("value", "$.data"), "o_orderkey long, o_custkey long, o_orderstatus string, cents long")
    got = out.select("seq", data.alias("d")).select("seq", "d.*")
    image = F.coalesce("after", "before")
    want = changes.select("seq", image.alias("d")).select("seq", "d.*")
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        Sink(form="avro")


def test_tasks_are_checked():
    good = TaskSpec({"host": "a"}, [Rule("db", "t")], sink={"form": "default"}).checked()
    assert good.source["port"] == 3306 and good.rate_limit == 30_000
    assert good.moved("pause").state == "paused" and good.moved("pause").moved("recover").state == "running"
    with pytest.raises(PlanError):
        good.moved("recover")
    for bad in (TaskSpec({}, [Rule("db", "t")], sink={}), TaskSpec({"host": "a"}, [], sink={}), TaskSpec({"host": "a"}, [Rule("db", "t")])):
        with pytest.raises(PlanError):
            bad.checked()


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    from tidelog.plans.table_plan import TablePlan

    plan = TablePlan.of("select o_orderkey, o_custkey from orders where o_orderstatus = 'F'", orders.schema, KEY)
    text = plan.snapshot(orders)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    resumed = orders.filter(stitch.after_key(["o_orderkey", "o_custkey"], {"o_orderkey": 10, "o_custkey": 5}))
    assert "GreaterThanOrEqual(o_orderkey,10)" in resumed._jdf.queryExecution().executedPlan().toString()
