import pytest

from tidelog.functions.sql_text import directives, normalized, probe, statements
from tidelog.operators import results
from tidelog.plans.rules import Rule, statement_allowed
from tidelog.sources.config import load
from tidelog.streaming.folders import Folder
from tidelog.streaming.listener import Progress
from tidelog.streaming.runner import in_files


def test_statements():
    assert statements("select ';' ; /* ; */ ; insert into `a;b` values (1) -- ;\n; ") == ["select ';'", "insert into `a;b` values (1) -- ;"]


def test_normalized():
    sql, values = normalized("select a from t1 where b = 'x' and c = 5 and d in (1, 'y') and e = 5 and `f6` = :keep")
    assert sql == "select a from t1 where b = :v2 and c = :v3 and d in ::v1 and e = :v3 and `f6` = :keep"
    assert values == {"v1": [1, "y"], "v2": "x", "v3": 5}


def test_directives_and_probe():
    assert directives("select /*x+ A=1 B C=false D=z */ 1") == {"A": 1, "B": True, "C": False, "D": "z"} and directives("select 1") == {}
    assert probe("select 1 a") == "select * from (select 1 a) t where 1 != 1"


def test_results(spark):
    a, b = spark.range(3), spark.range(4)
    assert results.equal(a, spark.range(2, -1, -1)) and not results.equal(a, b) and results.appended(a, b).count() == 7
    with pytest.raises(ValueError):
        results.appended(a, b.withColumnRenamed("id", "x"))


def test_settings_and_statements(tmp_path):
    (tmp_path / "a.ini").write_text("[engine]\nhost = h\nport = 1\n")
    (tmp_path / "b.ini").write_text("[engine]\nport = 2\n")
    assert (s := load(str(tmp_path / "a.ini"), str(tmp_path / "b.ini"))).host == "h" and s.port == 2
    (tmp_path / "c.ini").write_text("[engine]\nnope = 2\n")
    with pytest.raises(ValueError):
        load(str(tmp_path / "c.ini"))
    assert statement_allowed([Rule("a", "t")], "a") and not statement_allowed([Rule("a", "t")], "b")


def test_progress_is_listened_to(spark):
    import time

    listener, folder = Progress(), Folder.fresh(spark, "progress")
    spark.streams.addListener(listener)
    try:
        in_files(spark.range(10).withColumnRenamed("id", "seq"), folder.at("source"), 2)
        stream = spark.readStream.schema("seq long").parquet(folder.at("source"))
        stream.writeStream.foreachBatch(lambda d, n: d.write.format("noop").mode("append").save()).option("checkpointLocation", folder.at("c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if listener.rows:
                break
            time.sleep(0.1)
        assert sum(r[2] for r in listener.rows) == 10 and "stream_rows_total" in listener.text() and listener.table(spark).count() == len(listener.rows)
    finally:
        spark.streams.removeListener(listener)
