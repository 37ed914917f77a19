"""The registered queries of the change-data engine, each with the SQL that checks it."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import mysql_values as mv
from tidelog.functions import statements as st
from tidelog.functions import sql_text
from tidelog.functions.binding import bound, exploded
from tidelog.operators import envelope, metrics, positions, results, stitch, tasks, timeline
from tidelog.operators.following import Following
from tidelog.operators.incremental import aggregate, merged, partial, shown
from tidelog.operators.state import applied, key_moved, state
from tidelog.plans.errors import PlanError
from tidelog.plans.rules import Rule, ddl_matters_column, is_hosted_system_statement, route_column
from tidelog.plans.table_plan import TablePlan
from tidelog.sources import binlog, snapshot
from tidelog.sources.catalog import TableSpec, included
from tidelog.sources.changelog import MOVED, ORDER_ROW, SIDS, full_images, order_changes, order_rows
from tidelog.streaming.runner import run_to_state, run_windows
from tidelog.streaming.stateful import run_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ("o_orderkey",)
NOW = 1_700_000_000

#: The changelog's base rows and final state in DuckDB.
BASE = "b AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS cents, o_orderdate FROM orders)"
FINAL = f"""{BASE}, f AS (SELECT CASE WHEN k % 13 = 5 THEN k + {MOVED} ELSE k END AS o_orderkey, o_custkey,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'F' ELSE 'O' END ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN k % 3 = 0 THEN cents + 100 ELSE cents END AS cents FROM b WHERE k % 21 <> 0)"""
LOG = f"""{BASE}, l AS (
  SELECT 8 * k + 1 AS seq, k, 'INSERT' AS op, NULL AS bk, o_custkey, NULL AS bs, NULL::BIGINT AS bc, k AS ak, o_orderstatus AS as_, cents AS ac, o_orderdate FROM b
  UNION ALL SELECT 8 * k + 2, k, 'UPDATE', k, o_custkey, o_orderstatus, cents, k, CASE WHEN k % 2 = 0 THEN 'F' ELSE 'O' END, cents + 100, o_orderdate FROM b WHERE k % 3 = 0
  UNION ALL SELECT 8 * k + 3, k, 'UPDATE', k, o_custkey, ns, nc, k + {MOVED}, ns, nc, o_orderdate FROM n WHERE k % 13 = 5 AND k % 21 <> 0
  UNION ALL SELECT 8 * k + 4, k, 'DELETE', k, o_custkey, ns, nc, NULL, NULL, NULL, o_orderdate FROM n WHERE k % 21 = 0)"""
LOG = LOG.replace(", l AS (", """, n AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'F' ELSE 'O' END ELSE o_orderstatus END AS ns,
  CASE WHEN k % 3 = 0 THEN cents + 100 ELSE cents END AS nc FROM b), l AS (""")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes(table(spark, sf_dir, "orders"))


def planned(text: str, key: tuple[str, ...] = KEY, extended: bool = False) -> TablePlan:
    return TablePlan.of(text, ORDER_ROW, key, extended)


# Scans and snapshots.

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, 'uuid:1-5' AS snapshot_gtid FROM lineitem")
def snapshot_scan(spark, sf_dir):
    return snapshot.scan(table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity"), "uuid:1-5")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey, l_linenumber) > (700, 50, 3, 2)")
def snapshot_resume_keyset(spark, sf_dir):
    last = {"l_orderkey": 700, "l_partkey": 50, "l_suppkey": 3, "l_linenumber": 2}
    return snapshot.resumed(table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag"), LINE_KEY, last)


@query("""SELECT l_orderkey // 1000 AS batch, max(l_orderkey) AS l_orderkey, max_by(l_linenumber, l_orderkey * 1000 + l_linenumber) AS l_linenumber, count(*) AS rows
FROM lineitem GROUP BY 1""")
def snapshot_lastpk_per_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return snapshot.last_keys(rows, ["l_orderkey", "l_linenumber"], F.floor(F.col("l_orderkey") / 1000))


@query(f"""WITH {BASE}, s AS (SELECT k, length(k::VARCHAR) + length(o_custkey::VARCHAR) + length(o_orderstatus) + length(cents::VARCHAR) AS size FROM b),
r AS (SELECT k, (coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 25000)::BIGINT AS batch FROM s)
SELECT batch, count(*) AS rows, max(k) AS last_key FROM r GROUP BY batch""")
def snapshot_byte_batches(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders")).drop("o_orderdate")
    cut = snapshot.byte_batches(rows, ["o_orderkey"], 25_000)
    return cut.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max("o_orderkey").alias("last_key"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def snapshot_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return TablePlan.of("select o_orderkey, o_custkey from orders where o_orderstatus = 'F'", rows.schema, KEY).snapshot(rows)


# The binary log.


def _order_events(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each order as a rows event of one insert, with a JSON column."""
    for pdf in parts:
        rows = []
        for k, c, s in zip(pdf["o_orderkey"].tolist(), pdf["o_custkey"].tolist(), pdf["o_orderstatus"].tolist(), strict=True):
            doc = b"\0" + struct.pack("<HHHHBhc", 1, 12, 11, 1, 5, c % 1000, b"k")
            image = b"\0" + struct.pack("<qq", k, c) + bytes([len(s)]) + s.encode() + struct.pack("<I", len(doc)) + doc
            body = (7).to_bytes(6, "little") + b"\0\0" + struct.pack("<H", 2) + b"\x04\x0f" + image
            rows.append(("log", k + 1, struct.pack("<IBIIIH", 1_600_000_000, 30, 1, 19 + len(body), 0, 0) + body))
        yield pd.DataFrame(rows, columns=["file", "pos", "event"])


@query("SELECT o_orderkey + 1 AS pos, 'shop' AS db, 'orders' AS tbl, o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, (o_custkey % 1000)::INT AS k FROM orders")
def binlog_decode_rows(spark, sf_dir):
    """Orders written as raw row events, decoded again."""
    kinds = bytes([binlog.LONGLONG, binlog.LONGLONG, binlog.VARCHAR, binlog.JSON])
    body = (7).to_bytes(6, "little") + b"\0\0\x04shop\0\x06orders\0\x04" + kinds + b"\x03" + struct.pack("<H", 40) + b"\x04\x0f"
    begin = [("log", 0, bytearray(struct.pack("<IBIIIH", 0, binlog.TABLE_MAP, 1, 19 + len(body), 0, 0) + body))]
    shape = "file string, pos long, event binary"
    events = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").mapInPandas(_order_events, shape)
    raw = events.unionByName(spark.createDataFrame(begin, shape))
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("customer", T.LongType()), T.StructField("status", T.StringType()), T.StructField("doc", T.StructType([T.StructField("k", T.IntegerType())]))])
    out = binlog.typed(binlog.decode(raw, {("shop", "orders"): ["id", "customer", "status", "doc"]}), "shop", "orders", row)
    return out.select("pos", "db", "tbl", "after.id", "after.customer", "after.status", "after.doc.k")


def _event(kind: int, body: bytes) -> bytes:
    """An event with its header and a checksum."""
    return struct.pack("<IBIIIH", 1_600_000_000, kind, 1, 23 + len(body), 0, 0) + body + b"\0\0\0\0"


def _image(row) -> bytes:
    return b"\0" + struct.pack("<qq", row["o_orderkey"], row["o_custkey"]) + bytes([len(row["o_orderstatus"])]) + row["o_orderstatus"].encode() + struct.pack("<q", row["cents"])


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each order's changes as a transaction of raw events: GTID, rows events, XID."""
    head = (7).to_bytes(6, "little") + b"\0\0" + struct.pack("<H", 2) + b"\x04\x0f"
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            k = r["txn_id"]
            file, at = f"log.{k % 4:06d}", 1000 * k
            gtid = b"\0" + uuid.UUID(SIDS[k % 2]).bytes + struct.pack("<q", k // 2 + 1)
            rows.append((file, at, _event(binlog.GTID, gtid)))
            for n, c in enumerate(r["changes"]):
                kind = 30 if c["before"] is None else 32 if c["after"] is None else 31
                images = b"".join(_image(i) for i in (c["before"], c["after"]) if i is not None)
                rows.append((file, at + 100 * (n + 1), _event(kind, head + (b"\x0f" if kind == 31 else b"") + images)))
            rows.append((file, at + 900, _event(binlog.XID, struct.pack("<q", k))))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["file", "pos", "event"])


def _raw_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' changelog written as raw events of four files, and read back from them."""
    shape = "file string, pos long, event binary"
    kinds = bytes([binlog.LONGLONG, binlog.LONGLONG, binlog.VARCHAR, binlog.LONGLONG])
    announced = (7).to_bytes(6, "little") + b"\0\0\x04shop\0\x06orders\0\x04" + kinds + b"\x02" + struct.pack("<H", 40) + b"\x0f"
    # A FORMAT event ends with the kind of checksum, 1, and its own.
    begin = [(f"log.{f:06d}", p, bytearray(e)) for f in range(4) for p, e in ((0, _event(binlog.FORMAT, b"\x04\0" + b"8.0".ljust(50, b"\0") + b"\0" * 5 + b"\x01")), (1, _event(binlog.TABLE_MAP, announced)))]
    grouped = log(spark, sf_dir).groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("seq", "before", "after"))).alias("changes"))
    raw = grouped.mapInArrow(_transactions, shape).unionByName(spark.createDataFrame(begin, shape))
    return binlog.changelog(binlog.decode(raw, {("shop", "orders"): ORDER_ROW.names}))


# Routing.

TABLES = ["orders", "_orders_gho", "_orders_del", "_orders", "lineitem", "order_log", "customer", "users_2020"]
VALUES = "(VALUES " + ", ".join(f"('{d}', '{t}')" for d in ("shop", "other") for t in TABLES) + ") v(db, tbl)"


def _routed(spark: SparkSession, rules: list[Rule], shadows: bool = False) -> DataFrame:
    rows = spark.createDataFrame([(d, t) for d in ("shop", "other") for t in TABLES], "db string, tbl string")
    return rows.withColumn("rule", route_column(rules, F.col("db"), F.col("tbl"), shadows))


@query(f"SELECT db, tbl, CASE WHEN db = 'shop' AND tbl = 'orders' THEN 0 END::INT AS rule FROM {VALUES}")
def route_exact(spark, sf_dir):
    return _routed(spark, [Rule("shop", "orders")])


@query(f"SELECT db, tbl, CASE WHEN db <> 'shop' THEN NULL WHEN tbl = 'customer' THEN -1 WHEN tbl IN ('orders', 'customer', 'lineitem') THEN 1 END::INT AS rule FROM {VALUES}")
def route_list_with_exclusion(spark, sf_dir):
    return _routed(spark, [Rule("shop", "customer", "exclude"), Rule("shop", "orders, customer,lineitem")])


@query(f"SELECT db, tbl, CASE WHEN db = 'shop' AND regexp_matches(tbl, 'order|_20\\d\\d$') THEN 0 END::INT AS rule FROM {VALUES}")
def route_regexp(spark, sf_dir):
    return _routed(spark, [Rule("shop", r"/order|_20\d\d$/")])


@query(f"""SELECT db, tbl, CASE WHEN db = 'shop' AND (tbl = 'orders' OR regexp_replace(regexp_replace(tbl, '^_(.+)_(gho|ghc|del)$', '\\1'), '^_(.+)$', '\\1') = 'orders') THEN 0 END::INT AS rule FROM {VALUES}""")
def route_shadow_tables(spark, sf_dir):
    return _routed(spark, [Rule("shop", "orders")], shadows=True)


# Filters and projections.


@query(f"WITH {BASE} SELECT k AS o_orderkey, cents FROM b WHERE o_orderstatus = 'O' AND o_custkey = 7")
def filter_eq_and(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders"))
    return planned("select o_orderkey, cents from orders where o_orderstatus = 'O' and o_custkey = 7").snapshot(rows)


@query(f"WITH {BASE} SELECT k AS o_orderkey, cents FROM b WHERE cents >= 15000000 AND o_orderstatus <> 'P'")
def filter_extended(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders"))
    return planned("select o_orderkey, cents from orders where cents >= 15000000 and o_orderstatus != 'P'", extended=True).snapshot(rows)


@query(f"WITH {BASE} SELECT k AS id, o_custkey + cents AS total, upper(concat(o_orderstatus, 'x')) AS tag, CASE WHEN cents > 100000 THEN 'big' ELSE 'small' END AS size FROM b")
def project_alias_expr(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders"))
    text = "select o_orderkey id, o_custkey + cents as total, upper(concat(o_orderstatus, 'x')) as tag, case when cents > 100000 then 'big' else 'small' end as size from orders"
    return planned(text, ("id",)).snapshot(rows)


@query("SELECT 1 AS one FROM orders")
def project_const_one(spark, sf_dir):
    return planned("select 1 as one from orders", ("one",)).snapshot(order_rows(table(spark, sf_dir, "orders")))


@query(f"WITH {BASE} SELECT k AS o_orderkey, o_custkey, o_orderstatus, cents FROM b")
def project_star(spark, sf_dir):
    return planned("select * from orders").snapshot(order_rows(table(spark, sf_dir, "orders")))


@query(f"""WITH {LOG}, i AS (SELECT *, coalesce(bs = 'F', false) AS b, coalesce(as_ = 'F', false) AS a FROM l)
SELECT CASE WHEN NOT b THEN 'INSERT' WHEN NOT a THEN 'DELETE' ELSE 'UPDATE' END AS op, count(*) AS n FROM i WHERE a OR b GROUP BY 1""")
def image_filter_transitions(spark, sf_dir):
    return planned("select * from orders where o_orderstatus = 'F'").changes(log(spark, sf_dir)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


DDL = ("create database x", "alter table orders add c int", "drop table lineitem", "rename table a to orders", "truncate table `shop`.`orders`", "something odd")


@query(f"""SELECT n_nationkey, sql, sql IN ('{DDL[1]}', '{DDL[3]}', '{DDL[4]}', '{DDL[5]}') AS followed
FROM (SELECT n_nationkey, ([{", ".join(f"'{t}'" for t in DDL)}])[1 + n_nationkey % {len(DDL)}] AS sql FROM nation)""")
def ddl_relevance(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, DDL)), (1 + F.col("n_nationkey") % len(DDL)).cast("int"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("sql"))
    return rows.withColumn("followed", ddl_matters_column([Rule("shop", "orders")], F.lit("shop"), F.col("sql")))


@query(f"""WITH {FINAL}, m AS (SELECT o_orderkey AS id, o_orderstatus AS label FROM f WHERE o_orderkey >= {MOVED} OR o_orderkey % 7 <> 0)
SELECT 'archive' AS db, 'orders' AS tbl, id, label FROM m UNION ALL SELECT 'archive', 'orders', o_orderkey, 'G' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'shop', 'nation', n_nationkey, n_name FROM nation WHERE n_regionkey = 1""")
def follow_rules_state(spark, sf_dir):
    """A log of four tables: one followed under another database's name, with its shadow, one filtered, one excluded, one of a foreign database."""
    orders = log(spark, sf_dir)
    shaped = lambda d, db, tbl: d.select("seq", F.lit(db).alias("db"), F.lit(tbl).alias("tbl"), F.lit("row").alias("kind"), *(F.to_json(i).alias(i) if i in d.columns else F.lit(None).cast("string").alias(i) for i in ("before", "after")))
    k = F.col("o_orderkey")
    ghosts = order_rows(table(spark, sf_dir, "orders")).filter(k % 7 == 0).select((8 * k + 5).alias("seq"), F.struct(k, "o_custkey", F.lit("G").alias("o_orderstatus"), "cents").alias("after"))
    customers = table(spark, sf_dir, "customer").select((8 * F.col("c_custkey") + 6).alias("seq"), F.struct(F.col("c_custkey").alias("o_orderkey"), F.lit("X").alias("o_orderstatus")).alias("after"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.struct("n_nationkey", "n_name", "n_regionkey").alias("after"))
    every = [shaped(orders, "shop", "orders"), shaped(ghosts, "shop", "_orders_gho"), shaped(customers, "shop", "customer"), shaped(nations, "shop", "nation"), shaped(orders.withColumn("seq", F.col("seq") + 7), "other", "orders")]
    merged_log = reduce(DataFrame.unionByName, every)
    nation = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])
    rules = [
        Rule("shop", "customer", "exclude"), Rule("shop", "orders", "select o_orderkey as id, o_orderstatus as label from orders", target_dbname="archive"),
        Rule("shop", "/^nat/", "select n_nationkey as id, n_name as label from nation where n_regionkey = 1"),
    ]
    tables = [TableSpec("shop", "orders", ORDER_ROW, ("id",)), TableSpec("shop", "nation", nation, ("id",)), TableSpec("shop", "customer", ORDER_ROW, ("o_orderkey",))]
    states = Following(rules, tables, shadows=True).states(merged_log)
    return reduce(DataFrame.unionByName, (d.select(F.lit(db).alias("db"), F.lit(tbl).alias("tbl"), "id", "label") for (db, tbl), d in states.items()))


@query(f"WITH {FINAL} SELECT * FROM f WHERE o_orderstatus = 'F'")
def binlog_to_state(spark, sf_dir):
    """Raw events with checksums to the filtered state: decoded, put in transactions, applied."""
    plan = planned("select * from orders where o_orderstatus = 'F'")
    out = _raw_changelog(spark, sf_dir)
    return applied(plan, out.withColumns({i: F.from_json(i, ORDER_ROW) for i in ("before", "after")}))


@query(f"""WITH {LOG} SELECT CASE WHEN k % 2 = 0 THEN '{SIDS[0]}' ELSE '{SIDS[1]}' END AS gtid_sid, (k // 2 + 1)::BIGINT AS gtid_seq, count(*) AS events, 1::BIGINT AS commits FROM l GROUP BY k""")
def binlog_transactions(spark, sf_dir):
    """What each transaction of the raw log holds: events, and one of them that ends it."""
    return _raw_changelog(spark, sf_dir).groupBy("gtid_sid", "gtid_seq").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("commit").cast("long")).alias("commits"))


# Keyed state.


@query(f"WITH {FINAL} SELECT * FROM f WHERE o_orderstatus = 'F'")
def cdc_filtered_state(spark, sf_dir):
    return applied(planned("select * from orders where o_orderstatus = 'F'"), log(spark, sf_dir))


@query(f"WITH {FINAL} SELECT * FROM f")
def cdc_state_pk_change(spark, sf_dir):
    return applied(planned("select * from orders"), log(spark, sf_dir))


@query(f"WITH {LOG} SELECT seq, bk AS from_key, ak AS to_key FROM l WHERE op = 'UPDATE' AND bk <> ak")
def cdc_pk_moves(spark, sf_dir):
    return log(spark, sf_dir).filter(key_moved(KEY)).select("seq", F.col("before.o_orderkey").alias("from_key"), F.col("after.o_orderkey").alias("to_key"))


@query(f"WITH {FINAL} SELECT o_orderkey, 'archive' AS db FROM f WHERE o_orderstatus = 'O'")
def db_rename(spark, sf_dir):
    rule = Rule("shop", "orders", "select o_orderkey from orders where o_orderstatus = 'O'", target_dbname="archive")
    spec = TableSpec("shop", "orders", ORDER_ROW, KEY)
    texts = log(spark, sf_dir).withColumns({i: F.to_json(i) for i in ("before", "after")})
    changes = Following([rule], [spec]).changes(texts, spec)
    return state(changes.withColumns({i: F.when(F.col(i).isNotNull(), F.col(i).withField("db", F.col("db"))) for i in ("before", "after")}), KEY)


# Incremental aggregation.

IVM = "select o_custkey, count(*) as c, sum(cents) as s from orders where o_orderstatus = 'F' group by o_custkey"


def _grouped(text: str = IVM) -> TablePlan:
    return planned(text, ("o_custkey",))


@query(f"WITH {FINAL} SELECT o_custkey, count(*) AS c, sum(cents)::BIGINT AS s FROM f WHERE o_orderstatus = 'F' GROUP BY 1")
def ivm_count_sum(spark, sf_dir):
    plan = _grouped()
    return aggregate(plan, plan.changes(log(spark, sf_dir)), prune_empty=True)


@query(f"""WITH {LOG}, g AS (SELECT DISTINCT o_custkey FROM l WHERE bs = 'F' OR as_ = 'F'), {FINAL.replace(BASE + ',', '')}
SELECT g.o_custkey, count(f.o_orderkey) AS c, coalesce(sum(cents), 0)::BIGINT AS s FROM g LEFT JOIN f ON f.o_custkey = g.o_custkey AND f.o_orderstatus = 'F' GROUP BY 1""")
def ivm_zero_groups(spark, sf_dir):
    return applied(_grouped(), log(spark, sf_dir))


@query(f"WITH {FINAL} SELECT o_custkey, count(*) AS c, sum(CASE WHEN cents % 2 = 0 THEN cents ELSE 0 END)::BIGINT AS s FROM f GROUP BY 1")
def ivm_count_sum_nulls(spark, sf_dir):
    odd = lambda i: F.col(i).withField("cents", F.when(F.col(f"{i}.cents") % 2 == 0, F.col(f"{i}.cents")))
    holes = log(spark, sf_dir).withColumns({i: F.when(F.col(i).isNotNull(), odd(i)) for i in ("before", "after")})
    plan = _grouped("select o_custkey, count(*) as c, sum(cents) as s from orders group by o_custkey")
    return aggregate(plan, plan.changes(holes), prune_empty=True)


@query(f"""WITH {LOG} SELECT o_custkey, max_by(struct_pack(v := v), seq * 2 + s).v AS o_orderstatus FROM
(SELECT o_custkey, seq, 0 AS s, NULL AS v FROM l WHERE bk IS NOT NULL UNION ALL SELECT o_custkey, seq, 1, as_ FROM l WHERE ak IS NOT NULL) GROUP BY 1""")
def ivm_last_value(spark, sf_dir):
    return applied(planned("select o_custkey, o_orderstatus from orders group by o_custkey", ("o_custkey",)), log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT ak AS o_orderkey, arg_min(as_, seq) AS o_orderstatus FROM l WHERE ak IS NOT NULL GROUP BY 1""")
def ivm_insert_ignore(spark, sf_dir):
    return applied(planned("select o_orderkey, o_orderstatus from orders group by o_orderkey, o_orderstatus"), log(spark, sf_dir))


@query(f"WITH {FINAL} SELECT o_orderstatus, count(*) AS c, sum(cents)::BIGINT AS s, sum(o_orderkey)::BIGINT AS keys FROM f GROUP BY 1")
def ivm_pk_move(spark, sf_dir):
    plan = planned("select o_orderstatus, count(*) as c, sum(cents) as s, sum(o_orderkey) as keys from orders group by o_orderstatus", ("o_orderstatus",))
    return aggregate(plan, plan.changes(log(spark, sf_dir)), prune_empty=True)


@query(f"WITH {FINAL} SELECT o_custkey, count(*) AS c, sum(cents)::BIGINT AS s FROM f WHERE o_orderstatus = 'F' GROUP BY 1")
def ivm_merged_batches(spark, sf_dir):
    """Shares of four batches, folded."""
    plan = _grouped()
    changes = plan.changes(log(spark, sf_dir))
    parts = [partial(plan, changes.filter(F.pmod("seq", F.lit(4)) == k)) for k in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return shown(plan, merged(plan, every), prune_empty=True)


# Envelopes.


def _messages(spark: SparkSession, sf_dir: str, **sink) -> DataFrame:
    changes = planned("select * from orders").changes(log(spark, sf_dir))
    return envelope.messages(changes, KEY, envelope.Sink(**sink), NOW)


TEXT_IMAGE = """'{"cents":"' || %c || '","o_custkey":"' || o_custkey || '","o_orderkey":"' || %k || '","o_orderstatus":"' || %s || '"}'"""
AFTER_TEXT = TEXT_IMAGE.replace("%c", "ac").replace("%k", "ak").replace("%s", "as_")
BEFORE_TEXT = TEXT_IMAGE.replace("%c", "bc").replace("%k", "bk").replace("%s", "bs")
NATIVE = """'{"cents":' || %c || ',"o_custkey":' || o_custkey || ',"o_orderkey":' || %k || ',"o_orderstatus":"' || %s || '"}'"""
AFTER_NATIVE = NATIVE.replace("%c", "ac").replace("%k", "ak").replace("%s", "as_")
BEFORE_NATIVE = NATIVE.replace("%c", "bc").replace("%k", "bk").replace("%s", "bs")
ES = "epoch(o_orderdate)::BIGINT"
GTID = f"(CASE WHEN k % 2 = 0 THEN '{SIDS[0]}' ELSE '{SIDS[1]}' END || ':' || (k // 2 + 1))"


@query(f"""WITH {LOG} SELECT seq, 'shop_orders' AS topic, coalesce(ak::VARCHAR, '') AS key, '{{"table":"orders","database":"shop","gtid":"' || {GTID} || '","es":' || {ES} || ',"ts":{NOW},"pkNames":["o_orderkey"],"sql":"","isDdl":false,"type":"' || op || '","data":[' ||
CASE WHEN ak IS NULL THEN {BEFORE_TEXT} ELSE {AFTER_TEXT} END || '],"old":[' || CASE WHEN bk IS NULL THEN '{{}}' ELSE {BEFORE_TEXT} END || ']}}' AS value FROM l""")
def env_default(spark, sf_dir):
    return _messages(spark, sf_dir, with_gtid=True)


OLD = """concat_ws(',', CASE WHEN bc <> ac THEN '"cents":' || bc END, CASE WHEN bk <> ak THEN '"o_orderkey":' || bk END, CASE WHEN bs <> as_ THEN '"o_orderstatus":"' || bs || '"' END)"""


@query(f"""WITH {LOG} SELECT seq, 'shop' AS topic, coalesce(ak::VARCHAR, '') AS key, '{{"table":"orders","database":"shop","ts":{NOW},"type":"' || lower(op) || '","data":' ||
CASE WHEN ak IS NULL THEN {BEFORE_NATIVE} ELSE {AFTER_NATIVE} END || CASE WHEN op = 'UPDATE' AND {OLD} <> '' THEN ',"old":{{' || {OLD} || '}}' ELSE '' END || '}}' AS value FROM l""")
def env_maxwell(spark, sf_dir):
    return _messages(spark, sf_dir, form="maxwell", topic_mode="db")


@query(f"""WITH {LOG} SELECT seq, CASE WHEN bc <> ac THEN bc END AS cents, CASE WHEN bs <> as_ THEN bs END AS o_orderstatus, CASE WHEN bk <> ak THEN bk END AS o_orderkey FROM l WHERE op = 'UPDATE'""")
def env_maxwell_old_diff(spark, sf_dir):
    """The envelope's `old`, parsed again."""
    out = _messages(spark, sf_dir, form="maxwell").filter(F.get_json_object("value", "$.type") == "update")
    old = F.from_json(F.get_json_object("value", "$.old"), "cents long, o_orderstatus string, o_orderkey long")
    return out.select("seq", old.alias("o")).select("seq", "o.*")


META = f"""'"database":"shop","es":' || {ES} || ',"isDdl":false,"pkNames":["o_orderkey"],"sql":"","table":"orders","ts":{NOW},"type":"' || op || '"}}'"""


@query(f"""WITH {LOG} SELECT seq, 'shop_orders' AS topic, coalesce(ak::VARCHAR, '') AS key, '{{' || CASE WHEN ak IS NULL THEN '' ELSE substr({AFTER_NATIVE}, 2, length({AFTER_NATIVE}) - 2) || ',' END || {META} AS value FROM l""")
def env_flat(spark, sf_dir):
    return _messages(spark, sf_dir, form="flat")


@query(f"""WITH {BASE} SELECT k // 1000 AS bucket, '{{"table":"orders","database":"shop","es":{NOW}000,"ts":{NOW}000,"pkNames":["o_orderkey"],"sql":"","isDdl":false,"type":"INSERT","data":[' ||
string_agg({TEXT_IMAGE.replace('%c', 'cents').replace('%k', 'k').replace('%s', 'o_orderstatus')}, ',' ORDER BY k) || ']}}' AS value FROM b GROUP BY 1""")
def env_snapshot_array(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders")).drop("o_orderdate")
    return envelope.snapshot_batches(rows, F.floor(F.col("o_orderkey") / 1000), "shop", "orders", KEY, ["o_orderkey"], NOW * 1000)


@query(f"""WITH {BASE} SELECT '{{"cents":' || cents || ',"o_orderkey":' || k || ',"o_orderstatus":"' || o_orderstatus || '","database":"shop","es":{NOW},"isDdl":false,"pkNames":["o_orderkey"],"sql":"","table":"orders","ts":{NOW},"type":"INSERT"}}' AS value FROM b""")
def env_snapshot_flat(spark, sf_dir):
    rows = order_rows(table(spark, sf_dir, "orders")).drop("o_orderdate")
    return envelope.snapshot_flat(rows, "shop", "orders", KEY, NOW, exclude=("o_custkey",))


@query(f"WITH {LOG} SELECT seq, 'shop_orders' AS by_table, 'shop' AS by_db FROM l")
def kafka_topic_routing(spark, sf_dir):
    changes = log(spark, sf_dir)
    return changes.select("seq", envelope.topic(envelope.Sink()).alias("by_table"), envelope.topic(envelope.Sink(topic_mode="db")).alias("by_db"))


@query(f"WITH {LOG} SELECT seq, 'shop_orders' AS topic, o_custkey::VARCHAR || coalesce(as_, bs) AS key FROM l")
def kafka_partition_key_column(spark, sf_dir):
    return _messages(spark, sf_dir, partition_mode="column", partition_columns=("o_custkey", "o_orderstatus")).drop("value")


@query(f"WITH {LOG} SELECT seq, 'shop_orders' AS topic, 'orders' AS key FROM l")
def kafka_partition_key_table(spark, sf_dir):
    return _messages(spark, sf_dir, partition_mode="column", partition_columns=("nowhere",)).drop("value")


@query(f"WITH {LOG} SELECT seq, 'shop_orders' AS topic, coalesce(ak::VARCHAR, '') AS key FROM l")
def kafka_partition_key_pk(spark, sf_dir):
    return _messages(spark, sf_dir, partition_mode="column", partition_columns=("nowhere",), fallback="primary_key").drop("value")


@query(f"""WITH {LOG} SELECT seq, '{{"table":"orders","database":"shop","ts":{NOW},"type":"' || lower(op) || '","data":{{"o_orderkey":' || coalesce(ak, bk) || '}}' || CASE WHEN op = 'UPDATE' AND bk <> ak THEN ',"old":{{"o_orderkey":' || bk || '}}' ELSE '' END || '}}' AS value FROM l""")
def kafka_exclude_columns(spark, sf_dir):
    return _messages(spark, sf_dir, form="maxwell", exclude=("cents", "o_custkey", "o_orderstatus")).select("seq", "value")


# Stitching.


@query(f"WITH {LOG} SELECT seq, CASE WHEN bk <= 500 THEN bk END AS bk, CASE WHEN ak <= 500 THEN ak END AS ak FROM l WHERE bk <= 500 OR ak <= 500")
def copy_progress_filter(spark, sf_dir):
    cut = stitch.copied_part(log(spark, sf_dir), list(KEY), {"o_orderkey": 500})
    return cut.select("seq", F.col("before.o_orderkey").alias("bk"), F.col("after.o_orderkey").alias("ak"))


@query(f"WITH {LOG} SELECT seq, CASE WHEN bk <= 900 THEN bk END AS bk, CASE WHEN ak <= 900 THEN ak END AS ak FROM l WHERE bk <= 900 OR ak <= 900")
def copy_progress_by_table(spark, sf_dir):
    progress = spark.createDataFrame([("orders", 900), ("lineitem", None)], "tbl string, lastpk long")
    cut = stitch.copied_by_table(log(spark, sf_dir), progress, "o_orderkey")
    return cut.select("seq", F.col("before.o_orderkey").alias("bk"), F.col("after.o_orderkey").alias("ak"))


@query(f"WITH {LOG} SELECT seq, op FROM l WHERE seq <= 4000")
def fast_forward(spark, sf_dir):
    out = stitch.fast_forward(planned("select * from orders").changes(log(spark, sf_dir)), 4000)
    return out.select("seq", "op")


@query(f"WITH {FINAL} SELECT * FROM f WHERE o_orderstatus <> 'P'")
def stitch_snapshot_changelog(spark, sf_dir):
    """The state at a cut, then the changes behind it."""
    plan = planned("select * from orders where o_orderstatus != 'P'", extended=True)
    changes = plan.changes(log(spark, sf_dir))
    cut = 8 * 700
    return stitch.stitched(state(changes.filter(F.col("seq") <= cut), KEY), cut, changes, KEY)


@query(f"WITH {LOG} SELECT seq FROM l WHERE NOT ((k // 2 + 1) BETWEEN 10 AND 300 AND k % 2 = 0)")
def not_applied_twice(spark, sf_dir):
    done = spark.createDataFrame([(SIDS[0], 10, 300)], "sid string, start long, end long")
    return stitch.not_applied_twice(done, log(spark, sf_dir)).select("seq")


# Streams over the log's order, on batch tables.

EVENT_LOG = "e AS (SELECT event_id AS seq, event_id // 4 AS txn_id, ts, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN 'ddl' WHEN event_id % 89 = 0 THEN 'other' ELSE 'row' END AS kind FROM events)"


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "ddl").when(F.col("event_id") % 89 == 0, "other").otherwise("row")
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 4).alias("txn_id"), "ts", "user_id", "event_type", kind.alias("kind"))


@query(f"WITH {EVENT_LOG} SELECT seq, (sum(CASE WHEN kind <> 'row' THEN 1 ELSE 0 END) OVER (ORDER BY seq))::BIGINT AS txn_group FROM e")
def txn_grouping(spark, sf_dir):
    return timeline.transaction_groups(_event_log(spark, sf_dir), width=1 << 10).select("seq", "txn_group")


@query(f"WITH {EVENT_LOG} SELECT seq, coalesce(sum(CASE WHEN kind = 'ddl' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS schema_version FROM e")
def ddl_barrier_versions(spark, sf_dir):
    return timeline.schema_versions(_event_log(spark, sf_dir), width=1 << 10).select("seq", "schema_version")


@query(f"WITH {EVENT_LOG} SELECT seq FROM e WHERE txn_id <= 501 // 4")
def stop_position(spark, sf_dir):
    return timeline.until(_event_log(spark, sf_dir), 501).select("seq")


@query(f"WITH {EVENT_LOG} SELECT seq FROM e WHERE txn_id IN (SELECT txn_id FROM e WHERE event_type = 'error')")
def empty_transactions_suppressed(spark, sf_dir):
    marked = _event_log(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "error", "row").otherwise("other"))
    return timeline.without_empty(marked).select("seq")


@query(f"WITH {EVENT_LOG} SELECT event_type, max(1800000000 - floor(epoch(ts)))::BIGINT AS max_lag, min(1800000000 - floor(epoch(ts)))::BIGINT AS min_lag, count(*) AS events FROM e GROUP BY 1")
def lag_by_type(spark, sf_dir):
    return timeline.lag_by(_event_log(spark, sf_dir), ["event_type"], "ts", F.timestamp_seconds(F.lit(1_800_000_000)))


@query(f"""WITH {EVENT_LOG}, g AS (SELECT event_type, seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, seq) AS gap_us FROM e)
SELECT event_type, seq, gap_us, gap_us // 900000 AS beats FROM g WHERE gap_us > 900000""")
def heartbeat_gaps(spark, sf_dir):
    return timeline.heartbeats(_event_log(spark, sf_dir), ["event_type"], "ts", "seq", 900_000)


@query(f"WITH {EVENT_LOG} SELECT seq, greatest(0, ceil((row_number() OVER (PARTITION BY event_type ORDER BY seq) - 60) / 30.0))::BIGINT AS admit_second FROM e")
def rate_limit_admission(spark, sf_dir):
    return timeline.admitted(_event_log(spark, sf_dir), ["event_type"], "seq", 30, 60).select("seq", "admit_second")


@query(f"""WITH {EVENT_LOG}, n AS (SELECT event_type, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS n FROM e),
o AS (SELECT *, max(t * 3 - n * 1000000) OVER (PARTITION BY event_type ORDER BY seq) AS over FROM n)
SELECT seq, greatest(t, (over + (n + 1 - 5) * 1000000 + 2) // 3)::BIGINT AS admit_us FROM o""")
def rate_limit_arrivals(spark, sf_dir):
    """A token bucket of 5, refilled 3 a second, by when events arrive."""
    rows = _event_log(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return timeline.admitted(rows, ["event_type"], "seq", 3, 5, "t", 1000).select("seq", "admit_us")


@query(f"""WITH {EVENT_LOG}, h AS (SELECT event_type, seq, row_number() OVER w AS n, first_value(seq) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS old FROM e WINDOW w AS (PARTITION BY event_type ORDER BY seq))
SELECT event_type, seq, CASE WHEN n > 1 THEN (seq - old)::DOUBLE / least(n - 1, 5) END AS rate FROM h""")
def rate_ring(spark, sf_dir):
    return timeline.rates(_event_log(spark, sf_dir), ["event_type"], "seq", "seq", 5, 1000).select("event_type", "seq", "rate")


@query(f"""WITH {EVENT_LOG}, c AS (SELECT user_id, seq, event_type, row_number() OVER w AS r, event_type IS NOT DISTINCT FROM lag(event_type) OVER w AS same FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
a AS (SELECT user_id, seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS age FROM c WHERE NOT (same AND r > 1)) SELECT user_id, seq, event_type, age::INT AS age FROM a WHERE age <= 3""")
def history_last3(spark, sf_dir):
    out = timeline.history(_event_log(spark, sf_dir).select("user_id", "seq", "event_type"), ["user_id"], "seq", "event_type")
    return out.select("user_id", "seq", "event_type", "age")


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 600000000 THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM s) SELECT user_id, min(ts) AS began, count(*) AS events FROM n GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    """Extension: sessions with a gap of ten minutes, by Spark's session windows."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    # A gap of exactly ten minutes still joins two events.
    w = F.session_window("t", "600 seconds 1 microsecond")
    return e.groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("events")).drop("w")


# Positions.

SETS = {
    "a": [(SIDS[0], 1, 5), (SIDS[0], 6, 9), (SIDS[0], 20, 30), (SIDS[1], 1, 3), (SIDS[1], 9, 4)],
    "b": [(SIDS[0], 4, 7), (SIDS[0], 25, 40), (SIDS[1], 2, 2)],
    "c": [(SIDS[0], 2, 3), (SIDS[1], 1, 1)],
}
SET_VALUES = "(VALUES " + ", ".join(f"('{k}', '{s}', {a}::BIGINT, {b}::BIGINT)" for k, v in SETS.items() for s, a, b in v) + ') v(set_id, sid, "start", "end")'
POINTS = f"p AS (SELECT DISTINCT set_id, sid, unnest(range(\"start\", \"end\" + 1)) AS n FROM {SET_VALUES} WHERE \"end\" >= \"start\")"
ISLANDS = 'SELECT {id} AS set_id, sid, min(n) AS "start", max(n) AS "end" FROM (SELECT *, n - row_number() OVER (PARTITION BY {by} ORDER BY n) AS g FROM {src}) GROUP BY {by}, g'


def _sets(spark: SparkSession, *names: str) -> DataFrame:
    rows = [(k, *i) for k in names for i in SETS[k]]
    return spark.createDataFrame(rows, "set_id string, sid string, start long, end long")


@query(f"WITH {POINTS} " + ISLANDS.format(id="set_id", by="set_id, sid", src="p"))
def gtid_coalesce(spark, sf_dir):
    return positions.coalesced(_sets(spark, *SETS))


@query(f"WITH {POINTS}, u AS (SELECT DISTINCT sid, n FROM p WHERE set_id IN ('a', 'b')) " + ISLANDS.format(id="'union'", by="sid", src="u"))
def gtid_union(spark, sf_dir):
    return positions.union(_sets(spark, "a"), _sets(spark, "b"))


@query(f"WITH {POINTS}, u AS (SELECT sid, n FROM p WHERE set_id = 'a' EXCEPT SELECT sid, n FROM p WHERE set_id = 'b') " + ISLANDS.format(id="'difference'", by="sid", src="u"))
def gtid_difference(spark, sf_dir):
    return positions.difference(_sets(spark, "a"), _sets(spark, "b"))


@query(f"WITH {POINTS}, u AS (SELECT sid, n FROM p WHERE set_id = 'a' INTERSECT SELECT sid, n FROM p WHERE set_id = 'b') " + ISLANDS.format(id="'intersection'", by="sid", src="u"))
def gtid_intersection(spark, sf_dir):
    return positions.intersection(_sets(spark, "a"), _sets(spark, "b"))


@query(f"""WITH {POINTS} SELECT 'a>=c' AS pair, NOT EXISTS (SELECT sid, n FROM p WHERE set_id = 'c' EXCEPT SELECT sid, n FROM p WHERE set_id = 'a') AS "contains"
UNION ALL SELECT 'a>=b', NOT EXISTS (SELECT sid, n FROM p WHERE set_id = 'b' EXCEPT SELECT sid, n FROM p WHERE set_id = 'a')""")
def gtid_contains(spark, sf_dir):
    one = lambda x, y: positions.contains(_sets(spark, x), _sets(spark, y)).select(F.lit(f"{x}>={y}").alias("pair"), "contains")
    return one("a", "c").unionByName(one("a", "b"))


@query(f"""WITH {POINTS}, i AS ({ISLANDS.format(id='set_id', by='set_id, sid', src='p')}),
s AS (SELECT set_id, sid, string_agg(CASE WHEN "start" = "end" THEN "start"::VARCHAR ELSE "start" || '-' || "end" END, ':' ORDER BY "start") AS r FROM i GROUP BY 1, 2)
SELECT set_id, string_agg(sid || ':' || r, ',' ORDER BY sid) AS gtid_set FROM s GROUP BY 1""")
def gtid_text(spark, sf_dir):
    return positions.text(_sets(spark, *SETS))


@query(f"""WITH {LOG}, p AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN '{SIDS[0]}' ELSE '{SIDS[1]}' END AS sid, k // 2 + 1 AS n FROM l) """ + ISLANDS.format(id="'log'", by="sid", src="p"))
def gtid_executed(spark, sf_dir):
    return positions.executed(log(spark, sf_dir))


@query(f"WITH {POINTS}, u AS (SELECT sid, n FROM p WHERE set_id = 'b' EXCEPT SELECT sid, n FROM p WHERE set_id = 'a') " + ISLANDS.format(id="'lost'", by="sid", src="u"))
def gtid_purged_gap(spark, sf_dir):
    return positions.lost(_sets(spark, "b"), _sets(spark, "a"))


@query("SELECT true AS ahead, false AS behind")
def mariadb_contains(spark, sf_dir):
    points = lambda *p: spark.createDataFrame(p, "domain int, server int, sequence long")
    a, b = points((0, 1, 10), (1, 1, 5)), points((0, 2, 9))
    return positions.domain_contains(a, b).withColumnRenamed("contains", "ahead").crossJoin(positions.domain_contains(b, a).withColumnRenamed("contains", "behind"))


MARIA = "(VALUES (0, 1, 10), (0, 2, 12), (1, 1, 5), (1, 1, 4)) v(domain, server, sequence)"


@query(f"SELECT domain::INT AS domain, max(sequence)::BIGINT AS sequence, arg_max(server, sequence)::INT AS server FROM {MARIA} GROUP BY 1")
def mariadb_gtid_set(spark, sf_dir):
    return positions.domain_set(spark.createDataFrame([(0, 1, 10), (0, 2, 12), (1, 1, 5), (1, 1, 4)], "domain int, server int, sequence long"))


@query("SELECT event_id, 'binlog.00000' || (event_id % 5) AS file FROM events WHERE ('binlog.00000' || (event_id % 5), event_id) <= ('binlog.000002', 500)")
def file_position_reached(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("binlog.00000"), F.col("event_id") % 5).alias("file"), F.col("event_id").alias("pos"))
    return positions.file_position_reached(points, "binlog.000002", 500).drop("pos")


# Value semantics.

PAIRS = [(1, 2), (None, 2), (3, None), (None, None), (7, 0), (-5, 3), (1 << 40, 1 << 21), (-(1 << 62), 3)]
PAIR_VALUES = "(VALUES " + ", ".join(f"({k}, {'NULL' if a is None else a}::BIGINT, {'NULL' if b is None else b}::BIGINT)" for k, (a, b) in enumerate(PAIRS)) + ") v(id, l, r)"


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "id int, l long, r long")


@query(f"""SELECT id, l + r AS added, l - r AS taken, CASE WHEN l::HUGEINT * r BETWEEN -9223372036854775808 AND 9223372036854775807 THEN (l::HUGEINT * r)::BIGINT END AS multiplied,
CASE WHEN r <> 0 THEN l::DOUBLE / r END AS divided FROM {PAIR_VALUES}""")
def math_add_sub_mul_div(spark, sf_dir):
    l, r = F.col("l"), F.col("r")
    ops = {"added": "+", "taken": "-", "multiplied": "*", "divided": "/"}
    return _pairs(spark).select("id", *(mv.arithmetic(op, l, r, tolerant=True).alias(n) for n, op in ops.items()))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_suppkey AS added, l_partkey - l_suppkey AS taken, l_partkey * l_suppkey AS multiplied, CASE WHEN l_suppkey <> 0 THEN l_partkey::DOUBLE / l_suppkey END AS divided FROM lineitem")
def math_over_lineitem(spark, sf_dir):
    l, r = F.col("l_partkey"), F.col("l_suppkey")
    ops = {"added": "+", "taken": "-", "multiplied": "*", "divided": "/"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(mv.arithmetic(op, l, r).alias(n) for n, op in ops.items()))


UNSIGNED = [("18446744073709551615", "0"), ("18446744073709551615", "1"), ("5", "7"), ("7", "5")]


@query("""SELECT id::INT AS id, added, taken FROM (VALUES (0, '18446744073709551615', '18446744073709551615'), (1, NULL, '18446744073709551614'), (2, '12', NULL), (3, '12', '2')) v(id, added, taken)""")
def math_unsigned(spark, sf_dir):
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(UNSIGNED)], "id int, l string, r string")
    l, r = (F.col(c).cast("decimal(20,0)") for c in ("l", "r"))
    return rows.select("id", *(mv.arithmetic(op, l, r, "uint64", "uint64", tolerant=True).cast("string").alias(n) for n, op in (("added", "+"), ("taken", "-"))))


@query(f"SELECT id, coalesce(l, 0) + coalesce(r, 0) AS total FROM {PAIR_VALUES}")
def nullsafe_add(spark, sf_dir):
    return _pairs(spark).select("id", mv.nullsafe_add(F.col("l"), F.col("r")).alias("total"))


@query(f"SELECT id, CASE WHEN l IS NOT DISTINCT FROM r THEN 0 WHEN l IS NULL THEN -1 WHEN r IS NULL THEN 1 WHEN l < r THEN -1 ELSE 1 END::INT AS compared FROM {PAIR_VALUES}")
def nullsafe_compare(spark, sf_dir):
    return _pairs(spark).select("id", mv.nullsafe_compare(F.col("l"), F.col("r")).alias("compared"))


@query(f"SELECT id, least(l, r) AS low, greatest(l, r) AS high FROM {PAIR_VALUES}")
def minmax_null(spark, sf_dir):
    return _pairs(spark).select("id", mv.smaller(F.col("l"), F.col("r")).alias("low"), mv.larger(F.col("l"), F.col("r")).alias("high"))


TEXTS = [("12", 12.0), ("-3", -3.0), ("1.5", 1.5), ("abc", 0.0), (" 12", 0.0), ("1e3", 1000.0), ("", 0.0), ("99999999999999999999", 1e20)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in TEXTS) + ") v(text, number)")
def text_to_number(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in TEXTS], "text string").select("text", mv.text_to_number(F.col("text")).alias("number"))


CASTS = [("12", 12, "12", 12.0), ("-1", -1, None, -1.0), ("1.5", None, None, 1.5), ("x", None, None, None), ("18446744073709551615", None, "18446744073709551615", 18446744073709551615.0), ("9223372036854775807", 9223372036854775807, "9223372036854775807", 9223372036854775807.0)]
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


@query("SELECT text, i::BIGINT AS i, u::VARCHAR AS u, f::DOUBLE AS f FROM (VALUES " + ", ".join(f"({_sql(t)}, {_sql(i)}, {_sql(u)}, {_sql(f)})" for t, i, u, f in CASTS) + ") v(text, i, u, f)")
def cast_matrix(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t, *_ in CASTS], "text string")
    c = F.col("text")
    return rows.select("text", mv.cast(c, "int64", True).alias("i"), mv.cast(c, "uint64", True).cast("string").alias("u"), mv.cast(c, "float64", True).alias("f"))


@query("SELECT o_orderkey, true AS same FROM orders")
def hash_contract(spark, sf_dir):
    """Equal numbers of different kinds have equal codes."""
    k = F.col("o_orderkey")
    codes = [mv.hash_code(c) for c in (k, k.cast("double"), k.cast("decimal(20,0)"), k.cast("string").cast("double"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", ((codes[0] == codes[1]) & (codes[0] == codes[2]) & (codes[0] == codes[3])).alias("same"))


@query("SELECT s_suppkey, regexp_replace(s_acctbal::DECIMAL(12,2)::VARCHAR, '^(-?)0\\.', '\\1.') AS shown FROM supplier")
def decimal_text(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", mv.decimal_text(F.col("s_acctbal").cast("decimal(12,2)")).alias("shown"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type LIKE 'S%'")
def like_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(st.like(F.col("p_name"), "%a_e%") & st.like(F.col("p_type"), "S%")).select("p_partkey", "p_name")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_extract_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 950 THEN substr(text, 1, 950) || '...' ELSE text END AS message FROM documents")
def truncate_message(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", st.truncated(F.col("text")).alias("message"))


STATEMENTS = [
    ("select 1", "SELECT"), ("  /* c */ Insert into t values (1)", "INSERT"), ("BEGIN", "BEGIN"), ("begin junk", "UNKNOWN"), ("start transaction", "BEGIN"), ("commit /* x */", "COMMIT"), ("rollback", "ROLLBACK"),
    ("rollback to a", "SAVEPOINT_ROLLBACK"), ("alter table t add c int", "DDL"), ("truncate t", "DDL"), ("set a = 1", "SET"), ("desc t", "EXPLAIN"), ("grant all", "PRIV"), ("/*!40101 x */", "COMMENT"), ("(select 1)", "SELECT"), ("analyze t", "OTHER"), ("hello", "UNKNOWN"), ("", "UNKNOWN"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}')" for s, k in STATEMENTS) + ") v(sql, kind)")
def statement_preview(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in STATEMENTS], "sql string").select("sql", st.statement_kind(F.col("sql")).alias("kind"))


NAMES = [("CamelCase", "camel_case", "camel-case"), ("CCamel.Name", "c_camel_name", "c-camel-name"), ("a-b", "a_b", "a-b"), ("CAMEL_CASE", "camel_case", "camel-case")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in NAMES) + ") v(name, snake, kebab)")
def metric_names(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, *_ in NAMES], "name string")
    return rows.select("name", st.snake_name(F.col("name")).alias("snake"), st.kebab_name(F.col("name")).alias("kebab"))


@query("SELECT p_partkey, '`' || replace(p_name, '`', '``') || '`' AS quoted, '''' || replace(p_type, '''', '\\''') || '''' AS literal FROM part")
def sql_encoding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", st.quoted_name(F.col("p_name")).alias("quoted"), st.quoted_text(F.col("p_type")).alias("literal"))


@query("SELECT c_nationkey, unnest([c_custkey, c_custkey + 1]) AS id, unnest(['a', 'b']) AS tag FROM customer")
def plan_value_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.array(F.col("c_custkey"), F.col("c_custkey") + 1).alias("id"), F.array(F.lit("a"), F.lit("b")).alias("tag"))
    return exploded(rows, ["id", "tag"])


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN least(ts, ts + INTERVAL 1 SECOND) END AS first FROM events")
def event_token_minimum(spark, sf_dir):
    ts = F.col("ts")
    other = F.when(F.col("event_id") % 7 != 0, ts + F.expr("interval 1 second"))
    return table(spark, sf_dir, "events").select("event_id", st.earliest_token(ts, other).alias("first"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey::INT, s_name FROM supplier")
def result_append(spark, sf_dir):
    other = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return results.appended(results.first_columns(table(spark, sf_dir, "nation"), 2), other)


@query("SELECT o_orderstatus, count(*) - count(*) FILTER (o_orderkey % 5 <> 0) AS missing FROM orders GROUP BY 1")
def result_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return results.differences(rows, rows.filter("o_orderkey % 5 <> 0")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, 0::BIGINT AS bad FROM events")
def named_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return rows.select("event_id", results.named("k", "bigint", -1).alias("k"), results.named("event_type", "bigint", 0).alias("bad"))


@query("SELECT p_partkey, base64(encode(p_name)) AS encoded FROM part")
def ascii_encoding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("encoded"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def collated_filter(spark, sf_dir):
    """A case-insensitive comparison by collation."""
    return table(spark, sf_dir, "customer").filter(F.collate("c_mktsegment", "UTF8_LCASE") == F.lit("Building")).select("c_custkey")


# Control plane and metrics.

TASKS = [(k, f"10.0.0.{k % 3}", ("running", "paused", "running", "copying")[k % 4], 1000 + 37 * k) for k in range(23)]
TASK_VALUES = "(VALUES " + ", ".join(f"({i}, '{a}', '{s}', {u}::BIGINT)" for i, a, s, u in TASKS) + ") t(id, service_addr, state, updated_at)"
INSTANCES = ["10.0.0.0", "10.0.0.1", "10.0.0.7", "10.0.0.8"]
INSTANCE_VALUES = "(VALUES " + ", ".join(f"('{a}')" for a in INSTANCES) + ") i(addr)"


def _tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "id int, service_addr string, state string, updated_at long")


def _instances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in INSTANCES], "addr string")


@query(f"SELECT addr, count(id) AS tasks FROM {INSTANCE_VALUES} LEFT JOIN {TASK_VALUES} ON addr = service_addr GROUP BY 1 ORDER BY tasks, addr LIMIT 1")
def task_least_loaded(spark, sf_dir):
    return tasks.least_loaded(_instances(spark), _tasks(spark))


@query(f"SELECT addr FROM {INSTANCE_VALUES} WHERE addr NOT IN (SELECT service_addr FROM {TASK_VALUES})")
def task_idle_instances(spark, sf_dir):
    return tasks.idle(_instances(spark), _tasks(spark))


@query(f"SELECT * FROM {TASK_VALUES} ORDER BY id LIMIT 5 OFFSET 10")
def task_paging(spark, sf_dir):
    return tasks.page(_tasks(spark), 3, 5)


@query(f"SELECT * FROM {TASK_VALUES} WHERE state = 'running' AND 1900 - updated_at > 400")
def task_stale(spark, sf_dir):
    return tasks.stale(_tasks(spark), 1900, 400)


@query(f"SELECT * FROM {TASK_VALUES} WHERE state IN ('copying', 'running') AND service_addr NOT IN (SELECT addr FROM {INSTANCE_VALUES})")
def task_takeover(spark, sf_dir):
    return tasks.to_take_over(_tasks(spark), _instances(spark))


@query(f"SELECT id % 4 AS repl_id, count(*) AS tables FROM {TASK_VALUES} GROUP BY 1")
def pending_tables(spark, sf_dir):
    return tasks.pending_tables(_tasks(spark).select((F.col("id") % 4).alias("repl_id"), F.col("service_addr").alias("tbl")))


BUCKETS = "CASE " + " ".join(f"WHEN v <= {c} THEN '{c}'" for c in metrics.CUTOFFS) + " ELSE 'inf' END"


@query(f"WITH v AS (SELECT event_type, round(value * 10000000)::BIGINT AS v FROM events) SELECT event_type, {BUCKETS} AS bucket, count(*) AS events, sum(v)::BIGINT AS total FROM v GROUP BY 1, 2")
def metrics_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], F.round(F.col("value") * 10_000_000).cast("long"))


@query("SELECT event_type, user_id % 3 AS shard, count(*) AS count, grouping(event_type, user_id % 3)::BIGINT AS level FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def metrics_counters(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 3), ["event_type", "shard"])


@query("SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def metrics_gauge(spark, sf_dir):
    return metrics.gauge(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")


@query("SELECT event_type, (epoch_us(ts) // 60000000)::BIGINT AS slot, count(*) AS events, count(*) / 60.0::DOUBLE AS per_second FROM events GROUP BY 1, 2")
def metrics_rates(spark, sf_dir):
    return metrics.counter_rates(table(spark, sf_dir, "events"), ["event_type"], F.unix_timestamp(F.col("ts").cast("timestamp")), 60)


# Relational surface of the grammar, over derived state.


@query(f"""WITH {FINAL} SELECT c_mktsegment, n_name, count(*) AS orders, sum(cents)::BIGINT AS cents FROM f JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def state_join_dimensions(spark, sf_dir):
    """Derived state joined with dimensions; Catalyst broadcasts those it knows to be small."""
    orders = applied(planned("select * from orders"), log(spark, sf_dir))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))


JOIN_SQL = {
    "anti_not_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "is_true_false": ("SELECT o_orderkey, (o_orderstatus = 'F') IS TRUE AS f, (o_orderkey % 2 = 0) IS NOT FALSE AS e FROM orders", None),
    "regexp_match": ("SELECT c_custkey FROM customer WHERE regexp_like(c_name, '[02468]$')", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[02468]$')"),
    "null_safe_equal": ("SELECT o_orderkey, nullif(o_orderstatus, 'P') <=> nullif('P', 'P') AS missing FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL AS missing FROM orders"),
    "like_escape": ("SELECT n_nationkey FROM nation WHERE concat(n_name, '_x') LIKE '%!_x' ESCAPE '!'", None),
    "population_deviation": ("SELECT l_returnflag, round(stddev_pop(l_linenumber), 6) AS std FROM lineitem GROUP BY l_returnflag", None),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_right": ("SELECT n_nationkey, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey", None),
    "join_using": ("SELECT count(*) AS n, sum(a.c_custkey) AS s FROM customer a JOIN customer b USING (c_custkey)", "SELECT count(*) AS n, sum(a.c_custkey)::BIGINT AS s FROM customer a JOIN customer b USING (c_custkey)"),
    "join_natural": ("SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) y", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "semi_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "set_union_distinct": ("SELECT o_orderstatus AS s FROM orders UNION SELECT l_linestatus FROM lineitem", None),
    "set_union_all": ("SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s FROM orders UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY s", None),
    "order_limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "aggregate_names": (
        "SELECT l_returnflag, avg(l_linenumber) AS a, bit_and(l_linenumber) AS b, bit_or(l_linenumber) AS o, bit_xor(l_linenumber) AS x, count(DISTINCT l_suppkey) AS d, min(l_linenumber) AS mi, max(l_linenumber) AS ma, round(var_pop(l_linenumber), 6) AS vp, round(stddev_samp(l_linenumber), 6) AS ss FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "group_concat": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "boolean_and_range": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND o_orderkey BETWEEN 10 AND 5000 AND ((o_orderkey % 2 = 0) <> (o_custkey % 2 = 0)) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice IS NOT NULL", None),
    "bit_operators": (
        "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey ^ 5 AS x, shiftleft(o_orderkey, 2) AS l, shiftright(o_orderkey, 1) AS r, o_orderkey DIV 7 AS d, o_orderkey % 7 AS m FROM orders",
        "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders",
    ),
    "string_functions": (
        "SELECT p_partkey, substring(p_name, 1, 3) AS s, concat(p_brand, '-', p_type) AS c, lpad(cast(p_size AS string), 4, '0') AS l, if(p_size > 20, 'big', 'small') AS i, ifnull(p_name, '') AS n, hex(p_size) AS h FROM part",
        "SELECT p_partkey, substring(p_name, 1, 3) AS s, concat(p_brand, '-', p_type) AS c, lpad(p_size::VARCHAR, 4, '0') AS l, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS i, coalesce(p_name, '') AS n, hex(p_size) AS h FROM part",
    ),
    "date_functions": (
        "SELECT o_orderkey, hour(o_orderdate) AS h, date_format(o_orderdate, 'yyyy-MM') AS ym, datediff(date '2000-01-01', cast(o_orderdate AS date)) AS d FROM orders",
        "SELECT o_orderkey, hour(o_orderdate)::INT AS h, strftime(o_orderdate, '%Y-%m') AS ym, datediff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS d FROM orders",
    ),
}


def _relational(name: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if t in text]
        return spark.sql(_bound(text, names), **{f"{t}_": table(spark, sf_dir, t) for t in names})

    run.__name__ = name
    return run


def _bound(text: str, names: list[str]) -> str:
    """The text with its tables as parameters, so that no view is left behind."""
    for t in names:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}_}} {t}", text)
    # An alias of its own stands in for the table's name.
    return re.sub(r"(\{\w+_\}) \w+ ([ab])\b", r"\1 \2", text)


for _name, (_text, _oracle) in JOIN_SQL.items():
    QUERIES[_name] = _relational(_name, _text)
    ORACLES[_name] = _oracle or _text


# Texts, checks and plans: what the driver's functions give for the rows of a table.


def _mapped(rows: DataFrame, column: str, name: str, of: Callable[[str], str | None]) -> DataFrame:
    one = F.pandas_udf(lambda texts: texts.map(of), "string")
    return rows.withColumn(name, one(column))


def _statement(rows: DataFrame, *parts) -> DataFrame:
    return rows.select("o_orderkey", F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("sql"))


@query("SELECT o_orderkey, 'select * from t where a = :v2 and b = :v3 and c = :v2 and d in ::v1' AS template, o_orderkey || ' ' || o_orderstatus || ' [7, 8]' AS vars FROM orders")
def literal_normalization(spark, sf_dir):
    rows = _statement(table(spark, sf_dir, "orders"), "select * from t where a = ", F.col("o_orderkey"), " and b = '", F.col("o_orderstatus"), "' and c = ", F.col("o_orderkey"), " and d in (7, 8)")
    out = _mapped(rows, "sql", "template", lambda t: sql_text.normalized(t)[0])
    shown = lambda v: f"{v['v2']} {v['v3']} {v['v1']}"
    return _mapped(out, "sql", "vars", lambda t: shown(sql_text.normalized(t)[1])).drop("sql")


@query("SELECT o_orderkey, 'update t set a = '';'' where k = ' || o_orderkey AS first, 2 AS statements FROM orders")
def statement_splitting(spark, sf_dir):
    rows = _statement(table(spark, sf_dir, "orders"), "update t set a = ';' where k = ", F.col("o_orderkey"), " ; /* ; */ ; delete from t;")
    out = _mapped(rows, "sql", "first", lambda t: sql_text.statements(t)[0])
    return _mapped(out, "sql", "n", lambda t: str(len(sql_text.statements(t)))).select("o_orderkey", "first", F.col("n").cast("int").alias("statements"))


@query("SELECT o_orderkey, o_orderkey || ' True False' AS directives FROM orders")
def comment_directives(spark, sf_dir):
    rows = _statement(table(spark, sf_dir, "orders"), "select /*x+ SIZE=", F.col("o_orderkey"), " FAST DEEP=false */ 1")
    return _mapped(rows, "sql", "directives", lambda t: "{SIZE} {FAST} {DEEP}".format(**sql_text.directives(t))).drop("sql")


@query("SELECT o_orderkey, 'select * from (select ' || o_orderkey || ' as k) t where 1 != 1' AS probe FROM orders")
def impossible_query(spark, sf_dir):
    return _mapped(_statement(table(spark, sf_dir, "orders"), "select ", F.col("o_orderkey"), " as k"), "sql", "probe", sql_text.probe).drop("sql")


@query("SELECT o_orderkey, 'insert into t values (:v, :v)' AS shown FROM orders")
def redacted_statement(spark, sf_dir):
    rows = _statement(table(spark, sf_dir, "orders"), "insert into t values (", F.col("o_orderkey"), ", '", F.col("o_orderstatus"), "')")
    return rows.select("o_orderkey", st.redacted(F.col("sql")).alias("shown"))


@query("SELECT o_orderkey, 'select a from t where k = ' || o_orderkey || ' and s in (''x'', null)' AS bound FROM orders")
def bind_substitution(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return _mapped(rows, "k", "bound", lambda k: bound("select a from t where k = :k and s in ::l", {"k": int(k), "l": ["x", None]})).drop("k")


@query("SELECT n_nationkey, hex(encode(n_name)) || repeat('00', 30 - length(n_name)) AS padded FROM nation")
def padded_binary(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.hex(mv.padded_binary(F.col("n_name"), 30)).alias("padded"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN n_regionkey = 1 END AS flag FROM nation")
def to_bool(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", mv.to_bool(F.col("n_regionkey"), tolerant=True).alias("flag"))


@query("SELECT event_id, event_id % 3 = 0 AS hosted FROM events")
def hosted_system_statements(spark, sf_dir):
    sql = F.when(F.col("event_id") % 3 == 0, "insert into mysql.rds_heartbeat2 values (1)").otherwise("insert into t values (1)")
    return table(spark, sf_dir, "events").select("event_id", is_hosted_system_statement(sql).alias("hosted"))


@query(f"WITH {LOG} SELECT kind, count(*) AS n FROM (SELECT 'row' AS kind FROM l) GROUP BY kind")
def full_row_images(spark, sf_dir):
    return full_images(log(spark, sf_dir), list(ORDER_ROW.names)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS pos, 'shop' AS db, 'alter table t add c' || o_orderkey || ' int' AS sql, 'ddl' AS kind FROM orders")
def binlog_query_events(spark, sf_dir):
    def events(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            body = lambda k: struct.pack("<IIBHH", 1, 0, 4, 0, 0) + b"shop\0" + f"alter table t add c{k} int".encode()
            yield pd.DataFrame({"file": "log.1", "pos": pdf["o_orderkey"], "event": [_event(binlog.QUERY, body(k)) for k in pdf["o_orderkey"].tolist()]})

    raw = table(spark, sf_dir, "orders").select("o_orderkey").mapInPandas(events, "file string, pos long, event binary")
    return binlog.decode(raw, checksum=True).select("pos", "db", "sql", "kind")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def default_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return TablePlan.of(Rule("shop", "nation").select_text("nation"), rows.schema, ("n_nationkey",)).snapshot(rows)


@query("SELECT * FROM (VALUES ('cents', 0), ('o_custkey', 1), ('o_orderstatus', 2)) v(name, place)")
def column_pruning(spark, sf_dir):
    plan = planned("select cents + o_custkey as total from orders where o_orderstatus = 'F'", ("total",))
    return spark.createDataFrame(list(zip(plan.referenced, range(9), strict=False)), "name string, place int")


@query("SELECT * FROM (VALUES (0, 'Orders'), (1, 'customer'), (2, 'lineitem')) v(place, name)")
def tables_included_and_sorted(spark, sf_dir):
    found = included(["lineitem", "part", "Orders", "customer", "customer_old"], ["ORDERS", "/^(cust|line)/"], ["/_old$/"])
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@query("SELECT * FROM (VALUES ('select c2 from t', 'primary key column c1 not found in select list'), ('select c2, count(*) as c1 from t group by c2', 'primary key column c1 is not allowed to reference an aggregate expression')) v(text, refused)")
def key_validation(spark, sf_dir):
    schema, rows = T.StructType([T.StructField(c, T.LongType()) for c in ("c1", "c2")]), []
    for text in ("select c2 from t", "select c2, count(*) as c1 from t group by c2"):
        try:
            TablePlan.of(text, schema, ("c1",))
        except PlanError as e:
            rows.append((text, str(e)))
    return spark.createDataFrame(rows, "text string, refused string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'a task needs a source host' WHEN n_nationkey % 3 = 1 THEN 'a task goes to one database or to one message bus' ELSE 'port 3306' END AS checked FROM nation")
def task_validation(spark, sf_dir):
    def checked(k: str) -> str:
        n = int(k) % 3
        try:
            return f"port {tasks.TaskSpec({'host': 'h'} if n else {}, [Rule('db', 't')], sink={} if n != 1 else None).checked().source['port']}"
        except PlanError as e:
            return str(e)

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("k"))
    return _mapped(rows, "k", "checked", checked).drop("k")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal::DECIMAL(12,2) >= 1000.50 AND s_acctbal::DECIMAL(12,2) <> 1234.567")
def decimal_literals(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(12,2)").alias("balance"))
    return TablePlan.of("select s_suppkey from supplier where balance >= '1000.50' and balance != '1234.567'", rows.schema, ("s_suppkey",), extended=True).snapshot(rows)


# Streams.


@query(f"WITH {FINAL} SELECT * FROM f WHERE o_orderstatus = 'F'")
def stream_state_equals_batch(spark, sf_dir):
    """The filtered state again, by a file stream folded batch by batch."""
    return run_to_state(spark, log(spark, sf_dir), planned("select * from orders where o_orderstatus = 'F'"), files=4)


@query(f"WITH {FINAL} SELECT o_custkey, count(*) AS c, sum(cents)::BIGINT AS s FROM f WHERE o_orderstatus = 'F' GROUP BY 1")
def stream_aggregate_equals_batch(spark, sf_dir):
    return run_to_state(spark, log(spark, sf_dir), _grouped(), files=4).filter("c > 0")


@query(f"WITH {LOG} SELECT o_custkey, count(*) AS changes, max(seq) AS last_seq FROM l GROUP BY 1")
def stream_stateful_counts(spark, sf_dir):
    """Changes per customer, by a custom stateful operator."""
    rows = log(spark, sf_dir).select("seq", F.coalesce("after.o_custkey", "before.o_custkey").alias("o_custkey"))
    return run_counts(spark, rows, "o_custkey", files=3)


@query("SELECT event_type, epoch(time_bucket(INTERVAL 10 MINUTE, ts))::BIGINT AS began, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Extension: windowed counts with a watermark, all windows complete at the end."""
    return run_windows(spark, table(spark, sf_dir, "events"), "ts", ["event_type"], "10 minutes", files=3)
