from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tidelog.plans.errors import PlanError
from tidelog.plans.rules import Rule, base_table, ddl_matters, route
from tidelog.plans.select_text import parse
from tidelog.plans.table_plan import TablePlan

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "region", "amount", "tax", "order")])

# Refused selects by the rule that they break. The wording of the errors is a contract (fixed values).
NOT_A_SELECT = {
    "sell everything": "syntax error at position 5 near 'sell'",
    "delete from stock": "unexpected: delete from stock",
    "insert into stock values (1)": "unexpected: insert into stock values(1)",
}
NOT_ONE_TABLE = {
    "select distinct region from stock": "unexpected: select distinct region from stock",
    "select id from stock, depot": "unexpected: select id from stock, depot",
    "select id from stock left join depot": "unexpected: select id from stock left join depot",
    "select id from (select id from depot) as d": "unexpected: select id from (select id from depot) as d",
}
ITEMS = {
    "select *, amount from stock": "unexpected: select *, amount from stock",
    "select amount, * from stock": "unexpected: *",
    "select upper(distinct region) as r from stock": "unexpected: upper(distinct region)",
    "select amount + tax from stock": "expression needs an alias: amount + tax",
}
AGGREGATES = {
    "select count(amount) as n from stock": "only count(*) is supported: count(amount)",
    "select sum(*) as total from stock": "unexpected: sum(*)",
    "select sum(amount, tax) as total from stock": "unexpected: sum(amount, tax)",
    "select sum(amount * tax) as total from stock": "unexpected: sum(amount * tax)",
    "select region from stock group by region * 2": "unexpected: region * 2",
    "select region as r from stock group by region": "group by expression does not reference an alias in the select list: region",
    "select sum(amount) as s from stock group by s": "group by expression is not allowed to reference an aggregate expression: s",
}
REJECTED = NOT_A_SELECT | NOT_ONE_TABLE | ITEMS | AGGREGATES


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(PlanError) as e:
        parse(text)
    assert str(e.value) == REJECTED[text]


@pytest.mark.parametrize("where", ["a > 5", "a = null", "a in (1, 2)", "a = 1 or b = 2", "not a = 1", "a = 1.5", "a like 'x'", "1 = a", "f(a) = 1"])
def test_rejected_constraints(where):
    with pytest.raises(PlanError):
        parse(f"select * from t1 where {where}")


@pytest.mark.parametrize("clause", ["having c > 1", "order by a", "limit 3", "union select a from t2"])
def test_no_clause_is_ignored(clause):
    with pytest.raises(PlanError):
        parse(f"select a from t1 {clause}")


@pytest.mark.parametrize(("text", "mode", "actions"), [
    ("select id, amount from stock", "normal", ("insert", "update", "delete")),
    ("select id, concat('r', region) as name, amount - tax as net from stock where region = 3", "normal", ("insert", "update", "delete")),
    ("select region as id, tax from stock group by id", "on_dup", ("upsert", "update", "update")),
    ("select region as id, count(*) as n, sum(amount) as total from stock group by id", "on_dup", ("upsert", "update", "update")),
    ("select id, region from stock group by id, region", "ignore", ("ignore", "ignore", "none")),
])
def test_modes(text, mode, actions):
    plan = TablePlan.of(text, SCHEMA, ("id",))
    assert plan.mode == mode and tuple(plan.actions().values()) == actions


def test_key_references_and_pruning():
    plan = TablePlan.of("select amount + tax as code, region as r from stock where id = 4", SCHEMA, ("code",))
    assert plan.key_references == ("amount", "tax")
    assert plan.referenced == ("amount", "tax", "region", "id")


def test_reserved_names_are_quoted():
    plan = TablePlan.of("select id, `order` from `group`", SCHEMA, ("id",))
    assert plan.select.table == "group" and plan.select.items[1].sql("after") == "`after`.`order`"


def test_keys_are_checked(spark):
    with pytest.raises(PlanError, match="not found in select list"):
        TablePlan.of("select region from stock", SCHEMA, ("id",))
    with pytest.raises(PlanError, match="aggregate expression"):
        TablePlan.of("select region, count(*) as id from stock group by region", SCHEMA, ("id",))
    with pytest.raises(PlanError, match="unknown column"):
        TablePlan.of("select nope from stock", SCHEMA, ("nope",))
    with pytest.raises(PlanError, match="is a number"):
        from tidelog.plans.table_plan import condition

        condition(parse("select * from stock where amount = 'x'").where, SCHEMA)


def test_literals_have_the_columns_type(spark):
    schema = T.StructType([T.StructField("price", T.DecimalType(12, 2)), T.StructField("rate", T.DoubleType()), T.StructField("n", T.IntegerType())])
    rows = spark.createDataFrame([(Decimal("1.50"), 0.25, 3), (Decimal("1.51"), 1e30, -4), (None, None, None)], schema)
    kept = lambda where: TablePlan.of(f"select n from t where {where}", schema, ("n",), extended=True).snapshot(rows).count()
    assert kept("price = '1.50'") == kept("price = '1.5'") == kept("rate = '0.25'") == kept("n = '3'") == 1
    assert kept("price = '1.505'") == kept("n = '3.5'") == 0 and kept("price < '1.505'") == kept("n < '3.5'") - 1 == 1
    assert kept("n < '99999999999999999999'") == kept("price < '123456789012345.678'") == 2
    text = TablePlan.of("select n from t where price = '1.50'", schema, ("n",)).snapshot(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(price" not in text


def test_routing():
    rules = [Rule("db", "t2", "exclude"), Rule("db", "/.*/")]
    assert route(rules, "db", "t2") is None and route(rules, "db", "t1")[0] is rules[1] and route(rules, "x", "t1") is None
    assert Rule("db", "t1").select_text("t1") == "select * from `t1`"
    assert [base_table(t) for t in ("_t_gho", "_t_ghc", "_t_del", "_t", "t", "__x_gho")] == ["t", "t", "t", "t", "t", "x"]
    with pytest.raises(PlanError):
        Rule("db", "/(/")
    assert not ddl_matters(rules, "db", "create database a") and not ddl_matters([Rule("db", "a")], "db", "alter table b add c int")
