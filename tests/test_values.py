import pytest
from pyspark.sql import functions as F

from tidelog.functions import mysql_values as mv
from tidelog.functions import statements as st
from tidelog.functions.binding import bound, encoded, pivoted
from tidelog.sources.catalog import equivalent, included, label_of, reconciled, spark_field


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_overflow_is_an_error_unless_tolerant(spark):
    big, two = F.lit((1 << 63) - 1), F.lit(2)
    for op in "+*":
        with pytest.raises(Exception, match="out of range"):
            one(spark, mv.arithmetic(op, big, two))
        assert one(spark, mv.arithmetic(op, big, two, tolerant=True)) is None
    u = F.lit("5").cast("decimal(20,0)")
    with pytest.raises(Exception, match="UNSIGNED"):
        one(spark, mv.arithmetic("-", u, F.lit(7), "uint64", "int64"))
    # Times 0 is 0, and a negative number may be added to an unsigned one.
    assert one(spark, mv.arithmetic("*", u, F.lit(0), "uint64", "int64")) == 0
    assert one(spark, mv.arithmetic("+", u, F.lit(-2), "uint64", "int64")) == 3


def test_division_is_real(spark):
    assert one(spark, mv.arithmetic("/", F.lit(1), F.lit(4))) == 0.25
    assert one(spark, mv.arithmetic("/", F.lit(1), F.lit(0))) is None
    assert one(spark, mv.arithmetic("/", F.lit(1), F.lit("0.3"), "int64", "text")) == pytest.approx(1 / 0.3)


@pytest.mark.parametrize(("a", "b", "kinds", "out"), [
    (None, None, ("int64", "int64"), 0), (None, 1, ("int64", "int64"), -1), (1, None, ("int64", "int64"), 1), ("abd", "abc", ("text", "text"), 1),
    ("10", 9, ("text", "int64"), 1), (1.0, 1, ("float64", "int64"), 0), ("a", "B", ("text", "text"), 1),
])
def test_nullsafe_compare(spark, a, b, kinds, out):
    assert one(spark, mv.nullsafe_compare(F.lit(a), F.lit(b), *kinds)) == out


def test_nullsafe_add(spark):
    assert one(spark, mv.nullsafe_add(F.lit(None).cast("long"), F.lit(None).cast("long"))) == 0
    assert one(spark, mv.nullsafe_add(F.lit(1), F.lit(None).cast("long"))) == 1


def test_special_values(spark):
    assert one(spark, mv.year_text(F.lit(0))) == "0000" and one(spark, mv.year_text(F.lit(121))) == "2021"
    assert one(spark, mv.date_or_null(F.lit("0000-00-00"))) is None and one(spark, mv.date_or_null(F.lit("2020-02-03"))).isoformat() == "2020-02-03"
    assert one(spark, mv.time_interval(F.lit("-838:59:59"))).total_seconds() == -3020399
    assert one(spark, mv.time_interval(F.lit("839:00:00"))) is None
    assert bytes(one(spark, mv.padded_binary(F.lit("ab"), 4))) == b"ab\0\0"
    assert one(spark, mv.to_bool(F.lit(1))) is True
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, mv.to_bool(F.lit(2)))


def test_statements(spark):
    assert one(spark, st.bit_literal(F.lit(bytearray(b"a")))) == "b'01100001'"
    assert one(spark, st.quoted_text(F.lit("a'b\n\\"))) == "'a\\'b\\n\\\\'" and one(spark, st.quoted_text(F.lit(None).cast("string"))) == "null"
    assert one(spark, st.redacted(F.lit("select * from t1 where a = 'x' and b = 12"))) == "select * from t1 where a = :v and b = :v"
    assert one(spark, st.like(F.lit("a%b"), r"a\%b")) and not one(spark, st.like(F.lit("axb"), r"a\%b"))


def test_binding(spark):
    assert bound("a = :a and b in ::b", {"a": "x'y", "b": [1, None]}) == "a = 'x\\'y' and b in (1, null)"
    with pytest.raises(KeyError, match="missing bind var c"):
        bound(":c", {})
    assert encoded(True) == "1"
    assert [tuple(r) for r in pivoted(spark, {"a": 10, "b": [1, 2]}, "a int, b int").collect()] == [(10, 1), (10, 2)]
    with pytest.raises(ValueError, match="mismatch"):
        pivoted(spark, {"a": [1], "b": [1, 2]}, "a int, b int")


def test_catalog():
    assert included(["A", "b", "c1"], ["a", "/^c/"]) == ["A", "c1"] and included(["a", "b"], exclude=["B"]) == ["a"]
    assert spark_field("x", "bigint(20) unsigned").dataType.simpleString() == "decimal(20,0)"
    assert spark_field("x", "decimal(65,30)").dataType.simpleString() == "string"
    assert spark_field("x", "enum('a','b''c')").metadata["labels"] == ["a", "b'c"]
    assert label_of(2, ["a", "b"]) == "b" and label_of(0, ["a"]) == "" and label_of(5, ["a", "b", "c"], True) == "a,c"
    assert equivalent("int", "int unsigned") and equivalent("char", "enum") and not equivalent("int", "bigint")
    from pyspark.sql import types as T

    table = T.StructType([spark_field("a", "int"), spark_field("b", "varchar(9)"), spark_field("c", "int")])
    assert reconciled(["int", "varchar"], table) == ["a", "b"] and reconciled(["bigint", "varchar"], table) == ["@1", "@2"]
