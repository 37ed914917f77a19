"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same number of expected copies, target / source size. In a
fixed order within the source the expected copies are summed up; with one offset per source, a
document is emitted once for each integer that its part of the sum crosses. The order runs through
classes of like size, so that the words taken stay near the target.

The running sum needs each document's place in its source. It is found in two levels, with no task
that holds a source: documents are numbered within (source, size class, chunk), and the sizes of
those groups are summed along the source, over at most `CHUNKS` x (about 500) rows a source.

Defined results: a null or empty text has size 0 and still has a place; a null source is a source of
its own, the last one; identical rows are interchangeable; a source without words has target 0 and
takes nothing; extra columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, column, fresh

WEIGHTS = (1, 2, 3)
CAP = 3
CHUNKS = 64


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with target: shares by weight, none above CAP x size.

    Sources in order of size per weight: the first ones, as long as their even share is above the
    cap, are capped; the rest shares what is left by weight. One row per source goes through one
    task, for the order of the sources is global.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        (F.sum("source_size").over(every) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    capped = F.col("words_left") * F.col("weight") >= CAP * F.col("source_size") * F.col("weight_left")
    share = left.withColumn("share", F.when(~capped, F.col("words_left").cast("double") / F.col("weight_left")))
    level = F.max("share").over(every)
    cap = (CAP * F.col("source_size")).cast("double")
    return share.select(
        "source", "source_size", F.when(F.col("share").isNull(), cap).otherwise(F.least(cap, level * F.col("weight"))).alias("target")
    )


def plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` with size, source_size, target and copies (long), under names it has free.

    The four names are returned as the attribute `mix_columns` of the result.
    """
    names = [fresh(docs, n) for n in ("size", "source_size", "target", "copies")]
    row, src, key = (fresh(docs, f"_mix_{n}") for n in ("row", "source", "id"))
    bits = F.length(F.bin(F.col(names[0])))
    octave = F.greatest(bits - 4, F.lit(0))
    based = docs.withColumns({row: F.lit(1), src: column(docs, "source", "string"), key: column(docs, "doc_id", "long"), names[0]: _size(column(docs, "text", "string"))})
    classed = based.withColumns({
        row: (octave * 16 + F.expr(f"shiftright(`{names[0]}`, cast({octave_sql(names[0])} as int))")).cast("long"),
        f"{row}chunk": F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(CHUNKS)),
    })
    group = [src, row, f"{row}chunk"]
    counted = classed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(names[0]).alias("words"))
    sizes = counted.groupBy(F.col(src).alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(sizes).withColumnRenamed("source", "goal_source")
    along = Window.partitionBy(src).orderBy(row, f"{row}chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .join(goal, F.col(src).eqNullSafe(F.col("goal_source")))
        .select(*(F.col(c).alias(f"{c}__g") for c in group), "before", F.col("source_size").alias("s_size"), F.col("target").alias("s_target"))
    )
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(src), F.lit("")))), 1, 3), 16, 10).cast("double") + 0.5) / 4096
    place = F.col("before") + F.row_number().over(
        Window.partitionBy(*group).orderBy(F.col(key).asc_nulls_last(), F.col(names[0]))
    )
    rate = F.when(F.col("s_size") > 0, F.col("s_target") / F.col("s_size")).otherwise(0.0)
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    joined = classed.join(starts, [F.col(c).eqNullSafe(F.col(f"{c}__g")) for c in group])
    out = joined.withColumn("crossed", F.least(crossed, F.lit(CAP)).cast("long")).select(
        *(F.col(f"`{c}`") for c in docs.columns), F.col(names[0]), F.col("s_size").alias(names[1]), F.col("s_target").alias(names[2]), F.col("crossed").alias(names[3])
    )
    out.mix_columns = names
    return out


def octave_sql(size: str) -> str:
    return f"greatest(length(bin(`{size}`)) - 4, 0)"


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the plan says, with the copy's number."""
    planned = plan(docs, seed)
    size, source_size, target, copies = planned.mix_columns
    copy = fresh(planned, "copy")
    emitted = planned.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return emitted.select(*(F.col(f"`{c}`") for c in docs.columns), copy)


def digest(docs: DataFrame) -> DataFrame:
    planned = plan(docs.select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT *, greatest(length(bin(size)) - 4, 0) AS o FROM d),
c AS (SELECT *, o * 16 + (size >> o::INT) AS cls, coalesce(doc_id, 0) % 64 AS chunk FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, chunk, doc_id NULLS LAST, size) AS place FROM c),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM r),
l AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS words_left,
        sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
      FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN words_left * weight < 3 * source_size * weight_left THEN words_left::DOUBLE / weight_left END AS share FROM l),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN (3 * source_size)::DOUBLE
        ELSE least((3 * source_size)::DOUBLE, max(share) OVER () * weight) END AS target FROM h),
u AS (SELECT p.doc_id, p.size, t.source_size, t.target, place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        (('0x' || substr(md5('0:' || coalesce(p.source, '')), 1, 3))::BIGINT::DOUBLE + 0.5) / 4096 AS off
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(place * rate + off) - floor((place - 1) * rate + off), 3)::BIGINT * size)::BIGINT AS taken FROM u
"""
