"""Column helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def column(docs: DataFrame, name: str, kind: str) -> Column:
    """`name` of `docs` as `kind`, typed null where the table has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in docs.columns else F.lit(None).cast(kind)


def held_out(modulus: int, remainder: int, doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == remainder, F.lit(False))


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that `docs` does not use."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Rows that are Python objects at once.
SLICE = 500


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches in slices: a batch's texts are never all unpacked at once."""
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            yield b.slice(a, SLICE)


def filtered(docs: DataFrame, value: Column, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of `docs` that `keep` says so of, by their `value`; no shuffle, all columns stay."""
    name = fresh(docs, "_value")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            mask = keep(b.column(b.num_columns - 1).to_pylist())
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(mask, pa.bool_()))

    return docs.withColumn(name, value).mapInArrow(of, docs.schema)


def replaced_text(docs: DataFrame, change: Callable[[list], list]) -> DataFrame:
    """`docs` with `change` applied to its text column; all others stay."""
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text = pa.array(change(b.column(at).to_pylist()), b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(of, docs.schema)
