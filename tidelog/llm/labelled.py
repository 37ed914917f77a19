"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import column


def sample_of(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, label) of about `bound` labelled rows, drawn by hash of the id.

    `labels` has doc_id (long) and label (int); null labels and ids are left out. The sample is cut
    before the join, so that it costs one pass over the documents and no shuffle of texts.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    total = known.count()
    share = min(1 << 20, (1 << 20) * bound // max(total, 1) + 1)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).limit(2 * bound)
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    # At most 2 x `bound` rows of 12 bytes: a size that does not grow with the tables.
    return texts.join(F.broadcast(drawn.select("doc_id", "label")), "doc_id").select("doc_id", "text", "label")
