"""A small table with everything that may be odd about documents."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # Names that operators use themselves.
    *(T.StructField(c, T.StringType()) for c in ("size", "copies", "_value", "_mix_row", "text_hash", "node", "key", "kept", "score", "copy", "_batch")),
])
COLUMNS = SCHEMA.names


def rows():
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(200), prose(60)
    near = base.split()
    near[90] = "changed"
    texts = [
        None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper(), prose(50) + " " + passage + " " + prose(40), passage, prose(30) + "\n" + passage,
        "a " * 300, "x" * 5000, "é" * 120 + " ü😀 " * 40, prose(20_000), prose(34), prose(35), "idiot moron " + prose(30), "\0 nul " + prose(20), "mail joe@ex.com or +49 30 123456789 or 1.2.3.4 or 4111 1111 1111 1111",
    ]
    out = [(k, t, ("en", "de", None)[k % 3], ("a", "b", None, "c")[k % 4]) for k, t in enumerate(texts)]
    # Rows that repeat, an id with two texts, rows without an id.
    out += [out[5], out[5], (3, "another text", "en", "a"), (None, base, None, None), (None, "no id here", "fr", "b"), (None, None, None, None)]
    return [(*x, *("extra",) * (len(COLUMNS) - 4)) for x in out]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
