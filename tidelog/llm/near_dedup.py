"""Near-duplicate documents: MinHash bands, odd sketches, full sets, components.

A document's set has the distinct `WORDS`-word shingles of its text, A-Z lowered (all its words as
one if there are fewer). Two documents are linked if 100 x intersection >= 80 x union.

1. Each document gets `HASHES` MinHash samples. Bands of some are bucket keys; all samples are folded
   into an odd sketch: each flips one bit of a bitmap, so the bits in which two bitmaps differ tell
   how many samples do. At a similarity of 0.8 a pair shares none of 30 bands of 4 with probability
   1.4e-7, and has more than `MOST_BITS` differing bits with 7.1e-8 (4.4e-9 at 0.81); at 0.7 one pair
   in seven has more.
2. Documents with equal sets are one node from here on.
3. Each bucket has a centre: its node that shares the most buckets with the most others. Every node
   is compared with the centres of its buckets, by sketch and then on the full sets.
4. Buckets of at most `SMALL` nodes whose nodes are in different components by now: pairs of different
   components whose sketches allow it are verified.
5. Larger ones are split, and the parts go through 3 to 5 again. Let c be the centre and x a node of
   another component, so not linked with c. If z is linked with x, then either x and z share a
   shingle that c lacks, and at least as many of those as x's similarity with c falls short; or
   |z| <= 9/4 |x & c| - |x| < |c|, for 9 |x & z| >= 4 (|x| + |z|) and |x & z| <= |x & c|. So the parts
   are, for each shingle among x's rarest ones beyond c, the nodes that have it; and the nodes small
   enough for some such x, with those x. No link is lost, the centre is in no part, and a group whose
   members differ from it each in its own way falls into parts of one.

Every step is linear in a bucket's nodes: in 4 a node meets fewer than `SMALL` others of a bucket
(twice as many at each further level). Nothing gathers a bucket in one task: buckets are aggregates
and joins, and what all rows of a bucket need (its centre's text, sketch and root) goes to as many
partitions as they fill. They learn how many they are where they lie if they are more than a
`HOT_SHARE`th of all rows; no more than `HOT_SHARE` buckets can be that large. Only tables of at most
`AT_ONCE` rows of numbers, whatever the corpus, are taken by one task or broadcast: dealing them out costs
more than the work. Texts are compared in parallel always.

Defined results: a text without words is empty and linked with nothing; rows with one doc_id count as
one document for links; ids may be any 64-bit numbers. A null doc_id is no one's component_id: the
component of null ids alone is null and `digest` keeps its rows. `dedup` leaves one row of every
component, by doc_id and text hash, whatever the ids; of texts without words it leaves every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column, fresh, sliced
from tidelog.llm.components import components, merged, rooted
from tidelog.llm.storage import Tables

WORDS = 4
BANDS, ROWS = 30, 4
#: MinHash samples: the bands take the first ones, the sketches all.
HASHES = 480
BITS = 1024
MOST_BITS = 235
PERCENT = 80
#: Nodes of a bucket that may meet in pairs; larger buckets are split.
SMALL = 128
#: Pairs with one centre that share a copy of its text, rows of one bucket that share a copy of its figures.
COPY = 256
#: A bucket with more than its share of all rows, `1 / HOT_SHARE` of them, is a hot one.
HOT_SHARE = 1024
HOT_ROWS = 1000
#: Rows of some 64-bit numbers that one task may take at once, and pairs that it may look at; more go by
#: exchanges. What one task holds needs no exchange to be grouped or joined.
AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 24

_random = np.random.default_rng(7_062_024)
_FLIP = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_SIGNED = "doc_id long, n long, s1 long, s2 long, text_hash long, bands array<long>, sketch array<long>"


def shingles(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    for numbers in hashing.groups([len(r) for r in raw]):
        buffer = np.frombuffer(b"\n".join(raw[k] for k in numbers), np.uint8)
        values, starts, _ = hashing.word_hashes(buffer, lower=True)
        bound = np.searchsorted(starts, np.cumsum([len(raw[k]) + 1 for k in numbers])).tolist()
        grams = hashing.grams(values, words)
        a = 0
        for b in bound:
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield hashing.grams(values[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
            a = b


def samples(shingle_set: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1 << 14):
        part = (x[None, a : a + (1 << 14)] ^ _FLIP[:, None]) * _ODD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def sketches(mins: np.ndarray) -> np.ndarray:
    """The odd sketches of rows of samples, as 64-bit words."""
    bit = (hashing.mixed(mins.astype(np.uint64) + _SALT[None, :]) % np.uint64(BITS)).astype(np.int64)
    flat = (bit + BITS * np.arange(len(bit))[:, None]).ravel()
    parity = (np.bincount(flat, minlength=BITS * len(bit)) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(-1, BITS), axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = list(shingles(batch.column(1).to_pylist(), words))
        n = np.array([len(s) for s in sets], np.int64)
        # The last row is no document's: it keeps the arrays from being empty.
        mins = np.array([samples(s) for s in sets if len(s)] + [np.zeros(HASHES, np.uint32)])
        band = mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS).astype(np.uint64) + _SALT[: BANDS * ROWS].reshape(BANDS, ROWS)[None]
        bands = hashing.mixed(hashing.mixed(band).sum(axis=2, dtype=np.uint64)).view(np.int64)
        odd = sketches(mins)
        at = np.where(n > 0, np.cumsum(n > 0) - 1, len(mins) - 1)
        s1 = np.array([int(hashing.mixed(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
        s2 = np.array([int(np.bitwise_xor.reduce(hashing.mixed(s ^ np.uint64(0x5BF0_3635)))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(n), pa.array(s1), pa.array(s2), batch.column(2), pa.array(list(bands[at]), pa.list_(pa.int64())), pa.array(list(odd[at]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "text_hash", "bands", "sketch"])


def _apart() -> Column:
    """In how many bits the sketches `sketch` and `other` differ."""
    bits = [F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("other")[k])) for k in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def _tasks(rows: int, share: int) -> int:
    """The most tasks that `rows` rows are worth: one for each `share` of them, and a few."""
    return 16 + rows // share


def _near(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most `rows` rows, in one task if they are few."""
    return df.coalesce(1) if rows <= AT_ONCE else df


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most `rows` rows, sent to where the other side of its join lies if they are few."""
    return F.broadcast(df) if rows <= AT_ONCE else df


def _compared(pairs: DataFrame, texts: DataFrame, words: int, count: int) -> DataFrame:
    """`count` pairs (u, v, size, more) of nodes, v the one that up to `size` others have too -> (u, v, nu, nv,
    both, extra): the sizes of their sets and of the intersection, and with `more` the shingles that
    u has and v lacks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            us, vs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            held = dict.fromkeys([*us, *vs])
            for t, s in zip(held, shingles(list(held), words), strict=True):
                held[t] = s
            rows = [(held[a], held[b]) for a, b in zip(us, vs, strict=True)]
            beyond = [np.setdiff1d(x, y, assume_unique=True) if more else None for (x, y), more in zip(rows, batch.column(2).to_pylist(), strict=True)]
            both = [len(np.intersect1d(x, y, assume_unique=True)) if d is None else len(x) - len(d) for (x, y), d in zip(rows, beyond, strict=True)]
            extra = pa.array([None if d is None else d.view(np.int64) for d in beyond], pa.list_(pa.int64()))
            sizes = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(both, pa.int64()), extra], ["u", "v", "nu", "nv", "both", "extra"])

    copies = _near(pairs, count).withColumn("copies", 1 + F.floor(F.col("size") / COPY).cast("int")).withColumn("salt", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int"))
    # Only the texts of these nodes are moved; a centre's text goes to each of its salts.
    first = texts.select(F.col("node").alias("u"), F.col("text").alias("a")).join(_sent(copies, count), "u")
    salts = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    centres = copies.groupBy("v").agg(F.max("copies").alias("copies"))
    second = texts.select(F.col("node").alias("v"), F.col("text").alias("b")).join(_sent(centres, count), "v").select("v", salts, "b")
    met = first.join(second, ["v", "salt"]).select("u", "v", "more", "a", "b").coalesce(_tasks(count, 1024))
    return met.mapInArrow(of, "u long, v long, nu long, nv long, both long, extra array<long>")


def _similar() -> Column:
    return 100 * F.col("both") >= PERCENT * (F.col("nu") + F.col("nv") - F.col("both"))


def labelled(docs: DataFrame, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row of `docs`."""
    found = _rooted(docs, words, small)
    held = found.filter("n > 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root")
    least = held.groupBy("root").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"))
    # Of components with more than a 128th of all rows there are at most 128.
    rows = docs.count()
    limit = 1000 + rows // 128
    large = F.broadcast(least.filter(F.col("size") > limit).select("root", F.struct("id").alias("found")))
    there = held.join(large, "root", "left")
    rest = there.filter("found is null").join(least.filter(F.col("size") <= limit).select("root", F.col("id").alias("component_id")), "root")
    columns = ["doc_id", "text_hash", "n_shingles"]
    some = there.filter("found is not null").select(*columns, F.col("found.id").alias("component_id")).unionByName(rest.select(*columns, "component_id"))
    alone = found.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(alone).coalesce(_tasks(rows, 4096))


def _rooted(docs: DataFrame, words: int, small: int) -> DataFrame:
    """(doc_id, text_hash, n, root) for each row of `docs`; rows of one component have one root."""
    tables = Tables(docs.sparkSession)
    read = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    signed = tables.store(read.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lambda batches: _signed(batches, words), _SIGNED))
    some = signed.filter("n > 0")
    tasks = _tasks(tables.count(signed), 4096)
    # The number of a class is any; it is written before it is used.
    grouped = some.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = tables.store(grouped.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "row.doc_id", "row.text_hash", "bands", "sketch"), tasks)
    held = some.select("doc_id", "text_hash", "n", "s1", "s2").join(classes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"])
    work = Tables(docs.sparkSession)
    graph = _graph(classes, read, _same_id(held), words, small, work)
    placed = rooted(held, "node", graph, work)
    some = placed.select("doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root"))
    out = tables.store(some.unionByName(signed.filter("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"))), tasks)
    work.clear()
    tables.clear(out)
    return out


def _same_id(held: DataFrame) -> DataFrame:
    """Links between the classes that rows of one id are in; none where ids are unique."""
    several = held.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last")
    return held.join(several, "doc_id").select(F.col("node").alias("u"), "v").distinct()


def _graph(classes: DataFrame, read: DataFrame, links: DataFrame, words: int, small: int, tables: Tables) -> DataFrame:
    """The components of the classes, as `components` gives them, from `links` and all similar pairs."""
    banded = classes.select("node", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    total = tables.count(classes)
    buckets = tables.store(_sized(banded, sizes, BANDS * total), _tasks(BANDS * total, 1 << 16))
    rows = tables.count(buckets)
    weights = _near(buckets, rows).groupBy("node").agg(F.sum("size").alias("weight"))
    nodes = tables.store(classes.select("node", "n", "s1", "sketch", "doc_id", "text_hash").join(_sent(weights, rows), "node"), _tasks(total, 4096))
    held = tables.count(nodes)
    same_row = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    all_texts = read.select(F.col("doc_id").alias("id_"), "text", F.xxhash64("text").alias("hash_"))
    found = all_texts.join(_sent(nodes.select("node", F.col("doc_id").alias("id"), "text_hash"), held), same_row)
    # Equal rows have one text; any of them will do.
    one = F.row_number().over(Window.partitionBy("id_", "hash_").orderBy("node"))
    texts = tables.store(found.withColumn("one", one).filter("one = 1").select("node", "text"), _tasks(held, 1024))
    nodes = nodes.select("node", "weight", "n", "s1", "sketch")
    graph = components(links, tables)

    while True:
        rows = tables.count(buckets)
        placed = tables.store(_centred(buckets, nodes, rows))
        asked = _near(placed, rows).filter(F.col("node") != F.col("c")).filter((F.col("apart") <= MOST_BITS) | (F.col("size") > small))
        pairs = tables.store(asked.groupBy(F.col("node").alias("u"), F.col("c").alias("v")).agg(F.max("size").alias("size"), (F.max("size") > small).alias("more")))
        compared = tables.store(_compared(pairs, texts, words, tables.count(pairs)))
        graph = merged(graph, compared.filter(_similar()), tables)
        mixed = tables.store(_mixed(rooted(_near(placed, rows), "node", graph, tables)))
        rows = tables.count(mixed)
        if not rows:
            return graph
        few = _near(mixed.filter(F.col("size") <= small), rows).join(_near(nodes, held), "node")
        pairs = tables.store(_across(few if rows * small <= PAIRS_AT_ONCE else mixed.filter(F.col("size") <= small).join(nodes, "node")))
        if tables.count(pairs):
            graph = merged(graph, _compared(pairs, texts, words, tables.count(pairs)).filter(_similar()), tables)
        large = mixed.filter(F.col("size") > small)
        if large.isEmpty():
            return graph
        split = tables.store(_split(large, compared, rows))
        # What follows goes by the shingles beyond the centres.
        rows = tables.count(split) + (split.agg(F.sum(F.size("extra"))).first()[0] or 0)
        split = _near(split, rows)
        alive = _near(tables.store(_beyond(split)), rows)
        parts = tables.store(_parts(alive, split))
        total = tables.count(parts)
        parts = _near(parts, total)
        buckets = tables.store(_sized(parts, _several(parts), total))
        if not tables.count(buckets):
            return graph
        small *= 2


def _sized(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """The rows (key, node, size) of the `total` ones of `rows` whose keys are in `sizes` (key, size)."""
    limit = HOT_ROWS + total // HOT_SHARE
    if total <= max(limit, AT_ONCE):
        return rows.join(sizes, "key").select("key", "node", "size")
    hot = F.broadcast(sizes.filter(F.col("size") > limit).withColumnRenamed("size", "hot_size"))
    there = rows.join(hot, "key", "left")
    rest = there.filter("hot_size is null").join(sizes.filter(F.col("size") <= limit), "key")
    return there.filter("hot_size is not null").select("key", "node", F.col("hot_size").alias("size")).unionByName(rest.select("key", "node", "size"))


def _told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """`rows` (key, node, size, ...) with what `facts` (key, size, ...) has of their keys."""
    copies = 1 + F.floor(F.col("size") / COPY).cast("int")
    salts = F.explode(F.sequence(F.lit(0), copies - 1))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int"))
    return salted.join(facts.withColumn("salt", salts).drop("size"), ["key", "salt"]).drop("salt")


def _centred(buckets: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(key, node, size, n, c, apart): each of the `count` rows of buckets, its centre, and how far their sketches differ."""
    rows = _near(nodes.join(_sent(buckets, count), "node"), count)
    best = F.max_by(F.struct("node", "sketch"), F.struct("weight", "s1", "node"))
    centres = rows.groupBy("key").agg(best.alias("best"), F.max("size").alias("size"))
    centres = centres.select("key", "size", F.col("best.node").alias("c"), F.col("best.sketch").alias("other"))
    return _told(rows, centres).select("key", "node", "size", "n", "c", _apart().alias("apart"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows but centres of buckets that have other components than one beside the centre, with
    their `root`, null where a node is its own, and whether it isn't the centre's (`stray`)."""
    rooted = placed.withColumn("root", F.coalesce("root", "node"))
    centre = F.col("node") == F.col("c")
    roots = [f(F.when(~centre, F.col("root"))).alias(name) for f, name in ((F.min, "least"), (F.max, "most"))]
    of_centre = F.max(F.when(centre, F.col("root"))).alias("c_root")
    several = rooted.groupBy("key").agg(*roots, of_centre, F.max("size").alias("size")).filter("least < most").select("key", "size", "c_root")
    return _told(rooted.filter(~centre), several).select("key", "node", "size", "n", "c", "root", (F.col("root") != F.col("c_root")).alias("stray"))


def _across(few: DataFrame) -> DataFrame:
    """The pairs of different components in buckets of bounded size, as far as their sketches allow."""
    one = few.select("key", F.col("node").alias("u"), F.col("root").alias("u_root"), "sketch")
    two = few.select("key", F.col("node").alias("v"), F.col("root").alias("v_root"), F.col("sketch").alias("other"))
    met = one.join(two, "key").filter((F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & (_apart() <= MOST_BITS))
    return met.select("u", "v").distinct().select("u", "v", F.lit(1).alias("size"), F.lit(False).alias("more"))


def _split(large: DataFrame, compared: DataFrame, count: int) -> DataFrame:
    """Each node of large buckets with its centre, and how they compare: (c, node, root, stray, nu, both, extra, lo)."""
    large = _near(large, count)
    of = large.select("c", "node", "root", "stray").distinct().join(large.groupBy("c").agg(F.min("n").alias("lo")), "c")
    return compared.withColumnsRenamed({"u": "node", "v": "c"}).join(_sent(of, count), ["c", "node"])


def _beyond(split: DataFrame) -> DataFrame:
    """(c, s, node, root, chosen): each shingle s beyond the centre that nodes of several components
    have; `chosen` where it is one of those by which a stray must be found.

    A stray has to share `t` of its extra shingles with whatever it is linked with, so all but t - 1
    of them will do; those that no other component has come first, then the rarest."""
    # What is linked has 0.8 of the stray's shingles at least.
    low = F.greatest("lo", F.ceil(F.col("nu") * 4 / 5))
    t = F.greatest(F.lit(1), F.ceil((4 * (F.col("nu") + low) - 9 * F.col("both")) / 9))
    spread = split.select("c", "node", "root", "stray", F.size("extra").alias("extras"), (F.size("extra") - t + 1).alias("enough"), F.explode("extra").alias("s"))
    held = spread.groupBy("c", "s").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("c", "s", "held")
    alive = spread.join(held, ["c", "s"])
    own = Window.partitionBy("c", "node")
    rank = F.row_number().over(own.orderBy("held", "s"))
    dead = F.col("extras") - F.count(F.lit(1)).over(own)
    return alive.select("c", "s", "node", "root", (F.col("stray") & (rank <= F.col("enough") - dead)).alias("chosen"))


def _parts(alive: DataFrame, split: DataFrame) -> DataFrame:
    """The nodes (key, node, root) of the buckets that large ones fall into."""
    chosen = alive.filter("chosen").select("c", "s").distinct()
    shared = alive.select("c", "s", "node", "root").join(chosen, ["c", "s"]).select(F.xxhash64("c", "s").alias("key"), "node", "root")
    most = F.when(F.col("stray"), F.floor(9 * F.col("both") / 4) - F.col("nu"))
    sized = split.select("c", "node", "root", "nu", most.alias("most"))
    limits = sized.groupBy("c").agg(F.min("nu").alias("lo"), F.max("most").alias("hi")).filter("lo <= hi")
    small = sized.join(limits, "c").filter("nu <= hi or most >= lo").select(F.xxhash64("c", F.lit("small")).alias("key"), "node", "root")
    return shared.unionByName(small).distinct()


def _several(parts: DataFrame) -> DataFrame:
    """(key, size) of the buckets with nodes of several components."""
    return parts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key", "size")


def digest(docs: DataFrame, words: int = WORDS, small: int = SMALL) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return labelled(docs, words, small).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def dedup(docs: DataFrame, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """The rows of `docs` without near-duplicates: one row of each component, all rows without words."""
    key, text, part, one = (fresh(docs, n) for n in ("_n_id", "_n_hash", "_n_part", "_n_one"))
    found = _rooted(docs, words, small)
    # A null id is a component's row only where it has no other.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("least")
    some = found.filter("n > 0").groupBy("root").agg(least).select("least.doc_id", "least.text_hash", F.lit(False).alias("_k_empty"))
    stay = some.unionByName(found.filter("n = 0").select("doc_id", "text_hash", F.lit(True).alias("_k_empty")).distinct()).withColumnsRenamed({"doc_id": "_k_id", "text_hash": "_k_hash"})
    keyed = docs.withColumns({key: column(docs, "doc_id", "long"), text: F.xxhash64(column(docs, "text", "string"))})
    left = keyed.join(stay, F.col(key).eqNullSafe(F.col("_k_id")) & (F.col(text) == F.col("_k_hash")))
    # Equal rows become one; rows without words are each a part of their own.
    parts = left.withColumn(part, F.when(F.col("_k_empty"), F.monotonically_increasing_id()))
    first = parts.withColumn(one, F.row_number().over(Window.partitionBy(key, text, part).orderBy(F.lit(0))))
    return first.filter(F.col(one) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON c.doc_id = l.x),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
