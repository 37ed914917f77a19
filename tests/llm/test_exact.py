"""Operators with exact results against brute force, odd rows included."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.comparing import duck, duck_rows, spark_rows
from tests.llm import odd
from tidelog.llm import decontamination, jpeg, mixing, near_dedup, pii, suffix_array, suffix_automaton
from tidelog.llm.components import components
from tidelog.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck(SF), ORACLES[name])


@pytest.mark.parametrize("module", [mixing, suffix_automaton, suffix_array, near_dedup, jpeg, pii])
def test_empty_tables(spark, module):
    assert module.digest(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"batch_bytes": 3000, "bucket_bytes": 2000}, {"batch_bytes": 1500, "bucket_bytes": 1500, "hot_batches": 1}])
def test_substring_dedup(spark, limits):
    want = [(r[0], *b) for r, b in zip(odd.rows(), suffix_automaton.brute([r[1] for r in odd.rows()]), strict=True)]
    got = suffix_automaton.dedup(odd.table(spark), **limits).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert listed(got) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("limits", [{}, {"batch_bytes": 3000, "bucket_bytes": 2000}, {"batch_bytes": 1500, "bucket_bytes": 1500, "hot_batches": 1}])
def test_suffix_array_dedup(spark, limits):
    ids = [(1 << 62 if r[0] is None else r[0], r[1]) for r in odd.rows()]
    want = [(r[0], *b) for r, b in zip(odd.rows(), suffix_array.brute(ids), strict=True)]
    got = suffix_array.dedup(odd.table(spark), **limits).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    assert listed(got) == sorted(want, key=str)


@pytest.mark.parametrize("with_null", [True, False])
def test_repeats_at_the_ends_of_the_ids(spark, with_null):
    passage = " ".join(f"p{k}" for k in range(60))
    ids = [(1 << 63) - 1, -(1 << 63), 1 << 62, *([None, None] if with_null else []), 0, (1 << 63) - 2]
    rows = [(d, f"a{k} b{k} {passage if k else passage + ' end'} c{k}") for k, d in enumerate(ids)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [(d, *b) for (d, _), b in zip(rows, suffix_automaton.brute([t for _, t in rows]), strict=True)]
    assert listed(suffix_automaton.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))) == sorted(words, key=str)
    last = [((1 << 63) if d is None else d, t) for d, t in rows]
    bytes_ = [(d, *b) for (d, _), b in zip(rows, suffix_array.brute(last), strict=True)]
    got = suffix_array.dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    assert listed(got) == sorted(bytes_, key=str) and sum(b[2] for b in bytes_) > 500


def test_suffix_order():
    r = np.random.default_rng(2)
    for _ in range(300):
        s = r.integers(0, r.integers(1, 5), r.integers(1, 50))
        order = suffix_array.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = suffix_array.common_prefixes(s.tolist(), order)
        for a, b, h in zip(order, order[1:], shared[1:], strict=False):
            assert s[a : a + h].tolist() == s[b : b + h].tolist() and s[a + h : a + h + 1].tolist() != s[b + h : b + h + 1].tolist()


@pytest.mark.parametrize("steps", [0, 3, 1000])
def test_suffix_order_in_steps(steps, monkeypatch):
    """Rows of rising symbols that end in 0, as a shard lays them out: by steps, by groups, by both."""
    monkeypatch.setattr(suffix_array, "STEPS", steps)
    r = np.random.default_rng(4)
    for _ in range(150):
        rows = [np.append(np.flatnonzero(r.random(9) < 0.7) * 3 + r.integers(1, 3), 0) for _ in range(r.integers(1, 12))]
        s = np.concatenate(rows + [r.integers(0, 2, r.integers(0, 6))])
        order = suffix_array.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix_array.suffix_array(np.zeros(0, np.int64)) == [] and suffix_array.common_prefixes([], []).tolist() == []


def test_automaton_counts():
    r = np.random.default_rng(3)
    texts = [[bytes([97 + x]) for x in r.integers(0, 3, 40)] for _ in range(4)]
    a = suffix_automaton.Automaton()
    for k, t in enumerate(texts):
        a.add(t, k + 1)
    a.close()
    count = Counter()
    for k, t in enumerate(texts):
        for i in range(len(t) - 4):
            count[tuple(t[i : i + 5])] += k + 1
    probe = [bytes([97 + x]) for x in r.integers(0, 3, 60)]
    assert a.matches(probe, 5) == [count[tuple(probe[i : i + 5])] for i in range(56)]


def brute_components(rows, words):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if a and b and (same_id or 100 * len(a & b) >= 80 * len(a | b)):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), low, doc == low))
    return out


def test_near_dedup(spark):
    rows = [(r[0], r[1]) for r in odd.rows()]
    assert listed(near_dedup.digest(odd.table(spark))) == sorted(brute_components(rows, 4), key=str)
    kept = near_dedup.dedup(odd.table(spark))
    assert kept.columns == odd.COLUMNS
    # One row of the big group, one of each pair of equal rows; texts without words all stay.
    assert [r.doc_id for r in kept.filter("text is not null").collect()].count(5) == 1 and not kept.filter("doc_id in (6, 7, 8)").count()


def test_near_dedup_of_odd_ids(spark):
    base = [f"w{k}" for k in range(100)]
    near = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in (30, 60)]
    twice = [" ".join([f"v{k}" for k in range(50)] + x) for x in ([], ["end"], ["stop"])]
    rows = [(None, " ".join(base)), (None, near[0]), (None, near[1]), (None, near[1])]
    rows += [(7, twice[0]), (7, twice[1]), (9, twice[2]), (8, "one"), (8, "other words")]
    rows += [(None, None), (None, None), (None, ""), (None, ""), (4, " "), (4, " ")]
    kept = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.doc_id is None and "w1 " in (r.text or "") for r in kept) == 1
    assert sorted(r.doc_id for r in kept if r.doc_id and (r.text or "").strip()) == [7, 8]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept if not (r.text or "").strip()) == sorted((str(d), str(t)) for d, t in rows[-6:])


def test_near_copies_around_a_base(spark):
    """Copies that are similar to their base but not to each other are one component."""
    r = np.random.default_rng(5)
    base = [f"b{k}" for k in r.integers(0, 10_000, 300)]
    rows = []
    for k in range(60):
        t = list(base)
        for at in r.choice(300, 5, replace=False):
            t[at] = f"n{k}_{at}"
        rows.append((k + 1, " ".join(t)))
    rows.append((1000, " ".join(base)))
    rows += [(2000 + k, " ".join(f"z{x}" for x in r.integers(0, 10_000, 80))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(near_dedup.digest(docs)) == sorted(brute_components(rows, 4), key=str)


@pytest.mark.parametrize(("small", "copy", "hot_share"), [(3, near_dedup.COPY, near_dedup.HOT_SHARE), (3, 4, 64), (near_dedup.SMALL, 4, 64)])
def test_large_buckets_are_split_exactly(spark, monkeypatch, small, copy, hot_share):
    """Families with substitutions, cuts and additions, and versions that follow one another; buckets
    that need several copies of their figures, and hot ones."""
    for name, value in (("COPY", copy), ("HOT_SHARE", hot_share), ("HOT_ROWS", 0 if copy < near_dedup.COPY else near_dedup.HOT_ROWS)):
        monkeypatch.setattr(near_dedup, name, value)
    r = np.random.default_rng(8)
    texts = []
    for f in range(3):
        base = [f"f{f}_{k}" for k in range(120)]
        for k in range(40):
            t = list(base)
            for at in r.choice(120, r.integers(0, 8), replace=False):
                t[at] = f"n{k}_{at}" if k % 3 else f"m{at % 4}"
            texts.append(t[r.integers(0, 12) : 120 - r.integers(0, 12)] + [f"e{k % 5}_{x}" for x in range(r.integers(0, 14))])
        for k in range(12):
            base = [*base[2:], *(f"v{f}_{k}_{x}" for x in range(r.integers(1, 5)))]
            texts.append(list(base))
    ids = [-(1 << 63), (1 << 63) - 1, 1 << 62, (1 << 62) + 10, (1 << 62) + 11, -1, 0, None]
    ids += [int(x) for x in r.integers(-(1 << 40), 1 << 40, len(texts) - len(ids))]
    rows = [(d, " ".join(t)) for d, t in zip(r.permutation(np.array(ids, object)).tolist(), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute_components(rows, 4), key=str)
    assert listed(near_dedup.digest(docs, small=small)) == want
    assert len({w[2] for w in want}) > 5


@pytest.mark.parametrize("at_once", [0, near_dedup.AT_ONCE])
def test_few_rows_of_split_buckets_go_without_exchanges(spark, monkeypatch, at_once):
    """Later rounds of few rows are not dealt out to as many tasks as there are shuffle partitions; with
    exchanges, hot buckets included, the result is the same."""
    monkeypatch.setattr(near_dedup, "AT_ONCE", at_once)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 0)
    r = np.random.default_rng(9)
    base, rows = [f"b{k}" for k in range(90)], []
    for k in range(40):
        t = list(base)
        for at in r.choice(90, r.integers(0, 7), replace=False):
            t[at] = f"m{at % 4}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    context, group, before = spark.sparkContext, f"few-{at_once}", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(group, group)
    try:
        found = listed(near_dedup.digest(docs, small=3))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sorted(brute_components(rows, 4), key=str)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(group)]
    stages = [context.statusTracker().getStageInfo(s) for s in sorted({s for j in jobs if j for s in j.stageIds})]
    tasks = sum(s.numTasks for s in stages if s and s.numCompletedTasks)
    assert not at_once or tasks < 1000


def test_odd_sketches_tell_similarity():
    r = np.random.default_rng(6)
    for shared, total in ((90, 100), (80, 100), (50, 100)):
        bits = []
        for _ in range(30):
            x = r.integers(0, 1 << 63, 3 * total, dtype=np.uint64)
            a, b = np.unique(x[: total + shared]), np.unique(x[total:][: total + shared])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = near_dedup.sketches(np.array([near_dedup.samples(a), near_dedup.samples(b)]))
            p = sum(int(v).bit_count() for v in (s[0] ^ s[1]).view(np.uint64))
            bits.append(1 + near_dedup.BITS / (4 * near_dedup.HASHES) * np.log(1 - 2 * p / near_dedup.BITS) - j)
        assert abs(np.mean(bits)) < 0.05


def test_sketches_miss_less_than_bands():
    """Exactly: samples that differ are binomial, and each flips two of the bits that tell."""
    differ, bits = np.zeros(near_dedup.HASHES + 1), np.zeros(near_dedup.BITS + 1)
    differ[0] = bits[0] = 1
    for _ in range(near_dedup.HASHES):
        differ[1:], differ[0] = 0.8 * differ[1:] + 0.2 * differ[:-1], 0.8 * differ[0]
    missed, odd_bits = 0.0, np.arange(near_dedup.BITS + 1) / near_dedup.BITS
    for share in differ:
        missed += share * bits[near_dedup.MOST_BITS + 1 :].sum()
        for _ in range(2):
            bits = np.append(0, (bits * (1 - odd_bits))[:-1]) + np.append((bits * odd_bits)[1:], 0)
    assert missed < (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS
    assert missed == pytest.approx(7.1e-8, rel=0.02)


def test_components(spark):
    edges = [(a, a + 1) for a in range(1, 60)] + [(100 + k, 100) for k in range(1, 30)] + [(7, 7), (500, 400), (400, 450)]
    out = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {(a, 1) for a in range(2, 61)} | {(100 + k, 100) for k in range(1, 30)} | {(500, 400), (450, 400)}


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_and_more_links(spark, monkeypatch, few):
    """By passes and in one task alike: components, then more links that join some of them."""
    from tidelog.llm import components as module
    from tidelog.llm.storage import Tables

    monkeypatch.setattr(module, "FEW", few)
    r = np.random.default_rng(3)
    one, two = (r.integers(-60, 60, (40, 2)).tolist() for _ in range(2))
    tables = Tables(spark)
    frame = lambda edges: spark.createDataFrame(edges, "u long, v long").repartition(3)
    graph = module.merged(components(frame(one), tables), frame(two), tables)
    want = module.least_reached(*np.array(one + two).T)
    assert {tuple(x) for x in graph.collect()} == set(zip(*(x.tolist() for x in want), strict=True))
    assert module.merged(graph, frame(two).filter("u > 1000"), tables) is graph
    tables.clear()


def test_few_links_take_few_stages(spark):
    stages = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    edges, before = spark.createDataFrame([(a, a + 1) for a in range(300)], "u long, v long").repartition(4), stages()
    assert components(edges).count() == 300 and stages() - before < 20


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.digest(docs).cache()
    assert out.filter("taken > 3 * size or taken % greatest(size, 1) <> 0").count() == 0
    by = docs.select("doc_id", "source").join(out, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max("size").alias("m"), F.first("source_size").alias("s"))
    for r in by.collect():
        assert abs(r.t - r.goal) <= 1.5 * r.m and r.goal <= 3 * r.s
    assert sum(r.goal for r in by.collect()) == pytest.approx(out.agg(F.sum("size")).first()[0])
    assert listed(out) == listed(mixing.digest(docs.repartition(7)))


def test_mixing_odd_rows(spark):
    docs = odd.table(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*odd.COLUMNS, "copy_"]
    planned = mixing.digest(docs)
    assert planned.count() == docs.count()
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert words == planned.agg(F.sum("taken")).first()[0]


def test_capped_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 989)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a and c are capped at 30 and 3; b and the last one share the rest by 2 to 1.
    assert got["a"] == 30 and got["c"] == 3 and got["b"] == pytest.approx(1967 * 2 / 3) and got[None] == pytest.approx(1967 / 3)


def test_media_round_trip(spark):
    docs = odd.table(spark)
    want = []
    for r in odd.rows():
        payload = jpeg.payload_of(r[1])
        want.append((r[0], len((r[1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = jpeg.digest(docs).cache()
    assert listed(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == sorted(want, key=str)
    assert got.groupBy("payload_sha256").agg(F.countDistinct("media_sha256", "feature").alias("n")).filter("n > 1").count() == 0
    stored = jpeg.media(docs.filter("doc_id = 14")).first()
    width, height, thumbnail = jpeg.decode([bytes(stored.media)])[0]
    assert (width, height) == (stored.width, stored.height) == (512, 8 * len(thumbnail) // 64) and thumbnail == bytes(stored.thumbnail)


def test_media_of_several_images():
    payload = bytes(range(256)) * (64 * (jpeg.ROWS + 3) // 256 + 1)
    payload = payload[: 64 * (jpeg.ROWS + 3)]
    media = jpeg.encode([payload])[0]
    assert media.count(b"\xff\xd8\xff\xe0") == 2 and jpeg.decode([media])[0] == (512, 8 * (jpeg.ROWS + 3), payload)
    with pytest.raises(ValueError):
        jpeg.decode([b"no image"])


@pytest.mark.parametrize(("width", "height", "colour"), [(64, 48, True), (100, 37, True), (8, 8, False), (33, 90, False)])
def test_files_of_another_encoder(spark, width, height, colour):
    """Java's encoder writes colour with halved chroma; its decoder's luminance is the truth."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if colour else 10)
    for x in range(width):
        for y in range(height):
            r, g, b = (x * 255 // width, y * 255 // height, (x + y) * 255 // (width + height)) if colour else [(x * 3 + y * 2) % 256] * 3
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    media = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media)).getData()
    got_width, got_height, thumbnail, digest, error = jpeg.read(media)
    assert (got_width, got_height, error) == (width, height, None) and len(digest) == 16
    shown = np.frombuffer(thumbnail, np.uint8).reshape(-(-height // 8), -(-width // 8))
    for bx in range(width // 8):
        for by in range(height // 8):
            pixels = np.array(back.getPixels(8 * bx, 8 * by, 8, 8, spark.sparkContext._gateway.new_array(jvm.int, 64 * (3 if colour else 1)))).reshape(64, -1)
            truth = (pixels @ [0.299, 0.587, 0.114]).mean() if colour else pixels.mean()
            assert abs(shown[by, bx] - truth) <= 3
    files = spark.createDataFrame([(1, bytearray(media), "x"), (2, None, "x"), (3, bytearray(b"GIF89a"), "x"), (4, bytearray(media[:-40]), "x"), (5, bytearray(), "x")], "id long, media binary, error string")
    rows = {r.id: r for r in jpeg.thumbnails(files).collect()}
    assert bytes(rows[1].thumbnail) == thumbnail and rows[2].error is None and all(rows[k].thumbnail is None and "not decoded" in rows[k].error for k in (3, 4, 5))


def test_decontamination_of_unspaced_scripts_and_marks(spark):
    items = [(1, "今天天气很好我们一起去公园散步吧"), (2, "यह एक छोटा सा परीक्षण वाक्य है"), (3, "สวัสดีครับผมชื่อสมชาย")]
    docs = [(1, "他说：今天天气很好，我们一起去公园散步吧！然后走了。"), (2, "उसने कहा यह एक छोटा सा परीक्षण वाक्य है और गया"), (3, "พูดว่าสวัสดีครับผมชื่อสมชายแล้วก็ไป"), (4, "天 今 好"), (5, "यह दूसरा वाक्य है")]
    got = decontamination.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    left = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [4, 5]
    assert decontamination.decontaminate(odd.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination(spark):
    r = np.random.default_rng(9)
    word = lambda: f"q{r.integers(0, 3000)}"
    items = [[word() for _ in range(n)] for n in (1, 3, 4, 5, 9, 14, 20, 31, 60)]
    docs = []
    for k in range(120):
        t = [word() for _ in range(int(r.integers(0, 60)))]
        item = list(items[k % len(items)])
        for _ in range(int(r.integers(0, len(item) // 4 + 1))):
            at = int(r.integers(0, len(item)))
            kind = r.integers(0, 3)
            if kind == 0:
                item[at] = word()
            elif kind == 1 and len(item) > 1:
                del item[at]
            else:
                item.insert(at, word())
        at = int(r.integers(0, len(t) + 1))
        docs.append((k, " ".join(t[:at] + item + t[at:])))
    b = [(k, " ".join(i)) for k, i in enumerate(items)]
    bench = spark.createDataFrame([*b, (90, None), (91, " ... ")], "item_id long, text string")
    shouted = spark.createDataFrame([(k, t.upper().replace(" ", ", ")) for k, t in docs], "doc_id long, text string")
    want = decontamination.brute(docs, b)
    assert {tuple(x) for x in decontamination.digest(shouted, bench).collect()} == want and len(want) > 60
    # Blocks of items give the same.
    small = decontamination.found(shouted, bench, block_bytes=100).select("doc_id", "item_id", "distance", "budget")
    assert {tuple(x) for x in small.collect()} == want
    clean = decontamination.decontaminate(shouted, bench, block_bytes=200)
    assert {r.doc_id for r in clean.collect()} == set(range(120)) - {d for d, *_ in want}


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(None, "two words"), (1, "no id here")], "item_id long, text string")
    got = listed(decontamination.digest(odd.table(spark), bench))
    assert got == sorted([(4, None, 0, 0), (None, 1, 0, 0)], key=str)
    assert decontamination.decontaminate(odd.table(spark), bench).columns == odd.COLUMNS
    assert decontamination.decontaminate(odd.table(spark), bench.limit(0)).count() == len(odd.rows())
    assert decontamination.digest(odd.empty(spark), bench).count() == 0


def test_myers_distance():
    r = np.random.default_rng(4)
    for _ in range(300):
        p, t = r.integers(0, 3, r.integers(1, 90)).tolist(), r.integers(0, 3, r.integers(1, 120)).tolist()
        row = [0] * (len(t) + 1)
        for k, x in enumerate(p):
            new = [k + 1]
            for j, w in enumerate(t):
                new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontamination.myers(p, t, 200)[0] == min(row[1:])


TEXTS = [
    "", "a@b.c", "x@@a.b", "a.b@c.d@e.f.g", "@a.b", "a@b", "a@-.-.", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1111",
    "+1 (555) 123-4567", "++49 30 1234567..", "+1+2+3456789012", "a" * 2000 + "@b.co", "mail " + "a" * 600 + "@b.co x@y.zz@q.rr.ss", "1." * 3000, "1..2.3.4.5", "12.3.4.5.6.7.8.9.10",
]


def test_personal_data_base(spark):
    texts = [r[0] for r in duck("/root/testdata/sf0.01").sql("select text from documents").fetchall()] + TEXTS
    for t in texts:
        sure, _ = pii.spans_of(t, pii.fitted(np.zeros((0, 1)), np.zeros(0, int), np.zeros((0, 3, 1))))
        kinds = [k for *_, k in sure]
        assert (*(kinds.count(k) for k in range(4)), hashlib.sha256(pii.joined(sure).encode()).hexdigest()) == pii.brute(t)
    got = {r.doc_id: r for r in pii.digest(odd.table(spark)).collect() if r.doc_id is not None}
    assert (got[20].n_email, got[20].n_ip, got[20].n_card, got[20].n_phone) == (1, 1, 1, 1) and got[0].spans == ""


def test_personal_data_consistency():
    weights = pii.fitted(np.zeros((0, 1)), np.zeros(0, int), np.zeros((0, 3, 1)))
    spans = pii.spans_of("Call +1 555 123 4567 now. Later: 1 555 123 4567 again, but not 9 555 123 4567.", weights)[1]
    assert [(k, a) for a, _, k in spans] == [(3, 5), (3, 33)]
    assert pii.masked("me@x.org and ME@X.ORG", weights) == "<email> and <email>"


def test_personal_data_sample(spark):
    mails = " ".join(f"joe{k}@ex.com" for k in range(70))
    cards = " , ".join(["4111 1111 1111 1111"] * 70)
    one = spark.createDataFrame([(mails + " " + cards,)], "text string")
    # What stands behind the first candidates is learned too.
    assert pii.fit(one).nodes[pii._N_FEATURES - 3, 2] > 0
    texts = [(f"call {k} +49 30 {1234567 + k} or 10.0.0.{k} or a{k}@ex.com",) for k in range(200)]
    plain, copied = (spark.createDataFrame(rows, "text string").repartition(n) for rows, n in ((texts, 3), (texts + texts[:1] * 2000 + texts[1:9] * 50, 5)))
    a, b = pii.fit(plain, 40), pii.fit(copied, 40)
    assert np.array_equal(a.nodes, b.nodes) and np.array_equal(a.edges, b.edges)


def test_the_field_adds_spans(spark):
    """Planted variants that no base pattern matches; what edges add goes with the edges."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    assert field.edges[pii.SAME] > 1
    hidden = {
        "email": "mail die.34@mail7.example.com or die.34 @ mail7.example.com", "ip": "host 10.20.30.40 or 10.20 .30.40",
        "phone": "Call +1 (555) 123-4567 now. Later 1 (555) 123-4567", "secret": 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and',
        "card": "Card 4111 1111 1111 1111 and 4111.1111.1111.1111",
    }
    added = {}
    for kind, text in hidden.items():
        sure, every = pii.spans_of(text, field)
        added[kind] = [pii.KINDS[k] for a, b, k in every if (a, b, k) not in sure]
    assert sum(kind in found for kind, found in added.items()) >= 4 and "card" in added["card"]
    # Precision on texts with nothing to find.
    clean = ["the value 5555-123-4567 is", "version 1.2.3.4.5.6 and 1 000 000 000 000", "a" * 60, "x-" * 40, "see http-tables-and-other-long-words-here", "9807 9157"]
    assert [pii.spans_of(t, field)[1] for t in clean] == [[(8, 15, 1)] if "1.2.3.4" in t else [] for t in clean]
    alone = pii.Field(field.nodes, np.zeros(3))
    assert pii.spans_of(hidden["card"], alone)[0] == pii.spans_of(hidden["card"], alone)[1]
    out = pii.find(docs, field).agg(F.sum("n_secret").alias("s"), F.sum("n_spans").alias("n"), F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")).alias("b")).first()
    secrets = docs.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1)))).alias("s")).first().s
    assert out.s >= secrets > 5 and out.n >= out.b + out.s


def test_long_texts_are_linear():
    weights = pii.fitted(np.zeros((0, 1)), np.zeros(0, int), np.zeros((0, 3, 1)))
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000):
        pii.spans_of(t, weights)
