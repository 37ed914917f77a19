"""Held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tidelog.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def share_right(out, truth, column):
    joined = out.filter("held_out").join(truth.select("doc_id", column), "doc_id")
    return joined.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_language(docs):
    out = language_id.digest(docs)
    right = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and out.count() == docs.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_odd_rows(spark):
    out = {r.doc_id: r for r in language_id.digest(odd.table(spark)).collect() if r.doc_id is not None}
    assert [out[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and out[5].lang_pred in ("en", "de", "fr")
    assert language_id.digest(odd.empty(spark)).count() == 0


def test_every_language_is_learned(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = {f"x{k:03}": " ".join(word() for _ in range(8)) for k in range(170)}
    # The last twenty are rare; one of the common ones has nothing but equal rows without an id.
    rows = [(None if k == 0 else 1000 * k + j, texts[x], x) for k, x in enumerate(texts) for j in range(1 if k >= 150 else 60 if k else 3000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.languages == sorted(texts)
    assert [p[0] for p in model.predict(list(texts.values()))] == list(texts)
    # All rows count for the idf: the blank is in each.
    assert model.idf.min() == 1


def test_toxicity(docs, labels):
    out = toxicity.digest(docs, labels)
    assert share_right(out, labels, "toxic") > 0.93 and out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxic_words_are_found_and_clean_texts_left(spark, docs, labels):
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    scores = model.scores(["you idiot are a moron and scum", "a calm sentence about rivers and hills", None, ""])
    assert scores[0] > 0.9 and max(scores[1:]) < 0.3


def test_insults_of_the_corpus_are_learned(spark):
    """Words of no list, in a language of no list, told by how they begin; endings that no label has seen too."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(("ba", "ke", "lo", "mi", "nu", "sor", "té")) for _ in range(r.randint(2, 4)))
    rows = []
    for k in range(1200):
        toxic, words = int(k % 8 == 0), [word() for _ in range(60)]
        for at in r.sample(range(60), 3 if toxic else 0):
            words[at] = r.choice(("zorbé", "vuxe")) + (word() if k < 1000 else "zz" + word())
        rows.append((k, " ".join(words), toxic))
    # Copies of a clean text with one word that only it has: copies count once, so the word tells nothing.
    rows += [(2000 + k, "qwertz " + rows[1][1], 1) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = toxicity.fit(table, table.filter("doc_id < 1000 or doc_id >= 2000").selectExpr("doc_id", "toxic as label"))
    new = rows[1000:1200]
    assert [int(s >= 0.5) for s in model.scores([t for _, t, _ in new])] == [y for _, _, y in new]
    assert sum(len(keys) for keys, _ in model.voters.stems.values()) == 2
    again = toxicity.fit(table.repartition(3), table.filter("doc_id < 1000 or doc_id >= 2000").selectExpr("doc_id", "toxic as label"))
    assert np.allclose(again.weights, model.weights)


def test_label_model_reads_votes_not_labels(spark, docs, labels):
    """Labels that are wrong in three of ten rows change nothing much; voters that repeat one count once."""
    known = toxicity.training_labels(labels).withColumn("label", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 3, 1 - F.col("label")).otherwise(F.col("label")))
    model = toxicity.fit(docs, known)
    rows = docs.join(labels.filter("toxic is not null"), "doc_id").select("text", "toxic").collect()
    truth = np.array([r.toxic for r in rows])
    assert ((model.scores([r.text for r in rows]) >= 0.5) == truth).mean() > 0.93

    r = np.random.default_rng(1)
    y = r.random(3000) < 0.3
    say = lambda p, q: np.where(r.random(3000) < np.where(y, p, q), 1, -1)
    good, bad = [say(0.85, 0.15) for _ in range(4)], say(0.5, 0.45)
    # Eight echoes of one poor voter: counted as independent they would outvote the others.
    votes = np.stack([*good, *[np.where(r.random(3000) < 0.97, bad, -bad) for _ in range(8)]], axis=1).astype(np.int8)
    found = toxicity.LabelModel(votes, 1, np.ones(3000), 0.3)
    assert ((found.posterior > 0.5) == y).mean() > 0.9
    assert sum(j > 3 and p > 3 for j, p in found.tree) == 7


def test_quality(docs, labels):
    out = quality.digest(docs, labels)
    assert share_right(out, labels, "quality") > 0.92


def test_quality_comes_from_the_vectors(docs, labels):
    """With the word vectors of no word the length is left, and says next to nothing."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("label is not null")
    model = quality.fit(docs, known.filter(F.pmod("doc_id", F.lit(3)) != 0))
    rows = docs.join(known.filter(F.pmod("doc_id", F.lit(3)) == 0), "doc_id").select("text", "label").collect()
    truth = np.array([r.label for r in rows])

    def above(scores):
        good, bad = scores[truth == 1], scores[truth == 0]
        return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2

    assert above(model.scores([r.text for r in rows])) > 0.85
    model.table = np.zeros_like(model.table)
    assert above(model.scores([r.text for r in rows])) < 0.75


def test_words_that_share_a_row_read_another():
    words = [f"w{k}" for k in range(40_000)]
    values = quality._hashed([" ".join(words).encode()], [0])[0]
    one, two = quality._rows(values)
    often = np.bincount(one, minlength=quality.WORDS) + np.bincount(two, minlength=quality.WORDS)
    assert len(values) == 40_000 and (np.minimum(often[one], often[two]) < often[one]).mean() > 0.3
    assert quality._hashed([b"of%%% the!! end", b"", b"a"], [0, 1, 2])[1].tolist() == [0, 0, 0, 0, 0, 2]


def test_sums_meet_in_levels(spark, docs, labels):
    known = labels.select("doc_id", F.col("quality").alias("label")).limit(0)
    texts = [(r.text or "").encode() for r in docs.select("text").collect()]
    sums, often = quality.contexts(texts)
    assert (quality.fit(docs.repartition(9), known).often == often).all()
    assert np.allclose(quality.fit(docs.repartition(9), known).table, quality.Model(sums, often).table)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 0), (7, None, None), (18, 0, 1), (None, 1, 1), (999, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (empty, some):
        out = module.digest(odd.table(spark), known)
        assert out.count() == len(odd.rows()) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert module.digest(odd.empty(spark), some).count() == 0


def test_samples_are_bounded(spark, docs, labels):
    from tidelog.llm.labelled import sample_of

    known = labels.select("doc_id", F.col("toxic").alias("label"))
    assert 20 < sample_of(docs, known, 60).count() <= 120
