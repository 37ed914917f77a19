"""The pipeline's stages, each against its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tests.llm.test_exact import brute_components
from tidelog.llm import decontamination, mixing, pii

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").limit(400), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        out.append((docs, spark.read.parquet(str(folder / str(k)))))
        docs = out[-1][1]
    return out


def test_stages(spark, outputs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    for _, out in outputs[:-1]:
        assert out.columns == columns
    toxic_in, toxic_out = outputs[0]
    insulting = F.lower("text").rlike(r"\b(idiot|moron|scum)\b")
    assert toxic_in.filter(insulting).count() > 5 and toxic_out.filter(insulting).count() == 0
    assert toxic_out.count() > 0.8 * toxic_in.count()


def test_near_duplicates_go(outputs):
    before, after = outputs[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = sorted(d for d, _, _, kept in brute_components(rows, 5) if kept)
    assert sorted(r.doc_id for r in after.collect()) == want and len(want) < len(rows)


def test_benchmark_goes(spark, outputs):
    before, after = outputs[2]
    items = [(r.item_id, r.t) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", decontamination.normal(F.col("text")).alias("t")).collect()]
    left = {r.doc_id: r.t for r in before.select("doc_id", decontamination.normal(F.col("text")).alias("t")).collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone == {d for d, t in left.items() if any(f" {i} " in f" {t} " for _, i in items)}


def test_personal_data_is_masked(outputs):
    before, after = outputs[3]
    assert after.count() == before.count()
    assert sum(len(pii.base(r.text)) for r in before.collect()) > 0
    assert sum(len(pii.base(r.text)) for r in after.collect()) == 0


def test_mix(outputs):
    before, after = outputs[4]
    want = mixing.plan(before).filter("copies > 0").agg(F.sum("copies")).first()[0]
    assert after.count() == want and after.filter("copy > 3").count() == 0


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, label int")
    from tidelog.llm import near_dedup, toxicity

    docs = toxicity.reject(odd.table(spark), toxicity.fit(odd.table(spark), labels))
    assert docs.filter("doc_id = 18").count() == 0 and docs.filter("text is null").count() == 2
    docs = near_dedup.dedup(docs, 5)
    docs = pii.redact(docs, pii.fit(docs))
    assert docs.columns == odd.COLUMNS and mixing.mix(docs).count() > 0
    for stage in (lambda d: near_dedup.dedup(d, 5), lambda d: pii.redact(d, pii.fit(d)), mixing.mix):
        assert stage(odd.empty(spark)).count() == 0
