"""The pipeline's stages against their operators and brute force."""

import importlib.util

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline as c  # noqa: E402

from tests.llm.test_minhash import brute  # noqa: E402
from wayfare.llm import mixing  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs
    for name, stage in c.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(stages["documents"].select("doc_id"), "doc_id")
    assert good.join(stages["language"], "doc_id", "left_anti").count() <= 0.02 * good.count()
    bad = labels.where("quality = 0").join(stages["quality"].select("doc_id"), "doc_id")
    assert bad.count() <= 0.1 * labels.where("quality = 0").count() + 1
    for name in ("quality", "language", "near_duplicates", "mix"):
        assert stages[name].columns == stages["documents"].columns


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["language"].collect()]
    want = {i for i, (_, root) in brute(rows).items() if i == root}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == want


def test_mix_and_tokens(stages):
    mixed = mixing.mix(stages["near_duplicates"]).where("copies > 0").select("doc_id", "copies").collect()
    got = {r.doc_id: r["count"] for r in stages["mix"].groupBy("doc_id").count().collect()}
    assert got == {r.doc_id: r.copies for r in mixed}
    assert {r.doc_id: r["count"] for r in stages["tokens"].groupBy("doc_id").count().collect()} == got


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    """Null and repeated ids, one id with several texts, empty and long texts, and columns of any name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.limit(1).collect()[0]
    other = " ".join(reversed(one.text.split()))  # a text that nothing else is like
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (90001, "", "en", "s", 0), (90002, one.text, None, None, None), (90002, one.text, None, None, None), (90002, other, None, None, None)]
        + [(None, one.text, None, None, None), (None, other, None, None, None), (90003, "a" * 50_000, "en", "s", 5)],
        docs.schema,
    )
    rows = docs.unionByName(odd).withColumns({"of_": F.lit(1), "copies_": F.lit(2), "copy_": F.lit(3)})
    columns = rows.columns
    for name, stage in c.STAGES:
        path = str(tmp_path / name)
        before = rows
        out = stage(spark, rows, SF)
        assert name == "tokens" or out.columns == columns
        out.write.parquet(path)
        rows = spark.read.parquet(path)
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in rows.collect()]
            assert before.where(F.col("text") == one.text).count() >= 4 and [i for i, t in kept if t == one.text] == [one.doc_id]
            assert [i for i, t in kept if t == other] == [90002]
            assert len({t for _, t in kept}) == len(kept)


def test_an_empty_table_passes(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        rows = stage(spark, rows, SF)
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        assert rows.count() == 0
