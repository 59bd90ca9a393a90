import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from thalweg.llm import ordinal, packing, quality_rules, secrets  # noqa: E402
from tests.llm.test_setjoin import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_their_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == before.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.toPandas(), docs.toPandas())
    first, kept = seen["quality_rules"]
    good = {r.doc_id for r in quality_rules.digest(spark.createDataFrame(first)).collect() if r.kept}
    assert set(kept.doc_id) == good and 0 < len(kept) < len(first)
    before, after = seen["quality_classifier"]
    m = ordinal.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = ordinal.Scorer(m)
    import numpy as np
    want = {d for d, t in zip(before.doc_id, before.text) if m.tails(np.array([score(t)]))[0, ordinal.KEEP_GRADE - 1] >= ordinal.KEEP_ODDS}
    assert set(after.doc_id) == want and len(after) < len(before)
    before, after = seen["ngram_jaccard_join"]
    assert set(after.doc_id) == {c for _, c in brute(dict(zip(before.doc_id, before.text)), 5, 80).values()} and len(after) < len(before)
    before, after = seen["secret_scans"]
    assert set(before.doc_id) == set(after.doc_id) and not (after.text.str.len() == 0).any()
    had = {r.doc_id for r in secrets.digest(spark.createDataFrame(before[["doc_id", "text"]])).collect() if r.spans}
    assert {d for d, t in zip(after.doc_id, after.text) if secrets.MARK in t} == had
    again = secrets.digest(spark.createDataFrame(after[["doc_id", "text"]])).agg({"n_hex": "sum", "n_access": "sum"}).first()
    assert tuple(again) == (0, 0)
    before, after = seen["packing"]
    assert set(after.doc_id) == set(before.doc_id)
    for d, g in after.groupby("doc_id"):
        assert g.length.sum() == g.doc_tokens.iloc[0] and list(g.sort_values("start").length) == packing.decompose(int(g.length.sum()))


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "start", "length", "ids", "sequence_id"} <= set(corpus_pipeline.run(spark, SF).columns)
