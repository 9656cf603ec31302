"""The pipeline's stages, and a run from end to end."""

import corpus_pipeline as P
from geoloom.llm import cotraining, decontaminate, hyperminhash, pii, sentencepiece
from tests.llm.fixtures import frame

SF = "/root/testdata/sf0.001"


def test_stages_by_name():
    assert [n for n, _ in P.STAGES] == ["quality", "near_copies", "benchmark_passages", "personal_data", "token_ids"] and P.ORACLE_SQL is None


def test_run_against_the_operators(spark, tmp_path):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in cotraining.scored(docs, labels).where("keep").collect()}
    left = docs.where(docs.doc_id.isin(list(good)))
    gone = {r.doc_id for r in hyperminhash.near_duplicates(left).where("NOT kept").collect()}
    left = left.where(~left.doc_id.isin(list(gone) or [-1]))
    want = {r.doc_id: r.ids for r in sentencepiece.encoded(pii.redact(decontaminate.decontaminate(left, bench))).collect()}
    got = {r.doc_id: r.ids for r in P.run(spark, SF).collect()}
    assert got == want and good - gone == set(got) and len(got) > 100


def test_each_stage_takes_awkward_and_empty_tables(spark):
    for name, stage in P.STAGES:
        for docs in (frame(spark), frame(spark, [])):
            out = stage(spark, docs, SF)
            rows = out.count()
            assert rows <= docs.count() and (docs.count() == 0) <= (rows == 0)
            if name != "token_ids":
                assert out.columns == docs.columns
