"""Stages of the pipeline against brute force on what the stage before kept."""

import cases
import corpus_pipeline
import plain
import pytest
from attestry.llm import quality
from attestry.session import stored
from test_llm_near_copies import survivors

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "substring_dedup", "decontaminate", "pack_windows",
    ]


def test_quality_stage(spark, sf_dir, steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {d for d, t in cases.pairs(docs) if not plain.quality(t)[-1]}
    got = {r.doc_id for r in steps[0].collect()}
    assert got <= kept and len(got) >= 0.9 * len(kept)
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert got == {r.doc_id for r in quality.judge(docs, bands).where("kept").collect()}


def test_dedup_stage(steps):
    before, after = cases.pairs(steps[0]), cases.pairs(steps[1])
    assert sorted(d for d, _ in after) == survivors(before)
    assert dict(after).items() <= dict(before).items()


def test_substring_stage(steps):
    before, after = cases.pairs(steps[1]), cases.pairs(steps[2])
    expected = {d: (n - gone, digest) for d, n, gone, digest in plain.without_repeats(before)}
    got = {d: (len(plain.words(t)), plain.sha(" ".join(plain.words(t)))) for d, t in after}
    assert got == expected
    same = {d for d, n, gone, _ in plain.without_repeats(before) if not gone}
    assert all(dict(before)[d] == dict(after)[d] for d in same)


def test_decontamination_stage(spark, sf_dir, steps):
    before = cases.pairs(steps[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {row[0] for row in plain.contamination(before, items) if not row[-1]}
    assert {d for d, _ in cases.pairs(steps[3])} == clean


def test_packing_stage(steps):
    from test_llm_layout import check_pieces

    assert check_pieces(steps[4].collect(), cases.pairs(steps[3])) == 0


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_run_equals_the_stages(spark, sf_dir, steps):
    ids = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(steps[4])


def test_stages_take_odd_rows(spark, sf_dir, odd, empty):
    for docs in (odd.select(COLUMNS), empty.select(COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf_dir), "odd")
    assert empty.count() == 0
