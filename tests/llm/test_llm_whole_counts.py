"""The n-gram query learns from every n-gram of the training texts."""

import cases
import plain
import pytest
from attestry.llm import lm_score, queries


def test_query_keeps_ngrams_seen_once(spark, sf_dir, small, monkeypatch):
    monkeypatch.setattr(lm_score, "GRAMS", 5000)  # several shards a level
    got = {r.doc_id: r.score for r in queries.QUERIES["op4_ngram_trie"](spark, sf_dir).collect()}
    for doc, n, _, _, _, score in plain.language_model(cases.pairs(small), least=1):
        assert got[doc] == pytest.approx(score, abs=n * 2e-3)
