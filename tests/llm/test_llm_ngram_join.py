"""The similarity join against the similarity of all pairs."""

import random

import cases
import numpy as np
import plain
import pytest
from attestry.llm import ngram_join
from test_llm_near_copies import edited, shingles


def joined(docs):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    near = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    roots, least = plain.components(len(docs), near), {}
    for (doc, _), r in zip(docs, roots):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return [(doc, len(s), least[r]) for (doc, _), s, r in zip(docs, sets, roots)]


def table(spark, texts):
    docs = list(enumerate(texts))
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def prose(rng, n, name="w"):
    return [f"{name}{rng.randrange(10**6)}" for _ in range(n)]


def test_odd_rows(odd, empty):
    cases.same(ngram_join.classes(odd).collect(), joined(cases.pairs(odd)))
    assert ngram_join.classes(empty).columns == ["doc_id", "n_shingles", "component_id"]
    assert ngram_join.classes(empty).count() == 0


def test_links_at_the_border(spark):
    # 44 words are 40 shingles; a text and its first 36 words share 32 of 40
    base = prose(random.Random(3), 44)
    docs, df = table(spark, [" ".join(base), " ".join(base[:36]), " ".join(base[:35]), " ".join(base[1:37]), "one two", "ONE two", "one"])
    want = joined(docs)
    assert [c for _, _, c in want[:2]] == [0, 0]
    cases.same(ngram_join.classes(df).collect(), want)


@pytest.mark.parametrize("block, rounds", [(1024, (16, 512, None)), (7, (1, None))])
def test_a_large_group_and_chains(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(5)
    base, other, passage = prose(rng, 150), prose(rng, 200, "v"), prose(rng, 60, "p")
    texts = [edited(base, set(rng.sample(range(150), rng.randrange(7)))) for _ in range(120)]
    # neighbours are near, ends are not
    texts += [edited(other, set(range(3, 3 + 25 * k, 25))) for k in range(8)]
    # a shared passage links nothing
    texts += [" ".join(prose(rng, 40) + passage + prose(rng, 40)) for _ in range(30)]
    docs, df = table(spark, texts)
    cases.same(ngram_join.classes(df).collect(), joined(docs))


def test_any_order_gives_the_same_links(spark, monkeypatch, small):
    want = joined(cases.pairs(small))
    monkeypatch.setattr(ngram_join, "_frequencies", lambda *_: np.zeros(1 << ngram_join.CELL_BITS, np.int64))
    cases.same(ngram_join.classes(small).collect(), want)


def test_candidates_grow_with_a_group(spark, monkeypatch):
    """Verified pairs of a group of edited copies stay in proportion to its rows."""

    def verified(n):
        rng, counts = random.Random(9), []
        base = prose(rng, 150)
        _, df = table(spark, [edited(base, set(rng.sample(range(150), rng.randrange(6)))) for _ in range(n)])
        linked = ngram_join._linked

        def counting(pairs, sets):
            counts.append(pairs.count())
            return linked(pairs, sets)

        monkeypatch.setattr(ngram_join, "_linked", counting)
        ngram_join.classes(df).count()
        monkeypatch.setattr(ngram_join, "_linked", linked)
        return sum(counts)

    assert verified(800) <= 2.2 * verified(400)


def test_ranges_are_stored_with_the_sets_only(spark, sf_dir, monkeypatch):
    kept = []
    store = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: kept.append(("ranges" in df.columns, name)) or store(df, name))
    ngram_join.classes(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)).count()
    assert [name for has, name in kept if has] == ["join-sets"]


def test_whole_sets_are_carried_for_pairs_with_near_ranges_only(spark, monkeypatch):
    """Texts that share half of their words, and so prefix shingles, never have their sets compared."""
    rng, linked, seen = random.Random(11), ngram_join._linked, []

    def counting(pairs, sets):
        seen.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(ngram_join, "_linked", counting)
    halves = [prose(rng, 40) for _ in range(30)]
    far = [" ".join(half + prose(rng, 40)) for half in halves for _ in range(2)]
    docs, df = table(spark, far)
    cases.same(ngram_join.classes(df).collect(), joined(docs))
    assert seen and seen[0] == 0
    copies = [" ".join(half + [f"x{i}"]) for half in halves[:5] for i in range(2)]
    docs, df = table(spark, far + copies)
    cases.same(ngram_join.classes(df).collect(), joined(docs))
