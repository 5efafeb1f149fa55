"""Decontamination, substring dedup and SimHash against brute force."""

import cases
import compare
import numpy as np
import plain
import pytest
from attestry.llm import decontamination, frames, queries, simhash, substring, words

DECON = ["doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated"]


def decon_rows(found):
    from pyspark.sql import functions as F

    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("sha")
    return found.withColumn("sha", digest).select(DECON).collect()


def benchmark(spark):
    rows = [
        (10, "seven old wizards, quite unlike their friends mix POTIONS of jade and box them"),
        (9, "two words"),
        (None, "naïve 中文"),
        (11, None),
        (12, ""),
        (13, "lazy"),
        (10, "seven old wizards, quite unlike their friends mix POTIONS of jade and box them"),
        (14, "a b c a b c a b c a b c"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [10**6, 12])
def test_contamination_of_odd_rows(spark, odd, block):
    items = benchmark(spark)
    expected = plain.contamination(cases.pairs(odd), [tuple(r) for r in items.collect()])
    found = decontamination.contamination(odd, items, block_words=block)
    cases.same(decon_rows(found), expected)
    assert {"lang", "source", "n_chars", "score"} <= set(found.columns)


def test_blocks_hold_their_words_with_null_ids(spark):
    """Half the items without an id, one very long: no block above its words, no window lost."""
    texts = [(None if i % 2 else i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(40))) for i in range(200)]
    texts += [(7, " ".join(f"v{j * 7919 % 5003}" for j in range(20_000))), (8, "two words"), (9, ""), (None, None), texts[1]]
    items = spark.createDataFrame(texts, "item_id long, text string").repartition(5)
    chunks = decontamination.blocks_of(items, block_words=2000).collect()
    sums = {}
    for r in chunks:
        assert r.n_words == len(r.chunk.split(" "))
        sums[r.block] = sums.get(r.block, 0) + r.n_words
    assert max(sums.values()) <= 2000 and len(sums) > 10
    windows = lambda name, ws: {(name, tuple(ws[i : i + 10])) for i in range(max(1, len(ws) - 9)) if ws}
    got = set().union(*(windows(r.name, r.chunk.split(" ")) for r in chunks))
    want = set().union(*(windows("" if i is None else str(i), (t or "").split()) for i, t in texts))
    assert got == want
    # every start of a window lies in one chunk, and the repeated row counts once
    assert sum(max(1, r.n_words - 9) for r in chunks) == 200 * 31 + 20_000 - 9 + 1


def test_contamination_of_the_small_table(spark, sf_dir, small):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    expected = plain.contamination(cases.pairs(small), [(r.item_id, r.text) for r in items.collect()])
    cases.same(decon_rows(decontamination.contamination(small, items)), expected)


def test_contamination_of_nothing(spark, odd, empty):
    assert decon_rows(decontamination.contamination(empty, benchmark(spark))) == []
    none = decontamination.contamination(odd, benchmark(spark).limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == odd.count()


def repeats(found):
    return frames.with_words_sha256(found, "kept_text", "sha").select("doc_id", "n_words", "n_removed", "sha").collect()


@pytest.mark.parametrize("group", [substring.GROUP, 2])
def test_substring_odd_rows(odd, group):
    cases.same(repeats(substring.remove_repeats(odd, group=group)), plain.without_repeats(cases.pairs(odd)))


@pytest.mark.parametrize("group", [substring.GROUP, 2])
def test_substring_small_table(small, group):
    cases.same(repeats(substring.remove_repeats(small, group=group)), plain.without_repeats(cases.pairs(small)))


def test_substring_keeps_what_does_not_repeat(spark, empty):
    passage = " ".join(f"p{i}" for i in range(35))
    rows = [(1, f"one\n{passage}  two"), (2, f"three {passage}\nfour\n"), (3, "alone\n\n stays "), (4, passage[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs).collect()}
    assert kept == {1: "one\ntwo", 2: "three four\n", 3: "alone\n\n stays ", 4: passage[:-1]}
    assert substring.remove_repeats(empty).count() == 0


def test_simhash_odd_rows(odd, empty):
    cases.same(simhash.near_groups(odd).collect(), plain.near_groups(cases.pairs(odd)))
    assert simhash.near_groups(empty).count() == 0


def test_simhash_small_table(small):
    cases.same(simhash.near_groups(small).collect(), plain.near_groups(cases.pairs(small)))


def test_masks_cover_every_pair_of_bits():
    for bits in (list(range(64)), list(range(5, 40, 3))):
        masks = simhash.covering_masks(bits)
        for i in bits:
            for j in bits:
                assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_components_of_crowded_fingerprints(spark, bucket):
    """Many fingerprints within a few bits of each other, also with every bucket dealt again."""
    rng = np.random.default_rng(3)
    fps = set()
    for centre in (0, -1, 0x0F0F0F0F0F0F0F0F):
        for _ in range(60):
            flips = rng.integers(0, 64, rng.integers(0, 7))
            fps.add(int(np.uint64(centre & (2**64 - 1)) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))))
    fps = [f - 2**64 if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
    masked = [f & (2**64 - 1) for f in fps]
    expected = plain.components(len(fps), lambda i, j: (masked[i] ^ masked[j]).bit_count() <= 2)
    groups = {}
    for f, e in zip(fps, expected):
        groups.setdefault(e, []).append(f)
    for group in groups.values():
        assert {roots.get(f, f) for f in group} == {min(group)}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(900, 901).selectExpr("id as a", "id + 7 as b"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 907: 900}


def test_one_row_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    groups = plain.near_groups(cases.pairs(odd))
    assert kept.columns == odd.columns
    assert kept.count() == len({g or "null" for _, _, g in groups})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({g for _, _, g in groups if g})


def test_words_and_hashes():
    texts = ["a  b\tc", "", " \n", "été a b c", "b"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = words.find(np.frombuffer(raw, np.uint8), offsets, ~words.SPACE)
    assert [found.strings(np.arange(a, b)) for a, b in zip(found.first, found.first[1:])] == [t.split() for t in texts]
    hashes = found.hashes()
    assert hashes[0] == hashes[4] and hashes[1] == hashes[5] == hashes[7] and len(set(hashes.tolist())) == 4
    grams = words.gram_hashes(hashes, 3)
    assert grams[0] == grams[4] and found.inside(3).tolist() == [True, False, False, True, True, False]


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_twins(spark, sf_dir, key):
    twin = queries.ORACLE_SQL[key]
    assert compare.compare(queries.QUERIES[key](spark, sf_dir), compare.duck(sf_dir), twin) == []
