"""Importance resampling against a plain loop over all features."""

import collections
import hashlib
import math
import random
import zlib

import cases
import numpy as np
import plain
import pytest
from attestry.llm import importance, words


def grams(text):
    w = plain.ALNUM.findall(plain.lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, items):
    s, t = (collections.Counter(b for _, text in rows for b in grams(text)[1]) for rows in (docs, items))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, enough = [], []
    for doc, text in docs:
        n, buckets = grams(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(buckets), weight, score, None])
        if n >= 20:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(enough[: 5 * len(enough) // 100], 1):
        row[4] = rank
    return out


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")


def test_small_table(small, items):
    want = resampled(cases.pairs(small), [tuple(r) for r in items.collect()])
    assert sum(r[4] is not None for r in want) >= 5
    cases.same(importance.resample(small, items).collect(), want)


def test_odd_rows(odd, items, empty):
    many = odd.unionByName(odd).unionByName(odd)
    want = resampled(cases.pairs(many), [tuple(r) for r in items.collect()])
    assert any(r[4] for r in want)
    cases.same(importance.resample(many, items).collect(), want)
    assert importance.resample(empty, items).count() == 0
    cases.same(importance.resample(odd, items.limit(0)).collect(), resampled(cases.pairs(odd), []))


def test_lines_are_counted_once_and_crossings_added(spark):
    texts = ["a b c\nd e\n\nf", "a b c\nd e", "\n\na b c", "x\ny\nz\nw v", None, "a b c"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = collections.Counter(b for t in texts for b in grams(t)[1])
    got = importance.bucket_counts(docs)
    assert {b: n for b, n in enumerate(got.tolist()) if n} == dict(want)


def test_checksums_of_grams_are_those_of_their_bytes():
    rng = random.Random(1)
    parts = ["é" * n if n % 2 else "".join(rng.choices("abcxyz019", k=n)) for n in (1, 2, 5, 31, 63, 64, 65, 66, 200, 70_001, 3)]
    text = " ".join(parts).encode()
    found = words.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words.LETTERS)
    got, _ = importance.features(found)
    want = [zlib.crc32(" ".join(parts[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(parts) - n + 1)]
    assert got.tolist() == want


def test_draws_favour_the_target(spark):
    rng = random.Random(2)
    near, far = ["alpha", "beta", "gamma"], ["one", "two", "three"]
    mixed = lambda p: " ".join(rng.choice(near if rng.random() < p else far) for _ in range(60))
    docs = spark.createDataFrame([(i, mixed(0.9 if i % 10 == 0 else 0.1)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(mixed(0.95),) for _ in range(20)], "text string")
    drawn = importance.resample(docs, target).where("rank is not null").collect()
    assert len(drawn) == 20 and all(r.doc_id % 10 == 0 for r in drawn)
