"""Language model, trie, quality rules and vocabularies."""

import cases
import numpy as np
import plain
import pytest
from attestry.llm import lm_score, ngram_trie, quality, tokens, words
from hypothesis import given, settings
from hypothesis import strategies as st


def scored(df):
    return {
        (r.doc_id, r.n_tokens): (r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in df.collect()
    }


@pytest.mark.parametrize("shard", [lm_score.SHARD, 300])
def test_scores_match_plain_trigrams(small, odd, shard):
    for docs in (small, odd):
        got = scored(lm_score.score_corpus(docs, shard=shard))
        for doc, n, known, total, base, score in plain.language_model(cases.pairs(docs)):
            row = got[doc, n]
            assert row[:2] == (known, total) and row[4] == plain.held_out(doc)
            assert row[2] == pytest.approx(base, rel=1e-9)
            assert abs(row[3] - score) <= n * 2e-3


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_score.score_corpus(docs).where("held_out")
    base, score = held.selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base


def test_model_of_nothing(odd, empty):
    assert lm_score.score_corpus(empty).count() == 0
    only_held = odd.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    rows = lm_score.score_corpus(only_held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=400))
def test_elias_fano_gives_back_its_values(values):
    values = np.sort(np.array(values, np.int64))
    coded = ngram_trie.EliasFano(*ngram_trie.elias_fano(values).values())
    assert (coded[np.arange(len(values))] == values).all()


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 10**8, 50_000))
    assert sum(a.nbytes for a in ngram_trie.elias_fano(values).values()) * 8 < 16 * len(values)


TEXT = st.text(alphabet=st.sampled_from(list("aBZé ñß\t\n.,;:!?'’-<|>019中σΣ́ #ﬁ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.sampled_from(["a<|endoftext|>. b", "<|ENDOFTEXT|>", "it's. I'LL, x"]), min_size=1, max_size=4))
def test_ids_by_words_are_those_of_whole_texts(texts):
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    units = tokens.units(np.frombuffer(raw, np.uint8), offsets)
    coded = tokens.vocabulary("word_bpe_49k.json")(units, units.hashes())
    cuts = np.concatenate([[0], np.cumsum(coded.size)])[units.first]
    flat = coded.flat().tolist()
    assert [flat[a:b] for a, b in zip(cuts, cuts[1:])] == [plain.encode(t) for t in texts]


def test_vocabulary_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    own = tokens.Vocabulary("word_bpe_49k.json")
    for text in ("one two three four five", "six one two", "five six seven"):
        data = np.frombuffer(text.encode(), np.uint8)
        units = tokens.units(data, np.array([0, len(data)]))
        assert own(units, units.hashes()).flat().tolist() == plain.encode(text)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_rules(small, odd, empty):
    for docs in (small, odd):
        judged = quality.judge(docs)
        cases.same(judged.select("doc_id", *BASE).collect(), [(d, *plain.quality(t)) for d, t in cases.pairs(docs)])
        assert judged.where("kept and base_failed").count() == 0
    assert quality.judge(empty).count() == 0


def test_fertility_measures(small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.resolve("piece_bpe_32k.model"))
    rows = quality.measure(small).collect()
    for r in rows[:60]:
        ids = [i for w in plain.words(r.text) for i in model.encode(w)]
        assert r.n_pieces == len(ids) and r.n_tokens == len(plain.encode(r.text))
        assert r.token_entropy == pytest.approx(plain.entropy(ids), abs=1e-9)
        assert r.fallback_share == pytest.approx(sum(map(model.is_byte, ids)) / max(1, len(ids)))


def test_bands_reject_blobs_and_keep_prose(spark):
    blob = " ".join("qzx%06x" % (i * 2654435761 % 2**24) + "ᾚ㐀" for i in range(80))
    loop = " ".join(f"{a}{a}{a}" for a in "aabb" for _ in range(20))
    docs = spark.createDataFrame([(1, cases.PROSE, "en"), (2, blob, "en"), (3, loop, "en"), (4, cases.PROSE, None)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}


def test_fitted_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bands = quality.fit_bands(docs, labels)
    assert "en" in bands and bands["en"].piece[1] < 0 < bands["en"].piece[2]
    judged = quality.judge(docs, bands).join(labels, "doc_id").where("not base_failed")
    good, bad = (judged.where(f"quality = {q}") for q in (1, 0))
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("not kept").count() >= 0.5 * bad.count()
    assert quality.fit_bands(docs, labels.limit(0)) == {}


def test_words_of_control_strings_keep_their_case():
    raw = b"A<|endoftext|>b <|ENDOFTEXT|>"
    units = tokens.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert units.strings(np.arange(len(units.start))) == raw.decode().split()
    assert words.LOWER[ord("A")] == ord("a")


def test_distinct_pairs_beyond_32_bits():
    rng = np.random.default_rng(4)
    small, words_ = rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    for contexts in (small, small + (1 << 33)):
        c, w, each, n = lm_score._distinct(contexts, words_)
        assert (c[each] == contexts).all() and (w[each] == words_).all() and n.sum() == 500
        assert sorted(zip(c.tolist(), w.tolist())) == list(zip(c.tolist(), w.tolist()))


def test_hashes_of_long_buffers_do_not_depend_on_the_cut(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    found = words.find(data, np.array([0, len(data)]), ~words.SPACE)
    whole = found.hashes()
    monkeypatch.setattr(words, "RUN_BYTES", 50)
    assert (found.hashes() == whole).all()


def test_bands_keep_clean_rows_they_were_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    bands = quality.fit_bands(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs, bands).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good = judged.where("quality = 1")
    assert good.where("not kept").count() < 0.005 * good.count()


def test_a_languages_sample_is_its_own(spark):
    """A hot language takes no rows from a rare one."""
    rows = [(i, cases.PROSE, "en" if i % 10 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    few = quality.fit_bands(docs, labels, rows=10)
    alone = quality.fit_bands(docs.where("lang = 'de'"), labels, rows=10)
    assert alone["de"] == few["de"]


def test_fitted_bands_and_verdicts_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bands = quality.fit_bands(docs, labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = quality.judge(docs, bands).collect()
    for lang, band in bands.items():
        fit = [r for r in rows if r.lang == lang and r.doc_id in good and r.n_words >= 50 and not r.other_script]
        total = sum(r.n_words for r in fit)
        for name, got in (("chars_per_piece", band.piece), ("chars_per_token", band.token)):
            at = sum(r[name] * r.n_words for r in fit) / total
            ends = [(r[name] - at) * r.n_words**0.5 for r in fit]
            more = 0.1 * (max(ends) - min(ends))
            assert got == pytest.approx((at, min(ends) - more, max(ends) + more))
        assert band.share == len(fit) / (len(fit) + 4) and band.longest == max(r.n_words for r in fit)
        for r in (r for r in rows if r.lang == lang and not r.other_script and r.n_words):
            root, wide, w = min(r.n_words, band.longest) ** 0.5, band.wide, band.share
            inside = r.fallback_share <= w * band.fallback + (1 - w) * wide.fallback
            inside &= r.token_entropy >= w * band.entropy + (1 - w) * wide.entropy
            for value, at, low, high in (
                (r.chars_per_piece, band.piece, wide.piece_low, wide.piece_high),
                (r.chars_per_token, band.token, wide.token_low, wide.token_high),
            ):
                inside &= w * (at[0] + at[1] / root) + (1 - w) * low <= value <= w * (at[0] + at[2] / root) + (1 - w) * high
            assert r.kept == (inside and not r.base_failed)


def test_samples_are_bounded_and_nearly_full(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 20 = 0 THEN 'de' WHEN id % 3 > 0 THEN 'en' END AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    sizes = {r.lang: r["count"] for r in quality._sample(docs.union(docs), labels, 3_000).groupBy("lang").count().collect()}
    assert sizes["de"] == 2_000 and 2_600 <= sizes["en"] <= 3_000
    assert quality._sample(docs, labels.limit(0), 10).count() == 0
