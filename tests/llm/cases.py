"""Awkward rows: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

PROSE = (
    "The quick brown fox jumps over the lazy dog while seven old wizards, quite unlike their friends, "
    "mix potions of jade and box them with care for the long winter that comes after every short summer "
    "in these hills. Nobody asked why they did so, and nobody had to, since the reasons were plain to see: "
    "a warm hearth, a full cellar and a story to tell were all that anyone there had ever wanted."
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, shard string"


def documents(spark):
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
    texts = [
        (1, PROSE, "en"),
        (2, PROSE + " And one more line.\nAnd one more line.", "en"),
        (2, PROSE + " And one more line.\nAnd one more line.", "en"),  # the same row again
        (3, None, "en"),
        (4, "", None),
        (5, " \t\n\x0b\x0c\r ", "de"),
        (6, "Two words", "xx"),
        (None, PROSE.upper(), None),
        (None, None, None),
        (7, long, "en"),
        (8, "a b c " * 400, "en"),
        (9, "été naïve 中文 \U0001f600 " * 20 + "<|endoftext|> <|ENDOFTEXT|> it's. I'LL, a.B;c", "fr"),
        (10, "x" * 50_000, "en"),
        (11, "\nsame line here\nsame line here\n\nother\nsame line here", "en"),
    ]
    rows = [(i, t, lang, None if i == 1 else "s", len(t or ""), "clash", "clash", "clash") for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    """Whether two lists hold the same rows, in any order."""
    order = lambda xs: sorted((tuple(x) for x in xs), key=repr)
    got, want = order(rows), order(expected)
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:3]
