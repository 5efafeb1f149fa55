"""Packing, sharding, token counts, chat formatting and page texts."""

import zlib

import cases
import compare
import numpy as np
import plain
import pytest
from attestry.llm import chat, html_text, length_histogram, packing, queries, sharding


def check_pieces(rows, docs):
    """Every id in one piece, windows gapless, padding only where there must be."""
    texts = {}
    for doc, text in docs:
        ids = np.array([*plain.encode(text), packing.END], "<u4")
        texts.setdefault((doc, len(ids)), []).append(ids)
    by_window, covered = {}, {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append(r)
        ids = texts[r.doc_id, r.doc_tokens][0]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, spans in covered.items():
        copies = len(texts[key])
        marks = np.zeros(key[1], int)
        for start, length in spans:
            marks[start : start + length] += 1
        assert (marks == copies).all()
    assert set(covered) == set(texts)
    for window in by_window.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window[0].sequence_length <= packing.WINDOW
        assert window[0].padding == (0 if at & (at - 1) == 0 else packing.WINDOW - at)
    return sum(w[0].padding for w in by_window.values())


def test_packing_small_and_odd(small, odd, empty):
    assert check_pieces(packing.pack(small).collect(), cases.pairs(small)) == 0
    assert check_pieces(packing.pack(odd).collect(), cases.pairs(odd)) == 0
    assert packing.pack(empty).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(200):
        packer = packing.Packer(16)
        packer.counts[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def squares(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            if level + size < 16:
                counts[level + size] += 1
            return int((counts[1:16] ** 2).sum())

        allowed = [h for h in range(0, 17 - size) if h == 0 or packer.counts[h] > 0]
        best = min(map(squares, allowed))
        assert squares(packer._level(size)) == best


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 4)
    packer, rng, total = packing.Packer(64), np.random.default_rng(2), 0
    out = []
    for doc in range(300):
        ids = np.arange(rng.integers(1, 150), dtype=np.uint32)
        total += len(ids)
        out += packer.add(doc, ids)
        assert packer.opened <= 4
    out += packer.finish()
    assert sum(map(packing.fill, out)) == total and sum(packing.fill(w) < 64 for w in out) <= 6


@pytest.mark.parametrize("parts", [sharding.UNITS, 4])
def test_shards(spark, small, odd, empty, monkeypatch, parts):
    monkeypatch.setattr(sharding, "UNITS", parts)
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('copy ', 50), repeat(md5(string(id)), 8)) as text")
    for docs in (small, odd, hot):
        rows = sharding.shard(docs).collect()
        expected = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in cases.pairs(docs)]
        cases.same([(r.doc_id, r["size"], r.text_crc32) for r in rows], expected)
        sizes = [0] * sharding.SHARDS
        for s in range(sharding.SHARDS):
            own = [r for r in rows if r.shard == s]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            sizes[s] = sum(r["size"] for r in own)
        mean = sum(sizes) / len(sizes)
        slack = 2 * max(max(e[1] for e in expected), mean / parts)
        assert all(abs(s - mean) <= slack for s in sizes)
    assert sharding.shard(empty).count() == 0


def line_of(docs):
    """(hash of the text, its bytes and one) of every record, in order."""
    from pyspark.sql import functions as F

    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return sorted((r[0], r[1]) for r in docs.select(F.xxhash64(body), F.octet_length(body) + 1).collect())


def test_shards_are_stretches_of_the_line(spark, small, odd):
    """Plain version: exact borders on the sorted line, held against the sampled ones."""
    hot = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('copy ', 50), repeat(md5(string(id)), 8)) as text")
    for docs in (small, odd, hot):
        line = line_of(docs)
        total = sum(size for _, size in line)
        rows = sharding.shard(docs).collect()
        sums = [sum(r["size"] for r in rows if r.shard <= s) for s in range(sharding.SHARDS)]
        slack = total / sharding.SHARDS / sharding.UNITS
        behind = np.cumsum([size for _, size in line])
        for s, sum_ in enumerate(sums[:-1]):
            target = total * (s + 1) / sharding.SHARDS
            holding = line[int(np.searchsorted(behind, target, side="right"))][1]
            assert abs(sum_ - target) <= max(slack, holding / 2) + 1
        # what the shards hold follows the line: a text lies in one shard, or in neighbours
        by_text = {}
        for r in rows:
            by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        large = {k for k, v in by_text.items() if len(v) > 1}
        for key in large:
            assert sum(r["size"] for r in rows if (r.text_crc32, r["size"]) == key) > slack
            assert sorted(by_text[key]) == list(range(min(by_text[key]), max(by_text[key]) + 1))
    assert len(large) == 1


def test_other_boundaries_move_records(small, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 32)
    monkeypatch.setattr(sharding, "UNITS", 4)
    monkeypatch.setattr(sharding, "SAMPLE", 1)
    one, other = ({(r.doc_id, r.shard) for r in sharding.shard(small, seed=s).collect()} for s in (1, 9))
    assert len(one) == len(other) == small.count() and one != other


def test_overfull_ranges_are_cut_again(small, monkeypatch):
    monkeypatch.setattr(sharding, "OVERFULL", 0.2)
    rows = sharding.shard(small).collect()
    assert len(rows) == small.count()


def test_histogram(small, odd, empty):
    for docs in (small, odd):
        sizes = np.array([len(plain.encode(t)) for _, t in cases.pairs(docs)])
        hist = length_histogram.histogram(length_histogram.lengths(docs), block=64)
        rows = hist.collect()
        assert {r.n_tokens: r.n_docs for r in rows} == dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
        for r in rows:
            assert (r.docs_from, r.tokens_from) == ((sizes >= r.n_tokens).sum(), sizes[sizes >= r.n_tokens].sum())
            assert r.truncated_tokens == np.minimum(sizes, r.n_tokens).sum() and r.total_tokens == sizes.sum()
            assert r.share_up_to == pytest.approx((sizes <= r.n_tokens).mean()) and r.total_docs == len(sizes)
        limits = [0, 1, 17, 100, 512, 10**9]
        for r in length_histogram.at_limits(hist, limits).collect():
            assert r.truncated_tokens == np.minimum(sizes, r.context_limit).sum()
            assert r.docs_over == (sizes > r.context_limit).sum() and r.total_tokens == sizes.sum()
        got = {r.share: r.n_tokens for r in length_histogram.quantiles(hist, [0.1, 0.5, 0.9, 1.0]).collect()}
        assert got == {q: np.quantile(sizes, q, method="inverted_cdf") for q in got}
    none = length_histogram.histogram(length_histogram.lengths(empty))
    assert none.count() == 0
    assert [tuple(r) for r in length_histogram.at_limits(none, [5]).collect()] == [(5, 0, 0, 0)]


TURNS = [
    (1, 0, "user", "a"),
    (1, 0, "user", "a"),
    (1, 1, "user", "b\\n#<\\h"),
    (1, 1, "odd: role#", None),
    (1, 2, "assistant", "x</turn>\n### user: y"),
    (1, 3, "assistant", "<part/>z\\"),
    (2, None, None, ""),
    (3, 5, "assistant", "later"),
    (3, None, "user", "first"),
    (None, 1, "assistant", "q"),
]


def test_chat_reads_back(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn int, role string, text string, formatted string")
    out = chat.read_turns(chat.format_conversations(rows)).select("*", chat.loss_text().alias("lost")).collect()
    expected = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected.setdefault(c, []).append((r or "", x or ""))
    for row in out:
        assert [tuple(t) for t in row.read] == expected[row.conv_id]
        assert "".join(s.text for s in row.segments) == row.formatted
        assert row.lost == "".join(x for r, x in expected[row.conv_id] if r == "assistant")
        marks = sum(a[0] != b[0] for a, b in zip(expected[row.conv_id], expected[row.conv_id][1:])) + 1
        assert row.formatted.count("### ") == row.formatted.count("</turn>\n") == marks
    assert len(out) == len(expected)
    assert chat.digests(rows.limit(0)).count() == 0


def test_chat_query_equals_its_twin(spark, sf_dir):
    got = queries.QUERIES["op3_chat"](spark, sf_dir)
    assert compare.compare(got, compare.duck(sf_dir), queries.ORACLE_SQL["op3_chat"]) == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGE = """<html><head><title>x</title><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header>
<div class="page-with-sidebar"><div class="cookie-notice">We use cookies, do accept them please</div>
<div class="post-{n} entry"><h2>Title &amp; more</h2><p>First para with <a href=x>link</a> and
   text, quite long enough to count.<p>Second para a < b &nbsp; and so on until<br>the end.
<form><input name=q>Search text</form><div class=ad>Buy this</div><ul><li>one<li>two</ul>
<section class="comments"><p>nice post, thank you very much for it</p></section></div>
<div class="sidebar"><p>Related stuff, some longer text about other things</p></div></div><footer>Bye</footer>"""
TEXT = "Title & more\nFirst para with link and text, quite long enough to count.\nSecond para a < b and so on until the end.\none\ntwo"


def test_page_texts(spark):
    rows = [(i, f"https://H.example.com:80/{i}", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(6, None, "<p>alone</p>"), (7, "no url", None), (8, "https://h.example.com/8", ""), (None, "", "a &lt; b")]
    rows += [(9, "https://h.example.com/9", "<main><p>Another layout altogether.</p></main>"), rows[0]]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = html_text.main_text(pages)
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    expected = [(i, TEXT) for i in [*range(6), 0]]
    expected += [(6, "alone"), (7, ""), (8, ""), (None, "a < b"), (9, "Another layout altogether.")]
    cases.same(got, [(i, t, len(t)) for i, t in expected])
    assert html_text.main_text(pages.limit(0)).count() == 0
    winner = html_text.host_paths(pages).where("host = 'h.example.com'").first()
    assert winner.path.endswith("div.entry.post-#")


def test_consensus_overrules_a_longer_sidebar(spark):
    article = "<article><p>" + "Short article text. " * 4 + "</p></article>"
    pages = [(i, "http://a.b/x", f"<body>{article}<div class=extra><p>{'filler ' * (40 if i == 0 else 2)}</p></div></body>") for i in range(5)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_text.main_text(docs).collect()}
    assert texts[0].startswith("Short article") and "filler" not in texts[0]


def test_pages_of_the_test_table(spark, sf_dir):
    """There the article element holds the text."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.main_text(pages).collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
