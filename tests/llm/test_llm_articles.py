"""Whole articles of several templates, and the vote of hosts, against a plain version."""

import pytest

from attestry.llm import html_text


def run_of(word, n):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


AROUND = (
    "<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav>",
    "<div class=latest><ul><li><a href=/1>First other story</a><li><a href=/2>Second other story</a></ul></div><footer>All rights</footer>",
)
# name: (markup around the blocks of the article, with {0}, {1} ... for the blocks)
TEMPLATES = {
    "heading": ("<article><h1>{0}</h1><div class=body><p>{1}</p><p>{2}</p></div></article>", (4, 200, 90)),
    "parts": ("<main><div class=part><p>{0}</p></div><div class=part><p>{1}</p></div></main>", (200, 100)),
    "beside": ("<div class=story><p class=lede>{0}</p><div class=txt><p>{1}</p></div><ul><li>{2}<li>{3}</ul></div>", (20, 200, 6, 6)),
    "sections": ("<div class=wrap><section><div class=t><p>{0}</p></div></section><section><div class=t><p>{1}</p></div></section></div>", (150, 80)),
    "tags-word": ("<article><h2>{0}</h2><div class=copy><p>{1}</p><blockquote>{2}</blockquote><p>{3}</p></div></article>", (3, 60, 30, 60)),
    "bare": ("<h1>{0}</h1><div class=text><p>{1}</p></div><p>{2}</p>", (4, 150, 20)),
}


def page(name, number):
    markup, sizes = TEMPLATES[name]
    blocks = [run_of(f"{name}{number}x{k}w", n) for k, n in enumerate(sizes)]
    around = AROUND if name != "bare" else ("<nav><a href=/>Home</a></nav>", "<footer>All rights</footer>")
    return f"<html><body>{around[0]}{markup.format(*blocks)}{around[1]}</body></html>", "\n".join(blocks)


@pytest.fixture(scope="module")
def rows():
    return [(i, f"http://{name}.example/{i}", *page(name, i)) for name in TEMPLATES for i in range(3)]


def test_whole_articles(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in html_text.main_text(docs).collect()}
    assert got == {(i, url): text for i, url, _, text in rows}


def test_votes_against_a_plain_sum(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    tally = {}
    for _, url, source, _ in rows:
        votes = tally.setdefault(url.split("/")[2], {})
        for path, share in html_text.votes_of(source):
            votes[path] = votes.get(path, 0) + share
    plain = {host: max((round(v, 6), p) for p, v in votes.items())[1] for host, votes in tally.items()}
    assert {r.host: r.path for r in html_text.host_paths(docs).collect()} == plain


def test_votes_that_tie(spark):
    pages = [(i, "http://tie.example/", f"<body><div class={c}><p>Some text of the page</p></div></body>") for i, c in enumerate("ab")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert html_text.host_paths(docs).first().path.endswith("div.b")
    assert {r.text for r in html_text.main_text(docs).collect()} == {"Some text of the page"}


def test_a_very_long_page(spark):
    text = run_of("word", 200_000)
    docs = spark.createDataFrame([(1, None, f"<article><h1>t</h1><p>{text}</p></article>")], "page_id long, url string, html string")
    assert html_text.main_text(docs).first().text == "t\n" + text
