"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the running text below them, and the best
are widened to the whole article: to an ``article`` around them, or to the nearest
parent whose other children are headings, paragraphs, lists or further parts of
the same name.  A container is named by the tags and classes on its way from the
root, with numbers generalised, so pages of one template share names.  Spark sums
the pages' votes by host and name; all elements of the winning name make the text
of each of the host's pages.  A page where it does not occur, or holds little of
the page's text, takes its own best container.  Votes that tie go to the name that
sorts last.

Votes are a few short rows for each page and are summed before they are
shuffled, so a host with a third of all pages is no hot key; the winners are one
row for each host, and Spark broadcasts them only while they are small.

Null and empty pages give an empty text.  Pages without a host vote for
themselves alone.  Broken markup is read as browsers do in spirit: unknown ends
are ignored, open elements end with their parents.  Repeated rows are pages of
their own.  Extra columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import frames
from attestry.session import stored

# Containers of a page that vote.
VOTES = 3
# Elements that say they hold the article count more.
BONUS = {"article": 1.5, "main": 1.2}
# Share of the weight of the page's own article from which the host's container is taken.
ENOUGH = 0.3

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript object script style svg math template textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# An opening tag ends these open elements, looked for up to the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CONTAINERS = frozenset("article main section div td body center blockquote form ul ol".split())
DROPPED = frozenset("nav aside footer form button select input label dialog menu head".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split()
)
# Words in class or id of what surrounds an article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
# Children that belong to the text of the container they stand in.
FLOW = frozenset(
    "address blockquote center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table ul".split()
)
# Share of link text up to which the surroundings of a container are still text.
LINKED = 0.34
HEADER_WORDS = frozenset("header masthead".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NUMBER = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Page:
    """Elements of a page in document order and its blocks of text."""

    __slots__ = ("tags", "parents", "steps", "dropped", "headers", "links", "blocks", "sizes", "link_sizes", "kept", "kept_links", "prose")

    def __init__(self, source: str):
        self.tags, self.parents, self.steps = ["#root"], [-1], [""]
        self.dropped, self.headers, self.links = [False], [False], [False]
        # (element, pieces): the block's innermost element, and (element, text) pieces
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._read(source)
        self._measure()

    def _open(self, tag: str, raw: str, parent: int) -> int:
        named: set[str] = set()
        label = tag
        dropped = tag in DROPPED
        header = tag == "header"
        if raw and not raw.isspace():
            values = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
            classes = sorted(set(_NUMBER.sub("#", values.get("class", "")).lower().split()))
            label = ".".join([tag, *classes])
            for part in (values.get("class", ""), values.get("id", "")):
                named |= {w.lower() for w in _WORDS.findall(part)}
            dropped |= values.get("role", "").lower() in DROPPED_ROLES
            dropped |= "hidden" in values or values.get("aria-hidden") == "true"
            dropped |= "display:none" in values.get("style", "").replace(" ", "").lower()
            if tag not in ("html", "body", "main", "article"):
                dropped |= bool(named & DROPPED_WORDS)
                header |= bool(named & HEADER_WORDS) and not named & CONTENT_WORDS
        self.tags.append(tag)
        self.parents.append(parent)
        self.steps.append(label)
        self.dropped.append(dropped)
        self.headers.append(header)
        self.links.append(tag == "a")
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack = [0]
        pieces: list[tuple[int, str]] = []
        names = self.tags
        at = 0
        end = len(source)

        def flush() -> None:
            nonlocal pieces
            if pieces:
                self.blocks.append((stack[-1], pieces))
                pieces = []

        while at < end:
            match = _TOKEN.search(source, at)
            stop = match.start() if match else end
            if stop > at:
                pieces.append((stack[-1], source[at:stop]))
            if not match:
                break
            at = match.end()
            tag = match[2]
            if tag is None:
                continue
            tag = tag.lower()
            if match[1]:
                if tag == "p" and "p" not in [names[i] for i in stack]:
                    flush()
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if names[stack[depth]] == tag:
                        if any(names[i] in BLOCK for i in stack[depth:]):
                            flush()
                        del stack[depth:]
                        break
                continue
            if tag in CLOSES_P:
                flush()
                for depth in range(len(stack) - 1, 0, -1):
                    name = names[stack[depth]]
                    if name == "p":
                        del stack[depth:]
                        break
                    if name in BLOCK:
                        break
            elif tag in BLOCK:
                flush()
            if tag in ENDS:
                ended, barrier = ENDS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    name = names[stack[depth]]
                    if name in barrier:
                        break
                    if name in ended:
                        flush()
                        del stack[depth:]
                        break
            if tag in RAW:
                if not match[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    close = _RAW_END[tag].search(source, at)
                    at = close.end() if close else end
                continue
            if tag in VOID:
                pieces.append((stack[-1], " "))
                continue
            if tag == "body" and "body" in [names[i] for i in stack] or tag == "html" and len(stack) > 1:
                continue
            element = self._open(tag, match[3], stack[-1])
            stack.append(element)
        flush()

    def _measure(self) -> None:
        """Text and link text below each element, and what is really dropped."""
        n = len(self.tags)
        sizes, link_sizes = [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.links[i] or in_link[self.parents[i]]
        for _, pieces in self.blocks:
            for element, text in pieces:
                size = len(text)
                sizes[element] += size
                if in_link[element]:
                    link_sizes[element] += size
        holds = [t in ("article", "main") for t in self.tags]
        for i in range(n - 1, 0, -1):
            parent = self.parents[i]
            sizes[parent] += sizes[i]
            link_sizes[parent] += link_sizes[i]
            holds[parent] |= holds[i]
        total = sizes[0]
        inside = [False] * n
        for i in range(1, n):
            parent = self.parents[i]
            inside[i] = inside[parent] or self.tags[i] in ("article", "main")
            own = self.dropped[i]
            # a name may also be that of a wrapper around the article itself
            if own and self.tags[i] not in DROPPED:
                own = not holds[i] and 2 * sizes[i] <= total
            if self.headers[i] and not inside[i]:
                own |= not holds[i] and 2 * sizes[i] <= total
            self.dropped[i] = own or self.dropped[parent]
        self.sizes, self.link_sizes = sizes, link_sizes
        kept, kept_links = [0] * n, [0] * n
        for _, pieces in self.blocks:
            for element, text in pieces:
                if not self.dropped[element]:
                    size = len(text.strip())
                    kept[element] += size
                    kept_links[element] += size if in_link[element] else 0
        prose = [t in ("p", "ul", "ol", "dl", "pre", "blockquote") for t in self.tags]
        for i in range(n - 1, 0, -1):
            parent = self.parents[i]
            kept[parent] += kept[i]
            kept_links[parent] += kept_links[i]
            prose[parent] |= prose[i] and kept[i] > 0
        self.kept, self.kept_links, self.prose = kept, kept_links, prose

    def path(self, element: int) -> str:
        parts = []
        while element > 0:
            parts.append(self.steps[element])
            element = self.parents[element]
        return "/".join(reversed(parts))

    def scores(self) -> dict[int, float]:
        """Containers by the running text of their paragraphs, near ones counting more."""
        out: dict[int, float] = {}
        for element, pieces in self.blocks:
            size = sum(len(t) for e, t in pieces if not self.dropped[e] and not self.links[e])
            if self.dropped[element] or not size:
                continue
            share = 1.0
            while element > 0 and share > 0.05:
                if self.tags[element] in CONTAINERS and not self.dropped[element]:
                    out[element] = out.get(element, 0.0) + size * share
                    share *= 0.5
                element = self.parents[element]
        for element in out:
            density = self.link_sizes[element] / max(1, self.sizes[element])
            out[element] *= (1 - min(density, 1.0)) * BONUS.get(self.tags[element], 1.0)
        return out

    def weight(self, element: int) -> float:
        """Running text that an element keeps, semantic elements counting more."""
        return (self.kept[element] - self.kept_links[element]) * BONUS.get(self.tags[element], 1.0)

    def _is_text(self, element: int) -> bool:
        return self.kept_links[element] <= LINKED * self.kept[element]

    def _is_part(self, element: int) -> bool:
        """Whether an element may be one of several parts under one name."""
        return self._is_text(element) and ("." in self.steps[element] or self.prose[element])

    def _joins(self, parent: int, child: int, children: list[int]) -> bool:
        """Whether what stands beside a child belongs to the same article."""
        if self.tags[parent] == "main":
            rest = self.kept[parent] - self.kept[child]
            return self.kept_links[parent] - self.kept_links[child] <= LINKED * rest
        for other in children:
            if other != child and self.kept[other]:
                same = self.steps[other] == self.steps[child] and self._is_part(other)
                if not same and not (self.tags[other] in FLOW and self._is_text(other)):
                    return False
        return True

    def widened(self, elements: list[int]) -> list[int]:
        """Each container's article: the ``article`` around it, or as far out as text stands beside it."""
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tags)):
            children.setdefault(self.parents[i], []).append(i)
        out = []
        for element in elements:
            way, at = [], element
            while at > 0:
                way.append(at)
                at = self.parents[at]
            articles = [e for e in way if self.tags[e] == "article"]
            best = articles[-1] if articles else element
            if not articles:
                for child, parent in zip(way, way[1:]):
                    if self.tags[parent] == "html" or not self._joins(parent, child, children[parent]):
                        break
                    if self.kept[parent] > self.kept[child]:
                        best = parent
            out.append(best)
        return out

    def text(self, elements: list[int]) -> str:
        """Blocks below some elements, each with single spaces, in page order."""
        chosen = set(elements)
        inside = [i in chosen for i in range(len(self.tags))]
        for i in range(1, len(self.tags)):
            inside[i] |= inside[self.parents[i]]
        out = []
        for _, pieces in self.blocks:
            raw = "".join(t for e, t in pieces if inside[e] and not self.dropped[e])
            clean = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if clean:
                out.append(clean)
        return "\n".join(out)


def _best(scores: dict[int, float]) -> list[int]:
    return sorted(scores, key=lambda e: (-scores[e], e))


def votes_of(source: str | None) -> list[tuple[str, float]]:
    """The best containers' articles with their share of the best score."""
    if not source:
        return []
    page = Page(source)
    scores = page.scores()
    ranked = _best(scores)[:VOTES]
    most = max(scores.values(), default=0.0) or 1.0
    shares: dict[str, float] = {}
    for element, article in zip(ranked, page.widened(ranked)):
        path = page.path(article)
        shares[path] = max(shares.get(path, 0.0), scores[element] / most)
    return list(shares.items())


def extract(source: str | None, path: str | None) -> str:
    """Text of the elements on a path, or of the page's own best article."""
    if not source:
        return ""
    page = Page(source)
    ranked = _best(page.scores())
    if not ranked:
        return page.text([0])
    chosen = page.widened(ranked[:1])
    if path is not None:
        last = path.rpartition("/")[2]
        found = [e for e in range(1, len(page.tags)) if page.steps[e] == last and page.kept[e] and page.path(e) == path]
        if found:
            largest = max(found, key=lambda e: page.kept[e])
            found = [e for e in found if e == largest or page._is_part(e)]
            if sum(map(page.weight, found)) >= ENOUGH * page.weight(chosen[0]):
                chosen = found
    return page.text(chosen)


def host_of(url: str = "url"):
    """Lower-case host name without port; empty where there is none."""
    name = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(name, r"\.$", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning container path of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, share in votes_of(source):
                    tally[host, path] = tally.get((host, path), 0.0) + share
            rows = [(h, p, v) for (h, p), v in tally.items()]
            columns = list(zip(*rows)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "vote"])

    hosts = pages.select(host_of().alias("host"), "html").where("host <> ''")
    votes = frames.map_texts(hosts, run, "host string, path string, vote double")
    # rounded: sums in another order must not change the winner
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("vote", "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """Pages with ``text`` and ``n_chars``."""
    winners = stored(host_paths(pages), "host-paths")
    marked = pages.drop("text", "n_chars").withColumn("__host", host_of())
    joined = marked.join(winners.select(F.col("host").alias("__host"), F.col("path").alias("__path")), "__host", "left")
    names = [c for c in joined.columns if not c.startswith("__")]
    schema = T.StructType([joined.schema[n] for n in names] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            texts = [extract(h, p) for h, p in zip(column("html").to_pylist(), column("__path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(texts, pa.string())], names=schema.names)

    return frames.map_texts(joined, run, schema).withColumn("n_chars", F.length("text").cast("long"))
