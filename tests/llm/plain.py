"""Brute-force versions of the operators in plain Python, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def words(text: str | None) -> list[str]:
    return SPACED.findall(text or "")


def components(n: int, linked) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def contamination(docs, items, size=10):
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i : i + n])):
                    found |= items_here
                    hit[i : i + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def without_repeats(docs, size=35):
    split = [words(t) for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(docs, split):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), sha(" ".join(kept))))
    return out


def fingerprint(text: str | None) -> int:
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs):
    prints = [fingerprint(t) for _, t in docs]
    roots = components(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least: dict[int, int | None] = {}
    for (doc, _), r in zip(docs, roots):
        ids = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(ids) if ids else None
    return [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(docs, prints, roots)]


def quality(text: str | None):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    n, r = len(w), sum(again)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def entropy(ids) -> float:
    counts = collections.Counter(ids)
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


_tokenizer = None


def encode(text: str | None) -> list[int]:
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return _tokenizer.encode(text or "", add_special_tokens=False).ids


def held_out(doc) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def language_model(docs, discount=0.75, least=2):
    """Rows of n_tokens, n_known, train tokens, base and trigram scores."""
    end = "\n end"
    texts = [words(lower(t)) + [end] for _, t in docs]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for (doc, _), w in zip(docs, texts):
        if not held_out(doc):
            one.update(w)
            two.update(zip([end, *w], w))
            three.update(zip([end, *w], w, w[1:]))
    total, size = sum(one.values()), len(one)
    given2, given3 = collections.Counter(), collections.Counter()
    for (a, _), n in two.items():
        given2[a] += (n - discount) / one[a] if n >= least else 0
    for (a, b, _), n in three.items():
        given3[a, b] += (n - discount) / two[a, b] if n >= least else 0

    def p1(w):
        return (one[w] + 0.5) / (total + 0.5 * (size + 1))

    def p2(a, w):
        seen = (two[a, w] - discount) / one[a] if two[a, w] >= least else 0
        return seen + max(1 - given2[a], 1e-4) * p1(w)

    def p3(a, b, w):
        if two[a, b] < least:
            return p2(b, w)
        seen = (three[a, b, w] - discount) / two[a, b] if three[a, b, w] >= least else 0
        return seen + max(1 - given3[a, b], 1e-4) * p2(b, w)

    out = []
    for (doc, _), w in zip(docs, texts):
        all_ = [end, *w]
        score = math.log10(p2(all_[0], all_[1])) + sum(math.log10(p3(*all_[i : i + 3])) for i in range(len(all_) - 2))
        base = sum(math.log10(p1(x)) for x in w)
        out.append((doc, len(w), sum(x in one for x in w), total, base, score))
    return out
