"""Language-model scores of whole texts from an Elias-Fano n-gram trie.

The model is an interpolated n-gram model with absolute discounting: a seen
n-gram keeps its count less ``DISCOUNT``, and what a context does not give to
kept n-grams goes to the next shorter context, down to word frequencies with
half a count added.  N-grams of two words and more are kept from ``least``
occurrences on, counted over the whole training corpus; a longer n-gram can only
reach that count if its parts do, so only those are counted at all.  The query
keeps all of them (``least`` 1); ``LEAST`` is the default of a direct call.

Counting is pre-aggregated in each task; counted n-grams go to the task of their
shard once for each level, as packed columns, and are added there.  Tasks build
the trie's shards (``ngram_trie``) and scoring tasks map them.  The model grows with
the corpus.  Frequent n-grams are one row per task, so there is no hot key.

Null and empty texts are one end token.  A null id counts as the empty string,
which is a training id.  Repeated rows are counted and scored each.  Without
training texts every token has probability 1.  Extra columns pass through,
clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.llm.ngram_trie import STEP, Shape, coded, decoded, elias_fano, opened, save
from attestry.session import shared_dir, stored

ORDER = 3
LEAST = 2
DISCOUNT = 0.75
# Items of a level in one shard.
SHARD = 400_000
# N-grams of a shard of a longer level, about.
GRAMS = 1_000_000

# N-grams that a task holds before it counts them.
HELD = 2_000_000

# Bytes of text whose n-grams are counted and looked up at once.
RUN_BYTES = 3_000_000

END_HASH = np.uint64(0x5DEECE66D2B79F11)


def held_out(doc_id: str = "doc_id") -> Column:
    """One of five documents, by checksum of its id."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each token's place among them, and the texts' borders; ends included."""
    found = words.find(words.LOWER[data], offsets, ~words.SPACE)
    texts = len(offsets) - 1
    hashes = np.full(len(found.start) + texts, END_HASH, np.uint64)
    hashes[np.arange(len(found.start)) + found.owner()] = found.hashes()
    first = found.first + np.arange(texts + 1)
    distinct, each = np.unique(hashes, return_inverse=True)
    return distinct, each, first


def _contexts(first: np.ndarray, total: int) -> np.ndarray:
    """Place of the token before, -1 at the start of a text."""
    before = np.arange(total) - 1
    before[first[:-1]] = -1
    return before


def _pairs(trie, end: int, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context word: the one before, or the end mark at a text's start."""
    before = _contexts(first, len(ids))
    return np.where(before >= 0, ids[before], end), before


def _end_id(trie) -> int:
    return int(trie.words(np.array([END_HASH]))[0][0])


def _distinct(contexts: np.ndarray, nexts: np.ndarray):
    """Distinct (context, word) pairs in order, each row's place among them, and their counts."""
    if not len(contexts) or max(contexts.max(), nexts.max()) < 1 << 32:
        packed = contexts.astype(np.uint64) << np.uint64(32) | nexts.astype(np.uint64)
        pairs, each, n = np.unique(packed, return_inverse=True, return_counts=True)
        return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), each, n
    order = np.lexsort((nexts, contexts))
    cut = frames.starts_of(contexts[order], nexts[order])
    n = np.diff(np.append(cut, len(order)))
    each = np.empty(len(order), np.int64)
    each[order] = np.repeat(np.arange(len(cut)), n)
    return contexts[order][cut], nexts[order][cut], each, n


def _lookup(trie, level: int, contexts: np.ndarray, nexts: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Items of the pairs where both sides are known; equal pairs are looked up once."""
    out = np.full(len(contexts), -1, np.int64)
    at = np.flatnonzero(ok & (contexts >= 0) & (nexts >= 0))
    if len(at):
        c, w, each, _ = _distinct(contexts[at], nexts[at])
        out[at] = trie.find(level, c, w)[each]
    return out


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns.values()], names=list(columns))


# Rows of n-grams between tasks: those of one shard, as columns of bytes.
GRAM_ROWS = "shard long, size long, context binary, word binary, n binary"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, first bytes together, then second ones."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(np.int64)


class _Counter:
    """N-grams of a task, counted and cut by shard whenever enough have come together."""

    def __init__(self, per: int):
        self.per, self.held, self.size = per, [], 0

    def add(self, contexts: np.ndarray, nexts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((contexts, nexts))
        self.size += len(contexts)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        context, word, _, n = _distinct(*(np.concatenate(c) for c in zip(*self.held)))
        self.held, self.size = [], 0
        shard = context // self.per
        rows = []
        for low, high in _runs(shard):
            local = context[low:high] - shard[low] * self.per
            parts = (np.diff(local, prepend=0), word[low:high], n[low:high])
            rows.append((int(shard[low]), high - low, *map(_packed, parts)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "size", "context", "word", "n"])


def _summed(rows, per: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, n) of one shard, in order, equal n-grams added."""
    columns = []
    for size, *parts in zip(rows["size"].tolist(), *(rows[k].to_pylist() for k in ("context", "word", "n"))):
        local, word, n = (_unpacked(raw, size) for raw in parts)
        columns.append((np.cumsum(local), word, n))
    local, word, n = (np.concatenate(c) for c in zip(*columns))
    local, word, each, _ = _distinct(local, word)
    total = np.bincount(each, n, len(local)).astype(np.int64)
    keep = total >= least
    return local[keep] + int(rows["shard"][0]) * per, word[keep], total[keep]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in words.runs(batch, batch.schema.names[0], RUN_BYTES):
            distinct, each, _ = _tokens(data, offsets)
            yield _batch({"hash": distinct.view(np.int64), "n": np.bincount(each, minlength=len(distinct))})


def _grams_of(shape: Shape, level: int, least: int):
    """Pairs (item of the level above, word) whose parts are frequent enough, counted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counter = opened(shape), _Counter(shape.per[level - 2])
        end = _end_id(trie)
        for batch in batches:
            for _, data, offsets in words.runs(batch, batch.schema.names[0], RUN_BYTES):
                distinct, each, first = _tokens(data, offsets)
                known, counts = trie.words(distinct)
                ids, often = known[each], counts[each] >= least
                left, before = _pairs(trie, end, ids, first)
                ok = often & np.where(before >= 0, often[before], True)
                if level == 2:
                    yield from counter.add(left[ok], ids[ok])
                    continue
                pairs = _lookup(trie, 2, left, ids, ok)
                context = np.where(before >= 0, pairs[before], -1)
                ok = (context >= 0) & (pairs >= 0)
                yield from counter.add(context[ok], ids[ok])
        yield from counter.flush()

    return run


def _shards(sizes: dict[int, int], count: int) -> list[int]:
    return [sizes.get(i, 0) for i in range(count)]


def _first_level(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in frames.sorted_groups(batches, 1):
            for low, high in _runs(group["shard"]):
                shard = int(group["shard"][low])
                keys = group["hash"][low:high].view(np.uint64)
                order = np.argsort(keys)
                save(folder, f"keys-{shard}", keys[order])
                save(folder, f"count1-{shard}", _narrow(group["n"][low:high][order]))
                yield _batch({"shard": np.array([shard]), "size": np.array([high - low])})

    return run


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = frames.starts_of(keys)
    return list(zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist()))


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def _unigram(shape: Shape, counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (shape.tokens + 0.5 * (shape.vocabulary + 1))


def _next_level(shape: Shape, level: int, least: int, last: bool):
    """Write the shards of a level from its packed rows, sorted by shard; the last level needs no counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(shape)
        per = shape.per[level - 2]
        above = int(trie.bases[level - 2][-1])
        for group in frames.sorted_groups(batches, 1):
            for low, high in _runs(group["shard"]):
                shard = int(group["shard"][low])
                context, word, n = _summed({k: v[low:high] for k, v in group.items()}, per, least)
                if not len(n):
                    continue
                contexts = min(per, above - shard * per)
                local = context - shard * per
                totals = trie.column("count", level - 1, np.arange(contexts) + shard * per).astype(float)
                share = (n - DISCOUNT) / totals[local]
                given = np.bincount(local, share, contexts)
                weight = np.maximum(1 - given, 10.0**-4)
                if level == 2:
                    shorter = _unigram(shape, trie.column("count", 1, word))
                else:
                    middle = trie.column("word", 2, context)
                    pair = _lookup(trie, 2, middle, word, np.ones(len(word), bool))  # kept: a part of a kept n-gram
                    shorter = 10 ** decoded(trie.column("prob", 2, pair))
                logs = np.log10(share + weight[local] * shorter)
                folder = shape.folder
                borders = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=contexts))])
                for part, array in elias_fano(borders).items():
                    save(folder, f"borders{level}-{shard}-{part}", array)
                save(folder, f"word{level}-{shard}", _narrow(word))
                save(folder, f"prob{level}-{shard}", coded(logs))
                save(folder, f"weight{level}-{shard}", coded(np.log10(weight)))
                if not last:
                    save(folder, f"count{level}-{shard}", _narrow(n))
                yield _batch({"shard": np.array([shard]), "size": np.array([len(n)])})

    return run


def train(texts: DataFrame, order: int = ORDER, least: int = LEAST, shard: int = SHARD) -> Shape:
    """Build a trie from a column of texts; returns its shape, a few numbers for each shard."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = texts.sparkSession
    folder = shared_dir(spark, "trie")
    vocabulary = stored(
        frames.map_texts(texts, _words_of, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "vocabulary"
    )
    size, total = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    bits = max(1, (size // shard).bit_length())
    first = vocabulary.withColumn("shard", F.shiftrightunsigned("hash", 64 - bits))
    shape = Shape(folder, total or 0, bits, [], [])
    written = _written(first.select("shard", "hash", "n"), _first_level(folder))
    shape.sizes.append(_shards(written, 1 << bits))
    for level in range(2, order + 1):
        above = sum(shape.sizes[-1])
        # as many shards as the level above or as the n-grams may need, at the least one context each
        shards = max(len([s for s in shape.sizes[-1] if s] or [0]), -(-shape.tokens // GRAMS))
        shape.per.append(max(1, -(-above // shards)))
        rows = frames.map_texts(texts, _grams_of(shape, level, least), GRAM_ROWS)
        written = _written(rows, _next_level(shape, level, least, level == order))
        shape.sizes.append(_shards(written, max(1, -(-above // shape.per[-1]))))
    return shape


def _written(rows: DataFrame, write) -> dict[int, int]:
    """Sizes of the shards that tasks have written, each from its own rows."""
    parts = rows.repartition("shard").sortWithinPartitions("shard")
    return {r.shard: r.size for r in frames.map_texts(parts, write, "shard long, size long").collect()}


def score(docs: DataFrame, shape: Shape, text: str = "text") -> DataFrame:
    """Documents with token counts, the base score and the model's log10 probability."""

    def compute(batch, data, offsets):
        trie = opened(shape)
        end = _end_id(trie)
        distinct, each, first = _tokens(data, offsets)
        known, counts = trie.words(distinct)
        base = np.log10(_unigram(shape, counts))[each]
        ids = known[each]
        left, before = _pairs(trie, end, ids, first)
        logs = base.copy()
        items = _lookup(trie, 2, left, ids, np.ones(len(ids), bool))
        at = np.flatnonzero(left >= 0)
        logs[at] -= trie.backoff(2, left[at]) / STEP
        at = np.flatnonzero(items >= 0)
        logs[at] = decoded(trie.column("prob", 2, items[at]))
        if len(shape.sizes) > 2:
            context = np.where(before >= 0, items[before], -1)
            longer = _lookup(trie, 3, context, ids, np.ones(len(ids), bool))
            at = np.flatnonzero(context >= 0)
            logs[at] -= trie.backoff(3, context[at]) / STEP
            at = np.flatnonzero(longer >= 0)
            logs[at] = decoded(trie.column("prob", 3, longer[at]))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        texts = len(first) - 1
        return {
            "n_tokens": pa.array(np.diff(first)),
            "n_known": pa.array(np.bincount(owner, counts[each] > 0, texts).astype(np.int64)),
            "train_tokens": pa.array(np.full(texts, shape.tokens)),
            "base_score": pa.array(np.bincount(owner, base, texts)),
            "score": pa.array(np.bincount(owner, logs, texts)),
        }

    fields = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return frames.with_columns(docs, compute, fields, text, size=RUN_BYTES)


def score_corpus(
    docs: DataFrame, text: str = "text", order: int = ORDER, shard: int = SHARD, least: int = LEAST
) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    marked = docs.withColumn("held_out", held_out())
    shape = train(marked.where("not held_out").select(text), order, least, shard)
    return score(marked, shape, text)
