"""Exact similarity join of texts by their sets of five-word shingles.

A text is the set of its distinct shingles (64-bit hashes); two texts link when
the Jaccard similarity of their sets is at least ``PART / WHOLE``.  Texts of one
set are one node, named by 64 bits of it, and meet as such only.

Shingles have one global order, rare ones first: by the documents that hold
their cell of a count sketch, then by hash.  The sketch has a fixed size and
covers all documents; any order gives the same links, a rarer prefix gives fewer
candidates.  Two linked sets share a shingle of both their prefixes, and at the
first shared one the rest of both is long enough (position filter), as are the
sets (length filter).  Buckets are the nodes of one prefix shingle.

Links are needed as far as they join components.  A star round verifies every
node with the heads of its buckets (a head holds the shingle earliest), which
joins a large group in rows that grow with its size.  After that only nodes of different
components meet, in blocks of a bucket: pairs that pass the filters, the suffix
filter included (sizes of 256 ranges of both sets bound their difference), are
verified best first, and components are merged in between.  Nothing is capped:
the last round takes all pairs that are left.

Null, empty and white-space texts have no shingles, link with nothing and keep
their own id; a text of fewer words than a shingle is one shingle.  Repeated
rows are copies of each other.  A null id takes part and is never the smallest,
unless all ids of its component are null.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.operators.connected import components
from attestry.session import stored

SHINGLE = 5
# Least similarity, as a fraction.
PART, WHOLE = 4, 5
# Cells of the count sketch, and bits of the suffix filter's ranges.
CELL_BITS = 18
RANGE_BITS = 8
# Documents of a cell from which on its shingles are dealt to several tasks.
CROWD = 100_000
# Nodes of a bucket that meet in one unit of work.
BLOCK = 1024
# Rows of keys that are broadcast (24 bytes each); beyond, the join shuffles.
CARRIED = 1_000_000
# Members verified against one copy of a hub's set.
MEMBERS = 256
# Most candidates of a node in a unit, round by round; the last takes all that are left.
ROUNDS = (16, 512, None)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the texts' borders among them."""
    found = words.find(words.LOWER[data], offsets, ~words.SPACE)
    counts, hashes, owner = found.counts, found.hashes(), found.owner()
    at = np.flatnonzero(found.inside(SHINGLE))
    values, texts = [words.gram_hashes(hashes, SHINGLE)[at]], [owner[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            values.append(words.gram_hashes(hashes, n)[found.first[short]])
            texts.append(short)
    values, texts = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = frames.starts_of(texts, values)
    return values[new], np.searchsorted(texts[new], np.arange(len(offsets)))


def _nodes(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values), dtype=np.uint64)])
    return words.mix((sums[cuts[1:]] - sums[cuts[:-1]]) + np.diff(cuts).astype(np.uint64)).view(np.int64)


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def marked(docs: DataFrame, text: str) -> DataFrame:
    """The rows with ``node`` and ``n_shingles`` in place of the text; null nodes have no shingles."""

    def compute(batch, data, offsets):
        values, cuts = shingle_sets(data, offsets)
        size = np.diff(cuts)
        return {"node": pa.array(_nodes(values, cuts), mask=size == 0), "n_shingles": pa.array(size)}

    return frames.with_columns(docs, compute, "node long, n_shingles long", text).drop(text)


def _frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Documents of each cell of the sketch: a fixed number of sums."""

    def count(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, data, offsets in words.runs(batch, text):
                cells += np.bincount(_cells(shingle_sets(data, offsets)[0]), minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    rows = frames.map_texts(docs.select(text), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << CELL_BITS, np.int64)
    found = rows.toArrow()
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(docs: DataFrame, text: str, frequencies: np.ndarray) -> DataFrame:
    """(token, node, place) of the prefix shingles that more than one set may hold.

    A place is the position in rare-first order, then the size.  Rows are sorted
    by shingle, and one that stands alone is left out; a row that repeats its
    neighbour is a copy's.  Shingles of cells far above the others are dealt to
    several tasks by node and kept.
    """
    deal = np.maximum(1, frequencies // max(CROWD, 4 * int(frequencies.mean())))
    shared = docs.sparkSession.sparkContext.broadcast((frequencies, deal))

    def task(batches):
        rank, parts = shared.value
        for batch in batches:
            for _, data, offsets in words.runs(batch, text):
                values, cuts = shingle_sets(data, offsets)
                size, node = np.diff(cuts), _nodes(values, cuts)
                owner = np.repeat(np.arange(len(size)), size)
                values = values[np.lexsort((values, rank[_cells(values)], owner))]
                pos = np.arange(len(values)) - cuts[:-1][owner]
                keep = pos <= size[owner] - -(-PART * size[owner] // WHOLE)
                owner, values, pos = owner[keep], values[keep], pos[keep]
                crowd = parts[_cells(values)]
                part = np.where(crowd > 1, 1 + (node[owner] & 0x7FFFFFFF) % crowd, 0)
                columns = [values.view(np.int64), part, (pos << 31) | size[owner], node[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "part", "place", "node"])

    rows = frames.map_texts(docs.select(text), task, "token long, part long, place long, node long")
    keys = ["token", "part", "place", "node"]
    return frames.map_texts(rows.repartition("token", "part").sortWithinPartitions(*keys), _together, "token long, node long, size long, pos long")


def _together(batches):
    """Rows of sorted (token, part, place, node) but repeats and those alone with their token; one row is carried."""
    last, linked = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(4)]
        if last is not None:
            columns = [np.concatenate(pair) for pair in zip(last, columns)]
        at = frames.starts_of(columns[0], columns[3])
        token, part, place, node = columns = [c[at] for c in columns]
        met = part > 0
        next_to = token[1:] == token[:-1]
        met[1:] |= next_to
        met[0] |= linked
        last, linked = [c[-1:] for c in columns], bool(met[-1])
        met[:-1] |= next_to
        yield _met(columns, np.flatnonzero(met[:-1]))
    if linked:
        yield _met(last, np.zeros(1, np.int64))


def _met(columns, at: np.ndarray) -> pa.RecordBatch:
    token, _, place, node = (c[at] for c in columns)
    out = [token, node, place & 0x7FFFFFFF, place >> 31]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["token", "node", "size", "pos"])


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """(node, shingles, ranges): the sets, and how many shingles lie in each range of hashes."""

    def compute(batch, data, offsets):
        values, cuts = shingle_sets(data, offsets)
        spans = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts)) << RANGE_BITS
        sizes = np.bincount(
            spans + (values & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64),
            minlength=(len(offsets) - 1) << RANGE_BITS,
        )
        raw = np.minimum(sizes, 0xFF).astype(np.uint8).tobytes()
        width = 1 << RANGE_BITS
        return {
            "shingles": pa.ListArray.from_arrays(cuts.astype(np.int32), values.view(np.int64)),
            "ranges": pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
        }

    return frames.with_columns(docs, compute, "shingles array<long>, ranges binary", text).drop(text)


def _possible(size, pos, other_size, other_pos):
    """Length and position filters of two nodes that share a prefix shingle (columns or arrays)."""
    fits = (PART * size <= WHOLE * other_size) & (PART * other_size <= WHOLE * size)
    need = PART * (size + other_size)
    return fits & ((WHOLE + PART) * (size - pos) >= need) & ((WHOLE + PART) * (other_size - other_pos) >= need)


def _small(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, broadcast where it has at most ``CARRIED`` rows."""
    return F.broadcast(table) if table.count() <= CARRIED else table


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with a column of both their sets, as x and y.

    That of ``a`` is carried once for each part of its pairs, that of ``b`` once
    for each pair, so a hub of many pairs is split.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).alias("part")
    dealt = stored(pairs.join(counts, "a").select(*pairs.columns, part), "join-dealt")
    parts = stored(dealt.select("a", "part").distinct(), "join-parts")
    # the sets stay where they are as long as the pairs are few
    members = sets.select(F.col("node").alias("b"), F.col(column).alias("y")).join(_small(dealt), "b")
    hubs = sets.select(F.col("node").alias("a"), F.col(column).alias("x")).join(_small(parts), "a")
    return members.join(hubs, ["a", "part"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each verified once."""
    both, size = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return _beside(pairs, sets, "shingles").where((WHOLE + PART) * both >= PART * size).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, total) that pass the suffix filter; only their ranges are carried."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (_matrix(batch.column(k)) for k in (3, 4))
            keep = pa.array(_spare(batch.column(2).to_numpy(), one, two) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    met = _beside(pairs, sets, "ranges").select("a", "b", "total", "x", "y")
    return frames.map_texts(met, task, "a long, b long")


def _matrix(ranges: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(ranges.to_pylist()), np.uint8).reshape(len(ranges), -1)


def _spare(total: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Suffix filter, below zero where sets of these ranges cannot be similar enough.

    Of a shared part o: (WHOLE + PART) o >= PART total, and apart <= total - 2 o.
    """
    apart = np.abs(one.astype(np.int16) - two).sum(axis=1)
    return (WHOLE - PART) * total - (WHOLE + PART) * apart


def _meetings(rows) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows that meet in a unit: all small units at once, a large one row by row."""
    low = frames.starts_of(rows["token"], rows["one"], rows["two"])
    high = np.append(low[1:], len(rows["token"]))
    few = high - low <= 16
    out = [_all_pairs(low[few], high[few])] if few.any() else []
    for first, last in zip(low[~few].tolist(), high[~few].tolist()):
        out += [(np.full(last - i - 1, i), np.arange(i + 1, last)) for i in range(first, last - 1)]
    return [(i[keep], j[keep]) for i, j in out for keep in [_met_once(rows, i, j)]]


def _met_once(rows, i, j) -> np.ndarray:
    """Pairs of different labels that pass the filters, in the one unit of their blocks."""
    block, size, pos = rows["block"], rows["size"], rows["pos"]
    keep = (rows["label"][i] != rows["label"][j]) & ((rows["one"][i] == rows["two"][i]) | (block[i] != block[j]))
    return keep & _possible(size[i], pos[i], size[j], pos[j])


def _partnered(batches):
    """Rows of units that may be similar to another one there."""
    for rows in frames.sorted_groups(batches, 3):
        keep = np.zeros(len(rows["token"]), bool)
        for i, j in _meetings(rows):
            keep[i] = keep[j] = True
        names = ["token", "node", "size", "pos"]
        yield pa.RecordBatch.from_arrays([pa.array(rows[n][keep]) for n in names], names=names)


def _crossing(most: int | None):
    """Task over units of a bucket: pairs of different labels by all filters, the ``most`` likely of a node."""

    def task(batches):
        for rows in frames.sorted_groups(batches, 3):
            rows["ranges"] = _matrix(rows["ranges"])
            found = [_likely(rows, i, j, most) for i, j in _meetings(rows)]
            for i, j, more in found:
                columns = [rows["node"][i], rows["node"][j], more]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "more"])

    return task


def _all_pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside each of the spans."""
    places = np.arange(int(high.max()))
    last = np.zeros(len(places), np.int64)
    for k in range(int((high - low).max())):
        inside = low + k < high
        last[(low + k)[inside]] = high[inside]
    follow = np.maximum(last - places - 1, 0)
    one = np.repeat(places, follow)
    return one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(follow) - follow, follow)


def _likely(rows, i, j, most):
    """Pairs that pass the suffix filter; of more than ``most``, all of one i, the likely ones."""
    size, ranges = rows["size"], rows["ranges"]
    spare = _spare(size[i] + size[j], ranges[i], ranges[j])
    i, j, spare = i[spare >= 0], j[spare >= 0], spare[spare >= 0]
    more = np.zeros(len(i), bool)
    if most is not None and len(i) > most and (i == i[0]).all():
        best = np.lexsort((rows["node"][j], -spare))[:most]
        i, j, more = i[best], j[best], np.ones(most, bool)
    return i, j, more


def _units(rows: DataFrame) -> DataFrame:
    """Rows of the buckets of several labels, once for each unit of two blocks that they belong to."""
    buckets = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    mixed = rows.join(buckets.where("lo <> hi").select("token", F.ceil(F.col("n") / BLOCK).alias("blocks")), "token")
    block = mixed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    each = block.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return each.select(
        "token", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"),
        "node", "size", "pos", "label", "block",
    )


def _by_unit(units: DataFrame) -> DataFrame:
    return units.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two")


def _candidate_sets(docs: DataFrame, ids: DataFrame, met: DataFrame, text: str) -> DataFrame:
    """The sets of the nodes that share a prefix shingle, one row each."""
    some = ids.join(met.select("node").distinct(), "node", "left_semi")
    first = some.groupBy("node").agg(F.min(F.struct("__k1", "__k2")).alias("k"))
    chosen = stored(first.select("node", "k.__k1", "k.__k2"), "join-chosen")
    texts = docs.select("__k1", "__k2", text).join(_small(chosen), ["__k1", "__k2"]).select("node", text)
    sets = stored(_sets(texts, text), "join-sets")
    # only repeated rows, of one id and text, have one key
    return sets if sets.count() == chosen.count() else stored(sets.dropDuplicates(["node"]), "join-sets")


def roots(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """(node, root) of the nodes that are not the smallest of their component.

    ``docs`` has ``__k1``, ``__k2`` and the text, ``ids`` (stored) the keys and the node of each row.
    """
    prefixes = stored(_prefixes(docs, text, _frequencies(docs, text)), "join-prefixes")
    units = _by_unit(_units(prefixes.withColumn("label", F.col("node"))))
    met = stored(frames.map_texts(units, _partnered, prefixes.schema).distinct(), "join-met")
    # the head of a bucket holds its shingle earliest
    place = F.shiftleft(F.least("pos", F.lit(1 << 22)), 40).bitwiseOR(F.col("node").bitwiseAND((1 << 40) - 1))
    heads = met.groupBy("token").agg(
        F.min_by("node", place).alias("head"), F.min_by("size", place).alias("head_size"), F.min_by("pos", place).alias("head_pos")
    )
    heads = met.join(heads, "token").where("node <> head")
    heads = heads.where(_possible(*(F.col(c) for c in ("size", "pos", "head_size", "head_pos"))))
    sets = _candidate_sets(docs, ids, met, text)
    total = (F.col("size") + F.col("head_size")).alias("total")
    tried = stored(heads.select(F.col("head").alias("a"), F.col("node").alias("b"), total).distinct(), "join-pairs")
    # ranges are far smaller than sets
    links = stored(_linked(stored(_near(tried, sets), "join-near"), sets), "join-links")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a column of the stored sets, read alone
    ranges = sets.select("node", "ranges")
    found = components(links)
    for most in ROUNDS:
        units = _units(met.join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
        columns = [*units.columns, "ranges"]
        units = _by_unit(units.join(ranges, "node").select(columns))
        pairs = stored(frames.map_texts(units, _crossing(most), "a long, b long, more boolean"), "join-pairs")
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = stored(new.join(tried, ["a", "b"], "left_anti"), "join-pairs")
        links = stored(links.unionByName(_linked(new, sets)), "join-links")
        tried = tried.unionByName(new)
        found = components(links)
        if pairs.where("more").isEmpty():
            break
    return found


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """The rows with 128 bits of id and text, the same for repeated rows."""
    return docs.withColumns({"__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(text, F.lit(1), "doc_id")})


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; a component is named by its smallest id."""
    rows = keyed(docs.select("doc_id", text), text)
    ids = stored(marked(rows, text), "join-ids")
    nodes = ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    found = roots(rows, ids, text)
    named = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(smallest, "root").select("node", "component_id")
    out = ids.join(component, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
