"""The sequential part of an upsert, run on executors: ordered updates over live records."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# Dead rows that may be kept beside the live ones before they are copied out.
SLACK = 4096


class Live:
    """Live records of one linked set: places of rows by key, keys by alternative key."""

    def __init__(self):
        self.places: dict = {}  # key -> (table, row, alternative key)
        self.holders: dict = {}  # alternative key -> heap of keys, dead ones among them

    def _least(self, alt):
        heap = self.holders.get(alt)
        while heap:
            held = self.places.get(heap[0])
            if held is not None and held[2] == alt:
                return heap[0]
            heapq.heappop(heap)
        return None

    def apply(self, key, alt, update: bool, place: tuple) -> None:
        if update and key not in self.places and alt is not None:
            # the record with these alternative keys moves to the new key
            moved = self._least(alt)
            if moved is not None:
                del self.places[moved]
        known = self.places.get(key)
        self.places[key] = (*place, alt)
        if alt is not None and (known is None or known[2] != alt):
            heapq.heappush(self.holders.setdefault(alt, []), key)


def fold(columns: list[str], key: str):
    """``mapInArrow`` task over rows sorted by (__root, __update, order); yields what is left of each set.

    Besides the batch at hand only rows of live records of the set at hand are kept.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, live, tables, ready = None, Live(), [], {}

        def finish() -> None:
            for at, row, _ in live.places.values():
                ready.setdefault(id(tables[at]), (tables[at], []))[1].append(row)

        def compact() -> None:
            parts, moved = [], {}
            for at, table in enumerate(tables):
                mine = [(name, row, alt) for name, (t, row, alt) in live.places.items() if t == at]
                if mine:
                    moved |= {name: (len(parts), i, alt) for i, (name, _, alt) in enumerate(mine)}
                    parts.append(table.take(pa.array([row for _, row, _ in mine], pa.int64())))
            live.places, tables[:] = moved, parts

        for batch in batches:
            own = batch.select(columns)
            tables.append(own)
            roots, keys, alts, updates = (batch.column(c).to_pylist() for c in ("__root", key, "__alt", "__update"))
            for i, now in enumerate(roots):
                if now != root:
                    finish()
                    root, live = now, Live()
                    tables[:] = [own]
                live.apply(keys[i], alts[i], updates[i], (len(tables) - 1, i))
            for table, rows in ready.values():
                yield table.take(pa.array(rows, pa.int64()))
            ready.clear()
            if sum(t.num_rows for t in tables) > 2 * len(live.places) + SLACK:
                compact()
        finish()
        for table, rows in ready.values():
            yield table.take(pa.array(rows, pa.int64()))

    return task


# executors need not have this package on their path
register_pickle_by_value(sys.modules[__name__])
