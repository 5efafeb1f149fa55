"""Arrow plumbing shared by the operators."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestry.llm import tokens, words

# Rows of one Arrow batch, where the session has Spark's default: texts are long.
BATCH_ROWS = 2000
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

# freed batches go back to the machine, which executors and workers share
pa.set_memory_pool(pa.system_memory_pool())


def _give_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, function, schema, vocabularies: bool = False) -> DataFrame:
    """``mapInArrow`` with a bound on the rows of a batch.

    A worker lives on from task to task.  A task that needs no vocabularies
    drops those of earlier ones, and every task gives back what it has freed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not vocabularies:
            tokens.forget()
            _give_back()
        yield from function(batches)
        _give_back()

    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        conf.set(_ROWS_KEY, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def with_columns(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]],
    fields: str | T.StructType,
    text: str = "text",
    vocabularies: bool = False,
    size: int = words.RUN_BYTES,
) -> DataFrame:
    """Append columns computed from runs of whole texts; the input's columns pass through.

    A new column replaces an input column of the same name.
    """
    new = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    taken = {f.name for f in new}
    kept = [f.name for f in df.schema if f.name not in taken]
    schema = T.StructType([f for f in df.schema if f.name in kept] + list(new))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.runs(batch, text, size):
                out = compute(part, data, offsets)
                columns = [part.column(part.schema.get_field_index(n)) for n in kept]
                columns += [out[f.name] for f in new]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_texts(df, apply, schema, vocabularies)


def with_words_sha256(df: DataFrame, text: str, name: str) -> DataFrame:
    """SHA-256 of the words of a text joined by one space."""

    def compute(batch, data, offsets):
        found = words.find(data, offsets, ~words.SPACE)
        plain, low, high = words.joined(found)
        out = []
        for first, last in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            out.append(hashlib.sha256(plain[low[first] : high[last - 1]] if last > first else b"").hexdigest())
        return {name: pa.array(out, pa.string())}

    return with_columns(df, compute, f"{name} string", text)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of rows sorted by their first ``keys`` columns, no key cut in two.

    Yields column arrays that hold one or more complete keys; a key larger than
    a batch is put together first.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            differs |= values != values[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if held:
            last = held[-1]
            same = all(
                last.column(k)[last.num_rows - 1].as_py() == batch.column(k)[batch.num_rows - 1].as_py()
                for k in range(keys)
            )
            if cut == 0 and same:
                held.append(batch)
                continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield _arrays(held)
        held = [batch.slice(cut)]
    if held:
        yield _arrays(held)


def _arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    out = {}
    for name in table.column_names:
        column = table.column(name)
        fixed = pa.types.is_primitive(column.type)
        out[name] = column.to_numpy() if fixed else column.combine_chunks()
    return out


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys, in rows sorted by them."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
