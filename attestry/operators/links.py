"""The sequential part of a hash chain, run on executors."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value


def link(previous: str | None, sequence: int, body_digest: str) -> str:
    return hashlib.sha256(f"{previous or ''}:{sequence}:{body_digest}".encode()).hexdigest()


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by session and sequence, carrying only the last hash."""
    session, previous = None, None
    for rows in batches:
        before, after = [], []
        for current, sequence, body in zip(rows["session_id"], rows["sequence"], rows["body_digest"]):
            if current != session:
                session, previous = current, None
            before.append(previous)
            previous = link(previous, sequence, body)
            after.append(previous)
        yield pd.DataFrame(
            {"event_id": rows["event_id"], "previous_event_hash": before, "evidence_hash": after}
        )


# executors need not have this package on their path
register_pickle_by_value(sys.modules[__name__])
