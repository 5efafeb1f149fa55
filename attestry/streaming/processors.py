"""Keyed-state processors, run on executors.

Rows of one key arrive in any order inside a micro-batch and are sorted there;
the micro-batch itself is bounded by the source's trigger options.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _sorted(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """Rows of one key in order of their first columns: chunks are sorted one by one and merged."""
    by = len(columns)
    chunks = [
        sorted(zip(*[chunk[c].tolist() for c in columns]), key=lambda r: r[:2]) for chunk in rows if by and len(chunk)
    ]
    return heapq.merge(*chunks, key=lambda r: r[:2])


class EvidenceLog(StatefulProcessor):
    """Session state machine: (next sequence, last hash, closed)."""

    def __init__(self, allowed: list[str]):
        self.allowed = set(allowed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "sequence int, head string, closed boolean")

    def _refusal(self, kind: str, sequence: int, closed: bool, by_close: bool, refused: str | None) -> str | None:
        if kind not in self.allowed:
            return "type_unknown"
        if closed:
            return "after_close"
        if kind == "session_started" and sequence > 0:
            return "second_start"
        if kind == "session_closed" and not by_close:
            return "close_reserved"
        return refused if isinstance(refused, str) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.session.get()
        sequence, head, closed = stored if stored else (0, None, False)
        out = []
        for _, event_id, kind, body, by_close, refused in _sorted(
            rows, "at", "event_id", "event_type", "body_digest", "by_close", "refused"
        ):
            reason = self._refusal(kind, sequence, closed, bool(by_close), refused)
            if reason:
                out.append((key[0], event_id, False, reason, None, None, None))
                continue
            sequence += 1
            text = f"{head or ''}:{sequence}:{body}"
            before, head = head, hashlib.sha256(text.encode()).hexdigest()
            closed = kind == "session_closed"
            out.append((key[0], event_id, True, None, sequence, before, head))
        self.session.update((sequence, head, closed))
        frame = pd.DataFrame(
            out,
            columns=[
                "session_id", "event_id", "accepted", "reason", "sequence", "previous_event_hash", "evidence_hash",
            ],
        )
        frame["sequence"] = frame["sequence"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    """Emit a changed signature once it has stayed for the debounce time.

    State: (signature, since, last emitted signature, waiting); times are in
    microseconds, timers in milliseconds of event time.  A waiting key has one
    timer, that of its state, so changes inside a micro-batch set none.
    """

    def __init__(self, debounce_us: int):
        self.debounce_us = debounce_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.project = handle.getValueState(
            "project", "signature string, since bigint, emitted string, waiting boolean"
        )

    def _due(self, since: int) -> int:
        # first whole millisecond at which the signature has been stable long enough
        return -(-(since + self.debounce_us) // 1000)

    def _row(self, key, since: int, signature: str) -> tuple:
        return (key[0], since, since + self.debounce_us, signature)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["project", "changed_at", "emitted_at", "signature"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.project.get()
        signature, since, emitted, waiting = stored if stored else (None, 0, None, False)
        timer = self._due(since) if waiting else None
        out = []
        for at, _, seen in _sorted(rows, "at", "event_id", "signature"):
            at = int(at)
            if signature is None:
                signature, since, emitted, waiting = seen, at, seen, False
                continue
            if seen == signature:
                continue
            if waiting and at - since >= self.debounce_us and signature != emitted:
                out.append(self._row(key, since, signature))
                emitted = signature
            signature, since, waiting = seen, at, True
        due = self._due(since) if waiting else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.project.update((signature, since, emitted, waiting))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        signature, since, emitted, waiting = self.project.get()
        out = []
        if waiting and expiredTimerInfo.getExpiryTimeInMs() == self._due(since):
            if signature != emitted:
                out.append(self._row(key, since, signature))
                emitted = signature
            self.project.update((signature, since, emitted, False))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


class StableExport(StatefulProcessor):
    """Emit a file once, when size and time of change stayed for the stability time."""

    def __init__(self, stability_us: int):
        self.stability_us = stability_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "size bigint, changed bigint, since bigint, emitted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.file.get()
        size, changed, since, emitted = stored if stored else (None, None, 0, False)
        out = []
        for at, _, now_size, now_changed in _sorted(rows, "at", "event_id", "size", "changed"):
            at, now_size, now_changed = int(at), int(now_size), int(now_changed)
            if (now_size, now_changed) != (size, changed):
                size, changed, since = now_size, now_changed, at
            if not emitted and size > 0 and at - since >= self.stability_us:
                emitted = True
                out.append((key[0], at, size))
        self.file.update((size, changed, since, emitted))
        if out:
            yield pd.DataFrame(out, columns=["path", "emitted_at", "size"])

    def close(self) -> None:
        pass


class ProjectSession(StatefulProcessor):
    """Reuse a project's session while it records; else start a new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.project = handle.getValueState("project", "started bigint, recording boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.project.get()
        started, recording = stored if stored else (0, False)
        out = []
        for at, event_id, closes in _sorted(rows, "at", "event_id", "closes"):
            if closes:
                recording = False
                continue
            reused = recording
            if not recording:
                started, recording = int(at), True
            out.append((key[0], event_id, started, reused))
        if recording:
            self.project.update((started, recording))
        else:  # a closed project starts anew, so nothing has to be kept
            self.project.clear()
        if out:
            yield pd.DataFrame(out, columns=["project_key", "event_id", "session_started", "reused"])

    def close(self) -> None:
        pass


class Registration(StatefulProcessor):
    """The first submission of an identity registers it; its id is the state."""

    def __init__(self, id_column: str):
        self.id_column = id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.registered = handle.getValueState("registered", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.registered.get()
        known = stored[0] if stored else None
        kept = []
        for chunk in rows:
            kept.append(chunk[self.id_column])
        if known is None:
            known = min(int(ids.min()) for ids in kept)
            self.registered.update((known,))
        for ids in kept:
            yield pd.DataFrame(
                {self.id_column: ids, "asset_uid": key[0], "registered_id": known, "registration_reused": ids != known}
            )

    def close(self) -> None:
        pass


# executors need not have this package on their path
register_pickle_by_value(sys.modules[__name__])
