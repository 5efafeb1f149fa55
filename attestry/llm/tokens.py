"""Public vocabularies, applied once per distinct word and looked up for the rest.

The vocabularies used here never join pieces across white space, so a text's
ids are its words' ids in order (``tests/llm`` holds this against whole texts).
Each Python worker keeps the words that it has met, up to ``CACHE_WORDS``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

from attestry.llm import words

# Distinct words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 800_000

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_TAIL = np.zeros(256, bool)
_TAIL[np.frombuffer(b",.;:!?", np.uint8)] = True


def resolve(name: str) -> str:
    """A path as it is, or the place of a public vocabulary on this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def units(data: np.ndarray, offsets: np.ndarray) -> words.Words:
    """Words for a lower-casing vocabulary that splits letters from punctuation.

    Capitals become small and one closing mark after a letter becomes a unit of
    its own, which leaves fewer distinct units and the same ids.  Texts that
    could hold a control token, which is told apart by case, stay as they are.
    """
    if b"<|" not in data.tobytes():
        data = words.LOWER[data]
    found = words.find(data, offsets, ~words.SPACE)
    if not len(found.start):
        return found
    long = found.end - found.start > 1
    tail = long & _TAIL[data[found.end - 1]] & _LETTER[data[np.maximum(found.end - 2, 0)]]
    place = np.arange(len(tail)) + np.cumsum(tail) - tail
    total = len(tail) + int(tail.sum())
    start, end = np.empty(total, np.int64), np.empty(total, np.int64)
    start[place], end[place] = found.start, found.end - tail
    start[place[tail] + 1], end[place[tail] + 1] = found.end[tail] - 1, found.end[tail]
    first = np.append(place, total)[found.first]
    return words.Words(data, offsets, start, end, first)


@dataclass
class Encoded:
    """Ids of units: those of unit i are ``ids[at[i]:at[i] + size[i]]``."""

    ids: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def flat(self) -> np.ndarray:
        """All ids in text order."""
        total = int(self.size.sum())
        before = np.cumsum(self.size) - self.size
        return self.ids[np.arange(total) + np.repeat(self.at - before, self.size)]


class Vocabulary:
    """Word-wise encoder with a memory of words met."""

    def __init__(self, name: str):
        path = resolve(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            batch = getattr(model, "encode_batch_fast", model.encode_batch)
            self.encode = lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]
            self.is_byte = np.zeros(model.get_vocab_size(), bool)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.uint32)
        # short ids where they fit: every worker holds these arrays
        self.ids = np.zeros(0, np.uint16 if len(self.is_byte) <= 1 << 16 else np.uint32)

    def __call__(self, found: words.Words, hashes: np.ndarray) -> Encoded:
        keys, one, each = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            fresh = self.encode(found.strings(one[~known]))
            size = np.fromiter(map(len, fresh), np.int64, len(fresh))
            ids = np.fromiter((i for row in fresh for i in row), self.ids.dtype, int(size.sum()))
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            self.keys = np.insert(self.keys, place[~known], keys[~known])
            self.at = np.insert(self.at, place[~known], at)
            self.size = np.insert(self.size, place[~known], size)
            place = np.searchsorted(self.keys, keys)
        place = place[each]
        return Encoded(self.ids, self.at[place].astype(np.int64), self.size[place].astype(np.int64))


_open: dict[str, Vocabulary] = {}


def forget() -> None:
    """Drop the worker's vocabularies."""
    _open.clear()


def vocabulary(name: str) -> Vocabulary:
    """The worker's copy of a vocabulary."""
    if name not in _open:
        _open[name] = Vocabulary(name)
    return _open[name]
