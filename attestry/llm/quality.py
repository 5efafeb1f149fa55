"""Quality rules on how public vocabularies break a text.

Readable text of a language gives tokens of a typical length, few byte
fallbacks and many different tokens.  Encoded blobs, wrong decodings, keyboard
noise and loops leave these bands.  Counts come from whole texts, word by word;
there is no shuffle, so no source or group of copies can be hot.

Null, empty and white-space texts have no words and fail the base rule; their
measures are 0.  Unknown or null languages take the band of the text's script,
judged by its non-ASCII share.  Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import frames, tokens, words
from attestry.session import stored

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Band:
    """Limits of characters per piece and per token, of the share of byte pieces, of bits per piece."""

    piece_low: float
    piece_high: float
    token_low: float
    token_high: float
    fallback: float
    entropy: float


@dataclass(frozen=True)
class Fitted:
    """A band fitted on labelled rows, inside a wide one.

    Characters per piece and per token are means over a text's words, so they
    scatter with the root of their number: the limits are a centre and the
    deviations below and above it times that root.  ``longest`` bounds the number
    of words, as no sample says more about longer texts.  ``share`` is the
    weight of the fitted limits against the wide ones.
    """

    wide: Band
    share: float
    longest: int
    piece: tuple[float, float, float]
    token: tuple[float, float, float]
    fallback: float
    entropy: float


# Bands by language, then by script for other languages, where no labelled rows
# say better.  They are wide: prose lies well inside, blobs and loops outside.
LANGUAGE_BANDS = {
    "en": Band(1.3, 8.0, 1.3, 8.0, 0.10, 3.0),
    "de": Band(1.2, 8.0, 1.2, 8.0, 0.12, 3.0),
    "fr": Band(1.2, 8.0, 1.2, 8.0, 0.12, 3.0),
    "es": Band(1.2, 8.0, 1.2, 8.0, 0.12, 3.0),
}
SCRIPT_BANDS = {
    "latin": Band(1.1, 9.0, 1.0, 9.0, 0.20, 3.0),
    "other": Band(0.2, 9.0, 0.1, 9.0, 0.90, 2.5),
}
# Share of non-ASCII letters from which a text counts as another script.
OTHER_SCRIPT_SHARE = 0.5

# Bound of the labelled sample of each language that bands are fitted on, the
# steps of its hash scale for each halving, and the ids up to which it is broadcast.
FIT_ROWS = 5_000
FIT_STEPS = 8
FIT_BROADCAST = 200_000
# A fitted band reaches beyond the clean rows' ends by this share of its half width.
FIT_MARGIN = 0.2
# The same for the ends of the byte share and the entropy, which have one side.
SIDE_MARGIN = 0.02
# Rows at which a language's band lies half-way between its wide band and the fitted one.
FIT_HALF = 4

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_pieces long, chars_per_token double, chars_per_piece double, fallback_share double, "
    "token_entropy double, other_script boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _duplicates(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value is met again in its text, and per text the values met before."""
    keys = words.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    later = np.bincount(owner[again], minlength=texts)
    again[order[:-1][same]] = True
    return again, later


def _entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits per token of each text's own token counts."""
    counts = np.diff(first)
    texts = len(counts)
    owner = np.repeat(np.arange(texts, dtype=np.int64), counts)
    keys = np.sort((owner << 20) | ids.astype(np.int64))
    cut = frames.starts_of(keys)
    n = np.diff(np.append(cut, len(keys))).astype(float)
    total = np.bincount(keys[cut] >> 20, n * np.log2(n), texts)
    size = np.maximum(counts, 1)
    return np.maximum(np.log2(size) - total / size, 0.0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Word counts, repetition and fertility of each whole text."""

    def compute(batch, data, offsets):
        texts = len(offsets) - 1
        found = words.find(data, offsets, ~words.SPACE)
        hashes, owner = found.hashes(), found.owner()
        on = ~words.SPACE[data]
        letters = on & ((data & 0xC0) != 0x80)
        word_chars = words.per_text(letters, offsets)
        wide = words.per_text(letters & (data >= 0x80), offsets)

        inside = found.inside(3)
        grams = words.gram_hashes(hashes, 3)[inside]
        at = np.flatnonzero(inside)
        again, _ = _duplicates(owner[at], grams, texts)
        repeated = words.covered(at[again], 3, len(hashes))

        line_ends = data == 0x0A
        edges = np.union1d(np.flatnonzero(line_ends), offsets)
        low, high = edges[:-1], edges[1:]
        low = low + line_ends[np.minimum(low, max(len(data) - 1, 0))] if len(data) else low
        filled = np.searchsorted(found.start, high) > np.searchsorted(found.start, low)
        low, high = low[filled], high[filled]
        line_owner = np.searchsorted(offsets, low, side="right") - 1
        _, dup_lines = _duplicates(line_owner, words.span_hashes(data, low, high), texts)

        units = tokens.units(data, offsets)
        plain = tokens.vocabulary(WORD_VOCABULARY)(units, units.hashes())
        n_tokens = words.per_text(plain.size, units.first)
        vocabulary = tokens.vocabulary(PIECE_VOCABULARY)
        pieces = vocabulary(found, hashes)
        ids = pieces.flat()
        before = np.concatenate([[0], np.cumsum(pieces.size)])[found.first]
        n_pieces = np.diff(before)
        fallback = words.per_text(vocabulary.is_byte[ids], before)
        out = {
            "n_words": found.counts,
            "word_chars": word_chars,
            "n_symbols": words.per_text(_SYMBOL[data], offsets),
            "n_dup_lines": dup_lines,
            "n_repeat_words": words.per_text(repeated, found.first),
            "n_tokens": n_tokens,
            "n_pieces": n_pieces,
            "chars_per_token": word_chars / np.maximum(n_tokens, 1),
            "chars_per_piece": word_chars / np.maximum(n_pieces, 1),
            "fallback_share": fallback / np.maximum(n_pieces, 1),
            "token_entropy": _entropy(ids, before),
            "other_script": wide > OTHER_SCRIPT_SHARE * np.maximum(word_chars, 1),
        }
        return {k: pa.array(v) for k, v in out.items()}

    return frames.with_columns(docs, compute, FIELDS, text, vocabularies=True)


def _root(longest: int):
    """Square root of the number of words, as far as fitted texts go."""
    return F.sqrt(F.greatest(F.least("n_words", F.lit(longest)), F.lit(1)))


def _within(band: Band | Fitted):
    if isinstance(band, Band):
        return (
            F.col("chars_per_piece").between(band.piece_low, band.piece_high)
            & F.col("chars_per_token").between(band.token_low, band.token_high)
            & (F.col("fallback_share") <= band.fallback)
            & (F.col("token_entropy") >= band.entropy)
        )
    blend = lambda fitted, wide: F.lit(band.share) * fitted + F.lit((1 - band.share) * wide)
    root, wide = _root(band.longest), band.wide
    near = lambda name, at, low, high: F.col(name).between(
        blend(at[0] + at[1] / root, low), blend(at[0] + at[2] / root, high)
    )
    return (
        near("chars_per_piece", band.piece, wide.piece_low, wide.piece_high)
        & near("chars_per_token", band.token, wide.token_low, wide.token_high)
        & (F.col("fallback_share") <= blend(F.lit(band.fallback), wide.fallback))
        & (F.col("token_entropy") >= blend(F.lit(band.entropy), wide.entropy))
    )


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, lang) of at most ``rows`` good documents of each language, those with the smallest hashes.

    Hashes are counted by steps of a geometric scale, a few hundred for each
    language, and all steps that fit are taken; no language is sorted in one task.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    spoken = docs.select("doc_id", "lang").where("lang is not null").join(good, "doc_id", "left_semi").distinct()
    small = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)) + F.lit(1.0)
    known = stored(spoken.withColumn("step", F.floor((63 - F.log2(small)) * FIT_STEPS).cast("int")), "fit-ids")
    deeper = Window.partitionBy("lang").orderBy(F.desc("step"))
    counts = known.groupBy("lang", "step").count().withColumn("upto", F.sum("count").over(deeper))
    cuts = counts.where(F.col("upto") <= rows).groupBy("lang").agg(F.min("step").alias("cut"))
    sample = stored(known.join(cuts, "lang").where("step >= cut").select("doc_id", "lang"), "fit-sample")
    return F.broadcast(sample) if sample.count() <= FIT_BROADCAST else sample


def fit_bands(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[str, Fitted]:
    """Bands by language from at most ``rows`` labelled documents of good quality in each.

    A language's sample depends neither on file order nor on other languages.  A band is the clean rows'
    extremes and a margin, drawn towards the wide band where rows are few: ``n``
    rows weigh ``n / (n + FIT_HALF)``.  Documents without a language or a label
    take no part.
    """
    taken = docs.join(_sample(docs, labels, rows), ["doc_id", "lang"], "left_semi").select("text", "lang")
    measures = ["n_words", "chars_per_piece", "chars_per_token", "fallback_share", "token_entropy"]
    measured = stored(measure(taken).where("not other_script").where(F.col("n_words") >= MIN_WORDS).select("lang", *measures), "fit-rows")
    centre = lambda name: (F.sum(F.col(name) * F.col("n_words")) / F.sum("n_words")).alias(f"{name}_at")
    centres = measured.groupBy("lang").agg(F.max("n_words").alias("longest"), centre("chars_per_piece"), centre("chars_per_token"))
    ends = lambda name: [
        f((F.col(name) - F.col(f"{name}_at")) * F.sqrt("n_words")).alias(f"{name}_{side}") for side, f in (("low", F.min), ("high", F.max))
    ]
    fitted = (
        measured.join(centres, "lang")
        .groupBy("lang", "longest", "chars_per_piece_at", "chars_per_token_at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *ends("chars_per_piece"),
            *ends("chars_per_token"),
            F.max("fallback_share").alias("fallback"),
            F.min("token_entropy").alias("entropy"),
        )
    )

    def limits(r, name: str) -> tuple[float, float, float]:
        low, high = r[f"{name}_low"], r[f"{name}_high"]
        more = FIT_MARGIN * (high - low) / 2
        # rounded: sums in another order must not move a limit
        return round(r[f"{name}_at"], 9), round(low - more, 9), round(high + more, 9)

    return {
        r.lang: Fitted(
            LANGUAGE_BANDS.get(r.lang, SCRIPT_BANDS["latin"]),
            r.n / (r.n + FIT_HALF),
            r.longest,
            limits(r, "chars_per_piece"),
            limits(r, "chars_per_token"),
            r.fallback * (1 + SIDE_MARGIN) + 0.01,
            r.entropy * (1 - SIDE_MARGIN),
        )
        for r in fitted.collect()  # a row for each language
    }


def judge(docs: DataFrame, bands: dict[str, Band | Fitted] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents with their measures, ``base_failed``, ``band_failed`` and ``kept``.

    ``bands`` go before the wide ones.  Every input column passes through; a
    clashing one is replaced.
    """
    measured = measure(docs, text)
    script = F.when(F.col("other_script"), _within(SCRIPT_BANDS["other"])).otherwise(_within(SCRIPT_BANDS["latin"]))
    verdict = script
    if lang in docs.columns:
        for code, band in {**LANGUAGE_BANDS, **(bands or {})}.items():
            # a text in another script than its language's is judged by its script
            verdict = F.when((F.col(lang) == code) & ~F.col("other_script"), _within(band)).otherwise(verdict)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.withColumn("base_failed", base)
        .withColumn("band_failed", (F.col("n_words") > 0) & ~verdict)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))
    )
