r"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, merged where neighbours have the
same role, and written as

    ### role: text</turn>

with ``<part/>`` between the texts of merged turns.  Inside roles and texts the
characters that control strings are made of are replaced by two-character codes
(``\`` by ``\b``, ``#`` by ``\h``, ``<`` by ``\l``, and ``:`` in roles by
``\c``), so no text can end a turn or open another, and everything reads back.

The output is a list of segments whose texts in order are the formatted string;
the loss mask is a flag of each segment and covers exactly the assistant's texts.

Null roles and texts are empty; rows of a null conversation are one
conversation; null turns come first; equal turns are ordered by role and text
and repeated rows are turns of their own.  Extra columns do not matter.  A
conversation becomes one string, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, MIDDLE, CLOSE, PART = "### ", ": ", "</turn>\n", "<part/>"

# Characters and their codes; the code of the backslash goes first when
# escaping and last when reading.
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_CODES = [*CODES, (":", "\\c")]


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted) of (conv_id, turn, role, text) rows."""
    none = F.lit("")
    turn = F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    role = lambda i: F.get("turns", i)["role"]
    starts = F.filter(places, lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0)))))
    runs = turns.withColumn("starts", starts)
    merged = F.transform(
        "starts",
        lambda s, j: F.struct(
            role(s).alias("role"),
            F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s).alias("parts"),
        ),
    )
    off = F.lit(False)
    header = lambda m: F.concat(F.lit(OPEN), escape(m["role"], ROLE_CODES), F.lit(MIDDLE))
    body = lambda m: F.flatten(
        F.transform(
            m["parts"],
            lambda p, k: F.array(
                _segment(F.when(k == 0, none).otherwise(F.lit(PART)), off),
                _segment(escape(p["text"]), m["role"] == ASSISTANT),
            ),
        )
    )
    blocks = runs.select("conv_id", merged.alias("blocks"))
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda m: F.concat(F.array(_segment(header(m), off)), body(m), F.array(_segment(F.lit(CLOSE), off))),
        )
    )
    cut = blocks.select("conv_id", segments.alias("segments"))
    return cut.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Add ``read``, the (role, text) turns that the formatted string holds."""
    blocks = F.split("formatted", CLOSE)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, MIDDLE, 1)
        body = F.substr(block, F.length(head) + len(MIDDLE) + 1)
        name = unescape(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_CODES)
        return F.transform(
            F.split(body, PART), lambda text: F.struct(name.alias("role"), unescape(text).alias("text"))
        )

    # the last piece is what follows the last mark: nothing
    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return formatted.withColumn("read", F.flatten(F.transform(whole, turns)))


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(rows: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted form."""
    back = read_turns(format_conversations(rows))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    texts = back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        lines.alias("lines"),
        loss_text().alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return texts.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
