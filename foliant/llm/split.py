"""Cutting oversized texts at natural boundaries, with overlap.

One regular expression takes piece after piece from the text: its alternatives stand in the
order of the strength of a boundary, each consumes as much as the limit allows through a
bounded quantifier and ends right behind such a boundary, and the last takes characters. The
overlap is looked back for in the piece before and starts at a sentence or word where it can.
All of it is built-in expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 512
OVERLAP_TOKENS = 64
CHARS_PER_TOKEN = 4


def size_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def piece_pattern(body: int) -> str:
    """Pieces of at most ``body`` characters. Strong boundaries count from a quarter of it on,
    so that no boundary leaves a crumb; a blank or a character counts anywhere."""
    least = max(1, body // 4)
    strong = [
        r"(?<=\n[ \t\r]{0,8}\n)",  # paragraph
        r"(?<=\n)",  # line
        r"(?<=[.!?।。][\"'”’)\]]{0,2}\s)",  # sentence
        r"(?<=[;:]\s)",  # clause
        r"(?<=,\s)",
    ]
    return f"(?s).{{1,{body}}}\\z|" + "|".join(f".{{{least},{body}}}{b}" for b in strong) + f"|.{{1,{body}}}(?<=\\s)|.{{1,{body}}}"


#: The longest ending that starts at a sentence; the longest that starts at a word.
_SENTENCE = r"(?s)(?<=[.!?।。][\"'”’)\]]{0,2}\s)\S.*\z"
_WORD = r"(?s)(?<=\s)\S.*\z"


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """One row for each piece: keys, piece (from 0), pieces, start, overlap_chars, tokens, text.

    ``start`` is where the piece starts in its text, counted in code points, and includes the
    overlap of at most ``overlap`` tokens with the piece before; without the overlaps the
    pieces of a text are the text, character for character. A text within the limit is one
    piece. A null text gives no row and an empty text one empty piece. Rows that repeat keys
    and text each give their pieces. Sizes are floor(chars / 4), at least 1, whatever a stored
    count says. An empty table gives no rows; other columns are not read, and a column of the
    name of an output column is used only as text or key.
    """
    t = F.col("_text")
    back = overlap * CHARS_PER_TOKEN
    body = limit * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1 - back
    base = df.filter(F.col(text).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(text).alias("_text"))
    cores = F.when(F.floor(F.length(t) / CHARS_PER_TOKEN) > limit, F.regexp_extract_all(t, F.lit(piece_pattern(body)), F.lit(0))).otherwise(F.array(t))
    cored = base.select("_key", cores.alias("_cores"))
    starts = F.aggregate(
        "_cores",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, c: F.struct((a["at"] + F.length(c)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )["all"]

    def lookback(before: Column) -> Column:
        tail = F.right(before, F.lit(back))
        sentence, word = F.regexp_extract(tail, _SENTENCE, 0), F.regexp_extract(tail, _WORD, 0)
        return F.when(F.length(sentence) > 0, sentence).when(F.length(word) > 0, word).otherwise(tail)

    overlaps = F.transform("_cores", lambda c, i: F.when(i > 0, lookback(F.get("_cores", i - 1))).otherwise(F.lit("")))
    made = cored.select("_key", "_cores", starts.alias("_starts"), overlaps.alias("_overlaps"))
    rows = made.select("_key", F.size("_cores").alias("pieces"), F.posexplode(F.arrays_zip("_cores", "_starts", "_overlaps")).alias("piece", "x"))
    own = F.concat(F.col("x._overlaps"), F.col("x._cores"))
    return rows.select(
        *[F.col(f"_key.`{k}`").alias(k) for k in keys],
        "piece",
        "pieces",
        (F.col("x._starts") - F.length("x._overlaps")).alias("start"),
        F.length("x._overlaps").alias("overlap_chars"),
        size_tokens(own).alias("tokens"),
        own.alias("piece_text"),
    )
