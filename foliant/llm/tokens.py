"""Encoding a corpus with a public byte-level BPE vocabulary by tree reduction.

A text is halved down to leaves, leaves are encoded on their own, and neighbours are
joined by re-encoding a window around the seam. The join is a monoid operation: its
result equals encoding the joined text at once, for any way of halving.

Why the tokens outside the window are final: merges never cross the pre-tokens of the
vocabulary's pattern, the pattern looks at nothing before a pre-token's start, and only
white-space pre-tokens look past their end. White space occurs in a pre-token only at its
beginning or alone, so a position with a non-blank before it and a blank at it starts a
pre-token in every text that holds those two characters. The window grows until it finds
such a position on either side of the seam, or reaches the end of that side.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZERS = "/opt/tokenizers"
LEAF_CHARS = 4096
WINDOW_CHARS = 64
_BLANKS = " \n\t\r"
#: The pattern that public byte-level BPE vocabularies of 50k tokens are used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary file at ``path`` (lines of base64 token and rank)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("foliant", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(folder: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(folder or os.environ.get("FOLIANT_TOKENIZERS", DEFAULT_TOKENIZERS), name)


def _seam_left(text: str, a: int, m: int) -> int:
    """The last certain pre-token start in [a, m), looking further back each time."""
    w, hi = WINDOW_CHARS, m
    while hi > a:
        lo = max(a, m - w)
        for i in range(hi - 1, max(lo, a + 1) - 1, -1):
            if text[i] in _BLANKS and not text[i - 1].isspace():
                return i
        hi, w = lo, w * 2
    return a


def _seam_right(text: str, m: int, b: int) -> int:
    """The first certain pre-token start after m that both sides agree on, else b."""
    w, lo = WINDOW_CHARS, m + 1
    while lo < b:
        hi = min(b, m + w)
        for j in range(lo, hi):
            if text[j] in _BLANKS and not text[j - 1].isspace():
                return j
        lo, w = max(hi, lo), w * 2
    return b


def _join(enc, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    i, j = _seam_left(text, a, m), _seam_right(text, m, b)
    drop_l = len(enc.encode_ordinary(text[i:m])) if i > a else len(left)
    drop_r = len(enc.encode_ordinary(text[m:j])) if j < b else len(right)
    seam = np.asarray(enc.encode_ordinary(text[i:j]), dtype=np.int32)
    return np.concatenate([left[: len(left) - drop_l], seam, right[drop_r:]])


def encode_tree(enc, text: str | None, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Token ids of ``text``; null and empty give no ids. Equal to encoding it at once."""
    if not text:
        return np.empty(0, dtype=np.int32)
    # Halving is done with a list of cuts rather than by recursion, so depth is no limit.
    cuts = [0, len(text)]
    while max(y - x for x, y in zip(cuts, cuts[1:])) > leaf:
        cuts = sorted({*cuts, *((x + y) // 2 for x, y in zip(cuts, cuts[1:]) if y - x > leaf)})
    parts = [np.asarray(enc.encode_ordinary(text[x:y]), dtype=np.int32) for x, y in zip(cuts, cuts[1:])]
    while len(parts) > 1:
        nxt, ends = [], [0]
        for k in range(0, len(parts) - 1, 2):
            nxt.append(_join(enc, text, cuts[k], cuts[k + 1], cuts[k + 2], parts[k], parts[k + 1]))
            ends.append(cuts[k + 2])
        if len(parts) % 2:
            nxt.append(parts[-1])
            ends.append(cuts[-1])
        parts, cuts = nxt, ends
    return parts[0]


def decode_tree(enc, ids) -> str:
    """The text of ``ids``: halves are decoded to bytes and concatenated up the tree."""
    ids = [int(i) for i in ids]
    parts = [enc.decode_bytes(ids[k : k + 1024]) for k in range(0, len(ids), 1024)]
    while len(parts) > 1:
        parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0].decode("utf-8", errors="replace") if parts else ""


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        k = batch.schema.get_field_index(text)
        arrays = [encode_tree(enc, t) for t in batch.column(k).to_pylist()]
        lengths = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
        if count_only:
            out = pa.array(lengths.astype(np.int32))
        else:
            offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
            np.cumsum(lengths, out=offsets[1:])
            flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
        rest = [i for i in range(batch.num_columns) if i != k]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in rest), out],
            names=[*(batch.schema.names[i] for i in rest), "n_tokens" if count_only else "ids"],
        )


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (key, ids) for every row of ``df``, repeated rows included; null and empty
    texts give an empty list, an empty table gives no rows, other columns are not read.
    No shuffle: each task encodes the rows of its split."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda it: _encoded(it, path, text, False), f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """As ``encode_corpus``, with the number of tokens only."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda it: _encoded(it, path, text, True), f"`{key}` {kind}, n_tokens int")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text) of token ids; an empty or null list is an empty text."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_tree(enc, x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
