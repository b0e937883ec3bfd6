"""Long exact spans shared between records: seeds, chains, verbatim coverage.

1. Seeds. Of every window of SPAN characters the k-mer with the least hash is kept. Equal
   windows keep the same k-mer at the same place, so two records that share a span of SPAN
   characters share a seed; about one position in 80 is a seed.
2. Join. Seeds of more than one record keep a context: just the characters of the windows
   they are the least k-mer of. For passages, every two records of a group of equal seeds
   are compared around the seed, equal texts once. For coverage, windows are compared by hash, so
   each occurrence gets the maximal runs of windows found in another record without any pair
   of occurrences being formed. A group of very many occurrences is not gathered: its
   windows are aggregated by their own hash, with partial aggregation before the shuffle.
3. Chains. The matches of a record are chained per partner: ordered on both sides, with a
   cost linear in the gaps, over a Fenwick tree of prefix maxima. For passages every shared
   seed counts, grown as far as the two records agree around it, so a copy with small edits
   is a chain of short matches; SPAN matched characters or more make a passage.
4. Alignment. What lies between the matches of a passage is aligned by edit distance, which
   gives how alike the passage is in the two records. Just these stretches are fetched.
5. Coverage. Verbatim characters are counted on the union of the matches of all chains that
   are SPAN long.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, small

SPAN = 200
K = 40
HOT = 20_000
GAP_COST = 0.25  # so SPAN matched characters make up for four times as many that are not
_BITS = 22  # positions of a block; a block holds at most 2**22 characters
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _prefix(codes: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.upto(len(codes) + 1)
    p = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x1234567)) * up[: len(codes)], out=p[1:])
    return p, down


def _window_hashes(p: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    n = len(p) - k
    return _mix((p[k:] - p[:n]) * down[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries, by doubling."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _seeds_of(texts: list[str], span: int, k: int, powers: _Powers) -> tuple[np.ndarray, ...]:
    """(text number, position, first window, last window, hash) of all seeds of the texts;
    every text has ``span`` characters or more and together they fit a block."""
    codes = _codes(texts)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    p, down = _prefix(codes, powers)
    h = _window_hashes(p, down, k)
    mask = np.uint64((1 << _BITS) - 1)
    keyed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(keyed, span - k + 1) & mask).astype(np.int64)  # of each window start
    valid = np.repeat(np.arange(len(texts)), lengths - span + 1)
    offset = np.arange(len(valid)) - np.repeat(np.cumsum(lengths - span + 1) - (lengths - span + 1), lengths - span + 1)
    best = at[starts[valid] + offset]
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (valid[1:] != valid[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(best) - 1]])
    text = valid[new]
    return text, best[new] - starts[text], offset[new], offset[last], h[best[new]]


def _blocks(rows: list[tuple], limit: int = 1 << 21) -> Iterator[list[tuple]]:
    """Rows (.., text) in blocks of at most ``limit`` characters; a longer text is alone."""
    block, size = [], 0
    for r in rows:
        if block and size + len(r[-1]) > limit:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r[-1])
    if block:
        yield block


def _sections(text: str, span: int) -> Iterator[tuple[int, str]]:
    """Very long texts in sections that fit a block; sections overlap by span - 1, so each
    window lies in exactly one."""
    step = (1 << _BITS) - span - 1
    for at in range(0, max(1, len(text) - span + 1), step):
        yield at, text[at : at + step + span - 1]


def _seed_batches(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        rows = [(d, at, s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d is not None and t and len(t) >= span for at, s in _sections(t, span)]
        for block in _blocks(rows):
            i, pos, lo, hi, h = _seeds_of([r[2] for r in block], span, k, powers)
            docs = np.array([r[0] for r in block], dtype=np.int64)[i]
            at = np.array([r[1] for r in block], dtype=np.int64)[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(docs), pa.array((pos + at).astype(np.int32)), pa.array((lo + at).astype(np.int32)), pa.array((hi + at).astype(np.int32))],
                names=["seed", "doc", "pos", "lo", "hi"],
            )


def seeds(docs: DataFrame, key: str, text: str, span: int = SPAN, k: int = K) -> DataFrame:
    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(lambda it: _seed_batches(it, span, k), "seed bigint, doc bigint, pos int, lo int, hi int")


_CONTEXT = "seed bigint, doc bigint, lo int, context string, hot boolean"


def _contexts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for d, t, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for s in at:
                for column, value in zip(out, (s["seed"], d, s["lo"], t[s["lo"] : s["hi"] + span], s["hot"])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())], names=["seed", "doc", "lo", "context", "hot"])


_MATCH = "doc bigint, start int, end int, partner bigint, partner_start int"


def _windows(doc: np.ndarray, lo: np.ndarray, contexts: list[str], span: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start) of every window of the contexts."""
    lengths = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    n = lengths - span + 1
    p, down = _prefix(_codes(contexts), powers)
    h = _window_hashes(p, down, span)
    owner = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return h[(np.cumsum(lengths) - lengths)[owner] + offset], doc[owner], lo[owner] + offset


def _matches_of(doc: np.ndarray, lo: np.ndarray, contexts: list[str], span: int, powers: _Powers) -> pa.RecordBatch:
    h, d, s = (np.concatenate(x) for x in zip(*(_windows(doc[a:b], lo[a:b], contexts[a:b], span, powers) for a, b in _ranges(contexts))))
    order = np.lexsort((s, d, h))
    h, d, s = h[order], d[order], s[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    tail = np.concatenate([head[1:], [len(h)]]) - 1
    shared = (d[head] != d[tail])[group]
    # the partner of a window is the first record of its group, of that record itself the last
    partner = np.where(d == d[head][group], tail[group], head[group])
    h, d, s, pd_, ps = h[shared], d[shared], s[shared], d[partner][shared], s[partner][shared]
    order = np.lexsort((s, pd_, d))
    d, s, pd_, ps = d[order], s[order], pd_[order], ps[order]
    if not len(d):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())], names=["doc", "start", "end", "partner", "partner_start"])
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (pd_[1:] != pd_[:-1]) | (s[1:] != s[:-1] + 1) | (ps[1:] != ps[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(d)]]) - 1
    return pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(s[new].astype(np.int32)), pa.array((s[last] + span).astype(np.int32)), pa.array(pd_[new]), pa.array(ps[new].astype(np.int32))], names=["doc", "start", "end", "partner", "partner_start"])


def _ranges(contexts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, c in enumerate(contexts):
        if size and size + len(c) > limit:
            yield a, b
            a, size = b, 0
        size += len(c)
    yield a, len(contexts)


def _matches(batches: Iterator[pa.RecordBatch], span: int, chars: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by seed; whole groups are taken, about ``chars`` at a time."""
    powers, held, size = _Powers(), [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(3).nbytes
        if size > chars:
            rows = pa.Table.from_batches(held).combine_chunks()
            seed = rows["seed"].to_numpy()
            cut_at = int(np.searchsorted(seed, seed[-1]))
            if cut_at:
                done = rows.slice(0, cut_at)
                yield _matches_of(done["doc"].to_numpy(), done["lo"].to_numpy().astype(np.int64), done["context"].to_pylist(), span, powers)
                rows = rows.slice(cut_at)
            held, size = rows.to_batches(), sum(b.column(3).nbytes for b in rows.to_batches()) if cut_at else size
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield _matches_of(rows["doc"].to_numpy(), rows["lo"].to_numpy().astype(np.int64), rows["context"].to_pylist(), span, powers)


def _hot_windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        if batch.num_rows:
            contexts = batch.column(3).to_pylist()
            for a, b in _ranges(contexts):
                h, d, s = _windows(batch.column(1).to_numpy()[a:b], batch.column(2).to_numpy()[a:b].astype(np.int64), contexts[a:b], span, powers)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(s.astype(np.int32))], names=["window", "doc", "start"])


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, hot: int = HOT) -> DataFrame:
    """Maximal runs of ``span`` or more characters of a record that stand verbatim in
    another: (doc, start, end, partner, partner_start), with one partner for each run."""
    found = cut(seeds(docs, key, text, span, k), "seeds")
    counted = found.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n"))
    shared = found.join(counted.filter("a < b").select("seed", (F.col("n") > hot).alias("hot")), "seed")
    of_doc = shared.groupBy("doc").agg(F.collect_list(F.struct("seed", "lo", "hi", "hot")).alias("at"))  # bounded by the text's length
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).dropDuplicates(["doc"])
    context = of_doc.join(texts, "doc").select("doc", "t", "at").mapInArrow(lambda it: _contexts(it, span), _CONTEXT)
    context = cut(context, "contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = context.filter(~F.col("hot")).repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(lambda it: _matches(it, span), _MATCH)
    windows = context.filter("hot").mapInArrow(lambda it: _hot_windows(it, span), "window bigint, doc bigint, start int")
    at = F.struct("doc", "start")
    ends = windows.groupBy("window").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a.doc < b.doc")
    partner = F.when(F.col("doc") == F.col("a.doc"), F.col("b")).otherwise(F.col("a"))
    warm = windows.join(ends, "window").select("doc", "start", (F.col("start") + span).alias("end"), partner["doc"].alias("partner"), partner["start"].alias("partner_start"))
    return cold.unionByName(warm)


def _occurrences(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in kinds)
        for d, t, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for s in at:
                for column, value in zip(out, (s["seed"], d, s["lo"], s["pos"] - s["lo"], t[s["lo"] : s["hi"] + span], s["parts"])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["seed", "doc", "lo", "off", "context", "parts"])


def _extent(p: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many characters, at most ``most``, agree after (way 1) or before (-1) a and b."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    while (low < high).any():
        m = (low + high + 1) // 2
        x, z = (a, b) if way > 0 else (a - m, b - m)
        same = (p[x + m] - p[x]) * down[x] == (p[z + m] - p[z]) * down[z]
        low, high = np.where(same, m, low), np.where(same, high, m - 1)
    return low


def _pairs_of(rows: pa.Table, span: int, k: int, powers: _Powers, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs around a seed shared by two records of whole groups (seed, part), least record first. Windows of
    a seed have it at the same place, so two occurrences share one run around it. An occurrence
    whose context its record had before only meets those that are the first of theirs."""
    seed, part, doc, lo, off = (rows[c].to_numpy().astype(np.int64) for c in ("seed", "part", "doc", "lo", "off"))
    order = np.lexsort((lo, doc, part, seed))
    kept = order[np.concatenate([[True], np.any([v[order][1:] != v[order][:-1] for v in (seed, part, doc, lo)], axis=0)])]
    seed, part, doc, lo, off = (v[kept] for v in (seed, part, doc, lo, off))
    parts = rows["parts"].to_numpy()[kept]
    contexts = rows["context"].take(pa.array(kept)).to_pylist()
    length = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    at = np.cumsum(length) - length
    p, down = _prefix(_codes(contexts), powers)
    whole = _mix((p[at + length] - p[at]) * down[at]) ^ _mix((length * (1 << 20) + off).astype(np.uint64))
    group = np.cumsum(np.concatenate([[True], (seed[1:] != seed[:-1]) | (part[1:] != part[:-1])])) - 1
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.bincount(group)
    order = np.lexsort((lo, whole, doc, group))
    first = np.zeros(len(doc), dtype=bool)
    first[order[np.concatenate([[True], np.any([v[order][1:] != v[order][:-1] for v in (group, doc, whole)], axis=0)])]] = True
    mine = np.flatnonzero(first & ((np.arange(len(doc)) - begin[group]) % parts == part))
    size = n[group[mine]]
    block = np.cumsum(size) // most
    for own in np.split(mine, np.flatnonzero(np.diff(block)) + 1):
        size = n[group[own]]
        i = np.repeat(own, size)
        j = np.repeat(begin[group[own]], size) + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        met = (doc[i] != doc[j]) & ~(first[j] & (doc[j] < doc[i]))
        i, j = i[met], j[met]
        i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        before = _extent(p, down, at[i] + off[i], at[j] + off[j], np.minimum(off[i], off[j]), -1)
        after = _extent(p, down, at[i] + off[i] + k, at[j] + off[j] + k, np.minimum((length - off)[i], (length - off)[j]) - k, 1)
        same = _extent(p, down, at[i] + off[i], at[j] + off[j], np.full(len(i), k), 1) == k
        i, j, before, after = i[same], j[same], before[same], after[same]
        start = lo[i] + off[i] - before
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(start.astype(np.int32)), pa.array((start + before + k + after).astype(np.int32)), pa.array(doc[j]), pa.array((lo[j] + off[j] - before).astype(np.int32))], names=["doc", "start", "end", "partner", "partner_start"])


def _pairs(batches: Iterator[pa.RecordBatch], span: int, k: int, chars: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by seed and part; whole groups are taken."""
    powers, held, size = _Powers(), [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > chars:
            rows = pa.Table.from_batches(held).combine_chunks()
            seed, part = rows["seed"].to_numpy(), rows["part"].to_numpy()
            ends = np.flatnonzero((seed[1:] != seed[:-1]) | (part[1:] != part[:-1]))
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield from _pairs_of(rows.slice(0, at), span, k, powers)
            held, size = rows.slice(at).to_batches(), 0
    if held and sum(b.num_rows for b in held):
        yield from _pairs_of(pa.Table.from_batches(held).combine_chunks(), span, k, powers)


def pair_runs(texts: DataFrame, span: int = SPAN, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc, start, end, partner, partner_start), doc < partner: the runs around each seed that
    two of the records (doc, h, t) share. A seed of more than ``hot`` / 10
    occurrences is dealt to several parts; each has them all and takes its share of them as
    one side of the pairs."""
    found = cut(seeds(texts, "doc", "t", span, k), "seeds")
    counted = found.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.ceil(F.count("*") / max(1, hot // 10)).cast("int").alias("parts"))
    shared = found.join(counted.filter("a < b").select("seed", "parts"), "seed")
    of_doc = shared.groupBy("doc").agg(F.collect_list(F.struct("seed", "pos", "lo", "hi", "parts")).alias("at"))  # bounded by the text's length
    context = of_doc.join(texts.select("doc", "t").dropDuplicates(["doc"]), "doc").select("doc", "t", "at").mapInArrow(lambda it: _occurrences(it, span), "seed bigint, doc bigint, lo int, off int, context string, parts int")
    context = context.select("seed", "doc", "lo", "off", "context", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return context.repartition(n, "seed", "part").sortWithinPartitions("seed", "part").mapInArrow(lambda it: _pairs(it, span, k), _MATCH)


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if self.best[i][0] < value:
                self.best[i] = (value, item)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The best of positions 0..i - 1."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chain(hits: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[int]]:
    """Chains of matches (start, end, partner_start) of one record with one partner, as lists
    of indices. A match follows another if it starts later on both sides; the score is the
    matched length less ``gap_cost`` for each character between them on either side. As the
    cost is linear it splits into a term of either match, so the best predecessor is a prefix
    maximum over partner positions. Where the cost exceeds what went before, a chain starts anew."""
    order = sorted(range(len(hits)), key=lambda i: hits[i])
    ys = sorted({hits[i][2] for i in order})
    tree, before, value = Fenwick(len(ys)), [-1] * len(hits), [0.0] * len(hits)
    for i in order:
        s, e, y = hits[i]
        rank = bisect_left(ys, y)
        best, j = tree.upto(rank)
        own = float(e - s)
        value[i] = own
        if j >= 0 and hits[j][0] < s:
            gain = best - gap_cost * (s + y)
            if gain > 0:
                value[i] += gain
                before[i] = j
        tree.put(rank, value[i] + gap_cost * (e + y + e - s), i)
    out, used = [], set()
    for i in sorted(order, key=lambda i: (-value[i], hits[i])):
        members = []
        while i >= 0 and i not in used:
            used.add(i)
            members.append(i)
            i = before[i]
        if members:
            out.append(members[::-1])
    return out


_PASSAGE = "doc bigint, partner bigint, start int, end int, partner_start int, partner_end int, verbatim_chars int, gaps int, pieces array<struct<start:int,end:int>>, anchors array<struct<start:int,end:int,partner_start:int>>"


def _union(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(pieces):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _merged(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, end, partner_start) on one diagonal that touch are one match."""
    merged: list[tuple[int, int, int]] = []
    for s, e, y in sorted(hits, key=lambda h: (h[2] - h[0], h[0])):
        if merged and y - s == merged[-1][2] - merged[-1][0] and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2])
        else:
            merged.append((s, e, y))
    return merged


def _passage(doc: int, partner: int, own: list[tuple[int, int, int]], span: int) -> tuple | None:
    """A chain as a row; None if it matches fewer than ``span`` characters. Pieces are what is
    verbatim over ``span`` characters, anchors all its matches if there is anything between."""
    held = sum(e - s for s, e in _union([(s, e) for s, e, _ in own]))
    if held < span:
        return None
    pieces = _union([(s, e) for s, e, _ in own if e - s >= span])
    anchors = [{"start": s, "end": e, "partner_start": y} for s, e, y in own] if len(own) > 1 else []
    return doc, partner, own[0][0], max(e for _, e, _ in own), own[0][2], max(y + e - s for s, e, y in own), held, len(own) - 1, [{"start": s, "end": e} for s, e in pieces], anchors


_COLUMNS = [c.split()[0] for c in _PASSAGE.split(", ")]


def _chained(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, partner, hits in zip(batch["doc"], batch["partner"], batch["hits"]):
            merged = _merged([(int(h["start"]), int(h["end"]), int(h["partner_start"])) for h in hits])
            out += [p for members in chain(merged) if (p := _passage(doc, partner, [merged[i] for i in members], span))]
        yield pd.DataFrame(out, columns=_COLUMNS)


def _both_ways(rows: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
    """Passages of either record of each pair; whole pairs, sorted by pair, diagonal and start."""
    d, q, s, e, y = (rows[c].to_numpy().astype(np.int64) for c in ("doc", "partner", "start", "end", "partner_start"))
    pair = np.concatenate([[True], (d[1:] != d[:-1]) | (q[1:] != q[:-1])])
    new = np.concatenate([[True], pair[1:] | (y[1:] - s[1:] != y[:-1] - s[:-1]) | (s[1:] > e[:-1])])  # runs of one diagonal have ends in the order of their starts
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(d)]]) - 1
    of = (np.cumsum(pair) - 1)[head]
    d, q, s, e, y = d[head], q[head], s[head], e[tail], y[head]
    alone = np.bincount(of)[of] == 1
    n = e - s
    point = lambda *v: pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in v], ["start", "end", "partner_start"][: len(v)])
    none = np.empty(0)
    pack = lambda a, b, x, x_end, z: pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), *(pa.array(v.astype(np.int32)) for v in (x, x_end, z, z + x_end - x, x_end - x, np.zeros(len(x)))), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), point(x, x_end)), pa.ListArray.from_arrays(pa.array(np.zeros(len(x) + 1, dtype=np.int32)), point(none, none, none))],
        names=_COLUMNS,
    )
    i = np.flatnonzero(alone & (n >= span))
    if len(i):
        yield pack(d[i], q[i], s[i], e[i], y[i])
        yield pack(q[i], d[i], y[i], (y + n)[i], s[i])
    out, rest = [], np.flatnonzero(~alone)
    for own in np.split(rest, np.flatnonzero(np.diff(of[rest])) + 1) if len(rest) else []:
        if n[own].sum() < span:
            continue
        merged = list(zip(s[own].tolist(), e[own].tolist(), y[own].tolist()))
        a, b = int(d[own[0]]), int(q[own[0]])
        for members in chain(merged):
            run = [merged[m] for m in members]
            for passage in (_passage(a, b, run, span), _passage(b, a, [(z, z + end - x, x) for x, end, z in run], span)):
                if passage:
                    out.append(passage)
    if out:
        place = lambda *names: pa.list_(pa.struct([(c, pa.int32()) for c in names]))
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, place("start", "end"), place("start", "end", "partner_start")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_COLUMNS)


def _chained_pairs(batches: Iterator[pa.RecordBatch], span: int, rows: int = 500_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            d, q = whole["doc"].to_numpy(), whole["partner"].to_numpy()
            ends = np.flatnonzero((d[1:] != d[:-1]) | (q[1:] != q[:-1]))
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield from _both_ways(whole.slice(0, at), span)
            held = whole.slice(at).to_batches()
            size = whole.num_rows - at if at else 0
    if held and sum(b.num_rows for b in held):
        yield from _both_ways(pa.Table.from_batches(held).combine_chunks(), span)


def edits(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as the bits of a number."""
    if not a or not b:
        return max(len(a), len(b))
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    more, less, score = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(across | more)), more & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        more, less = down | (full & ~(same | less | up)), up & (same | less)
    return score


def between(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, partner_start, partner_end) of what lies between the matches of a chain, one
    of which may be empty; matches that overlap count from where the one before ended."""
    out = []
    x, y = anchors[0][1], anchors[0][2] + anchors[0][1] - anchors[0][0]
    for s, e, z in anchors[1:]:
        skip = max(0, x - s, y - z)
        if s + skip < e:
            out.append((x, s + skip, y, z + skip))
            x, y = e, z + e - s
    return out


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        out = []
        for doc, partner, start, other, anchors in zip(f["doc"], f["partner"], f["start"], f["partner_start"], f["anchors"]):
            for g, (a, b, c, d) in enumerate(between([(int(h["start"]), int(h["end"]), int(h["partner_start"])) for h in anchors])):
                out += [(doc, doc, partner, start, other, g, 0, a, b), (partner, doc, partner, start, other, g, 1, c, d)]
        yield pd.DataFrame(out, columns=["at", "doc", "partner", "start", "partner_start", "gap", "side", "a", "b"])


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x or "", y or "") for x, y in zip(a, b)], dtype="int64")


def aligned(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages with ``edits``, the edit distance of what lies between their matches in the two
    records, and ``identity``, the share of the longer side that needs none."""
    key = ["doc", "partner", "start", "partner_start"]
    fuzzy = found.filter("gaps > 0").select(*key, "anchors")
    once = fuzzy.filter("doc < partner")
    asked = once.mapInPandas(_stretches, "at bigint, doc bigint, partner bigint, start int, partner_start int, gap int, side int, a int, b int")
    cut_out = asked.join(texts.select(F.col("doc").alias("at"), "t"), "at").select(*key, "gap", "side", F.substring(F.col("t"), F.col("a") + 1, F.col("b") - F.col("a")).alias("s"))
    sides = cut_out.groupBy(*key, "gap").agg(F.max(F.when(F.col("side") == 0, F.col("s"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("s"))).alias("y"))
    distance = F.pandas_udf(_edits, "bigint")
    scored = cut(sides.select(*key, distance("x", "y").alias("n")).groupBy(*key).agg(F.sum("n").alias("edits")), "aligned")
    back = scored.select(F.col("partner").alias("doc"), F.col("doc").alias("partner"), F.col("partner_start").alias("start"), F.col("start").alias("partner_start"), "edits")
    longer = F.greatest(F.col("end") - F.col("start"), F.col("partner_end") - F.col("partner_start"))
    out = found.join(scored.unionByName(back), key, "left").withColumn("edits", F.coalesce("edits", F.lit(0)))
    return out.withColumn("identity", F.round(1 - F.col("edits") / longer, 4))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, hot: int = HOT) -> DataFrame:
    """Passages of a record that occur in a partner, for every partner: chains of matches around
    shared seeds of ``span`` matched characters or more, with the edit distance of what stands
    between the matches. A copy with edits is found if seeds are left between these: seeds are
    shared where about ``k`` characters that are the least of their windows agree.

    Records of equal texts are a class, named by its least key in ``class``. Classes meet by
    that record, either way; the others of a class have a passage to it and it to them, over
    the whole text. So two records share a span if they are of one class, or the records
    their classes are named by have a passage with a piece; pieces are what is verbatim over
    ``span`` characters. Each window of a record meets each partner, a
    window that is repeated in both at the first place in one of them.

    Records are told apart by ``key``; rows with a null key and texts that are null, empty or
    shorter than ``span`` have no passages; of rows that repeat a key one text is taken. An
    empty table gives no rows. ``text`` and ``key`` may be any columns; others are not read.
    """
    hashed = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).filter(F.col("doc").isNotNull() & (F.length("t") >= span)).withColumn("h", F.xxhash64("t"))
    rows = cut(hashed.select("doc", "h", F.length("t").alias("n")).distinct(), "texts")
    one = rows.groupBy("doc").agg(F.min(F.struct("h", "n")).alias("x")).select("doc", "x.h", "x.n")
    named = one.groupBy("h").agg(F.min("doc").alias("class"), F.count("*").alias("copies"))
    copies = cut(one.join(named.filter("copies > 1").select("h", "class"), "h").filter("doc <> class"), "copies")
    aside = cut(rows.join(one, ["doc", "h"], "left_anti").select("doc", "h").union(copies.select("doc", "h")), "aside")
    texts = hashed.join(small(aside), ["doc", "h"], "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = pair_runs(texts, span, k, hot).repartition(parts, "doc", "partner").sortWithinPartitions("doc", "partner", F.col("partner_start") - F.col("start"), "start")
    found = runs.mapInArrow(lambda it: _chained_pairs(it, span), _PASSAGE).withColumn("class", F.col("doc"))
    zero, n = F.lit(0), F.col("n")
    whole = [zero.alias("start"), n.alias("end"), zero.alias("partner_start"), n.alias("partner_end"), n.alias("verbatim_chars"), zero.alias("gaps"), F.array(F.struct(zero.alias("start"), n.alias("end"))).alias("pieces"), F.array().cast("array<struct<start:int,end:int,partner_start:int>>").alias("anchors")]
    same = copies.select("doc", F.col("class").alias("partner"), *whole, "class").union(copies.select(F.col("class").alias("doc"), F.col("doc").alias("partner"), *whole, "class"))
    return aligned(cut(found, "passages").unionByName(same), texts)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, hot: int = HOT) -> DataFrame:
    """Passages as above, without alignment and with one partner for each run of ``span``
    characters or more: all that shared_chars needs, in time that does not grow with pairs."""
    found = matches(docs, key, text, span, k, hot)
    grouped = found.groupBy("doc", "partner").agg(F.collect_list(F.struct("start", "end", "partner_start")).alias("hits"))  # bounded by the text's length
    return grouped.mapInPandas(lambda it: _chained(it, span), _PASSAGE)


def _covered(pieces: pd.Series) -> pd.Series:
    return pd.Series([sum(e - s for s, e in _union([(int(p["start"]), int(p["end"])) for p in own])) for own in pieces], dtype="int64")


def shared_chars(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shared_chars): characters of each record in the verbatim pieces of its passages,
    each character once."""
    covered = F.pandas_udf(_covered, "bigint")
    return found.groupBy("doc").agg(F.flatten(F.collect_list("pieces")).alias("pieces")).select(F.col("doc").alias(key), covered("pieces").alias("shared_chars"))
