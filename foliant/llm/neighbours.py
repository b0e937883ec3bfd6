"""The k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (random signs and a Walsh-Hadamard
transform, three times) and hashed to the nearest signed axis; several rotations make one
bucket number, the last of which may look at a part of the axes only, so that a bucket holds
about FILL vectors however many there are. Independent ones make the tables of the index; as
the chance of meeting in a table falls with a small power of the number of vectors, tables
are added with that power. A vector is stored in one bucket of a table and looked up in that
and in its PROBES next best buckets, those whose axes it misses by least.

Buckets hold numbers and sketches (signs along random directions), not vectors. In a bucket
the sketches rule out what is too far away and give each lookup its best candidates; these
are reranked by their exact cosine, for which each vector is joined to the pairs once.

Equal vectors are one point of the index. A bucket of more than TILE points is split into a
grid: stored points and lookups are dealt to shares, and every share of the one meets every
share of the other in a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut, small

TABLES = 12
FILL = 4
FILL_FAR = 16  # where neighbours of any cosine are asked for, which meet less often
PROBES = 3
TILE = 4096
WORDS = 2  # of 64 signs, in a sketch
SPARE = 8  # candidates a lookup passes on, for each neighbour asked for
DEVIATIONS = 3.5  # of the signs that differ: a pair right at the floor is missed with a chance of 0.0002
SEED = 20240611


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, normalised; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotation(rounds: np.ndarray) -> np.ndarray:
    """The pseudo-rotation of some rounds of signs as a matrix, for short vectors: one product
    with it takes less time than the passes of the transform over memory."""
    y = np.eye(rounds.shape[1])
    for s in rounds:
        y = hadamard(y * s)
    return y.astype(np.float32)


def plan(n: int, d: int, fill: int = FILL, tables: int = TABLES) -> tuple[int, list[int]]:
    """(tables, axes of each digit) for ``n`` vectors: about n / fill buckets a table."""
    bits = max(1, round(math.log2(max(2.0, n / fill))))
    whole = int(math.log2(2 * d))
    digits = [d] * (bits // whole) + ([2 ** (bits % whole - 1)] if bits % whole else [])
    return math.ceil(tables * max(1.0, n / 65_536) ** 0.1), digits


def signs(tables: int, digits: int, d: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, digits, 3, d))


def buckets(x: np.ndarray, turns: list[np.ndarray], axes: list[int], probes: int) -> np.ndarray:
    """Bucket numbers of the rows of ``x`` in one table: the own bucket, then probes."""
    own, costs, others, scale = np.zeros(len(x), dtype=np.int64), [], [], 1
    for turn, m in zip(turns, axes):
        y = x @ turn[:, :m]
        size = np.abs(y)
        axis = np.argpartition(-size, min(2, m - 1), axis=1)[:, : min(3, m)] if m > 3 else np.broadcast_to(np.arange(m), y.shape)
        value = np.take_along_axis(y, axis, 1)
        order = np.argsort(-np.abs(value), axis=1, kind="stable")
        axis, value = np.take_along_axis(axis, order, 1), np.take_along_axis(value, order, 1)
        digit = axis * 2 + (value < 0)
        own += digit[:, 0] * scale
        for a in range(1, axis.shape[1]):
            costs.append((np.abs(value[:, 0]) - np.abs(value[:, a])) ** 2)
            others.append((digit[:, a] - digit[:, 0]) * scale)
        scale *= 2 * m
    if not costs:
        return own[:, None]
    order = np.argsort(np.array(costs).T, axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], own[:, None] + np.take_along_axis(np.array(others).T, order, 1)], axis=1)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v, h): the rows whose vector has ``dim`` finite numbers, not all zero; equal vectors
    have the same h, 128 bits of hash."""
    v = F.col(vector)
    # of each number: present and finite (NaN and the infinities fail the comparison with the largest float)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028234663852886e38)))
    fit = df.filter(F.col(key).isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))
    plain = fit.select(F.col(key).alias("id"), F.transform(v, lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("v"))
    return plain.withColumn("h", F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_WORDS = [f"w{i}" for i in range(WORDS)]
_ROW = "bucket bigint, node bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)


def _rows(batches: Iterator[pa.RecordBatch], d: int, tables: int, axes: list[int], probes: int) -> Iterator[pa.RecordBatch]:
    """(bucket, node, sketch) of vectors (n, v). A node is twice the number, plus one if the
    vector is stored in the bucket and not only looked up there."""
    pad = 1 << (d - 1).bit_length()
    turns = [[rotation(r) for r in table] for table in signs(tables, len(axes), pad)]
    look = np.concatenate([rotation(r) for r in signs(-(-64 * WORDS // pad), 1, pad, SEED + 1)[:, 0]], axis=1)[:, : 64 * WORDS]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.zeros((batch.num_rows, pad), dtype=np.float32)
        x[:, :d] = _vectors(batch.column(1), d)
        sketch = np.packbits(x @ look > 0, axis=1, bitorder="little").view("<i8")
        node = batch.column(0).to_numpy() * 2
        for t in range(tables):
            b = buckets(x, turns[t], axes, probes)
            each = b.shape[1]
            stored = np.tile(np.arange(each) == 0, len(x))
            words = [pa.array(np.repeat(sketch[:, i], each)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(b.reshape(-1) * tables + t), pa.array(np.repeat(node, each) + stored), *words], names=["bucket", "node", *_WORDS])


def _nearest_sketches(q: np.ndarray, m: np.ndarray, differ: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of candidates (lookup i, stored j) those that differ least, ``most`` for each lookup."""
    order = np.lexsort((m[j], differ, i))
    i, j, differ = i[order], j[order], differ[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, dtype=int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = rank < most
    return q[i[keep]], m[j[keep]], differ[keep]


def _candidates(batches: Iterator[pa.RecordBatch], reach: int, most: int, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """(a, b, differ), a < b, of rows sorted by (bucket, cell); whole groups are taken, many at
    a time. A cell is four times the share, plus two if the row asks, plus one if it may be
    found, which takes a node that is stored."""

    def done(table: pa.Table) -> pa.RecordBatch:
        bucket, node, cell = (table[c].to_numpy() for c in ("bucket", "node", "cell"))
        asks, number, there = (cell & 2).astype(bool), node >> 1, (node & cell & 1).astype(bool)
        words = np.stack([table[w].to_numpy().view(np.uint64) for w in _WORDS])
        group = cell >> 2
        cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1]), [True]]))
        sizes = np.diff(cuts)
        out = []

        def judge(i: np.ndarray, j: np.ndarray) -> None:
            ok = asks[i] & there[j] & (number[i] != number[j])
            i, j = i[ok], j[ok]
            differ = np.zeros(len(i), dtype=np.int16)
            for w in words:
                differ += np.bitwise_count(w[i] ^ w[j])
            ok = differ <= reach
            out.append(_nearest_sketches(number, number, differ[ok], i[ok], j[ok], most))

        # small groups: all their lookups against all their points in one go
        few = np.flatnonzero((sizes > 1) & (sizes <= 256))
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(sizes[few].astype(np.int64) ** 2) // 2_000_000)) + 1):
            n = sizes[part]
            first = np.repeat(cuts[part], n)
            own = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            per = np.repeat(n, n)
            i = np.repeat(own, per)
            judge(i, np.repeat(first, per) + np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per))
        for g in np.flatnonzero(sizes > 256):
            lo, hi = cuts[g], cuts[g + 1]
            q, m = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(there[lo:hi])
            step = max(1, 4_000_000 // max(1, len(m)))
            for s in range(0, len(q), step):
                i = np.repeat(q[s : s + step], len(m))
                judge(i, np.tile(m, len(i) // len(m)) if len(m) else i[:0])
        a, b, differ = (np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int16))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, differ = a[order], b[order], differ[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64()), pa.array(differ[new].astype(np.int16))], names=["a", "b", "differ"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > rows:
            table = pa.Table.from_batches(held).combine_chunks()
            b, s = table["bucket"].to_numpy(), table["cell"].to_numpy() >> 2
            same = np.flatnonzero((b != b[-1]) | (s != s[-1]))
            if len(same):
                yield done(table.slice(0, int(same[-1]) + 1))
                table = table.slice(int(same[-1]) + 1)
            held, size = table.to_batches(), table.num_rows if len(same) else size
    if size:
        yield done(pa.Table.from_batches(held).combine_chunks())


def _cosines(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.einsum("ij,ij->i", _vectors(batch.column(2), d), _vectors(batch.column(3), d))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "cosine"])


def _grid(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (bucket, node, sketch) with their ``cell``, which says in which group of the bucket
    they are compared, and whether they ask or may be found there: one group for most buckets,
    a grid of groups for those of more than ``tile`` rows."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("node") % 2).alias("m")).filter((F.col("n") > tile) & (F.col("m") > 0))
    full = small(cut(sizes.select("bucket", F.ceil(F.col("m") / tile).alias("across"), F.ceil(F.col("n") / tile).alias("down")), "full-buckets"))
    plain = rows.join(full, "bucket", "left_anti").select("*", F.lit(3).cast("bigint").alias("cell"))
    hot = rows.join(full, "bucket")
    home = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asking = hot.withColumn("i", each("across")).select(*rows.columns, (4 * (F.col("i") * F.col("down") + home("down")) + 2).alias("cell"))
    stored = hot.filter(F.col("node") % 2 == 1).withColumn("i", each("down")).select(*rows.columns, (4 * (home("across") * F.col("down") + F.col("i")) + 1).alias("cell"))
    return plain.union(asking).union(stored)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, floor: float = 0.0, tables: int = TABLES, fill: int | None = None, probes: int = PROBES, tile: int = TILE, spare: int = SPARE) -> DataFrame:
    """(a, b, cosine, rank): for every usable vector a its k most similar others of cosine
    ``floor`` or more, as far as the index finds them.

    Vectors that are null, of another length, all zero or hold nulls, NaN or infinities are
    left out, as are null keys; a repeated key counts once. Ties go to the smaller key. Equal
    vectors are neighbours of each other with cosine 1 whatever their number. An empty table
    gives no rows. Other columns are not read.

    What the sketches rule out: more signs apart than the angle of ``floor`` makes likely
    (DEVIATIONS), and in a bucket all but the ``spare * k`` nearest sketches of a lookup.
    """
    rows = usable(df, key, vector, dim)
    points = cut(rows.groupBy("id").agg(F.min("h").alias("h")).select("id", "h.*"), "vector-keys")
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    heads = points.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = rows.select("h.*", "v").groupBy("h1", "h2").agg(F.first("v").alias("v"))
    classes = heads.join(vectors, ["h1", "h2"]).select("h1", "h2", "ids", F.col("ids")[0].alias("id"), "v")
    classes = cut(classes.withColumn("n", F.monotonically_increasing_id()), "vector-classes")
    count, axes = plan(classes.count(), 1 << (dim - 1).bit_length(), fill or (FILL if floor > 0 else FILL_FAR), tables)
    hashed = classes.select("n", "v").mapInArrow(lambda it: _rows(it, dim, count, axes, probes), _ROW)
    share = math.acos(max(-1.0, min(1.0, floor))) / math.pi
    bits = 64 * WORDS
    reach = bits if floor <= 0 else min(bits, math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _grid(hashed, tile).repartition(parts, "bucket", F.shiftright("cell", 2)).sortWithinPartitions("bucket", "cell").mapInArrow(lambda it: _candidates(it, reach, spare * k), "a bigint, b bigint, differ smallint")
    pairs = met.groupBy("a", "b").agg(F.min("differ").alias("differ"))
    if floor <= 0:  # a vector's best candidates over all tables
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), "a", "b", "differ"), F.struct(F.col("b").alias("x"), "a", "b", "differ"))).alias("e")).select("e.*")
        nearer = Window.partitionBy("x").orderBy("differ", "a", "b")
        pairs = ends.withColumn("r", F.row_number().over(nearer)).filter(F.col("r") <= 2 * spare * k).select("a", "b").distinct()
    v = classes.select("n", "v")
    both = pairs.select("a", "b").join(v.withColumnsRenamed({"n": "a", "v": "va"}), "a").join(v.withColumnsRenamed({"n": "b", "v": "vb"}), "b").select("a", "b", "va", "vb")
    scored = cut(both.mapInArrow(lambda it: _cosines(it, dim), "a bigint, b bigint, cosine double").filter(F.col("cosine") >= floor), "near-pairs")
    names = classes.select("n", F.col("id").alias("name"))
    ways = scored.select("a", "b", "cosine").union(scored.select("b", "a", "cosine"))
    top = Window.partitionBy("a").orderBy(F.desc("cosine"), "name")
    near = ways.join(names, ways["b"] == names["n"]).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).select("a", "b", "cosine")
    # from classes back to keys: a class stands for its first k + 1 keys
    kin = classes.select(F.col("n").alias("b"), F.slice("ids", 1, k).alias("others"))
    lists = near.join(kin, "b").groupBy("a").agg(F.collect_list(F.struct("cosine", "others")).alias("near"))  # k at most
    own = points.join(classes.select("h1", "h2", F.col("n").alias("a"), "ids"), ["h1", "h2"]).select(F.col("id").cast("string").alias("key"), "a", F.transform("ids", lambda x: x.cast("string")).alias("ids"))
    every = own.join(lists, "a", "left")
    twins = F.transform(F.array_except("ids", F.array("key")), lambda b: F.struct((-F.lit(1.0)).alias("c"), b.alias("b")))
    others = F.flatten(F.transform(F.coalesce("near", F.array()), lambda x: F.transform(x["others"], lambda b: F.struct((-x["cosine"]).alias("c"), b.cast("string").alias("b")))))
    ranked = F.slice(F.sort_array(F.concat(twins, others)), 1, k)
    out = every.select(F.col("key").alias("a"), F.posexplode(ranked).alias("p", "x"))
    return out.select("a", F.col("x.b").alias("b"), (-F.col("x.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def links(found: DataFrame, floor: float) -> DataFrame:
    """Unordered pairs (a < b) where one is among the nearest of the other."""
    near = found.filter(F.col("cosine") >= floor)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
