"""Filling containers of fixed capacity from optimal length buckets.

A length is at most the capacity, so the global histogram has at most ``capacity`` bins
whatever the corpus holds, and everything decided on the driver is decided on it:

1. dynamic programming over the histogram chooses the bucket ceilings that minimise the
   padding, i.e. the sum of (ceiling - length);
2. token-budget batches are formed over the buckets: a batch opens in the largest bucket
   that still has items and takes from the largest bucket that fits its remaining budget.
   The same batch is repeated as often as the buckets allow, so the plan has one entry for
   each kind of batch, not for each container.

Items then find their container by their rank within their bucket. Ranks come from counts
of (bucket, salt), so no bucket is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut

CAPACITY = 2048
BUCKETS = 256
ROWS_PER_SALT = 20_000
MAX_SALTS = 4096


def optimal_ceilings(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Ceilings, ascending, of at most ``buckets`` intervals with the least total padding."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if len(lengths) <= buckets:
        return lengths.tolist()
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(counts)])
    s = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    m = len(lengths)
    # cost[i, j]: lengths i..j-1 rounded up to lengths[j-1]
    cost = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        cost[:j, j] = lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
    best, back = cost[0].copy(), []
    best[0] = 0.0
    for _ in range(buckets - 1):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
        best[0] = 0.0
    ends, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        ends.append(j)
        j = int(arg[j])
    if j > 0:
        ends.append(j)
    return sorted({int(lengths[e - 1]) for e in ends})


def plan_batches(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Token-budget batches over {ceiling: items}. Rows (ceiling, rank_start, rank_end,
    per_batch, first_container): items of that ceiling with those ranks go to consecutive
    containers, ``per_batch`` to each."""
    left = {c: n for c, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    plan, container = [], 0
    while left:
        budget, batch = capacity, {}
        for c in sorted(left, reverse=True):
            k = min(budget // c, left[c])
            if k:
                batch[c] = k
                budget -= k * c
        times = min(left[c] // k for c, k in batch.items())
        for c, k in batch.items():
            plan.append((c, taken[c], taken[c] + k * times, k, container))
            taken[c] += k * times
            left[c] -= k * times
            if not left[c]:
                del left[c]
        container += times
    return plan


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Assign every item to a container: (key, part, start, n_tokens, bucket, container_id).

    An item larger than the capacity is divided into parts of the capacity and a rest; no
    other item is divided. Items with a null or non-positive size take no room and do not
    appear. Each row is an item of its own, so repeated rows each get room. An empty table
    gives no rows. Sizes of a container never add up to more than the capacity.
    """
    spark = sizes.sparkSession
    n = F.col("size")
    parts = F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)
    pieces = (
        sizes.select(F.col(key).alias("item"), F.col(size).cast("bigint").alias("size"))
        .filter(n > 0)
        .select("item", "size", F.explode(parts).alias("part"))
        .select("item", "part", (F.col("part") * F.lit(capacity)).cast("bigint").alias("start"), F.least(F.lit(capacity), n - F.col("part") * F.lit(capacity)).cast("int").alias("tokens"))
    )
    histogram = {int(r["tokens"]): int(r["n"]) for r in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    kind = sizes.schema[key].dataType.simpleString()
    if not histogram:
        return spark.createDataFrame([], f"`{key}` {kind}, part int, start bigint, n_tokens int, bucket int, container_id bigint")
    ceilings = optimal_ceilings(histogram, buckets)
    of = {length: int(ceilings[np.searchsorted(ceilings, length)]) for length in histogram}
    counts: dict[int, int] = {}
    for length, c in histogram.items():
        counts[of[length]] = counts.get(of[length], 0) + c
    plan = spark.createDataFrame(plan_batches(counts, capacity), "bucket int, rank_start bigint, rank_end bigint, per_batch bigint, first bigint")
    # both tables below are bounded by the capacity, not by the corpus
    to_bucket = spark.createDataFrame(sorted(of.items()), "tokens int, bucket int")
    salts = max(1, min(MAX_SALTS, -(-sum(histogram.values()) // ROWS_PER_SALT)))
    items = pieces.join(F.broadcast(to_bucket), "tokens").withColumn("salt", F.pmod(F.xxhash64("item", "part"), F.lit(salts)))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("bucket", "salt").agg(F.count("*").alias("n")).select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "salt").orderBy("item", "part")
    ranked = items.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["bucket", "salt"]).withColumn("rank", F.col("r") + F.col("offset"))
    placed = ranked.join(F.broadcast(plan), (ranked["bucket"] == plan["bucket"]) & (F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_end")))
    container = F.col("first") + F.floor((F.col("rank") - F.col("rank_start")) / F.col("per_batch"))
    return placed.select(F.col("item").alias(key), "part", "start", F.col("tokens").alias("n_tokens"), ranked["bucket"], container.cast("bigint").alias("container_id"))


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``pack`` for texts sized in tokens of a public tokenizer. Counting is the costly
    part, so the counts are written once and read by the histogram and the assignment."""
    from foliant.llm.tokens import token_counts

    return pack(cut(token_counts(df, key, text, vocabulary), "token-counts"), key, "n_tokens", capacity)
