"""Evaluation of retrieval and answers, as one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.records import passed_over
from foliant.session import cut

UNSUPPORTED, OVERLAP = 0.30, 0.60
#: Fixed value
SPECULATIVE = (
    r"(?i)\b(?:may\s+be|might\s+be|could\s+(?:be|suggest|indicate|imply)|possibly|perhaps|indirectly|seems\s+to|appears\s+to|it\s+is\s+(?:possible|likely|probable)|"
    r"suggests?\s+a\s+(?:possible|potential)|cannot\s+be\s+confirmed|cannot\s+confirm|implicitly|may\s+(?:have|indicate|suggest|imply))\b"
)


def results(df: DataFrame) -> DataFrame:
    return df.filter("query_id IS NOT NULL").dropDuplicates(["query_id"])


def ranks(df: DataFrame, tolerance: int = 1) -> DataFrame:
    """(query_id, rank, reciprocal_rank, hit_1, hit_3, hit_5) of results with expected_document,
    expected_page and retrieved_top5: the first source of the document, in any case, within
    ``tolerance`` pages; 0 if none."""
    own = F.transform("retrieved_top5", lambda s, i: F.when((F.lower(s["document"]) == F.lower("expected_document")) & (F.abs(s["page"] - F.col("expected_page")) <= tolerance), i + 1))
    rank = F.coalesce(F.array_min(own), F.lit(0))
    at = lambda k: ((F.col("rank") > 0) & (F.col("rank") <= k)).cast("int")
    return df.select("*", rank.alias("_rank")).drop("rank").withColumnRenamed("_rank", "rank").select("query_id", "question_type", "rank", F.when(F.col("rank") > 0, F.round(1.0 / F.col("rank"), 6)).otherwise(F.lit(0.0)).alias("reciprocal_rank"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(5).alias("hit_5"))


def report(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall and precision at 1, 3 and 5, mean reciprocal rank; for all or by columns. All
    questions count, found or not."""
    k = {1: "hit_1", 3: "hit_3", 5: "hit_5"}
    recall = [F.round(F.avg(c), 4).alias(f"recall_at_{n}") for n, c in k.items()]
    precision = [F.round(F.avg(F.col(c) / n), 4).alias(f"precision_at_{n}") for n, c in k.items()]
    return ranked.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, *precision, F.round(F.avg("reciprocal_rank"), 4).alias("mrr"))


def whole_report(ranked: DataFrame, grounded: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row: the report of retrieval, the means of what is known of the answers (faithfulness,
    coverage, similarity, relevancy and confidence, where there), the shares that are unsupported
    and speculative, and the mean of each stage's latency, a column of ``latencies``."""
    both = ranked.select("query_id", "question_type", "rank", "reciprocal_rank", "hit_1", "hit_3", "hit_5").join(grounded, "query_id", "left")
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("faithfulness", "coverage", "similarity", "relevancy", "confidence") if c in grounded.columns]
    rates = [F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate") for c in ("unsupported", "speculative") if c in grounded.columns]
    one = report(both).crossJoin(both.agg(*means, *rates))  # two single rows
    if latencies is None:
        return one
    times = [c for c in latencies.columns if c != "query_id"]
    return one.crossJoin(latencies.agg(*[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in times]))


def grounding_summary(ranked: DataFrame, grounded: DataFrame) -> DataFrame:
    """(question_type, n, mean_faithfulness, mean_coverage, unsupported_rate, speculative_rate,
    recall_at_3) of each type of question."""
    both = ranked.select("query_id", "question_type", "hit_3").join(grounded, "query_id")
    return both.groupBy("question_type").agg(
        F.count("*").alias("n"), F.round(F.avg("faithfulness"), 4).alias("mean_faithfulness"), F.round(F.avg("coverage"), 4).alias("mean_coverage"),
        F.round(F.avg(F.col("unsupported").cast("int")), 4).alias("unsupported_rate"), F.round(F.avg(F.col("speculative").cast("int")), 4).alias("speculative_rate"), F.round(F.avg("hit_3"), 4).alias("recall_at_3"),
    )


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's words that stand in the context."""
    words = [T.token_set(x, T.EVALUATION_STOPWORDS, True) for x in (answer, context)]
    return F.round(T.recall(*words), 4)


def coverage(answer: Column, contexts: Column) -> Column:
    """Share of sentences over 10 characters that share three words with some one context."""
    said = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "[.!?]"), lambda p: F.trim(p)), lambda s: F.length(s) > 10)
    sets = F.transform(contexts, lambda c: T.token_set(c, T.EVALUATION_STOPWORDS, True))
    held = F.filter(said, lambda s: F.exists(sets, lambda c: F.size(F.array_intersect(T.token_set(s, T.EVALUATION_STOPWORDS, True), c)) >= 3))
    return F.when(F.size(said) == 0, F.lit(1.0)).otherwise(F.round(F.size(held) / F.size(said), 4))


def is_speculative(answer: Column, from_graph: Column) -> Column:
    return from_graph & F.coalesce(answer.rlike(SPECULATIVE), F.lit(False))


def grounding(pairs: DataFrame) -> DataFrame:
    """(query_id, faithfulness, coverage, unsupported, speculative) of (query_id, answer,
    contexts, from_graph)."""
    f = faithfulness(F.col("answer"), F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), " "))
    return pairs.select("query_id", f.alias("faithfulness"), coverage(F.col("answer"), F.coalesce("contexts", F.array().cast("array<string>"))).alias("coverage"), is_speculative(F.col("answer"), F.col("from_graph")).alias("speculative")).withColumn("unsupported", F.col("faithfulness") < UNSUPPORTED)


def answer_similarity(answer: Column, reference: Column, semantic: Column | None = None) -> Column:
    """Similarity of an answer to its reference: the overlap coefficient of their words, or the
    embedding similarity where that is higher. It is symmetric, so precision is recall."""
    words = [T.token_set(x, T.EVALUATION_STOPWORDS, True) for x in (answer, reference)]
    overlap = T.overlap_coefficient(*words)
    score = F.greatest(overlap, semantic) if semantic is not None else overlap
    return F.when(F.trim(F.coalesce(reference, F.lit(""))) == "", F.lit(0.0)).otherwise(F.round(score, 4))


def latency(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Number, mean, 95th percentile by nearest rank, least and most of a latency."""
    x = F.col(column)
    return df.filter(x.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(x), 3).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{column}`)").alias("p95"), F.min(x).alias("fastest"), F.max(x).alias("slowest"))


def adjacent(chunks: DataFrame, first: int = 3) -> DataFrame:
    """(document, chunk_index, next_index): the first neighbouring chunks of each document."""
    w = Window.partitionBy("document").orderBy("chunk_index")
    rows = chunks.select("document", "chunk_index", F.lead("chunk_index").over(w).alias("next_index"), F.row_number().over(w).alias("_r"))
    return rows.filter(F.col("next_index").isNotNull() & (F.col("_r") <= first)).drop("_r")


def fallback_questions(chunks: DataFrame) -> DataFrame:
    """A question and answer for every chunk where no model writes any: what does it state, and
    its first sentence, cut at a word to 220 characters."""
    t = F.coalesce("text", F.lit(""))
    one = F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda s: s != ""), F.lit(0)), F.lit("")), r"\s+", " "))
    short = F.concat(F.regexp_replace(F.regexp_replace(F.substring(one, 1, 220), r" [^ ]*$", ""), r"[ ,;:]+$", ""), F.lit("..."))
    answer = F.when(F.length(one) > 220, short).when(one == "", "See the referenced document chunk.").otherwise(one)
    question = F.concat(F.lit("What information is stated in "), "document", F.lit(" on page "), F.col("page").cast("string"), F.lit(", chunk "), F.col("chunk_index").cast("string"), F.lit("?"))
    return chunks.select("document", "page", "chunk_index", question.alias("question"), answer.alias("answer"))


def relational_questions(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(document, chunk_index, question, answer, kind): how the first two entities of a chunk that
    mentions two or more are related, for the first ``most`` such chunks of a document."""
    named = mentions.filter("document IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''").groupBy("document", "chunk_index", "entity_id").agg(F.min_by("text", "mention_id").alias("text"), F.min("mention_id").alias("first"))
    w = Window.partitionBy("document", "chunk_index").orderBy("first")
    two = named.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("document", "chunk_index").agg(F.max(F.when(F.col("r") == 1, F.col("text"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("text"))).alias("b")).filter("b IS NOT NULL")
    first = two.withColumn("r", F.row_number().over(Window.partitionBy("document").orderBy("chunk_index"))).filter(F.col("r") <= most)
    return first.select("document", "chunk_index", F.concat(F.lit("How are "), "a", F.lit(" and "), "b", F.lit(" related in "), "document", F.lit("?")).alias("question"), F.lit("").alias("answer"), F.lit("relational").alias("kind"))


def written_questions(chunks: DataFrame, write: Callable[[str], str], verify: Callable[[str, str], str] | None = None, most: int = 5) -> DataFrame:
    """(document, chunk_index, question, answer, kind): questions a model writes about each chunk,
    its list read by ``parse_questions``, ``most`` for a chunk. ``verify`` (question, text) gives
    the passage that answers it or says there is none, and then the question goes; a verifier
    that fails lets it pass, marked as unverified."""
    from foliant.plugins import is_unanswered, parse_questions

    kind = "document string, chunk_index int, question string, answer string, kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for document, at, text in zip(f["document"], f["chunk_index"], f["text"]):
                try:
                    asked = parse_questions(write(text))[:most]
                except Exception:  # noqa: BLE001 - other chunks are still asked about
                    asked = []
                for q in asked:
                    answer = ""
                    if verify:
                        try:
                            answer = verify(q, text)
                        except Exception:  # noqa: BLE001
                            answer = "UNVERIFIED"
                        if is_unanswered(answer):
                            continue
                    out.append((document, at, q, answer, "factual"))
            yield pd.DataFrame(out, columns=["document", "chunk_index", "question", "answer", "kind"])

    return chunks.filter("text IS NOT NULL AND trim(text) <> ''").select("document", "chunk_index", "text").mapInPandas(run, kind)


def question_pool(chunks: DataFrame, needed: int = 10, mentions: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """(document, question, answer, kind): for each document, factual questions a model wrote,
    relational ones about entities met in a chunk, comparative ones about neighbouring chunks
    and, up to ``needed``, what single chunks state. ``mentions`` and ``written`` may be left out."""
    both = adjacent(chunks).select("document", F.concat(F.lit("How do chunks "), F.col("chunk_index").cast("string"), F.lit(" and "), F.col("next_index").cast("string"), F.lit(" of "), "document", F.lit(" differ?")).alias("question"), F.lit("").alias("answer"), F.lit("comparative").alias("kind"), F.col("chunk_index"))
    single = fallback_questions(chunks).select("document", "question", "answer", F.lit("fallback").alias("kind"), "chunk_index")
    if mentions is not None:
        both = both.unionByName(relational_questions(mentions))
    if written is not None:
        both = both.unionByName(written)
    order = F.array_position(F.array(*[F.lit(k) for k in ("factual", "relational", "comparative", "fallback")]), F.col("kind"))
    w = Window.partitionBy("document").orderBy(order, "chunk_index", "question")
    return both.unionByName(single).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= needed).select("document", "question", "answer", "kind")


def stage_latency(stages: Column, defaults: list[str]) -> Column:
    """A map of stage times with 0 for stages that did not run and their total."""
    zero = F.map_from_arrays(F.array(*[F.lit(x) for x in defaults]), F.array(*[F.lit(0.0) for _ in defaults]))
    given = F.map_filter(F.coalesce(stages, F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull())
    kept = F.map_filter(zero, lambda k, v: ~F.map_contains_key(given, k))
    merged = F.map_concat(kept, F.transform_values(given, lambda k, v: F.round(v, 3)))
    total = F.aggregate(F.map_values(given), F.lit(0.0), lambda s, v: s + v)
    return F.map_concat(merged, F.create_map(F.lit("total"), F.round(total, 3)))


def _overlaps(index: list[np.ndarray], probes: list[np.ndarray], overlap: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (probe, index) of sets that overlap by ``overlap`` of the smaller one: frequent
    words are counted by a dense product, the rest by their postings."""
    sizes, own = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (index, probes))
    words, code = np.unique(np.concatenate(index), return_inverse=True)
    owner = np.repeat(np.arange(len(index)), sizes)
    df = np.bincount(code, minlength=len(words))
    often = np.flatnonzero(df * 64 >= len(index))
    column = np.full(len(words), -1)
    column[often] = np.arange(len(often))
    dense = np.zeros((len(index), len(often)), dtype=np.float32)
    hit = column[code] >= 0
    dense[owner[hit], column[code[hit]]] = 1
    posting = owner[np.argsort(code, kind="stable")]
    begin = np.cumsum(df) - df
    for r in range(0, len(probes), rows):
        some = probes[r : r + rows]
        who, w = np.repeat(np.arange(len(some)), own[r : r + rows]), np.concatenate(some)
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        known = words[at] == w
        who, at = who[known], at[known]
        mine = np.zeros((len(some), len(often)), dtype=np.float32)
        hit = column[at] >= 0
        mine[who[hit], column[at[hit]]] = 1
        both = mine @ dense.T
        who, at = who[~hit], at[~hit]
        n = df[at]
        where = np.repeat(begin[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell, times = np.unique(np.repeat(who, n) * len(index) + posting[where], return_counts=True)
        both.reshape(-1)[cell] += times.astype(np.float32)
        i, j = np.nonzero(both >= np.float32(overlap * min(own[r : r + rows].min(), sizes.min()) - 0.01))
        good = both[i, j].astype(np.float64) / np.minimum(own[r + i], sizes[j]) >= overlap
        yield r + i[good], j[good]


def distinct_questions(pool: DataFrame, overlap: float = OVERLAP, whole: bool = False, most: int = 8192) -> DataFrame:
    """(block, question_id, question) kept when no earlier kept question of its block, or of the
    ``whole`` pool, overlaps it by ``overlap`` of the smaller word set. Ids are unique in a block.

    Equal word sets are compared once. Sets are dealt to slots of about ``most`` and each two
    slots compared in a task, which finds all pairs that overlap (up to 64-bit hashes of
    words). The greedy pass goes over these pairs."""
    key = F.lit(0).cast("bigint") if whole else F.xxhash64("block")
    words = T.token_set(F.col("question"), T.EVALUATION_STOPWORDS, True)
    rows = cut(pool.select("block", "question_id", "question", key.alias("b"), F.array_sort(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))).alias("words")), "questions")
    sets = cut(rows.filter(F.size("words") > 0).groupBy("b", "words").agg(F.min("question_id").alias("id")), "sets")
    slots = sets.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("slots"))
    dealt = sets.join(slots, "b").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = dealt.select("b", "id", "words", "slot", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["slot"] == f["x"]], f[f["slot"] == f["y"]]
        ids = (left["id"].to_numpy(), right["id"].to_numpy())
        found: list[tuple] = []
        if len(left) and len(right):
            for i, j in _overlaps(list(left["words"]), list(right["words"]), overlap):
                found += [(min(p, q), max(p, q)) for p, q in zip(ids[1][i], ids[0][j]) if p < q or (p != q and f["x"].iloc[0] != f["y"].iloc[0])]
        return pd.DataFrame({"b": f["b"].iloc[0], "early": pd.Series([p for p, _ in found], dtype=object), "late": pd.Series([q for _, q in found], dtype=object)})

    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["question_id"].dataType.simpleString()
    pairs = cut(dealt.repartition(parts, "b", "x", "y").groupBy("b", "x", "y").applyInPandas(run, f"b bigint, early {kind}, late {kind}"), "overlaps")
    kept = sets.select("b", F.col("id").alias("question_id"))
    kept = kept.join(passed_over(pairs).withColumnRenamed("late", "question_id"), ["b", "question_id"], "left_anti")
    out = rows.filter(F.size("words") > 0).join(kept, ["b", "question_id"], "left_semi").unionByName(rows.filter(F.size("words") == 0))
    return out.select("block", "question_id", "question")
