"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.lit("page").alias("src"), "document", F.col("page").alias("idx"), F.col("raw_text").alias("text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.lit("chunk").alias("src"), "document", F.col("chunk_index").alias("idx"), "text")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("page").alias("src"), "document", F.col("page").alias("idx"), "page", F.col("raw_text").alias("text"))
    return pages.union(table(spark, d, "chunks").select(F.lit("chunk"), "document", "chunk_index", "page", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.noise import found

    return found(_scanned(spark, d))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.noise import repaired

    return repaired(_scanned(spark, d))


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.noise import repaired

    pages = table(spark, d, "pages").select("document", "page", F.posexplode("blocks").alias("idx", "block"))
    blocks = pages.select(F.lit("block").alias("src"), "document", "idx", "page", F.col("block.text").alias("text"))
    whole = table(spark, d, "pages").select(F.lit("page").alias("src"), "document", F.col("page").alias("idx"), "page", F.col("raw_text").alias("text"))
    return repaired(whole.union(blocks)).filter("src = 'block'").select("document", F.col("idx").alias("block"), "paragraph", "text")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.split import split_oversized

    items = _pages(spark, d).union(_chunks(spark, d)).distinct()
    return split_oversized(items, ["src", "document", "idx"], "text").select("src", "document", "idx", "piece", "start", "overlap_chars", "tokens", "piece_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.split import split_oversized

    pieces = split_oversized(_pages(spark, d).union(_chunks(spark, d)), ["src", "document", "idx"], "text")
    return pieces.filter("pieces > 1 AND piece = 0").select("src", "document", "idx").distinct()


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item add up to without their overlaps, and whether all keep the limits."""
    from foliant.llm.split import LIMIT_TOKENS, OVERLAP_TOKENS, split_oversized

    items = _pages(spark, d).union(_chunks(spark, d)).distinct()
    pieces = split_oversized(items.withColumn("item", F.md5("text")), ["src", "document", "idx", "item"], "text")
    own = F.struct("piece", F.col("piece_text").substr(F.col("overlap_chars") + 1, F.length("piece_text")).alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "")
    fits = (F.col("tokens") <= LIMIT_TOKENS) & (F.col("overlap_chars") <= 4 * OVERLAP_TOKENS)
    return pieces.groupBy("src", "document", "idx", "item").agg(F.md5(whole).alias("rebuilt"), F.min(fits).alias("fits")).select("src", "document", "idx", "rebuilt", "fits")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the token ids of p8_ids decode to, as their hash."""
    from foliant.llm.tokens import decode_corpus

    return decode_corpus(p8_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.near import near_pairs

    questions = near_pairs(table(spark, d, "eval_results"), "query_id", "question").select(F.lit("question").alias("src"), "id_a", "id_b")
    return questions.union(near_pairs(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunk"), "id_a", "id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.near import near_classes

    columns = ("id", F.col("class").alias("class_id"), "copies", "links")
    questions = near_classes(table(spark, d, "eval_results"), "query_id", "question").select(F.lit("question").alias("src"), *columns)
    return questions.union(near_classes(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunk"), *columns))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.pairs import broken_pairs

    results, responses = table(spark, d, "eval_results"), table(spark, d, "query_responses")
    pairs = results.select(F.lit("generated").alias("src"), F.col("query_id").alias("row_id"), "question", F.col("generated_answer").alias("answer"))
    pairs = pairs.union(results.select(F.lit("reference"), "query_id", "question", "reference_answer"))
    return broken_pairs(pairs.union(responses.select(F.lit("response"), "response_id", "original_query", "answer")))


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.names import ORGANISATION_LABELS, PERSON_LABELS

    entities = table(spark, d, "entities").filter(F.col("label").isin(*PERSON_LABELS, *ORGANISATION_LABELS)).withColumn("person", F.col("label").isin(*PERSON_LABELS))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    names = entities.select("entity_id", "person", F.lit(0).alias("rank"), tidy(F.col("name")).alias("text"))
    aliases = entities.select("entity_id", "person", F.lit(1).alias("rank"), F.explode("aliases").alias("text"))
    mentions = table(spark, d, "mentions").filter(F.col("label").isin(*PERSON_LABELS, *ORGANISATION_LABELS))
    person = F.col("label").isin(*PERSON_LABELS)
    typed = mentions.select("entity_id", person.alias("person"), F.explode(F.array(tidy(F.col("text")), tidy(F.col("normalized")))).alias("text")).distinct().select("entity_id", "person", F.lit(2).alias("rank"), "text")
    return names.union(aliases).union(typed)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.names import pairs, resolve

    return pairs(resolve(_spellings(spark, d), table(spark, d, "name_forms")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.names import resolve

    return resolve(_spellings(spark, d), table(spark, d, "name_forms")).select("entity_id", F.col("root").alias("group_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.neighbours import links, nearest

    found = links(nearest(table(spark, d, "cache_rows"), "cache_id", "embedding", floor=0.85), 0.85)
    return found.select(F.col("a").alias("cache_a"), F.col("b").alias("cache_b"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.packing import pack_texts

    return pack_texts(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.spans import pieces, shared_chars

    return shared_chars(pieces(table(spark, d, "documents")))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    from foliant.llm.spans import passages

    found = passages(table(spark, d, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("partner").alias("partner_id"), "start", "end", "partner_start", "partner_end", "verbatim_chars", "gaps", "edits", "identity", F.size("pieces").alias("exact_pieces"), F.col("class").alias("class_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p1_blocks": p1_blocks,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rebuilt": p2_rebuilt,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_passages": p10_passages,
}

_NORMALISED = """
    texts AS (SELECT DISTINCT src, id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM (
        SELECT 'question' AS src, query_id AS id, question AS text FROM eval_results UNION ALL SELECT 'chunk', chunk_id, text FROM chunks) WHERE id IS NOT NULL AND text IS NOT NULL),
    kept AS (SELECT src, id, norm, min(id) OVER (PARTITION BY src, norm) AS class FROM texts WHERE norm <> ''),
    grams AS (SELECT src, class, unnest(list_distinct(CASE WHEN length(norm) <= 4 THEN [norm] ELSE list_transform(range(1, length(norm) - 2), lambda i: substr(norm, i, 4)) END)) AS g FROM kept WHERE id = class),
    sizes AS (SELECT src, class, count(*) AS n FROM grams GROUP BY ALL),
    common AS (SELECT a.src, a.class AS a, b.class AS b, count(*) AS c FROM grams a JOIN grams b ON a.src = b.src AND a.g = b.g AND a.class < b.class GROUP BY ALL),
    alike AS (SELECT c.src, c.a, c.b FROM common c JOIN sizes x ON x.src = c.src AND x.class = c.a JOIN sizes y ON y.src = c.src AND y.class = c.b WHERE c.c / (x.n + y.n - c.c) >= 0.7)"""

ORACLE: dict[str, str] = {
    "p2_found": """
        SELECT DISTINCT 'page' AS src, document, page AS idx FROM pages WHERE floor(length(raw_text) / 4) > 512
        UNION ALL
        SELECT DISTINCT 'chunk', document, chunk_index FROM chunks WHERE floor(length(text) / 4) > 512
    """,
    "p2_rebuilt": """
        SELECT DISTINCT src, document, idx, md5(text) AS rebuilt, true AS fits FROM (
            SELECT 'page' AS src, document, page AS idx, raw_text AS text FROM pages UNION ALL SELECT 'chunk', document, chunk_index, text FROM chunks) WHERE text IS NOT NULL
    """,
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p3_found": f"""
        WITH {_NORMALISED}
        SELECT s.src, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM alike s JOIN kept x ON x.src = s.src AND x.class = s.a JOIN kept y ON y.src = s.src AND y.class = s.b
        UNION ALL SELECT x.src, x.id, y.id FROM kept x JOIN kept y ON x.src = y.src AND x.class = y.class AND x.id < y.id
    """,
    "p3_classes": f"""
        WITH {_NORMALISED}
        SELECT k.src, k.id, k.class AS class_id, count(*) OVER (PARTITION BY k.src, k.class) AS copies, coalesce(l.links, 0) AS links
        FROM kept k LEFT JOIN (SELECT src, class, count(*) AS links FROM (SELECT src, a AS class FROM alike UNION ALL SELECT src, b FROM alike) GROUP BY ALL) l ON l.src = k.src AND l.class = k.class
    """,
    "p6_found": """
        WITH points AS (SELECT cache_id, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM cache_rows WHERE cache_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY cache_id),
        near AS (SELECT a.cache_id AS a, b.cache_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM points a JOIN points b ON a.cache_id <> b.cache_id),
        top AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM near)
        SELECT DISTINCT least(a, b) AS cache_a, greatest(a, b) AS cache_b FROM top WHERE r <= 5 AND c >= 0.85
    """,
    "p10_found": """
        WITH windows AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i FROM windows SEMI JOIN shared USING (h))
        SELECT doc_id, CAST(sum(least(200, coalesce(next_i - i, 200))) AS BIGINT) AS shared_chars FROM starts GROUP BY doc_id
    """,
}
