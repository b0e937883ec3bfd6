"""Queries of the core operators, each with its SQL where SQL can express it.

Tables are read whole. Questions of searches are the stated set: those whose id is divisible
by 50. Facts for the numeric operators are sentences written from the order tables, as the
corpus holds none; both sides write the same sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, evaluation, graph, records, retrieval, state, units
from foliant.plans import planner
from foliant.session import cut, is_stored, keep, table
from foliant.sources import corpus
from foliant.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STATED = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- shared parts -----------------------------------------------------------------------------
def results(s: SparkSession, d: str) -> DataFrame:
    return evaluation.results(table(s, d, "eval_results"))


def stated(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).filter((F.col("query_id") % STATED == 0) & F.col("question").isNotNull()).select("query_id", "question")


def questions(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).filter("question IS NOT NULL").select("query_id", "question")


def responses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "query_responses").filter("response_id IS NOT NULL").groupBy("response_id").agg(*[F.min_by(c, "received_at").alias(c) for c in ("session_id", "original_query", "answer", "status", "cache_hit", "latency_ms", "created_at")])


def cache(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cache_rows").filter("cache_id IS NOT NULL").dropDuplicates(["cache_id"])


def mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mentions").filter("mention_id IS NOT NULL").dropDuplicates(["mention_id"])


_INDEXES: dict[tuple, retrieval.Index] = {}


def index(s: SparkSession, d: str) -> retrieval.Index:
    """The stored index of the chunks of ``d``, built once in an application as an ingest would."""
    key = (s.sparkContext.applicationId, d)
    held = _INDEXES.get(key)
    if held is None or not all(map(is_stored, (held.forward, held.terms))):
        held = _INDEXES[key] = retrieval.build_index(corpus.corpus(s, d))
        keep(held.forward, held.terms)
    return held


CHUNKS = "(SELECT document, chunk_index, any_value(page) AS page, any_value(text) AS text, any_value(token_count) AS token_count, any_value(entities) AS entities, any_value(ocr_confidence) AS ocr_confidence FROM chunks WHERE document IS NOT NULL AND chunk_index IS NOT NULL GROUP BY document, chunk_index)"
PAGES = "(SELECT document, page, any_value(raw_text) AS raw_text, any_value(ocr_confidence) AS ocr_confidence, any_value(extraction_method) AS extraction_method, any_value(blocks) AS blocks FROM pages WHERE document IS NOT NULL AND page IS NOT NULL GROUP BY document, page)"
RESULTS = "(SELECT query_id, any_value(question) AS question, any_value(expected_document) AS expected_document, any_value(expected_page) AS expected_page, any_value(question_type) AS question_type, any_value(generated_answer) AS generated_answer, any_value(reference_answer) AS reference_answer, any_value(retrieved_top5) AS retrieved_top5, any_value(total_response_time_ms) AS total_response_time_ms FROM eval_results WHERE query_id IS NOT NULL GROUP BY query_id)"
MENTIONS = "(SELECT mention_id, any_value(entity_id) AS entity_id, any_value(text) AS text, any_value(label) AS label, any_value(normalized) AS normalized, any_value(confidence) AS confidence, any_value(document) AS document, any_value(page) AS page, any_value(chunk_index) AS chunk_index FROM mentions WHERE mention_id IS NOT NULL GROUP BY mention_id)"
RESPONSES = "(SELECT response_id, arg_min(session_id, received_at) AS session_id, arg_min(original_query, received_at) AS original_query, arg_min(answer, received_at) AS answer, arg_min(cache_hit, received_at) AS cache_hit, arg_min(latency_ms, received_at) AS latency_ms, arg_min(created_at, received_at) AS created_at FROM query_responses WHERE response_id IS NOT NULL GROUP BY response_id)"
CACHE = "(SELECT cache_id, any_value(corpus_key) AS corpus_key, any_value(normalized_question) AS normalized_question, any_value(top_k) AS top_k, any_value(embedding) AS embedding, any_value(answer) AS answer, any_value(created_at) AS created_at, any_value(last_accessed_at) AS last_accessed_at FROM cache_rows WHERE cache_id IS NOT NULL GROUP BY cache_id)"
STEM = "regexp_replace(lower({0}), '^(.{{3,}}?)(?:" + "|".join(T.SUFFIXES) + ")$', '\\1')"
WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"


def stem_sql(x: str) -> str:
    return STEM.format(x)


def token_set_sql(x: str, stopwords: list[str] = T.EVALUATION_STOPWORDS, stemmed: bool = True) -> str:
    stop = ", ".join(f"'{w}'" for w in stopwords)
    kept = f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({stop}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda w: {stem_sql('w')})))" if stemmed else f"list_sort(list_distinct({kept}))"


def re_sql(pattern: str) -> str:
    return pattern.replace("'", "''")


# -- sources and sinks --------------------------------------------------------------------------
@query(f"SELECT DISTINCT document FROM {CHUNKS}")
def document_list(s, d):
    return corpus.document_list(corpus.corpus(s, d))


@query(f"""
    SELECT document, count(*) AS n_chunks, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, floor((2 * sum(CAST(round(coalesce(ocr_confidence, 1.0) * 1000000) AS BIGINT)) + 1000 * count(*)) / (2000 * count(*))) / 1000.0 AS avg_confidence,
           CAST(len(list_distinct(flatten(list(coalesce(entities, []))))) AS INTEGER) AS n_entities FROM {CHUNKS} GROUP BY document""")
def document_info(s, d):
    return corpus.document_info(corpus.corpus(s, d))


@query(f"""
    SELECT p.document, p.pages, p.ocr_confidence, p.methods, coalesce(c.chunks, 0) AS chunks, coalesce(m.entities, 0) AS entities
    FROM (SELECT document, count(*) AS pages, CASE WHEN count(ocr_confidence) > 0 THEN floor((2 * sum(CAST(round(ocr_confidence * 1000000) AS BIGINT)) + 1000 * count(ocr_confidence)) / (2000 * count(ocr_confidence))) / 1000.0 END AS ocr_confidence, array_to_string(list_sort(list(DISTINCT extraction_method) FILTER (extraction_method IS NOT NULL)), '+') AS methods FROM {PAGES} GROUP BY document) p
    LEFT JOIN (SELECT document, count(*) AS chunks FROM {CHUNKS} GROUP BY document) c USING (document)
    LEFT JOIN (SELECT document, count(DISTINCT entity_id) AS entities FROM mentions WHERE document IS NOT NULL GROUP BY document) m USING (document)""")
def ingest_rollup(s, d):
    return corpus.ingest_rollup(corpus.page_table(s, d), corpus.corpus(s, d), table(s, d, "mentions"))


@query(f"""
    SELECT substr(sha256(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) || ':' || count(*) || '|chunks:' || CAST(sum(n) AS BIGINT)), 1, 16) AS corpus_key, CAST(sum(n) AS BIGINT) AS n_chunks
    FROM (SELECT md5(document) AS h, count(*) AS n FROM {CHUNKS} GROUP BY document)""")
def corpus_fingerprint(s, d):
    return corpus.fingerprint(corpus.corpus(s, d))


@query(f"SELECT document, page, chunk_index, length(text) AS chars FROM {CHUNKS} WHERE page = 1")
def filtered_scan(s, d):
    return corpus.scan(corpus.corpus(s, d), {"page": 1}).select("document", "page", "chunk_index", F.length("text").cast("bigint").alias("chars"))


@query(f"SELECT document, page, CASE WHEN length(trim(coalesce(raw_text, ''))) >= 40 THEN 'native' ELSE 'ocr' END AS route FROM {PAGES}")
def extraction_route(s, d):
    return corpus.page_table(s, d).select("document", "page", corpus.extraction_route(F.col("raw_text")).alias("route"))


@query(f"""
    SELECT document, page, round(coalesce(list_avg(list_transform(list_filter(list_transform(blocks, lambda b: b.confidence), lambda x: x IS NOT NULL), lambda x: least(1.0, greatest(0.0, CASE WHEN x > 1 THEN x / 100 ELSE x END)))), 0.0), 6) AS confidence FROM {PAGES}""")
def block_confidence(s, d):
    return corpus.page_table(s, d).select("document", "page", F.round(F.coalesce(corpus.block_confidence(F.col("blocks")), F.lit(0.0)), 6).alias("confidence"))


@query(f"SELECT document, count(*) AS n FROM {CHUNKS} WHERE document <> (SELECT min(document) FROM chunks) GROUP BY document")
def document_delete(s, d):
    c = corpus.corpus(s, d)
    first = c.agg(F.min("document")).first()[0]
    return corpus.delete_document(c, first).groupBy("document").agg(F.count("*").alias("n"))


@query(f"""
    SELECT document, chunk_index, length(text) AS chars FROM (
        SELECT document, chunk_index, text FROM {CHUNKS} WHERE document NOT IN (SELECT document FROM pages WHERE page = 2 AND document IS NOT NULL)
        UNION ALL SELECT document, page, raw_text FROM {PAGES} WHERE document IN (SELECT document FROM pages WHERE page = 2 AND document IS NOT NULL))""")
def document_replace(s, d):
    pages = corpus.page_table(s, d)
    incoming = pages.join(pages.filter("page = 2").select("document"), "document", "left_semi").select("document", F.col("page").alias("chunk_index"), F.col("raw_text").alias("text"))
    return corpus.replace_documents(corpus.corpus(s, d).select("document", "chunk_index", "text"), incoming).select("document", "chunk_index", F.length("text").cast("bigint").alias("chars"))


@query("SELECT entity_id FROM entities WHERE entity_id IN (SELECT entity_id FROM mentions WHERE document IS DISTINCT FROM (SELECT min(document) FROM mentions))")
def live_entities(s, d):
    m = table(s, d, "mentions")
    first = m.agg(F.min("document")).first()[0]
    return corpus.live_entities(table(s, d, "entities"), m.filter(~F.col("document").eqNullSafe(F.lit(first)))).select("entity_id")


# -- text ---------------------------------------------------------------------------------------
def _again(x: str, pattern: str, put: str) -> str:
    """A replacement done twice, which reaches what overlaps with a first match."""
    once = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{put}', 'g')"


_LINES = r"regexp_replace(raw_text, '\r\n?', chr(10), 'g')"
_JOINED = _again(_again(_LINES, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"\1\2"), r"([^.!?:;])\n([a-z0-9(])", r"\1 \2")
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_JOINED}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT document, page, md5({_CLEAN}) AS clean FROM {PAGES}")
def text_clean(s, d):
    return corpus.page_table(s, d).select("document", "page", F.md5(T.clean_ocr(F.col("raw_text"))).alias("clean"))


@query(rf"""
    SELECT document, chunk_index, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '([.!?])\s+([A-Z"‘’])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n+', chr(10) || chr(1), 'g'), chr(1)),
           lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS sentence FROM {CHUNKS} WHERE text IS NOT NULL""")
def sentence_split(s, d):
    return corpus.corpus(s, d).filter("text IS NOT NULL").select("document", "chunk_index", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query(f"SELECT document, chunk_index, CAST(greatest(1, floor(length(text) / 4)) AS INTEGER) AS tokens, token_count IS DISTINCT FROM CAST(greatest(1, floor(length(text) / 4)) AS INTEGER) AS differs FROM {CHUNKS} WHERE text IS NOT NULL")
def token_counts(s, d):
    n = T.tokens_approx(F.col("text"))
    return corpus.corpus(s, d).filter("text IS NOT NULL").select("document", "chunk_index", n.alias("tokens"), (~F.col("token_count").eqNullSafe(n)).alias("differs"))


@query(rf"""
    WITH titled AS (SELECT document, page, list_filter(list_transform(regexp_split_to_array({_CLEAN}, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4 AND length(x) <= 140 AND regexp_matches(x, '{re_sql(T.SECTION)}'))[1] AS title FROM {PAGES})
    SELECT document, page, last_value(title IGNORE NULLS) OVER (PARTITION BY document ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM titled""")
def section_carry(s, d):
    return chunking.section_titles(corpus.page_table(s, d))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '([.!?])\s+([A-Z"‘’])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n+', chr(10) || chr(1), 'g'), chr(1)),
           lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_TOKENS = "CAST(greatest(1, floor(length({0}) / 4)) AS BIGINT)"
_SUM = "coalesce(list_sum(list_transform({0}, lambda x: " + _TOKENS.format("x") + ")), 0)"
_FLAT = f"""
    WITH RECURSIVE clean AS (SELECT document, page, ocr_confidence, extraction_method, {_CLEAN} AS clean FROM {PAGES}),
    each AS (SELECT document, page, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT document, page, {_SENTENCES.format('clean')} AS s FROM clean WHERE clean <> '')),
    long AS (SELECT document, page, i, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM each WHERE {_TOKENS.format('x')} > 512),
    runs(document, page, i, k, line, done) AS (
        SELECT document, page, i, 0, '', CAST([] AS VARCHAR[]) FROM long
        UNION ALL SELECT document, page, i, k + 1, CASE WHEN line <> '' AND length(line) + 1 + length(w[k + 1]) > 2048 OR line = '' THEN w[k + 1] ELSE line || ' ' || w[k + 1] END,
            CASE WHEN line <> '' AND length(line) + 1 + length(w[k + 1]) > 2048 THEN list_append(done, line) ELSE done END FROM runs JOIN long USING (document, page, i) WHERE k < len(w)),
    parts AS (SELECT document, page, i, [x] AS p FROM each WHERE {_TOKENS.format('x')} <= 512 UNION ALL SELECT document, page, i, list_append(done, line) FROM runs JOIN long USING (document, page, i) WHERE k = len(w)),
    flat AS MATERIALIZED (SELECT document, page, flatten(list(p ORDER BY i)) AS p FROM parts GROUP BY ALL),"""
CHUNK_SQL = f"""{_FLAT}
    pack(document, page, k, own, done) AS (
        SELECT document, page, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[][]) FROM flat
        UNION ALL SELECT document, page, k + 1, list_append(CASE WHEN NOT is_full THEN own WHEN {_SUM.format('kept')} + {_TOKENS.format('nxt')} > 512 THEN [] ELSE kept END, nxt), CASE WHEN is_full THEN list_append(done, own) ELSE done END
            FROM (SELECT *, len(own) > 0 AND {_SUM.format('own')} + {_TOKENS.format('nxt')} > 512 AS is_full, own[list_filter(range(1, len(own) + 2), lambda j: {_SUM.format('own[j:]')} <= 64)[1]:] AS kept FROM (SELECT document, page, k, own, done, p[k + 1] AS nxt, len(p) AS n FROM pack JOIN flat USING (document, page)) WHERE k < n)),
    chunks_of AS (SELECT document, page, unnest(c) AS c, generate_subscripts(c, 1) AS pos FROM (SELECT document, page, list_append(done, own) AS c FROM pack JOIN flat USING (document, page) WHERE k = len(p)))
    SELECT document, page, CAST(row_number() OVER (PARTITION BY document ORDER BY page, pos) - 1 AS INTEGER) AS chunk_index, array_to_string(c, ' ') AS text, CAST({_TOKENS.format("array_to_string(c, ' ')")} AS INTEGER) AS token_count, section_title, ocr_confidence, extraction_method
    FROM chunks_of JOIN clean USING (document, page) JOIN ({ORACLE['section_carry']}) USING (document, page)"""


@query(CHUNK_SQL)
def chunk_fixed(s, d):
    return chunking.chunk_fixed(corpus.page_table(s, d))


_OF = "coalesce(list_sum(list_transform({0}, lambda x: nt[x])), 0)"
SEMANTIC_SQL = f"""{_FLAT}
    sent AS MATERIALIZED (SELECT document, page, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM flat),
    dims AS MATERIALIZED (SELECT document, page, i, place, sum(sign) AS x FROM (SELECT document, page, i, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) AS place, CASE WHEN substr(md5(w), 3, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM (SELECT document, page, i, unnest({WORDS.format('x')}) AS w FROM sent)) GROUP BY ALL),
    norms AS MATERIALIZED (SELECT document, page, i, sqrt(sum(x * x)) AS n FROM dims GROUP BY ALL),
    dots AS (SELECT b.document, b.page, b.i, sum(a.x * b.x) AS d FROM dims a JOIN dims b ON a.document = b.document AND a.page = b.page AND b.i = a.i + 1 AND a.place = b.place GROUP BY ALL),
    near AS MATERIALIZED (SELECT s.document, s.page, list(CASE WHEN na.n * nb.n > 0 THEN coalesce(d.d, 0) / (na.n * nb.n) ELSE 0.0 END ORDER BY s.i) AS near FROM sent s LEFT JOIN dots d ON d.document = s.document AND d.page = s.page AND d.i = s.i
        LEFT JOIN norms nb ON nb.document = s.document AND nb.page = s.page AND nb.i = s.i LEFT JOIN norms na ON na.document = s.document AND na.page = s.page AND na.i = s.i - 1 GROUP BY ALL),
    base AS MATERIALIZED (SELECT document, page, p, near, list_transform(p, lambda x: {_TOKENS.format('x')}) AS nt FROM flat JOIN near USING (document, page)),
    grp(document, page, k, own, tokens, rolling, groups) AS (
        SELECT document, page, CAST(1 AS BIGINT), CAST([1] AS BIGINT[]), CAST(nt[1] AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[][]) FROM base
        UNION ALL SELECT document, page, k + 1, list_append(seed, k + 1), CAST(CASE WHEN parted THEN {_OF.format('seed')} ELSE tokens END + nt[k + 1] AS BIGINT), CASE WHEN parted THEN NULL WHEN rolling IS NULL THEN s ELSE 0.75 * rolling + 0.25 * s END, CASE WHEN parted THEN list_append(groups, own) ELSE groups END
            FROM (SELECT *, CASE WHEN NOT parted THEN own WHEN {_OF.format('kept')} + nt[k + 1] <= 512 THEN kept ELSE [] END AS seed FROM (
                SELECT document, page, k, own, tokens, rolling, groups, nt, near[k + 1] AS s, tokens + nt[k + 1] > 512 OR (rolling IS NOT NULL AND tokens >= 80 AND rolling - near[k + 1] >= 0.18) AS parted, own[list_filter(range(1, len(own) + 2), lambda j: {_OF.format('own[j:]')} <= 64)[1]:] AS kept
                FROM grp JOIN base USING (document, page) WHERE k < len(p)))),
    sets AS MATERIALIZED (SELECT document, page, p, nt, list_append(groups, own) AS groups FROM grp JOIN base USING (document, page) WHERE k = len(p)),
    mrg(document, page, j, acc) AS (
        SELECT document, page, 0, CAST([] AS BIGINT[][]) FROM sets
        UNION ALL SELECT document, page, j + 1, CASE WHEN len(acc) > 0 AND {_OF.format('g')} < 80 AND {_OF.format('acc[len(acc)]')} + {_OF.format('new')} <= 512 THEN list_append(acc[1:len(acc) - 1], list_concat(acc[len(acc)], new)) ELSE list_append(acc, g) END
            FROM (SELECT document, page, j, acc, nt, groups[j + 1] AS g, list_filter(groups[j + 1], lambda x: len(acc) = 0 OR NOT list_contains(acc[len(acc)], x)) AS new FROM mrg JOIN sets USING (document, page) WHERE j < len(groups))),
    chunks_of AS (SELECT document, page, unnest(c) AS c, generate_subscripts(c, 1) AS pos FROM (SELECT document, page, list_transform(acc, lambda g: list_transform(g, lambda x: p[x])) AS c FROM mrg JOIN sets USING (document, page) WHERE j = len(groups)))
    SELECT document, page, CAST(row_number() OVER (PARTITION BY document ORDER BY page, pos) - 1 AS INTEGER) AS chunk_index, array_to_string(c, ' ') AS text, CAST({_TOKENS.format("array_to_string(c, ' ')")} AS INTEGER) AS token_count, section_title, ocr_confidence, extraction_method
    FROM chunks_of JOIN clean USING (document, page) JOIN ({ORACLE['section_carry']}) USING (document, page)"""


@query(SEMANTIC_SQL)
def chunk_semantic(s, d):
    return chunking.chunk_semantic(corpus.page_table(s, d))


def _parts_sql(source: str, key: str) -> str:
    """SQL of the parts of the texts (key, t) of ``source``: (key, part, text)."""
    return f"""
    WITH RECURSIVE lines AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM {source}),
    pack({key}, k, own, done) AS (
        SELECT {key}, 0, '', CAST([] AS VARCHAR[]) FROM lines
        UNION ALL SELECT {key}, k + 1, CASE WHEN big THEN '' WHEN seed = '' THEN p ELSE seed || chr(10) || chr(10) || p END, CASE WHEN big THEN list_concat(held, cuts) ELSE held END
            FROM (SELECT {key}, k, p, length(p) > 12000 AS big, CASE WHEN is_full THEN list_append(done, own) ELSE done END AS held, CASE WHEN is_full THEN CASE WHEN length(own) > 600 THEN right(own, 600) ELSE '' END ELSE own END AS seed,
                         list_filter(list_transform(range(0, greatest(0, length(p) - 1) + 1, 11400), lambda i: trim(substr(p, i + 1, 12000))), lambda x: x <> '') AS cuts
                  FROM (SELECT {key}, k, own, done, l[k + 1] AS p, own <> '' AND length(own) + length(l[k + 1]) + 2 > 12000 AS is_full FROM pack JOIN lines USING ({key}) WHERE k < len(l)))),
    whole AS (SELECT {key}, CASE WHEN own <> '' THEN list_append(done, own) ELSE done END AS c FROM pack JOIN lines USING ({key}) WHERE k = len(l))
    SELECT {key}, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS part, unnest(c) AS text FROM whole"""


@query(_parts_sql("(SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)", "doc_id"))
def summary_parts(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(chunking.summary_parts(F.col("text"))).alias("part", "text"))


@query(f"SELECT term, count(*) AS n FROM (SELECT {stem_sql('w')} AS term FROM (SELECT unnest({WORDS.format('text')}) AS w FROM {CHUNKS})) GROUP BY term")
def stemmed_vocab(s, d):
    return retrieval.terms(corpus.corpus(s, d), "text", []).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT query_id, array_to_string({token_set_sql('question')}, ' ') AS tokens FROM {RESULTS}")
def token_sets(s, d):
    return results(s, d).select("query_id", F.array_join(T.token_set(F.col("question"), T.EVALUATION_STOPWORDS, True), " ").alias("tokens"))


@query(rf"SELECT query_id, regexp_replace(regexp_replace(lower(regexp_replace(question, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g') AS normalised FROM {RESULTS}")
def question_normalise(s, d):
    return results(s, d).select("query_id", T.normalise_question(F.col("question")).alias("normalised"))


_LONG = r"list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"


@query(rf"""
    SELECT doc_id, md5(CASE WHEN len(s) = 0 THEN substr(t, 1, 1200) ELSE array_to_string(s[1:2], ' ') || chr(10) || chr(10) || 'Key points:' || chr(10) || array_to_string(list_transform(CASE WHEN len(s) > 2 THEN s[3:8] ELSE s[1:6] END, lambda x: '- ' || x), chr(10)) END) AS summary
    FROM (SELECT doc_id, t, {_LONG} AS s FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents WHERE text IS NOT NULL))""")
def extractive_summary(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(T.extractive_summary(F.col("text"))).alias("summary"))


def _extract_sql(source: str, keys: str) -> str:
    """SQL of the extractive summaries s of the texts (keys, text) of ``source``."""
    tidy = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g')"
    return f"""(SELECT {keys}, CASE WHEN len(s) = 0 THEN substr(t, 1, 1200) ELSE array_to_string(s[1:2], ' ') || chr(10) || chr(10) || 'Key points:' || chr(10) || array_to_string(list_transform(CASE WHEN len(s) > 2 THEN s[3:8] ELSE s[1:6] END, lambda x: '- ' || x), chr(10)) END AS s
        FROM (SELECT {keys}, t, {_LONG} AS s FROM (SELECT {keys}, {tidy} AS t FROM {source})))"""


_BRIEF = f"""(SELECT document, page, chunk_index, CASE WHEN len(s) > 0 THEN array_to_string(s[1:4], ' ') ELSE substr(t, 1, 600) END AS brief
    FROM (SELECT document, page, chunk_index, t, {_LONG} AS s FROM (SELECT document, page, chunk_index, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM {CHUNKS} WHERE text IS NOT NULL AND trim(text) <> '')))"""
_BRIEF_PARTS = f"({_parts_sql(f'(SELECT document, string_agg(brief, chr(10) ORDER BY page, chunk_index) AS t FROM {_BRIEF} GROUP BY document)', 'document')})"


@query(f"""
    SELECT document, CASE WHEN n = 1 THEN a ELSE s END AS summary FROM (SELECT document, count(*) AS n, string_agg(s, chr(10) ORDER BY part) AS a FROM {_extract_sql(_BRIEF_PARTS, 'document, part')} GROUP BY document)
    JOIN {_extract_sql("(SELECT document, string_agg(s, chr(10) ORDER BY part) AS text FROM " + _extract_sql(_BRIEF_PARTS, 'document, part') + " GROUP BY document)", 'document')} USING (document)""")
def document_summary(s, d):
    return chunking.summarise_documents(corpus.corpus(s, d))


@query(f"SELECT response_id FROM {RESPONSES} WHERE length(trim(coalesce(answer, ''))) < 20 OR " + " OR ".join(f"contains(lower(answer), '{m}')" for m in T.BAD_SUMMARY_MARKERS))
def bad_summaries(s, d):
    return responses(s, d).filter(T.is_bad_summary(F.col("answer"))).select("response_id")


# -- planning -----------------------------------------------------------------------------------
@query(rf"""
    SELECT query_id, CASE WHEN q = '' THEN q WHEN len(string_split(q, ' ')) <= 3 AND NOT ends_with(q, '?') THEN 'Find document evidence about ' || q || '.'
        WHEN NOT regexp_matches(q, '{planner.QUESTION_START}') AND NOT ends_with(q, '?') THEN 'Find document evidence related to: ' || q
        WHEN NOT regexp_matches(q, '{planner.DOC_HINT}') THEN q || ' Answer using the uploaded document evidence.' ELSE q END AS rewritten
    FROM (SELECT query_id, trim(regexp_replace(question, '\s+', ' ', 'g')) AS q FROM {RESULTS})""")
def rewrite_queries(s, d):
    return results(s, d).select("query_id", planner.rewrite(F.col("question")).alias("rewritten"))


_TYPES = [(planner.MULTI_HOP, "MULTI_HOP"), (planner.NUMERICAL_FILTER, "NUMERICAL_FILTER"), (planner.ENTITY_LOOKUP, "ENTITY_LOOKUP"), (None, "SEMANTIC_LOOKUP"), (planner.COUNTING, "COUNTING"), (planner.RANKING, "RANKING"), (planner.COMPARISON, "COMPARISON"), (planner.AGGREGATION, "AGGREGATION"), (planner.RELATIONSHIP, "RELATIONSHIP"), (planner.TEMPORAL, "TEMPORAL"), (planner.ANALYTICAL, "ANALYTICAL")]
TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{t}'" if p else f"WHEN regexp_matches(question, '{planner.SEMANTIC_START}') AND regexp_matches(question, '{planner.SEMANTIC_BUSINESS}') THEN '{t}'" for p, t in _TYPES) + " ELSE 'LOOKUP' END"
_STRATEGY_ROWS = ", ".join(f"('{t}', '{x}', {k}, '{h}')" for t, (x, k, h) in planner.STRATEGY.items())
CLASSIFIED = f"""
    SELECT query_id, question, query_type, query_scope, strategy AS retrieval_strategy, CASE WHEN single THEN 20 ELSE k END AS top_k, CASE WHEN single THEN hints || ',find_top_1' ELSE hints END AS hints
    FROM (SELECT query_id, question, query_type, CASE WHEN regexp_matches(question, '{planner.GLOBAL_SCOPE}') THEN 'GLOBAL' ELSE 'LOCAL' END AS query_scope,
                 query_type = 'RANKING' AND regexp_matches(question, '{planner.SUPERLATIVE}') AND NOT regexp_matches(question, '{planner.MULTI_ITEM}') AS single
          FROM (SELECT query_id, question, {TYPE_SQL} AS query_type FROM (SELECT query_id, regexp_replace(trim(question), '[À-ÖØ-öø-ɏ]', 'x', 'g') AS question FROM {RESULTS} WHERE question IS NOT NULL)))
    JOIN (VALUES {_STRATEGY_ROWS}) AS strategies(query_type, strategy, k, hints) USING (query_type)"""


@query(f"SELECT query_id, query_type, query_scope, retrieval_strategy, top_k, hints FROM ({CLASSIFIED})")
def classify_queries(s, d):
    return planner.classify(questions(s, d)).select("query_id", "query_type", "query_scope", "retrieval_strategy", "top_k", "hints")


_FLAG_ROWS = ", ".join(f"('{n}', {str(a).lower()}, {str(b).lower()}, {str(c).lower()})" for n, (a, b, c) in retrieval.STRATEGIES.items())


@query(f"""
    SELECT query_id, use_bm25, use_dense, use_graph, CASE WHEN use_bm25 THEN greatest(20, CASE WHEN retrieval_strategy = 'exact_graph_metadata' THEN 4 ELSE 2 END * top_k) ELSE 0 END AS bm25_k,
           CASE WHEN use_dense THEN greatest(20, CASE WHEN retrieval_strategy = 'dense_heavy' THEN 4 ELSE 2 END * top_k) ELSE 0 END AS dense_k,
           CASE WHEN (query_scope = 'GLOBAL' AND query_type IN ('RANKING', 'AGGREGATION', 'COUNTING', 'NUMERICAL_FILTER')) OR retrieval_strategy = 'dense_heavy' THEN least(100, 4 * top_k) ELSE 20 END AS rerank_window
    FROM ({CLASSIFIED}) JOIN (VALUES {_FLAG_ROWS}) AS flags(retrieval_strategy, use_bm25, use_dense, use_graph) USING (retrieval_strategy)""")
def retrieval_depths(s, d):
    return retrieval.depths(planner.classify(questions(s, d))).select("query_id", "use_bm25", "use_dense", "use_graph", "bm25_k", "dense_k", "rerank_window")


def _keyword_sql(q: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({q}, '{re_sql(p)}', 1)), '')" for p in planner.KEYWORDS) + ")"


@query(f"""
    SELECT query_id, regexp_matches(question, '{planner.KEYWORD_PRESENCE}') AS presence, {_keyword_sql('question')} AS keyword,
           CASE WHEN regexp_matches(question, '(?i)\\bINV-\\d+\\b') AND contains(lower(question), 'amount') OR regexp_matches(question, '\\bProject\\s+[A-Z][A-Za-z0-9_-]*') AND contains(lower(question), 'transaction') THEN 'exact_metric'
                WHEN regexp_matches(question, '\\b[A-Z]{{1,10}}-\\d+\\b') OR regexp_matches(question, '{planner.LIST_QUERY}') THEN 'graph_fact'
                WHEN regexp_matches(question, '{planner.KEYWORD_PRESENCE}') AND {_keyword_sql('question')} IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS route
    FROM {RESULTS} WHERE question IS NOT NULL""")
def route_queries(s, d):
    q = F.col("question")
    return questions(s, d).select("query_id", planner.is_presence_question(q).alias("presence"), planner.keyword(q).alias("keyword"), planner.route(q, F.lit(False), F.lit(1)).alias("route"))


@query(f"""
    SELECT query_id, regexp_matches(question, '{planner.DOC_SPECIFIC}') AS doc_specific, regexp_matches(question, '{planner.FOLLOW_UP}') AS follow_up,
           length(question) BETWEEN 5 AND 2000 AS valid, query_type NOT IN ('RANKING', 'AGGREGATION', 'COUNTING', 'COMPARISON', 'ANALYTICAL') AND NOT regexp_matches(question, '{planner.DOC_SPECIFIC}') AS general
    FROM (SELECT query_id, question, query_type FROM ({CLASSIFIED}))""")
def question_tests(s, d):
    q = F.trim("question")
    rows = planner.classify(questions(s, d))
    return rows.select("query_id", q.rlike(planner.DOC_SPECIFIC).alias("doc_specific"), planner.is_follow_up(q, F.lit(True)).alias("follow_up"), planner.valid_request(q, F.lit(5), F.lit("s")).alias("valid"), planner.is_general(q, F.col("query_type")).alias("general"))


@query(f"""
    WITH asked AS (SELECT query_id, trim(coalesce({_keyword_sql('question')}, regexp_extract(question, '\\b([A-Z]+/[0-9]+/[A-Z])\\b', 1))) AS keyword FROM {RESULTS} WHERE question IS NOT NULL),
    hits AS (SELECT query_id, document, page, chunk_index, row_number() OVER (PARTITION BY query_id, document, page ORDER BY chunk_index) AS r FROM asked JOIN {CHUNKS} c ON keyword <> '' AND contains(lower(c.text), lower(keyword))),
    first_hits AS (SELECT query_id, document, page, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY page, chunk_index, document) AS rank FROM hits WHERE r = 1)
    SELECT query_id, document, page, chunk_index, CAST(rank AS INTEGER) AS rank FROM first_hits WHERE rank <= 3""")
def keyword_scan(s, d):
    code = F.regexp_extract("question", r"\b([A-Z]+/[0-9]+/[A-Z])\b", 1)
    asked = questions(s, d).select("query_id", F.coalesce(planner.keyword(F.col("question")), code).alias("keyword"))
    return retrieval.keyword_scan(asked, corpus.corpus(s, d))


# -- retrieval ------------------------------------------------------------------------------------
TF = f"(SELECT document, chunk_index, term, count(*) AS f FROM (SELECT document, chunk_index, {stem_sql('w')} AS term FROM (SELECT document, chunk_index, unnest({WORDS.format('text')}) AS w FROM {CHUNKS})) GROUP BY ALL)"


@query(f"SELECT term, count(*) AS chunks, CAST(sum(f) AS BIGINT) AS total FROM {TF} GROUP BY term")
def term_stats(s, d):
    return index(s, d).terms.select("term", F.col("n").alias("chunks"), F.col("f").alias("total"))


def bm25_sql(k: int) -> str:
    return f"""
    WITH tf AS {TF}, dl AS (SELECT document, chunk_index, sum(f) AS len FROM tf GROUP BY ALL), st AS (SELECT count(*) AS total, avg(len) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS n FROM tf GROUP BY term), raw AS (SELECT term, ln(total - n + 0.5) - ln(n + 0.5) AS raw FROM df, st),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    qt AS (SELECT query_id, {stem_sql('w')} AS term, count(*) AS weight FROM (SELECT query_id, unnest({WORDS.format('question')}) AS w FROM {RESULTS} WHERE query_id % 50 = 0 AND question IS NOT NULL) GROUP BY ALL),
    missing AS (SELECT query_id, term, weight FROM qt WHERE term NOT IN (SELECT term FROM df) AND length(term) > 2),
    grown AS (SELECT query_id, "full" AS term, weight FROM (SELECT m.query_id, m.weight, d.term AS "full", row_number() OVER (PARTITION BY m.query_id, m.term ORDER BY d.term) AS r FROM missing m JOIN df d ON starts_with(d.term, m.term)) WHERE r <= 5),
    asked AS (SELECT query_id, term, sum(weight) AS weight FROM (SELECT * FROM qt WHERE term IN (SELECT term FROM df) UNION ALL SELECT * FROM grown) GROUP BY ALL),
    scored AS (SELECT query_id, document, chunk_index, round(sum(weight * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS s FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (document, chunk_index), st GROUP BY ALL),
    ranked AS (SELECT query_id, document, chunk_index, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document, chunk_index) AS rank, max(s) OVER (PARTITION BY query_id) AS top FROM scored)
    SELECT query_id, document, chunk_index, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, document, chunk_index, CASE WHEN top > 0 THEN round(s / top, 4) ELSE 0 END AS score, rank FROM ranked WHERE rank <= {k}) WHERE score > 0.001"""


@query(bm25_sql(10))
def bm25_topk(s, d):
    return retrieval.bm25(stated(s, d), index(s, d), 10)


DENSE_SQL = """
    SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (
        SELECT q.vec_id AS query, v.vec_id AS item, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 4) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""


@query(DENSE_SQL)
def dense_topk(s, d):
    v = table(s, d, "embeddings")
    return retrieval.dense(v.filter(F.col("vec_id") % STATED == 0), v, "vec_id", "vec_id", "embedding", 10)


_TOP5 = f"(SELECT query_id, x.document AS document, x.page AS page, min(i) AS rank FROM (SELECT query_id, unnest(retrieved_top5) AS x, generate_subscripts(retrieved_top5, 1) AS i FROM {RESULTS} WHERE query_id % 50 = 0) WHERE x.document IS NOT NULL GROUP BY ALL)"
_PAGE_LIST = f"(SELECT query_id, document, page, row_number() OVER (PARTITION BY query_id ORDER BY best, document, page) AS rank FROM (SELECT query_id, document, page, min(rank) AS best FROM ({bm25_sql(20)}) JOIN {CHUNKS} USING (document, chunk_index) GROUP BY ALL))"
RRF_SQL = f"""
    SELECT query_id, document, page, round(sum(1.0 / (60 + rank)), 6) AS score, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources
    FROM (SELECT query_id, document, page, rank, 'bm25' AS source FROM {_PAGE_LIST} UNION ALL SELECT query_id, document, page, rank, 'stored' FROM {_TOP5}) GROUP BY ALL"""


def _page_lists(s, d) -> list[tuple[str, DataFrame]]:
    chunks = corpus.corpus(s, d)
    found = retrieval.bm25(stated(s, d), index(s, d), 20).join(chunks.select("document", "chunk_index", "page"), ["document", "chunk_index"]).groupBy("query_id", "document", "page").agg(F.min("rank").alias("best"))
    pages = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "document", "page")))
    top = results(s, d).filter(F.col("query_id") % STATED == 0).select("query_id", F.posexplode("retrieved_top5").alias("i", "x")).filter("x.document IS NOT NULL").groupBy("query_id", "x.document", "x.page").agg((F.min("i") + 1).alias("rank"))
    return [("bm25", pages), ("stored", top)]


@query(f"SELECT query_id, document, page, score, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, page) AS INTEGER) AS rank FROM ({RRF_SQL})")
def rrf_fusion(s, d):
    return retrieval.rrf(_page_lists(s, d), ["document", "page"])


@query(f"""
    SELECT query_id, document, page, score, retrieval_source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, page) AS INTEGER) AS rank FROM (
        SELECT f.query_id, f.document, f.page, CASE WHEN t.rank IS NOT NULL THEN round(least(1.0, score + 0.12), 6) ELSE score END AS score, CASE WHEN t.rank IS NOT NULL THEN 'graph_hybrid' ELSE 'hybrid' END AS retrieval_source
        FROM (SELECT * FROM ({RRF_SQL}) WHERE score >= 0.005) f LEFT JOIN {_TOP5} t ON f.query_id = t.query_id AND f.document = t.document AND f.page IS NOT DISTINCT FROM t.page)""")
def graph_boost(s, d):
    lists = _page_lists(s, d)
    return retrieval.graph_boost(retrieval.rrf(lists, ["document", "page"]).drop("sources").filter(F.col("score") >= retrieval.LEAST_SCORE), lists[1][1], ["document", "page"])


@query(f"""
    SELECT query_id, document, chunk_index, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, chunk_index) AS rank FROM (
        SELECT query_id, document, chunk_index, round(1 / (1 + exp(-(4 * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q) END - 2))), 4) AS score
        FROM (SELECT query_id, document, chunk_index, {token_set_sql('question')} AS q, {token_set_sql('text')} AS c FROM ({bm25_sql(20)}) JOIN {CHUNKS} USING (document, chunk_index) JOIN (SELECT query_id, question FROM {RESULTS}) USING (query_id)))) WHERE rank <= 5""")
def rerank_lexical(s, d):
    chunks, q = corpus.corpus(s, d), stated(s, d)
    found = retrieval.bm25(q, index(s, d), 20).select("query_id", "document", "chunk_index").join(chunks.select("document", "chunk_index", "text"), ["document", "chunk_index"]).join(q, "query_id")
    return retrieval.lexical_rerank(found, 5).select("query_id", "document", "chunk_index", "score", "rank")


def engine(s: SparkSession, d: str, graphed: bool = True):
    from foliant.api import Engine

    more = (mentions(s, d), table(s, d, "entities")) if graphed else ()
    return Engine(s, corpus.corpus(s, d), *more, index=index(s, d))


@query()
def hybrid_answers(s, d):
    return engine(s, d).answer(stated(s, d))


_DIMS = "(SELECT {0}, place, sum(sign) AS x FROM (SELECT {0}, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) AS place, CASE WHEN substr(md5(w), 3, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM (SELECT {0}, unnest(" + WORDS.format('{1}') + ") AS w FROM {2})) GROUP BY ALL)"
_PLANNED = f"(SELECT * FROM ({ORACLE['retrieval_depths']}) JOIN ({CLASSIFIED}) USING (query_id) WHERE query_id % 50 = 0)"
HYBRID_SQL = f"""
    WITH plan AS {_PLANNED}, lexical AS ({bm25_sql(100)}),
    cv AS {_DIMS.format('document, chunk_index', 'text', CHUNKS)}, qv AS {_DIMS.format('query_id', 'question', "(SELECT query_id, question FROM " + RESULTS + " WHERE query_id % 50 = 0 AND question IS NOT NULL)")},
    cn AS (SELECT document, chunk_index, sqrt(sum(x * x)) AS n FROM cv GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY ALL),
    near AS (SELECT query_id, document, chunk_index, round(least(1.0, greatest(0.0, CASE WHEN any_value(cn.n) * any_value(qn.n) > 0 THEN sum(cv.x * qv.x) / (any_value(cn.n) * any_value(qn.n)) ELSE 0 END)), 4) AS score FROM qv JOIN cv USING (place) JOIN cn USING (document, chunk_index) JOIN qn USING (query_id) GROUP BY ALL),
    dense AS (SELECT query_id, document, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, chunk_index) AS rank FROM near WHERE score > 0),
    lists AS (SELECT query_id, document, chunk_index, rank FROM lexical JOIN plan USING (query_id) WHERE use_bm25 AND rank <= bm25_k UNION ALL SELECT query_id, document, chunk_index, rank FROM dense JOIN plan USING (query_id) WHERE use_dense AND rank <= dense_k),
    fused AS (SELECT query_id, document, chunk_index, round(sum(1.0 / (60 + rank)), 6) AS score FROM lists GROUP BY ALL),
    shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, chunk_index) AS r FROM fused WHERE score >= 0.005),
    scored AS (SELECT query_id, document, chunk_index, least(top_k, rerank_window) AS most, round(1 / (1 + exp(-(4 * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q) END - 2))), 4) AS score
        FROM (SELECT s.query_id, s.document, s.chunk_index, p.top_k, p.rerank_window, {token_set_sql('p.question')} AS q, {token_set_sql('c.text')} AS c FROM shown s JOIN plan p USING (query_id) JOIN {CHUNKS} c USING (document, chunk_index) WHERE s.r <= p.rerank_window))
    SELECT query_id, document, chunk_index, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, chunk_index) AS rank FROM scored) WHERE rank <= most"""


@query(HYBRID_SQL)
def hybrid_hits(s, d):
    return engine(s, d, graphed=False).retrieve(stated(s, d)).select("query_id", "document", "chunk_index", "score", "rank")


@query()
def adaptive_retrieval(s, d):
    from foliant.operators import reasoning

    chunks, held = corpus.corpus(s, d), index(s, d)
    search = lambda q, k: retrieval.bm25(q, held, k).join(chunks.select("document", "chunk_index", "page", "text"), ["document", "chunk_index"])
    measure = lambda r: reasoning.evidence_records(r).groupBy("query_id").agg(F.countDistinct(F.lower("entity")).alias("m"))
    kind = planner.classify(stated(s, d))
    deepen = (F.col("query_type") == "RANKING") | ((F.col("query_scope") == "GLOBAL") & F.col("query_type").isin("AGGREGATION", "COUNTING"))
    return retrieval.adaptive(search, measure, cut(kind.select("query_id", "question", deepen.alias("deepen")), "stated")).select("query_id", "document", "chunk_index", "score", "rank")


@query(f"""
    WITH shallow AS (SELECT * FROM ({bm25_sql(5)})), deep AS (SELECT * FROM ({bm25_sql(10)}))
    SELECT query_id, document, chunk_index, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, chunk_index) AS INTEGER) AS rank FROM (SELECT query_id, document, chunk_index, score FROM shallow UNION SELECT query_id, document, chunk_index, score FROM deep)""")
def iterative_merge(s, d):
    q, held = stated(s, d), index(s, d)
    return retrieval.merge_new(retrieval.bm25(q, held, 5), retrieval.bm25(q, held, 10), ["document", "chunk_index"])


# -- the graph ------------------------------------------------------------------------------------
_NUM = r"(?i)([-+]?\d[\d,]*(?:\.\d+)?)\s*(k|m|b|thousand|million|billion|trillion)?\b"
_FACTOR = "CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN {v:.1f}" for k, v in T.MULTIPLIERS.items()) + " ELSE 1.0 END"


_NUMBER_SQL = f"""CASE WHEN label IN ({", ".join(f"'{x}'" for x in T.NUMERIC_LABELS)}) AND regexp_extract(text, '{_NUM}', 1) <> '' THEN TRY_CAST(regexp_replace(regexp_extract(text, '{_NUM}', 1), '[^0-9.+-]', '', 'g') AS DOUBLE) * {_FACTOR.format(f"regexp_extract(text, '{_NUM}', 2)")} END"""


@query(f"""
    SELECT entity_id, arg_max(label, mention_id) AS label, arg_max(text, mention_id) AS name, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT text)), '|') AS spellings, round(arg_max(number, mention_id) FILTER (number IS NOT NULL), 4) AS numeric_value
    FROM (SELECT *, {_NUMBER_SQL} AS number FROM {MENTIONS}) WHERE entity_id IS NOT NULL GROUP BY entity_id""")
def entity_merge(s, d):
    return graph.merge_entities(mentions(s, d)).withColumn("numeric_value", F.round("numeric_value", 4))


@query(f"SELECT mention_id FROM (SELECT mention_id, row_number() OVER (PARTITION BY entity_id, lower(text), document, page, chunk_index ORDER BY mention_id) AS r FROM {MENTIONS}) WHERE r = 1")
def mention_dedupe(s, d):
    return graph.unique_mentions(mentions(s, d)).select("mention_id")


def _entity_norm_sql() -> str:
    tidy = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    bare = rf"regexp_replace(regexp_replace({tidy}, '{T.ENTITY_PREFIX}', ''), '^\s+|\s+$', '', 'g')"
    exact = ", ".join(f"'{x}'" for x in T.EXACT_LABELS)
    return rf"CASE WHEN label IN ({exact}) THEN lower(replace({bare}, ',', '')) ELSE regexp_replace(regexp_replace(lower({bare}), '[^\p{{L}}\p{{N}}_\s&.-]', '', 'g'), '^\s+|\s+$', '', 'g') END"


@query(f"SELECT mention_id, norm, lower(label) || ':' || substr(sha1(label || ':' || norm), 1, 12) AS entity_key FROM (SELECT mention_id, label, {_entity_norm_sql()} AS norm FROM {MENTIONS} WHERE text IS NOT NULL AND label IS NOT NULL)")
def entity_normalise(s, d):
    norm = T.normalise_entity(F.col("text"), F.col("label"))
    return mentions(s, d).filter("text IS NOT NULL AND label IS NOT NULL").select("mention_id", norm.alias("norm"), T.entity_key(F.col("label"), norm).alias("entity_key"))


@query(f"""
    SELECT mention_id, round(TRY_CAST(regexp_replace(regexp_extract(text, '{_NUM}', 1), '[^0-9.+-]', '', 'g') AS DOUBLE) * {_FACTOR.format(f"regexp_extract(text, '{_NUM}', 2)")}, 4) AS number
    FROM {MENTIONS} WHERE label IN ({", ".join(f"'{x}'" for x in T.NUMERIC_LABELS)}) AND regexp_extract(text, '{_NUM}', 1) <> ''""")
def entity_numbers(s, d):
    n = T.entity_number(F.col("text"), F.col("label"))
    return mentions(s, d).select("mention_id", F.round(n, 4).alias("number")).filter("number IS NOT NULL")


@query("SELECT entity_id FROM entities WHERE contains(lower(name), 'engineering') OR coalesce(len(list_filter(aliases, lambda a: contains(lower(a), 'engineering'))), 0) > 0")
def entity_search(s, d):
    e = table(s, d, "entities")
    return graph.search(e, "Company Engineering", 2**31 - 1).select("entity_id")


@query(f"""
    WITH asked AS (SELECT DISTINCT entity_id AS query_id, lower(name) AS q FROM entities WHERE label IN ('COMPANY', 'PERSON') AND length(name) >= 3),
    names AS (SELECT entity_id, confidence, lower(unnest(list_distinct(list_filter(list_concat([name], coalesce(aliases, [])), lambda x: x IS NOT NULL)))) AS n FROM entities)
    SELECT query_id, entity_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC NULLS LAST, entity_id) AS rank
        FROM (SELECT query_id, entity_id, max(confidence) AS confidence FROM asked JOIN names ON starts_with(n, q) GROUP BY ALL)) WHERE rank <= 10""")
def entity_search_batch(s, d):
    e = table(s, d, "entities")
    asked = e.filter(F.col("label").isin("COMPANY", "PERSON") & (F.length("name") >= 3)).select(F.col("entity_id").alias("query_id"), F.col("name").alias("query"))
    return graph.search_batch(asked, e)


EDGES = """(
    SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'LOCATED_IN' AS type, CAST(0.9 AS DOUBLE) AS confidence FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', CAST(0.8 AS DOUBLE) FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', CAST(1.0 AS DOUBLE) FROM nation)"""
VERTICES = """(
    SELECT 'customer:' || c_custkey AS entity_id, 'COMPANY' AS label, c_name AS name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'COMPANY', s_name FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'COUNTRY', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'REGION', r_name FROM region)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, a, k, b, o, kind, c: table(s, d, t).select(F.concat(F.lit(f"{a}:"), F.col(k).cast("string")).alias("source_id"), F.concat(F.lit(f"{b}:"), F.col(o).cast("string")).alias("target_id"), F.lit(kind).alias("type"), F.lit(c).alias("confidence"))
    return one("customer", "customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN", 0.9).union(one("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN", 0.8)).union(one("nation", "nation", "n_nationkey", "region", "n_regionkey", "PART_OF", 1.0))


def vertices(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, a, k, label, n: table(s, d, t).select(F.concat(F.lit(f"{a}:"), F.col(k).cast("string")).alias("entity_id"), F.lit(label).alias("label"), F.col(n).alias("name"))
    return one("customer", "customer", "c_custkey", "COMPANY", "c_name").union(one("supplier", "supplier", "s_suppkey", "COMPANY", "s_name")).union(one("nation", "nation", "n_nationkey", "COUNTRY", "n_name")).union(one("region", "region", "r_regionkey", "REGION", "r_name"))


def _neighbours_sql(depth: int) -> str:
    return f"""
    WITH RECURSIVE both_ways AS (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM {EDGES} UNION ALL SELECT target_id, source_id FROM {EDGES}) WHERE a <> b),
    walk(root, entity_id, hops) AS (SELECT entity_id, entity_id, 0 FROM {VERTICES} WHERE label = 'REGION' UNION SELECT root, b, hops + 1 FROM walk JOIN both_ways ON a = entity_id WHERE hops < {depth})
    SELECT root, entity_id, min(hops) AS hops FROM walk WHERE entity_id <> root GROUP BY ALL"""


def _neighbours(s, d, depth):
    return graph.neighbours(vertices(s, d).filter("label = 'REGION'"), edges(s, d), depth)


@query(_neighbours_sql(1))
def neighbours_1(s, d):
    return _neighbours(s, d, 1)


@query(_neighbours_sql(2))
def neighbours_2(s, d):
    return _neighbours(s, d, 2)


@query(_neighbours_sql(3))
def neighbours_3(s, d):
    return _neighbours(s, d, 3)


_TYPES_SQL = ", ".join(f"'{x}'" for x in graph.ENTITY_TYPES)


@query(f"""
    SELECT 'entity' AS kind, label AS name, count(*) AS n FROM {VERTICES} WHERE label IN ({_TYPES_SQL}) AND label <> 'REGION' GROUP BY label
    UNION ALL SELECT 'relation', type, count(*) FROM {EDGES} WHERE source_id NOT LIKE 'region:%' AND target_id NOT LIKE 'region:%' GROUP BY type""")
def entity_whitelist(s, d):
    v = vertices(s, d).withColumn("label", F.when(F.col("label") == "REGION", "CONTINENT").otherwise(F.col("label")))
    known, kept = graph.whitelist(v, edges(s, d).withColumn("type", F.col("type")).unionByName(edges(s, d).withColumn("type", F.lit("NEAR"))))
    one = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one(known, "entity", "label").union(one(kept, "relation", "type"))


@query(f"""
    WITH near AS ({_neighbours_sql(2)}), all_v AS (SELECT root, entity_id, hops FROM near UNION SELECT entity_id, entity_id, 0 FROM {VERTICES} WHERE label = 'REGION')
    SELECT a.root, e.source_id, e.target_id, e.type FROM (SELECT DISTINCT source_id, target_id, type FROM {EDGES}) e JOIN all_v a ON a.entity_id = e.source_id JOIN all_v b ON b.entity_id = e.target_id AND b.root = a.root WHERE least(a.hops, b.hops) < 2""")
def neighbourhood_edges(s, d):
    return graph.neighbourhood(vertices(s, d).filter("label = 'REGION'"), edges(s, d), 2)[1]


@query(f"SELECT root, entity_id, hops FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY hops, entity_id) AS r FROM ({_neighbours_sql(2)})) WHERE r <= 40")
def neighbourhood_limited(s, d):
    return graph.neighbourhood(vertices(s, d).filter("label = 'REGION'"), edges(s, d), 2, 40)[0]


@query(f"SELECT document, entity_id, page, chunk_index, text, max(confidence) AS confidence FROM {MENTIONS} WHERE document IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL")
def mention_edges(s, d):
    return graph.merge_mentions(mentions(s, d))


@query(f"""
    SELECT source_id, target_id, type, document, CASE WHEN source_id LIKE 'customer:1%' THEN 0.5 ELSE confidence END AS confidence FROM (SELECT DISTINCT source_id, target_id, type, 'tables' AS document, confidence FROM {EDGES})
    UNION ALL SELECT source_id, target_id, type, 'other', 0.5 FROM (SELECT DISTINCT source_id, target_id, type FROM {EDGES} WHERE source_id LIKE 'customer:1%')""")
def relation_merge(s, d):
    one = edges(s, d).withColumn("document", F.lit("tables"))
    new = one.filter("source_id LIKE 'customer:1%'").withColumn("confidence", F.lit(0.5))
    return graph.merge_relations(graph.merge_relations(one.dropDuplicates(), new), new.withColumn("document", F.lit("other")))


@query(f"SELECT DISTINCT source_id, target_id, type, a.name AS source_name, b.name AS target_name, e.confidence FROM {EDGES} e JOIN {VERTICES} a ON a.entity_id = source_id JOIN {VERTICES} b ON b.entity_id = target_id WHERE target_id = 'nation:3'")
def facts_to(s, d):
    return graph.facts(edges(s, d), vertices(s, d).withColumn("aliases", F.lit(None).cast("array<string>")), target="nation:3")


@query(f"SELECT DISTINCT source_id, target_id, type, a.name AS source_name, b.name AS target_name, e.confidence FROM {EDGES} e JOIN {VERTICES} a ON a.entity_id = source_id JOIN {VERTICES} b ON b.entity_id = target_id WHERE type = 'LOCATED_IN'")
def relationship_facts(s, d):
    return graph.facts(edges(s, d), vertices(s, d).withColumn("aliases", F.lit(None).cast("array<string>")), ["LOCATED_IN"])


@query(f"""
    WITH f AS (SELECT source_id AS query_id, source_id, target_id, type, a.name AS source_name, b.name AS target_name FROM {EDGES} e JOIN {VERTICES} a ON a.entity_id = source_id JOIN {VERTICES} b ON b.entity_id = target_id)
    SELECT query_id, source_name || ' ' || lower(replace(type, '_', ' ')) || ' ' || target_name || '.' AS answer, CAST(0.95 AS DOUBLE) AS confidence FROM f""")
def graph_fact_answers(s, d):
    f = graph.facts(edges(s, d), vertices(s, d).withColumn("aliases", F.lit(None).cast("array<string>"))).withColumn("query_id", F.col("source_id"))
    return graph.answer_facts(graph.facts_for(f, F.array(F.lit("locat"))))


@query(f"""
    WITH asked AS (SELECT label AS query_id, entity_id FROM entities WHERE label IN ('PERSON', 'COMPANY', 'PRODUCT')),
    hits AS (SELECT query_id, document, page, chunk_index, count(DISTINCT entity_id) AS hits FROM asked JOIN mentions m USING (entity_id) WHERE document IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL)
    SELECT query_id, document, page, chunk_index, hits, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, document, page, chunk_index) AS rank FROM hits) WHERE rank <= 12""")
def chunks_for_entities(s, d):
    asked = table(s, d, "entities").filter(F.col("label").isin("PERSON", "COMPANY", "PRODUCT")).select(F.col("label").alias("query_id"), "entity_id")
    return graph.chunks_for(asked, table(s, d, "mentions"))


@query("SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT mention_id) AS mentions, count(DISTINCT document) AS documents FROM mentions")
def graph_counts(s, d):
    return table(s, d, "mentions").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("mention_id").alias("mentions"), F.countDistinct("document").alias("documents"))


@query()
def canonical_mentions(s, d):
    return graph.canonical_mentions(mentions(s, d))


def _relation_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.RELATION_STOPWORDS)
    stem = "CASE WHEN w LIKE '%ers' AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%er' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
    return f"nullif(upper(array_to_string(list_transform(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+'), lambda w: w NOT IN ({stop})), lambda w: {stem})[1:5], '_')), '')"


@query(f"SELECT query_id, {_relation_sql('question')} AS relation FROM {RESULTS}")
def relation_normalise(s, d):
    return results(s, d).select("query_id", T.relation_name(F.col("question")).alias("relation"))


# -- numeric evidence -----------------------------------------------------------------------------
FACTS = """(
    SELECT 'orders' AS document, CAST(o_orderkey % 100 AS INTEGER) AS page, CAST(o_orderkey AS INTEGER) AS chunk_index, 'Invoice INV-' || o_orderkey || ' amount was $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '. It was placed in ' || year(o_orderdate) || '.' AS text FROM orders
    UNION ALL SELECT 'part', CAST(p_size AS INTEGER), CAST(p_partkey AS INTEGER), 'Project Alpha' || (p_partkey % 500) || ' generated revenue of ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || ' dollars. Gamma' || (p_partkey % 500) || ' earned ' || CAST(p_partkey % 90 + 1 AS VARCHAR) || ' thousand.' FROM part
    UNION ALL SELECT 'lineitem', CAST(l_linenumber AS INTEGER), CAST(l_suppkey AS INTEGER), 'Project Beta' || l_suppkey || ' processed exactly ' || count(*) || ' transactions. Employee EMP-' || l_suppkey || ' signed Contract CX-' || (l_suppkey % 40) || '.' FROM lineitem GROUP BY l_linenumber, l_suppkey)"""


def facts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.lit("orders").alias("document"), (F.col("o_orderkey") % 100).cast("int").alias("page"), F.col("o_orderkey").cast("int").alias("chunk_index"), F.concat(F.lit("Invoice INV-"), F.col("o_orderkey").cast("string"), F.lit(" amount was $"), F.floor("o_totalprice").cast("string"), F.lit(". It was placed in "), F.year("o_orderdate").cast("string"), F.lit(".")).alias("text"))
    n = (F.col("p_partkey") % 500).cast("string")
    p = table(s, d, "part").select(F.lit("part"), F.col("p_size").cast("int"), F.col("p_partkey").cast("int"), F.concat(F.lit("Project Alpha"), n, F.lit(" generated revenue of "), F.floor("p_retailprice").cast("string"), F.lit(" dollars. Gamma"), n, F.lit(" earned "), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit(" thousand.")))
    li = table(s, d, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.count("*").alias("n"))
    k = F.col("l_suppkey").cast("string")
    li = li.select(F.lit("lineitem"), F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("int"), F.concat(F.lit("Project Beta"), k, F.lit(" processed exactly "), F.col("n").cast("string"), F.lit(" transactions. Employee EMP-"), k, F.lit(" signed Contract CX-"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".")))
    return o.union(p).union(li)


_RECORD_SQL = f"""(
    SELECT 'Invoice' AS kind, 'INV-' || o_orderkey AS nameless, 'INV-' || o_orderkey AS entity, 'invoice' AS entity_type, 'amount' AS metric, CAST(floor(o_totalprice) AS DOUBLE) AS value, CAST(1.0 AS DOUBLE) AS confidence FROM orders
    UNION ALL SELECT 'Revenue', '', 'Project Alpha' || (p_partkey % 500), 'project', 'revenue', CAST(floor(p_retailprice) AS DOUBLE), 1.0 FROM part
    UNION ALL SELECT 'Earned', '', 'Gamma' || (p_partkey % 500), 'project', 'revenue', CAST((p_partkey % 90 + 1) * 1000 AS DOUBLE), 0.85 FROM part
    UNION ALL SELECT 'Transactions', '', 'Project Beta' || l_suppkey, 'project', 'transactions', CAST(count(*) AS DOUBLE), 1.0 FROM lineitem GROUP BY l_linenumber, l_suppkey)"""
_DEDUPED = f"(SELECT metric, arg_max(entity, confidence) AS entity, any_value(entity_type) AS entity_type, max(value) AS value FROM {_RECORD_SQL} GROUP BY metric, lower(entity))"


@query(f"SELECT entity, entity_type, metric, value, confidence, count(*) AS n FROM {_RECORD_SQL} GROUP BY ALL")
def record_extraction(s, d):
    f = facts(s, d)
    return records.structured_records(f).unionByName(records.flexible_records(f)).groupBy("entity", "entity_type", "metric", "value", "confidence").agg(F.count("*").alias("n"))


@query(f"SELECT metric, entity, value FROM {_DEDUPED}")
def record_dedupe(s, d):
    return records.metric_records(facts(s, d)).select("metric", "entity", "value")


@query(f"SELECT metric, round(sum(value), 2) AS sum, round(avg(value), 2) AS average, min(value) AS min, max(value) AS max, count(*) AS count FROM {_DEDUPED} GROUP BY metric")
def aggregate_metrics(s, d):
    return records.aggregate(records.metric_records(facts(s, d)))


def _rank_sql(order: str, limit: int) -> str:
    return f"SELECT metric, CAST(rank AS INTEGER) AS rank, entity, value FROM (SELECT metric, entity, value, row_number() OVER (PARTITION BY metric ORDER BY value {order}, entity) AS rank FROM {_DEDUPED}) WHERE rank <= {limit}"


@query(_rank_sql("DESC", 20))
def rank_top20(s, d):
    return records.rank(records.metric_records(facts(s, d)))


@query(_rank_sql("ASC", 5))
def rank_lowest5(s, d):
    return records.rank(records.metric_records(facts(s, d)), 5, ascending=True)


@query(_rank_sql("DESC", 1))
def rank_top1(s, d):
    return records.rank(records.metric_records(facts(s, d)), 1)


_CONDITIONS = [
    (1, "revenue greater than 1500", "revenue", "value > 1500"), (2, "Which invoices have an amount between $2,000 and $50,000?", "amount", "value BETWEEN 2000 AND 50000"), (3, "transactions no less than 5", "transactions", "value >= 5"),
    (4, "revenue at most 2 thousand", "revenue", "value <= 2000"), (5, "invoice amount under 0.1 million", "amount", "value < 100000"), (6, "revenue = 1000", "revenue", "value = 1000"), (7, "projects with revenue above 50 thousand", "revenue", "value > 50000"),
]


@query("\n UNION ALL ".join(f"SELECT {i} AS query_id, count(*) FILTER ({c}) AS matched, count(*) FILTER (NOT ({c})) AS excluded, count(*) AS total FROM {_DEDUPED} WHERE metric = '{m}'" for i, _, m, c in _CONDITIONS))
def numeric_filter(s, d):
    q = s.createDataFrame([(i, t) for i, t, _, _ in _CONDITIONS], "query_id int, question string")
    return records.numeric_filter(q, records.metric_records(facts(s, d)))


@query(f"""
    SELECT entity_type, count(DISTINCT entity) AS n, array_to_string(list_sort(list(DISTINCT entity))[1:100], ', ') AS names FROM (
        SELECT entity_type, entity FROM {_DEDUPED} WHERE entity_type IN ('project', 'invoice')
        UNION ALL SELECT 'employee', 'EMP-' || l_suppkey FROM lineitem UNION ALL SELECT 'contract', 'CX-' || (l_suppkey % 40) FROM lineitem) GROUP BY entity_type""")
def entity_counts(s, d):
    f = facts(s, d)
    return records.count_entities(records.metric_records(f), f)


@query(f"""
    SELECT document, chunk_index, page, CAST(year AS INTEGER) AS year, CAST(row_number() OVER (PARTITION BY document ORDER BY year, page, chunk_index) AS INTEGER) AS rank
    FROM (SELECT document, chunk_index, page, regexp_extract(text, '\\b((?:19|20)\\d{{2}})\\b', 1) AS year FROM {CHUNKS}) WHERE year <> ''""")
def temporal_order(s, d):
    return records.temporal_order(corpus.corpus(s, d))


_NAMED = f"(SELECT document, page, chunk_index, unnest(list_filter(list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)), lambda n: length(n) >= 2 AND lower(n) NOT IN ('the', 'this', 'that', 'from', 'with'))) AS name FROM {CHUNKS} WHERE text IS NOT NULL)"


@query(f"""
    SELECT document, name, any_value(n) AS appearances, array_to_string(list(chunk_index ORDER BY r), ',') AS sources
    FROM (SELECT *, row_number() OVER (PARTITION BY document, name ORDER BY page, chunk_index) AS r, count(*) OVER (PARTITION BY document, name) AS n FROM {_NAMED}) WHERE n >= 2 AND r <= 3 GROUP BY document, name""")
def bridging_entities(s, d):
    return records.bridging(corpus.corpus(s, d))


@query(f"""
    WITH asked AS (SELECT query_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, list_distinct(regexp_extract_all(question, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1)) AS l FROM {RESULTS} WHERE query_id % 50 = 0 AND question IS NOT NULL)),
    hits AS (SELECT query_id, name, count(DISTINCT (document, chunk_index)) AS n, arg_min(substr(text, 1, 200), (document, page, chunk_index)) AS said FROM asked JOIN {_NAMED} USING (name) JOIN (SELECT document, chunk_index, text FROM {CHUNKS}) USING (document, chunk_index) GROUP BY ALL)
    SELECT a.query_id, least(a.name, b.name) AS first_name, greatest(a.name, b.name) AS second_name, a.n + b.n AS chunks, least(a.said, b.said) AS evidence FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.name < b.name""")
def compare_pairs(s, d):
    return records.compare(stated(s, d), corpus.corpus(s, d)).select("query_id", F.least("entity_a", "entity_b").alias("first_name"), F.greatest("entity_a", "entity_b").alias("second_name"), (F.col("a_chunks") + F.col("b_chunks")).alias("chunks"), F.array_min(F.split("evidence", " / ", 2)).alias("evidence"))


@query(f"""
    SELECT DISTINCT document || ':' || page || ':' || chunk_index AS query_id, unnest(CASE document WHEN 'orders' THEN ['INV-' || chunk_index] WHEN 'lineitem' THEN ['EMP-' || chunk_index, 'CX-' || (chunk_index % 40)] ELSE [] END) AS name FROM {FACTS}""")
def query_entities(s, d):
    q = facts(s, d).select(F.concat_ws(":", "document", F.col("page").cast("string"), F.col("chunk_index").cast("string")).alias("query_id"), F.col("text").alias("question"))
    return graph.query_entities(q).distinct()


_ANY_NUMBER = r"(?i)[$€£₹¥]?\s*(\d[\d,]*(?:\.\d+)?)\s*(?:(%|percent|thousand|million|billion|trillion|k|m|b)\b)?"
_ANY_NAME = r"\b([A-Z]{2,}-\d+|[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*){0,5})\b"


@query(f"""
    WITH cuts AS (SELECT document, page, chunk_index, text AS t, string_split(regexp_replace(text, '({_ANY_NUMBER[4:]})', '\\1' || chr(1), 'gi'), chr(1)) AS p FROM {FACTS}),
    each AS (SELECT document, page, chunk_index, t, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(p[i], '{_ANY_NUMBER}$', 0) AS m, regexp_extract(p[i], '{_ANY_NUMBER}$', 1) AS n, regexp_extract(p[i], '{_ANY_NUMBER}$', 2) AS u, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) AS fin FROM (SELECT *, unnest(range(1, len(p))) AS i FROM cuts)),
    near AS (SELECT *, greatest(0, fin - length(m) - 30) AS low FROM each),
    told AS (SELECT document, page, chunk_index, pos, n, u, list_extract(regexp_extract_all(substr(t, low + 1, fin - length(m) - low), '{_ANY_NAME}', 1), -1) AS entity, lower(regexp_extract(substr(t, low + 1, fin + 30 - low), '(?i)\\b(revenue|sales|amount|cost|profit|transactions?|count)\\b', 1)) AS metric FROM near)
    SELECT entity, 'generic' AS entity_type, metric, CAST(replace(n, ',', '') AS DOUBLE) * {_FACTOR.format('u')} AS value, document, page, chunk_index, 0.6 AS confidence, pos FROM told WHERE entity IS NOT NULL AND metric <> ''""")
def generic_records(s, d):
    return records.generic_records(facts(s, d))


@query("SELECT o_orderkey AS query_id, 'The amount of invoice INV-' || o_orderkey || ' is ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.' AS answer FROM orders WHERE o_orderkey % 50 = 0")
def exact_metric(s, d):
    q = table(s, d, "orders").filter(F.col("o_orderkey") % STATED == 0).select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("What is the amount of inv-"), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"))
    return records.exact_metric(q, facts(s, d))


@query(f"""
    SELECT metric, 'Ranked results from extracted document evidence:' || chr(10) || array_to_string(list(rank || '. ' || entity || ': ' || format('{{:,}}', CAST(value AS BIGINT)) || ' ' || metric ORDER BY rank), chr(10)) AS answer
    FROM ({_rank_sql("DESC", 5)}) GROUP BY metric""")
def ranked_answers(s, d):
    return records.ranked_answer(records.rank(records.metric_records(facts(s, d)), 5))


@query(f"""
    SELECT query_id, 'No answer was written; these passages fit best:' || chr(10) || string_agg('- ' || document || ', page ' || coalesce(CAST(page AS VARCHAR), '?') || ': ' || CASE WHEN length(t) > 500 THEN regexp_replace(substr(t, 1, 500), '\\s+\\S*$', '') || ' …' ELSE t END, chr(10) ORDER BY rank) AS answer,
           least(0.45, greatest(max(score) FILTER (rank = 1), 0.2)) AS confidence
    FROM (SELECT h.query_id, h.document, c.page, h.score, h.rank, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS t FROM ({bm25_sql(3)}) h JOIN {CHUNKS} c USING (document, chunk_index)) GROUP BY query_id""")
def fallback_answers(s, d):
    chunks = corpus.corpus(s, d)
    hits = retrieval.bm25(stated(s, d), index(s, d), 3).join(chunks.select("document", "chunk_index", "page", "text"), ["document", "chunk_index"])
    return records.fallback_answer(hits)


@query(f"""
    SELECT query_id, CASE WHEN query_type IN ('LOOKUP', 'ENTITY_LOOKUP', 'SEMANTIC_LOOKUP') THEN top >= 0.3 WHEN query_type IN ('AGGREGATION', 'COUNTING', 'NUMERICAL_FILTER', 'RANKING') THEN n > 0
        WHEN query_type IN ('COMPARISON', 'RELATIONSHIP') THEN n >= 2 WHEN query_type = 'MULTI_HOP' THEN n >= 2 AND top >= 0.2 ELSE top >= 0.2 END AS sufficient
    FROM (SELECT query_id, query_type FROM ({CLASSIFIED})) JOIN (SELECT query_id, coalesce(list_max(list_transform(retrieved_top5, lambda x: x.relevance_score)), 0.0) AS top, coalesce(len(retrieved_top5), 0) AS n FROM {RESULTS}) USING (query_id)""")
def evidence_sufficient(s, d):
    top = results(s, d).select("query_id", F.coalesce(F.array_max(F.transform("retrieved_top5", lambda x: x["relevance_score"])), F.lit(0.0)).alias("top"), F.coalesce(F.size("retrieved_top5"), F.lit(0)).alias("n"))
    n = F.greatest(F.col("n"), F.lit(0))
    return planner.classify(questions(s, d)).join(top, "query_id").select("query_id", records.sufficient(F.col("query_type"), F.col("top"), n, n, n).alias("sufficient"))


@query(f"""
    SELECT query_id, CASE query_type WHEN 'AGGREGATION' THEN 'aggregate' WHEN 'NUMERICAL_FILTER' THEN 'numeric_filter' WHEN 'COUNTING' THEN 'count' WHEN 'RANKING' THEN 'rank' WHEN 'COMPARISON' THEN 'compare'
        WHEN 'RELATIONSHIP' THEN 'relationships' WHEN 'TEMPORAL' THEN 'temporal' WHEN 'MULTI_HOP' THEN 'multi_hop' ELSE 'none' END AS branch FROM ({CLASSIFIED})""")
def reasoning_branch(s, d):
    return planner.classify(questions(s, d)).select("query_id", records.branch(F.col("query_type"), F.col("hints")).alias("branch"))


@query(f"""
    SELECT metric, any_value(n) || ' ' || metric || ' records: ' || string_agg(entity, ', ' ORDER BY r) || CASE WHEN any_value(sure) < 0.75 THEN ' (low confidence)' ELSE '' END AS summary
    FROM (SELECT metric, entity, row_number() OVER (PARTITION BY metric ORDER BY value DESC, entity) AS r, count(*) OVER (PARTITION BY metric) AS n, 0.85 AS sure FROM {_DEDUPED}) WHERE r <= 10 GROUP BY metric""")
def reasoning_summary(s, d):
    return records.summary_line(records.metric_records(facts(s, d)))


@query(f"""
    SELECT query_id, query_type NOT IN ('RANKING', 'AGGREGATION', 'COUNTING') AND top < 0.15 AND query_type NOT IN ('COMPARISON', 'ANALYTICAL') AND NOT regexp_matches(question, '{planner.DOC_SPECIFIC}') AS general
    FROM (SELECT query_id, question, query_type FROM ({CLASSIFIED})) JOIN (SELECT query_id, coalesce(list_max(list_transform(retrieved_top5, lambda x: x.relevance_score)), 0.0) AS top FROM {RESULTS}) USING (query_id)""")
def general_fallback(s, d):
    top = results(s, d).select("query_id", F.array_max(F.transform("retrieved_top5", lambda x: x["relevance_score"])).alias("top"))
    return planner.classify(questions(s, d)).join(top, "query_id").select("query_id", planner.wants_general_answer(F.col("question"), F.col("query_type"), F.col("top")).alias("general"))


# -- state ------------------------------------------------------------------------------------------
NOW = "(SELECT max(created_at) FROM cache_rows)"


def _now(s, d):
    return table(s, d, "cache_rows").agg(F.max("created_at").alias("now"))


@query(f"SELECT cache_id FROM {CACHE} WHERE epoch_us(created_at) >= epoch_us({NOW}) - 86400000000")
def cache_live(s, d):
    rows = cache(s, d).crossJoin(F.broadcast(_now(s, d)))  # one row
    return state.live(rows, F.col("now"), 86_400).select("cache_id")


@query(f"SELECT cache_id FROM (SELECT cache_id, row_number() OVER (PARTITION BY corpus_key ORDER BY last_accessed_at DESC, cache_id) AS r FROM {CACHE}) WHERE r <= 512")
def cache_survivors(s, d):
    return state.survivors(cache(s, d), ["corpus_key"]).select("cache_id")


@query(f"""
    SELECT query_id, cache_id FROM (SELECT cache_id AS query_id, corpus_key, top_k, normalized_question AS q FROM {CACHE})
    JOIN (SELECT cache_id, corpus_key, top_k, normalized_question FROM (SELECT *, row_number() OVER (PARTITION BY corpus_key, top_k, normalized_question ORDER BY created_at DESC, cache_id) AS r FROM {CACHE}) WHERE r = 1) USING (corpus_key, top_k)
    WHERE regexp_replace(regexp_replace(lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') = normalized_question""")
def cache_exact(s, d):
    rows = cache(s, d)
    asked = rows.select(F.col("cache_id").alias("query_id"), "corpus_key", "top_k", F.col("normalized_question").alias("question"))
    return state.exact(asked, rows)


@query(f"""
    WITH fit AS (SELECT cache_id, corpus_key, CAST(embedding AS DOUBLE[]) AS e FROM {CACHE} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    asked AS (SELECT cache_id AS query_id, corpus_key, e FROM fit WHERE CAST(epoch_us((SELECT any_value(created_at) FROM cache_rows c WHERE c.cache_id = fit.cache_id)) // 1000000 AS BIGINT) % 50 = 0)
    SELECT query_id, arg_min(cache_id, (-similarity, cache_id)) AS cache_id, max(similarity) AS similarity
    FROM (SELECT query_id, c.cache_id, round(list_cosine_similarity(a.e, c.e), 6) AS similarity FROM asked a JOIN fit c USING (corpus_key)) WHERE similarity >= 0.92 AND query_id <> cache_id GROUP BY query_id""")
def cache_semantic(s, d):
    rows = cache(s, d)
    asked = rows.filter(F.floor(F.unix_micros("created_at") / 1_000_000) % STATED == 0).select(F.col("cache_id").alias("query_id"), "corpus_key", "embedding")
    return state.semantic(asked, rows)


@query(f"SELECT count(*) FILTER (cache_hit) AS hits, count(*) - count(*) FILTER (cache_hit) AS misses, round(count(*) FILTER (cache_hit) / count(*), 4) AS hit_rate FROM {RESPONSES}")
def cache_stats(s, d):
    return state.cache_stats(responses(s, d))


@query(f"SELECT corpus_key, round(least(100.0, count(*) * 100.0 / 512), 2) AS load_percent FROM {CACHE} GROUP BY corpus_key")
def cache_load(s, d):
    return state.load_percent(cache(s, d))


@query(f"""
    SELECT cache_id, CASE WHEN length(normalized_question) > 150 THEN substr(normalized_question, 1, 150) || '...' ELSE normalized_question END AS preview, t AS seconds_left,
           CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' END AS ttl
    FROM (SELECT cache_id, normalized_question, CAST(floor(864000 - (epoch_us({NOW}) - epoch_us(created_at)) / 1e6) AS BIGINT) AS t FROM {CACHE} WHERE epoch_us(created_at) >= epoch_us({NOW}) - 864000000000)""")
def cache_entries(s, d):
    return state.entries(cache(s, d).crossJoin(F.broadcast(_now(s, d))), F.col("now"), 864_000)


_TURNS = f"(SELECT session_id, original_query, answer, row_number() OVER (PARTITION BY session_id ORDER BY created_at, response_id) AS n FROM {RESPONSES} WHERE session_id IS NOT NULL)"


@query(f"""
    SELECT session_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM (
        SELECT session_id, 2 * n - 1 AS turn, 'user' AS role, original_query AS content FROM {_TURNS} UNION ALL SELECT session_id, 2 * n, 'assistant', answer FROM {_TURNS}) WHERE trim(session_id) <> '') WHERE r <= 8""")
def chat_window(s, d):
    return state.history(state.turns_of(responses(s, d))).select("session_id", F.col("turn").cast("bigint").alias("turn"), "role", "content")


# -- evaluation ---------------------------------------------------------------------------------------
RANKS = f"""(
    SELECT query_id, question_type, rank, CASE WHEN rank > 0 THEN round(1.0 / rank, 6) ELSE 0.0 END AS reciprocal_rank, CAST(rank BETWEEN 1 AND 1 AS INTEGER) AS hit_1, CAST(rank BETWEEN 1 AND 3 AS INTEGER) AS hit_3, CAST(rank BETWEEN 1 AND 5 AS INTEGER) AS hit_5
    FROM (SELECT query_id, question_type, CAST(coalesce(list_min(list_filter(list_transform(retrieved_top5, lambda x, i: CASE WHEN lower(x.document) = lower(expected_document) AND abs(x.page - expected_page) <= 1 THEN i END), lambda i: i IS NOT NULL)), 0) AS INTEGER) AS rank FROM {RESULTS}))"""
_REPORT = "count(*) AS n, " + ", ".join(f"round(avg(hit_{k}), 4) AS recall_at_{k}" for k in (1, 3, 5)) + ", " + ", ".join(f"round(avg(hit_{k} / {k}), 4) AS precision_at_{k}" for k in (1, 3, 5)) + ", round(avg(reciprocal_rank), 4) AS mrr"


@query(f"SELECT * FROM {RANKS}")
def eval_ranks(s, d):
    return evaluation.ranks(results(s, d))


@query(f"SELECT {_REPORT} FROM {RANKS}")
def eval_report(s, d):
    return evaluation.report(evaluation.ranks(results(s, d)))


@query(f"SELECT question_type, {_REPORT} FROM {RANKS} GROUP BY question_type")
def eval_by_type(s, d):
    return evaluation.report(evaluation.ranks(results(s, d)), ["question_type"])


def grounded(s, d):
    rows = results(s, d).withColumn("contexts", F.array("reference_answer"))
    base = evaluation.grounding(rows.select("query_id", F.col("generated_answer").alias("answer"), "contexts", (F.col("question_type") == "relational").alias("from_graph")))
    return base.join(rows.select("query_id", evaluation.answer_similarity(F.col("generated_answer"), F.col("reference_answer")).alias("similarity")), "query_id")


_SAID = "list_filter(list_transform(regexp_split_to_array(coalesce(generated_answer, ''), '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 10)"
_GROUNDED = f"""(
    SELECT query_id, f AS faithfulness, f < 0.3 AS unsupported, coverage, similarity, question_type = 'relational' AND coalesce(regexp_matches(generated_answer, '{evaluation.SPECULATIVE}'), false) AS speculative
    FROM (SELECT query_id, question_type, generated_answer, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, r)) / len(a) END, 4) AS f,
                 CASE WHEN len(s) = 0 THEN 1.0 ELSE round(len(list_filter(s, lambda x: len(list_intersect({token_set_sql('x')}, r)) >= 3)) / len(s), 4) END AS coverage,
                 CASE WHEN trim(coalesce(reference_answer, '')) = '' THEN 0.0 ELSE round(CASE WHEN least(len(a), len(r)) > 0 THEN len(list_intersect(a, r)) / least(len(a), len(r)) ELSE 0.0 END, 4) END AS similarity
          FROM (SELECT *, {token_set_sql('generated_answer')} AS a, {token_set_sql('reference_answer')} AS r, {_SAID} AS s FROM {RESULTS})))"""


@query(f"""
    SELECT question_type, count(*) AS n, round(avg(faithfulness), 4) AS mean_faithfulness, round(avg(coverage), 4) AS mean_coverage, round(avg(CAST(unsupported AS INTEGER)), 4) AS unsupported_rate, round(avg(CAST(speculative AS INTEGER)), 4) AS speculative_rate, round(avg(hit_3), 4) AS recall_at_3
    FROM {RANKS} JOIN {_GROUNDED} USING (query_id) GROUP BY question_type""")
def grounding_by_type(s, d):
    return evaluation.grounding_summary(evaluation.ranks(results(s, d)), grounded(s, d))


@query(f"""
    SELECT {_REPORT}, round(avg(faithfulness), 4) AS mean_faithfulness, round(avg(coverage), 4) AS mean_coverage, round(avg(similarity), 4) AS mean_similarity, round(avg(CAST(unsupported AS INTEGER)), 4) AS unsupported_rate, round(avg(CAST(speculative AS INTEGER)), 4) AS speculative_rate,
           round(avg(total_response_time_ms), 3) AS mean_total_response_time_ms
    FROM {RANKS} JOIN {_GROUNDED} USING (query_id) JOIN (SELECT query_id, total_response_time_ms FROM {RESULTS}) USING (query_id)""")
def eval_whole_report(s, d):
    return evaluation.whole_report(evaluation.ranks(results(s, d)), grounded(s, d), results(s, d).select("query_id", "total_response_time_ms"))


_SETS = f"(SELECT query_id, {token_set_sql('generated_answer')} AS a, {token_set_sql('reference_answer')} AS r FROM {RESULTS})"


@query(f"SELECT query_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, r)) / len(a) END, 4) AS faithfulness FROM {_SETS}")
def faithfulness(s, d):
    return results(s, d).select("query_id", evaluation.faithfulness(F.col("generated_answer"), F.col("reference_answer")).alias("faithfulness"))


@query(f"SELECT query_id, CASE WHEN trim(coalesce(reference_answer, '')) = '' THEN 0.0 ELSE round(CASE WHEN least(len(a), len(r)) > 0 THEN len(list_intersect(a, r)) / least(len(a), len(r)) ELSE 0.0 END, 4) END AS similarity FROM {_SETS} JOIN (SELECT query_id, reference_answer FROM {RESULTS}) USING (query_id)")
def answer_similarity(s, d):
    return results(s, d).select("query_id", evaluation.answer_similarity(F.col("generated_answer"), F.col("reference_answer")).alias("similarity"))


@query(f"""
    WITH said AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(coalesce(generated_answer, ''), '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 10) AS s, {token_set_sql('reference_answer')} AS c FROM {RESULTS})
    SELECT query_id, CASE WHEN len(s) = 0 THEN 1.0 ELSE round(len(list_filter(s, lambda x: len(list_intersect({token_set_sql('x')}, c)) >= 3)) / len(s), 4) END AS coverage FROM said""")
def evidence_coverage(s, d):
    return results(s, d).select("query_id", evaluation.coverage(F.col("generated_answer"), F.array("reference_answer")).alias("coverage"))


@query(f"SELECT response_id, regexp_matches(answer, '{evaluation.SPECULATIVE}') AS speculative FROM {RESPONSES} WHERE answer IS NOT NULL")
def speculative(s, d):
    return responses(s, d).filter("answer IS NOT NULL").select("response_id", evaluation.is_speculative(F.col("answer"), F.lit(True)).alias("speculative"))


@query(f"SELECT question_type, count(*) AS n, round(avg(total_response_time_ms), 3) AS mean, quantile_disc(total_response_time_ms, 0.95) AS p95, min(total_response_time_ms) AS fastest, max(total_response_time_ms) AS slowest FROM {RESULTS} WHERE total_response_time_ms IS NOT NULL GROUP BY question_type")
def latency_by_type(s, d):
    return evaluation.latency(results(s, d), "total_response_time_ms", ["question_type"])


@query(f"SELECT document, chunk_index, next_index FROM (SELECT document, chunk_index, lead(chunk_index) OVER (PARTITION BY document ORDER BY chunk_index) AS next_index, row_number() OVER (PARTITION BY document ORDER BY chunk_index) AS r FROM {CHUNKS}) WHERE next_index IS NOT NULL AND r <= 3")
def adjacent_chunks(s, d):
    return evaluation.adjacent(corpus.corpus(s, d))


@query(rf"""
    SELECT document, page, chunk_index, 'What information is stated in ' || document || ' on page ' || page || ', chunk ' || chunk_index || '?' AS question,
           CASE WHEN length(o) > 220 THEN regexp_replace(regexp_replace(substr(o, 1, 220), ' [^ ]*$', ''), '[ ,;:]+$', '') || '...' WHEN o = '' THEN 'See the referenced document chunk.' ELSE o END AS answer
    FROM (SELECT document, page, chunk_index, trim(regexp_replace(coalesce(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1], ''), '\s+', ' ', 'g')) AS o FROM {CHUNKS})""")
def fallback_pool(s, d):
    return evaluation.fallback_questions(corpus.corpus(s, d))


_POOL = f"(SELECT query_id, expected_document, question, {token_set_sql('question')} AS w FROM {RESULTS} WHERE question IS NOT NULL)"


@query(f"""
    WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY query_id) AS i FROM {_POOL} WHERE len(w) > 0),
    near AS MATERIALIZED (SELECT b.i, list(a.i) AS early FROM q a JOIN q b ON a.i < b.i WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6 GROUP BY b.i),
    go(i, query_id, fresh, kept) AS (
        SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS BIGINT[])
        UNION ALL SELECT i, query_id, fresh, CASE WHEN fresh THEN list_append(kept, i) ELSE kept END
            FROM (SELECT q.i, q.query_id, kept, near.i IS NULL OR NOT list_has_any(kept, near.early) AS fresh FROM go JOIN q ON q.i = go.i + 1 LEFT JOIN near ON near.i = q.i))
    SELECT expected_document AS block, query_id AS question_id, question FROM {_POOL} WHERE len(w) = 0 OR query_id IN (SELECT query_id FROM go WHERE fresh)""")
def question_pool(s, d):
    q = results(s, d).filter("question IS NOT NULL")
    return evaluation.distinct_questions(q.select(F.col("expected_document").alias("block"), F.col("query_id").alias("question_id"), "question"), whole=True)


@query(f"SELECT query_id, round(least(1.0, 1.6 * (0.6 * top + 0.4 * f)), 3) AS confidence FROM (SELECT query_id, coalesce(list_max(list_transform(retrieved_top5, lambda x: x.relevance_score)), 0.0) AS top, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, r)) / len(a) END AS f FROM (SELECT query_id, retrieved_top5, {token_set_sql('generated_answer', T.CONFIDENCE_STOPWORDS, False)} AS a, {token_set_sql('reference_answer', T.CONFIDENCE_STOPWORDS, False)} AS r FROM {RESULTS}))")
def answer_confidence(s, d):
    top = F.coalesce(F.array_max(F.transform("retrieved_top5", lambda x: x["relevance_score"])), F.lit(0.0))
    words = [T.token_set(F.col(c), T.CONFIDENCE_STOPWORDS, False) for c in ("generated_answer", "reference_answer")]
    return results(s, d).select("query_id", T.confidence(top, T.recall(*words)).alias("confidence"))


@query(f"""
    WITH named AS (SELECT document, chunk_index, entity_id, arg_min(text, mention_id) AS text, min(mention_id) AS first FROM {MENTIONS} WHERE document IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL AND trim(text) <> '' GROUP BY ALL),
    two AS (SELECT document, chunk_index, list(text ORDER BY first) AS t FROM named GROUP BY ALL HAVING count(*) >= 2),
    related AS (SELECT document, chunk_index, t FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY chunk_index) AS r FROM two) WHERE r <= 3)
    SELECT document, question, answer, kind FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY list_position(['factual', 'relational', 'comparative', 'fallback'], kind), chunk_index, question) AS r FROM (
        SELECT document, chunk_index, 'How are ' || t[1] || ' and ' || t[2] || ' related in ' || document || '?' AS question, '' AS answer, 'relational' AS kind FROM related WHERE document IN (SELECT document FROM {CHUNKS})
        UNION ALL SELECT document, chunk_index, 'How do chunks ' || chunk_index || ' and ' || next_index || ' of ' || document || ' differ?' AS question, '' AS answer, 'comparative' AS kind FROM ({ORACLE['adjacent_chunks']})
        UNION ALL SELECT document, chunk_index, question, answer, 'fallback' FROM ({ORACLE['fallback_pool']}))) WHERE r <= 10""")
def evaluation_pool(s, d):
    chunks = corpus.corpus(s, d)
    return evaluation.question_pool(chunks, mentions=mentions(s, d).join(chunks.select("document").distinct(), "document", "left_semi"))


@query(f"SELECT response_id, coalesce(round(latency_ms, 3), 0.0) AS answer_ms, CAST(0.0 AS DOUBLE) AS embed_ms, round(coalesce(latency_ms, 0.0), 3) AS total_ms FROM {RESPONSES}")
def stage_latency(s, d):
    m = evaluation.stage_latency(F.create_map(F.lit("answer"), F.col("latency_ms")), ["answer", "embed"])
    return responses(s, d).select("response_id", m.alias("m")).select("response_id", F.col("m")["answer"].alias("answer_ms"), F.col("m")["embed"].alias("embed_ms"), F.col("m")["total"].alias("total_ms"))


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(T.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query(f"SELECT corpus_key, count(*) AS n FROM {CACHE} GROUP BY corpus_key")
def cache_snapshot(s, d):
    return corpus.snapshot(cache(s, d), "cache").groupBy("corpus_key").agg(F.count("*").alias("n"))


_MET = f"(SELECT DISTINCT entity_id, document, page, chunk_index FROM {MENTIONS} WHERE label IN ('PERSON', 'COMPANY', 'EXECUTIVE') AND entity_id IS NOT NULL AND document IS NOT NULL AND chunk_index IS NOT NULL)"


@query(f"""
    WITH place AS {_MET}, asked AS (SELECT entity_id AS query_id, entity_id FROM entities WHERE label IN ('PERSON', 'COMPANY')),
    met AS (SELECT DISTINCT query_id, document, page, chunk_index FROM asked JOIN place USING (entity_id)),
    wide AS (SELECT DISTINCT query_id, p.entity_id FROM met m JOIN place p ON m.document = p.document AND m.chunk_index = p.chunk_index AND m.page IS NOT DISTINCT FROM p.page UNION SELECT query_id, entity_id FROM asked),
    hits AS (SELECT query_id, document, page, chunk_index, count(DISTINCT entity_id) AS hits FROM wide JOIN place USING (entity_id) GROUP BY ALL)
    SELECT query_id, document, page, chunk_index, hits, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, document, page, chunk_index) AS rank FROM hits) WHERE rank <= 12""")
def graph_retrieval(s, d):
    asked = table(s, d, "entities").filter(F.col("label").isin("PERSON", "COMPANY")).select(F.col("entity_id").alias("query_id"), "entity_id")
    # entities met in one chunk are neighbours
    m = mentions(s, d).filter("label IN ('PERSON', 'COMPANY', 'EXECUTIVE')")
    return graph.chunk_retrieve(asked, m).select("query_id", "document", "page", "chunk_index", "hits", "rank")


@query()
def sample_corpus(s, d):
    from foliant.sources.sample import sample_pages

    return chunking.chunk_fixed(sample_pages(s))


# -- functions and sinks that no query above asks for ------------------------------------------------------
_TIDY = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_BARE = rf"regexp_replace(regexp_replace({_TIDY}, '{T.ENTITY_PREFIX}', ''), '^\s+|\s+$', '', 'g')"


@query(rf"""
    SELECT mention_id, CASE WHEN ends_with(label, '_ID') OR label IN ('ID', 'EMAIL', 'PHONE') THEN lower({_BARE}) ELSE regexp_replace(regexp_replace(lower({_BARE}), '[^\p{{L}}\p{{N}}_\s&.-]', '', 'g'), '^\s+|\s+$', '', 'g') END AS norm
    FROM (SELECT mention_id, text, CASE WHEN label = 'CONTRACT' THEN 'CONTRACT_ID' ELSE label END AS label FROM {MENTIONS} WHERE text IS NOT NULL AND label IS NOT NULL)""")
def graph_normalise(s, d):
    m = mentions(s, d).filter("text IS NOT NULL AND label IS NOT NULL").withColumn("label", F.when(F.col("label") == "CONTRACT", "CONTRACT_ID").otherwise(F.col("label")))
    return m.select("mention_id", T.normalise_graph_entity(F.col("text"), F.col("label")).alias("norm"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'INVOICE_ID' ELSE 'INV_ID' END AS label FROM orders")
def id_labels(s, d):
    noun = F.when(F.col("o_orderkey") % 2 == 0, "invoice")
    return table(s, d, "orders").select("o_orderkey", T.label_of_id(noun, F.concat(F.lit("inv-"), F.col("o_orderkey").cast("string"))).alias("label"))


@query(f"SELECT query_id, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS badge FROM (SELECT query_id, coalesce(list_max(list_transform(retrieved_top5, lambda x: x.relevance_score)), 0.0) AS c FROM {RESULTS})")
def confidence_badges(s, d):
    top = F.coalesce(F.array_max(F.transform("retrieved_top5", lambda x: x["relevance_score"])), F.lit(0.0))
    return results(s, d).select("query_id", T.confidence_badge(top).alias("badge"))


@query(f"SELECT count(*) FILTER (cache_hit) AS hits, count(*) - count(*) FILTER (cache_hit) AS misses, round(count(*) FILTER (cache_hit) / count(*), 4) AS hit_rate, count(*) FILTER (cache_hit AND latency_ms < 200) AS exact_hits, count(*) FILTER (cache_hit AND latency_ms >= 200) AS semantic_hits FROM {RESPONSES}")
def cache_tiers(s, d):
    rows = responses(s, d).withColumn("tier", F.when(F.col("latency_ms") < 200, "exact").when(F.col("latency_ms") >= 200, "semantic"))
    return state.cache_stats(rows, "tier")


@query(f"SELECT document, count(*) AS n_chunks, arg_min(section_title, (page, chunk_index)) FILTER (trim(section_title) <> '') AS summary FROM (SELECT document, chunk_index, any_value(page) AS page, any_value(section_title) AS section_title FROM chunks WHERE document IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL) GROUP BY document")
def document_info_summary(s, d):
    return corpus.document_info(corpus.corpus(s, d).withColumn("summary", F.col("section_title"))).select("document", "n_chunks", "summary")


@query(f"""
    SELECT p.document, p.pages, coalesce(r.relations, 0) AS relations FROM (SELECT document, count(*) AS pages FROM {PAGES} GROUP BY document) p
    LEFT JOIN (SELECT document, count(*) AS relations FROM (SELECT DISTINCT document, entity_id, label FROM {MENTIONS} WHERE document IS NOT NULL) GROUP BY document) r USING (document)""")
def ingest_relations(s, d):
    related = mentions(s, d).select(F.col("entity_id").alias("source_id"), F.col("label").alias("target_id"), F.lit("BELONGS_TO").alias("type"), "document")
    return corpus.ingest_rollup(corpus.page_table(s, d), corpus.corpus(s, d), table(s, d, "mentions"), related).select("document", "pages", "relations")


@query("""
    SELECT document, chunk_index, round(x, 6) AS x FROM (
        SELECT 'd' || vec_id % 10 AS document, vec_id AS chunk_index, CAST(-embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 = 0
        UNION ALL SELECT 'd' || vec_id % 10, vec_id, CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0)""")
def vector_upsert(s, d):
    keyed = table(s, d, "embeddings").select(F.concat(F.lit("d"), (F.col("vec_id") % 10).cast("string")).alias("document"), F.col("vec_id").alias("chunk_index"), "embedding")
    incoming = keyed.filter("chunk_index % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    merged = corpus.upsert_vectors(keyed.filter("chunk_index % 2 = 0"), incoming)
    return merged.select("document", "chunk_index", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("SELECT document, page FROM (SELECT DISTINCT document, page FROM pages WHERE document IS NOT NULL AND page IS NOT NULL) WHERE lower(regexp_extract(document, '\\.([^./]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp') AND page * 20000000 <= 52428800")
def upload_accept(s, d):
    rows = table(s, d, "pages").filter("document IS NOT NULL AND page IS NOT NULL").select("document", "page").distinct()
    return rows.filter(corpus.accepted_upload(F.col("document"), F.col("page") * 20_000_000))


@query(f"SELECT corpus_key, count(*) AS n FROM {CACHE} WHERE corpus_key IS DISTINCT FROM (SELECT min(corpus_key) FROM cache_rows) GROUP BY corpus_key")
def cache_invalidate(s, d):
    rows = cache(s, d)
    first = rows.agg(F.min("corpus_key")).first()[0]
    return state.invalidate(rows, first).groupBy("corpus_key").agg(F.count("*").alias("n"))


@query(f"""
    SELECT query_id, document, chunk_index FROM ({bm25_sql(20)}) JOIN {CHUNKS} USING (document, chunk_index) JOIN (SELECT query_id, question FROM {RESULTS}) USING (query_id)
    WHERE score >= 0.8 OR coalesce(len(list_intersect(coalesce(entities, []), regexp_extract_all(question, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1))), 0) > 0""")
def evidence_kept(s, d):
    held = retrieval.bm25(stated(s, d), index(s, d), 20).join(corpus.corpus(s, d).select("document", "chunk_index", "entities"), ["document", "chunk_index"]).join(stated(s, d), "query_id")
    asked = F.regexp_extract_all("question", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), F.lit(1))
    return retrieval.evidence(held, F.col("entities"), asked, 0.8).select("query_id", "document", "chunk_index")


@query(f"""
    WITH m AS (SELECT DISTINCT document, page, chunk_index, lower(text) AS name, entity_id, mention_id FROM {MENTIONS} WHERE document IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL),
    first AS (SELECT document, page, chunk_index, name, arg_min(entity_id, mention_id) AS entity_id FROM (SELECT document, page, chunk_index, name, entity_id, mention_id FROM m UNION SELECT document, page, chunk_index, normalized, entity_id, mention_id FROM {MENTIONS} WHERE normalized IS NOT NULL AND document IS NOT NULL AND chunk_index IS NOT NULL) GROUP BY ALL),
    said AS (SELECT document, page, chunk_index, min(name) AS s, max(name) AS t FROM m GROUP BY ALL HAVING count(DISTINCT name) > 1)
    SELECT DISTINCT a.entity_id AS source_id, b.entity_id AS target_id, 'RELATED_TO' AS type, s.document, 0.92 AS confidence FROM said s
    JOIN first a ON a.document = s.document AND a.page = s.page AND a.chunk_index = s.chunk_index AND a.name = s.s JOIN first b ON b.document = s.document AND b.page = s.page AND b.chunk_index = s.chunk_index AND b.name = s.t""")
def relations_linked(s, d):
    m = mentions(s, d).filter("document IS NOT NULL AND chunk_index IS NOT NULL")
    said = m.filter("text IS NOT NULL").groupBy("document", "page", "chunk_index").agg(F.min(F.lower("text")).alias("source"), F.max(F.lower("text")).alias("target")).filter("source <> target")
    found = graph.relations_of(said.withColumn("type", F.lit("RELATED_TO")).withColumn("seq", F.lit(0)), m)
    return found.select("source_id", "target_id", "type", "document", F.col("confidence").cast("double").alias("confidence"))


# -- events ---------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(s, d):
    return events.tumbling(table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH e AS (SELECT date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS slot FROM events)
    SELECT start, count(*) AS n FROM (SELECT slot AS start FROM e UNION ALL SELECT slot - INTERVAL 30 MINUTE FROM e) GROUP BY start""")
def sliding_counts(s, d):
    return events.sliding(table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM r GROUP BY user_id, run""")
def session_counts(s, d):
    e = events.sessions(table(s, d, "events"))
    return e.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("finish", F.col("finish").cast("timestamp_ntz"))


# -- quantities -------------------------------------------------------------------------------------------
@query()
def p7_found(s, d):
    return units.common_quantities(table(s, d, "mentions"), table(s, d, "entities"), table(s, d, "common_units"))


@query("""
    WITH v AS (SELECT entity_id, source, value FROM (SELECT entity_id, 'numeric_value' AS source, numeric_value AS value FROM entities UNION ALL SELECT entity_id, 'metadata', TRY_CAST(metadata['numeric_value'] AS DOUBLE) FROM entities UNION ALL SELECT entity_id, 'name', TRY_CAST(name AS DOUBLE) FROM entities) WHERE value IS NOT NULL AND NOT isnan(value)),
    pairs AS (SELECT x.source AS a, y.source AS b, x.value AS x, y.value AS y FROM v x JOIN v y ON x.entity_id = y.entity_id AND x.source < y.source),
    centres AS (SELECT a, b, count(*) AS n, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my FROM pairs GROUP BY ALL HAVING count(*) >= 8),
    slopes AS (SELECT a, b, n, coalesce(quantile_disc((y - my) / (x - mx), 0.5) FILTER (abs(x - mx) > 1e-9 * greatest(1.0, abs(mx))), my / nullif(mx, 0), 1.0) AS scale FROM pairs JOIN centres USING (a, b) GROUP BY a, b, n, mx, my)
    SELECT a, b, n, round(scale, 6) AS scale, round(quantile_disc(y - scale * x, 0.5), 6) AS "offset" FROM pairs JOIN slopes USING (a, b) GROUP BY a, b, n, scale""")
def p7_sources(s, d):
    """Each pair of sources of the numbers of one entity, with its estimated conversion."""
    e = table(s, d, "entities")
    columns = {"numeric_value": F.col("numeric_value"), "metadata": F.expr("try_cast(metadata['numeric_value'] AS double)"), "name": F.expr("try_cast(name AS double)")}
    found = e.select(F.col("entity_id").alias("entity"), F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("value")) for k, v in columns.items()])).alias("x"))
    estimates = units.estimate_links(found.select("entity", "x.source", "x.value"))
    return estimates.select("a", "b", "n", F.round("scale", 6).alias("scale"), F.round("offset", 6).alias("offset"))
