"""Scans and sinks of the document corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import cut, table

#: Fixed values
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MIN_NATIVE_CHARS = 40
QA_SCHEMA = "question string, expected_document string, expected_page int, answer_hint string"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, one row for each (document, chunk_index); repeated rows hold the same."""
    return table(spark, d, "chunks").filter("document IS NOT NULL AND chunk_index IS NOT NULL").dropDuplicates(["document", "chunk_index"])


def page_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("document IS NOT NULL AND page IS NOT NULL").dropDuplicates(["document", "page"])


def scan_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of the accepted kinds with their bytes: (path, length, modificationTime, content)."""
    kinds = "*.{" + ",".join([*SUFFIXES, *map(str.upper, SUFFIXES)]) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", kinds).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def accepted_upload(path: Column, length: Column) -> Column:
    """Whether an upload has an accepted kind and size."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SUFFIXES) & (length <= MAX_UPLOAD_BYTES)


def extraction_route(text: Column, least: int = MIN_NATIVE_CHARS) -> Column:
    """Native text if a page has enough of it, else recognition."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least, "native").otherwise("ocr")


def block_confidence(blocks: Column) -> Column:
    """Mean confidence of a page's blocks: negative values count 0, percentages are scaled."""
    c = F.filter(F.transform(blocks, lambda b: b["confidence"]), lambda x: x.isNotNull())
    scaled = F.transform(c, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x))))
    return F.when(F.size(scaled) > 0, F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x) / F.size(scaled)).otherwise(F.lit(0.0))


def scan(chunks: DataFrame, where: dict | None = None) -> DataFrame:
    """Chunks that equal all values of ``where``, in reading order; the filter reaches the scan."""
    for k, v in (where or {}).items():
        chunks = chunks.filter(F.col(k) == F.lit(v))
    return chunks.orderBy("document", "page", "chunk_index")


def replace_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sink semantics of an ingest: documents of ``incoming`` are replaced as a whole, so no
    chunk of an older, longer version stays behind."""
    return current.join(incoming.select("document").distinct(), "document", "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_vectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows keyed by (document, chunk_index), the incoming one wins; all vectors must have one
    length."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("document", "chunk_index").orderBy(F.desc("_new"))
    kept = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")
    length = F.size("embedding")
    return kept.withColumn("embedding", F.when(length == F.first(length, True).over(Window.partitionBy("document")), F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in length"))))


def write_documents(df: DataFrame, path: str) -> None:
    """Write partitioned by document; only the partitions present in ``df`` are replaced."""
    df.write.partitionBy("document").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def delete_document(chunks: DataFrame, document: str) -> DataFrame:
    return chunks.filter(~F.col("document").eqNullSafe(F.lit(document)))


def live_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that some mention still refers to, so a deleted document leaves no orphan."""
    return entities.join(mentions.select("entity_id").distinct(), "entity_id", "left_semi")


def document_list(chunks: DataFrame) -> DataFrame:
    return chunks.select("document").distinct().orderBy("document")


def mean_3(x: Column) -> Column:
    """Mean to three places, halves up: summed in whole millionths, so that it does not depend
    on the order of the rows."""
    total, n = F.sum(F.round(x * 1_000_000).cast("bigint")), F.count(x)
    return F.when(n > 0, F.floor((2 * total + 1000 * n) / (2000 * n)) / 1000.0)


def document_info(chunks: DataFrame) -> DataFrame:
    """Rollup of each document: chunks, pages, mean confidence (unknown counts 1), entities, and
    the first summary that is not blank, if chunks have any."""
    return chunks.groupBy("document").agg(
        F.count("*").alias("n_chunks"),
        F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"),
        mean_3(F.coalesce("ocr_confidence", F.lit(1.0))).alias("avg_confidence"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.coalesce("entities", F.array().cast("array<string>")))))).alias("n_entities"),
        *([F.min_by("summary", F.when(F.trim("summary") != "", F.struct("page", "chunk_index"))).alias("summary")] if "summary" in chunks.columns else []),
    )


def ingest_rollup(pages: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """What an ingest reports for each document; relations are those edges (.., document) state."""
    p = pages.groupBy("document").agg(F.count("*").alias("pages"), mean_3(F.col("ocr_confidence")).alias("ocr_confidence"), F.array_join(F.sort_array(F.collect_set("extraction_method")), "+").alias("methods"))
    c = chunks.groupBy("document").agg(F.count("*").alias("chunks"))
    m = mentions.filter("document IS NOT NULL").groupBy("document").agg(F.countDistinct("entity_id").alias("entities"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = p.join(c, "document", "left").join(m, "document", "left").select("document", "pages", "ocr_confidence", "methods", zero("chunks"), zero("entities"))
    if edges is None:
        return out
    r = edges.select("source_id", "target_id", "type", "document").distinct().groupBy("document").agg(F.count("*").alias("relations"))
    return out.join(r, "document", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """Key of the corpus: its document names and number of chunks; not its content. The names
    count by sums of their hashes, so they are never gathered or sorted."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5("document"), at, 15), 16, 10).cast("decimal(38,0)"))
    names = chunks.groupBy("document").agg(F.count("*").alias("n")).agg(part(1).alias("a"), part(17).alias("b"), F.count("*").alias("d"), F.sum("n").alias("n_chunks"))
    told = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("a", "b", "d")])
    n = F.coalesce("n_chunks", F.lit(0))
    return names.select(F.substring(F.sha2(F.concat(told, F.lit("|chunks:"), n.cast("string")), 256), 1, 16).alias("corpus_key"), n.alias("n_chunks"))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer pairs from a JSON array."""
    return spark.read.schema(QA_SCHEMA).json(path, multiLine=True).withColumn("answer_hint", F.coalesce("answer_hint", F.lit("")))


def write_report(report: DataFrame, path: str, gate: float = 0.7) -> bool:
    """Write a one-row report as JSON; whether it passes the recall gate."""
    report.coalesce(1).write.mode("overwrite").json(path)
    row = report.select("recall_at_3").first()
    return bool(row and row[0] is not None and row[0] >= gate)


PAGE_SCHEMA = "document string, page int, raw_text string, ocr_confidence double, extraction_method string, blocks array<struct<text:string,bbox:array<double>,confidence:double>>"


def extract_pages(files: DataFrame, extractors: list) -> DataFrame:
    """Pages of files by the first extractor that gives any; a file none can read is one page
    of method ``ocr_unavailable``, confidence 0. An extractor maps (path, bytes) to dicts."""
    import pandas as pd

    def run(batches):
        for f in batches:
            out = []
            for path, content in zip(f["path"], f["content"]):
                name, rows = path.rsplit("/", 1)[-1], None
                for extract in extractors:
                    try:
                        rows = list(extract(path, content))
                    except Exception:  # noqa: BLE001 - the next one is asked
                        rows = None
                    if rows:
                        break
                for i, r in enumerate(rows or [{}]):
                    blocks = r.get("blocks") or []
                    means = [b.get("confidence") for b in blocks if b.get("confidence") is not None]
                    out.append((name, r.get("page", i + 1), r.get("text", ""), r.get("confidence", sum(means) / len(means) if means else 0.0), r.get("method", "ocr_unavailable"), blocks))
            yield pd.DataFrame(out, columns=["document", "page", "raw_text", "ocr_confidence", "extraction_method", "blocks"])

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def snapshot(state: DataFrame, name: str, ttl: int = 0) -> DataFrame:
    """Persist a state table in the shared folder and return it as stored, less what is older
    than ``ttl`` seconds when it is read; 0 keeps all."""
    stored = cut(state, name)
    return stored if ttl <= 0 else stored.filter(F.col("created_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(ttl)))


class KeyValues:
    """A table of keys and values with expiry: (key, value, expires_at). What is set last counts;
    the table is replaced as a whole by each call, so a reader never sees half of one."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def set(self, rows: DataFrame, now: Column, ttl: int = 0) -> None:
        """Set (key, value); they expire ``ttl`` seconds after ``now``, 0 never."""
        new = rows.select("key", "value", (F.timestamp_micros(F.unix_micros(now) + ttl * 1_000_000) if ttl > 0 else F.lit(None).cast("timestamp")).alias("expires_at"))
        self.rows = cut(self.rows.join(new.select("key"), "key", "left_anti").unionByName(new), "keys")

    def live(self, now: Column) -> DataFrame:
        return self.rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, value) of asked keys that are set and live."""
        return keys.select("key").distinct().join(self.live(now).select("key", "value"), "key")

    def keys(self, pattern: str, now: Column) -> DataFrame:
        """Live keys that fit a pattern, in which * stands for anything."""
        like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return self.live(now).filter(F.col("key").like(like)).select("key")

    def ttl(self, now: Column) -> DataFrame:
        """(key, seconds): how long keys that expire still live."""
        return self.live(now).filter("expires_at IS NOT NULL").select("key", F.floor((F.unix_micros("expires_at") - F.unix_micros(now)) / 1e6).cast("bigint").alias("seconds"))

    def delete(self, keys: DataFrame) -> None:
        self.rows = cut(self.rows.join(keys.select("key"), "key", "left_anti"), "keys")
