"""Exact deduplication as a stateful stream: keyed state on disk, kept for ever, with full bytes compared on every hit.

Arriving rows carry the digest of the normalised text, the stable document id, the length and a locator of the content.
The stream groups them by digest; its state (RocksDB, in the stream's checkpoint, no watermark, so nothing expires)
retains for each digest the row to keep. After the arrivals are in, every row that shares a digest is compared byte for
byte with the row kept, which is fetched by its locator; rows that differ in spite of equal digests are grouped by their
whole text instead.

Defined results: a null text is empty, and all texts of white space alone are equal; of rows with equal document ids,
lengths and texts one stays, the others name it; a null document id counts as the largest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.llm.files import stored, whole_row
from hexrisk.session import scratch_path

#: The characters that normalising deletes.
WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
#: The state store keeps its data on disk and its memory bounded; the store's log is kept instead of whole snapshots.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Without this each store sets 4 MB aside for its log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 10_000


def normalised(text: Column) -> Column:
    """``text`` without white space of ASCII; plain replacements run faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream carries of each row: digest, length in code points, document id, and the row number as locator."""
    return docs.select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("locator"),
    )


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_by_stream(source: DataFrame, checkpoint: str) -> None:
    """Run the stream of arrivals to its end; the state under ``checkpoint`` goes on from where an earlier run stopped.

    Rows of one digest are pre-aggregated before they are shuffled, so a digest in a third of all rows is no hot key.
    """
    best = F.struct("length", F.coalesce(F.bitwise_not("doc_id"), F.lit(-(2**63))).alias("first"), F.bitwise_not(F.hash("locator")).alias("tie"), "doc_id", "locator")
    state = source.groupBy("digest").agg(F.max(best).alias("kept"), F.count("*").alias("n"))
    with _settings(source.sparkSession, STATE):
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state's rows: digest, the row to keep, and how many rows had the digest."""
    with _settings(spark, STATE):
        rows = spark.read.format("statestore").load(checkpoint)
        columns = rows.schema["value"].dataType.names
        return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.{columns[0]}").alias("kept"), F.col(f"value.{columns[1]}").alias("n"))


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of ``docs``, the whole row, and a locator of it: file and row in it.

    Rows that don't come straight from files are stored first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
    try:
        return docs.select(*columns, whole_row(docs), place)
    except AnalysisException:
        return stored(docs, "located").select(*columns, whole_row(docs), place)


def exact_groups(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each row of ``located`` documents: locator, doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` only routes rows; results don't depend on it, since hits are compared in full.
    """
    spark = rows.sparkSession
    arrived = stored(arrivals(rows, digest), "arrivals")
    checkpoint = scratch_path(spark, "dedup-state")
    source = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(arrived.inputFiles()[0].rpartition("/")[0]) if arrived.inputFiles() else None
    if source is None:
        return arrived.select("locator", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")).limit(0)
    keep_by_stream(source, checkpoint)
    marked = stored(arrived.join(read_state(spark, checkpoint), "digest"), "marked")
    hits = marked.filter("n > 1").select("locator", "digest", "kept")
    texts = rows.select("locator", F.col("text")).join(hits, "locator").select("*", normalised(F.col("text")).alias("content")).drop("text")
    texts = stored(texts, "hits")
    firsts = texts.filter("locator = kept.locator").select("digest", F.col("content").alias("first_content"))
    compared = texts.join(firsts, "digest").select("locator", "digest", "content", (F.col("content") == F.col("first_content")).alias("same"))
    strays = stored(compared.filter("not same").select("locator", "digest", "content"), "strays")
    size = marked.join(strays.groupBy("digest").agg(F.count("*").alias("strayed")), "digest", "left").join(
        strays.select("locator", F.lit(True).alias("stray")), "locator", "left_anti"
    )
    plain = size.select(
        "locator", "doc_id", F.col("kept.doc_id").alias("keep_id"), (F.col("n") - F.coalesce("strayed", F.lit(0))).alias("group_size"),
        (F.col("locator") == F.col("kept.locator")).alias("kept"), "digest",
    )
    best = F.struct("length", F.coalesce(F.bitwise_not("doc_id"), F.lit(-(2**63))).alias("first"), F.bitwise_not(F.hash("locator")).alias("tie"), "doc_id", "locator")
    apart = strays.join(marked.select("locator", "length", "doc_id"), "locator")
    groups = apart.groupBy("digest", "content").agg(F.max(best).alias("k"), F.count("*").alias("group_size"))
    regrouped = apart.join(groups, ["digest", "content"]).select(
        "locator", "doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("k.locator")).alias("kept"), "digest"
    )
    both = plain.unionByName(regrouped)
    if digest is sha256:
        return both.withColumnRenamed("digest", "text_sha256")
    return both.drop("digest").join(rows.select("locator", sha256(normalised(F.col("text"))).alias("text_sha256")), "locator")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact groups drop."""
    rows = located(docs, "doc_id", "text")
    dropped = exact_groups(rows).filter("not kept").select("locator")
    return rows.join(dropped, "locator", "left_anti").select("whole.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = located(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with t as (
    select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents
), g as (
    select content, first(doc_id order by n desc, doc_id) as keep_id, count(*) as group_size from t group by content
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from t join g using (content)
"""
