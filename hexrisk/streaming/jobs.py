"""Continuous forms of the cell-day counts, the re-score and the alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hexrisk.functions.grid import cell_id, with_cell
from hexrisk.operators.model import LINEAR_COEFFICIENTS
from hexrisk.plans.scoring import new_alerts, score_rows, with_alert_text
from hexrisk.sources.state import StateTable
from hexrisk.sources.tables import upsert_scores

WATERMARK = "3 days"
RESCORE_INTERVAL = "15 minutes"
REFRESH_DAYS = 14


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS_DB) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which cell states need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def stream_cell_day(events: DataFrame, watermark: str = WATERMARK, ts: str = "ts") -> DataFrame:
    """Cell-day counts of a stream of flagged conflict events; rows up to three days late are counted."""
    binned = with_cell(events.withWatermark(ts, watermark))
    return (
        binned.groupBy(F.window(ts, "1 day"), "q", "r")
        .agg(
            F.count("event_type").alias("event_count"),
            F.sum("is_dangerous").alias("dangerous_count"),
            F.sum("fatalities").alias("total_fatalities"),
            F.max("fatalities").alias("max_fatalities"),
        )
        .select("q", "r", F.to_date("window.start").alias("event_date"), "event_count", "dangerous_count", "total_fatalities", "max_fatalities")
    )


def write_versions(counts: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write each batch's changed rows under its batch number; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .foreachBatch(write)
        .start()
    )


def read_versions(spark: SparkSession, path: str, keys: tuple[str, ...] = ("q", "r", "event_date")) -> DataFrame:
    """Newest version of every row written by :func:`write_versions`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def keep_versions(counts: DataFrame, table: StateTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the newest version of every cell-day in a state table (key ``cell_day``): old versions are dropped as batches come."""

    def write(batch: DataFrame, batch_id: int) -> None:
        key = F.concat_ws(" ", cell_id(F.col("q"), F.col("r")), F.col("event_date").cast("string"))
        table.merge(batch.withColumn("cell_day", key), batch_id)

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).foreachBatch(write).start()


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State left by the newest batch before ``batch_id``; null if there is none.

    The state of a batch is written as its own folder, so a batch that is repeated starts again from its predecessor.
    """
    try:
        past = spark.read.parquet(path).filter(F.col("batch") < batch_id)
    except AnalysisException:  # nothing written yet
        return None
    newest = past.agg(F.max("batch")).first()[0]
    return None if newest is None else spark.read.parquet(f"{path}/batch={newest}")


def stream_score(
    events: DataFrame,
    score_cells: Callable[[DataFrame], DataFrame],
    state_path: str,
    alert_path: str,
    checkpoint: str,
    interval: str | None = RESCORE_INTERVAL,
) -> StreamingQuery:
    """Re-score the cells each micro-batch touches, merge them into the state and write newly dangerous cells.

    ``score_cells`` gets the distinct touched cells (``q``, ``r``, ``event_date`` of the newest row) and returns state
    rows; it reads whatever history it needs.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = with_cell(batch).groupBy("q", "r").agg(F.max("event_date").alias("event_date"))
        updates = score_cells(touched)
        current = read_state(spark, state_path, batch_id)
        merged = updates if current is None else upsert_scores(current, updates)
        merged.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        written = spark.read.parquet(f"{state_path}/batch={batch_id}")
        alerts = written.filter("tactical_tier = 'DANGER'") if current is None else new_alerts(current, written)
        alerts.write.mode("overwrite").parquet(f"{alert_path}/batch={batch_id}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).foreachBatch(advance).start()
    )


def stream_state(
    feature_rows: DataFrame,
    table: StateTable,
    alert_path: str,
    checkpoint: str,
    model=None,
    interval: str | None = RESCORE_INTERVAL,
) -> StreamingQuery:
    """Score the feature rows of each micro-batch, merge them into the state and write newly dangerous cells.

    The batch number is the version of the state, so a repeated batch changes nothing; alerts compare a batch's cells with
    the version before it, and a repeated batch replaces its own.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        absent = {c: F.lit(0.0) for c in LINEAR_COEFFICIENTS if c not in batch.columns}
        rows = batch.withColumns({**absent, "cell": cell_id(F.col("q"), F.col("r"))})
        before = [v for v in table.versions() if v < batch_id]
        table.merge(with_alert_text(score_rows(rows, F.to_timestamp("event_date"), model)), batch_id)
        danger = table.read(batch_id).filter("tactical_tier = 'DANGER'")
        alerts = new_alerts(table.read(before[-1]), danger) if before else danger
        alerts.write.mode("overwrite").parquet(f"{alert_path}/batch={batch_id}")

    return feature_rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).foreachBatch(advance).start()


def touched_history(features: DataFrame, touched: DataFrame, days: int = REFRESH_DAYS) -> DataFrame:
    """Panel rows of the touched cells over the days their newest row can influence."""
    span = touched.select("q", "r", F.date_sub("event_date", days - 1).alias("_from"), F.col("event_date").alias("_to"))
    # The outer range prunes the folders of a table partitioned by day.
    first, last = span.select(F.min("_from")).scalar(), span.select(F.max("_to")).scalar()
    near = features.filter(F.col("event_date").between(first, last)).join(span, ["q", "r"])
    return near.filter(F.col("event_date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
