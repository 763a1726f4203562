"""Scoring of cell-days: the model layer and the rule layer side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexrisk.functions.numbers import half_up
from hexrisk.functions.risk import RULE_INPUTS, cell_text, strategic_tier, tactical_columns
from hexrisk.operators.model import linear_score, predict
from hexrisk.operators.summaries import latest_per_cell
from hexrisk.sources.state import StateTable

# Panel columns that feed a rule input of another name; the first one present is used.
INPUT_SOURCES = {
    "event_velocity": ("dangerous_velocity", "event_velocity"),
    "neighbor_event_avg": ("neighbor_danger_avg", "neighbor_event_avg"),
    "strategic_score": ("strategic_score", "ml_score"),
}
RECORD = (
    "cell",
    "q",
    "r",
    "strategic_score",
    "strategic_tier",
    "tactical_score",
    "tactical_tier",
    "should_alert",
    "tactical_triggers",
)


def rule_inputs(columns: list[str], sources: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Rule inputs resolved against the columns a table has; what is absent takes its default."""
    sources = {**INPUT_SOURCES, **(sources or {})}
    out = {}
    for name, default in RULE_INPUTS.items():
        present = next((c for c in sources.get(name, (name,)) if c in columns), None)
        out[name] = F.col(present).cast("double") if present else F.lit(default)
    return out


def score_table(df: DataFrame, sources: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add the rule layer to any table with (some of) its inputs."""
    return df.withColumns(tactical_columns(rule_inputs(df.columns, sources)))


def with_model_score(df: DataFrame, model=None) -> DataFrame:
    """Add ``strategic_score``: the model's on its own features if given, else the fixed logistic score."""
    if model is None:
        return df.withColumn("strategic_score", linear_score())
    return predict(df, model)


def score_record(scored: DataFrame, stamp: Column) -> DataFrame:
    """Columns of the current-state table; text is written per run, so it starts empty."""
    shaped = scored.withColumn("strategic_score", half_up(F.col("strategic_score"), 4))
    return shaped.select(
        *[c for c in RECORD if c in shaped.columns],
        F.lit(None).cast("string").alias("alert_text"),
        stamp.alias("scored_at"),
    )


def score_rows(features: DataFrame, stamp: Column, model=None) -> DataFrame:
    """Both layers for every row; tiers are decided on the unrounded score."""
    scored = with_model_score(features, model).transform(score_table)
    return score_record(scored.withColumn("strategic_tier", strategic_tier(F.col("strategic_score"))), stamp)


def score_latest(features: DataFrame, stamp: Column | None = None, model=None) -> DataFrame:
    """Current state of every cell from the last known value of each feature."""
    columns = [c for c in features.columns if c not in ("cell", "event_date", "label")]
    latest = latest_per_cell(features, columns)
    return score_rows(latest, stamp if stamp is not None else F.to_timestamp("event_date"), model)


def with_alert_text(scores: DataFrame) -> DataFrame:
    """Texts for the cells at DANGER, from their signals; the others have none."""
    text = cell_text(F.col("strategic_tier"), F.col("tactical_triggers"), F.lit(None).cast("string"))
    return scores.withColumn("alert_text", F.when(F.col("tactical_tier") == "DANGER", text))


def run_scoring(features: DataFrame, table: StateTable, stamp: Column | None = None, model=None) -> DataFrame:
    """Score all cells, give those at DANGER their texts, and merge the result into the state; returns the state.

    A run that dies before its commit leaves the state as it was.
    """
    table.merge(with_alert_text(score_latest(features, stamp, model)))
    return table.read()


def slice_day(panel: DataFrame, day: str | Column) -> DataFrame:
    """One day of the panel; with a table partitioned by day only that folder is read."""
    return panel.filter(F.col("event_date") == (F.lit(day).cast("date") if isinstance(day, str) else day))


def backtest_days(features: DataFrame, start, end, model=None) -> DataFrame:
    """Scores of every cell for each day of a range, in one job."""
    days = features.filter(F.col("event_date").between(start, end))
    scored = with_model_score(days, model).transform(score_table)
    scored = scored.withColumn("strategic_tier", strategic_tier(F.col("strategic_score")))
    return scored.select(
        "cell",
        "q",
        "r",
        "event_date",
        half_up(F.col("strategic_score"), 4).alias("strategic_score"),
        "strategic_tier",
        "tactical_score",
        "tactical_tier",
        "should_alert",
        "tactical_triggers",
        F.col("event_date").cast("string").alias("scored_at"),
    )


def new_alerts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Cells at DANGER now that were not at DANGER before."""
    danger = F.col("tactical_tier") == "DANGER"
    return current.filter(danger).join(previous.filter(danger).select("cell"), "cell", "left_anti")
