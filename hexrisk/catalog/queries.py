"""Named queries: one per operator and job, each ``(spark, root) -> DataFrame`` over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hexrisk.catalog import store
from hexrisk.catalog.store import rounded
from hexrisk.functions import risk
from hexrisk.functions.geo import filter_bbox
from hexrisk.functions.grid import cell_boundary, cell_center, cell_id, cell_neighbors, with_cell
from hexrisk.operators import aggregate, clean, clusters, evaluate, labels, model, panel, routes, spatial, summaries, weather
from hexrisk.plans import features as feature_plan
from hexrisk.plans import scoring, serving, studies
from hexrisk.session import scratch_path
from hexrisk.sources import derived, feeds, tables
from hexrisk.sources.state import StateTable
from hexrisk.streaming import cells, jobs
from hexrisk.streaming.jobs import state_store

QUERIES: dict = {}

# Training settings of the registered training queries; the library defaults are the full settings.
REPLAY = ("2024-01-05", "2024-01-25")
DAY = "2024-01-20"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _conflict(spark, root):
    return derived.conflict(spark, root)


def _rows(spark, root):
    return feature_plan.conflict_rows(_conflict(spark, root))


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", cell_id(F.col("q"), F.col("r"))).drop("q", "r")


def _daily(spark, root):
    return aggregate.agg_conflict_day(_rows(spark, root))


def _news_day(spark, root):
    return aggregate.agg_news_day(with_cell(derived.news(spark, root)))


def _thermal_day(spark, root):
    return aggregate.agg_thermal_day(with_cell(derived.thermal(spark, root)))


def _panel(spark, root):
    rows = _rows(spark, root)
    return panel.build_panel(aggregate.agg_conflict_day(rows), panel.date_bounds(rows))


def _grid(spark, root):
    return tables.build_cell_grid(store.features(spark, root))


def _center_text(lat, lng):
    return F.concat_ws(",", *[F.floor(x * 1e6 + 0.5).cast("string") for x in (lng, lat)])


# Sources and sinks ---------------------------------------------------------------------------------------------------


@query
def s1_read_conflict_events(spark, root):
    path = scratch_path(spark, "conflict-csv")
    day_first = F.date_format("event_date", "dd/MM/yyyy")
    damaged = F.when(F.col("event_id") % 50 == 0, F.lit("n/a"))
    _conflict(spark, root).select(
        F.when(F.col("event_id") % 97 != 0, day_first).alias("event_date"),
        F.col("lat").alias("latitude"),
        F.col("lng").alias("longitude"),
        "geo_precision",
        "event_type",
        "sub_event_type",
        "actor1",
        "actor2",
        F.coalesce(damaged, F.col("fatalities").cast("string")).alias("fatalities"),
        "population_best",
    ).write.csv(path, header=True)
    df = feeds.read_conflict_events(spark, path)
    return df.groupBy("event_date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("fatalities").alias("fatalities"),
        F.count("actor1").alias("known_actors"),
    )


@query
def s2_read_news_events(spark, root):
    path = scratch_path(spark, "news-tsv")
    at = {
        feeds.NEWS_POSITIONS["id"]: F.col("id").cast("string"),
        feeds.NEWS_POSITIONS["day"]: F.date_format("event_date", "yyyyMMdd"),
        feeds.NEWS_POSITIONS["goldstein"]: F.col("goldstein").cast("string"),
        feeds.NEWS_POSITIONS["articles"]: F.col("articles").cast("string"),
        feeds.NEWS_POSITIONS["tone"]: F.col("tone").cast("string"),
        feeds.NEWS_POSITIONS["lat"]: F.col("lat").cast("string"),
        feeds.NEWS_POSITIONS["lng"]: F.col("lng").cast("string"),
        feeds.NEWS_ROOT_CODE_POSITION: F.col("code").cast("string"),
    }
    line = F.concat_ws("\t", *[F.coalesce(at.get(i, F.lit("x")), F.lit("")) for i in range(feeds.NEWS_WIDTH)])
    derived.news(spark, root).select(line).write.text(path)
    df = feeds.read_news_events(spark, path)
    return df.groupBy("event_date").agg(
        F.count("id").alias("rows"), F.sum("articles").alias("articles"), F.sum("tone").alias("tone"), F.sum("code").alias("codes")
    )


@query
def s3_read_thermal(spark, root):
    path = scratch_path(spark, "thermal-csv")
    derived.thermal(spark, root).select(
        F.col("lat").alias("latitude"),
        F.col("lng").alias("longitude"),
        F.concat(F.date_format("event_date", "yyyy-MM-dd"), F.lit(" 10:30:00")).alias("acq_datetime"),
        F.col("frp").alias("FRP"),
    ).write.csv(path, header=True)
    df = feeds.read_thermal(spark, path)
    return rounded(df.groupBy("event_date").agg(F.count("frp").alias("rows"), F.max("frp").alias("max_frp")))


@query
def s4_read_weather_daily(spark, root):
    path = scratch_path(spark, "weather-json")
    days = F.array_sort(F.collect_list(F.struct("event_date", "temp_max", "temp_mean", "precip_mm")))
    docs = derived.weather(spark, root).groupBy("grid_lat", "grid_lon").agg(days.alias("d"))
    docs.select(
        "grid_lat",
        "grid_lon",
        F.struct(
            F.transform("d", lambda x: x["event_date"].cast("string")).alias("time"),
            F.col("d.temp_max").alias("temperature_2m_max"),
            F.col("d.temp_mean").alias("temperature_2m_mean"),
            F.col("d.precip_mm").alias("precipitation_sum"),
        ).alias("daily"),
    ).write.json(path)
    return rounded(feeds.read_weather_daily(spark, path))


@query
def s5_read_facilities(spark, root):
    path = scratch_path(spark, "facilities-json")
    # Documents in the shape of the facility file, up to 500 facilities each.
    listed = F.collect_list(F.struct("name", "type", "lat", "lng", "capacity", "notes")).alias("shelters")
    grouped = derived.facilities(spark, root).groupBy(F.expr("facility_id div 500")).agg(listed)
    grouped.select("shelters").write.json(path)
    return rounded(feeds.read_facilities(spark, path, multiline=False))


@query
def s6_read_feature_table(spark, root):
    df = store.features(spark, root)
    return rounded(
        df.select("cell", "event_date", "event_count", "gdelt_hostility", "firms_spike", "temp_max", "dangerous_roll14d")
    )


@query
def s7_write_feature_table(spark, root):
    path = scratch_path(spark, "panel")
    tables.write_feature_table(_panel(spark, root), path)
    return tables.read_feature_table(spark, path).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_count").alias("event_count")
    )


def _update_rows(spark, root):
    """Later scores of the cells that were dangerous on a later day."""
    later = store.history(spark, root).filter("event_date > '2024-01-20' and strategic_tier in ('red', 'orange')")
    return later.select("cell", "strategic_score", "strategic_tier", "tactical_score", "scored_at")


@query
def s8_upsert_scores(spark, root):
    # The state before the updates; together both read the scores of all days up to now that count.
    state = store.history(spark, root).filter(F.col("event_date") == F.lit(DAY).cast("date"))
    current = state.select("cell", "strategic_score", "strategic_tier", "tactical_score", "scored_at")
    return tables.upsert_scores(current, _update_rows(spark, root))


@query
def s9_patch_column(spark, root):
    days = store.history(spark, root).withColumn("cell", F.concat_ws("@", "cell", "event_date"))
    texts = days.filter("tactical_tier = 'DANGER'")
    patch = texts.select("cell", F.concat(F.lit("see "), F.col("tactical_triggers")).alias("alert_text"))
    return tables.patch_column(days.select("cell", "tactical_tier", F.lit(None).cast("string").alias("alert_text")), patch, "cell", "alert_text")


@query
def s10_build_cell_grid(spark, root):
    return _grid(spark, root)


@query
def s11_to_geojson_features(spark, root):
    cells = store.current_scores(spark, root).select("cell", "q", "r", "strategic_tier")
    return tables.to_geojson_features(cells, "cell")


def _parsed(features, properties):
    """What a reader of GeoJSON gets."""
    schema = f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    return features.select(F.from_json("value", schema).alias("f")).select("f.properties.*", "f.type", F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("c"))


@query
def s11_geojson_cells(spark, root):
    """The cell layer read back: outlines in the format's order of coordinates."""
    parsed = _parsed(s11_to_geojson_features(spark, root), "cell:string,strategic_tier:string")
    ring = F.from_json("c", "array<array<array<double>>>")[0]
    text = F.array_join(F.transform(ring, lambda p: _center_text(p[1], p[0])), ";")
    return parsed.select("cell", "type", "shape", "strategic_tier", F.size(ring).alias("corners"), text.alias("ring"))


@query
def s11_geojson_points(spark, root):
    """The layer of places read back."""
    places = spatial.place_table(spatial.cities(spark), derived.facilities(spark, root)).select("name", "lat", "lng", "kind")
    parsed = _parsed(tables.to_geojson_features(places, "point"), "name:string,kind:string")
    pair = F.from_json("c", "array<double>")
    return rounded(parsed.select("name", "type", "shape", "kind", pair[0].alias("lng"), pair[1].alias("lat")))


@query
def s11_facility_layer(spark, root):
    df = derived.facilities(spark, root)
    styled = df.withColumns(tables.facility_style(F.col("type")))
    return styled.select("name", "type", "emoji", "color")


@query
def s12_write_metrics(spark, root):
    path = scratch_path(spark, "metrics")
    sweep = evaluate.threshold_sweep(store.labelled_scores(spark, root))
    tables.write_metrics(evaluate.best_point(sweep), path)
    return rounded(spark.read.json(path).select("threshold", "alerts", "precision", "recall", "f1"))


@query
def s13_read_scores(spark, root):
    path = scratch_path(spark, "scores")
    store.scores(spark, root).select("cell", "strategic_score", F.lit("stale").alias("strategic_tier")).write.parquet(path)
    return tables.read_scores(spark, path)


# Projections and filters ---------------------------------------------------------------------------------------------


@query
def p1_filter_precision(spark, root):
    return clean.filter_precision(_conflict(spark, root)).select("event_id", "geo_precision", "event_type", "fatalities")


@query
def p2_filter_bbox(spark, root):
    box = {"lat": (33.2, 34.1), "lng": (35.45, 36.5)}
    return rounded(filter_bbox(derived.origins(spark, root), box=box))


@query
def p3_flag_dangerous(spark, root):
    return clean.flag_dangerous(_conflict(spark, root)).select("event_id", "event_type", "sub_event_type", "is_dangerous")


@query
def p4_flag_types(spark, root):
    return clean.flag_types(_conflict(spark, root)).select("event_id", *clean.TYPE_FLAGS)


@query
def p5_actor_pair(spark, root):
    return clean.actor_pair(_conflict(spark, root)).select("event_id", "actor_pair")


@query
def p6_hex_cell(spark, root):
    return with_cell(derived.origins(spark, root)).select("origin_id", cell_id(F.col("q"), F.col("r")).alias("cell"), "q", "r")


@query
def p7_cell_center(spark, root):
    cells = with_cell(derived.origins(spark, root)).select("q", "r").distinct()
    lat, lng = cell_center(F.col("q"), F.col("r"))
    return rounded(cells.select(cell_id(F.col("q"), F.col("r")).alias("cell"), lat.alias("lat"), lng.alias("lng")))


@query
def p8_cell_boundary(spark, root):
    cells = with_cell(derived.origins(spark, root)).select("q", "r").distinct()
    ring = F.transform(cell_boundary(F.col("q"), F.col("r")), lambda p: _center_text(p[1], p[0]))
    return cells.select(cell_id(F.col("q"), F.col("r")).alias("cell"), F.array_join(ring, ";").alias("ring"))


@query
def p9_cell_neighbors(spark, root):
    cells = with_cell(derived.origins(spark, root)).select("q", "r").distinct()
    pairs = cells.select(cell_id(F.col("q"), F.col("r")).alias("cell"), F.explode(cell_neighbors(F.col("q"), F.col("r"))).alias("n"))
    return pairs.select("cell", cell_id(F.col("n.q"), F.col("n.r")).alias("neighbor"))


@query
def p10_hostility(spark, root):
    return rounded(derived.news(spark, root).select("id", "tone", risk.hostility(F.col("tone")).alias("hostility")))


@query
def p11_thermal_spike(spark, root):
    counts = with_cell(derived.thermal(spark, root)).groupBy("q", "r", "event_date").agg(F.count("frp").alias("hotspots"))
    return _with_id(counts.withColumn("spike", risk.thermal_spike(F.col("hotspots"))))


@query
def p12_strategic_tier(spark, root):
    return store.tiered(store.labelled_scores(spark, root)).select("cell", "event_date", "strategic_score", "strategic_tier")


@query
def p13_tactical_score(spark, root):
    return store.history(spark, root).select("cell", "event_date", "tactical_score")


@query
def p14_tactical_level(spark, root):
    return store.history(spark, root).select("cell", "event_date", "tactical_tier", "should_alert")


@query
def p15_tactical_triggers(spark, root):
    return store.history(spark, root).select("cell", "event_date", "tactical_triggers")


@query
def p16_model_band(spark, root):
    df = store.labelled_scores(spark, root)
    return df.groupBy(risk.model_band(F.col("strategic_score")).alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query
def p17_score_table(spark, root):
    """Cell-days with only some rule inputs, under other names."""
    df = store.labelled_scores(spark, root).select(
        "cell",
        "event_date",
        F.col("strategic_score").alias("ml_score"),
        F.col("neighbor_danger_avg").alias("neighbor_event_avg"),
        "gdelt_hostility",
        "gdelt_avg_tone",
    )
    scored = scoring.score_table(df)
    return scored.select("cell", "event_date", "tactical_score", "tactical_tier", "should_alert", "tactical_triggers")


@query
def p18_align_features(spark, root):
    df = store.labelled(spark, root)
    wanted = ["event_count", "not_in_table", "gdelt_hostility"]
    return rounded(model.align_features(df, wanted, ["cell", "event_date"]))


@query
def p19_filter_active(spark, root):
    return labels.filter_active(store.labelled(spark, root)).select("cell", "event_date", "label")


@query
def p20_split_triggers(spark, root):
    texts = risk.split_triggers(F.col("tactical_triggers"))
    df = store.history(spark, root).select(F.explode(texts).alias("trigger"))
    return df.groupBy("trigger").agg(F.count(F.lit(1)).alias("times"))


@query
def p21_tier_description(spark, root):
    df = store.history(spark, root).groupBy("strategic_tier").agg(F.count(F.lit(1)).alias("rows"))
    return df.withColumn("description", risk.tier_description(F.upper("strategic_tier")))


@query
def p22_cell_text(spark, root):
    text = risk.cell_text(F.col("strategic_tier"), F.col("tactical_triggers"), F.lit(None).cast("string"))
    return store.history(spark, root).select("cell", "event_date", text.alias("narrative"))


@query
def p23_slice_day(spark, root):
    df = scoring.slice_day(store.features(spark, root), DAY)
    return df.select("cell", "event_date", "event_count", "dangerous_count")


@query
def p24_heat_style(spark, root):
    score = F.col("strategic_score")
    styled = store.history(spark, root).select(
        "cell", "event_date", risk.heat_opacity(score).alias("opacity"), risk.heat_color(score).alias("color")
    )
    return rounded(styled)


@query
def p25_score_record(spark, root):
    df = store.scores(spark, root)
    return df.select("cell", "strategic_score", "strategic_tier", "tactical_score", "alert_text", F.to_date("scored_at").alias("scored_on"))


# Aggregations --------------------------------------------------------------------------------------------------------


@query
def a1_agg_conflict_day(spark, root):
    return _with_id(_daily(spark, root))


@query
def a2_agg_news_day(spark, root):
    news = with_cell(derived.news(spark, root).drop("code"))
    return rounded(_with_id(aggregate.agg_news_day(news)))


@query
def a3_agg_thermal_day(spark, root):
    return rounded(_with_id(_thermal_day(spark, root)))


@query
def a4_agg_news_class_day(spark, root):
    return _with_id(aggregate.agg_news_class_day(with_cell(derived.news(spark, root))))


@query
def a5_label_balance(spark, root):
    return rounded(summaries.share(store.labelled(spark, root), F.col("label") == 1, ["event_date"]))


@query
def a5_news_coverage(spark, root):
    return rounded(summaries.share(store.features(spark, root), F.col("gdelt_event_count") > 0))


@query
def a6_profile(spark, root):
    return summaries.profile(store.features(spark, root))


@query
def a7_date_range(spark, root):
    return summaries.date_range(_conflict(spark, root))


@query
def a8_class_weight(spark, root):
    return rounded(evaluate.class_weight(labels.filter_active(store.labelled(spark, root))))


@query
def a9_tier_counts(spark, root):
    return summaries.tier_counts(store.scores(spark, root))


def _area_rows(df):
    return df.withColumn("top_triggers", F.array_join("top_triggers", " | "))


@query
def a10_area_summary(spark, root):
    areas = derived.origins(spark, root)
    summary = serving.area_summary(areas, _grid(spark, root), store.scores(spark, root))
    return rounded(_area_rows(summary).withColumn("latest_scored_at", F.to_date("latest_scored_at")))


@query
def a11_top_triggers(spark, root):
    return serving.top_triggers(store.history(spark, root), ["event_date"])


def _day_clusters(spark, root):
    return clusters.tier_clusters(store.current_scores(spark, root))


@query
def a12_cluster_summary(spark, root):
    df = clusters.cluster_summary(_day_clusters(spark, root))
    return rounded(df.withColumn("triggers", F.array_join("triggers", ";")))


@query
def a13_cluster_center(spark, root):
    return rounded(clusters.cluster_center(_day_clusters(spark, root)))


@query
def a14_monthly_p90(spark, root):
    return rounded(weather.monthly_p90(derived.weather(spark, root)))


@query
def a15_threshold_sweep(spark, root):
    return rounded(evaluate.threshold_sweep(store.labelled_scores(spark, root)))


@query
def a16_roc_auc(spark, root):
    return rounded(evaluate.roc_auc(store.labelled_scores(spark, root), ["event_date"]))


@query
def a17_average_precision(spark, root):
    return rounded(evaluate.average_precision(store.labelled_scores(spark, root), ["event_date"]))


@query
def a18_best_point(spark, root):
    sweep = evaluate.threshold_sweep(store.labelled_scores(spark, root), evaluate.FINE_THRESHOLDS, ["event_date"])
    return rounded(evaluate.best_point(sweep, ["event_date"]))


@query
def a18_pick_winner(spark, root):
    df = labels.filter_active(store.labelled_scores(spark, root))
    other = df.withColumn("strategic_score", F.least(F.col("dangerous_roll7d"), F.lit(1.0)))
    cols = ["event_date", "label", "strategic_score"]
    both = df.select(*cols, F.lit("standard").alias("model")).unionByName(other.select(*cols, F.lit("focal").alias("model")))
    points = evaluate.best_point(evaluate.threshold_sweep(both, by=["model"]), ["model"])
    return rounded(evaluate.pick_winner(points).select("model", "threshold", "f1"))


@query
def a19_active_summary(spark, root):
    return rounded(evaluate.active_summary(store.labelled(spark, root)))


@query
def a20_cv_summary(spark, root):
    blocks = labels.time_series_folds(labels.filter_active(store.labelled_scores(spark, root))).filter("block > 0")
    return rounded(evaluate.cv_summary(evaluate.ranking_metrics(blocks, ["block"])))


@query
def a21_alerts_per_day(spark, root):
    sweep = evaluate.threshold_sweep(store.labelled_scores(spark, root), evaluate.COARSE_THRESHOLDS)
    return rounded(sweep.select("threshold", "alerts", "alerts_per_day"))


@query
def a22_feature_importance(spark, root):
    """All features, their shares summing to 1, with those that tell of recent danger above the mean share."""
    report = model.feature_importance(spark, store.model(spark, root, "standard"))
    together = report.agg(F.abs(F.sum("importance") - 1.0) < 1e-9).scalar()
    past = F.col("feature").rlike("roll|lag|neighbor|velocity|delta|event_count")
    telling = report.agg(F.sum(F.when(past, F.col("importance"))) > F.count_if(past) / F.count(F.lit(1))).scalar()
    return report.select("feature", F.col("importance").between(0.0, 1.0).alias("in_range"), together.alias("sums_to_one"), telling.alias("past_tells"))


@query
def a23_tier_timeline(spark, root):
    return summaries.tier_timeline(store.history(spark, root))


# Windows -------------------------------------------------------------------------------------------------------------


@query
def w1_rolling_means(spark, root):
    df = panel.rolling_means(_panel(spark, root))
    rolls = [f"{n}_roll{d}d" for d in panel.ROLL_DAYS for n in panel.ROLL_SOURCES]
    return rounded(_with_id(df.select("q", "r", "event_date", *rolls)))


@query
def w2_deltas(spark, root):
    df = panel.deltas(_panel(spark, root))
    return _with_id(df.select("q", "r", "event_date", "dangerous_delta", "fatality_delta", "actor_pair_delta"))


@query
def w3_velocity(spark, root):
    df = panel.velocity(_panel(spark, root).transform(panel.rolling_means).transform(panel.actor_roll))
    return rounded(
        _with_id(df.select("q", "r", "event_date", "dangerous_velocity", "fatality_velocity", "actor_pair_velocity"))
    )


@query
def w4_actor_roll(spark, root):
    return rounded(_with_id(panel.actor_roll(_panel(spark, root)).select("q", "r", "event_date", "actor_pair_roll14d")))


@query
def w5_fill_static(spark, root):
    return _with_id(panel.fill_static(_panel(spark, root)).select("q", "r", "event_date", "population_best"))


@query
def w6_label_lookahead(spark, root):
    return _with_id(panel.label_lookahead(_panel(spark, root)).select("q", "r", "event_date", "label"))


@query
def w7_drop_tail(spark, root):
    return _with_id(panel.drop_tail(_panel(spark, root)).select("q", "r", "event_date", "event_count"))


@query
def w8_temporal_lags(spark, root):
    return _with_id(panel.temporal_lags(_panel(spark, root)).select("q", "r", "event_date", *panel.LAGS))


@query
def w9_temp_anomaly(spark, root):
    df = weather.temp_anomaly(derived.weather(spark, root))
    return rounded(df.select("grid_lat", "grid_lon", "event_date", "temp_anomaly_30d"))


def _with_gaps(df):
    """Feature rows with nulls where nothing was reported."""
    return df.select(
        "cell",
        "event_date",
        F.when(F.col("event_count") > 0, F.col("event_count")).alias("event_count"),
        F.when(F.col("gdelt_event_count") > 0, F.col("gdelt_hostility")).alias("gdelt_hostility"),
        F.when(F.col("firms_hotspot_count") > 0, F.col("firms_max_frp")).alias("firms_max_frp"),
    )


@query
def w10_latest_per_cell(spark, root):
    df = _with_gaps(store.features(spark, root))
    return rounded(summaries.latest_per_cell(df, ["event_count", "gdelt_hostility", "firms_max_frp"]))


@query
def w11_latest_k(spark, root):
    rows = _with_id(_rows(spark, root))
    top = summaries.latest_k(rows, "cell", [F.desc("event_date"), F.desc("event_id")], 4)
    return top.select("cell", "rank", "event_id", "event_date", "event_type", "fatalities", "actor1")


@query
def w12_running_best(spark, root):
    sweep = evaluate.threshold_sweep(store.labelled_scores(spark, root), evaluate.FINE_THRESHOLDS)
    return rounded(evaluate.running_best(sweep).select("threshold", "f1", "best_so_far"))


# Joins ---------------------------------------------------------------------------------------------------------------


@query
def j1_build_panel(spark, root):
    return _with_id(_panel(spark, root))


def _merged(spark, root, feeds, neighbors, own=None):
    """Panel of the conflict counts with other feeds merged in before the days are filled."""
    daily = _daily(spark, root)
    bounds, cells = panel.date_bounds(daily), panel.distinct_cells(daily)
    weather_rows = None if own is None else weather.weather_feed(cells, own)
    sparse = panel.merge_cell_days([daily, *feeds], cells, neighbors, weather_rows).filter(F.col("event_date").between(*bounds))
    return panel.fill_days(sparse, bounds)


@query
def j2_attach_features(spark, root):
    cols = ["gdelt_event_count", "gdelt_avg_tone", "gdelt_min_goldstein", "gdelt_num_articles", "gdelt_hostility"]
    df = _merged(spark, root, [_news_day(spark, root).select("q", "r", "event_date", *cols)], {})
    return rounded(_with_id(df.select("q", "r", "event_date", "event_count", *cols)))


@query
def j3_spatial_lag(spark, root):
    news = _news_day(spark, root).select("q", "r", "event_date", "gdelt_hostility", "gdelt_protest_count")
    thermal = _thermal_day(spark, root).select("q", "r", "event_date", "firms_spike")
    df = _merged(spark, root, [news, thermal], panel.NEIGHBOR_FEATURES)
    whole = Window.partitionBy("q", "r")
    df = panel.finish_neighbors(df.withColumn("_n", F.max("_n").over(whole)), panel.NEIGHBOR_FEATURES)
    return rounded(_with_id(df.select("q", "r", "event_date", *panel.NEIGHBOR_FEATURES)))


@query
def j4_nearest_grid(spark, root):
    cells = panel.distinct_cells(with_cell(derived.origins(spark, root)))
    return rounded(_with_id(weather.nearest_grid(cells)))


@query
def j5_radius_join(spark, root):
    points = derived.facilities(spark, root).select("name", "lat", "lng")
    pairs = spatial.within_radius(points, _grid(spark, root).select("cell", "lat", "lng"), 25.0)
    return rounded(pairs.select("name", "cell", "distance_km"))


@query
def j6_enrich_scores(spark, root):
    grid = with_cell(derived.facilities(spark, root)).withColumn("cell", cell_id(F.col("q"), F.col("r")))
    scores = store.scores(spark, root).select("cell", "strategic_score", "strategic_tier", "tactical_tier")
    return tables.enrich_scores(grid.select("name", "cell"), scores)


@query
def j7_evac_candidates(spark, root):
    places = spatial.place_table(spatial.cities(spark), derived.facilities(spark, root))
    df = spatial.evac_candidates(derived.origins(spark, root), places, store.current_scores(spark, root))
    return rounded(df.select("lat", "lng", "rank", "name", "distance_km"))


@query
def j8_route_exposure(spark, root):
    return routes.route_exposure(_routes(spark, root), store.current_scores(spark, root))


def _routes(spark, root):
    """A straight way from every origin to its nearest candidate, as a user would supply roads."""
    places = spatial.place_table(spatial.cities(spark), derived.facilities(spark, root))
    ways = spatial.evac_candidates(derived.origins(spark, root), places, store.current_scores(spark, root), k=1)
    points = routes.straight_route(ways.select("lat", "lng", "to_lat", "to_lng"), n=250)
    route = F.concat_ws(",", *[F.floor(F.col(c) * 100 + 0.5).cast("string") for c in ("lat", "lng")])
    return points.select(route.alias("route_id"), "seq", F.col("point_lat").alias("lat"), F.col("point_lng").alias("lng"))


@query
def j9_nearest_facility(spark, root):
    facilities = derived.facilities(spark, root).select("name", "type", "lat", "lng")
    df = spatial.nearest_facility(derived.origins(spark, root), facilities, store.current_scores(spark, root))
    return rounded(df.select("lat", "lng", "name", "type", "distance_km"))


@query
def j10_tier_clusters(spark, root):
    return _day_clusters(spark, root).select("cell", "strategic_tier", "cluster_id")


@query
def j11_seed_cluster(spark, root):
    scores = store.current_scores(spark, root)
    return clusters.seed_cluster(scores.select("cell"), scores).select("seed", "cell", "hop", "rank")


@query
def j12_missing_days(spark, root):
    loaded = _conflict(spark, root)
    start, end = panel.date_bounds(loaded)
    return summaries.missing_days(loaded, F.date_sub(start, 5), F.date_add(end, 3))


@query
def j13_cell_detail(spark, root):
    return _detail(spark, root).select(
        "cell", "strategic_tier", "news_date", "news_gdelt_event_count", "thermal_date", "thermal_firms_spike", "recent"
    )


def _detail(spark, root):
    scores = store.scores(spark, root).select("cell", "q", "r", "strategic_score", "strategic_tier", "tactical_score")
    df = serving.cell_detail(scores, _news_day(spark, root), _thermal_day(spark, root), _rows(spark, root))
    text = F.transform(
        "recent_events", lambda e: F.concat_ws(":", e["event_date"].cast("string"), e["event_type"], e["fatalities"].cast("string"))
    )
    return df.withColumn("recent", F.array_join(text, ";"))


@query
def j14_attach_weather(spark, root):
    df = _merged(spark, root, [], {}, weather.weather_features(derived.weather(spark, root)))
    return rounded(_with_id(df.select("q", "r", "event_date", "event_count", *weather.WEATHER_FEATURES)))


@query
def j15_annotate_timeline(spark, root):
    history = store.history(spark, root)
    timeline = summaries.tier_timeline(history).select("event_date", "red", "orange")
    return rounded(summaries.annotate_timeline(timeline, derived.key_events(spark)))


# Sorts, top-k and set operations -------------------------------------------------------------------------------------


@query
def k2_nearest_first(spark, root):
    points = derived.facilities(spark, root).select("name", "lat", "lng")
    found = serving.cells_near(points, _grid(spark, root), store.scores(spark, root), 10.0)
    return rounded(found.orderBy("name", "distance_m").select("name", "cell", "distance_m", "strategic_tier"), 3)


@query
def k3_top5_candidates(spark, root):
    places = spatial.place_table(spatial.cities(spark), derived.facilities(spark, root))
    df = spatial.evac_candidates(derived.origins(spark, root), places, store.current_scores(spark, root))
    listed = F.array_sort(F.collect_list(F.struct("rank", "name")))
    joined = df.groupBy("lat", "lng").agg(F.transform(listed, lambda x: x["name"]).alias("names"))
    return rounded(joined.select("lat", "lng", F.array_join("names", ";").alias("names")))


def _candidate_ways(spark, root):
    places = spatial.place_table(spatial.cities(spark), derived.facilities(spark, root))
    df = spatial.evac_candidates(derived.origins(spark, root), places, store.current_scores(spark, root))
    return df.withColumn("variant", F.lit(0))


@query
def k4_best_route(spark, root):
    danger = routes.danger_cells(store.current_scores(spark, root))
    exposed = serving.exposed_ways(_candidate_ways(spark, root), danger, ["lat", "lng", "rank", "variant"])
    best = routes.best_route(exposed, ["lat", "lng"])
    return rounded(best.select("lat", "lng", "rank", "name", "danger_cells", "total_cells"))


@query
def k5_detour_choice(spark, root):
    plan = serving.evac_plan(derived.origins(spark, root), derived.facilities(spark, root), store.current_scores(spark, root))
    return rounded(plan.select("origin_id", "variant", "danger_cells", "distance_km"))


@query
def k6_time_position(spark, root):
    return labels.with_time_position(store.labelled(spark, root)).select("cell", "event_date", "position", "n_rows")


@query
def u1_union_feeds(spark, root):
    parts = [
        _with_id(_daily(spark, root)).select("cell", "event_date", "event_count", F.lit("conflict").alias("feed")),
        _with_id(_news_day(spark, root)).select("cell", "event_date", "gdelt_event_count", F.lit("news").alias("feed")),
        _with_id(_thermal_day(spark, root)).select("cell", "event_date", "firms_hotspot_count", F.lit("thermal").alias("feed")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query
def u2_place_table(spark, root):
    return rounded(spatial.place_table(spatial.cities(spark), derived.facilities(spark, root)))


@query
def u3_distinct_cells(spark, root):
    return _with_id(panel.distinct_cells(_rows(spark, root)))


@query
def u4_known_neighbors(spark, root):
    df = panel.cell_adjacency(panel.distinct_cells(_rows(spark, root)))
    return _with_id(df.select("q", "r", F.size("neighbors").cast("bigint").alias("neighbors")))


# Scalar functions ----------------------------------------------------------------------------------------------------


@query
def f1_haversine(spark, root):
    from hexrisk.functions.geo import haversine_km

    d = haversine_km(F.col("lat"), F.col("lng"), F.lit(33.8938), F.lit(35.5018))
    return rounded(derived.origins(spark, root).select("origin_id", d.alias("km")), 4)


@query
def f2_coercion(spark, root):
    from hexrisk.functions.numbers import day_first_date, number_or_null

    k = F.col("event_id")
    messy = F.when(k % 5 == 0, F.concat(F.col("value").cast("string"), F.lit(" MW"))).otherwise(F.col("value").cast("string"))
    day = F.when(k % 7 == 0, F.lit("unknown")).when(k % 2 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(
        F.date_format("ts", "yyyy-MM-dd")
    )
    df = derived.table(spark, root, "events").select("event_id", number_or_null(messy).alias("number"), day_first_date(day).alias("day"))
    return rounded(df)


# Models --------------------------------------------------------------------------------------------------------------


@query
def m1_feature_groups(spark, root):
    """Filled share of every feature of the table."""
    df = store.labelled(spark, root)
    names = model.feature_names(df.columns)
    shares = df.agg(*[F.avg((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0).cast("double")).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled")) for c in names]))
    return rounded(shares.select(pairs.alias("p")).select("p.*"))


@query
def m2_time_series_folds(spark, root):
    blocks = labels.time_series_folds(labels.filter_active(store.labelled(spark, root)))
    return blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
    )


@query
def m3_time_holdout(spark, root):
    df = labels.time_holdout(store.labelled(spark, root))
    return df.select("cell", "event_date", "part")


#: AUC that a model must exceed that has learnt anything; scores without skill have one of 0.5.
SKILLED_AUC = 0.6


def _skill(df):
    """Whether scores of labelled rows show skill: a row."""
    found = evaluate.ranking_metrics(df)
    base = F.col("positives") / F.col("rows")
    return found.select((F.col("roc_auc") > SKILLED_AUC).alias("skilled"), (F.col("average_precision") > base).alias("above_base_rate"))


def _checked(spark, root, kind):
    """Counts of the test rows, and whether the model has learnt its training rows (the labels of these tables are chance)."""
    fitted = store.model(spark, root, kind)
    train, test, _ = store.training_parts(spark, root)
    scored = model.predict(test, fitted).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives"), F.bool_and(F.col("strategic_score").between(0.0, 1.0)).alias("in_range")
    )
    skill = _skill(model.predict(train, fitted))
    return scored.select("*", *[skill.select(c).scalar().alias(c) for c in skill.columns], F.lit(model.n_trees(fitted) >= 1).alias("has_trees"))


@query
def m4_planted_label(spark, root):
    """Labels that follow from features with noise: a model trained on the first nine tenths tells the last tenth."""
    train, test, names = store.training_parts(spark, root)
    noise = F.pmod(F.xxhash64("q", "r", "event_date"), F.lit(1000)) / 1000.0
    planted = (F.col("event_roll7d") + F.col("neighbor_danger_avg") + noise > 1.4).cast("int")
    rows = train.withColumn("label", planted)
    fitted = model.train_gbt(rows, names, maxIter=60)
    return _skill(model.predict(test.withColumn("label", planted), fitted))


@query
def m4_train_gbt(spark, root):
    return _checked(spark, root, "standard")


@query
def m5_focal_weight(spark, root):
    df = store.labelled_scores(spark, root)
    w = model.focal_weight(F.col("strategic_score"), F.col("label"))
    return rounded(df.select("cell", "event_date", w.alias("weight")))


@query
def m6_train_focal(spark, root):
    """All 400 rounds on the focal loss."""
    return _checked(spark, root, "focal").withColumn("trees", F.lit(model.n_trees(store.model(spark, root, "focal"))).cast("bigint"))


@query
def m7_predict(spark, root):
    # A table without the weather group is scored too; the model counts what is absent as 0.
    test = store.training_parts(spark, root)[1].drop(*model.WEATHER_FEATURES)
    scored = store.tiered(model.predict(test, store.model(spark, root, "standard")))
    score, tier = F.col("strategic_score"), F.col("strategic_tier")
    banded = F.when(score >= 0.70, "red").when(score >= 0.63, "orange").when(score >= 0.54, "yellow").otherwise("green")
    return scored.select("cell", "event_date", score.between(0.0, 1.0).alias("in_range"), (tier == banded).alias("tier_fits"))


@query
def m8_linear_score(spark, root):
    return store.labelled_scores(spark, root).select("cell", "event_date", "strategic_score")


@query
def m9_save_load(spark, root):
    path, fitted = scratch_path(spark, "model"), store.model(spark, root, "standard")
    test = store.training_parts(spark, root)[1]
    model.save_model(fitted, path)
    again = model.predict(model.predict(test, fitted, col="first"), model.load_model(path))
    return again.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("first") != F.col("strategic_score")).alias("differing"))


# Streams -------------------------------------------------------------------------------------------------------------


def _event_stream(spark, root):
    """Conflict events as a stream with their time."""
    path = scratch_path(spark, "event-stream")
    source = clean.clean_conflict(_conflict(spark, root)).withColumn("ts", F.col("event_date").cast("timestamp"))
    source.write.parquet(path)
    return spark.readStream.schema(source.schema).parquet(path)


@query
def t1_stream_cell_day(spark, root):
    out, checkpoint = scratch_path(spark, "cell-day"), scratch_path(spark, "cell-day-state")
    jobs.write_versions(jobs.stream_cell_day(_event_stream(spark, root)), out, checkpoint).awaitTermination()
    return _with_id(jobs.read_versions(spark, out))


@query
def t1_stream_versions(spark, root):
    """Counts over several batches, days out of order and none too late, kept in a table of bounded size."""
    events, _ = _event_batches(spark, root, 3)
    stream = jobs.stream_cell_day(events.withColumn("ts", F.col("event_date").cast("timestamp")), watermark="400 days")
    table = StateTable(spark, scratch_path(spark, "cell-days"), "cell_day", "event_date", 8)
    jobs.keep_versions(stream, table, scratch_path(spark, "cell-days-state")).awaitTermination()
    return _with_id(table.read().drop("cell_day"))


@query
def t2_stream_score(spark, root):
    state, alerts, checkpoint = (scratch_path(spark, n) for n in ("state", "alerts", "score-state"))
    table = store.features(spark, root)

    def rescore(touched):
        return scoring.score_latest(jobs.touched_history(table, touched))

    jobs.stream_score(_event_stream(spark, root), rescore, state, alerts, checkpoint, interval=None).awaitTermination()
    newest = spark.read.parquet(state)
    newest = newest.filter(F.col("batch") == newest.select(F.max("batch")).scalar())
    return newest.select("cell", "strategic_score", "strategic_tier", "tactical_score", "tactical_tier")


def _event_batches(spark, root, files=4):
    """Conflict events as a stream of several batches, out of order within and between them."""
    path = scratch_path(spark, "event-files")
    source = clean.clean_conflict(_conflict(spark, root))
    source.repartition(files, F.xxhash64(F.pmod(F.xxhash64(*source.columns), F.lit(files)))).write.parquet(path)
    first = source.agg(F.min("event_date").cast("string")).first()[0]
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path), first


def _feature_stream(spark, root):
    events, first = _event_batches(spark, root)
    return cells.stream_features(events, first)


@query
def t2_stream_features(spark, root):
    """Features kept by cell states over several batches; the last row of each cell equals the batch job's of that day."""
    out, checkpoint = (scratch_path(spark, n) for n in ("feature-rows", "feature-state"))
    with state_store(spark):
        jobs.write_versions(_feature_stream(spark, root), out, checkpoint).awaitTermination()
    rows = jobs.read_versions(spark, out, ("q", "r"))
    return rounded(_with_id(rows.select("q", "r", "event_date", *cells.FEATURES)))


@query
def t2_stream_state(spark, root):
    """State that a stream keeps by commits: scores of each cell's newest row."""
    path, alerts, checkpoint = (scratch_path(spark, n) for n in ("state", "alerts", "score-state"))
    table = StateTable(spark, path, buckets=8)
    with state_store(spark):
        jobs.stream_state(_feature_stream(spark, root), table, alerts, checkpoint, interval=None).awaitTermination()
    return table.read().select("cell", "strategic_score", "strategic_tier", "tactical_score", "tactical_tier", "alert_text", F.to_date("scored_at").alias("day"))


@query
def t3_new_alerts(spark, root):
    """Cells at DANGER in the second half of the month that were not so in the first."""
    history = store.history(spark, root)
    first, second = history.filter("event_date <= '2024-01-15'"), history.filter("event_date > '2024-01-15'")
    return scoring.new_alerts(first, second).select("cell", "event_date", "tactical_score")


@query
def t4_replace_days(spark, root):
    path = scratch_path(spark, "days")
    base = _panel(spark, root).select("q", "r", "event_date", "event_count")
    tables.write_feature_table(base, path)
    fixed = base.filter("event_date between '2024-01-10' and '2024-01-12'").withColumn("event_count", F.col("event_count") + 100)
    tables.replace_days(fixed, path)
    tables.replace_days(fixed, path)
    return _with_id(tables.read_feature_table(spark, path))


# Jobs ----------------------------------------------------------------------------------------------------------------


@query
def q0_panel_label(spark, root):
    return rounded(_with_id(feature_plan.panel_label(_conflict(spark, root))))


@query
def q1_build_features(spark, root):
    df = store.fresh_features(spark, root)
    return rounded(df.select("cell", "event_date", "label", *model.feature_names(df.columns), "actor_pair_roll14d"))


@query
def q2_train_and_evaluate(spark, root):
    """Folds and hold-out with the counts they are measured on; the focal model runs all rounds."""
    study = store.study(spark, root)
    trees = F.create_map(*[F.lit(x) for name, m in study.models.items() for x in (name, model.n_trees(m))])
    held = study.folds.withColumn("subject", F.concat(F.lit("fold "), F.col("fold").cast("string"))).drop("fold")
    both = held.unionByName(study.holdout.withColumnRenamed("model", "subject"))
    number = trees[F.col("subject")]
    inside = F.col("roc_auc").between(0.0, 1.0) & F.col("average_precision").between(0.0, 1.0)
    return both.select(
        "subject", "rows", "positives", F.coalesce(inside, F.lit(True)).alias("in_range"), F.when(F.col("subject") == "focal", number == 400).otherwise(number >= 1).alias("rounds_run")
    )


@query
def q2_publish(spark, root):
    """The saved production model scores the hold-out as the winner does, and the report holds the figures it was chosen by."""
    study, folder = store.study(spark, root), scratch_path(spark, "models")
    name = studies.publish(study, folder)
    test = store.training_parts(spark, root)[1]
    production = model.load_model(f"{folder}/production")
    both = model.predict(model.predict(test, study.models[name], "first"), production, "second")
    found = spark.read.json(f"{folder}/report")
    chosen = found.filter(F.col("metric") == "f1").filter(~F.col("subject").startswith("winner")).agg(F.max("value")).scalar()
    best = found.filter((F.col("metric") == "f1") & F.col("subject").startswith("winner")).agg(F.max("value")).scalar()
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("first") != F.col("second")).alias("differing"),
        F.coalesce(F.first(chosen) == F.first(best), F.lit(True)).alias("best_f1_won"),
    ).withColumn("report_subjects", found.agg(F.countDistinct("subject")).scalar())


@query
def q3_score_latest(spark, root):
    return scoring.score_latest(store.features(spark, root)).select(
        "cell", "strategic_score", "strategic_tier", "tactical_score", "tactical_tier", "should_alert", "tactical_triggers"
    )


@query
def q3_run_scoring(spark, root):
    """Two runs into the state table, one of them on an older feature table; what is read is the last commit."""
    table, features = StateTable(spark, scratch_path(spark, "scores"), buckets=8), store.features(spark, root)
    scoring.run_scoring(features.filter("event_date < '2024-01-20'"), table)
    return scoring.run_scoring(features, table).select(
        "cell", "strategic_score", "strategic_tier", "tactical_score", "tactical_tier", "should_alert", "alert_text", F.to_date("scored_at").alias("day")
    )


@query
def q4_backtest_days(spark, root):
    df = scoring.backtest_days(store.features(spark, root), *[F.lit(d).cast("date") for d in REPLAY])
    return df.drop("q", "r")


@query
def q5_latest_state(spark, root):
    return serving.latest_state(None, store.features(spark, root))


@query
def q5_stored_state(spark, root):
    """The main branch: scores that a run left in the state table, with tiers recomputed."""
    table = StateTable(spark, scratch_path(spark, "scores"), buckets=4)
    stale = scoring.run_scoring(store.features(spark, root), table).withColumn("strategic_tier", F.lit("stale"))
    return serving.latest_state(stale, store.features(spark, root)).withColumn("scored_at", F.substring("scored_at", 1, 10))


@query
def q6_cell_detail(spark, root):
    df = _detail(spark, root).select(
        "cell",
        "strategic_score",
        "strategic_tier",
        "tactical_score",
        "news_date",
        F.col("news_gdelt_hostility").alias("news_hostility"),
        "thermal_date",
        F.col("thermal_firms_max_frp").alias("thermal_max_frp"),
        "recent",
    )
    return rounded(df)


@query
def q7_cells_near(spark, root):
    points = derived.facilities(spark, root).select("name", "lat", "lng")
    found = serving.cells_near(points, _grid(spark, root), store.scores(spark, root))
    return rounded(found.select("name", "cell", "distance_m", "strategic_score", "strategic_tier", "tactical_tier", "should_alert"), 3)


@query
def q8_area_report(spark, root):
    df = serving.area_report(derived.origins(spark, root), _grid(spark, root), store.scores(spark, root))
    df = _area_rows(df).withColumn("latest_scored_at", F.to_date("latest_scored_at"))
    return rounded(df.drop("lat", "lng", "monitored_cells"))


@query
def q9_cluster_report(spark, root):
    df = serving.cluster_report(store.current_scores(spark, root), k=None)
    return rounded(df.withColumn("triggers", F.array_join("triggers", ";")))


@query
def q9_seed_cluster_report(spark, root):
    scores = store.current_scores(spark, root)
    df = serving.seed_cluster_report(scores.select("cell"), scores)
    return rounded(df.withColumn("triggers", F.array_join("triggers", ";")))


@query
def q10_evac_plan(spark, root):
    plan = serving.evac_plan(derived.origins(spark, root), derived.facilities(spark, root), store.current_scores(spark, root))
    cols = "origin_id destination country distance_km danger_cells total_cells nearest_facility facility_km narrative".split()
    return rounded(plan.select(*cols))


@query
def q10_custom_goal(spark, root):
    """Every third origin names its goal; dangerous cells on the way and the corners of the way come along."""
    asks = (F.col("origin_id") % 3) == 0
    goal = {"goal_lat": F.when(asks, F.lit(33.5138)), "goal_lng": F.when(asks, F.lit(36.2765))}
    plan = serving.evac_plan(derived.origins(spark, root).withColumns(goal), derived.facilities(spark, root), store.current_scores(spark, root))
    bend = F.when(F.size("route_points") == 3, F.col("route_points")[1])
    return rounded(
        plan.select("origin_id", "destination", "distance_km", "danger_cells", "total_cells", F.array_join("danger_ids", ";").alias("danger_ids"), bend[1].alias("bend_lat"), bend[0].alias("bend_lng"))
    )


@query
def q11_threshold_study(spark, root):
    return rounded(studies.threshold_study(store.labelled_scores(spark, root)))


@query
def q12_coverage_report(spark, root):
    stages = {
        "conflict": _with_id(_rows(spark, root)),
        "news": _with_id(with_cell(derived.news(spark, root))),
        "thermal": _with_id(with_cell(derived.thermal(spark, root))),
        "features": store.features(spark, root),
    }
    start, end = F.lit("2023-12-30").cast("date"), F.lit("2024-02-02").cast("date")
    return studies.coverage_report(stages, start, end)


@query
def r1_straight_route(spark, root):
    ways = derived.origins(spark, root).withColumns({"to_lat": F.lit(33.8938), "to_lng": F.lit(35.5018)})
    sides = ways.withColumn("side", F.explode(F.array(*[F.lit(s) for s in (0, 1, -1)])))
    points = routes.straight_route(sides, n=11, side="side")
    return rounded(points.select("origin_id", "side", "seq", "point_lat", "point_lng"))
