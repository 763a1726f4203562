"""Tiers, the additive rule score, trigger texts and summary sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hexrisk.functions.numbers import fixed, half_up

# Lower bounds of the model tiers.
TIERS = (("red", 0.70), ("orange", 0.63), ("yellow", 0.54))
BASE_TIER = "green"
ALL_TIERS = ("red", "orange", "yellow", "green")
TIER_TEXT = {
    "red": "HIGH RISK — active conflict zone",
    "orange": "ELEVATED RISK — significant danger present",
    "yellow": "MODERATE RISK — tensions detected",
    "green": "LOW RISK — currently stable",
}
UNKNOWN_TIER_TEXT = "UNKNOWN RISK"

# Rule thresholds, weights and saturation points.
HOTSPOT_MIN, HOTSPOT_FULL, SPIKE_WEIGHT, PARTIAL_SHARE = 2.0, 5.0, 0.35, 0.6
FRP_MIN, FRP_WEIGHT = 50.0, 0.10
HOSTILITY_MIN, HOSTILITY_FULL, HOSTILITY_WEIGHT = 0.55, 0.8, 0.25
GOLDSTEIN_MAX, GOLDSTEIN_FULL, GOLDSTEIN_WEIGHT = -5.0, 10.0, 0.20
NEIGHBOR_MIN, NEIGHBOR_FULL, NEIGHBOR_WEIGHT = 3.0, 8.0, 0.15
VELOCITY_MIN, VELOCITY_FULL, VELOCITY_WEIGHT = 2.0, 4.0, 0.20
BANDS = (("Red", 0.7), ("Orange", 0.5), ("Yellow", 0.3))
BAND_WEIGHT = 0.15
LEVELS = (("DANGER", 0.75), ("WARNING", 0.55), ("WATCH", 0.35))
BASE_LEVEL = "CLEAR"
ALERT_MIN = 0.75
TRIGGER_SEPARATOR = " | "
NO_TRIGGER = "No significant signals detected"
NO_TRIGGER_MARK = "No significant"

# Inputs of the rule score with the value an absent column stands for.
RULE_INPUTS = {
    "firms_hotspot_count": 0.0,
    "firms_max_frp": 0.0,
    "firms_spike": 0.0,
    "gdelt_hostility": 0.0,
    "gdelt_min_goldstein": 0.0,
    "gdelt_avg_tone": 0.0,
    "event_velocity": 1.0,
    "neighbor_event_avg": 0.0,
    "strategic_score": 0.0,
}

# Map style. Opacity and colour are linear between stops.
HEAT_FROM = 0.54
OPACITY_STOPS = ((0.54, 0.45), (0.60, 0.58), (0.66, 0.72), (0.72, 0.85), (0.80, 0.92))
COLOR_STOPS = (
    (0.54, "#ffffb2"),
    (0.57, "#fed976"),
    (0.60, "#feb24c"),
    (0.63, "#fd8d3c"),
    (0.65, "#fc4e2a"),
    (0.68, "#e31a1c"),
    (0.71, "#bd0026"),
    (0.74, "#800026"),
)
CLEAR_COLOR = "rgba(0,0,0,0)"


def _ladder(x: Column, steps, default: Column) -> Column:
    """Label of the first step whose lower bound ``x`` reaches."""
    out = default
    for label, bound in reversed(steps):
        out = F.when(x >= F.lit(bound), F.lit(label)).otherwise(out)
    return out


def strategic_tier(score: Column) -> Column:
    """Colour tier of a model score."""
    return _ladder(score, TIERS, F.lit(BASE_TIER))


def model_band(score: Column) -> Column:
    """Band of a model score inside the rule layer, null below the lowest."""
    return _ladder(score, BANDS, F.lit(None).cast("string"))


def tactical_level(score: Column) -> Column:
    """Risk level of an unrounded rule score."""
    return _ladder(score, LEVELS, F.lit(BASE_LEVEL))


def should_alert(score: Column) -> Column:
    return score >= F.lit(ALERT_MIN)


def tier_description(tier: Column) -> Column:
    """Plain description of a tier in either letter case."""
    out = F.lit(UNKNOWN_TIER_TEXT)
    for name, text in TIER_TEXT.items():
        out = F.when(F.lower(tier) == name, F.lit(text)).otherwise(out)
    return out


def hostility(tone: Column) -> Column:
    """Media hostility in 0..1 from an average tone."""
    return F.least(F.greatest(-tone, F.lit(0.0)) / F.lit(20.0), F.lit(1.0))


def thermal_spike(count: Column) -> Column:
    return (count >= F.lit(2)).cast("int")


def _share(x: Column, full: float) -> Column:
    return F.least(x / F.lit(full), F.lit(1.0))


def _fires(inputs: dict[str, Column]) -> list[tuple[Column, Column, Column | None]]:
    """Per rule: condition, contribution, trigger text (null for the rule that stays silent)."""
    hotspots, frp = inputs["firms_hotspot_count"], inputs["firms_max_frp"]
    host, gold = inputs["gdelt_hostility"], inputs["gdelt_min_goldstein"]
    near, velocity, model = inputs["neighbor_event_avg"], inputs["event_velocity"], inputs["strategic_score"]
    spike = F.coalesce(inputs["firms_spike"] != F.lit(0), F.lit(False))
    return [
        (
            spike,
            F.lit(SPIKE_WEIGHT),
            F.concat(
                F.lit("Thermal spike detected ("), fixed(hotspots, 0), F.lit(" hotspots, max FRP="), fixed(frp, 0), F.lit(" MW)")
            ),
        ),
        (
            ~spike & (hotspots >= F.lit(HOTSPOT_MIN)),
            _share(hotspots, HOTSPOT_FULL) * F.lit(SPIKE_WEIGHT) * F.lit(PARTIAL_SHARE),
            F.concat(F.lit("Elevated thermal activity ("), fixed(hotspots, 0), F.lit(" hotspots)")),
        ),
        (
            frp >= F.lit(FRP_MIN),
            F.lit(FRP_WEIGHT),
            F.concat(F.lit("High-intensity heat source (FRP="), fixed(frp, 0), F.lit(" MW)")),
        ),
        (
            host >= F.lit(HOSTILITY_MIN),
            F.lit(HOSTILITY_WEIGHT) * _share(host, HOSTILITY_FULL),
            F.concat(
                F.lit("Hostile media coverage (hostility="),
                fixed(host, 2),
                F.lit(", tone="),
                fixed(inputs["gdelt_avg_tone"], 1),
                F.lit(")"),
            ),
        ),
        (
            gold <= F.lit(GOLDSTEIN_MAX),
            F.lit(GOLDSTEIN_WEIGHT) * _share(F.abs(gold), GOLDSTEIN_FULL),
            F.concat(F.lit("Destabilizing events in news (Goldstein="), fixed(gold, 1), F.lit(")")),
        ),
        (
            near >= F.lit(NEIGHBOR_MIN),
            F.lit(NEIGHBOR_WEIGHT) * _share(near, NEIGHBOR_FULL),
            F.concat(F.lit("High surrounding activity ("), fixed(near, 1), F.lit(" avg events in adjacent hexes)")),
        ),
        (
            velocity >= F.lit(VELOCITY_MIN),
            F.lit(VELOCITY_WEIGHT) * _share(velocity, VELOCITY_FULL),
            F.concat(F.lit("Event rate spiking ("), fixed(velocity, 1), F.lit("x above 4-week baseline)")),
        ),
        (
            model >= F.lit(BANDS[0][1]),
            F.lit(BAND_WEIGHT),
            F.concat(F.lit("ML model flagged Red (escalation probability="), fixed(model, 2), F.lit(")")),
        ),
        (
            (model >= F.lit(BANDS[1][1])) & (model < F.lit(BANDS[0][1])),
            F.lit(BAND_WEIGHT * 0.5),
            None,
        ),
    ]


def rule_score(inputs: dict[str, Column]) -> Column:
    """Unrounded additive score, at most 1."""
    total = F.lit(0.0)
    for fires, adds, _ in _fires(inputs):
        total = total + F.when(fires, adds).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def rule_triggers(inputs: dict[str, Column]) -> Column:
    """Texts of the rules that fire, as an array; a default text when none does."""
    texts = F.array_compact(F.array(*[F.when(fires, text) for fires, _, text in _fires(inputs) if text is not None]))
    return F.when(F.size(texts) == 0, F.array(F.lit(NO_TRIGGER))).otherwise(texts)


def split_triggers(text: Column) -> Column:
    """Trigger text to a clean array: trimmed, without blanks and without the default text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: (t != "") & ~F.contains(t, F.lit(NO_TRIGGER_MARK)))


def heat_opacity(score: Column) -> Column:
    out = F.lit(OPACITY_STOPS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(OPACITY_STOPS, OPACITY_STOPS[1:]))):
        line = F.lit(y0) + (score - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        out = F.when(score < F.lit(x1), line).otherwise(out)
    return F.when(score < F.lit(HEAT_FROM), F.lit(0.0)).otherwise(out)


def heat_color(score: Column) -> Column:
    """Colour between the stops, each channel on a line; the last stop's colour beyond it."""

    def channels(color: str) -> list[int]:
        return [int(color[i : i + 2], 16) for i in (1, 3, 5)]

    def text(values: list[Column]) -> Column:
        return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(v + F.lit(0.5)).cast("int"))), 2, "0") for v in values])

    out = F.lit(COLOR_STOPS[-1][1])
    for (x0, c0), (x1, c1) in reversed(list(zip(COLOR_STOPS, COLOR_STOPS[1:]))):
        way = (score - F.lit(x0)) / F.lit(x1 - x0)
        mixed = text([F.lit(float(a)) + way * F.lit(float(b - a)) for a, b in zip(channels(c0), channels(c1), strict=True)])
        out = F.when(score < F.lit(x1), mixed).otherwise(out)
    return F.when(score < F.lit(HEAT_FROM), F.lit(CLEAR_COLOR)).otherwise(out)


def cell_text(tier: Column, triggers: Column, alert_text: Column) -> Column:
    """One sentence per cell: the alert text, else the first two signals, else the tier."""
    signals = split_triggers(triggers)
    return (
        F.when(F.coalesce(alert_text, F.lit("")) != "", alert_text)
        .when(
            F.size(signals) > 0,
            F.concat(
                F.lit("Risk signals detected near this location: "), F.array_join(F.slice(signals, 1, 2), "; "), F.lit(".")
            ),
        )
        .otherwise(
            F.concat(
                F.lit("This area carries a "),
                F.lower(F.coalesce(tier, F.lit(BASE_TIER))),
                F.lit(" risk level based on historical conflict patterns in the region."),
            )
        )
    )


def cluster_text(tier: Column, size: Column, triggers: Column) -> Column:
    """One sentence per cluster from its tier, size and array of signals."""
    zones = size.cast("string")
    return F.when(
        F.size(triggers) > 0,
        F.concat(
            F.lit("This "),
            F.lower(tier),
            F.lit("-risk cluster of "),
            zones,
            F.lit(" zones shows: "),
            F.array_join(F.slice(triggers, 1, 3), "; "),
            F.lit("."),
        ),
    ).otherwise(
        F.concat(
            F.lit("This area carries a "),
            F.lower(tier),
            F.lit(" risk level across "),
            zones,
            F.lit(" adjacent monitoring zones based on historical conflict patterns."),
        )
    )


def route_text(destination: Column, country: Column, km: Column, minutes: Column, danger: Column, facility: Column) -> Column:
    """Travel advice for a route."""
    return F.concat(
        F.lit("Drive to "),
        destination,
        F.when(F.coalesce(country, F.lit("")) != "", F.concat(F.lit(", "), country)).otherwise(F.lit("")),
        F.lit(" ("),
        fixed(km, 1),
        F.lit(" km, ~"),
        minutes.cast("string"),
        F.lit(" min)."),
        F.when(
            danger > 0,
            F.concat(F.lit(" Caution: route crosses "), danger.cast("string"), F.lit(" active danger zone(s).")),
        ).otherwise(F.lit("")),
        F.when(facility.isNotNull(), F.concat(F.lit(" Nearest facility: "), facility, F.lit("."))).otherwise(F.lit("")),
        F.lit(" Travel during daylight. Bring ID, water, phone charger."),
    )


def tactical_columns(inputs: dict[str, Column]) -> dict[str, Column]:
    """All rule-layer outputs for one ``select``; levels are decided before rounding."""
    raw = rule_score(inputs)
    return {
        "tactical_score": half_up(raw, 3),
        "tactical_tier": tactical_level(raw),
        "should_alert": should_alert(raw),
        "tactical_triggers": F.array_join(rule_triggers(inputs), TRIGGER_SEPARATOR),
    }
