"""Values that the SQL of the catalogue expects, written out: it must not take them from the code it checks."""

from __future__ import annotations

# Grid, thresholds, tiers, map style, texts, features, coefficients, cities.
KM_PER_DEG_LAT, KM_PER_DEG_LNG, EDGE_KM = 111.195, 92.784, 3.722
SQRT3, INV_SQRT3 = 1.7320508075688772, 0.5773502691896258
NEIGHBOR_OFFSETS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
CORNERS = ((0.8660254037844386, -0.5), (0.8660254037844386, 0.5), (0.0, 1.0), (-0.8660254037844386, 0.5), (-0.8660254037844386, -0.5), (0.0, -1.0))
# From 0.10 to 0.95 by 0.05, from 0.05 to 0.95 by 0.01, and from 0.1 to 0.9 by 0.1.
REPORT_THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(18))
FINE_THRESHOLDS = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))
COARSE_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ALL_TIERS = ("red", "orange", "yellow", "green")
BANDS = (("Red", 0.7), ("Orange", 0.5), ("Yellow", 0.3))
COLOR_STOPS = ((0.54, "#ffffb2"), (0.57, "#fed976"), (0.6, "#feb24c"), (0.63, "#fd8d3c"), (0.65, "#fc4e2a"), (0.68, "#e31a1c"), (0.71, "#bd0026"), (0.74, "#800026"))
LEVELS = (("DANGER", 0.75), ("WARNING", 0.55), ("WATCH", 0.35))
OPACITY_STOPS = ((0.54, 0.45), (0.6, 0.58), (0.66, 0.72), (0.72, 0.85), (0.8, 0.92))
TIERS = (("red", 0.7), ("orange", 0.63), ("yellow", 0.54))
TIER_TEXT = {
    "red": "HIGH RISK — active conflict zone",
    "orange": "ELEVATED RISK — significant danger present",
    "yellow": "MODERATE RISK — tensions detected",
    "green": "LOW RISK — currently stable",
}
LINEAR_INTERCEPT = -0.1
LINEAR_COEFFICIENTS = {
    "dangerous_roll7d": 1.6,
    "neighbor_danger_avg": 0.9,
    "gdelt_hostility": 0.5,
    "firms_spike": 0.3,
    "fatalities_roll14d": 0.02,
    "event_roll3d": 0.06,
}
ALL_FEATURES = """
  event_count dangerous_count total_fatalities max_fatalities battle_count explosion_count
  vac_count riot_count population_best unique_actors dangerous_roll3d dangerous_roll7d
  dangerous_roll14d fatalities_roll3d fatalities_roll7d fatalities_roll14d event_roll3d event_roll7d
  event_roll14d dangerous_delta fatality_delta dangerous_velocity fatality_velocity neighbor_danger_avg
  neighbor_fatal_sum actor_pair_count actor_pair_delta actor_pair_velocity dangerous_lag1 dangerous_lag2
  fatalities_lag1 battle_lag1 explosion_lag1 gdelt_event_count gdelt_avg_tone gdelt_min_goldstein
  gdelt_avg_goldstein gdelt_num_articles gdelt_hostility neighbor_gdelt_hostility_avg firms_hotspot_count firms_avg_frp
  firms_max_frp firms_spike neighbor_firms_spike_sum gdelt_protest_count gdelt_threaten_count gdelt_assault_count
  gdelt_fight_count gdelt_cameo_conflict neighbor_gdelt_protest_avg temp_max temp_anomaly_30d precip_mm
  precip_spike
""".split()
CITIES = (
    ("Beirut", 33.8938, 35.5018, "Lebanon"),
    ("Tripoli", 34.4367, 35.8497, "Lebanon"),
    ("Sidon", 33.5633, 35.3714, "Lebanon"),
    ("Jounieh", 33.9808, 35.6178, "Lebanon"),
    ("Zahle", 33.8463, 35.902, "Lebanon"),
    ("Damascus", 33.5138, 36.2765, "Syria"),
    ("Latakia", 35.5317, 35.7918, "Syria"),
    ("Tartous", 34.8959, 35.8867, "Syria"),
    ("Homs", 34.7324, 36.7137, "Syria"),
    ("Amman", 31.9454, 35.9284, "Jordan"),
    ("Irbid", 32.5568, 35.8469, "Jordan"),
    ("Mafraq", 32.3422, 36.2079, "Jordan"),
    ("Antakya (Hatay)", 36.2025, 36.1522, "Turkey"),
    ("Gaziantep", 37.0594, 37.3825, "Turkey"),
    ("Erbil", 36.1912, 44.0089, "Iraq"),
    ("Haifa", 32.794, 34.9896, "Israel"),
)
