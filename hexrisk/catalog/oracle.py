"""SQL that computes the named queries on the same tables with another engine, as a check.

Common steps are named fragments; a query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from hexrisk.catalog import expected as risk
from hexrisk.catalog.expected import (
    ALL_FEATURES,
    CITIES,
    COARSE_THRESHOLDS,
    CORNERS,
    EDGE_KM,
    FINE_THRESHOLDS,
    INV_SQRT3,
    KM_PER_DEG_LAT,
    KM_PER_DEG_LNG,
    LINEAR_COEFFICIENTS,
    LINEAR_INTERCEPT,
    NEIGHBOR_OFFSETS,
    REPORT_THRESHOLDS,
    SQRT3,
)

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def d(x: float) -> str:
    return f"cast('{x!r}' as double)"


def hu(x: str, digits: int = 6) -> str:
    scale = float(10**digits)
    return f"(floor(({x}) * {d(scale)} + {d(0.5)}) / {d(scale)})"


def fixed(x: str, digits: int) -> str:
    if digits == 0:
        return f"cast(cast(floor(({x}) + {d(0.5)}) as bigint) as varchar)"
    return f"cast(cast({hu(x, digits)} as decimal(18,{digits})) as varchar)"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def lattice(key: str, shift: float = 0.0) -> str:
    return (
        f"{d(33.0 + shift)} + (({key} // 40) % 90 - 90 * (({key} // 259200) % 14)) * {d(0.05)} as lat, "
        f"{d(35.0)} + ({key} % 40 + 40 * (({key} // 3600) % 72)) * {d(0.05)} as lng"
    )


def fractions(lat: str, lng: str) -> tuple[str, str]:
    """Fractional axial coordinates of a point."""
    x, y = f"({lng} * {d(KM_PER_DEG_LNG)})", f"({lat} * {d(KM_PER_DEG_LAT)})"
    return f"(({d(INV_SQRT3)} * {x} - {y} / {d(3.0)}) / {d(EDGE_KM)})", f"(({d(2.0)} * {y} / {d(3.0)}) / {d(EDGE_KM)})"


def hexed(src: str) -> str:
    """Cells of rows with the fractions ``_fq``, ``_fr``."""
    h = d(0.5)
    return f"""(select * exclude (_fq, _fr, _q, _r, _s),
      cast(case when abs(_q - _fq) > abs(_s + _fq + _fr) and abs(_q - _fq) > abs(_r - _fr) then -_s - _r else _q end as bigint) as q,
      cast(case when not (abs(_q - _fq) > abs(_s + _fq + _fr) and abs(_q - _fq) > abs(_r - _fr))
                 and abs(_r - _fr) > abs(_s + _fq + _fr) then -_q - _s else _r end as bigint) as r
      from (select *, floor(_fq + {h}) as _q, floor(_fr + {h}) as _r, floor(-_fq - _fr + {h}) as _s from {src}) as c1)"""


def celled(src: str, lat: str = "lat", lng: str = "lng") -> str:
    fq, fr = fractions(lat, lng)
    return hexed(f"(select *, {fq} as _fq, {fr} as _fr from {src}) as c0")


def crossed(legs: str, keys: str) -> str:
    """Cells that the legs (``la``, ``lo`` to ``lb``, ``lp``) of each key cross: middles between all places where a form is whole."""
    a, b = fractions("la", "lo"), fractions("lb", "lp")
    ends = f"(select {keys}, {a[0]} as aq, {a[1]} as ar, {b[0]} as bq, {b[1]} as br from {legs} as l0)"
    two = d(2.0)
    forms = f"""(select *, bq - aq as dq, br - ar as dr, aq - ar as u0, bq - br as u1, aq + {two} * ar as v0, bq + {two} * br as v1, {two} * aq + ar as w0, {two} * bq + br as w1
      from {ends} as l1)"""
    cuts = ", ".join(
        f"list_transform(range(cast(floor(least({x}0, {x}1)) as bigint) + 1, greatest(cast(ceil(greatest({x}0, {x}1)) as bigint), cast(floor(least({x}0, {x}1)) as bigint) + 1)), lambda k: (k - {x}0) / ({x}1 - {x}0))"
        for x in "uvw"
    )
    cut = f"(select *, list_sort(list_distinct(flatten([[{d(0.0)}, {d(1.0)}], {cuts}]))) as ts from {forms} as l2)"
    middles = f"(select *, (ts[i] + ts[i + 1]) / {two} as t from (select *, unnest(range(1, len(ts))) as i from {cut} as l3) as l4)"
    return f"(select distinct {keys}, q, r from {hexed(f'(select {keys}, aq + dq * t as _fq, ar + dr * t as _fr from {middles} as l5) as l6')} as l7)"


def center(q: str = "q", r: str = "r") -> tuple[str, str]:
    lat = f"(({d(EDGE_KM * 1.5)} * {r}) / {d(KM_PER_DEG_LAT)})"
    lng = f"(({d(EDGE_KM * SQRT3)} * ({q} + {r} / {d(2.0)})) / {d(KM_PER_DEG_LNG)})"
    return lat, lng


def haversine(a: str, b: str, c: str, e: str) -> str:
    hl, hg = f"sin(radians({c} - {a}) / {d(2.0)})", f"sin(radians({e} - {b}) / {d(2.0)})"
    chord = f"({hl} * {hl} + cos(radians({a})) * cos(radians({c})) * {hg} * {hg})"
    return f"({d(12742.0)} * asin(sqrt(least({chord}, {d(1.0)}))))"


ID = "q || '_' || r as cell"
OFFSETS = "(values " + ", ".join(str(o) for o in NEIGHBOR_OFFSETS) + ") as o(dq, dr)"


def ladder(x: str, steps, default: str) -> str:
    return "case " + " ".join(f"when {x} >= {d(b)} then '{n}'" for n, b in steps) + f" else {default} end"


def tier(x: str) -> str:
    return ladder(x, risk.TIERS, "'green'")


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def oracle(name: str, sql: str) -> None:
    """Register a check: the fragments it needs, in order, then the query."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for p in PARTS:
            if p not in seen and re.search(rf"\b{p}\b", text):
                seen.add(p)
                visit(PARTS[p])
                needed.append(p)

    visit(sql)
    recursive = "recursive " if any("union" in PARTS[p] and f"from {p}" in PARTS[p] for p in needed) else ""
    heads = ",\n".join(f"{p} as ({PARTS[p]})" for p in needed)
    ORACLES[name] = f"with {recursive}{heads}\n{sql}" if needed else sql


# Feeds ---------------------------------------------------------------------------------------------------------------

part(
    "conflict",
    f"""select event_id, cast(ts as date) as event_date, {lattice('user_id')}, 1 + k % 3 as geo_precision,
    case when event_type = 'click' then 'Protests'
         when value >= 150 and event_type = 'error' then 'Explosions/Remote violence'
         when value >= 150 and event_type = 'purchase' then 'Battles'
         when value >= 150 and event_type = 'signup' then 'Riots'
         when value >= 150 and event_type = 'view' then 'Violence against civilians'
         when event_type = 'view' then 'Protests' else 'Strategic developments' end as event_type,
    case when value >= 150 and event_type = 'click' then 'Excessive force against protesters' else 'Other' end as sub_event_type,
    case when k % 11 <> 0 then 'A' || (k % 7) end as actor1,
    case when k % 4 <> 0 then 'B' || (k % 5) end as actor2,
    case when value >= 150 then cast(floor(value / 50) as bigint) else 0 end as fatalities,
    case when k % 2 = 0 then 1000 * (1 + user_id % 9) else 0 end as population_best
    from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events) as e""",
)
DANGEROUS = """cast(coalesce(event_type in ('Battles', 'Explosions/Remote violence', 'Violence against civilians', 'Riots'), false)
  or coalesce(sub_event_type in ('Excessive force against protesters', 'Protest with intervention', 'Violent demonstration'), false)
  as int)"""
FLAGS = """cast(event_type = 'Battles' as int) as is_battle, cast(event_type = 'Explosions/Remote violence' as int) as is_explosion,
  cast(event_type = 'Violence against civilians' as int) as is_vac, cast(event_type = 'Riots' as int) as is_riot"""
PAIR = "coalesce(actor1, 'unknown') || '||' || coalesce(actor2, 'unknown')"
part(
    "crows",
    f"select *, {DANGEROUS} as is_dangerous, {FLAGS}, {PAIR} as actor_pair from "
    + celled("(select * from conflict where geo_precision <= 2) as c"),
)
part(
    "news",
    f"""select l_orderkey * 10 + l_linenumber as id, date '2024-01-01' + cast(l_orderkey % 30 as int) as event_date, {lattice('l_suppkey')},
    {d(12.5)} - {d(0.625)} * l_quantity as tone, {d(10.0)} - {d(200.0)} * l_discount as goldstein, l_quantity as articles,
    1 + l_partkey % 20 as code from lineitem""",
)
part(
    "thermal",
    f"""select date '2024-01-01' + cast(o_orderkey % 30 as int) as event_date, {lattice('o_custkey')},
    o_totalprice / {d(5000.0)} as frp from orders""",
)
part(
    "weather",
    f"""select grid_lat, grid_lon, event_date,
    max(cast(20 + (g * 7 + dd * 3) % 17 + o_orderkey % 3 as double)) as temp_max,
    avg(cast(15 + (g * 7 + dd * 3) % 17 as double)) as temp_mean,
    max(cast(greatest((g * 5 + dd * 11) % 23 - 15 + o_custkey % 2, 0) as double)) as precip_mm
    from (select *, cast(grid_lat * {d(10.0)} + grid_lon * {d(2.0)} as bigint) as g from
      (select o_orderkey, o_custkey, floor(lat * {d(2.0)}) / {d(2.0)} as grid_lat, floor(lng * {d(2.0)}) / {d(2.0)} as grid_lon,
       date '2023-12-22' + cast(o_orderkey % 40 as int) as event_date, o_orderkey % 40 as dd
       from (select o_orderkey, o_custkey, {lattice('o_custkey')} from orders) as o1) as o2) as o3
    group by 1, 2, 3""",
)
part(
    "facilities",
    f"""select s_name as name, (['hospital', 'un_shelter', 'border_crossing', 'evacuation_point', 'red_cross'])[s_nationkey % 5 + 1] as type,
    {lattice('s_suppkey', 0.1)}, case when s_acctbal >= 5000 then 'major' else 'medium' end as capacity,
    'nation ' || s_nationkey as notes from supplier""",
)
part("origins", f"select c_custkey as origin_id, {lattice('c_custkey')} from customer")

# Panel and features --------------------------------------------------------------------------------------------------

part(
    "cday",
    """select q, r, event_date, count(event_type) as event_count, cast(sum(is_dangerous) as bigint) as dangerous_count,
    cast(sum(fatalities) as bigint) as total_fatalities, cast(max(fatalities) as bigint) as max_fatalities,
    cast(sum(is_battle) as bigint) as battle_count, cast(sum(is_explosion) as bigint) as explosion_count,
    cast(sum(is_vac) as bigint) as vac_count, cast(sum(is_riot) as bigint) as riot_count,
    cast(max(population_best) as bigint) as population_best, count(distinct actor1) as unique_actors,
    count(distinct actor_pair) as actor_pair_count from crows group by q, r, event_date""",
)
part("cells", "select distinct q, r from cday")
part("bounds", "select min(event_date) as lo, max(event_date) as hi from cday")
COUNTS = (
    "event_count dangerous_count total_fatalities max_fatalities battle_count explosion_count vac_count riot_count "
    "population_best unique_actors actor_pair_count"
).split()
part(
    "panel",
    "select s.q, s.r, s.event_date, "
    + ", ".join(f"cast(coalesce(c.{c}, 0) as bigint) as {c}" for c in COUNTS)
    + """ from (select q, r, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as event_date from cells, bounds) as s
    left join cday as c on c.q = s.q and c.r = s.r and c.event_date = s.event_date""",
)
part(
    "nday",
    f"""select *, least(greatest(-gdelt_avg_tone, {d(0.0)}) / {d(20.0)}, {d(1.0)}) as gdelt_hostility from (
    select q, r, event_date, count(id) as gdelt_event_count, avg(tone) as gdelt_avg_tone, min(goldstein) as gdelt_min_goldstein,
    avg(goldstein) as gdelt_avg_goldstein, sum(articles) as gdelt_num_articles,
    count(*) filter (code in (14)) as gdelt_protest_count, count(*) filter (code in (13)) as gdelt_threaten_count,
    count(*) filter (code in (18)) as gdelt_assault_count, count(*) filter (code in (19, 20)) as gdelt_fight_count,
    count(*) filter (code in (13, 14, 18, 19, 20)) as gdelt_cameo_conflict
    from {celled('news')} as n group by q, r, event_date) as n2""",
)
part(
    "tday",
    f"""select *, cast(firms_hotspot_count >= 2 as int) as firms_spike from (select q, r, event_date,
    count(frp) as firms_hotspot_count, avg(frp) as firms_avg_frp, max(frp) as firms_max_frp
    from {celled('thermal')} as t group by q, r, event_date) as t2""",
)
NEWS = (
    "gdelt_event_count gdelt_avg_tone gdelt_min_goldstein gdelt_avg_goldstein gdelt_num_articles gdelt_protest_count "
    "gdelt_threaten_count gdelt_assault_count gdelt_fight_count gdelt_cameo_conflict gdelt_hostility"
).split()
THERMAL = "firms_hotspot_count firms_avg_frp firms_max_frp firms_spike".split()
part(
    "joined",
    "select p.*, "
    + ", ".join(f"coalesce(n.{c}, 0) as {c}" for c in NEWS)
    + ", "
    + ", ".join(f"coalesce(t.{c}, 0) as {c}" for c in THERMAL)
    + """ from panel as p left join nday as n on n.q = p.q and n.r = p.r and n.event_date = p.event_date
    left join tday as t on t.q = p.q and t.r = p.r and t.event_date = p.event_date""",
)
part(
    "lagged",
    f"""select a.q, a.r, a.event_date, avg(b.dangerous_count) as neighbor_danger_avg,
    cast(sum(b.total_fatalities) as double) as neighbor_fatal_sum, avg(b.gdelt_hostility) as neighbor_gdelt_hostility_avg,
    avg(b.gdelt_protest_count) as neighbor_gdelt_protest_avg, cast(sum(b.firms_spike) as double) as neighbor_firms_spike_sum
    from joined as a, {OFFSETS}, joined as b where b.q = a.q + o.dq and b.r = a.r + o.dr and b.event_date = a.event_date
    group by a.q, a.r, a.event_date""",
)
LAGGED = (
    "neighbor_danger_avg neighbor_fatal_sum neighbor_gdelt_hostility_avg neighbor_gdelt_protest_avg neighbor_firms_spike_sum"
).split()
W = "over (partition by q, r order by event_date"
ROLL = {"dangerous": "dangerous_count", "fatalities": "total_fatalities", "event": "event_count"}
ROLLS = ", ".join(
    f"avg({src}) {W} rows between {n - 1} preceding and current row) as {name}_roll{n}d" for n in (3, 7, 14) for name, src in ROLL.items()
)
DELTAS = ", ".join(
    f"{c} - coalesce(lag({c}) {W}), {c}) as {name}"
    for c, name in (
        ("dangerous_count", "dangerous_delta"),
        ("total_fatalities", "fatality_delta"),
        ("actor_pair_count", "actor_pair_delta"),
    )
)
ACTOR_ROLL = f"avg(actor_pair_count) {W} rows between 13 preceding and current row) as actor_pair_roll14d"
LAGS = ", ".join(
    f"coalesce(lag({c}, {n}) {W}), 0) as {name}"
    for name, c, n in (
        ("dangerous_lag1", "dangerous_count", 1),
        ("dangerous_lag2", "dangerous_count", 2),
        ("fatalities_lag1", "total_fatalities", 1),
        ("battle_lag1", "battle_count", 1),
        ("explosion_lag1", "explosion_count", 1),
    )
)
LABEL = f"cast(coalesce(max(dangerous_count) {W} rows between 1 following and 3 following), 0) > 0 as int) as label"
FILL = f"""coalesce(last_value(nullif(population_best, 0) ignore nulls) {W} rows between unbounded preceding and current row),
  first_value(nullif(population_best, 0) ignore nulls) {W} rows between current row and unbounded following), 0) as population_best"""
LEFT = "row_number() over (partition by q, r order by event_date desc) as left_days"
part(
    "line",
    f"select * replace ({FILL}), {ROLLS}, {DELTAS}, {ACTOR_ROLL}, {LAGS}, {LABEL}, {LEFT} from joined",
)
EPS = d(1e-6)
VELOCITY = f"""dangerous_count / (dangerous_roll14d + {EPS}) as dangerous_velocity,
  total_fatalities / (fatalities_roll14d + {EPS}) as fatality_velocity,
  actor_pair_count / (actor_pair_roll14d + {EPS}) as actor_pair_velocity"""
part(
    "weatherf",
    """select w.grid_lat, w.grid_lon, w.event_date, temp_max, precip_mm,
    coalesce(temp_max - case when count(temp_max) over g >= 7 then avg(temp_max) over g end, 0) as temp_anomaly_30d,
    cast(precip_mm > p90 as int) as precip_spike
    from weather as w join (select grid_lat, grid_lon, month(event_date) as m, quantile_cont(precip_mm, 0.9) as p90
      from weather group by 1, 2, 3) as p on p.grid_lat = w.grid_lat and p.grid_lon = w.grid_lon and p.m = month(w.event_date)
    window g as (partition by w.grid_lat, w.grid_lon order by w.event_date rows between 29 preceding and current row)""",
)


def grid_step(x: str) -> str:
    return f"(ceil({x} / {d(0.5)} - {d(0.5)}) * {d(0.5)})"


GRID_LAT, GRID_LON = grid_step(center()[0]), grid_step(center()[1])
WEATHER = "temp_max temp_anomaly_30d precip_mm precip_spike".split()
part(
    "feat",
    "select l.*, "
    + VELOCITY
    + ", "
    + ", ".join(f"coalesce(g.{c}, 0) as {c}" for c in LAGGED)
    + ", "
    + ", ".join(f"coalesce(w.{c}, 0) as {c}" for c in WEATHER)
    + f""", l.{ID.replace("|| r", "|| l.r")} from (select *, {GRID_LAT} as grid_lat, {GRID_LON} as grid_lon from line) as l
    left join lagged as g on g.q = l.q and g.r = l.r and g.event_date = l.event_date
    left join weatherf as w on w.grid_lat = l.grid_lat and w.grid_lon = l.grid_lon and w.event_date = l.event_date""",
)
part("labelled", "select * from feat where left_days > 3")

# Scores --------------------------------------------------------------------------------------------------------------


def linear(columns: str = "", digits: int = 4) -> str:
    z = d(LINEAR_INTERCEPT) + "".join(f" + {d(c)} * {columns}{n}" for n, c in LINEAR_COEFFICIENTS.items())
    return hu(f"{d(1.0)} / ({d(1.0)} + exp(-({z})))", digits)


def rules(i: dict[str, str]) -> tuple[str, str]:
    """Unrounded rule score and trigger text for inputs given as SQL expressions."""
    n = {
        "hot": "0", "frp": "0", "spike": "0", "host": "0", "gold": "0", "tone": "0", "near": "0", "vel": d(1.0), "model": d(0.0), **i,
    }
    fires = [
        (f"{n['spike']} <> 0", d(0.35), f"'Thermal spike detected (' || {fixed(n['hot'], 0)} || ' hotspots, max FRP=' || {fixed(n['frp'], 0)} || ' MW)'"),
        (f"{n['spike']} = 0 and {n['hot']} >= 2", f"least({n['hot']} / {d(5.0)}, {d(1.0)}) * {d(0.35)} * {d(0.6)}", f"'Elevated thermal activity (' || {fixed(n['hot'], 0)} || ' hotspots)'"),
        (f"{n['frp']} >= 50", d(0.10), f"'High-intensity heat source (FRP=' || {fixed(n['frp'], 0)} || ' MW)'"),
        (f"{n['host']} >= {d(0.55)}", f"{d(0.25)} * least({n['host']} / {d(0.8)}, {d(1.0)})", f"'Hostile media coverage (hostility=' || {fixed(n['host'], 2)} || ', tone=' || {fixed(n['tone'], 1)} || ')'"),
        (f"{n['gold']} <= -5", f"{d(0.2)} * least(abs({n['gold']}) / {d(10.0)}, {d(1.0)})", f"'Destabilizing events in news (Goldstein=' || {fixed(n['gold'], 1)} || ')'"),
        (f"{n['near']} >= 3", f"{d(0.15)} * least({n['near']} / {d(8.0)}, {d(1.0)})", f"'High surrounding activity (' || {fixed(n['near'], 1)} || ' avg events in adjacent hexes)'"),
        (f"{n['vel']} >= 2", f"{d(0.2)} * least({n['vel']} / {d(4.0)}, {d(1.0)})", f"'Event rate spiking (' || {fixed(n['vel'], 1)} || 'x above 4-week baseline)'"),
        (f"{n['model']} >= {d(0.7)}", d(0.15), f"'ML model flagged Red (escalation probability=' || {fixed(n['model'], 2)} || ')'"),
        (f"{n['model']} >= {d(0.5)} and {n['model']} < {d(0.7)}", d(0.075), "null"),
    ]
    score = d(0.0) + "".join(f" + case when {c} then {a} else {d(0.0)} end" for c, a, _ in fires)
    texts = ", ".join(f"case when {c} then {t} end" for c, _, t in fires)
    return f"least({score}, {d(1.0)})", f"coalesce(nullif(concat_ws(' | ', {texts}), ''), 'No significant signals detected')"


LEVEL = ladder("raw", risk.LEVELS, "'CLEAR'")
SCORE_INPUTS = {
    "hot": "firms_hotspot_count", "frp": "firms_max_frp", "spike": "firms_spike", "host": "gdelt_hostility",
    "gold": "gdelt_min_goldstein", "tone": "gdelt_avg_tone", "near": "neighbor_danger_avg", "vel": "dangerous_velocity",
    "model": "strategic_score",
}


def scored(src: str) -> str:
    raw, text = rules(SCORE_INPUTS)
    return f"""select cell, q, r, event_date, strategic_score, {tier('strategic_score')} as strategic_tier,
    {hu('raw', 3)} as tactical_score, {LEVEL} as tactical_tier, raw >= {d(0.75)} as should_alert, tactical_triggers
    from (select *, {raw} as raw, {text} as tactical_triggers from (select *, {linear()} as strategic_score from {src}) as s1) as s2"""


part("history", scored("feat"))
part("state", scored("(select * from feat where left_days = 1) as f"))
part("dayscores", "select * from history where event_date = (select max(event_date) from history)")
part("lscores", f"select *, {linear(digits=9)} as strategic_score from labelled")
part("grid", f"select {ID}, q, r, {hu(center()[0])} as lat, {hu(center()[1])} as lng from cells")
part(
    "clusters",
    f"""select c.cell, c.q, c.r, c.strategic_tier, c.strategic_score, c.tactical_score, c.tactical_triggers,
    root.q || '_' || root.r as cluster_id from (select cell, min({{'q': rq, 'r': rr}}) as root from reach group by cell) as m
    join dayscores as c on c.cell = m.cell""",
)
part(
    "reach",
    f"""select cell, q, r, strategic_tier, q as rq, r as rr from dayscores
    union select a.cell, a.q, a.r, a.strategic_tier, b.q, b.r from reach as a, {OFFSETS}, dayscores as b
    where b.q = a.rq + o.dq and b.r = a.rr + o.dr and b.strategic_tier = a.strategic_tier""",
)
part(
    "seeds",
    f"""select seed, cell, hop, cast(row_number() over (partition by seed order by hop, q, r) as int) as rank from
    (select seed, cell, q, r, min(hop) as hop from hops group by seed, cell, q, r) as h
    qualify row_number() over (partition by seed order by hop, q, r) <= 30""",
)
part(
    "hops",
    f"""select cell as seed, cell, q, r, strategic_tier, 0 as hop from dayscores
    union select a.seed, b.cell, b.q, b.r, a.strategic_tier, a.hop + 1 from hops as a, {OFFSETS}, dayscores as b
    where b.q = a.q + o.dq and b.r = a.r + o.dr and b.strategic_tier = a.strategic_tier and a.hop < 29""",
)
SIGNALS = "list_filter(list_transform(string_split(tactical_triggers, '|'), lambda t: trim(t)), lambda t: t <> '' and not contains(t, 'No significant'))"


def cluster_numbers(src: str, key: str) -> str:
    return f"""select {key}, count(*) as cells, max(strategic_tier) as strategic_tier,
    {hu(f"cast(sum(cast(floor(strategic_score * {d(10000.0)} + {d(0.5)}) as bigint)) as double) / count(*) / {d(10000.0)}")} as avg_strategic_score,
    max(strategic_score) as max_strategic_score,
    {hu(f"cast(sum(cast(floor(tactical_score * {d(1000.0)} + {d(0.5)}) as bigint)) as double) / count(*) / {d(1000.0)}")} as avg_tactical_score,
    coalesce(any_value(trig), '') as triggers, any_value(trig3) as first_triggers
    from {src} as c left join (select {key}, string_agg(t, ';' order by t) as trig, string_agg(t, '; ' order by t) filter (i <= 3) as trig3
      from (select {key}, t, row_number() over (partition by {key} order by t) as i from
        (select distinct {key}, unnest({SIGNALS}) as t from {src}) as u) as v group by {key}) as g using ({key})
    group by {key}"""


def cluster_full(src: str, key: str) -> str:
    lat, lng = center()
    desc = "case " + " ".join(f"when strategic_tier = '{n}' then '{t}'" for n, t in risk.TIER_TEXT.items()) + " end"
    return f"""select n.* exclude (first_triggers), center_lat, center_lng, {desc} as description,
    case when first_triggers is not null then 'This ' || strategic_tier || '-risk cluster of ' || cells || ' zones shows: ' || first_triggers || '.'
    else 'This area carries a ' || strategic_tier || ' risk level across ' || cells || ' adjacent monitoring zones based on historical conflict patterns.' end as narrative
    from ({cluster_numbers(src, key)}) as n join (select {key}, {hu(f'avg({lat})')} as center_lat, {hu(f'avg({lng})')} as center_lng from {src} group by {key}) as z using ({key})"""


# Places, candidates, routes ------------------------------------------------------------------------------------------

CITY_ROWS = "(values " + ", ".join(f"('{n}', {d(la)}, {d(lo)}, '{c}')" for n, la, lo, c in CITIES) + ") as t(name, lat, lng, country)"
part("places", f"select name, lat, lng, country, 'city' as kind from {CITY_ROWS} union all select name, lat, lng, notes, 'facility' from facilities")
part("redcells", "select q, r from dayscores where strategic_tier = 'red'")
part("safeplaces", f"select * from {celled('places')} as p where not exists (select 1 from redcells as x where x.q = p.q and x.r = p.r)")
part("safefacilities", f"select * from {celled('facilities')} as p where not exists (select 1 from redcells as x where x.q = p.q and x.r = p.r)")
part("spots", "select distinct lat, lng from origins")
part(
    "candidates",
    f"""select * from (select *, cast(row_number() over (partition by lat, lng order by distance_km, name) as int) as rank from
    (select s.lat, s.lng, p.name, p.country, p.lat as to_lat, p.lng as to_lng, {hu(haversine('s.lat', 's.lng', 'p.lat', 'p.lng'))} as distance_km
     from spots as s, safeplaces as p) as x where distance_km between 5 and 500) as y where rank <= 5""",
)
T = f"(seq / {d(100.0)})"
MID_LAT = f"((lat + to_lat) / {d(2.0)} + variant * (to_lng - lng) * {d(0.15)})"
MID_LNG = f"((lng + to_lng) / {d(2.0)} - variant * (to_lat - lat) * {d(0.15)})"


def bent(a: str, m: str, b: str, t: str = T) -> str:
    return (
        f"case when variant = 0 then {a} + ({b} - {a}) * {t} when {t} < {d(0.5)} then {a} + ({m} - {a}) * ({t} * {d(2.0)}) "
        f"else {m} + ({b} - {m}) * ({t} * {d(2.0)} - {d(1.0)}) end"
    )


def exposed(src: str) -> str:
    keys = "lat, lng, rank, variant"
    legs = f"""(select {keys}, lat as la, lng as lo, to_lat as lb, to_lng as lp from {src} where variant = 0
      union all select {keys}, lat, lng, {MID_LAT}, {MID_LNG} from {src} where variant <> 0 union all select {keys}, {MID_LAT}, {MID_LNG}, to_lat, to_lng from {src} where variant <> 0)"""
    return f"""select w.*, danger_cells, total_cells, danger_ids from {src} as w join (
      select b.lat, b.lng, b.rank, b.variant, count(x.q) as danger_cells, count(*) as total_cells,
        coalesce(list(x.q || '_' || x.r order by x.q || '_' || x.r) filter (x.q is not null), []) as danger_ids from {crossed(legs, keys)} as b
      left join dangercells as x on x.q = b.q and x.r = b.r group by 1, 2, 3, 4) as e
      on e.lat = w.lat and e.lng = w.lng and e.rank = w.rank and e.variant = w.variant"""


part("dangercells", "select q, r from dayscores where strategic_tier in ('red', 'orange')")
part("ways", "select *, 0 as variant from candidates")
part("direct", exposed("ways"))
part("bestdirect", "select * from direct qualify row_number() over (partition by lat, lng order by danger_cells, rank) = 1")
part(
    "sides",
    "select * exclude (variant, danger_cells, total_cells, danger_ids), unnest([1, -1]) as variant from bestdirect where danger_cells > 0",
)
part("bentways", exposed("sides"))
part(
    "chosen",
    """select * from (select lat, lng, rank, name, country, to_lat, to_lng, distance_km, variant, danger_cells, total_cells, danger_ids from bestdirect
    union all select lat, lng, rank, name, country, to_lat, to_lng, distance_km, variant, danger_cells, total_cells, danger_ids from bentways) as u
    qualify row_number() over (partition by lat, lng order by danger_cells, case variant when 0 then 0 when 1 then 1 else 2 end) = 1""",
)
KM = hu(
    f"case when variant = 0 then {haversine('lat', 'lng', 'to_lat', 'to_lng')} else {haversine('lat', 'lng', MID_LAT, MID_LNG)} "
    f"+ {haversine(MID_LAT, MID_LNG, 'to_lat', 'to_lng')} end",
    1,
)
part(
    "shelter",
    f"""select to_lat, to_lng, name as nearest_facility, {hu('km', 1)} as facility_km from
    (select g.to_lat, g.to_lng, p.name, {hu(haversine('g.to_lat', 'g.to_lng', 'p.lat', 'p.lng'))} as km
     from (select distinct to_lat, to_lng from chosen) as g, safefacilities as p) as s
    qualify row_number() over (partition by to_lat, to_lng order by km, name) = 1""",
)

# Evaluation ----------------------------------------------------------------------------------------------------------


def auc(src: str, by: str) -> str:
    return f"""select {by}, case when sum(pos) * sum(n - pos) > 0 then sum((n - pos) * (above + pos / {d(2.0)})) / cast(sum(pos) * sum(n - pos) as double) end as roc_auc
    from (select *, coalesce(sum(pos) over (partition by {by} order by strategic_score desc rows between unbounded preceding and 1 preceding), 0) as above
      from (select {by}, strategic_score, count(*) as n, sum(label) as pos from {src} group by all) as a0) as a1 group by {by}"""


def ap(src: str, by: str) -> str:
    return f"""select {by}, case when sum(pos) > 0 then sum(pos * prec) / cast(sum(pos) as double) end as average_precision
    from (select *, sum(pos) over w / cast(sum(n) over w as double) as prec
      from (select {by}, strategic_score, count(*) as n, sum(label) as pos from {src} group by all) as p0
      window w as (partition by {by} order by strategic_score desc)) as p1 group by {by}"""


def sweep(src: str, thresholds, by: str = "") -> str:
    grid = "(values " + ", ".join(f"({d(t)})" for t in thresholds) + ") as g(threshold)"
    b, on = (f"{by}, ", f"using ({by})") if by else ("", "on true")
    prec, rec = f"true_alerts / cast(alerts as double)", f"coalesce(true_alerts / nullif(cast(positives as double), 0), 0)"
    return f"""select {b}threshold, alerts, {prec} as precision, {rec} as recall,
    {d(2.0)} * true_alerts / cast(alerts + positives as double) as f1, alerts / cast(span as double) as alerts_per_day
    from (select {b}threshold, count(*) as alerts, cast(sum(label) as bigint) as true_alerts from {src} as x, {grid}
      where strategic_score >= threshold group by all) as h
    join (select {b}cast(sum(label) as bigint) as positives, greatest(max(event_date) - min(event_date), 1) as span from {src} group by all) as t {on}"""


ROUND_SWEEP = f"threshold, alerts, {hu('precision')} as precision, {hu('recall')} as recall, {hu('f1')} as f1, {hu('alerts_per_day')} as alerts_per_day"
part("active", "select * from labelled where dangerous_roll14d > 0 or dangerous_lag1 > 0 or neighbor_danger_avg > 0")
part("ascores", f"select *, {linear(digits=9)} as strategic_score from active")
part("placed", "select *, row_number() over (order by event_date, q, r) - 1 as position, count(*) over () as n_rows from labelled")
part("atest", f"""select * from (select *, row_number() over (order by event_date, q, r) - 1 as position, count(*) over () as n_rows from active) as a
  where position >= floor(n_rows * {d(0.9)})""")
part(
    "blocks",
    """select *, case when position < n_rows - 5 * (n_rows // 6) then 0 else (position - (n_rows - 5 * (n_rows // 6))) // greatest(n_rows // 6, 1) + 1 end as block
    from (select *, row_number() over (order by event_date, q, r) - 1 as position, count(*) over () as n_rows from ascores) as b""",
)

# Checks --------------------------------------------------------------------------------------------------------------

oracle("s1_read_conflict_events", """select event_date, event_type, count(*) as rows,
  cast(sum(case when event_id % 50 = 0 then 0 else fatalities end) as double) as fatalities, count(actor1) as known_actors
  from conflict where event_id % 97 <> 0 group by 1, 2""")
oracle("s2_read_news_events", """select event_date, count(*) as rows, sum(articles) as articles, sum(tone) as tone, cast(sum(code) as bigint) as codes
  from news where lat between 29.5 and 37.5 and lng between 33.5 and 42.5 group by 1""")
oracle("s3_read_thermal", f"select event_date, count(*) as rows, {hu('max(frp)')} as max_frp from thermal group by 1")
oracle("s4_read_weather_daily", f"select grid_lat, grid_lon, event_date, temp_max, {hu('temp_mean')} as temp_mean, precip_mm from weather")
oracle("s5_read_facilities", f"select name, type, {hu('lat')} as lat, {hu('lng')} as lng, capacity, notes from facilities")
oracle("s6_read_feature_table", f"""select cell, event_date, event_count, {hu('gdelt_hostility')} as gdelt_hostility, firms_spike,
  {hu('temp_max')} as temp_max, {hu('dangerous_roll14d')} as dangerous_roll14d from feat""")
oracle("s7_write_feature_table", "select event_date, count(*) as rows, cast(sum(event_count) as bigint) as event_count from panel group by 1")
oracle("s8_upsert_scores", """select cell, strategic_score, strategic_tier, tactical_score, scored_at from (
  select cell, strategic_score, strategic_tier, tactical_score, cast(event_date as varchar) as scored_at, event_date from history
  where event_date = date '2024-01-20' union all select cell, strategic_score, strategic_tier, tactical_score, cast(event_date as varchar), event_date from history
  where event_date > date '2024-01-20' and strategic_tier in ('red', 'orange')) as u
  qualify row_number() over (partition by cell order by event_date desc) = 1""")
oracle("s9_patch_column", """select cell || '@' || event_date as cell, tactical_tier,
  case when tactical_tier = 'DANGER' then 'see ' || tactical_triggers end as alert_text from history""")
oracle("s10_build_cell_grid", "select cell, q, r, lat, lng from grid")
oracle("s11_facility_layer", """select name, type,
  case type when 'hospital' then '🏥' when 'un_shelter' then '🇺🇳' when 'red_cross' then '⛑️' when 'evacuation_point' then '✈️' else '🛂' end as emoji,
  case type when 'hospital' then '#ff4444' when 'un_shelter' then '#4488ff' when 'red_cross' then '#ff6666' when 'evacuation_point' then '#ffaa33' else '#aa66cc' end as color
  from facilities""")
oracle("s12_write_metrics", f"""select threshold, alerts, {hu('precision')} as precision, {hu('recall')} as recall, {hu('f1')} as f1
  from ({sweep('lscores', REPORT_THRESHOLDS)}) as s order by s.f1 desc, threshold limit 1""")
oracle("s13_read_scores", "select cell, strategic_score, strategic_tier from state")

oracle("p1_filter_precision", "select event_id, geo_precision, event_type, fatalities from conflict where geo_precision <= 2")
oracle("p2_filter_bbox", f"select origin_id, {hu('lat')} as lat, {hu('lng')} as lng from origins where lat between 33.2 and 34.1 and lng between 35.45 and 36.5")
oracle("p3_flag_dangerous", f"select event_id, event_type, sub_event_type, {DANGEROUS} as is_dangerous from conflict")
oracle("p4_flag_types", f"select event_id, {FLAGS} from conflict")
oracle("p5_actor_pair", f"select event_id, {PAIR} as actor_pair from conflict")
oracle("p6_hex_cell", f"select origin_id, {ID}, q, r from {celled('origins')} as o")
part("ocells", f"select distinct q, r from {celled('origins')} as o")
oracle("p7_cell_center", f"select {ID}, {hu(center()[0])} as lat, {hu(center()[1])} as lng from ocells")


def corner(dx: float, dy: float) -> str:
    lat, lng = center()
    x, y = f"{lng} + {d(dx * EDGE_KM / KM_PER_DEG_LNG)}", f"{lat} + {d(dy * EDGE_KM / KM_PER_DEG_LAT)}"
    one = [f"cast(cast(floor(({v}) * {d(1e6)} + {d(0.5)}) as bigint) as varchar)" for v in (x, y)]
    return f"{one[0]} || ',' || {one[1]}"


oracle("p8_cell_boundary", f"select {ID}, concat_ws(';', {', '.join(corner(*c) for c in (*CORNERS, CORNERS[0]))}) as ring from ocells")
oracle("s11_geojson_cells", f"""select cell, 'Feature' as type, 'Polygon' as shape, strategic_tier, cast(7 as int) as corners, concat_ws(';', {', '.join(corner(*c) for c in (*CORNERS, CORNERS[0]))}) as ring from dayscores""")
oracle("s11_geojson_points", f"select name, 'Feature' as type, 'Point' as shape, kind, {hu('lng')} as lng, {hu('lat')} as lat from places")
oracle("p9_cell_neighbors", f"select {ID}, (q + dq) || '_' || (r + dr) as neighbor from ocells, {OFFSETS}")
HOSTILITY = f"least(greatest(-tone, {d(0.0)}) / {d(20.0)}, {d(1.0)})"
oracle("p10_hostility", f"select id, {hu('tone')} as tone, {hu(HOSTILITY)} as hostility from news")
oracle("p11_thermal_spike", f"select event_date, firms_hotspot_count as hotspots, firms_spike as spike, {ID} from tday")
oracle("p12_strategic_tier", f"select cell, event_date, strategic_score, {tier('strategic_score')} as strategic_tier from lscores")
oracle("p13_tactical_score", "select cell, event_date, tactical_score from history")
oracle("p14_tactical_level", "select cell, event_date, tactical_tier, should_alert from history")
oracle("p15_tactical_triggers", "select cell, event_date, tactical_triggers from history")
oracle("p16_model_band", f"select {ladder('strategic_score', risk.BANDS, 'null')} as band, count(*) as rows from lscores group by 1")
_raw, _text = rules({"host": "gdelt_hostility", "tone": "gdelt_avg_tone", "near": "neighbor_danger_avg", "model": "strategic_score"})
oracle("p17_score_table", f"""select cell, event_date, {hu('raw', 3)} as tactical_score, {LEVEL} as tactical_tier, raw >= {d(0.75)} as should_alert,
  tactical_triggers from (select *, {_raw} as raw, {_text} as tactical_triggers from lscores) as s""")
oracle("p18_align_features", f"""select cell, event_date, cast(event_count as double) as event_count, {d(0.0)} as not_in_table,
  {hu('gdelt_hostility')} as gdelt_hostility from labelled""")
oracle("p19_filter_active", "select cell, event_date, label from active")
oracle("p20_split_triggers", f"select t as trigger, count(*) as times from (select unnest({SIGNALS}) as t from history) as u group by 1")
oracle("p21_tier_description", "select strategic_tier, count(*) as rows, case "
  + " ".join(f"when strategic_tier = '{n}' then '{t}'" for n, t in risk.TIER_TEXT.items()) + " end as description from history group by 1")
oracle("p22_cell_text", f"""select cell, event_date, case when len(s) > 0 then 'Risk signals detected near this location: ' || array_to_string(s[1:2], '; ') || '.'
  else 'This area carries a ' || strategic_tier || ' risk level based on historical conflict patterns in the region.' end as narrative
  from (select *, {SIGNALS} as s from history) as h""")
oracle("p23_slice_day", "select cell, event_date, event_count, dangerous_count from feat where event_date = date '2024-01-20'")
_stops = risk.OPACITY_STOPS
_opacity = f"case when strategic_score < {d(0.54)} then {d(0.0)} " + " ".join(
    f"when strategic_score < {d(x1)} then {d(y0)} + (strategic_score - {d(x0)}) * {d((y1 - y0) / (x1 - x0))}" for (x0, y0), (x1, y1) in zip(_stops, _stops[1:])
) + f" else {d(_stops[-1][1])} end"
_channel = lambda c, i: int(c[2 * i + 1 : 2 * i + 3], 16)
_colors = [
    f"when strategic_score < {d(x1)} then '#' || " + " || ".join(
        f"printf('%02x', cast(floor({d(float(_channel(c0, i)))} + (strategic_score - {d(x0)}) / {d(x1 - x0)} * {d(float(_channel(c1, i) - _channel(c0, i)))} + {d(0.5)}) as int))" for i in range(3)
    ) for (x0, c0), (x1, c1) in zip(risk.COLOR_STOPS, risk.COLOR_STOPS[1:])
]
oracle("p24_heat_style", f"""select cell, event_date, {hu(_opacity)} as opacity,
  case when strategic_score < {d(0.54)} then 'rgba(0,0,0,0)' {" ".join(_colors)} else '{risk.COLOR_STOPS[-1][1]}' end as color from history""")
oracle("p25_score_record", "select cell, strategic_score, strategic_tier, tactical_score, cast(null as varchar) as alert_text, event_date as scored_on from state")

oracle("a1_agg_conflict_day", f"select * exclude (q, r), {ID} from cday")
oracle("a2_agg_news_day", f"""select event_date, gdelt_event_count, {hu('gdelt_avg_tone')} as gdelt_avg_tone, {hu('gdelt_min_goldstein')} as gdelt_min_goldstein,
  {hu('gdelt_avg_goldstein')} as gdelt_avg_goldstein, gdelt_num_articles, {hu('gdelt_hostility')} as gdelt_hostility, {ID} from nday""")
oracle("a3_agg_thermal_day", f"""select event_date, firms_hotspot_count, {hu('firms_avg_frp')} as firms_avg_frp, {hu('firms_max_frp')} as firms_max_frp,
  firms_spike, {ID} from tday""")
oracle("a4_agg_news_class_day", f"""select event_date, gdelt_protest_count, gdelt_threaten_count, gdelt_assault_count, gdelt_fight_count,
  gdelt_cameo_conflict, {ID} from nday""")
oracle("a5_label_balance", f"select event_date, count(*) as rows, {hu('avg(cast(label = 1 as int))')} as share from labelled group by 1")
oracle("a5_news_coverage", f"select count(*) as rows, {hu('avg(cast(gdelt_event_count > 0 as int))')} as share from feat")
oracle("a6_profile", "select count(*) as rows, count(distinct cell) as cells, min(event_date) as min_date, max(event_date) as max_date from feat")
oracle("a7_date_range", "select min(event_date) as min_date, max(event_date) as max_date from conflict")
oracle("a8_class_weight", f"""select neg, pos, {hu('neg / cast(pos as double)')} as weight from
  (select count(*) filter (label = 0) as neg, count(*) filter (label = 1) as pos from active) as c""")
TIER_COUNTS = ", ".join(f"count(*) filter (strategic_tier = '{t}') as {t}" for t in risk.ALL_TIERS)
oracle("a9_tier_counts", f"select {TIER_COUNTS} from state")
part(
    "areas",
    f"""select s.lat, s.lng, g.cell, x.strategic_score, x.strategic_tier, x.tactical_triggers, x.event_date
    from spots as s, grid as g, state as x where x.cell = g.cell and {hu(haversine('s.lat', 's.lng', 'g.lat', 'g.lng'))} <= 80""",
)
_mean = hu(f"cast(sum(cast(floor(strategic_score * {d(10000.0)} + {d(0.5)}) as bigint)) as double) / count(*) / {d(10000.0)}")
part(
    "areasum",
    f"""select * from spots left join (select lat, lng, count(*) as monitored_cells, count(*) as hex_count, {_mean} as avg_strategic,
    max(strategic_score) as max_strategic, max(event_date) as latest_scored_at, {TIER_COUNTS} from areas group by lat, lng) as n using (lat, lng)
    left join (select lat, lng, string_agg(trigger, ' | ' order by times desc, trigger) as top_triggers from
      (select lat, lng, trigger, times, row_number() over (partition by lat, lng order by times desc, trigger) as i from
        (select lat, lng, trigger, count(*) as times from (select lat, lng, trim(unnest(string_split(tactical_triggers, ' | '))) as trigger from areas) as u
         group by all) as c) as k where i <= 5 group by lat, lng) as t using (lat, lng)""",
)
oracle("a10_area_summary", f"select * replace ({hu('lat')} as lat, {hu('lng')} as lng) from areasum")
oracle("a11_top_triggers", """select event_date, trigger, times, cast(row_number() over (partition by event_date order by times desc, trigger) as int) as rank from
  (select event_date, trigger, count(*) as times from (select event_date, trim(unnest(string_split(tactical_triggers, ' | '))) as trigger from history) as u group by all) as c
  qualify row_number() over (partition by event_date order by times desc, trigger) <= 5""")
oracle("a12_cluster_summary", f"select * exclude (first_triggers) from ({cluster_numbers('clusters', 'cluster_id')}) as c")
oracle("a13_cluster_center", f"select cluster_id, {hu(f'avg({center()[0]})')} as center_lat, {hu(f'avg({center()[1]})')} as center_lng from clusters group by 1")
oracle("a14_monthly_p90", f"select grid_lat, grid_lon, cast(month(event_date) as int) as month, {hu('quantile_cont(precip_mm, 0.9)')} as p90 from weather group by 1, 2, 3")
oracle("a15_threshold_sweep", f"select {ROUND_SWEEP} from ({sweep('lscores', REPORT_THRESHOLDS)}) as s")
oracle("a16_roc_auc", f"select event_date, {hu('roc_auc')} as roc_auc from ({auc('lscores', 'event_date')}) as s")
oracle("a17_average_precision", f"select event_date, {hu('average_precision')} as average_precision from ({ap('lscores', 'event_date')}) as s")
oracle("a18_best_point", f"""select event_date, {ROUND_SWEEP} from (select * from ({sweep('lscores', FINE_THRESHOLDS, 'event_date')}) as s
  qualify row_number() over (partition by event_date order by f1 desc, threshold) = 1) as b""")
part(
    "twomodels",
    f"""select event_date, label, strategic_score, 'standard' as model from ascores
    union all select event_date, label, {hu('least(dangerous_roll7d, 1.0)', 4)}, 'focal' from ascores""",
)
oracle("a18_pick_winner", f"""select model, threshold, {hu('f1')} as f1 from ({sweep('twomodels', REPORT_THRESHOLDS, 'model')}) as s
  order by s.f1 desc, case when model = 'focal' then 0 else 1 end, threshold limit 1""")
oracle("a19_active_summary", f"""select rows, active_rows, positives, active_positives, {hu('active_rows / cast(rows as double)')} as active_share,
  {hu('active_positives / cast(active_rows as double)')} as active_label_rate,
  {hu('(positives - active_positives) / cast(rows - active_rows as double)')} as quiet_label_rate,
  {hu('active_positives / cast(positives as double)')} as captured_share from (select count(*) as rows, count(*) filter (a) as active_rows,
  count(*) filter (label = 1) as positives, count(*) filter (a and label = 1) as active_positives from
  (select label, dangerous_roll14d > 0 or dangerous_lag1 > 0 or neighbor_danger_avg > 0 as a from labelled) as f) as g""")
part("vblocks", "select * from blocks where block > 0")
oracle("a20_cv_summary", f"""select {hu('avg(roc_auc)')} as mean_roc_auc, {hu('avg(average_precision)')} as mean_average_precision,
  {hu('stddev_pop(roc_auc)')} as std_roc_auc, {hu('stddev_pop(average_precision)')} as std_average_precision
  from ({auc('vblocks', 'block')}) as a join ({ap('vblocks', 'block')}) as p using (block)""")
oracle("a21_alerts_per_day", f"select threshold, alerts, {hu('alerts_per_day')} as alerts_per_day from ({sweep('lscores', COARSE_THRESHOLDS)}) as s")
oracle("a23_tier_timeline", f"select event_date, {TIER_COUNTS} from history group by 1")

ROLL_NAMES = [f"{n}_roll{k}d" for k in (3, 7, 14) for n in ROLL]
oracle("w1_rolling_means", f"select event_date, {', '.join(f'{hu(c)} as {c}' for c in ROLL_NAMES)}, {ID} from (select *, {ROLLS} from panel) as p")
oracle("w2_deltas", f"select event_date, {DELTAS}, {ID} from panel")
VELOCITIES = ("dangerous_velocity", "fatality_velocity", "actor_pair_velocity")
oracle("w3_velocity", f"""select event_date, {', '.join(f'{hu(c)} as {c}' for c in VELOCITIES)}, {ID} from
  (select *, {VELOCITY} from (select *, {ROLLS}, {ACTOR_ROLL} from panel) as p) as v""")
oracle("w4_actor_roll", f"select event_date, {hu('actor_pair_roll14d')} as actor_pair_roll14d, {ID} from (select *, {ACTOR_ROLL} from panel) as p")
oracle("w5_fill_static", f"select event_date, {FILL}, {ID} from panel")
oracle("w6_label_lookahead", f"select event_date, {LABEL}, {ID} from panel")
oracle("w7_drop_tail", f"select event_date, event_count, {ID} from (select *, {LEFT} from panel) as p where left_days > 3")
oracle("w8_temporal_lags", f"select event_date, {LAGS}, {ID} from panel")
oracle("w9_temp_anomaly", f"select grid_lat, grid_lon, event_date, {hu('temp_anomaly_30d')} as temp_anomaly_30d from weatherf")
_known = {"event_count": "event_count > 0", "gdelt_hostility": "gdelt_event_count > 0", "firms_max_frp": "firms_hotspot_count > 0"}
oracle("w10_latest_per_cell", f"""select cell, max(event_date) as event_date, arg_max(event_count, event_date) filter (event_count > 0) as event_count,
  {hu('arg_max(gdelt_hostility, event_date) filter (gdelt_event_count > 0)')} as gdelt_hostility,
  {hu('arg_max(firms_max_frp, event_date) filter (firms_hotspot_count > 0)')} as firms_max_frp from feat group by cell""")
oracle("w11_latest_k", f"""select {ID}, cast(row_number() over (partition by q, r order by event_date desc, event_id desc) as int) as rank, event_id, event_date,
  event_type, fatalities, actor1 from crows qualify row_number() over (partition by q, r order by event_date desc, event_id desc) <= 4""")
oracle("w12_running_best", f"""select threshold, {hu('f1')} as f1,
  f1 > coalesce(max(f1) over (order by threshold rows between unbounded preceding and 1 preceding), -1) as best_so_far
  from ({sweep('lscores', FINE_THRESHOLDS)}) as s""")

oracle("j1_build_panel", f"select * exclude (q, r), {ID} from panel")
oracle("j2_attach_features", f"""select event_date, event_count, gdelt_event_count, {hu('gdelt_avg_tone')} as gdelt_avg_tone,
  {hu('gdelt_min_goldstein')} as gdelt_min_goldstein, gdelt_num_articles, {hu('gdelt_hostility')} as gdelt_hostility, {ID} from joined""")
oracle("j3_spatial_lag", f"""select p.event_date, {', '.join(hu(f'coalesce({c}, 0)') + f' as {c}' for c in LAGGED)}, p.q || '_' || p.r as cell
  from panel as p left join lagged as g on g.q = p.q and g.r = p.r and g.event_date = p.event_date""")
oracle("j4_nearest_grid", f"""select {ID}, {hu(GRID_LAT)} as grid_lat, {hu(GRID_LON)} as grid_lon from (select distinct q, r from
  {celled('origins')} as x) as y""")
oracle("j5_radius_join", f"""select * from (select f.name, g.cell, {hu(haversine('f.lat', 'f.lng', 'g.lat', 'g.lng'))} as distance_km
  from facilities as f, grid as g) as x where distance_km <= 25""")
oracle("j6_enrich_scores", f"""select f.name, f.cell, s.strategic_score, s.strategic_tier, s.tactical_tier from
  (select name, {ID} from {celled('facilities')} as c) as f left join state as s on s.cell = f.cell""")
oracle("j7_evac_candidates", f"select {hu('lat')} as lat, {hu('lng')} as lng, rank, name, distance_km from candidates")
_t250 = f"(seq / {d(249.0)})"
_j8 = f"""(select route_id, plat as la, plng as lo, lead(plat) over w as lb, lead(plng) over w as lp from
  (select cast(cast(floor(lat * 100 + 0.5) as bigint) as varchar) || ',' || cast(cast(floor(lng * 100 + 0.5) as bigint) as varchar) as route_id, seq,
   lat + (to_lat - lat) * {_t250} as plat, lng + (to_lng - lng) * {_t250} as plng from candidates, generate_series(0, 249) as g(seq) where rank = 1) as p0
  window w as (partition by route_id order by seq) qualify lb is not null)"""
oracle("j8_route_exposure", f"""select b.route_id, count(x.q) as danger_cells, count(*) as total_cells from {crossed(_j8, 'route_id')} as b
  left join dangercells as x on x.q = b.q and x.r = b.r group by 1""")
oracle("j9_nearest_facility", f"""select {hu('lat')} as lat, {hu('lng')} as lng, name, type, km as distance_km from (select s.lat, s.lng, p.name, p.type,
  {hu(haversine('s.lat', 's.lng', 'p.lat', 'p.lng'))} as km from spots as s, safefacilities as p) as x
  qualify row_number() over (partition by lat, lng order by km, name) = 1""")
oracle("j10_tier_clusters", "select cell, strategic_tier, cluster_id from clusters")
oracle("j11_seed_cluster", "select seed, cell, hop, rank from seeds")
oracle("j12_missing_days", """select event_date from (select cast(unnest(generate_series(min(event_date) - 5, max(event_date) + 3, interval 1 day)) as date) as event_date
  from conflict) as w where event_date not in (select event_date from conflict)""")
part(
    "detail",
    """select s.cell, s.strategic_score, s.strategic_tier, s.tactical_score, n.event_date as news_date, n.gdelt_event_count as news_gdelt_event_count,
    n.gdelt_hostility as news_hostility, t.event_date as thermal_date, t.firms_spike as thermal_firms_spike, t.firms_max_frp as thermal_max_frp, e.recent
    from state as s
    left join (select * from nday qualify row_number() over (partition by q, r order by event_date desc) = 1) as n on n.q = s.q and n.r = s.r
    left join (select * from tday qualify row_number() over (partition by q, r order by event_date desc) = 1) as t on t.q = s.q and t.r = s.r
    left join (select q, r, string_agg(event_date || ':' || event_type || ':' || fatalities, ';' order by event_date desc, event_id desc) as recent
      from (select * from crows qualify row_number() over (partition by q, r order by event_date desc, event_id desc) <= 4) as c group by q, r) as e
      on e.q = s.q and e.r = s.r""",
)
oracle("j13_cell_detail", "select cell, strategic_tier, news_date, news_gdelt_event_count, thermal_date, thermal_firms_spike, recent from detail")
oracle("j14_attach_weather", f"select event_date, event_count, {', '.join(f'{hu(c)} as {c}' if c != 'precip_spike' else c for c in WEATHER)}, cell from feat")
oracle("j15_annotate_timeline", f"""select t.event_date, red, orange, text, {hu('pct')} as pct from (select event_date, {TIER_COUNTS} from history group by 1) as t
  left join (select cast(e.dt as date) as event_date, e.text, (cast(e.dt as date) - lo) * {d(100.0)} / (hi - lo) as pct
    from (values ('2024-01-07', 'first mark'), ('2024-01-15', 'second mark'), ('2024-01-24', 'third mark')) as e(dt, text), bounds
    where cast(e.dt as date) between lo and hi) as k on k.event_date = t.event_date""")

_near = f"""select f.name, g.cell, {hu(haversine('f.lat', 'f.lng', 'g.lat', 'g.lng'))} as km, s.* exclude (cell)
  from facilities as f, grid as g left join state as s on s.cell = g.cell"""
oracle("k2_nearest_first", f"select name, cell, {hu('km * 1000', 3)} as distance_m, strategic_tier from ({_near}) as x where km <= 10")
oracle("k3_top5_candidates", f"select {hu('lat')} as lat, {hu('lng')} as lng, string_agg(name, ';' order by rank) as names from candidates group by candidates.lat, candidates.lng")
oracle("k4_best_route", f"select {hu('lat')} as lat, {hu('lng')} as lng, rank, name, danger_cells, total_cells from bestdirect")
oracle("k5_detour_choice", f"""select o.origin_id, c.variant, c.danger_cells, coalesce(c.km, 0) as distance_km from origins as o
  left join (select *, {KM} as km from chosen) as c on c.lat = o.lat and c.lng = o.lng""")
oracle("k6_time_position", "select cell, event_date, position, n_rows from placed")

oracle("u1_union_feeds", f"""select {ID}, event_date, event_count, cast(null as bigint) as gdelt_event_count, cast(null as bigint) as firms_hotspot_count, 'conflict' as feed from cday
  union all select {ID}, event_date, null, gdelt_event_count, null, 'news' from nday
  union all select {ID}, event_date, null, null, firms_hotspot_count, 'thermal' from tday""")
oracle("u2_place_table", f"select name, {hu('lat')} as lat, {hu('lng')} as lng, country, kind from places")
oracle("u3_distinct_cells", f"select {ID} from cells")
oracle("u4_known_neighbors", f"""select c.q || '_' || c.r as cell, count(b.q) as neighbors from cells as c cross join {OFFSETS}
  left join cells as b on b.q = c.q + o.dq and b.r = c.r + o.dr group by 1""")

oracle("f1_haversine", f"select origin_id, {hu(haversine('lat', 'lng', d(33.8938), d(35.5018)), 4)} as km from origins")
oracle("f2_coercion", f"""select event_id, case when event_id % 5 <> 0 then {hu('value')} end as number,
  case when event_id % 7 <> 0 then cast(ts as date) end as day from events""")

oracle("m1_feature_groups", "select feature, filled from (select "
  + ", ".join(f"{hu(f'avg(cast({c} <> 0 as int))')} as {c}" for c in ALL_FEATURES)
  + " from labelled) as s unpivot (filled for feature in (" + ", ".join(ALL_FEATURES) + ")) as u")
oracle("m2_time_series_folds", """select cast(block as int) as block, count(*) as rows, min(position) as first, max(position) as last,
  cast(sum(label) as bigint) as positives from blocks group by 1""")
oracle("m3_time_holdout", f"select cell, event_date, case when position < floor(n_rows * {d(0.9)}) then 'train' else 'test' end as part from placed")
_p = f"least(greatest(strategic_score, {d(1e-7)}), {d(1.0 - 1e-7)})"
oracle("m5_focal_weight", f"""select cell, event_date, {hu(f"case when label = 1 then {d(0.25)} * pow({d(1.0)} - {_p}, 2) else {d(0.75)} * pow({d(1.0)} - ({d(1.0)} - {_p}), 2) end")} as weight from lscores""")
# What training promises whatever the trees are: the rows it is measured on, and that it has learnt something.
_TRAINED = "select count(*) as rows, cast(sum(label) as bigint) as positives, true as in_range, true as skilled, true as above_base_rate, true as has_trees"
oracle("m4_train_gbt", f"{_TRAINED} from atest")
oracle("m4_planted_label", "select true as skilled, true as above_base_rate")
oracle("m6_train_focal", f"{_TRAINED}, cast(400 as bigint) as trees from atest")
oracle("m7_predict", "select cell, event_date, true as in_range, true as tier_fits from atest")
oracle("m9_save_load", "select count(*) as rows, cast(0 as bigint) as differing from atest")
oracle("a22_feature_importance", "select feature, true as in_range, true as sums_to_one, true as past_tells from (values " + ", ".join(f"('{n}')" for n in ALL_FEATURES) + ") as f(feature)")
oracle("q2_train_and_evaluate", """select 'fold ' || block as subject, count(*) as rows, cast(sum(label) as bigint) as positives, true as in_range, true as rounds_run
  from blocks where block > 0 group by block
  union all select model, count(*), cast(sum(label) as bigint), true, true from atest, (values ('standard'), ('focal')) as m(model) group by model""")
# Five folds, their summary, two models and the winner.
oracle("q2_publish", "select count(*) as rows, cast(0 as bigint) as differing, true as best_f1_won, cast(9 as bigint) as report_subjects from atest")
oracle("m8_linear_score", "select cell, event_date, strategic_score from lscores")

oracle("t1_stream_cell_day", f"select event_date, event_count, dangerous_count, total_fatalities, max_fatalities, {ID} from cday")
oracle("t1_stream_versions", f"select event_date, event_count, dangerous_count, total_fatalities, max_fatalities, {ID} from cday")
oracle("t2_stream_score", """select h.cell, strategic_score, strategic_tier, tactical_score, tactical_tier from history as h
  join (select q, r, max(event_date) as newest from crows group by q, r) as c on c.q = h.q and c.r = h.r and c.newest = h.event_date""")
# Newest day that a cell or one of its neighbours reported, and the features of that day without the feeds a conflict stream lacks.
part("touchdays", f"""select q, r, max(event_date) as newest from (select q, r, event_date from crows
  union all select c.q + o.dq, c.r + o.dr, c.event_date from crows as c cross join {OFFSETS}) as t group by q, r""")
_OTHER_FEEDS = "gdelt_hostility gdelt_min_goldstein gdelt_avg_tone firms_hotspot_count firms_max_frp firms_spike".split()
part("touched", "select f.* replace (" + ", ".join(f"0 as {c}" for c in _OTHER_FEEDS) + ") from feat as f join touchdays as t on t.q = f.q and t.r = f.r and t.newest = f.event_date")
_STREAMED = [
    *COUNTS, "dangerous_delta", "fatality_delta", "actor_pair_delta", "dangerous_lag1", "dangerous_lag2", "fatalities_lag1", "battle_lag1", "explosion_lag1",
]
_STREAMED_MEANS = [
    *[f"{n}_roll{k}d" for k in (3, 7, 14) for n in ROLL], "actor_pair_roll14d", "dangerous_velocity", "fatality_velocity", "actor_pair_velocity",
    "neighbor_danger_avg", "neighbor_fatal_sum",
]
oracle("t2_stream_features", "select cell, event_date, " + ", ".join([*[f"cast({c} as bigint) as {c}" for c in _STREAMED], *[f"{hu(c)} as {c}" for c in _STREAMED_MEANS]]) + " from touched")


def alert_text(signals: str) -> str:
    """Text of a cell at DANGER: its first two signals."""
    found = f"list_filter(string_split({signals}, ' | '), lambda s: s <> 'No significant signals detected')"
    return f"case when tactical_tier = 'DANGER' then 'Risk signals detected near this location: ' || array_to_string(({found})[1:2], '; ') || '.' end as alert_text"


oracle("t2_stream_state", f"""select cell, strategic_score, strategic_tier, tactical_score, tactical_tier, {alert_text('tactical_triggers')}, event_date as day
  from ({scored('touched')}) as s""")
oracle("t3_new_alerts", """select cell, event_date, tactical_score from history where event_date > date '2024-01-15' and tactical_tier = 'DANGER'
  and cell not in (select cell from history where event_date <= date '2024-01-15' and tactical_tier = 'DANGER')""")
oracle("t4_replace_days", f"""select event_date, case when event_date between date '2024-01-10' and date '2024-01-12' then event_count + 100 else event_count end as event_count,
  {ID} from panel""")

oracle("q0_panel_label", f"""select event_date, event_count, dangerous_count, {hu('event_roll7d')} as event_roll7d, label, {ID} from
  (select *, {ROLLS}, {LABEL}, {LEFT} from panel) as p where left_days > 3""")
WHOLE = set(COUNTS) | {
    "gdelt_event_count", "gdelt_protest_count", "gdelt_threaten_count", "gdelt_assault_count", "gdelt_fight_count", "gdelt_cameo_conflict",
    "firms_hotspot_count", "firms_spike", "precip_spike", "dangerous_delta", "fatality_delta", "actor_pair_delta", "dangerous_lag1",
    "dangerous_lag2", "fatalities_lag1", "battle_lag1", "explosion_lag1",
}
oracle("q1_build_features", "select cell, event_date, label, "
  + ", ".join(c if c in WHOLE else f"{hu(c)} as {c}" for c in [*ALL_FEATURES, "actor_pair_roll14d"]) + " from labelled")
STATE = "cell, strategic_score, strategic_tier, tactical_score, tactical_tier, should_alert"
oracle("q3_score_latest", f"select {STATE}, tactical_triggers from state")
oracle("q3_run_scoring", f"select {STATE}, {alert_text('tactical_triggers')}, event_date as day from state")
oracle("q4_backtest_days", f"""select {STATE}, tactical_triggers, event_date, cast(event_date as varchar) as scored_at from history
  where event_date between date '2024-01-05' and date '2024-01-25'""")
oracle("q5_latest_state", f"select {STATE}, cast(event_date as varchar) as scored_at from state")
oracle("q5_stored_state", f"select {STATE}, cast(event_date as varchar) as scored_at from state")
oracle("q6_cell_detail", f"""select cell, strategic_score, strategic_tier, tactical_score, news_date, {hu('news_hostility')} as news_hostility, thermal_date,
  {hu('thermal_max_frp')} as thermal_max_frp, recent from detail""")
oracle("q7_cells_near", f"""select name, cell, {hu('km * 1000', 3)} as distance_m, {hu('strategic_score', 3)} as strategic_score, strategic_tier, tactical_tier,
  should_alert from ({_near}) as x where km <= 50""")
oracle("q8_area_report", """select origin_id, coalesce(hex_count, 0) as hex_count, avg_strategic, max_strategic, latest_scored_at, coalesce(red, 0) as red,
  coalesce(orange, 0) as orange, coalesce(yellow, 0) as yellow, coalesce(green, 0) as green, top_triggers,
  case when hex_count is null then 'No monitored hexes in this area.' end as note from origins join areasum using (lat, lng)""")
oracle("q9_cluster_report", cluster_full("clusters", "cluster_id"))
part("seeded", "select s.seed, x.* from seeds as s join dayscores as x on x.cell = s.cell")
oracle("q9_seed_cluster_report", cluster_full("seeded", "seed"))
oracle("q10_evac_plan", f"""select origin_id, coalesce(c.name, 'No safe destination found') as destination, country, coalesce(km, 0) as distance_km, danger_cells,
  total_cells, nearest_facility, facility_km, case when c.name is null then 'Unable to find a safe evacuation destination. All nearby cities are in danger zones.' else
  'Drive to ' || c.name || case when country <> '' then ', ' || country else '' end || ' (' || {fixed('km', 1)} || ' km, ~0 min).'
  || case when danger_cells > 0 then ' Caution: route crosses ' || danger_cells || ' active danger zone(s).' else '' end
  || case when nearest_facility is not null then ' Nearest facility: ' || nearest_facility || '.' else '' end
  || ' Travel during daylight. Bring ID, water, phone charger.' end as narrative
  from origins as o left join (select *, {KM} as km from chosen) as c on c.lat = o.lat and c.lng = o.lng
  left join shelter as s on s.to_lat = c.to_lat and s.to_lng = c.to_lng""")
part("goalways", f"""select lat, lng, cast(1 as int) as rank, 'Custom destination' as name, '' as country, {d(33.5138)} as to_lat, {d(36.2765)} as to_lng, 0 as variant
  from (select distinct lat, lng from origins where origin_id % 3 = 0) as o""")
part("goaldirect", exposed("goalways"))
part("goalsides", "select * exclude (variant, danger_cells, total_cells, danger_ids), unnest([1, -1]) as variant from goaldirect where danger_cells > 0")
part("goalbent", exposed("goalsides"))
part("goalchosen", """select * from (select * from goaldirect union all by name select * from goalbent) as u
  qualify row_number() over (partition by lat, lng order by danger_cells, case variant when 0 then 0 when 1 then 1 else 2 end) = 1""")
_way = f"""name, {KM} as km, danger_cells, total_cells, danger_ids, case when variant <> 0 then {hu(MID_LAT)} end as bend_lat, case when variant <> 0 then {hu(MID_LNG)} end as bend_lng"""
oracle("q10_custom_goal", f"""select origin_id, coalesce(name, 'No safe destination found') as destination, coalesce(km, 0) as distance_km, danger_cells, total_cells,
  array_to_string(danger_ids, ';') as danger_ids, bend_lat, bend_lng from origins as o left join (select lat, lng, true as own, {_way} from goalchosen
  union all select lat, lng, false, {_way} from chosen) as c on c.lat = o.lat and c.lng = o.lng and c.own = (o.origin_id % 3 = 0)""")
part("tested", f"select *, {linear(digits=9)} as strategic_score from placed where position >= floor(n_rows * {d(0.9)})")
part(
    "scopes",
    """select 'all' as scope, event_date, label, strategic_score from tested union all select 'active', event_date, label, strategic_score from tested
    where dangerous_roll14d > 0 or dangerous_lag1 > 0 or neighbor_danger_avg > 0""",
)
oracle("q11_threshold_study", f"""select scope, threshold, alerts, {hu('precision')} as precision, {hu('recall')} as recall, {hu('f1')} as f1, best_so_far,
  {hu('alerts / (select greatest(max(event_date) - min(event_date), 1) from tested)')} as alerts_per_day from (select *,
  f1 > coalesce(max(f1) over (partition by scope order by threshold rows between unbounded preceding and 1 preceding), -1) as best_so_far
  from ({sweep('scopes', FINE_THRESHOLDS, 'scope')}) as s) as b where recall >= 0.25""")
_profile = "count(*) as rows, count(distinct q || '_' || r) as cells, min(event_date) as min_date, max(event_date) as max_date, 36 - count(distinct event_date) filter (event_date between date '2023-12-30' and date '2024-02-02') - 1 as missing_days"
oracle("q12_coverage_report", " union all ".join(
    f"select {_profile}, '{n}' as stage from {src}"
    for n, src in (("conflict", "crows"), ("news", celled("news") + " as n"), ("thermal", celled("thermal") + " as t"), ("features", "feat"))
))
oracle("r1_straight_route", f"""select origin_id, variant as side, cast(seq as int) as seq,
  {hu(bent('lat', MID_LAT, 'to_lat', f"(seq / {d(10.0)})"))} as point_lat, {hu(bent('lng', MID_LNG, 'to_lng', f"(seq / {d(10.0)})"))} as point_lng
  from (select *, {d(33.8938)} as to_lat, {d(35.5018)} as to_lng, unnest([0, 1, -1]) as variant from origins) as o, generate_series(0, 10) as g(seq)""")
