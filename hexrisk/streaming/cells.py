"""Features of cells kept up to date by a stream of conflict events.

Every event goes to its cell, and its counts to the six cells around it, in the same batch. Tasks first add up what they
have per cell and day, so a busy cell sends few rows. Each cell has a keyed state: a ring of the last ``RING_DAYS`` days of
its own counts and its neighbours' sums, the actors seen on each of these days, its last known population, and which
neighbours exist. What comes out are feature rows as the batch job would compute them for the newest day that the cell or
a neighbour reported, for every cell that a batch touches.

Late events count while their day is in the ring; older ones only prove that the cell exists, and give a population if
none is known.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hexrisk.functions.grid import NEIGHBOR_OFFSETS, with_cell
from hexrisk.operators.panel import EPSILON, LAGS, ROLL_DAYS, ROLL_SOURCES

#: The longest mean reaches back 14 days; three more take late events.
RING_DAYS = 17
#: Counts that a ring holds per day: summed, greatest, counted distinct, and sums over the neighbours.
SUMS = ("event_count", "dangerous_count", "total_fatalities", "battle_count", "explosion_count", "vac_count", "riot_count")
TOPS = ("max_fatalities", "population_best")
SETS = {"unique_actors": "actor1", "actor_pair_count": "actor_pair"}
AROUND = ("around_dangerous", "around_fatalities")
CHANNELS = (*SUMS, *TOPS, *SETS, *AROUND)
SOURCES = {
    "event_count": "event_type", "dangerous_count": "is_dangerous", "total_fatalities": "fatalities", "battle_count": "is_battle",
    "explosion_count": "is_explosion", "vac_count": "is_vac", "riot_count": "is_riot", "max_fatalities": "fatalities", "population_best": "population_best",
}

DELTAS = {"dangerous_delta": "dangerous_count", "fatality_delta": "total_fatalities", "actor_pair_delta": "actor_pair_count"}
FEATURES = (
    *SUMS, *TOPS, *SETS, *[f"{n}_roll{d}d" for d in ROLL_DAYS for n in ROLL_SOURCES], "actor_pair_roll14d", *DELTAS, *LAGS,
    "dangerous_velocity", "fatality_velocity", "actor_pair_velocity", "neighbor_danger_avg", "neighbor_fatal_sum",
)
FEATURE_ROW = "q long, r long, event_date date, " + ", ".join(f"{c} double" for c in FEATURES)
MESSAGE = "q long, r long, day int, side int, " + ", ".join(f"{c} double" for c in (*SUMS, *TOPS)) + ", actors array<long>, pairs array<long>"
WHOLE = (*SUMS, *TOPS, *SETS, *DELTAS, *LAGS)
EPOCH = pd.Timestamp("1970-01-01")


def _hash_lists(values: pd.Series, group: np.ndarray, n: int) -> list[list[int]]:
    """Per group the 64-bit hashes of the values that are not null, each once."""
    # Rows without a day are in no group.
    known = values.notna().to_numpy() & (group >= 0)
    hashes, group = pd.util.hash_array(values[known].to_numpy(object), categorize=False).view(np.int64), group[known]
    order = np.lexsort((hashes, group))
    hashes, group = hashes[order], group[order]
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, ends = hashes[first].tolist(), np.cumsum(np.bincount(group[first], minlength=n)).tolist()
    return [hashes[begin:end] for begin, end in zip([0, *ends], ends, strict=False)]


def cell_messages(events: DataFrame) -> DataFrame:
    """What flagged events tell their cells (side -1) and the cells around (side: the direction they come from).

    Stateless, so it can run in a stream; rows of a task that concern one cell and day become one.
    """
    binned = with_cell(events).select("q", "r", F.datediff("event_date", F.lit("1970-01-01")).alias("day"), "event_type", "is_dangerous", "fatalities", "is_battle", "is_explosion", "is_vac", "is_riot", "population_best", "actor1", "actor_pair")

    def tell(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            groups = rows.groupby(["q", "r", "day"], sort=False)
            own = groups.agg(**{c: (SOURCES[c], "count" if c == "event_count" else "sum") for c in SUMS}, **{c: (SOURCES[c], "max") for c in TOPS})
            number = groups.ngroup().fillna(-1).to_numpy().astype(np.int64)
            own["actors"] = _hash_lists(rows["actor1"], number, len(own))
            own["pairs"] = _hash_lists(rows["actor_pair"], number, len(own))
            own = own.reset_index().assign(side=-1)
            none = [[] for _ in range(len(own))]
            # A direction is named by the way back, so the receiver knows which neighbour spoke.
            sent = [own.assign(q=own.q + dq, r=own.r + dr, side=NEIGHBOR_OFFSETS.index((-dq, -dr)), actors=none, pairs=none) for dq, dr in NEIGHBOR_OFFSETS]
            yield pd.concat([own, *sent])[[c.split()[0] for c in MESSAGE.split(", ")]]

    return binned.mapInPandas(tell, MESSAGE)


class Ring:
    """Counts of the last days of a cell, newest last."""

    def __init__(self, newest: int, values: np.ndarray):
        self.newest, self.values = newest, values

    @staticmethod
    def empty(newest: int) -> Ring:
        return Ring(newest, np.zeros((len(CHANNELS), RING_DAYS)))

    def place(self, day):
        """Column of a day, or of each of an array of days; negative if it has left the ring."""
        return RING_DAYS - 1 - (self.newest - day)

    def turn_to(self, day: int) -> np.ndarray:
        """Make ``day`` the newest one; returns the columns that leave."""
        step = day - self.newest
        if step <= 0:
            return np.zeros((len(CHANNELS), 0))
        gone = self.values[:, : min(step, RING_DAYS)].copy()
        self.values = np.concatenate([self.values[:, step:], np.zeros((len(CHANNELS), min(step, RING_DAYS)))], axis=1)
        self.newest = day
        return gone

    def of(self, channel: str) -> np.ndarray:
        return self.values[CHANNELS.index(channel)]


def feature_row(ring: Ring, population: float, known: int, first_day: int | None) -> dict[str, float]:
    """Features of the ring's newest day. Days before ``first_day``, if given, are no part of the time line."""
    days = RING_DAYS if first_day is None else max(1, min(RING_DAYS, ring.newest - first_day + 1))
    last = {c: ring.of(c)[-1] for c in CHANNELS}

    def ago(c: str, n: int) -> float:
        return ring.of(c)[-1 - n] if n < days else 0.0

    row = {c: last[c] for c in (*SUMS, *TOPS, *SETS)}
    seen = np.flatnonzero(ring.of("population_best"))
    row["population_best"] = ring.of("population_best")[seen[-1]] if len(seen) else population
    for n in ROLL_DAYS:
        for name, c in ROLL_SOURCES.items():
            row[f"{name}_roll{n}d"] = ring.of(c)[-min(n, days) :].mean()
    row["actor_pair_roll14d"] = ring.of("actor_pair_count")[-min(14, days) :].mean()
    for name, c in DELTAS.items():
        row[name] = last[c] - ago(c, 1) if days > 1 else 0.0
    for name, (c, n) in LAGS.items():
        row[name] = ago(c, n)
    row["dangerous_velocity"] = last["dangerous_count"] / (row["dangerous_roll14d"] + EPSILON)
    row["fatality_velocity"] = last["total_fatalities"] / (row["fatalities_roll14d"] + EPSILON)
    row["actor_pair_velocity"] = last["actor_pair_count"] / (row["actor_pair_roll14d"] + EPSILON)
    row["neighbor_danger_avg"] = last["around_dangerous"] / known if known else 0.0
    row["neighbor_fatal_sum"] = last["around_fatalities"]
    return row


class CellState(StatefulProcessor):
    """Keyed by cell (``q``, ``r``); input are messages, output are feature rows of cells that exist."""

    def __init__(self, first_day: int | None = None):
        self.first_day = first_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Everything in one value: a cell costs one read and one write a batch, however many days it reports.
        schema = "newest int, values array<double>, population double, exists boolean, around int, days array<int>, actors array<array<long>>, pairs array<array<long>>"
        self.cell = handle.getValueState("cell", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        column = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in ("day", "side", *SUMS, *TOPS, "actors", "pairs")}
        days, own = column["day"], column["side"] < 0
        newest = int(days.max())
        ring, population, exists, around, seen = Ring.empty(newest), 0.0, False, 0, {}
        before = self.cell.get() if self.cell.exists() else None
        if before is not None:
            ring = Ring(int(before[0]), np.array(before[1]).reshape(len(CHANNELS), RING_DAYS))
            population, exists, around = before[2:5]
            seen = {int(d): (a, p) for d, a, p in zip(*before[5:], strict=True)}
        for gone in ring.turn_to(newest)[CHANNELS.index("population_best")]:
            population = gone or population
        exists = bool(exists or own.any())
        for side in np.unique(column["side"][~own]).tolist():
            around |= 1 << side
        at = ring.place(days)
        if not population:
            late = np.flatnonzero(own & (at < 0))
            by_day = (np.fmax.reduce(column["population_best"][late[days[late] == d]]) for d in np.unique(days[late]))
            population = float(next((v for v in by_day if v), 0.0))
        inside = np.flatnonzero(~own & (at >= 0))
        for c, source in zip(AROUND, ("dangerous_count", "total_fatalities"), strict=True):
            np.add.at(ring.of(c), at[inside], column[source][inside])
        inside = np.flatnonzero(own & (at >= 0))
        for c in SUMS:
            np.add.at(ring.of(c), at[inside], column[c][inside])
        for c in TOPS:
            np.fmax.at(ring.of(c), at[inside], column[c][inside])
        for i in inside.tolist():
            day, told = int(days[i]), (column["actors"][i], column["pairs"][i])
            seen[day] = tuple(set(map(int, b)).union(map(int, v)) for b, v in zip(seen.get(day, ((), ())), told, strict=True))
        for day in {int(days[i]) for i in inside}:
            for c, values in zip(SETS, seen[day], strict=True):
                ring.of(c)[ring.place(day)] = len(values)
        seen = {d: v for d, v in sorted(seen.items()) if ring.place(d) >= 0}
        sets = [[sorted(v[i]) for v in seen.values()] for i in (0, 1)]
        self.cell.update((ring.newest, ring.values.ravel().tolist(), float(population), exists, around, list(seen), *sets))
        if exists:
            date = (EPOCH + pd.Timedelta(days=ring.newest)).date()
            yield pd.DataFrame([{"q": key[0], "r": key[1], "event_date": date, **feature_row(ring, population, around.bit_count(), self.first_day)}])


def stream_features(events: DataFrame, first_day: str | None = None) -> DataFrame:
    """Feature rows of all cells a batch touches, from a stream of flagged conflict events (``event_date``, ``lat``, ``lng``, …).

    Needs the RocksDB state store. ``first_day`` is the first day of the time line, where means have fewer days.
    """
    first = None if first_day is None else (pd.Timestamp(first_day) - EPOCH).days
    rows = cell_messages(events).groupBy("q", "r").transformWithStateInPandas(CellState(first), FEATURE_ROW, "Update", "None")
    return rows.withColumns({c: F.col(c).cast("long") for c in WHOLE})
