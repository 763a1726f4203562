"""Hexagonal cells of about 36 km2 on an equirectangular plane.

A cell is a pair of axial coordinates ``(q, r)``; its text id is ``q_r``. All maps are plain arithmetic, so binning,
neighbours and outlines need neither a lookup table nor a UDF; only the cells along a way are found in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the grid.
KM_PER_DEG_LAT = 111.195
KM_PER_DEG_LNG = 92.784
EDGE_KM = 3.722
SQRT3 = 1.7320508075688772
INV_SQRT3 = 0.5773502691896258
NEIGHBOR_OFFSETS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
# Corner i of a pointy-top hexagon in units of the edge, counter-clockwise from the lower right.
HALF_SQRT3 = 0.8660254037844386
CORNERS = ((HALF_SQRT3, -0.5), (HALF_SQRT3, 0.5), (0.0, 1.0), (-HALF_SQRT3, 0.5), (-HALF_SQRT3, -0.5), (0.0, -1.0))

#: Cells of the ways that are worked out at once.
LIST_CELLS = 1_000_000

_SHIFT = 4294967296
_OFFSET = 2147483648


def _nearest(v: Column) -> Column:
    return F.floor(v + F.lit(0.5))


def _axial(lat: Column, lng: Column, edge_km: float) -> tuple[Column, Column]:
    """Fractional axial coordinates of a point."""
    x = lng * F.lit(KM_PER_DEG_LNG)
    y = lat * F.lit(KM_PER_DEG_LAT)
    return (F.lit(INV_SQRT3) * x - y / F.lit(3.0)) / F.lit(edge_km), (F.lit(2.0) * y / F.lit(3.0)) / F.lit(edge_km)


def _rounded(fq: Column, fr: Column, q: Column, r: Column, s: Column) -> tuple[Column, Column]:
    """Whole coordinates from the fractions and their nearest integers: the worst of the three is derived anew."""
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s + fq + fr)
    q_off = (dq > ds) & (dq > dr)
    r_off = ~q_off & (dr > ds)
    return F.when(q_off, -s - r).otherwise(q), F.when(r_off, -q - s).otherwise(r)


def hex_cell(lat: Column, lng: Column, edge_km: float = EDGE_KM) -> Column:
    """Axial coordinates of the cell that holds a point, as ``struct<q,r>``."""
    fq, fr = _axial(lat, lng, edge_km)
    q, r = _rounded(fq, fr, _nearest(fq), _nearest(fr), _nearest(-fq - fr))
    return F.struct(q.alias("q"), r.alias("r"))


def with_cell(df: DataFrame, lat: str = "lat", lng: str = "lng", edge_km: float = EDGE_KM) -> DataFrame:
    """Add ``q`` and ``r``; rows without a position are dropped.

    Written in steps, so that each intermediate value is computed once per row. The results are never null, which
    spares joins on them a null check that would repeat the arithmetic.
    """
    located = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    fq, fr = _axial(F.col(lat), F.col(lng), edge_km)
    exact = located.withColumns({"_fq": fq, "_fr": fr})
    near = exact.withColumns(
        {
            "_q": _nearest(F.col("_fq")),
            "_r": _nearest(F.col("_fr")),
            "_s": _nearest(-F.col("_fq") - F.col("_fr")),
        }
    )
    q, r = _rounded(*[F.col(c) for c in ("_fq", "_fr", "_q", "_r", "_s")])
    zero = F.lit(0).cast("bigint")
    return near.withColumns({"q": F.coalesce(q, zero), "r": F.coalesce(r, zero)}).drop("_fq", "_fr", "_q", "_r", "_s")


def _leg_cells(a: np.ndarray, b: np.ndarray, way: np.ndarray, edge_km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of legs from ``a`` to ``b`` (rows of latitude and longitude): ways they belong to (rising), ``q`` and ``r``."""

    def axial(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = p[1] * KM_PER_DEG_LNG, p[0] * KM_PER_DEG_LAT
        return (INV_SQRT3 * x - y / 3.0) / edge_km, (2.0 * y / 3.0) / edge_km

    (aq, ar), (bq, br) = axial(a), axial(b)
    legs = np.arange(len(aq))
    leg, place = [legs, legs], [np.zeros(len(legs)), np.ones(len(legs))]
    for start, end in ((aq - ar, bq - br), (aq + 2.0 * ar, bq + 2.0 * br), (2.0 * aq + ar, 2.0 * bq + br)):
        # Places on the leg at which a whole number lies strictly between the form's values at its ends.
        first = np.floor(np.minimum(start, end)) + 1.0
        n = np.maximum(np.ceil(np.maximum(start, end)) - first, 0.0).astype(np.int64)
        of = np.repeat(legs, n)
        k = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        leg.append(of)
        place.append((k - start[of]) / (end - start)[of])
    leg, place = np.concatenate(leg), np.concatenate(place)
    order = np.lexsort((place, leg))
    leg, place = leg[order], place[order]
    kept = np.ones(len(leg), bool)
    kept[1:] = (leg[1:] != leg[:-1]) | (place[1:] != place[:-1])
    leg, place = leg[kept], place[kept]
    inside = np.flatnonzero(leg[1:] == leg[:-1])
    middle, leg = (place[inside] + place[inside + 1]) / 2.0, leg[inside]
    fq, fr = aq[leg] + (bq - aq)[leg] * middle, ar[leg] + (br - ar)[leg] * middle
    q, r, s = np.floor(fq + 0.5), np.floor(fr + 0.5), np.floor((-fq - fr) + 0.5)
    dq, dr, ds = np.abs(q - fq), np.abs(r - fr), np.abs(s + fq + fr)
    q_off = (dq > ds) & (dq > dr)
    r_off = ~q_off & (dr > ds)
    q, r = np.where(q_off, -s - r, q).astype(np.int64), np.where(r_off, -q - s, r).astype(np.int64)
    # Each cell of a way once, where it is met first.
    of = way[leg]
    order = np.lexsort((np.arange(len(of)), r, q, of))
    again = np.zeros(len(of), bool)
    again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (q[order[1:]] == q[order[:-1]]) & (r[order[1:]] == r[order[:-1]])
    return of[~again], q[~again], r[~again]


def _cell_lists(corners: list[np.ndarray], bent: np.ndarray, edge_km: float) -> Iterator[pa.Array]:
    """Cells of ways through three corners (latitudes and longitudes in turn), or two where a way isn't bent.

    Ways come in groups of bounded length, as a long one has thousands of cells.
    """
    known = np.isfinite(np.stack([corners[i] for i in (0, 1, 4, 5)])).all(0)
    points = [np.where(known, c, 0.0) for c in corners]
    reach = np.abs(points[4] - points[0]) * KM_PER_DEG_LAT + np.abs(points[5] - points[1]) * KM_PER_DEG_LNG
    group = (np.cumsum(2.0 * reach / edge_km + 4.0) // LIST_CELLS).astype(np.int64)
    for begin, end in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]):
        lat, lng, mid_lat, mid_lng, to_lat, to_lng = (p[begin:end] for p in points)
        turns, ways = bent[begin:end], np.arange(end - begin)
        starts = np.stack([np.concatenate([lat, mid_lat[turns]]), np.concatenate([lng, mid_lng[turns]])])
        ends = np.stack([np.concatenate([np.where(turns, mid_lat, to_lat), to_lat[turns]]), np.concatenate([np.where(turns, mid_lng, to_lng), to_lng[turns]])])
        way = np.concatenate([ways, ways[turns]])
        order = np.argsort(way, kind="stable")
        of, q, r = _leg_cells(starts[:, order], ends[:, order], way[order], edge_km)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=end - begin))]).astype(np.int32)
        unknown = ~known[begin:end][of]
        cells = pa.StructArray.from_arrays([pa.array(q, mask=unknown), pa.array(r, mask=unknown)], ["q", "r"])
        yield pa.ListArray.from_arrays(pa.array(offsets), cells)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def leg_cells(lat: Column, lng: Column, to_lat: Column, to_lng: Column, edge_km: float = EDGE_KM) -> Column:
    """The cells that a straight leg crosses, each once, in order: ``array<struct<q,r>>``.

    The edges of all cells lie on lines where one of three linear forms of the axial coordinates is a whole number, so
    between two places on the leg where any of them is, the leg stays inside one cell: that of the middle. Touching a
    corner is not crossing. Worked out in numpy by the very steps of :func:`hex_cell`, for many legs at once.
    """

    @F.arrow_udf("array<struct<q:bigint,r:bigint>>")
    def cells(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            a, b, c, d = map(_numbers, columns)
            yield from _cell_lists([a, b, a, b, c, d], np.zeros(len(a), bool), edge_km)

    return cells(*[c.cast("double") for c in (lat, lng, to_lat, to_lng)])


def bent_cells(start: tuple[Column, Column], middle: tuple[Column, Column], end: tuple[Column, Column], bent: Column, edge_km: float = EDGE_KM) -> Column:
    """The cells of both legs of a bent way, or of the straight one where ``bent`` is false, each once, in order."""

    @F.arrow_udf("array<struct<q:bigint,r:bigint>>")
    def cells(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for *columns, turns in batches:
            yield from _cell_lists([_numbers(c) for c in columns], turns.fill_null(False).to_numpy(zero_copy_only=False), edge_km)

    return cells(*[c.cast("double") for c in (*start, *middle, *end)], bent)


def cell_id(q: Column, r: Column) -> Column:
    """Text id of a cell."""
    return F.concat(q.cast("string"), F.lit("_"), r.cast("string"))


def split_cell(cell: Column) -> tuple[Column, Column]:
    """Axial coordinates of a text id."""
    parts = F.split(cell, "_")
    return parts[0].cast("bigint"), parts[1].cast("bigint")


def with_axes(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Add ``q`` and ``r`` parsed from the text id where they are absent."""
    if "q" in df.columns and "r" in df.columns:
        return df
    q, r = split_cell(F.col(cell))
    return df.withColumns({"q": q, "r": r})


def cell_center(q: Column, r: Column, edge_km: float = EDGE_KM) -> tuple[Column, Column]:
    """Latitude and longitude of the cell centre."""
    lat = (F.lit(edge_km * 1.5) * r) / F.lit(KM_PER_DEG_LAT)
    lng = (F.lit(edge_km * SQRT3) * (q + r / F.lit(2.0))) / F.lit(KM_PER_DEG_LNG)
    return lat, lng


def cell_boundary(q: Column, r: Column, edge_km: float = EDGE_KM) -> Column:
    """Closed outline of a cell: seven ``[lng, lat]`` pairs."""
    lat, lng = cell_center(q, r, edge_km)
    ring = [
        F.array(
            lng + F.lit(dx * edge_km / KM_PER_DEG_LNG),
            lat + F.lit(dy * edge_km / KM_PER_DEG_LAT),
        )
        for dx, dy in (*CORNERS, CORNERS[0])
    ]
    return F.array(*ring)


def cell_neighbors(q: Column, r: Column) -> Column:
    """The six adjacent cells as ``array<struct<q,r>>``, the cell itself excluded."""
    return F.array(
        *[F.struct((q + F.lit(dq)).alias("q"), (r + F.lit(dr)).alias("r")) for dq, dr in NEIGHBOR_OFFSETS]
    )


def pack_cell(q: Column, r: Column) -> Column:
    """One bigint per cell that sorts like ``(q, r)``."""
    return q * F.lit(_SHIFT) + (r + F.lit(_OFFSET))


def unpack_cell(packed: Column) -> tuple[Column, Column]:
    """Inverse of :func:`pack_cell`."""
    return F.shiftright(packed, 32), packed.bitwiseAND(F.lit(_SHIFT - 1)) - F.lit(_OFFSET)
