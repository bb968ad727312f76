"""Contract-expiry clusters: near areas whose contracts for one product end at about the same time."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.geo import haversine_km

EARTH_KM = 6371.0
DAYS_A_MONTH = 30.4
#: Names that stand for no authority.
NO_AUTHORITY = ("No current strategic authority", "No current combined authority", "")


def candidates(entries: DataFrame, links: DataFrame, config: DataFrame, geo: DataFrame, as_of: Column, horizon_months: int, nation: str | None = None) -> DataFrame:
    """J10 + W8: one row a product and area: earliest end, summed value, place, authority."""
    e = entries.where((F.col("is_tech") == 1) & F.col("end_date").between(as_of, F.add_months(as_of, horizon_months)))
    rows = e.join(links, F.col("id") == F.col("entry_id")).groupBy("product_id", "lad_code").agg(F.min("end_date").alias("end_date"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"))
    rows = rows.join(geo, "lad_code").join(config.select("lad_code", "combined_authority"), "lad_code")
    return rows.where(F.left("lad_code", F.lit(1)) == nation) if nation else rows


def score(n: Column, span_days: Column, ubiquity: Column, value: Column) -> Column:
    """W10."""
    return n / (1 + span_days / DAYS_A_MONTH) / F.log(F.lit(2.718281828) + ubiquity) * F.log(1 + F.greatest(F.lit(0.0), value))


def _groups(partners: list[list[int]], fits: Callable[[int, int], bool], minimum: int) -> list[tuple[int, ...]]:
    """Seeded groups: a seed's partners, of which the one with the most misfits goes (the first on ties) until all fit; each member set once."""
    out: dict[tuple[int, ...], None] = {}
    for members in partners:
        misfits = [sum(not fits(a, b) for b in members) for a in members]
        while len(members) > 1 and max(misfits):
            worst = misfits.index(max(misfits))
            gone = members[worst]
            members, misfits = members[:worst] + members[worst + 1 :], misfits[:worst] + misfits[worst + 1 :]
            misfits = [n - (not fits(a, gone)) for a, n in zip(members, misfits, strict=True)]
        if len(members) >= minimum:
            out[tuple(members)] = None
    return list(out)


def clusters(rows: DataFrame, ubiquity: DataFrame, *, radius_km: float = 60, window_months: float = 6, minimum: int = 2, mode: str = "proximity", similarity: float = 0.6) -> DataFrame:
    """W9 + U4: clusters of each product, by score, without those that are subsets of or too like a better one.

    The date window is about a seed and its partners; that all members are near
    each other (or in one authority) is what the group is pruned for.  By
    authority, areas without one are left out.

    Near areas come from ``near_pairs``, by grid cells, so what a product's task
    holds is its areas and the links between neighbours, no matrix.
    """
    window = window_months * DAYS_A_MONTH

    def of_product(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["end_date", "lad_code"]).reset_index(drop=True)
        day = pd.to_datetime(pdf["end_date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        place = {lad: k for k, lad in enumerate(pdf["lad_code"])}
        near: list[set[int]] = [{k} for k in range(len(pdf))]
        if mode == "authority":
            # Members of an authority all fit each other: no links are needed.
            whole = pdf.groupby("combined_authority").indices
            partners, fits = [whole[a].tolist() for a in pdf["combined_authority"]], lambda a, b: True
        else:
            for a, b in zip(pairs["lad_a"], pairs["lad_b"], strict=True):
                near[place[a]].add(place[b])
                near[place[b]].add(place[a])
            partners, fits = [sorted(n) for n in near], lambda a, b: b in near[a]
        partners = [[m for m in members if abs(day[m] - day[k]) <= window] for k, members in enumerate(partners)]
        found = []
        for m in _groups(partners, fits, minimum):
            at = list(m)
            span, value = int(day[at].max() - day[at].min()), float(pdf["value"].to_numpy()[at].sum())
            points = len(at) / (1 + span / DAYS_A_MONTH) / math.log(2.718281828 + int(pdf["ubiquity"].iloc[0])) * math.log(1 + max(0.0, value))
            found.append((round(points, 2), set(at), span, value))
        found.sort(key=lambda c: -c[0])
        kept: list = []
        for c in found:
            if not any(c[1] <= k[1] or len(c[1] & k[1]) / len(c[1] | k[1]) >= similarity for k in kept):
                kept.append(c)
        names = pdf["lad_code"].to_numpy()
        return pd.DataFrame([(pdf["product_id"].iloc[0], ",".join(sorted(names[list(k[1])])), len(k[1]), k[2], k[3], k[0]) for k in kept], columns=["product_id", "members", "n", "span_days", "value", "score"])

    if mode == "authority":
        rows = rows.where(F.coalesce(~F.col("combined_authority").isin(*NO_AUTHORITY), F.lit(False)))
    joined = rows.join(ubiquity.select("product_id", F.col("councils").alias("ubiquity")), "product_id").withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    # Two members are each within the window of their seed, so within twice of it of each other.
    pairs = near_pairs(joined.where(F.lit(mode != "authority")), radius_km, 2 * window_months).select(F.col("product_id").alias("pair_product"), "lad_a", "lad_b")
    both = joined.groupBy("product_id").cogroup(pairs.groupBy("pair_product"))
    return both.applyInPandas(of_product, "product_id long, members string, n long, span_days long, value double, score double")


def _cells(lat: Column, lon: Column, radius_km: float) -> tuple[Column, Callable[[Column, Column], Column], Callable[[Column], Column]]:
    """A grid whose cells are no smaller than the radius: the band of a latitude, the cell of a longitude in a band, and a band's number of cells.

    Bands are as high as the radius.  A band's cells are as wide as the radius is
    where the band, or a neighbour of it, comes closest to a pole.
    """
    high = min(180.0, math.degrees(radius_km / EARTH_KM) * 1.000001)
    band = F.floor((lat + 90) / high).cast("long")

    def cells(b: Column) -> Column:
        edge = F.greatest(F.abs((b - 1) * high - 90), F.abs((b + 2) * high - 90))
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(radius_km / EARTH_KM, math.pi / 2))) / F.cos(F.radians(F.least(edge, F.lit(89.9))))))) * 1.000001
        return F.when(edge >= 89.9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / wide))).cast("long")

    return band, lambda b, x: F.pmod(F.floor((x + 180) / (360 / cells(b))), cells(b)).cast("long"), cells


def near_pairs(rows: DataFrame, radius_km: float, window_months: float) -> DataFrame:
    """J10 of areas: those of one product within radius and window, (product_id, lad_a, lad_b, km).

    Each area stands in its own cell of place and time, and looks for others in
    the cells around it (nine of place, three of time): only neighbours meet.
    """
    days = window_months * DAYS_A_MONTH
    span = max(1, math.ceil(days))
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    band, cell, cells = _cells(lat, lon, radius_km)
    r = rows.select("product_id", "lad_code", "end_date", lat.alias("lat"), lon.alias("lon"), band.alias("_y"), F.floor(F.unix_date("end_date") / span).alias("_t"))
    around = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col(c) + d))
    own = r.select(F.col("product_id").alias("_p"), F.col("lad_code").alias("lad_b"), F.col("end_date").alias("end_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("_y").alias("_yb"), cell(F.col("_y"), F.col("lon")).alias("_xb"), F.col("_t").alias("_tb"))
    asks = r.withColumn("_y", around("_y")).withColumn("_t", around("_t")).withColumn("_n", cells(F.col("_y"))).withColumn("_x", cell(F.col("_y"), F.col("lon")))
    asks = asks.withColumn("_x", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_x") + d, F.col("_n"))))))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    met = asks.join(own, (F.col("product_id") == F.col("_p")) & (F.col("_y") == F.col("_yb")) & (F.col("_x") == F.col("_xb")) & (F.col("_t") == F.col("_tb")) & (F.col("lad_code") < F.col("lad_b")))
    return met.where((km <= radius_km) & (F.abs(F.datediff("end_date", "end_b")) <= days)).select("product_id", F.col("lad_code").alias("lad_a"), "lad_b", F.round(km, 4).alias("km"))
