"""Nearest points, boxes and neighbourhoods through grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, distance_m
from stopwise.session import cut_lineage


GLOBE_DEGREES = 360.0


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def around(value: Column, size: float) -> Column:
    """A cell and both neighbours."""
    middle = cell(value, size)
    return F.explode(F.sequence(middle - 1, middle + 1))


def nearest_point(places: DataFrame, nodes: DataFrame, node_key: str, size: float = 0.05) -> DataFrame:
    """The nearest node for each place, with its distance in metres.

    A place looks in its own grid cell and the eight around it. What lies outside is
    further away than one cell, so a node found within that distance is the
    nearest one. Places without such a node look again in cells twice as wide, until
    the cells span the globe, whatever ``size`` they began with. Places and nodes with equal
    coordinates are looked at once. Coordinates must not be null; longitudes do not wrap at 180 degrees.
    """
    nodes = nodes.groupBy(F.col("lat").alias("_nlat"), F.col("lon").alias("_nlon")).agg(F.min(node_key).alias("_node"))
    open_places = places.select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).distinct()
    spot = ["_plat", "_plon"]
    found = None
    width = size / 2
    while True:
        width *= 2
        last = width >= GLOBE_DEGREES  # a cell and its neighbours hold every node
        probes = open_places.withColumn("_cy", around(F.col("_plat"), width)).withColumn("_cx", around(F.col("_plon"), width))
        placed = nodes.withColumns({"_cy": cell(F.col("_nlat"), width), "_cx": cell(F.col("_nlon"), width)})
        gap = distance_m(F.col("_plat"), F.col("_plon"), F.col("_nlat"), F.col("_nlon"))
        best = probes.join(placed, ["_cy", "_cx"]).withColumn("_d", gap).groupBy(*spot).agg(
            F.min(F.struct("_d", "_node")).alias("_best"))
        reach = open_places.join(best, spot, "left")
        edge_lat = F.least(F.abs(F.col("_plat")) + 2 * width, F.lit(89.9))
        sure = 2 * EARTH_RADIUS_M * F.asin(F.cos(F.radians(edge_lat)) * F.sin(F.radians(F.lit(min(width, 180.0))) / 2))
        safe = F.least(sure, F.lit(width * METRES_PER_DEGREE))
        reach = cut_lineage(reach.withColumn("_safe", F.lit(last) | F.coalesce(F.col("_best._d") <= safe, F.lit(False))))
        done = reach.filter("_safe").select(*spot, F.col("_best._node").alias("nearest"), F.col("_best._d").alias("distance_m"))
        found = done if found is None else found.unionByName(done)
        open_places = reach.filter("not _safe").select(*spot)
        if last or open_places.isEmpty():
            break
    return places.join(found.withColumnsRenamed({"_plat": "lat", "_plon": "lon"}), ["lat", "lon"], "left").select(
        *places.columns, "nearest", "distance_m")


def level_of(extent: Column, size: float) -> Column:
    """The finest level whose cells, ``size`` times a power of two, are as wide as ``extent``."""
    level = F.greatest(F.ceil(F.log2(extent / size)), F.lit(0)).cast("int")
    return F.coalesce(level + (F.lit(size) * F.pow(F.lit(2.0), level) < extent).cast("int"), F.lit(0))  # a rounded logarithm may be one short


def spatial_candidates(edges: DataFrame, places: DataFrame, margin_m: float = 100, size: float = 0.05) -> DataFrame:
    """Edges whose box meets the box of ``margin_m`` around a place.

    ``edges`` holds edge_id, south, north, west, east; ``places`` holds place, lat, lon. A box stands on
    the level of its size, where it touches four cells at most, however long it is. Two boxes meet on the coarser one of
    their levels, so a box is also placed on those coarser levels that boxes of the other side stand on. A pair counts
    only in the cell of the larger of both lower corners, so it appears once.
    """
    dlat = margin_m / METRES_PER_DEGREE
    dlon = F.lit(dlat) / F.cos(F.radians("lat"))
    boxes = places.select("place", (F.col("lat") - dlat).alias("_s"), (F.col("lat") + dlat).alias("_n"),
                          (F.col("lon") - dlon).alias("_w"), (F.col("lon") + dlon).alias("_e"))
    left = edges.select("edge_id", "south", "north", "west", "east", level_of(F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west")), size).alias("_la"))
    right = boxes.withColumn("_lb", level_of(F.greatest(F.col("_n") - F.col("_s"), F.col("_e") - F.col("_w")), size))
    levels = lambda df, level: sorted(r[0] for r in df.select(level).distinct().collect())  # about log2(360 / size) numbers

    def spread(df: DataFrame, s: str, n: str, w: str, e: str, own: str, others: list[int], tag: str) -> DataFrame:
        up = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col(own))
        df = df.withColumn("_level", F.explode(F.concat(F.array(own), up)))
        at = lambda value: F.floor(F.col(value) / (F.lit(size) * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")
        df = df.withColumns({f"_{tag}y": at(s), f"_{tag}x": at(w)})
        df = df.withColumn("_cy", F.explode(F.sequence(F.col(f"_{tag}y"), at(n))))
        return df.withColumn("_cx", F.explode(F.sequence(F.col(f"_{tag}x"), at(e))))

    a = spread(left, "south", "north", "west", "east", "_la", levels(right, "_lb"), "a")
    b = spread(right, "_s", "_n", "_w", "_e", "_lb", levels(left, "_la"), "b")
    once = (F.col("_level") == F.greatest("_la", "_lb")) & (F.col("_cy") == F.greatest("_ay", "_by")) & (F.col("_cx") == F.greatest("_ax", "_bx"))
    meet = (F.col("south") <= F.col("_n")) & (F.col("_s") <= F.col("north")) & (F.col("west") <= F.col("_e")) & (F.col("_w") <= F.col("east"))
    return a.join(b, ["_level", "_cy", "_cx"]).filter(once & meet).select("edge_id", "place")


def radius_mean(queries: DataFrame, known: DataFrame, axes: list[str], radius: float, value: str, key: str) -> DataFrame:
    """Mean of ``value`` over known rows within ``radius`` of each query; null without any.

    Axes are scaled already. Known rows at one place are summed up first, and
    queries at one place are asked once, so crowded places do not multiply.
    """
    spots = known.filter(F.col(value).isNotNull()).groupBy(*axes).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    cells = {f"_c{i}": cell(F.col(a), radius) for i, a in enumerate(axes)}
    spots = spots.withColumns(cells).withColumnsRenamed({a: f"_k{i}" for i, a in enumerate(axes)})
    asked = queries.select(*axes).distinct().dropna()
    probes = asked
    for i, axis in enumerate(axes):
        probes = probes.withColumn(f"_c{i}", around(F.col(axis), radius))
    gap = sum(((F.col(a) - F.col(f"_k{i}")) * (F.col(a) - F.col(f"_k{i}")) for i, a in enumerate(axes)), F.lit(0.0))
    near = probes.join(spots, list(cells)).filter(gap <= radius * radius)
    means = near.groupBy(*axes).agg((F.sum("_sum") / F.sum("_n")).alias("radius_mean"))
    return queries.join(means, axes, "left").select(key, "radius_mean")
