"""Boxes of all sizes against brute force."""

import math
import random

from pyspark.sql import functions as F

from stopwise.functions.geo import METRES_PER_DEGREE
from stopwise.operators import spatial


def test_boxes_of_all_sizes_meet_their_places(spark):
    rng = random.Random(4)
    edges = [(0, -60.0, 60.0, -170.0, 170.0), (1, 50.0, 50.0, 8.0, 8.0), (2, 50.0, 50.05, 8.0, 8.1)]
    for i in range(3, 120):
        s, w, span = rng.uniform(49, 51), rng.uniform(7, 9), rng.choice([0, 1e-4, 0.05, 0.1, 0.3, 2.0])
        edges.append((i, s, s + span * rng.random(), w, w + span * rng.random()))
    places = [(i, rng.uniform(49, 51), rng.uniform(7, 9)) for i in range(150)] + [(900, 50.0, 8.0), (901, 50.05, 8.1), (902, -33.0, 151.0)]
    for margin in (100, 30_000):
        dlat = margin / METRES_PER_DEGREE
        want = set()
        for e, s, n, w, east in edges:
            for p, lat, lon in places:
                dlon = dlat / math.cos(math.radians(lat))
                if s <= lat + dlat and lat - dlat <= n and w <= lon + dlon and lon - dlon <= east:
                    want.add((e, p))
        found = spatial.spatial_candidates(spark.createDataFrame(edges, "edge_id int, south double, north double, west double, east double"),
                                           spark.createDataFrame(places, "place int, lat double, lon double"), margin).collect()
        assert len(found) == len(want) and {(r.edge_id, r.place) for r in found} == want


def test_a_box_touches_four_cells_at_most(spark):
    extents = [k * 0.05 * 2.0 ** j for j in range(-3, 12) for k in (0.999999, 1.0, 1.000001)]
    rows = spark.createDataFrame([(x,) for x in extents], "x double").withColumn("level", spatial.level_of(F.col("x"), 0.05)).collect()
    assert all(r.x <= 0.05 * 2 ** r.level and (r.level == 0 or r.x > 0.05 * 2 ** (r.level - 1) * 0.9999) for r in rows)
