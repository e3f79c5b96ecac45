"""Edge cases, golden values and brute-force comparisons on small fixtures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stopwise.functions import geo, scoring, textcols, timecols
from stopwise.operators import aggregate, clean, dedup, encoding, features, graph, lookup, nested, numbering, ranges, spatial, timetable, upsert
from stopwise.session import fresh_path
from stopwise.sources import files, jdbc, published
from stopwise.streaming import feeds, history

D = dt.datetime


def one(spark, column, **values):
    names = list(values)
    row = spark.range(1).select(*[v.alias(n) for n, v in values.items()]) if names else spark.range(1)
    return row.select(column).first()[0]


# --- stations: golden values -----------------------------------------------------------

GOLDEN = [("Tübingen Hbf", 8000141, "TT", 48.515811, 9.055407), ("Köln Hbf", 8000207, "KK", 50.943030, 6.958729)]


@pytest.fixture(scope="module")
def stations(spark):
    rows = [(n, e, d, la, lo, None, None) for n, e, d, la, lo in GOLDEN]
    rows += [("Alt", 1, "AA", 50.0, 8.0, None, D(2021, 1, 1)), ("Neu", 1, "AA", 50.1, 8.1, D(2021, 1, 1), None),
             ("Zu", 2, "ZZ", 51.0, 7.0, D(2020, 1, 1), D(2020, 6, 1)), ("Ohne", 3, "OO", None, None, None, None)]
    return spark.createDataFrame(rows, "name string, eva bigint, ds100 string, lat double, lon double, valid_from timestamp_ntz, valid_to timestamp_ntz")


@pytest.mark.parametrize("key,index", [("name", 0), ("eva", 1), ("ds100", 2)])
def test_golden_stations(spark, stations, key, index):
    kind = "bigint" if key == "eva" else "string"
    asked = spark.createDataFrame([(g[index], D(2021, 1, 1)) for g in GOLDEN], f"{key} {kind}, date timestamp_ntz")
    renamed = stations.withColumns({f"found_{c}": F.col(c) for c in ("name", "eva", "ds100", "lat", "lon")})
    wanted = [f"found_{c}" for c in ("name", "eva", "ds100", "lat", "lon")]
    for found in (lookup.station_lookup(asked, renamed, key, "date", wanted), lookup.station_lookup_latest(asked, renamed, key, wanted)):
        assert sorted(tuple(r[c] for c in wanted) for r in found.collect()) == sorted(GOLDEN)


def test_station_validity(spark, stations):
    asked = spark.createDataFrame([(1, D(2020, 12, 31)), (1, D(2021, 1, 1)), (2, D(2019, 1, 1)), (2, D(2020, 6, 1)), (9, D(2021, 1, 1))], "eva bigint, date timestamp_ntz")
    found = lookup.station_lookup(asked, stations, "eva", "date", ["name"]).collect()
    assert {(r.eva, r.date, r.name) for r in found} == {(1, D(2020, 12, 31), "Alt"), (1, D(2021, 1, 1), "Neu"), (2, D(2019, 1, 1), None),
                                                        (2, D(2020, 6, 1), None), (9, D(2021, 1, 1), None)}


def test_lookup_pairs_keep_key_and_date(spark, stations):
    asked = spark.createDataFrame([(1, ["Alt", "Neu"], [D(2020, 1, 1), D(2020, 1, 1)])], "id int, names array<string>, dates array<timestamp_ntz>")
    rows = lookup.station_lookup_pairs(asked, stations, "names", "dates", "name", ["eva"]).orderBy("position").collect()
    assert [(r.position, r.name, r.date, r.eva) for r in rows] == [(0, "Alt", D(2020, 1, 1), 1), (1, "Neu", D(2020, 1, 1), None)]


# --- delays ----------------------------------------------------------------------------


def test_delay_rules(spark):
    t = lambda m: D(2024, 1, 1, 12, 0) + dt.timedelta(minutes=m)
    rows = [(1, t(0), t(5), None, t(1), t(4), None), (2, t(0), t(7), None, None, None, None), (3, None, None, None, t(0), t(2), None),
            (4, t(0), t(9), "c", t(1), t(9), "c"), (5, t(0), t(3), None, t(1), t(-1), None), (6, t(0), t(-1), None, t(1), t(0), None)]
    stops = spark.createDataFrame(rows, "hash_id int, ar_pt timestamp_ntz, ar_ct timestamp_ntz, ar_cs string, dp_pt timestamp_ntz, dp_ct timestamp_ntz, dp_cs string")
    got = {r.hash_id: (r.ar_delay, r.dp_delay, r.ar_happened, r.dp_happened, r.ar_cancelled) for r in clean.add_delays(stops).collect()}
    assert got[1] == (5, 3, True, True, False)
    assert got[2] == (0, 0, True, False, False)  # no departure: both delays are 0
    assert got[3] == (None, 2, False, True, False)
    assert got[4] == (9, 8, False, False, True)
    assert got[5] == (0, 0, True, True, False)  # left two minutes early
    assert got[6] == (-1, -1, True, True, False)
    early = {r.hash_id: (r.ar_delay, r.dp_delay) for r in clean.add_delays(stops, clamp="only_early").collect()}
    assert early[2] == (7, None) and early[5] == (0, 0)
    with pytest.raises(ValueError):
        clean.add_delays(stops, clamp="other")


def test_rounding_to_days(spark):
    moments = [D(2024, 3, 1, 12), D(2024, 3, 2, 12), D(2024, 3, 1, 11, 59), D(2024, 3, 1, 12, 1)]
    rows = spark.createDataFrame([(m,) for m in moments], "m timestamp_ntz").select(timecols.round_to_day(F.col("m")).alias("d")).collect()
    assert [r.d for r in rows] == [D(2024, 3, 2), D(2024, 3, 2), D(2024, 3, 1), D(2024, 3, 2)]


def test_small_text_functions(spark):
    assert one(spark, timecols.duration_text(F.lit(3 * 3600 + 5 * 60))) == "3:05"
    assert one(spark, timecols.duration_text(F.lit(86400 + 60))) == "1 day, 0:01"
    assert one(spark, timecols.duration_text(F.lit(2 * 86400))) == "2 days, 0:00"
    assert one(spark, timecols.duration_text(F.lit(-60))) == "-1 day, 23:59"
    parts = textcols.split_stop_id(F.lit("-7654321-2401151230-12"))
    assert [one(spark, parts[p]) for p in ("dayly_id", "date_text", "stop_id")] == [-7654321, "2401151230", 12]
    assert one(spark, textcols.parse_path(F.lit(""))) is None
    assert one(spark, textcols.parse_path(F.lit("A"))) == ["A"]
    assert one(spark, textcols.array_text_items(F.lit('{a,"b, c",d}'))) == ["a", "b, c", "d"]
    assert one(spark, textcols.extract_code(F.lit("Bf Wilhelmshöhe (FKW)"))) == "FKW"
    assert one(spark, textcols.normalize_name(F.lit("Berlin Hbf (tief) gl.3-8/9"))) == "berlinhbftief389"
    assert one(spark, timecols.utc_to_local(F.lit("2021-07-01T10:00:00.000Z"))) == D(2021, 7, 1, 12)
    assert one(spark, timecols.parse_compact_ts(F.lit("nonsense"))) is None
    assert [one(spark, timecols.clock_to_hour(F.lit(x))) for x in (1230, 1231, 1250, 1151)] == [12, 13, 13, 13]


def test_html_spans(spark):
    html = '<span class="atr-name">A</span><span class="atr-value">1</span><span class="atr-name">B</span><span class="atr-value">2</span>'
    row = files.html_attributes(spark.createDataFrame([(html,)], "h string"), "h", ["A", "B", "C"]).first()
    assert (row.A, row.B, row.C) == ("1", "2", None)


def test_distance_and_angle(spark):
    tue, koe = GOLDEN[0], GOLDEN[1]
    metres = one(spark, geo.distance_m(*[F.lit(v) for v in (tue[3], tue[4], koe[3], koe[4])]))
    assert 305_000 < metres < 310_000
    assert one(spark, geo.distance_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert abs(one(spark, geo.angle_degrees(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1)])) - 90) < 1e-9


# --- scores against a plain loop -------------------------------------------------------


def plain_score(ar, dp, t):
    n = len(ar)
    if not 0 <= t < n:
        return 1.0
    a, d = max(t - 2, 0), max(2 - t, 0)
    total = ar[a] * dp[d]
    while a + 1 < n and d + 1 < n:
        total += (ar[a + 1] - ar[a]) * dp[d + 1]
        a, d = a + 1, d + 1
    return min(total, 1.0)


def test_connection_score_by_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        n = rng.choice([1, 2, 3, 15])
        rows.append((i, sorted(rng.random() for _ in range(n)), sorted((rng.random() for _ in range(n)), reverse=True), rng.randint(-3, n + 2)))
    frame = spark.createDataFrame(rows, "i int, ar array<double>, dp array<double>, t int")
    got = {r.i: r.s for r in frame.select("i", scoring.connection_score(F.col("ar"), F.col("dp"), F.col("t")).alias("s")).collect()}
    for i, ar, dp, t in rows:
        want = plain_score(ar, dp, t) if len(ar) > max(2 - t, 0) or not 0 <= t < len(ar) else got[i]
        assert got[i] == pytest.approx(want)


def test_banded_score_defaults(spark):
    nothing = {m: F.lit(None).cast("double") for m in (5, 10, 15)}
    assert one(spark, scoring.banded_score(F.lit(18), nothing, nothing)) == 1.0
    assert one(spark, scoring.banded_score(F.lit(13), nothing, nothing)) == pytest.approx(1 - 0.01 * 0.95)


# --- connecting trains -----------------------------------------------------------------


def test_connecting_trains_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "A" if rng.random() < 0.5 else rng.choice("BC"), D(2024, 1, 1) + dt.timedelta(seconds=30 * rng.randint(0, 300)),
             D(2024, 1, 1) + dt.timedelta(seconds=30 * rng.randint(0, 300))) for i in range(150)]
    stops = spark.createDataFrame(rows, "hash_id int, station string, ar_pt timestamp_ntz, dp_pt timestamp_ntz")
    got = sorted((r.ar_side_hash_id, r.dp_side_hash_id) for r in ranges.connecting_trains(stops, []).collect())
    want = sorted((a[0], b[0]) for a, b in itertools.product(rows, rows)
                  if a[0] != b[0] and a[1] == b[1] and dt.timedelta(minutes=2) <= b[3] - a[2] <= dt.timedelta(minutes=10))
    assert got == want and want


# --- aggregates ------------------------------------------------------------------------


def test_circular_mean_wraps_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(0, 1.0), (10, 2.0), (20, 6.0), (30, None), (40, 3.0)], "b int, v double")
    got = {r.b: r.v for r in aggregate.circular_rolling_mean(rows, "b", ["v"], 3).collect()}
    assert got == {0: 2.0, 10: 3.0, 20: None, 30: None, 40: None}
    with pytest.raises(ValueError):
        aggregate.circular_rolling_mean(rows, "b", ["v"], 4)


def test_group_uncommon_merges_ties(spark):
    rows = [("a", 1, 2.0, 0.5, 1, 4.0, 1.0), ("b", 1, 4.0, 1.0, 1, 2.0, 0.0), ("c", 9, 1.0, 1.0, 9, 1.0, 1.0), ("d", 0, None, 0.0, 2, 1.0, 1.0)]
    stats = spark.createDataFrame(rows, "k string, ar_delay_count long, ar_delay_mean double, ar_happened_mean double, dp_delay_count long, dp_delay_mean double, dp_happened_mean double")
    got = {r.k: r for r in aggregate.group_uncommon(stats, "k", 1).collect()}
    assert set(got) == {"other", "c"}
    assert (got["other"].ar_delay_count, got["other"].ar_delay_mean, got["other"].dp_delay_mean) == (2, 3.0, 2.0)


def test_per_delay_keeps_ties_in_order(spark):
    rows = spark.createDataFrame([(d, D(2024, 1, 1), True, None, False) for d in (1, 2, 3, 3)], "ar_delay int, ar_pt timestamp_ntz, ar_happened boolean, dp_pt timestamp_ntz, dp_happened boolean")
    assert [(r.ar_delay, r.ar_count) for r in aggregate.per_delay(rows, 2).collect()] == [(1, 1), (3, 2)]


# --- whole-table positions -------------------------------------------------------------


def test_running_sums_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 50), i, rng.randint(-5, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, i int, v int")
    got = {r.i: (r.n, r.total) for r in numbering.running_sums(frame, [F.col("k"), F.col("i")], {"n": F.lit(1), "total": F.col("v")}, slices=7).collect()}
    total = 0
    for n, (k, i, v) in enumerate(sorted(rows), start=1):
        total += v
        assert got[i] == (n, total)
    sliced = frame.repartitionByRange(7, "k", "i").groupBy(F.spark_partition_id()).count()
    assert sliced.agg(F.max("count")).first()[0] < 1000  # the hot key is split


def test_exact_sample_sizes(spark):
    rows = spark.range(5000).withColumnRenamed("id", "key")
    for size in (0, 1, 777, 5000, 6000):
        ids = [r.key for r in numbering.exact_sample(rows, "key", size).collect()]
        assert len(ids) == len(set(ids)) == min(size, 5000)
    again = [{r.key for r in numbering.exact_sample(rows, "key", 50, seed=4).collect()} for _ in range(2)]
    assert again[0] == again[1]


def test_balanced_classes(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    counts = {r.label: r["count"] for r in features.balance_undersample(rows, "label", "key").groupBy("label").count().collect()}
    assert counts == {0: 300, 1: 300}


# --- keyed tables ----------------------------------------------------------------------


def test_upserts_and_unions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    as_set = lambda df: {(r.k, r.v) for r in df.collect()}
    assert as_set(upsert.upsert_update(old, new, ["k"])) == {(1, "a"), (2, "B"), (3, "C")}
    assert as_set(upsert.upsert_ignore(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, "C")}
    assert as_set(dedup.union_first_wins([old, new], ["k"])) == {(1, "a"), (2, "b"), (3, "C")}
    assert as_set(dedup.union_last_wins([old, new], ["k"])) == {(1, "a"), (2, "B"), (3, "C")}


def test_key_chunks_do_not_overlap(spark):
    rows = upsert.key_chunks(spark.range(-500, 500).withColumnRenamed("id", "k"), "k", rows_per_chunk=130)
    spans = rows.groupBy("chunk").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("k").alias("n")).orderBy("chunk").collect()
    assert len(spans) == 7 and sum(s.n for s in spans) == 1000
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_materialized_table_policy(spark):
    made = lambda n: lambda: spark.range(n)
    assert published.materialized_table(spark, "t_policy", generate=True, table_generator=made(3)).count() == 3
    assert published.materialized_table(spark, "t_policy", prefer_cache=True, source=made(5)).count() == 3
    assert published.materialized_table(spark, "t_policy", source=made(5)).count() == 5
    assert published.materialized_table(spark, "t_policy").count() == 5
    assert published.materialized_table(spark, "t_missing", table_generator=made(2)).count() == 2
    with pytest.raises(FileNotFoundError):
        published.materialized_table(spark, "t_nowhere")
    with pytest.raises(ValueError):
        published.materialized_table(spark, "t_nowhere", generate=True)


def test_jdbc_ranges():
    options = jdbc.range_options("jdbc:x", "rtd", "hash_id", -10, 10)
    assert options["numPartitions"] == "200" and options["partitionColumn"] == "hash_id" and options["lowerBound"] == "-10"


def test_encoders(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y")], "p string, q string")
    codes = {(r.name, r.value): r.code for r in encoding.build_encoders(rows, ["p", "q"]).collect()}
    assert codes == {("p", "a"): 0, ("p", "b"): 1, ("p", None): -1, ("q", "x"): 0, ("q", "y"): 1, ("q", None): -1}
    unseen = spark.createDataFrame([("z", "y")], "p string, q string")
    row = encoding.encode(unseen, encoding.build_encoders(rows, ["p", "q"]), ["p", "q"]).first()
    assert (row.p_code, row.q_code) == (-1, 1)


# --- networks --------------------------------------------------------------------------


def plain_paths(edges, source):
    best = {source: 0.0}
    for _ in range(len(edges) + 1):
        for _, u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in best and best[a] + w < best.get(b, float("inf")):
                    best[b] = best[a] + w
    return best


def test_shortest_paths_on_a_grid(spark):
    rng = random.Random(5)
    names = lambda x, y: f"n{x}{y}"
    edges = [(names(x, y), names(x + dx, y + dy), float(rng.randint(1, 20))) for x in range(5) for y in range(5) for dx, dy in ((0, 1), (1, 0)) if x + dx < 5 and y + dy < 5]
    edges = [(i, *e) for i, e in enumerate(edges)] + [(99, "island", "cliff", 1.0)]
    frame = spark.createDataFrame(edges, "edge_id long, u string, v string, length double")
    pairs = [("n00", "n44"), ("n44", "n00"), ("n23", "n23"), ("n00", "island"), ("n00", "unknown"), ("unknown", "n00")]
    rows = graph.shortest_paths(spark.createDataFrame(pairs, "source string, target string"), frame).collect()
    length = {e[0]: e[3] for e in edges}
    for r in rows:
        want = plain_paths(edges, r.source).get(r.target) if r.source != "unknown" else None
        assert r.distance == want
        assert r.path is None or sum(length[e] for e in r.path) == r.distance
    assert len(rows) == len(pairs)


def test_groups_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300) if i != 150] + [(400, 400)]
    got = {r.node: r.label for r in graph.connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(151)} == {0} and {got[i] for i in range(151, 301)} == {151} and got[400] == 400
    requests = spark.createDataFrame([(400,), (150,)], "node long")
    assert graph.members_of(requests, spark.createDataFrame(list(got.items()), "node long, label long")).count() == 150


def test_simplification(spark):
    edges = spark.createDataFrame([(0, "a", "b", 5), (1, "b", "a", 9), (2, "b", "c", 2), (3, "c", "d", 3), (4, "d", "e", 1), (5, "e", "x", 1), (6, "a", "f", 4), (7, "b", "g", 1)],
                                  "edge_id long, u string, v string, length long")
    typed = spark.createDataFrame([("a",), ("e",), ("f",)], "node string")
    single = graph.drop_parallel_edges(edges)
    assert {r.edge_id for r in single.collect()} == {1, 2, 3, 4, 5, 6, 7}
    pruned = graph.prune_dead_ends(single, typed)
    assert {r.edge_id for r in pruned.collect()} == {1, 2, 3, 4, 6}
    merged = {(r.u, r.v, r.length, r.merged) for r in graph.contract_chains(pruned, typed).collect()}
    assert merged == {("a", "e", 15, 4), ("a", "f", 4, 1)}


def test_nearest_point_far_away(spark):
    places = spark.createDataFrame([("p", 48.0, 9.0), ("q", -33.0, 151.0)], "place string, lat double, lon double")
    nodes = spark.createDataFrame([("n1", 48.001, 9.001), ("n2", 52.0, 13.0)], "node string, lat double, lon double")
    got = {r.place: r.nearest for r in spatial.nearest_point(places, nodes, "node").collect()}
    assert got == {"p": "n1", "q": "n2"}


def test_distances_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(timetable, "CHUNK", 4)
    rows = [(trip, i, 48.0 + i * 0.01, 9.0, D(2024, 1, 1)) for trip, n in ((1, 11), (2, 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "trip_id long, seq int, lat double, lon double, at timestamp_ntz")
    got = {(r.trip_id, r.seq): r.distance_m for r in timetable.stop_distances(frame).collect()}
    step = got[(2, 1)]
    assert len(got) == 14 and all(abs(d - seq * step) < 0.02 for (_, seq), d in got.items())


def test_gaps_in_the_sequence_lose_no_leg(spark):
    rows = [(1, i * 10, 48.0 + i * 0.01, 9.0, D(2024, 1, 1)) for i in range(200)] + [(2, 5, 48.0, 9.0, D(2024, 1, 1)), (2, 7005, 48.01, 9.0, D(2024, 1, 1))]
    frame = spark.createDataFrame(rows, "trip_id long, seq int, lat double, lon double, at timestamp_ntz").withColumn("route", F.lit("r"))
    got = {r.trip_id: r.distance_m for r in timetable.trip_stats(frame).collect()}
    assert abs(got[1] - 199 * got[2]) < 1


def test_a_far_node_is_found_from_small_cells(spark):
    places = spark.createDataFrame([("p", 48.0, 9.0)], "place string, lat double, lon double")
    nodes = spark.createDataFrame([("near", 56.3, 9.0), ("far", 48.0, 26.0)], "node string, lat double, lon double")
    assert spatial.nearest_point(places, nodes, "node", size=0.001).first().nearest == "near"


def test_a_long_chain_is_one_group(spark):
    links = spark.range(1500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in graph.connected_groups(links).collect()} == {0}


def test_an_adjacent_pair_needs_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(i, f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(60)], "edge_id int, u string, v string, length double")
    rounds = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, real=graph.cut_lineage: rounds.append(1) or real(df))
    got = graph.shortest_paths(spark.createDataFrame([("n010", "n011")], "source string, target string"), edges).first()
    assert got.distance == 1.0 and list(got.path) == [10] and len(rounds) < 8


def test_an_open_end_makes_few_rows(spark):
    from stopwise.operators import ranges

    works = spark.createDataFrame([(1, D(2024, 1, 1), D(9999, 12, 31)), (1, D(2024, 1, 1), D(2024, 1, 1, 1))], "edge_id int, from_time timestamp_ntz, to_time timestamp_ntz").withColumn("w", F.monotonically_increasing_id())
    uses = spark.createDataFrame([(1, D(2024, 1, 1, 0, 30)), (1, D(2500, 1, 1)), (1, D(2023, 1, 1))], "edge_id int, at timestamp_ntz")
    found = ranges.obstacles_on_edges(uses, works, "at")
    assert sorted(r.at.year for r in found.collect()) == [2024, 2024, 2500]


# --- nested ----------------------------------------------------------------------------


def test_trip_slices(spark):
    trip = F.array(*[F.lit(x) for x in "ABC"])
    assert one(spark, nested.trip_until(trip, F.lit(1))) == ["A", "B"] and one(spark, nested.trip_from(trip, F.lit(1))) == ["B", "C"]
    assert one(spark, nested.trip_until(trip, F.lit(-1))) == [] and one(spark, nested.trip_from(trip, F.lit(-1))) == ["C"]
    assert one(spark, nested.stop_position(trip, F.lit("X"), F.lit("C"))) == 2
    assert one(spark, nested.consecutive_pairs(F.array(F.lit("A")))) == []


# --- streams and history ---------------------------------------------------------------


def test_replayed_batch_changes_nothing(spark):
    path = fresh_path(spark, "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    feeds.write_batch(rows, 0, path)
    feeds.write_batch(rows.filter("k = 1").withColumn("v", F.lit("A")), 1, path)
    feeds.write_batch(rows.filter("k = 1").withColumn("v", F.lit("A")), 1, path)
    want = {(1, "A"), (2, "b")}
    assert {(r.k, r.v) for r in feeds.latest_rows(spark, path, ["k"]).collect()} == want
    assert {(r.k, r.v) for r in spark.read.parquet(feeds.compact(spark, path, ["k"])).collect()} == want


def test_history_actions(spark):
    current = spark.createDataFrame([(1, "Same", "S", None, None, "1", False, True), (2, "Old", "O", None, None, "1", False, True),
                                     (3, "Gone", "G", None, None, "1", False, True)],
                                    "eva long, name string, ds100 string, valid_from timestamp_ntz, valid_to timestamp_ntz, platforms string, db boolean, iris boolean")
    incoming = spark.createDataFrame([(1, "Same", "S", D(2020, 1, 1), "2", True), (2, "New", "O", D(2020, 1, 1), "2", True), (4, "Fresh", "F", D(2022, 1, 1), "2", True)],
                                     "eva long, name string, ds100 string, created timestamp_ntz, platforms string, db boolean")
    now = D(2024, 1, 1)
    rows = {(r.eva, r.name, r.valid_from.year, r.valid_to.year, r.platforms, r.iris) for r in history.scd2_update(current, incoming, now).collect()}
    assert rows == {(1, "Same", 2020, 9999, "2", True), (2, "Old", 2020, 2024, "1", True), (2, "New", 2024, 9999, "2", True),
                    (3, "Gone", 1, 2024, "1", False), (4, "Fresh", 2022, 9999, "2", True)}


def test_closed_stations_stay_closed_and_keep_their_place(spark):
    kind = ("eva long, name string, ds100 string, valid_from timestamp_ntz, valid_to timestamp_ntz, platforms string, db boolean, iris boolean, "
            "lat double, lon double, number_of_events long, meta array<long>")
    current = spark.createDataFrame([(1, "Closed", "C", D(2000, 1, 1), D(2021, 1, 1), "1", False, False, 48.0, 9.0, 7, [5]),
                                     (2, "Old", "O", None, None, "1", False, True, 50.0, 8.0, 3, [1])], kind)
    incoming = spark.createDataFrame([(2, "New", "O", D(2020, 1, 1), "2", True, [1, 9])],
                                     "eva long, name string, ds100 string, created timestamp_ntz, platforms string, db boolean, meta array<long>")
    rows = {(r.name, r.valid_to.year, r.lat, r.number_of_events, tuple(r.meta)) for r in history.scd2_update(current, incoming, D(2024, 1, 1)).collect()}
    assert rows == {("Closed", 2021, 48.0, 7, (5,)), ("Old", 2024, 50.0, 3, (1,)), ("New", 9999, 50.0, 3, (1, 9))}


def test_silent_hours_alert(spark):
    ticks = spark.createDataFrame([(D(2024, 1, 1, 0, 5),), (D(2024, 1, 1, 3, 5),)], "ts timestamp_ntz")
    counts = feeds.hourly_counts(ticks)
    assert {(r.hour.hour, r.n) for r in feeds.freshness_alert(counts, 1, "plans").collect()} == {(1, 0), (2, 0)}
    later = feeds.freshness_alert(counts, 1, "plans", D(2024, 1, 1, 5, 30))
    assert {r.hour.hour for r in later.collect()} == {1, 2, 4, 5}
    assert feeds.freshness_alert(counts.limit(0), 1, "plans").count() == 0


# --- plans -----------------------------------------------------------------------------


def test_dates_prune_folders(spark):
    path = fresh_path(spark, "by_date")
    rows = [(i, D(2024, 1, i), D(2024, 1, i, 1)) for i in range(1, 9)] + [(9, None, D(2024, 1, 4)), (10, D(2024, 1, 4), None), (11, None, None), (12, D(2024, 1, 4), D(2024, 1, 6))]
    stops = spark.createDataFrame(rows, "hash_id int, ar_pt timestamp_ntz, dp_pt timestamp_ntz")
    stored = spark.read.parquet(files.write_by_date(stops, path))
    for low, high in ((D(2024, 1, 4), D(2024, 1, 5)), (D(2024, 1, 5, 0, 30), None), (None, D(2024, 1, 3))):
        found = files.load_stops(stored, ["hash_id"], low, high)
        assert {r.hash_id for r in found.collect()} == {r.hash_id for r in files.load_stops(stops, ["hash_id"], low, high).collect()}
    assert stored.count() == 12
    plan = files.load_stops(stored, ["hash_id"], D(2024, 1, 4), D(2024, 1, 5))._jdf.queryExecution().executedPlan().toString()
    assert "last_date" in plan.split("PartitionFilters")[1] and "first_date" in plan.split("PartitionFilters")[1]


def test_row_numbers_take_one_shuffle(spark):
    numbered = numbering.global_row_number(spark.range(50).repartition(3), [F.col("id").desc()])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert [r.row_number for r in numbered.orderBy("id").collect()] == list(range(50, 0, -1))
    assert "hashpartitioning(id" not in plan and "rangepartitioning" not in plan  # the slices are checkpointed; only their counts move


def test_stored_tables_follow_their_input(spark, tmp_path):
    from stopwise.sources.tables import Tables

    spark.range(3).write.parquet(f"{tmp_path}/events.parquet")
    read = lambda: Tables(spark, str(tmp_path)).stored("copy", lambda: spark.read.parquet(f"{tmp_path}/events.parquet")).count()
    assert read() == 3 == read()
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert read() == 5


def test_publishing_again_moves_the_table(spark):
    published.publish_table(spark.range(3), "t_moves")
    published.publish_table(spark.range(5), "t_moves")
    assert spark.table("t_moves").count() == 5
    published.publish_table(spark.range(2).withColumn("more", F.lit(1)), "t_moves")
    assert spark.table("t_moves").columns == ["id", "more"]


def test_filters_reach_the_scan(spark):
    path = fresh_path(spark, "stops")
    spark.createDataFrame([(1, "A", "F", D(2024, 1, 1), D(2024, 1, 1))], "hash_id long, station string, f string, ar_pt timestamp_ntz, dp_pt timestamp_ntz").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = files.load_stops(spark.read.parquet(path), ["station"], D(2024, 1, 1), D(2024, 1, 2), long_distance_only=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(f,F)" in plan and "GreaterThanOrEqual(ar_pt" in plan
    assert "hash_id" not in plan.split("ReadSchema")[1]


def test_folders_by_key_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(900).selectExpr("id", "CASE WHEN id % 300 > 0 THEN concat('S', id % 300) END AS station", "id % 7 AS v")
    path = files.write_partitioned(rows, f"{tmp_path}/many", "station")
    found = spark.read.parquet(path).withColumns({"file": F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)})
    assert sorted(map(tuple, found.select("id", "station", "v").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert found.select("file").distinct().count() >= 4  # few bytes, but many files
    assert found.groupBy("station").agg(F.count_distinct("file").alias("n")).filter("n > 1").isEmpty()
    hot = spark.range(1000).selectExpr("id", "CASE WHEN id < 3 THEN 'a' END AS station")
    path = files.write_partitioned(hot, f"{tmp_path}/hot", "station", file_rows=100)
    back = files.read_partitioned(spark, path)
    assert {(r.id, r.station) for r in back.collect()} == {(i, "a" if i < 3 else None) for i in range(1000)}
    assert back.filter("station is null").select(F.input_file_name()).distinct().count() > 1
