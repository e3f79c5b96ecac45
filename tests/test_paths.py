"""Shortest paths with many ties, and what a search writes per round."""

from pyspark.sql import functions as F

from stopwise.operators import graph


def best_paths(edges, source):
    """(length, edges, ids) of the best path to every node, by repeated relaxation over whole paths."""
    best = {source: (0.0, 0, [])}
    for _ in range(40):
        for e, u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a != b and a in best:
                    d, n, path = best[a]
                    best[b] = min(best.get(b, (float("inf"), 0, [])), (d + w, n + 1, path + [e]))
    return best


def grid(side, length):
    names = lambda x, y: f"n{x}{y}"
    pairs = [(names(x, y), names(x + dx, y + dy)) for x in range(side) for y in range(side) for dx, dy in ((0, 1), (1, 0)) if x + dx < side and y + dy < side]
    pairs += [("n00", "n01"), ("n11", "n11")]  # a second edge between two nodes, and a loop
    return [(k * 7 % 41, u, v, length(k)) for k, (u, v) in enumerate(pairs)]


def test_equal_lengths_are_decided_by_edges_and_ids(spark):
    for length in (lambda k: float(k % 2), lambda k: 0.1 * (1 + k % 3)):
        edges = grid(4, length)
        names = sorted({n for _, u, v, _ in edges for n in (u, v)})
        pairs = [(s, t) for s in ("n00", "n21") for t in names]
        frame = spark.createDataFrame(edges, "edge_id long, u string, v string, length double")
        found = graph.shortest_paths(spark.createDataFrame(pairs, "source string, target string"), frame).collect()
        best = {s: best_paths(edges, s) for s in ("n00", "n21")}
        assert len(found) == len(pairs)
        for r in found:
            d, _, path = best[r.source][r.target]
            assert (r.distance, list(r.path)) == (d, path)


def test_a_round_writes_the_nodes_that_came_closer(spark):
    chain = spark.range(40).select("id", F.format_string("c%03d", "id").alias("u"), F.format_string("c%03d", F.col("id") + 1).alias("v"), F.lit(1.0).alias("length"))
    pairs = spark.createDataFrame([("c000", "c020"), ("c000", "c005")], "source string, target string")
    arcs = graph.both_ways(chain.withColumnRenamed("id", "edge_id"))
    rounds = graph.closer_rounds(pairs, arcs)
    assert [r.count() for r in rounds] == [1] * 22  # the search ends one step behind its furthest target
    assert "array" not in str([f.dataType for f in rounds[5].drop("back").schema])


def test_no_pairs_and_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    edges = spark.createDataFrame(grid(2, lambda k: 1.0), "edge_id long, u string, v string, length double")
    assert graph.shortest_paths(none, edges).count() == 0
    assert [tuple(r) for r in graph.shortest_paths(spark.createDataFrame([("a", "b")], none.schema), edges.limit(0)).collect()] == [("a", "b", None, None)]


def test_a_search_starts_at_the_end_that_serves_more_pairs(spark):
    star = [(k, f"s{k:03d}", "hub", float(1 + k % 3)) for k in range(60)] + [(60, "hub", "end", 2.0), (61, "alone", "apart", 1.0)]
    edges = spark.createDataFrame(star, "edge_id long, u string, v string, length double")
    pairs = spark.createDataFrame([(f"s{k:03d}", "end") for k in range(60)] + [("end", "hub"), ("alone", "end"), ("nowhere", "end")], "source string, target string")
    assert {tuple(r) for r in graph.directed(pairs).select("turned").distinct().collect()} == {(True,)}
    found = {(r.source, r.target): (r.distance, r.path) for r in graph.shortest_paths(pairs, edges).collect()}
    assert len(found) == 63
    assert all(found[f"s{k:03d}", "end"] == (3.0 + k % 3, [k, 60]) for k in range(60))
    assert found["end", "hub"] == (2.0, [60]) and found["alone", "end"] == found["nowhere", "end"] == (None, None)


def test_bounds_and_turned_searches_give_the_same_paths(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORTH_THINNING", 0)
    edges = grid(3, lambda k: float(1 + k % 2)) + [(50, "n22", "far", 9.0), (51, "x", "y", 1.0)]
    frame = spark.createDataFrame(edges, "edge_id long, u string, v string, length double")
    names = sorted({n for _, u, v, _ in edges for n in (u, v)})
    best = {s: best_paths(edges, s) for s in names}
    pairs = spark.createDataFrame([(s, "n00") for s in names] + [("far", t) for t in names if t != "n00"], "source string, target string")
    assert {r.turned for r in graph.directed(pairs).collect()} == {False, True}
    found = graph.shortest_paths(pairs, frame).collect()
    assert len(found) == 2 * len(names) - 1
    for r in found:
        d, _, path = best[r.source].get(r.target, (None, 0, None))
        assert (r.distance, r.path if r.path is None else list(r.path)) == (d, path)


def test_a_bounded_search_writes_nothing_longer_than_its_bound(spark):
    star = [(k, "a", f"s{k:03d}", float(1 + k)) for k in range(50)] + [(50, "s000", "z", 1.0)]
    arcs = graph.both_ways(spark.createDataFrame(star, "edge_id long, u string, v string, length double"))
    pairs = spark.createDataFrame([("a", "z")], "source string, target string")
    thin = graph.thinned(arcs)
    assert thin.filter("a = 'a'").count() == 50  # the only arc of each other node
    rounds = graph.closer_rounds(pairs, arcs, graph.search_bounds(pairs, arcs), ties=False)
    assert [r.count() for r in rounds] == [1, 2, 1]  # 51 in the second round without a bound
