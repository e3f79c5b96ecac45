"""Network operators on edge tables.

Loops run a join and an aggregate per round and write a reliable checkpoint, so the
plan stays short and a lost executor costs one round at most. Edges are undirected
rows (edge_id, u, v, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.functions.geo import distance_m
from stopwise.operators.dedup import union_first_wins
from stopwise.operators.nested import consecutive_pairs
from stopwise.operators.numbering import global_row_number
from stopwise.operators.ranges import PRIORITIES, obstacle_lengths
from stopwise.session import cut_lineage, stored


def build_edge_table(edges: DataFrame) -> DataFrame:
    """Numbers edges from 0 in the order of (u, v, length); these must be unique."""
    numbered = global_row_number(edges, [F.col("u"), F.col("v"), F.col("length")], "_n")
    return numbered.select((F.col("_n") - 1).alias("edge_id"), "u", "v", "length")


def number_nodes(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return global_row_number(nodes, [F.col("node")], "_n").select("node", (F.col("_n") - 1).alias("node_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: columns edge_id, a, b, length."""
    return edges.select("edge_id", F.col("u").alias("a"), F.col("v").alias("b"), "length").union(
        edges.select("edge_id", "v", "u", "length"))


def unordered(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct pairs regardless of direction."""
    return pairs.select(F.least(source, target).alias("u"), F.greatest(source, target).alias("v")).filter(
        "u is not null and v is not null").distinct()


ROUNDS_PER_FOLD = 16
SHORT_ARCS = 4  # shortest arcs of each node in the thinned network
WORTH_THINNING = 10_000_000  # searches times arcs


def shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Length and edge ids of the shortest path for each distinct (source, target).

    A search starts at that end of a pair which serves more pairs, and all searches advance together. In a large network they
    run on its shortest arcs first, which tells how long a wanted path can be at most, and nothing longer is written when
    they run on all arcs. A round writes only the nodes that came closer in it, with pointers to the nodes and edges
    they came by; what was known before is read, never written again. It ends when nothing improves. Then the pointers are
    followed back from the other ends, through each round's rows once, and paths are put together for the wanted pairs alone.
    Lengths must not be negative. Equal lengths are decided by fewer edges, then by the edge ids.
    Unreachable pairs and unknown names get nulls.
    """
    arcs = stored(both_ways(edges).filter("a <> b"), "arcs")
    pairs = stored(pairs.select("source", "target").filter("source is not null and target is not null").distinct(), "pairs")
    known = lambda end: arcs.select(F.col("a").alias(end)).distinct()
    searched = directed(pairs.join(known("source"), "source", "left_semi").join(known("target"), "target", "left_semi"))
    turned = searched.filter("turned").select(F.col("target").alias("source"), F.col("source").alias("target"))
    straight = searched.filter("not turned").select("source", "target")
    wanted = stored(straight.unionByName(turned).distinct(), "wanted")
    searches = wanted.select("source").distinct().count()
    furthest = search_bounds(wanted, arcs) if searches * arcs.count() > WORTH_THINNING else None
    rounds = closer_rounds(wanted, arcs, furthest, ties=not straight.isEmpty())
    ends = cut_lineage(wanted.join(union_of(rounds).drop("back").withColumnRenamed("node", "target"), ["source", "target"]).groupBy("source", "target").agg(
        F.min(F.struct("d", "hops")).alias("end")))
    nothing = F.array().cast("array<bigint>")
    forth, back = ends.join(straight, ["source", "target"], "left_semi"), ends.join(turned, ["source", "target"], "left_semi")
    found = forth.join(paths_back(forth, rounds), ["source", "target"], "left").select("source", "target", F.col("end.d").alias("distance"), "path")
    found_back = back.join(paths_on(back, rounds), ["source", "target"], "left").select(
        F.col("target").alias("source"), F.col("source").alias("target"), F.coalesce("length", "end.d").alias("distance"), "path")
    found = found.unionByName(found_back).withColumn("path", F.coalesce("path", nothing))
    return pairs.join(found, ["source", "target"], "left")


def directed(pairs: DataFrame) -> DataFrame:
    """Pairs with ``turned``: whether the search starts at the target.

    It starts at the end that is in more pairs, and at all targets if these are fewer than the sources and not many more searches.
    """
    uses = pairs.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    side = lambda end: uses.select(F.col("node").alias(end), F.col("n").alias(f"_{end}"))
    placed = stored(pairs.join(side("source"), "source").join(side("target"), "target").select(
        "source", "target", (F.col("_source") < F.col("_target")).alias("turned")), "directed")
    start = F.when(F.col("turned"), F.col("target")).otherwise(F.col("source"))
    n = placed.agg(F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.count_distinct(start).alias("starts")).first()
    return placed.withColumn("turned", F.lit(True)) if n.targets < n.sources and n.targets <= 2 * n.starts else placed


def thinned(arcs: DataFrame) -> DataFrame:
    """The shortest arcs of every node, and the shortest one between any two groups that these leave apart.

    Nodes are connected in it if they are in the whole network.
    """
    usable = arcs.filter("length is not null")
    nearest = F.row_number().over(W.partitionBy("a").orderBy("length", "edge_id", "b"))
    near = cut_lineage(usable.withColumn("_n", nearest).filter(F.col("_n") <= SHORT_ARCS).select("edge_id", "a", "b", "length"))
    groups = connected_groups(near)
    if groups.select("label").distinct().limit(2).count() > 1:
        at = lambda end: groups.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        apart = usable.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b")
        bridges = apart.groupBy("_a", "_b").agg(F.min(F.struct("length", "edge_id", "a", "b")).alias("m"))
        near = near.unionByName(bridges.select("m.edge_id", "m.a", "m.b", "m.length"))
    back = near.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b"), "length")
    return cut_lineage(near.unionByName(back).distinct())


def search_bounds(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, _furthest): a length within which all reachable targets of a source lie, that of ways through the thinned network."""
    met = union_of(closer_rounds(pairs, thinned(arcs), ties=False)).select("source", F.col("node").alias("target"), "d")
    best = pairs.join(met, ["source", "target"]).groupBy("source", "target").agg(F.min("d").alias("d"))
    return cut_lineage(best.groupBy("source").agg(F.max("d").alias("_furthest")))


def union_of(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def closer_rounds(pairs: DataFrame, arcs: DataFrame, furthest: DataFrame | None = None, ties: bool = True) -> list[DataFrame]:
    """Per round the (source, node, d, hops) that came closer in it, with ``back``: edge, node and length of every equally good way there.

    A row of round r has r hops, so all its equally good ways arrive in that round. Without ``ties`` only the first way
    by edge and node is kept, so that offers shrink before they are shuffled. ``furthest`` (source, _furthest) leaves out
    what is longer; without it nodes further away than the furthest target of their source, once all its targets are reached,
    go no further.
    """
    known = arcs.select(F.col("a").alias("source")).distinct()
    start = pairs.select("source").distinct().join(known, "source", "left_semi")
    nothing = F.array().cast("array<struct<edge:bigint,node:string,length:double>>")
    rounds = [cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("hops"), nothing.alias("back")))]
    best, reached, late = rounds[0].drop("back"), [], []
    on, reach = F.col("node") == F.col("a"), lambda going: going
    if furthest is not None:
        arcs, on, reach = _classed(arcs, furthest)
    while True:
        newest, limit = rounds[-1], furthest
        if furthest is None:
            reached.append(pairs.join(newest.select("source", F.col("node").alias("target"), "d"), ["source", "target"]))
            limit = pairs.join(union_of(reached).groupBy("source", "target").agg(F.min("d").alias("_d")), ["source", "target"], "left").groupBy("source").agg(
                F.max(F.coalesce("_d", F.lit(float("inf")))).alias("_furthest"))
        going = newest.drop("back").join(limit, "source").filter("d <= _furthest")
        offers = reach(going).join(arcs, on).select(
            "source", F.col("b").alias("node"), (F.col("d") + F.col("length")).alias("d"), (F.col("hops") + 1).alias("hops"), "_furthest",
            F.struct(F.col("edge_id").cast("bigint").alias("edge"), F.col("a").alias("node"), F.col("length").cast("double").alias("length")).alias("way"))
        if furthest is not None:
            offers = offers.filter("d <= _furthest")
        if ties:
            ways = offers.groupBy("source", "node").agg(F.min("d").alias("d"), F.min("hops").alias("hops"), F.collect_list(F.struct("d", "way")).alias("_ways"))
            told = ways.select("source", "node", "d", "hops", F.transform(F.filter("_ways", lambda w: w["d"] == F.col("d")), lambda w: w["way"]).alias("back"))
        else:
            ways = offers.groupBy("source", "node").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "way"))).alias("_way"), F.min("hops").alias("hops"))
            told = ways.select("source", "node", "_way.d", "hops", F.array_compact(F.array("_way.way")).alias("back"))
        before = union_of([best, *late]).select(F.col("source").alias("_source"), F.col("node").alias("_node"), F.col("d").alias("_d"))
        no_closer = (F.col("source") == F.col("_source")) & (F.col("node") == F.col("_node")) & (F.col("_d") <= F.col("d"))
        closer = cut_lineage(told.join(before, no_closer, "left_anti"))  # known ways of the same length have fewer edges
        if closer.isEmpty():
            return rounds
        rounds.append(closer)
        late.append(closer.drop("back"))
        if len(late) == ROUNDS_PER_FOLD:  # the plan stays short
            best = cut_lineage(union_of([best, *late]).groupBy("source", "node").agg(F.min(F.struct("d", "hops")).alias("m")).select("source", "node", "m.*"))
            late = []
            if furthest is None:
                reached = [cut_lineage(union_of(reached).groupBy("source", "target").agg(F.min("d").alias("d")))]


def _classed(arcs: DataFrame, furthest: DataFrame):
    """Arcs that a bounded search may use, by class of length, the condition they are joined on, and what readies nodes for it.

    Each class has half the length of the one before. A node asks for the classes it can still afford, so the arcs of a large hub
    are not all gone through. A join of few nodes gives many offers, so it keeps its number of tasks.
    """
    most = furthest.agg(F.max("_furthest")).first()[0] or 0.0
    floors = [most / 2, most / 4, most / 8, 0.0]  # lengths of the class are above
    number = F.lit(len(floors) - 1)
    for i in reversed(range(len(floors) - 1)):
        number = F.when(F.col("length") > floors[i], F.lit(i)).otherwise(number)
    short = arcs.filter(F.col("length") <= most).withColumn("_arc_class", number)
    afforded = F.array_compact(F.array(*[F.when(F.col("d") + low <= F.col("_furthest"), F.lit(i)) for i, low in enumerate(floors)]))
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = lambda going: going.withColumn("_class", F.explode(afforded)).repartition(parts, "node", "_class")
    return short, (F.col("node") == F.col("a")) & (F.col("_class") == F.col("_arc_class")), reach


def paths_back(ends: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Edge ids from source to target, for ends with at least one edge.

    The rows of round r join those of round r - 1 only. All equally good ways back are followed; the first one
    by edge ids is picked going forward again, inside the row of a pair.
    """
    legs, at = [], None
    for hops in range(ends.agg(F.max("end.hops")).first()[0] or 0, 0, -1):
        here = ends.filter(F.col("end.hops") == hops).select("source", "target", F.col("target").alias("node"))
        at = here if at is None else at.unionByName(here).distinct()
        leg = cut_lineage(at.join(rounds[hops].select("source", "node", "back"), ["source", "node"]).select(
            "source", "target", F.lit(hops).alias("hops"), "node", F.explode("back").alias("way")))
        legs.append(leg)
        at = leg.select("source", "target", F.col("way.node").alias("node")).distinct()
    if not legs:
        return ends.select("source", "target", F.array().cast("array<bigint>").alias("path")).limit(0)
    steps = F.sort_array(F.collect_list(F.struct("hops", F.col("way.edge").alias("edge"), F.col("way.node").alias("a"), F.col("node").alias("b"))))
    start = F.struct(F.col("source").alias("at"), F.array().cast("array<bigint>").alias("path"))

    def go(done, step):
        onward = (step["hops"] == F.size(done["path"]) + 1) & (step["a"] == done["at"])
        return F.when(onward, F.struct(step["b"].alias("at"), F.concat(done["path"], F.array(step["edge"])).alias("path"))).otherwise(done)

    return union_of(legs).groupBy("source", "target").agg(steps.alias("steps")).select("source", "target", F.aggregate("steps", start, go)["path"].alias("path"))


def paths_on(ends: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(source, target, length, path) from target on to source, where the search began, for ends with at least one edge.

    Every pointer leads on by the first edge, so a pair has one row per edge. ``length`` is summed in the order of the path.
    """
    legs, at = [], None
    for hops in range(ends.agg(F.max("end.hops")).first()[0] or 0, 0, -1):
        here = ends.filter(F.col("end.hops") == hops).select("source", "target", F.col("target").alias("node"))
        at = here if at is None else at.unionByName(here)
        leg = cut_lineage(at.join(rounds[hops].select("source", "node", F.array_min("back").alias("way")), ["source", "node"]).select("source", "target", "way"))
        legs.append(leg.select("source", "target", F.struct(F.lit(-hops).alias("at"), F.col("way.edge").alias("edge"), F.col("way.length").alias("length")).alias("step")))
        at = leg.select("source", "target", F.col("way.node").alias("node"))
    if not legs:
        return ends.select("source", "target", F.lit(0.0).alias("length"), F.array().cast("array<bigint>").alias("path")).limit(0)
    steps = union_of(legs).groupBy("source", "target").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    length = F.aggregate("steps", F.lit(0.0), lambda total, step: total + step["length"])
    return steps.select("source", "target", length.alias("length"), F.transform("steps", lambda step: step["edge"]).alias("path"))


def refresh_path_cache(cache: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Cache of (u, v, distance, path) by unordered pair; only missing pairs are computed."""
    missing = unordered(pairs).join(cache, ["u", "v"], "left_anti")
    found = shortest_paths(missing.select(F.col("u").alias("source"), F.col("v").alias("target")), edges)
    fresh = found.select(F.col("source").alias("u"), F.col("target").alias("v"), "distance", "path")
    return union_first_wins([cache.select("u", "v", "distance", "path"), fresh], ["u", "v"])


def pair_distances(pairs: DataFrame, paths: DataFrame, places: DataFrame) -> DataFrame:
    """Distance of each unordered pair (u, v): path, else straight line, else 0."""
    at = lambda end: places.select(F.col("name").alias(end), F.col("lat").alias(f"_lat_{end}"), F.col("lon").alias(f"_lon_{end}"))
    known = paths.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("distance").alias("_path"))
    joined = unordered(pairs).join(known, ["u", "v"], "left").join(at("u"), "u", "left").join(at("v"), "v", "left")
    line = distance_m(F.col("_lat_u"), F.col("_lon_u"), F.col("_lat_v"), F.col("_lon_v"))
    return joined.select("u", "v", F.coalesce(F.col("_path"), line, F.lit(0.0)).alias("distance"))


def route_pairs(routes: DataFrame, route: str) -> DataFrame:
    """Neighbouring waypoints of all routes as (source, target)."""
    return routes.select(F.explode(consecutive_pairs(F.col(route))).alias("p")).select(
        F.col("p.a").alias("source"), F.col("p.b").alias("target"))


def route_lengths(routes: DataFrame, key: str, columns: list[str], distances: DataFrame) -> DataFrame:
    """Length of each array of waypoints in ``columns``; 0 without neighbours.

    ``distances`` holds the distinct pairs (u, v, distance), so each pair was solved once
    however many routes use it.
    """
    nothing = F.array().cast("array<struct<a:string,b:string>>")

    def tagged(column: str):
        return F.transform(F.coalesce(consecutive_pairs(F.col(column)), nothing), lambda p: F.struct(
            F.lit(column).alias("route"), F.least(p["a"], p["b"]).alias("u"), F.greatest(p["a"], p["b"]).alias("v")))

    hops = routes.select(key, F.explode(F.concat(*map(tagged, columns))).alias("h")).select(key, "h.*")
    sums = hops.join(distances, ["u", "v"]).groupBy(key).agg(
        *[F.sum(F.when(F.col("route") == c, F.col("distance"))).alias(f"{c}_length") for c in columns])
    return routes.select(key).join(sums, key, "left").fillna(0.0, subset=[f"{c}_length" for c in columns])


def route_features(stops: DataFrame, edges: DataFrame, places: DataFrame, obstacles: DataFrame, key: str = "hash_id",
                   cache: DataFrame | None = None) -> DataFrame:
    """Distances to the neighbours and both ends of the trip, and obstacle lengths on the way here.

    ``stops`` holds key, station, ar_pt and the arrays ar_cpth, dp_cpth; ``obstacles`` holds
    edge_id, priority, length, from_time, to_time.
    """
    here = F.array("station")
    routes = stops.select(
        key, "ar_pt", F.concat(F.array(F.try_element_at("ar_cpth", F.lit(-1))), here).alias("to_last"),
        F.concat("ar_cpth", here).alias("to_start"),
        F.concat(here, F.array(F.try_element_at("dp_cpth", F.lit(1)))).alias("to_next"), F.concat(here, "dp_cpth").alias("to_end"))
    pairs = route_pairs(routes, "to_start").union(route_pairs(routes, "to_end"))
    empty = cache if cache is not None else pairs.sparkSession.createDataFrame([], "u string, v string, distance double, path array<bigint>")
    paths = cut_lineage(refresh_path_cache(empty, pairs, edges))
    names = ["to_last", "to_start", "to_next", "to_end"]
    lengths = route_lengths(routes, key, names, pair_distances(pairs, paths, places))
    hops = routes.filter("to_start is not null").select(key, "ar_pt", F.explode(consecutive_pairs(F.col("to_start"))).alias("p")).select(
        key, "ar_pt", F.least("p.a", "p.b").alias("u"), F.greatest("p.a", "p.b").alias("v"))
    uses = hops.join(paths.select("u", "v", "path"), ["u", "v"]).select(key, "ar_pt", "path")
    sums = obstacle_lengths(uses, obstacles, key, "path", "ar_pt").withColumnsRenamed(
        {f"priority_{p}": f"obstacles_priority_{p}" for p in PRIORITIES})
    joined = lengths.join(sums, key, "left")
    return joined.fillna(0.0).withColumnsRenamed({f"{n}_length": f"distance_{n}" for n in names})


def obstacles_to_edges(works: DataFrame, edges: DataFrame) -> DataFrame:
    """Each work between two stations on each edge of the shortest path between them."""
    usable = works.filter("source is not null and target is not null and source <> target")
    paths = shortest_paths(unordered(usable).select(F.col("u").alias("source"), F.col("v").alias("target")), edges)
    by_pair = paths.filter("path is not null").select(F.col("source").alias("_u"), F.col("target").alias("_v"), "path")
    placed = usable.withColumns({"_u": F.least("source", "target"), "_v": F.greatest("source", "target")}).join(by_pair, ["_u", "_v"])
    rows = placed.withColumn("edge_id", F.explode("path"))
    return rows.join(edges.select("edge_id", "u", "v", "length"), "edge_id").select(
        "obstacle_id", "edge_id", "u", "v", "length", "priority", "from_time", "to_time")


def connected_groups(links: DataFrame) -> DataFrame:
    """Component label (its smallest node) per node of links (a, b); a node may link to itself.

    Each round a node takes the smallest label around it, and then the label of
    that label, which halves long chains.
    """
    arcs = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = cut_lineage(arcs.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        around = arcs.join(state, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = state.join(around, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("mid"))
        hop = state.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = lower.join(hop, "mid", "left").select("node", "old", F.least("mid", "far").alias("label"))
        new = cut_lineage(new)
        if new.filter("label <> old").isEmpty():
            break
        state = new.select("node", "label")
    return state


def group_sizes(groups: DataFrame) -> DataFrame:
    """Nodes with the size of their group; the other members of a node share its label."""
    return groups.join(groups.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "label").select("node", "label", "members")


def members_of(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """The other members of the group of each requested node."""
    wanted = requests.select("node").distinct().join(groups, "node")
    others = groups.select("label", F.col("node").alias("member"))
    return wanted.join(others, "label").filter("node <> member").select("node", "member")


def drop_parallel_edges(edges: DataFrame) -> DataFrame:
    """Of several edges between two nodes remove the shortest one."""
    pair = [F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")]
    shortest = edges.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("length", "edge_id")).alias("_s"))
    return edges.join(shortest.filter("_n > 1").select(F.col("_s.edge_id").alias("edge_id")), "edge_id", "left_anti")


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def prune_dead_ends(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """Remove untyped nodes with fewer than two edges, again and again until none is left."""
    current = cut_lineage(edges)
    while True:
        dead = cut_lineage(_degrees(current).filter("degree < 2").join(typed, "node", "left_anti").select("node"))
        if dead.isEmpty():
            break
        kept = current.join(dead, F.col("u") == F.col("node"), "left_anti").join(dead, F.col("v") == F.col("node"), "left_anti")
        current = cut_lineage(kept)
    return current


def contract_chains(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """Replace chains of untyped nodes with exactly two edges by one edge of their total length.

    Returns u, v, length and the number of edges merged. A ring without any other node is dropped.
    """
    inner = cut_lineage(_degrees(edges).filter("degree = 2").join(typed, "node", "left_anti").select("node"))
    flag = lambda end: inner.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    marked = cut_lineage(edges.join(flag("u"), "u", "left").join(flag("v"), "v", "left").select(
        "edge_id", "u", "v", "length", F.coalesce("_u", F.lit(False)).alias("_u"), F.coalesce("_v", F.lit(False)).alias("_v")))
    links = inner.select(F.col("node").alias("a"), F.col("node").alias("b")).union(marked.filter("_u and _v").select("u", "v"))
    labels = connected_groups(links)
    plain = marked.filter("not _u and not _v").select("u", "v", "length", F.lit(1).cast("bigint").alias("merged"))
    part = marked.filter("_u or _v").withColumn("node", F.when(F.col("_u"), F.col("u")).otherwise(F.col("v"))).join(labels, "node")
    ends = F.array_compact(F.array(F.when(~F.col("_u"), F.col("u")), F.when(~F.col("_v"), F.col("v"))))
    low, high = F.array_min(ends), F.array_max(ends)
    merged = part.groupBy("label").agg(F.min(low).alias("u"), F.max(high).alias("v"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("merged"))
    return plain.unionByName(merged.filter("u is not null").select("u", "v", "length", "merged"))


def construction_edges(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Edges that appear in ``closed`` (u, v) in either direction."""
    either = closed.select("u", "v").union(closed.select("v", "u")).distinct()
    return edges.join(either, ["u", "v"], "left_semi")


def reachability_waves(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes reachable from the seeds over links (a, b), with the round they were first met in."""
    links = cut_lineage(links.select("a", "b").distinct())
    seen = cut_lineage(seeds.select("node").distinct().withColumn("wave", F.lit(0)))
    wave = 0
    while True:
        wave += 1
        last = seen.filter(F.col("wave") == wave - 1)
        new = last.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        new = cut_lineage(new.withColumn("wave", F.lit(wave)))
        if new.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(new))
    return seen
