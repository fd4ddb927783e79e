"""Networks: grids, neighbours, pair tables, and shortest paths by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.operators.scans import Scan
from roadloom.sources.lineage import cut


def grid(spark: SparkSession, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y), and edges (edge, from, to) in both directions between neighbours of a grid, ids from 1."""
    nodes = spark.range(rows * cols).select((F.col("id") + 1).alias("node"), (F.col("id") % cols + 1).cast("int").alias("x"), (F.floor(F.col("id") / cols) + 1).cast("int").alias("y"))
    step = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    ways = nodes.select("node", "x", "y", F.explode(F.array(step(1, 0), step(-1, 0), step(0, 1), step(0, -1))).alias("w"))
    ways = ways.where((F.col("x") + F.col("w.dx")).between(1, cols) & (F.col("y") + F.col("w.dy")).between(1, rows))
    ends = ways.select(F.col("node").alias("from"), (F.col("node") + F.col("w.dx") + cols * F.col("w.dy")).alias("to"))
    from roadloom.operators.clean import dense_index

    return nodes, dense_index(ends, ["from", "to"], "edge").withColumn("edge", F.col("edge") + 1)


def edge_neighbors(edges: DataFrame) -> DataFrame:
    """edge, neighbor, relation, shared, distance, is_reverse of edges (edge, from, to, length); four self equi-joins.

    distance is half of both lengths, null where either is.
    """
    e = edges.select("edge", "from", "to", "length")
    n = e.select(F.col("edge").alias("neighbor"), F.col("from").alias("nf"), F.col("to").alias("nt"), F.col("length").alias("nl"))
    out = None
    for relation, mine, theirs in (("upstream", "from", "nt"), ("downstream", "to", "nf"), ("share_from", "from", "nf"), ("share_to", "to", "nt")):
        part = e.join(n, (F.col(mine) == F.col(theirs)) & (F.col("edge") != F.col("neighbor")))
        part = part.select("edge", "neighbor", F.lit(relation).alias("relation"), F.col(mine).alias("shared"), (F.col("length") / 2 + F.col("nl") / 2).alias("distance"), ((F.col("from") == F.col("nt")) & (F.col("to") == F.col("nf"))).alias("is_reverse"))
        out = part if out is None else out.unionByName(part)
    return out


#: Edges of a block of a node's list.
BLOCK_EDGES = 1024
# Relation, the side of the asked edge and that of its neighbour at the node that they share.
RELATIONS = (("upstream", "out", "in"), ("downstream", "in", "out"), ("share_from", "out", "out"), ("share_to", "in", "in"))


def neighbor_blocks(edges: DataFrame, block: int = BLOCK_EDGES) -> DataFrame:
    """node, side, block, edges: what starts (out) and ends (in) at each node, in lists of at most `block` edges.

    All neighbour pairs follow from these lists, which are as long as the edges, not as their pairs. Edges are numbered at
    their node by a segmented scan, so the lists of a hub are made by many tasks.
    """
    side = lambda k, at: F.struct(F.lit(k).alias("side"), F.col(at).alias("node"))
    ends = edges.select("edge", "from", "to", "length", F.explode(F.array(side("out", "from"), side("in", "to"))).alias("e")).select("e.node", "e.side", "edge", "from", "to", "length")
    ends = Scan(ends, ["node", "side"], ["edge"]).number("_n").done().withColumn("block", F.floor((F.col("_n") - 1) / block))
    return ends.groupBy("node", "side", "block").agg(F.array_sort(F.collect_list(F.struct("edge", "from", "to", "length"))).alias("edges"))


def expand_neighbors(blocks: DataFrame) -> DataFrame:
    """The rows of `edge_neighbors` from the lists: pairs of blocks are dealt to tasks before any pair of edges is made."""
    mine = blocks.select("node", F.col("side").alias("_a"), F.col("block").alias("_i"), F.col("edges").alias("_mine"))
    theirs = blocks.select("node", F.col("side").alias("_b"), F.col("block").alias("_j"), F.col("edges").alias("_theirs"))
    kind = F.create_map(*(x for r, a, b in RELATIONS for x in (F.lit(f"{a} {b}"), F.lit(r))))
    both = mine.join(theirs, "node").repartition("node", "_a", "_i", "_b", "_j")
    pairs = both.select("node", kind[F.concat_ws(" ", "_a", "_b")].alias("relation"), F.explode("_mine").alias("e"), "_theirs").select("node", "relation", "e", F.explode("_theirs").alias("n")).where("e.edge <> n.edge")
    reverse = (F.col("e.from") == F.col("n.to")) & (F.col("e.to") == F.col("n.from"))
    return pairs.select(F.col("e.edge").alias("edge"), F.col("n.edge").alias("neighbor"), "relation", F.col("node").alias("shared"), (F.col("e.length") / 2 + F.col("n.length") / 2).alias("distance"), reverse.alias("is_reverse"))


def lag_sources(edges: DataFrame, rule: str) -> DataFrame:
    """target, source: the edges whose past enters a target's model, itself included.

    origin: edges at the target's origin. two_endpoint: edges at either end. An edge is exploded into its ends, so
    the neighbourhood is an equi-join on nodes.
    """
    if rule not in ("origin", "two_endpoint"):
        raise ValueError(rule)
    asked = edges.select(F.col("edge").alias("target"), F.explode(F.array("from", "to") if rule == "two_endpoint" else F.array("from")).alias("node"))
    ends = edges.select(F.col("edge").alias("source"), F.explode(F.array_distinct(F.array("from", "to"))).alias("node"))
    return asked.join(ends, "node").select("target", "source").unionByName(edges.select(F.col("edge").alias("target"), F.col("edge").alias("source"))).distinct()


def pair_table(edges: DataFrame, nodes: DataFrame, rule: str, label: str) -> DataFrame:
    """target, source, relation, distance (least Manhattan distance of ends), pair_name."""
    at = nodes.select("node", "x", "y")
    ends = edges.select("edge", "from", "to")
    for k in ("from", "to"):
        ends = ends.join(at.select(F.col("node").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y")), k)
    side = lambda p: ends.select(*(F.col(c).alias(f"{p}_{c}") for c in ends.columns))
    out = lag_sources(edges, rule).join(side("t"), F.col("target") == F.col("t_edge")).join(side("s"), F.col("source") == F.col("s_edge"))
    apart = lambda a, b: F.abs(F.col(f"t_{a}_x") - F.col(f"s_{b}_x")) + F.abs(F.col(f"t_{a}_y") - F.col(f"s_{b}_y"))
    touches = lambda node: (F.col("s_from") == F.col(node)) | (F.col("s_to") == F.col(node))
    relation = F.when(F.col("target") == F.col("source"), "self").when(touches("t_from"), "origin").when(touches("t_to"), "destination").otherwise("nearby")
    return out.select(
        "target", "source", relation.alias("relation"), F.least(*(apart(a, b) for a in ("from", "to") for b in ("from", "to"))).cast("double").alias("distance"),
        F.concat(F.lit(f"{label}_e"), F.col("target"), F.lit("_lag"), F.col("source")).alias("pair_name"),
    )


def with_truth(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds true_active from truth (target, source, true_active); unknown pairs are false."""
    return pairs.join(truth.select("target", "source", "true_active"), ["target", "source"], "left").withColumn("true_active", F.coalesce("true_active", F.lit(False)))


def k_nearest(nodes: DataFrame, edges: DataFrame, k: int = 10, radius: float | None = None) -> DataFrame:
    """node, neighbor, distance, rank: the k nearest other nodes, or all within a radius, by distance, then node."""
    best = _settled(nodes.select(F.col("node").cast("long").alias("source")).distinct(), edges, k if radius is None else None, radius)
    best = best.where("source <> node").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("distance", "node")))
    best = best.where(F.col("rank") <= k) if radius is None else best
    return best.select(F.col("source").alias("node"), F.col("node").alias("neighbor"), "distance", "rank")


def _settled(sources: DataFrame, edges: DataFrame, k: int | None = None, radius: float | None = None, budget: bool = False) -> DataFrame:
    """source, node, distance, level of all that is reached from each source, by joins: rounds of relaxing what the last one improved.

    Nodes are ordered by distance, then level: how many edges of no length end a way at least. A distance beyond the
    radius, beyond the source's budget, or beyond the k-th of those found (which only shrink) is dropped where it arises,
    as nothing nearer can come of it.
    """
    keep = ["source", *(["budget"] if budget else [])]
    step = _steps(edges)
    start = sources.select(*keep, F.col("source").alias("node"), F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("level")).alias("at"))
    best = cut(start.withColumn("new", F.lit(True)))
    while not best.where("new").isEmpty():
        at = F.struct((F.col("at.distance") + F.col("l")).alias("distance"), F.when(F.col("l") == 0, F.col("at.level") + 1).otherwise(0).alias("level"))
        more = best.where("new").join(step, F.col("node") == F.col("from")).select(*keep, F.col("to").alias("node"), at.alias("at"))
        more = more.where(F.col("at.distance") <= F.lit(radius)) if radius is not None else more
        more = more.where(F.col("at.distance") <= F.col("budget")) if budget else more
        both = best.select(*keep, "node", "at", F.lit(True).alias("old")).unionByName(more.withColumn("old", F.lit(False)))
        both = both.groupBy(*keep, "node").agg(F.min("at").alias("at"), F.min(F.when(F.col("old"), F.col("at"))).alias("was"))
        both = both.withColumn("new", F.col("was").isNull() | (F.col("at") < F.col("was"))).drop("was")
        if k is not None:  # ranks are of one source's reached nodes, k and those that are as near
            nth = Window.partitionBy(*keep).orderBy("at.distance")
            both = both.withColumn("_nth", F.rank().over(nth)).where(F.col("_nth") <= k + 1).drop("_nth")
        best = cut(both)
    return best.select(*keep, "node", "at.*")


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.coalesce("length", F.lit(1.0)).cast("double").alias("l"))


def routes(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked (source, target, budget) with path and cost; an unreachable target has an empty path and a null cost.

    Nodes are settled by distance, then by how many edges of no length lead to them there, then by id, and each keeps
    the predecessor that was settled first, as label-setting searches do. Distances are found within each source's
    largest budget, predecessors by a join, and all paths are walked back at once, an edge a round.
    """
    ask = cut(asked.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), F.col("budget").cast("double").alias("budget")))
    reach = cut(_settled(ask.groupBy("source").agg(F.max("budget").alias("budget")), edges, budget=True).select("source", "node", "distance", "level"))
    step = _steps(edges).withColumnsRenamed({"from": "p", "to": "node"})
    before = reach.select("source", F.col("node").alias("p"), F.col("distance").alias("pd"), F.col("level").alias("pl"))
    via = reach.where("source <> node").join(step, "node").join(before, ["source", "p"]).where((F.col("pd") + F.col("l") == F.col("distance")) & ((F.col("l") > 0) | (F.col("pl") < F.col("level"))))
    via = cut(via.groupBy("source", "node").agg(F.min(F.struct("pd", "pl", "p")).alias("m")).select("source", "node", F.col("m.p").alias("p")))
    found = ask.distinct().join(reach, (ask["source"] == reach["source"]) & (ask["target"] == reach["node"])).where(F.col("distance") <= F.col("budget"))
    walk = cut(found.select(ask["source"], "target", "budget", F.col("distance").alias("cost"), F.array("target").alias("path"), F.col("target").alias("at")))
    while not walk.where("at <> source").isEmpty():
        on = walk.join(via.select(F.col("source").alias("s"), F.col("node").alias("at_"), "p"), (F.col("source") == F.col("s")) & (F.col("at") == F.col("at_")), "left")
        walk = cut(on.select("source", "target", "budget", "cost", F.when(F.col("at") != F.col("source"), F.concat(F.array("p"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("at") != F.col("source"), F.col("p")).otherwise(F.col("at")).alias("at")))
    out = ask.alias("a").join(walk.alias("w"), (F.col("a.source") == F.col("w.source")) & (F.col("a.target") == F.col("w.target")) & (F.col("a.budget") == F.col("w.budget")), "left")
    return out.select("a.source", "a.target", "a.budget", F.coalesce("w.path", F.array().cast("array<long>")).alias("path"), "w.cost")


def relax_distances(sources: DataFrame, edges: DataFrame, rounds: int, cut=cut) -> DataFrame:
    """source, node, distance within `rounds` hops, by joins alone: for graphs beyond a broadcast."""
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"))
    step = edges.select("from", "to", F.coalesce("length", F.lit(1.0)).alias("l"))
    for _ in range(rounds):
        more = best.join(step, F.col("node") == F.col("from")).select("source", F.col("to").alias("node"), (F.col("distance") + F.col("l")).alias("distance"))
        best = cut(best.unionByName(more).groupBy("source", "node").agg(F.min("distance").alias("distance")))
    return best


def neighbors(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """node, neighbor, kind, hops, distance, rank: direct successors and the k nearest by network distance."""
    direct = edges.select(F.col("from").alias("node"), F.col("to").alias("neighbor"), F.lit("direct_out").alias("kind"), F.lit(1).alias("hops"), F.col("length").alias("distance"), F.lit(None).cast("int").alias("rank"))
    near = k_nearest(nodes, edges, k).select("node", "neighbor", F.lit("network_nearest").alias("kind"), F.lit(None).cast("int").alias("hops"), "distance", "rank")
    return direct.unionByName(near)


def route_confidence(snap_a, snap_b, ratio, points):
    """low: a snap over 90 m or a detour over 4.5; medium: two points or fewer; else high."""
    return F.when((F.greatest(snap_a, snap_b) > 90) | (ratio > 4.5), "low").when(points <= 2, "medium").otherwise("high")


def route_budget(length_m):
    return F.least(F.lit(18000.0), F.greatest(8 * length_m + 900, F.lit(700.0)))


def incident(edges: DataFrame, node: int) -> DataFrame:
    """Edges that start or end at a node."""
    return edges.where((F.col("from") == node) | (F.col("to") == node))


def way_graph(points: DataFrame, digits: int = 7) -> DataFrame:
    """from, to, way, length of way points (way, pos, lon, lat, x, y): nodes are points merged at rounded coordinates.

    Ways are taken in both directions; steps of no length are left out. A node's id is the hash of its coordinates.
    """
    w = Window.partitionBy("way").orderBy("pos")
    node = F.xxhash64(F.round(F.col("lon") * 10**digits).cast("bigint"), F.round(F.col("lat") * 10**digits).cast("bigint"))
    p = points.withColumn("node", node).withColumn("_n", F.lead(F.struct("node", "x", "y")).over(w)).where(F.col("_n").isNotNull() & (F.col("node") != F.col("_n.node")))
    p = p.withColumn("length", F.hypot(F.col("x") - F.col("_n.x"), F.col("y") - F.col("_n.y"))).where(F.col("length") > 0)
    both = F.array(F.struct(F.col("node").alias("from"), F.col("_n.node").alias("to")), F.struct(F.col("_n.node").alias("from"), F.col("node").alias("to")))
    return p.select(F.explode(both).alias("e"), "way", "length").select("e.from", "e.to", "way", "length")


def route_edges(edges: DataFrame, nodes: DataFrame, graph: DataFrame, snap: float = 260.0) -> DataFrame:
    """Routes of model edges (edge, ax, ay, bx, by, length) over a way graph with nodes (pid, px, py).

    Both ends snap to their exact nearest node within `snap`; the path may cost what the edge's length allows; the
    ways are listed once each in order, and a confidence is given. Edges without a route have a null path.
    """
    from roadloom.operators.spatial import nearest_points

    ends = {k: nearest_points(edges.select(F.col("edge").alias("id"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")), nodes, snap).select(F.col("id").alias("edge"), F.col("nearest").alias(f"{k}_node"), F.col("dist").alias(f"{k}_snap")) for k in "ab"}
    asked = edges.join(ends["a"], "edge").join(ends["b"], "edge").withColumn("budget", route_budget(F.col("length")))
    found = routes(asked.select(F.col("a_node").alias("source"), F.col("b_node").alias("target"), "budget").distinct(), graph)
    out = asked.join(found, (F.col("a_node") == F.col("source")) & (F.col("b_node") == F.col("target")) & (asked["budget"] == found["budget"]), "left")
    ratio = F.try_divide("cost", F.greatest("length", F.lit(1.0)))
    out = out.select("edge", "a_snap", "b_snap", F.when(F.size("path") > 0, F.col("path")).alias("path"), "cost", ratio.alias("ratio"))
    return out.withColumn("confidence", F.when(F.col("path").isNotNull(), route_confidence(F.col("a_snap"), F.col("b_snap"), F.col("ratio"), F.size("path"))))


def path_ways(paths: DataFrame, graph: DataFrame, kind: str | None = None) -> DataFrame:
    """edge, ways: the way of each step of a path, the least id where several run there, each once and in order.

    With `kind`, a column of the graph such as the highway class, also kinds: those of the ways, each once and in order.
    """
    steps = paths.where(F.size("path") > 1).select("edge", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("from"), F.slice("path", 2, F.size("path") - 1).alias("to"))).alias("pos", "s"))
    way = graph.groupBy("from", "to").agg(F.min("way").alias("way"), *([F.min_by(kind, "way").alias("kind")] if kind else []))
    hit = steps.select("edge", "pos", F.col("s.from").alias("from"), F.col("s.to").alias("to")).join(way, ["from", "to"])
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])).alias(f"{c}s")
    return hit.groupBy("edge").agg(listed("way"), *([listed("kind")] if kind else []))
