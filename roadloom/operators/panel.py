"""Edge-time and node-time panels, paths and their segments, wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import occupancy_bins, to_int, to_num
from roadloom.operators.quantiles import quantiles


def edge_flow(moves: DataFrame, bin_col: str = "time_bin", weight: str | None = None) -> DataFrame:
    """time_bin, from, to, x: summed weights (1 where none is given, or where a weight is null or not positive)."""
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0))
    return moves.where(F.col(bin_col).isNotNull()).groupBy(F.col(bin_col).alias("time_bin"), "from", "to").agg(F.sum(w).alias("x"))


def dense(flow: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """The flow at every bin of every edge, 0 where none was seen.

    The spine is a generator on each edge, so no join makes it; flow meets it by an equi-join.
    """
    spine = edges.select("from", "to").distinct().select("from", "to", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("time_bin"))
    return spine.join(flow, ["time_bin", "from", "to"], "left").select("time_bin", "from", "to", F.coalesce("x", F.lit(0.0)).alias("x"))


def node_flow(flow: DataFrame) -> DataFrame:
    """time_bin, node, in_flow, out_flow, net_flow of nodes with any flow, from one pass over the edges."""
    both = flow.select("time_bin", F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(0.0).alias("i"), F.col("x").alias("o")), F.struct(F.col("to").alias("node"), F.col("x").alias("i"), F.lit(0.0).alias("o")))).alias("s"))
    out = both.groupBy("time_bin", F.col("s.node").alias("node")).agg(F.sum("s.i").alias("in_flow"), F.sum("s.o").alias("out_flow"))
    return out.withColumn("net_flow", F.col("out_flow") - F.col("in_flow"))


def node_moves(moves: DataFrame, bin_col: str = "time_bin") -> DataFrame:
    """node_flow of moves (bin, from, to) counted once each: both ends at once, so one shuffle instead of two."""
    end = lambda node, i, o: F.struct(F.col(node).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    both = moves.where(F.col(bin_col).isNotNull()).select(F.col(bin_col).alias("time_bin"), F.explode(F.array(end("from", 0.0, 1.0), end("to", 1.0, 0.0))).alias("s"))
    out = both.groupBy("time_bin", F.col("s.node").alias("node")).agg(F.sum("s.i").alias("in_flow"), F.sum("s.o").alias("out_flow"))
    return out.withColumn("net_flow", F.col("out_flow") - F.col("in_flow"))


def dense_nodes(flow: DataFrame, nodes: DataFrame, bins: int, minutes: int = 5) -> DataFrame:
    """node_flow at every bin of every node (column node), 0 where none was seen, with the bin's start and end minute."""
    spine = nodes.where(F.col("node").isNotNull()).select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("time_bin"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = spine.join(flow.select("time_bin", "node", "in_flow", "out_flow"), ["time_bin", "node"], "left")
    at = F.col("time_bin") * minutes
    return out.select("time_bin", at.alias("start_min"), (at + minutes).alias("end_min"), "node", zero("in_flow"), zero("out_flow")).withColumn("net_flow", F.col("out_flow") - F.col("in_flow"))


#: Link performance columns that are added up, averaged, or taken at their largest.
MOE_SUMS = (
    "link_in_volume_number_of_veh", "link_out_volume_number_of_veh", "link_volume_in_veh_per_hour_per_lane", "link_volume_in_veh_per_hour_for_all_lanes",
    "total_energy", "total_CO2", "total_NOX", "total_CO", "total_HC",
)
MOE_MEANS = ("travel_time_in_min", "delay_in_min", "density_in_veh_per_distance_per_lane", "speed", "queue_length_percentage", "number_of_queued_vehicles")
MOE_MAXIMA = ("cumulative_arrival_count", "cumulative_departure_count")


def moe_features(rows: DataFrame, ordinal, minutes: int = 5) -> DataFrame:
    """Link performance rows (from_node_id, to_node_id, timestamp_in_min, measures) by bin and edge.

    Only measures that are present are given; texts are read as numbers; rows without a key are left out. day_no is
    the first present one by `ordinal`, as input order does not exist.
    """
    for c in ("from_node_id", "to_node_id", "timestamp_in_min"):
        if c not in rows.columns:
            raise ValueError(f"missing column: {c}")
    number = lambda c: to_num(c)
    keyed = rows.withColumns({"from_node_id": to_int("from_node_id"), "to_node_id": to_int("to_node_id"), "_t": number("timestamp_in_min")})
    keyed = keyed.where(F.col("from_node_id").isNotNull() & F.col("to_node_id").isNotNull() & F.col("_t").isNotNull())
    have = lambda names: [c for c in names if c in rows.columns]
    aggs = [F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(c) for c in have(MOE_SUMS)] + [F.avg(number(c)).alias(c) for c in have(MOE_MEANS)] + [F.max(number(c)).alias(c) for c in have(MOE_MAXIMA)]
    if "day_no" in rows.columns:
        aggs.append(F.min_by(number("day_no"), F.when(number("day_no").isNotNull(), ordinal)).alias("day_no"))
    out = keyed.groupBy(F.floor(F.col("_t") / minutes).cast("int").alias("time_bin"), "from_node_id", "to_node_id").agg(*(aggs or [F.count("*").alias("records")]))
    at = F.col("time_bin") * minutes
    return out.withColumns({"start_min": at, "end_min": at + minutes, "edge_id": F.concat_ws("->", "from_node_id", "to_node_id")})


def moe_check(features: DataFrame, flow: DataFrame, column: str = "link_in_volume_number_of_veh") -> DataFrame:
    """Features with the counted flow x (time_bin, from, to), 0 where none, and the difference to a volume column."""
    counted = flow.select("time_bin", F.col("from").alias("from_node_id"), F.col("to").alias("to_node_id"), "x")
    out = features.select("time_bin", "from_node_id", "to_node_id", "edge_id", column).join(counted, ["time_bin", "from_node_id", "to_node_id"], "left")
    out = out.withColumn("x", F.coalesce("x", F.lit(0.0)))
    return out.withColumn("difference", F.col("x") - F.col(column)).withColumn("abs_difference", F.abs("difference"))


def enriched(flow: DataFrame, links: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """Flow (time_bin, from, to, x) of known links with their attributes, and capacities by edge_index where there are any."""
    attributes = links.withColumnsRenamed({"from_node_id": "from", "to_node_id": "to"})
    out = flow.join(attributes, ["from", "to"])
    return out.join(capacity, "edge_index", "left") if capacity is not None else out


def network_metrics(flow: DataFrame, metric: str, threshold: float, visible: int, total: str = "x", against: str | None = None) -> DataFrame:
    """One row a bin: active and congested edges and their shares of the visible ones, the total, and the metric's mean, p95 and maximum."""
    high = F.col(against or metric) >= threshold
    share = lambda n: F.when(F.lit(visible) > 0, F.bround(F.col(n) / max(visible, 1), 4)).otherwise(F.lit(0.0))
    out = flow.groupBy("time_bin").agg(
        F.count("*").alias("active_edges"), F.count_if(high).alias("congested_edges"), F.sum(total).alias("total"), F.avg(metric).alias("mean"), F.max(metric).alias("max"),
    )
    p95 = quantiles(flow, ["time_bin"], metric, (0.95,)).select("time_bin", F.col("q")[0].alias("p95"))
    out = out.join(p95, "time_bin", "left")
    return out.withColumns({"active_share": share("active_edges"), "congested_share": share("congested_edges")})


def wide(long: DataFrame, index: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """A column a name, summed, 0 where none; names are given so that no extra pass finds them."""
    return long.groupBy(index).pivot(name, sorted(names)).agg(F.sum(value)).na.fill(0.0)


def long(table: DataFrame, index: Sequence[str], names: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return table.unpivot(list(index), list(names), name, value)


def path_segments(paths: DataFrame, nodes: str = "nodes", times: str = "times") -> DataFrame:
    """Steps k -> k + 1 of each path: from, to, enter, leave; a path of fewer than two nodes has none."""
    steps = F.least(F.size(nodes), F.size(times)) - 1
    k = F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1)
    pair = F.transform(k, lambda i: F.struct(i.alias("step"), F.get(nodes, i).alias("from"), F.get(nodes, i + 1).alias("to"), F.get(times, i).alias("enter"), F.get(times, i + 1).alias("leave")))
    rest = [c for c in paths.columns if c not in (nodes, times)]
    return paths.where(steps >= 1).select(*rest, F.explode(pair).alias("_s")).select(*rest, "_s.*")


def segment_status(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds `status`: bad (a time missing or not finite), skipped (left before entered), missing (no such edge), ok."""
    known = edges.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.lit(True).alias("_known")).distinct()
    out = segments.join(known, (F.col("from") == F.col("_f")) & (F.col("to") == F.col("_t")), "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    status = F.when(~(finite("enter") & finite("leave")), "bad").when(F.col("leave") < F.col("enter"), "skipped").when(F.col("_known").isNull(), "missing").otherwise("ok")
    return out.withColumn("status", status).drop("_f", "_t", "_known")


def missing_edges(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """from, to, count of steps over pairs that are no edge."""
    return segments.join(edges.select("from", "to").distinct(), ["from", "to"], "left_anti").groupBy("from", "to").agg(F.count("*").alias("count"))


def occupancy(segments: DataFrame, width: float = 5.0, horizon: float = 1440.0) -> DataFrame:
    """time_bin, from, to, x: every bin that a stay overlaps counts it once."""
    bins = segments.select("from", "to", F.explode(occupancy_bins("enter", "leave", width, horizon)).alias("time_bin"))
    return edge_flow(bins)


def run_summary(paths: DataFrame, segments: DataFrame, edges: DataFrame, width: float = 5.0, horizon: float = 1440.0, nodes: str = "nodes", times: str = "times") -> DataFrame:
    """One row of a run's counters: agents (paths; bad ones have fewer than two usable nodes), edge traversals, segments.

    An agent is used when it is not bad. A traversal is missing when its pair is no edge; of the others, a segment is bad
    when a time is missing, skipped when it ends before it starts or outlasts the horizon, else counted, and updates as
    many bins as it overlaps. Both inputs are read once; their one-row sums meet.
    """
    usable = F.least(F.size(nodes), F.size(times)) >= 2
    agents = paths.agg(F.count("*").alias("total_agents"), F.count_if(F.coalesce(usable, F.lit(False))).alias("used_agents"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("bad_agents"))
    known = edges.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.lit(True).alias("_known")).distinct()
    s = segments.join(known, (F.col("from") == F.col("_f")) & (F.col("to") == F.col("_t")), "left").withColumn("_known", F.col("_known").isNotNull())
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    bad = F.col("_known") & ~(finite("enter") & finite("leave"))
    bins = F.size(occupancy_bins("enter", "leave", width, horizon))
    s = s.withColumn("_bad", bad).withColumn("_bins", F.when(F.col("_known") & ~F.col("_bad"), bins))
    sums = s.agg(
        F.count("*").alias("total_traversals"), F.count_if("_known").alias("used_traversals"), F.count_if(~F.col("_known")).alias("missing_traversals"),
        F.count_if(F.col("_bins") > 0).alias("counted_segments"), F.count_if(F.col("_bins") == 0).alias("skipped_segments"), F.count_if("_bad").alias("bad_segments"),
        F.coalesce(F.sum("_bins"), F.lit(0)).alias("bin_updates"), F.max("leave").alias("max_time"),
    )
    return agents.crossJoin(sums)  # one row each


def counters(segments: DataFrame) -> DataFrame:
    """One row of run counters in one pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    return segments.agg(F.count("*").alias("segments"), n("ok").alias("used"), n("bad").alias("bad"), n("skipped").alias("skipped"), n("missing").alias("missing"), F.max("leave").alias("max_time"))


def ranked(rows: DataFrame, value: str, ties: list[str], name: str = "rank") -> DataFrame:
    """Adds the place of each row by falling value, then by the tie columns, from 1; numbered by ranges, in many tasks."""
    from roadloom.operators.clean import dense_index

    out = dense_index(rows.withColumn("_less", -F.col(value)), ["_less", *ties], name)
    return out.withColumn(name, F.col(name) + 1).drop("_less")
