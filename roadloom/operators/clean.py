"""Cleaning: keep-first, latest-by, ordered concatenation, directed links, dense indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.lineage import cut


#: Link attributes that a merged pair takes the mean, or the first present value, of.
LINK_MEANS = ("speed", "jam_density", "wave_speed")
LINK_FIRSTS = ("link_type", "name", "link_type_name", "geometry", "original_geometry")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, typed; those that are absent are null."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have every key."""
    return df.na.drop(subset=list(keys))


def completed(agents: DataFrame, flag: str = "complete_flag") -> DataFrame:
    """Agents whose flag is c, without regard to case and blanks; all of them where there is no such column."""
    return agents.where(F.lower(F.trim(F.col(flag))) == "c") if flag in agents.columns else agents


def without(df: DataFrame, column: str, excluded: Sequence) -> DataFrame:
    """Rows whose value is not among the excluded ones; a null is not."""
    return df.where(F.coalesce(~F.col(column).isin(*excluded), F.lit(True))) if excluded else df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key by an explicit order, nulls first; input order does not exist.

    An aggregate, so that hot keys are combined before the shuffle and nothing is sorted.
    """
    row, by = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(row, by).alias("_first")).select("_first.*")


def latest(df: DataFrame, key: str, when: str, ordinal: str) -> DataFrame:
    """The newest row of each key; of equally new ones the first. An aggregate, so hot keys are combined early."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(when), -F.col(ordinal)))
    return df.groupBy(key).agg(best.alias("_best")).select("_best.*")


def first_present(c: str, ordinal: str) -> Column:
    """First non-null value by ordinal."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal)))


def joined_in_order(c: str, ordinal: str, sep: str = ";") -> Column:
    """Values in order; a null prints nan."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v"))))
    return F.array_join(F.transform(rows, lambda s: s["v"]), sep)


def joined_distinct(c: str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), sep)


def direct(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed links: direction -1 turns a link around, 0 and 2 give both ways, anything else goes forward.

    A length that is not positive is the straight distance in thousandths of the node unit.
    """
    one = lambda a, b, flag: F.struct(F.col(a).alias("from_node_id"), F.col(b).alias("to_node_id"), F.lit(flag).alias("direction_flag"))
    forth, back = one("from_node_id", "to_node_id", "forward"), one("to_node_id", "from_node_id", "reverse")
    d = F.col("direction")
    ways = F.when(d == -1, F.array(back)).when(d.isin(0, 2), F.array(forth, back)).otherwise(F.array(forth))
    rest = [c for c in links.columns if c not in ("from_node_id", "to_node_id", "direction")]
    out = links.select(*rest, F.explode(ways).alias("_way")).select("_way.*", *rest)
    at = lambda k: nodes.select(F.col("node_id").alias(f"{k}_node_id"), F.col("x").alias(f"_x{k}"), F.col("y").alias(f"_y{k}"))
    out = out.join(at("from"), "from_node_id", "left").join(at("to"), "to_node_id", "left")
    straight = F.hypot(F.col("_xfrom") - F.col("_xto"), F.col("_yfrom") - F.col("_yto")) / 1000
    length = F.when((F.col("length") > 0) & ~F.isnan("length"), F.col("length")).otherwise(straight)
    return out.withColumn("length", length).drop("_xfrom", "_yfrom", "_xto", "_yto")


def merge_links(links: DataFrame, ordinal: str) -> DataFrame:
    """One row a directed pair, with the dense edge_index by (from, to).

    Means, first values and link_keys are of the columns that `links` has. Only the pairs themselves are numbered, and the
    wide rows meet them afterwards.
    """
    have = lambda names: [c for c in names if c in links.columns]
    out = links.groupBy("from_node_id", "to_node_id").agg(
        F.min("length").alias("length"),
        F.coalesce(F.sum("lanes"), F.lit(0.0)).alias("lanes"),
        F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("capacity"),
        *(F.avg(c).alias(c) for c in have(LINK_MEANS)),
        *(first_present(c, ordinal).alias(c) for c in have(LINK_FIRSTS)),
        joined_distinct("direction_flag").alias("direction_flag"),
        joined_in_order("link_id", ordinal).alias("link_ids"),
        *([joined_in_order("link_key", ordinal).alias("link_keys")] if "link_key" in links.columns else []),
    )
    out = out.withColumn("edge_id", F.concat_ws("->", "from_node_id", "to_node_id"))
    out = cut(out)  # aggregated once, for its rows and for their keys
    keys = dense_index(out.select("from_node_id", "to_node_id"), ["from_node_id", "to_node_id"], "edge_index")
    return out.join(keys, out["from_node_id"].eqNullSafe(keys["from_node_id"]) & out["to_node_id"].eqNullSafe(keys["to_node_id"])).select(*(out[c] for c in out.columns), "edge_index")


def dense_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based row numbers in a global order, without sorting everything in one task.

    Rows are range-partitioned; each partition numbers its own and adds the sizes of those before it. Bounds are
    sampled, so the dealt rows are fixed by a checkpoint before they are counted and numbered.
    """
    if name in df.columns:
        df = df.drop(name)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = cut(parts).withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("_part").count()
    # One row a partition, so their running sum may be one task's.
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, (F.col("_nth") + F.col("_before")).cast("bigint")).drop("_at", "_part", "_nth", "_before")
