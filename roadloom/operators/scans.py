"""Segmented scans: running values by key in order, where one key may hold most rows.

A window puts all rows of a key into one task. Here rows are range-partitioned by key and order, so a key spans as many
tasks as it needs; each partition is scanned on its own, each leaves a boundary state for every key in it, and a second
pass adds what stands before (or after) the partition. As partitions are ranges, only the first and the last key of a
partition go on in others: the states that the second pass needs are two rows a partition at most, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.lineage import cut

#: Where no key has more rows than this, a key's rows are scanned by one task's window, which gives the same values.
ONE_TASK_ROWS = 1_000_000
#: Rows of a block in `leads`.
BLOCK_ROWS = 100_000


class Scan:
    """Rows with keys and a total order; each method adds a column, `done` returns the rows.

    `most` is how many rows a key has at most where the caller knows it, which saves counting them.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], one_task: int = ONE_TASK_ROWS, most: int | None = None):
        self.keys, self.order = list(keys), list(order)
        if most is None:
            most = rows.count()
            if most > one_task:
                most = rows.groupBy(*self.keys).count().agg(F.max("count")).first()[0] or 0
        self.split = most > one_task
        if self.split:  # range bounds are sampled, so the dealing is fixed
            rows = cut(rows.repartitionByRange(*self.keys, *self.order).withColumn("_part", F.spark_partition_id()))
        self.rows = rows
        self.group = [*self.keys, *(["_part"] if self.split else [])]
        self.window = Window.partitionBy(*self.group).orderBy(*self.order)

    def done(self) -> DataFrame:
        return self.rows.drop("_part")

    def _state(self, state: Column, carried, add) -> Scan:
        """Join to each partition what `carried(window over a key's partitions)` makes of all its partitions' states."""
        over = Window.partitionBy(*self.keys)
        per = self.rows.groupBy(*self.group).agg(state.alias("_scan_state"))
        per = per.withColumn("_scan_parts", F.count("*").over(over)).where(F.col("_scan_parts") > 1)
        per = per.select(*(F.col(k).alias(f"_scan_key{i}") for i, k in enumerate(self.keys)), F.col("_part").alias("_scan_part"), carried(over.orderBy("_part")).alias("_scan_carry"))
        on = F.col("_part") == F.col("_scan_part")
        for i, k in enumerate(self.keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_scan_key{i}"))
        both = self.rows.join(F.broadcast(per), on, "left")  # two rows a partition at most
        self.rows = add(both).drop("_scan_part", "_scan_carry", *(f"_scan_key{i}" for i in range(len(self.keys))))
        return self

    def sum(self, name: str, value: Column) -> Scan:
        """The sum of a value from the key's first row to this one; nulls count as 0."""
        v = F.coalesce(value, F.lit(0))
        self.rows = self.rows.withColumn(name, F.sum(v).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))
        if not self.split:
            return self
        before = lambda w: F.sum("_scan_state").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return self._state(F.sum(v), before, lambda d: d.withColumn(name, F.col(name) + F.coalesce("_scan_carry", F.lit(0))))

    def number(self, name: str) -> Scan:
        """The row's number in its key, from 1."""
        return self.sum(name, F.lit(1).cast("bigint"))

    def _at(self) -> Column:
        return F.struct(*self.order)

    def last(self, name: str, value: Column) -> Scan:
        """The latest value up to this row that is not null."""
        held = F.when(value.isNotNull(), F.struct(value.alias("v")))
        mine = F.last(held, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            self.rows = self.rows.withColumn(name, mine["v"])
            return self
        self.rows = self.rows.withColumn(name, mine)
        before = lambda w: F.last("_scan_state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return self._state(F.max_by(held, F.when(value.isNotNull(), self._at())), before, lambda d: d.withColumn(name, F.coalesce(name, "_scan_carry")["v"]))

    def first(self, name: str, value: Column) -> Scan:
        """The next value from this row on that is not null."""
        held = F.when(value.isNotNull(), F.struct(value.alias("v")))
        mine = F.first(held, ignorenulls=True).over(self.window.rowsBetween(0, Window.unboundedFollowing))
        if not self.split:
            self.rows = self.rows.withColumn(name, mine["v"])
            return self
        self.rows = self.rows.withColumn(name, mine)
        after = lambda w: F.first("_scan_state", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        return self._state(F.min_by(held, F.when(value.isNotNull(), self._at())), after, lambda d: d.withColumn(name, F.coalesce(name, "_scan_carry")["v"]))

    def lag(self, name: str, value: Column) -> Scan:
        """The value of the row before, null at a key's first."""
        return self._beside(name, value, F.lag, F.max_by, lambda w: F.lag("_scan_state").over(w))

    def lead(self, name: str, value: Column) -> Scan:
        """The value of the row after, null at a key's last."""
        return self._beside(name, value, F.lead, F.min_by, lambda w: F.lead("_scan_state").over(w))

    def _beside(self, name, value, step, pick, carried) -> Scan:
        held = F.struct(value.alias("v"))
        mine = step(held).over(self.window)
        if not self.split:
            self.rows = self.rows.withColumn(name, mine["v"])
            return self
        self.rows = self.rows.withColumn(name, mine)
        return self._state(pick(held, self._at()), carried, lambda d: d.withColumn(name, F.coalesce(name, "_scan_carry")["v"]))


def leads(rows: DataFrame, keys: Sequence[str], number: str, values: dict[str, tuple[Column, int]], block: int = BLOCK_ROWS) -> DataFrame:
    """Adds columns: the value (column, lag) of the row so many further on, for rows numbered without gaps from 1 by key.

    A key's rows are cut into blocks; the first rows of a block go to the one before it too, as many as the longest lag."""
    far = max(n for _, n in values.values())
    block = max(block, far)
    at = F.floor((F.col(number) - 1) / block)
    own = F.struct(at.alias("b"), F.lit(True).alias("own"))
    copy = F.when((at > 0) & ((F.col(number) - 1) % block < far), F.array(own, F.struct((at - 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(own))
    dealt = rows.withColumn("_at", F.explode(copy)).select(*rows.columns, F.col("_at.b").alias("_block"), F.col("_at.own").alias("_own"))
    w = Window.partitionBy(*keys, "_block").orderBy(number)
    return dealt.withColumns({k: F.lead(v, n).over(w) for k, (v, n) in values.items()}).where("_own").drop("_block", "_own")
