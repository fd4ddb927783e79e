"""Exact dedup by a log-structured merge index.

Each task keeps a *memtable* of digest -> (identifier, count); a full memtable is flushed as a sorted *run*, runs of
equal tier are merged four at a time, and when a task holds HELD_ROWS entries they are written out as one run, so a
task's memory is bounded. Runs of all tasks are dealt by digest, merged by an external sort, and *compacted* as a
stream, one block at a time: one entry per digest with the kept identifier and the number of rows. Hot digests are
collapsed by the memtables, so compaction reads at most one entry per run for each. Compacted runs have *filters*;
their union decides which rows may be hits and are shuffled at all (beyond about ten million repeated digests it
saturates, which costs shuffled bytes only). A *hit* (a row whose digest has more than one row) is compared byte by
byte with the row that is kept; rows that only share the digest are regrouped by their text. Digests are computed
once, and once more for the rows whose verdict is made.

Defined results: a null text counts as empty; rows that repeat an identifier are one document and share its
verdict; a null identifier loses to any other and is reported as null; an empty table gives no rows; texts of any
length are digested and compared whole; columns whose names clash with those used here are untouched, as `docs` is
carried as one struct by `keep_rows`. Of rows that repeat both identifier and text, `keep_rows` keeps the one whose
columns are first as JSON.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Bloom, cut, map_arrow, session

MEMTABLE_ROWS = 100_000
TIER_FANOUT = 4
#: Entries that a task holds at most before it writes them out as a run.
HELD_ROWS = 16 * MEMTABLE_ROWS
_NULL_ID = {"smallest": (1 << 63) - 1, "largest": -(1 << 63)}


class Run:
    """A sorted run of distinct 128-bit digests with identifiers and counts; its filter, made when asked, guards lookups."""

    def __init__(self, hi, lo, ids, n):
        self.hi, self.lo, self.ids, self.n = hi, lo, ids, n

    @cached_property
    def filter(self) -> Bloom:
        out = Bloom(Bloom.size_for(len(self)))
        out.add(self.hi, self.lo)
        return out

    def __len__(self):
        return len(self.hi)

    def get(self, hi: int, lo: int):
        """(identifier, count) or None; the filter answers most misses without a search."""
        if not self.filter.has(np.array([hi], np.int64), np.array([lo], np.int64))[0]:
            return None
        i = np.searchsorted(self.hi, hi)
        while i < len(self) and self.hi[i] == hi:
            if self.lo[i] == lo:
                return int(self.ids[i]), int(self.n[i])
            i += 1
        return None


def merge(parts: list[tuple], keep: str) -> tuple:
    """Merge entry arrays (hi, lo, ids, n) into sorted distinct entries."""
    hi, lo, ids, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    if not len(hi):
        return hi, lo, ids, n
    order = np.lexsort((lo, hi))
    hi, lo, ids, n = hi[order], lo[order], ids[order], n[order]
    start = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    pick = np.minimum if keep == "smallest" else np.maximum
    return hi[start], lo[start], pick.reduceat(ids, start), np.add.reduceat(n, start)


class MergeIndex:
    """Memtable, tiers of runs, and compaction, for one task."""

    def __init__(self, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS):
        self.keep, self.limit, self.pending, self.rows, self.tiers = keep, memtable_rows, [], 0, []

    def add(self, hi, lo, ids, n) -> None:
        self.pending.append((hi, lo, ids, n))
        self.rows += len(hi)
        if self.rows >= self.limit:
            self.pending = [merge(self.pending, self.keep)]
            self.rows = len(self.pending[0][0])
            if self.rows >= self.limit // 2:
                self.flush()

    def flush(self) -> None:
        if self.pending:
            self.push(0, Run(*merge(self.pending, self.keep)))
        self.pending, self.rows = [], 0

    def push(self, tier: int, run: Run) -> None:
        while len(self.tiers) <= tier:
            self.tiers.append([])
        self.tiers[tier].append(run)
        if len(self.tiers[tier]) >= TIER_FANOUT:
            runs, self.tiers[tier] = self.tiers[tier], []
            self.push(tier + 1, Run(*merge([(r.hi, r.lo, r.ids, r.n) for r in runs], self.keep)))

    def get(self, hi: int, lo: int):
        """Point lookup over memtable and runs."""
        self.flush()
        found = [x for t in self.tiers for r in t if (x := r.get(hi, lo))]
        best = min if self.keep == "smallest" else max
        return (best(x[0] for x in found), sum(x[1] for x in found)) if found else None

    def __len__(self):
        return self.rows + sum(len(r) for t in self.tiers for r in t)

    def compact(self) -> tuple:
        """All entries as one run's arrays; the index is empty afterwards."""
        self.flush()
        runs = [(r.hi, r.lo, r.ids, r.n) for t in self.tiers for r in t]
        self.tiers = []
        return merge(runs, self.keep) if runs else (np.zeros(0, np.int64),) * 4


_ENTRY = "hi long, lo long, id long, n long"


def _blocks(hi, lo, ids, n):
    for i in range(0, len(hi), 20_000):
        yield {"hi": hi[i : i + 20_000], "lo": lo[i : i + 20_000], "id": ids[i : i + 20_000], "n": n[i : i + 20_000]}


def _read(b) -> tuple:
    return tuple(b.column(k).to_numpy(zero_copy_only=False) for k in ("hi", "lo", "id", "n"))


def _runs(df: DataFrame, keep: str, memtable_rows: int, held_rows: int) -> DataFrame:
    """The sorted runs that each task's index writes out."""

    def make():
        index = MergeIndex(keep, memtable_rows)

        def each(b):
            index.add(*_read(b))
            if len(index) >= held_rows:
                yield from _blocks(*index.compact())

        each.close = lambda: _blocks(*index.compact())
        return each

    return map_arrow(df.select("hi", "lo", "id", "n"), make, _ENTRY)


def _compacted(runs: DataFrame, keep: str) -> DataFrame:
    """One entry per digest: runs meet by digest in an external sort and are merged as a stream."""

    def make():
        last: list[tuple] = []  # the newest digest, which the next block may go on with

        def each(b):
            entries = merge([*last, _read(b)], keep)
            last[:] = [tuple(x[-1:] for x in entries)]
            yield from _blocks(*(x[:-1] for x in entries))

        each.close = lambda: _blocks(*last[0]) if last else ()
        return each

    return map_arrow(runs.repartition("hi", "lo").sortWithinPartitions("hi", "lo"), make, _ENTRY)


def digested(docs: DataFrame, keep: str, digest_bits: int = 128) -> DataFrame:
    """All columns as struct `row`, the text, its SHA-256, the digest halves hi and lo, and the identifier used."""
    text = F.coalesce(docs["text"], F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), text.alias("txt"), sha.alias("sha"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID[keep])).alias("id"))
    half = lambda k: F.expr(f"cast(conv(substr(sha, {16 * k + 1}, 8), 16, 10) as bigint) * 2147483648L + shiftright(cast(conv(substr(sha, {16 * k + 9}, 8), 16, 10) as bigint), 1)")
    hi, lo = half(0), half(1)
    if digest_bits < 63:
        hi, lo = F.pmod(hi, F.lit(1 << digest_bits)), F.lit(0).cast("long")
    return out.withColumn("hi", hi).withColumn("lo", lo)


class Deduped:
    """The compacted index of `docs`, its filter, and the collisions that verification found."""

    def __init__(self, docs: DataFrame, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, digest_bits: int = 128, held_rows: int = HELD_ROWS):
        if keep not in _NULL_ID:
            raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
        self.spark, self.keep = session(docs), keep
        self.rows = digested(docs, keep, digest_bits)
        runs = _runs(self.rows.select("hi", "lo", "id", F.lit(1).cast("long").alias("n")), keep, memtable_rows, held_rows)
        self.repeated = cut(_compacted(runs, keep).where("n > 1").withColumnRenamed("id", "keep_key"))
        self.filter = Bloom.build(self.repeated)
        # The possible hits with their texts, written once for verification: copies, not the whole table.
        self.hits = cut(self._maybe().where("maybe").select("hi", "lo", "id", "sha", "txt"))
        self.collided = cut(self._collisions())
        self.clean = self.collided.isEmpty()

    def _maybe(self) -> DataFrame:
        return self.rows.withColumn("maybe", self.filter.column(self.spark, "hi", "lo"))

    def _collisions(self) -> DataFrame:
        """Hits whose bytes differ from the kept row's: hi, lo, id and a strong hash of the text."""
        hits = self.hits.drop("sha")
        kept = self.repeated.select("hi", "lo", F.col("keep_key").alias("id"))
        # Grouped with the id, which a digest has one of, so that this join is dealt by id too and not by hot digests.
        kept = hits.join(kept, ["hi", "lo", "id"]).groupBy("hi", "lo", "id").agg(F.min("txt").alias("kept_txt")).drop("id")
        pairs = hits.join(kept, ["hi", "lo"])
        return pairs.where("txt <> kept_txt").select("hi", "lo", "id", F.sha2(F.col("txt").cast("binary"), 512).alias("strong"))

    def _resolved(self, columns: list[str]) -> DataFrame:
        """`columns` of the digested rows with keep_key and group_size; only possible hits are shuffled.

        Where texts share a digest, `columns` hold the text (txt), by which those rows are told apart.
        """
        rows = self._maybe().select(*columns, "hi", "lo", "id", "maybe")
        alone = rows.where("not maybe").select(*columns, "id", F.col("id").alias("keep_key"), F.lit(1).cast("long").alias("group_size"))
        hits = rows.where("maybe").drop("maybe") if "row" in columns else self.hits.select(*columns, "hi", "lo", "id")
        hits = hits.join(self.repeated, ["hi", "lo"], "left")
        if self.clean:
            found = hits.select(*columns, "id", F.coalesce("keep_key", "id").alias("keep_key"), F.coalesce("n", F.lit(1)).alias("group_size"))
        else:
            best = F.min if self.keep == "smallest" else F.max
            lost = self.collided.groupBy("hi", "lo").agg(F.count("*").alias("lost"))
            own = self.collided.groupBy("hi", "lo", "strong").agg(best("id").alias("own_key"), F.count("*").alias("own_n"))
            own = self.collided.select("hi", "lo", "id", "strong").distinct().join(own, ["hi", "lo", "strong"])
            hits = hits.withColumn("strong", F.sha2(F.col("txt").cast("binary"), 512))
            hits = hits.join(lost, ["hi", "lo"], "left").join(own, ["hi", "lo", "id", "strong"], "left")
            found = hits.select(*columns, "id", F.coalesce("own_key", "keep_key", "id").alias("keep_key"), F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0)), F.lit(1)).alias("group_size"))
        return alone.unionByName(found)

    def verdicts(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
        columns = ["sha"] if self.clean else ["sha", "txt"]
        real = lambda c: F.when(F.col(c) != F.lit(_NULL_ID[self.keep]), F.col(c))
        return self._resolved(columns).select(real("id").alias("doc_id"), real("keep_key").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_key")).alias("kept"), F.col("sha").alias("text_sha256"))

    def keep_rows(self) -> DataFrame:
        """The rows of `docs` that stay, with their columns. Rows that repeat both id and text stay once."""
        columns = ["row", "sha"] if self.clean else ["row", "sha", "txt"]
        stay = self._resolved(columns).where("id = keep_key")
        again = stay.where("group_size > 1").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
        return stay.where("group_size = 1").select("row").unionByName(again.select("row")).select("row.*")


def exact_dedup(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    return Deduped(docs, keep, **options).verdicts()


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
