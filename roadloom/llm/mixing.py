"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S takes each of its documents T / S times on average: floor(T / S) copies for
certain and one more with the fractional probability. Pivotal rounding settles the fractions: two documents
trade probability, in proportion to their words, until one of them is at 0 or 1. A trade keeps every document's
expected copies and the source's expected *words* exactly, so a source misses its target by less than one
document. Documents are dealt to leaves of a few thousand by a hash of their identifier, their text, and, for rows
that are equal in both, the number of the row among those; each leaf leaves at most one fraction per source, and
these residuals meet in a reduction tree, LEAF_FANOUT nodes at a time. A hot source, or one repeated row, has as many
leaves as its rows ask for. The generator of a node is seeded by source, level and node, so reruns and retried tasks
agree. Sources may be many (hosts, say): their totals and targets stay in tables, and only sums over all of them are
read by the driver.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source, listed last;
a source without words has target 0; rows that repeat an identifier are separate rows; an empty table gives no rows;
texts of any length are counted whole; of `docs`, only doc_id, text and source are read by `mix`, whatever other
columns are named, and `mixed_rows` returns the columns of `docs` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import cut, session
from roadloom.operators.clean import dense_index

LEAF_ROWS, LEAF_FANOUT = 2048, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: Sequence[float], budget: float, cap: float) -> dict:
    """Words each source is to give, in memory, as `_plan` has them in tables: `budget` times all words shared by weight, each at most `cap` times its own."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in order if s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        left -= sum(out[s] for s in over)
    return out


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
    """Round probabilities p in place, keeping sum(p * w); at most one of them stays between 0 and 1."""
    u = rng.random(len(p) + 1)
    held = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if w[j] == 0:
            p[j] = float(u[j] < p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min((1 - p[i]) * w[i], p[j] * w[j]), min(p[i] * w[i], (1 - p[j]) * w[j])
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / w[i]
        p[j] -= move / w[j]
        for k in (i, j):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = round(p[k])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1


def _settle(level: int, last: bool, seed: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "p"], ascending=False, kind="stable").reset_index(drop=True)  # a small document is left last
        s, node = pdf["source"].iloc[0], int(pdf["node"].iloc[0])
        key = f"{seed}|{level}|{node}|{'-' if pd.isna(s) else '+' + s}".encode()
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big"))
        p, w = pdf["p"].to_numpy(np.float64).copy(), pdf["size"].to_numpy(np.float64)
        pivot(p, w, rng)
        if last:
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
        return pdf.assign(p=p)

    return settle


def _plan(rows: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """src, source_size, n, target of every source, as `targets` has them, by aggregates alone.

    A source is capped when the words left for each unit of weight would give it more than its cap; capping one
    raises that level for the others, so it rises until no source is newly capped.
    """
    totals = cut(rows.groupBy(F.col("source").alias("src")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    rank = dense_index(totals.withColumn("last", F.col("src").isNull()), ["last", "src"], "rank").drop("last")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = cut(rank.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)))
    words = plan.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("most") < F.col("weight") * level
        n, given, left = plan.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (budget * words - (given or 0.0)) / left
    return plan.select("src", "source_size", "n", F.least("most", F.col("weight") * level).alias("target"))


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs["doc_id"], docs["source"], size.alias("size"), key.alias("key"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken."""
    return _mixed(_keyed(docs, F.xxhash64(docs["doc_id"], docs["text"])), weights, budget, cap, seed).drop("key")


def _mixed(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """`mix` of rows (doc_id, source, size, key), with their key."""
    session(rows)
    rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    rows = rows.select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("nth"))
    rows = cut(rows.withColumn("id", F.xxhash64("key", "nth")).drop("nth"))
    plan = cut(_plan(rows, weights, budget, cap))
    most = max(1, -(-(plan.agg(F.max("n")).first()[0] or 0) // LEAF_ROWS))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["src"]))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    leaves = F.greatest(F.ceil(F.col("n") / LEAF_ROWS), F.lit(1))
    rows = rows.select("doc_id", "source", "size", "key", "id", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"), F.pmod("id", leaves).alias("node"))
    kind, level, done = rows.schema, 0, []
    while True:
        last = most == 1
        rows = cut(rows.groupBy("source", "node").applyInPandas(_settle(level, last, seed), kind))
        if last:
            done.append(rows)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.where(~open_))
        rows = rows.where(open_).withColumn("node", F.floor(F.col("node") / LEAF_FANOUT))
        level, most = level + 1, -(-most // LEAF_FANOUT)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows are told apart by all their columns, those of maps and variants by their JSON; rows that are equal in all are
    taken as often as the mix takes them together.
    """
    odd = [c for c, t in docs.dtypes if "map<" in t or "variant" in t]  # have no hash of their own
    plain = [docs[f"`{c}`"] for c in docs.columns if c not in odd]
    key = F.xxhash64(*plain, *(F.to_json(F.struct(docs[f"`{c}`"]), {"ignoreNullFields": "false"}) for c in odd))
    taken = _mixed(_keyed(docs, key), **options).groupBy("key").agg(F.sum("copies").alias("times"), F.count("*").alias("rows")).where("times > 0")
    taken = cut(taken.withColumnRenamed("key", "_key"))
    found = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key.alias("_key")).join(taken, "_key")
    again = found.where("rows > 1").groupBy("_key", "times").agg(F.min_by("row", F.to_json("row")).alias("row"))
    found = found.where("rows = 1").select("row", "times").unionByName(again.select("row", "times"))
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
