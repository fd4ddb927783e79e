"""MinHash near-dedup with circulant signatures.

A document's set holds the hashes of its distinct 5-word shingles. *Circulant MinHash*: one permutation sigma is
applied to the set, a second one pi is shifted circularly by k = 1..K, and coordinate k is the least
pi(sigma(x) - k) over the set. BANDS bands of ROWS coordinates are hashed; with 32 x 4, a pair of Jaccard
similarity 0.75 shares no band with probability 5e-6, and a likelier miss needs a less similar pair.

Equal sets form one *class*, keyed by the set's digest (in the graph by the first 64 of its 128 bits, as wide as a
shingle's hash), before anything is paired, so a group of copies costs one row. Links are found in two ways, both
confirmed on the full sets:

1. *Hubs.* The hub of a bucket is the member whose 32 buckets hold the most members: an original that its copies were
   made from has more company than they have. Every class is compared with one hub, of the buckets it is in the one
   it shares most buckets with, so there is one pair a class at most; links are contracted to components. Measured:
   this finds all but about 1 % of the merges there are, and further rounds, with hubs outside a bucket's largest
   component, found less than 0.1 % of what they asked, so there is one round.
2. *Blocks.* In buckets that still hold several components, the members outside the largest one meet all members,
   in blocks of BLOCK members, and each pair of blocks is a task of its own. Codes are joined once a member, before
   members are dealt to blocks. 32-bit codes of the shingles give an upper bound of the common shingles that is never
   too low; of the pairs that pass it, a block reports only a spanning forest over components, likeliest first, so
   what is reported grows with the members and not with their pairs. Should a reported pair fail on the full sets,
   the step is repeated over the contracted components with other codes, until all that is reported is confirmed.

Components are found by alternating large-star and small-star steps on the links, as tables, never on the driver.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer than five
words make one shingle; rows that repeat an identifier are one document whose sets are all linked; a null
identifier is treated as larger than any other and reported as null, and rows that have it are documents of their
own, one a set (of linked ones without any identifier, one set is kept); an empty table gives no rows; other columns
are carried untouched by `keep_rows`, which drops rows by identifier and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Bloom, cut, grouped, map_arrow, session

WORDS, BANDS, ROWS = 5, 32, 4
COORDINATES = BANDS * ROWS
NUMERATOR, DENOMINATOR = 75, 100
BLOCK = 256
_NONE = (1 << 63) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = text.encode().translate(_LOWER).split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter((_word(t) for t in tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.full(n, _U(min(words, len(h))))
    with np.errstate(over="ignore"):
        for k in range(min(words, len(h))):
            out = _mix64(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


_CACHE: dict[bytes, int] = {}


def _word(t: bytes) -> int:
    """64-bit hash of a word; frequent words are remembered, up to a bound."""
    v = _CACHE.get(t)
    if v is None:
        if len(_CACHE) >= 200_000:
            _CACHE.clear()
        v = _CACHE[t] = int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")
    return v


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes (not empty)."""
    base = (_mix64(s ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)  # sigma
    out = np.empty(coordinates, np.uint32)
    step = max(1, 65_536 // len(base))
    for k in range(0, coordinates, step):
        shift = np.arange(k + 1, min(coordinates, k + step) + 1, dtype=np.uint32)
        if len(base) <= 65_536:
            out[k : k + step] = _pi(base[None, :] - shift[:, None]).min(axis=1)
        else:
            out[k] = min(int(_pi(base[i : i + 65_536] - shift[0]).min()) for i in range(0, len(base), 65_536))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        with np.errstate(over="ignore"):
            h = _mix64(h * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return h.astype(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def codes(s: np.ndarray, salt: int = 0) -> np.ndarray:
    """32-bit codes of a set; another salt gives independent ones."""
    with np.errstate(over="ignore"):
        return (_mix64(s + _U(salt)) if salt else s).astype(np.uint32)


class Marks:
    """Sets of a block by the low 16 bits of their codes, laid out once, for an upper bound of what each shares with a set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets], np.int64)
        self.low = np.concatenate(sets).astype(np.uint16) if sets else np.zeros(0, np.uint16)
        self.starts, self.table = np.cumsum(self.sizes) - self.sizes, np.zeros(1 << 16, bool)

    def common(self, mine: np.ndarray) -> np.ndarray:
        """For each set, at least as many as the shingles that it shares with `mine`.

        Most fail on the low bits; what may pass is counted on all 32.
        """
        low = mine.astype(np.uint16)
        self.table[low] = True
        most = np.add.reduceat(self.table[self.low], self.starts, dtype=np.int64)
        self.table[low] = False
        return most


def passes(common: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """May sets of `sizes`, with at most `common` shingles in a set of `size`, be similar enough?"""
    common = np.minimum(common, np.minimum(sizes, size))
    return DENOMINATOR * common >= NUMERATOR * (sizes + size - common)


def described(docs: DataFrame) -> DataFrame:
    """id, th (the text's hash), n_shingles, the set's digest (hi, lo) and bands of every row; nulls for an empty set."""

    def make():
        def each(b):
            out = {k: [] for k in ("id", "th", "n_shingles", "hi", "lo", "bands")}
            for i, th, text in zip(*(b.column(k).to_pylist() for k in ("id", "th", "txt")), strict=True):
                s = shingles(text)
                hi, lo = _digest(s) if len(s) else (None, None)
                for k, v in zip(out, (i, th, len(s), hi, lo, bands(signature(s)) if len(s) else None), strict=True):
                    out[k].append(v)
            return out

        return each

    return map_arrow(_keyed(docs), make, "id long, th long, n_shingles long, hi long, lo long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id(docs).alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("txt"))


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable, which itself is not listed) of undirected links a, b.

    Large-star and small-star steps alternate until nothing changes.

    Least neighbours are written before they are joined, so that the join of a hub of any degree can be split.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


class NearDup:
    """Classes, verified links and components of `docs`."""

    def __init__(self, docs: DataFrame):
        self.spark, self.docs = session(docs), docs
        self.rows = cut(described(docs))
        filled = self.rows.where("n_shingles > 0")
        least = filled.groupBy("hi", "lo").agg(F.min(F.struct("id", "th")).alias("m"))
        self.classes = cut(least.select("hi", "lo", "m.id", "m.th"))  # written, so that the join deals hot classes anew
        reps = self.classes.join(filled.select("hi", "lo", "id", "th", "bands"), ["hi", "lo", "id", "th"]).dropDuplicates(["hi", "lo", "id", "th"])
        keys = reps.select(F.col("hi").alias("rep"), F.posexplode("bands").alias("band", "key"))
        shared = cut(keys.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"))
        self.members = cut(keys.join(shared, ["band", "key"]).select("band", "key", "rep", "size"))
        self.sets = cut(self._sets())
        self.steps: list[tuple[str, int, int]] = []  # (step, pairs asked or reported, links), for reports
        self.component: DataFrame | None = None
        self._contract(self._same(filled).unionByName(self._linked("hubs", self._hubs())))
        salt = 0
        while (links := self._linked("blocks", self._crossing(salt))) is not None:
            self._contract(links)
            salt += 1
            if self.steps[-1][1] == self.steps[-1][2]:  # all that blocks reported is confirmed, so nothing is left
                break

    def _linked(self, step: str, pairs: DataFrame) -> DataFrame | None:
        """The pairs that are links; None where no pair was asked."""
        pairs = cut(pairs)
        n = pairs.count()
        links = cut(self._verified(pairs)) if n or step == "hubs" else None
        self.steps.append((step, n, links.count() if links is not None else 0))
        return links

    def _contract(self, links: DataFrame) -> None:
        """Join the components that new links connect."""
        if self.component is None:
            self.component = cut(components(links))
            return
        old = self.component
        at = lambda k: old.select(F.col("node").alias(k), F.col("component").alias(f"{k}_in"))
        ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
        merged = cut(components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))))
        root = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = old.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        self.component = cut(moved.unionByName(merged))  # roots were not listed before, so no node is listed twice

    def _sets(self) -> DataFrame:
        """rep, set and codes of the classes that share a bucket; a Bloom filter keeps other texts out of the shuffle."""
        need = cut(self.members.select("rep").distinct().join(self.classes.select(F.col("hi").alias("rep"), "id", "th"), "rep"))
        bits = {"hi": F.xxhash64("id", "th"), "lo": F.xxhash64("id", "th", F.lit(1))}
        maybe = Bloom.build(need.select(*(v.alias(k) for k, v in bits.items()))).column(self.spark, "hi", "lo")
        texts = _keyed(self.docs).withColumns(bits).where(maybe).select("id", "th", "txt").join(need, ["id", "th"])

        def make():
            def each(b):
                sets = [shingles(t) for t in b.column("txt").to_pylist()]
                return {"rep": b.column("rep").to_pylist(), "items": [s.view(np.int64) for s in sets], "codes": [codes(s).tobytes() for s in sets]}

            return each

        return map_arrow(texts.groupBy("id", "th", "rep").agg(F.min("txt").alias("txt")), make, "rep long, items array<long>, codes binary")

    def _same(self, filled: DataFrame) -> DataFrame:
        """Links of the sets of one identifier; a null joins nothing."""
        known = filled.where(F.col("id") != _NONE)
        several = cut(known.groupBy("id").agg(F.min("hi").alias("b"), F.max("hi").alias("most")).where("b <> most").select("id", "b"))
        return known.select("id", F.col("hi").alias("a")).join(several, "id").where("a <> b").select("a", "b").distinct()

    def _hubs(self) -> DataFrame:
        """One pair a class at most: with the hub that it shares most buckets with."""
        company = self.members.groupBy("rep").agg(F.sum("size").alias("company"))
        hub = self.members.join(company, "rep").groupBy("band", "key").agg(F.max(F.struct("company", "rep")).alias("hub"))
        pairs = self.members.join(hub, ["band", "key"]).where("rep <> hub.rep").groupBy("rep", "hub").agg(F.count("*").alias("n"))
        return pairs.groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("n", "hub")).alias("best")).select("a", F.col("best.hub.rep").alias("b"))

    def _crossing(self, salt: int) -> DataFrame:
        """Pairs of classes that share a bucket, are in different components and may be similar enough.

        A block of a bucket reports no pair between components that its likelier pairs connect.
        """
        known = self.members.join(self.component, F.col("rep") == F.col("node"), "left")
        known = cut(known.select("band", "key", "rep", F.coalesce("component", "rep").alias("comp")))
        each = known.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
        mixed = each.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("comps")).where("comps > 1")
        mixed = mixed.select("band", "key", F.col("main.comp").alias("main"), F.col("main.n").alias("n_main"), "size")
        rows = known.join(mixed, ["band", "key"]).join(self._coded(salt), "rep")
        rows = rows.select("band", "key", "rep", "comp", (F.col("comp") != F.col("main")).alias("apart"), "codes", "size", (F.col("size") - F.col("n_main")).alias("n_apart"))
        # Members outside the bucket's main component (block i of those) meet all members (block j of all).
        blocks = lambda n: F.ceil(F.col(n) / BLOCK)
        nth = lambda n, s: F.pmod(F.xxhash64("rep", F.lit(s)), blocks(n))
        rows = rows.withColumn("at_i", nth("n_apart", 1)).withColumn("at_j", nth("size", 2))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
        told = F.transform(upto("n_apart"), lambda i: F.struct(i.alias("i"), F.col("at_j").alias("j")))
        asks = F.transform(F.filter(upto("size"), lambda j: F.col("apart") & (j != F.col("at_j"))), lambda j: F.struct(F.col("at_i").alias("i"), j.alias("j")))
        rows = rows.withColumn("cell", F.explode(F.concat(told, asks)))
        rows = rows.select("band", "key", "cell.i", "cell.j", "rep", "comp", "apart", (F.col("apart") & (F.col("cell.i") == F.col("at_i"))).alias("asks"), (F.col("cell.j") == F.col("at_j")).alias("told"), "codes")

        def compare(g: dict[str, list]) -> dict[str, list]:
            sets = [np.frombuffer(x, np.uint32) for x in g["codes"]]
            rep, comp, apart = np.array(g["rep"]), np.array(g["comp"]), np.array(g["apart"])
            told, found = np.flatnonzero(g["told"]), []
            marks = Marks([sets[i] for i in told])
            for k in np.flatnonzero(g["asks"]) if len(told) else ():
                size = len(sets[k])
                most = marks.common(sets[k])
                fit = (comp[told] != comp[k]) & (~apart[told] | (rep[told] > rep[k])) & passes(most, marks.sizes, size)
                for i in np.flatnonzero(fit):
                    m = int(np.isin(marks.sets[i], sets[k]).sum())
                    if passes(m, marks.sizes[i], size):
                        m = min(m, marks.sizes[i], size)
                        found.append((m / (marks.sizes[i] + size - m), k, told[i]))
            root: dict[int, int] = {}

            def find(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            kept = []
            for _, k, i in sorted(found, key=lambda f: (-f[0], rep[f[1]], rep[f[2]])):
                p, q = find(int(comp[k])), find(int(comp[i]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    kept.append((int(rep[k]), int(rep[i])))
            return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

        return grouped(rows, ["band", "key", "i", "j"], compare, "a long, b long").distinct()

    def _coded(self, salt: int) -> DataFrame:
        """rep and codes; those of another salt are made anew."""
        if not salt:
            return self.sets.select("rep", "codes")

        def make():
            def each(b):
                return {"rep": b.column("rep"), "codes": [codes(np.array(x, np.int64).view(np.uint64), salt).tobytes() for x in b.column("items").to_pylist()]}

            return each

        return map_arrow(self.sets.select("rep", "items"), make, "rep long, codes binary")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        a, b = (self.sets.select(F.col("rep").alias(k), F.col("items").alias(f"s{k}")) for k in "ab")
        both = pairs.join(a, "a").join(b, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.withColumn("common", common).where(DENOMINATOR * F.col("common") >= NUMERATOR * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")

    def _marked(self) -> DataFrame:
        """id, th, n_shingles, comp (the smallest identifier of the component) and kept of every row."""
        filled = self.rows.where("n_shingles > 0").select("id", "th", "n_shingles", "hi", "lo")
        classes = self.classes.join(self.component, F.col("hi") == F.col("node"), "left")
        classes = cut(classes.select("hi", "lo", "id", F.coalesce("component", "hi").alias("in")))
        first = cut(classes.groupBy("in").agg(F.min(F.struct("id", "hi")).alias("m")).select("in", F.col("m.id").alias("comp"), F.col("m.hi").alias("first")))
        classes = cut(classes.select("hi", "lo", "in").join(first, "in").select("hi", "lo", "comp", "first"))
        kept = (F.col("id") == F.col("comp")) & ((F.col("id") != _NONE) | (F.col("hi") == F.col("first")))
        out = filled.join(classes, ["hi", "lo"]).select("id", "th", "n_shingles", "comp", kept.alias("kept"))
        return out.unionByName(self.rows.where("n_shingles = 0").select("id", "th", "n_shingles", F.col("id").alias("comp"), F.lit(True).alias("kept")))

    def verdicts(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        real = lambda c: F.when(F.col(c) != _NONE, F.col(c))
        return self._marked().select(real("id").alias("doc_id"), "n_shingles", real("comp").alias("component_id"), "kept")

    def keep_rows(self) -> DataFrame:
        """The rows of `docs` that stay: one of each component, with its columns."""
        gone = self._marked().where("not kept").select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
        return self.docs.join(gone, (_id(self.docs) == gone["gone_id"]) & (F.xxhash64(self.docs["text"]) == gone["gone_th"]), "left_anti")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    return NearDup(docs).verdicts()


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component) of distinct ids, comparing all pairs of word sets; for tests."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(_LOWER).split()
        sets[i] = {tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and DENOMINATOR * min(len(sets[i]), len(sets[j])) >= NUMERATOR * max(len(sets[i]), len(sets[j])):
                c = len(sets[i] & sets[j])
                if DENOMINATOR * c >= NUMERATOR * (len(sets[i]) + len(sets[j]) - c):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}

