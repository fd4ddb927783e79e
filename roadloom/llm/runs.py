"""Periodic runs of words by block matching.

Words are numbered by first occurrence. For each power of two L the *aligned blocks* of L words are the keys of an
integer-sequence automaton, which is run over the whole document. From 16 words on a key is a sequence of eight numbers,
each that of an eighth of the block among all stretches of its length, and the document is read once for each offset
modulo an eighth: keys stay short, as the automaton's library walks all suffixes of a match. A run of period q and length 3q or more (24 or more)
that q suits to L (q in L to 2L - 1; all q below 16 for L = 8) holds an aligned block that occurs again q words later, as
2L - 1 words of the run less its last period hold one. So each block and each occurrence of it at a distance that suits
the scale is a *seed*, which is extended in both directions over all i with word i = word i + q, exactly and for as long
as that holds. A block of 2L words is a key only where both halves occur twice or more: it could not recur otherwise.

Repetitive texts have many seeds for few runs. A seed inside a stretch already found for its distance is dropped; so is
one whose block and later occurrence lie in one run of a period that divides the distance. A block of small period t
occurs every t words along a whole stretch of period t; of these occurrences only those keep the rank of a seed
that line up an end of the block's own stretch with the same end of theirs, since a longer period maps stretches onto
stretches. A stretch of a period that has a smaller period is no run and is dropped.

Defined results: a null text counts as empty and has no words; texts of fewer than 24 words have no run; of runs with
equal exponents the one with the smallest start, then period, is reported; no run leaves four nulls; a null identifier
counts as the empty text where the repeats are planted; rows that repeat an identifier and text have equal results; texts
of any length are read whole, one scale's automaton at a time, with one node a word at most; an empty table gives no
rows; columns of `docs` named as a result are replaced by it, all others stay untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, session

#: A run has this many words and periods at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: The smallest block: two periods of a run of MIN_WORDS words hold an aligned one for each period below twice its length.
FIRST = 8
#: Beyond this many occurrences a block has, by the lengths involved, a small period.
FEW = 4


def number(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _agree(x: np.ndarray, i: int, d: int, step: int) -> int:
    """How many k = 0, 1, ... in a row have x[i + k * step] = x[i + k * step + d]; looks at twice as many each time."""
    done, size = 0, 16
    most = len(x) - d - i if step > 0 else i + 1
    while done < most:
        n = min(size, most - done)
        lo = i + done if step > 0 else i - done - n + 1
        same = x[lo : lo + n] == x[lo + d : lo + d + n]
        bad = np.flatnonzero(~same)
        if len(bad):
            return done + int(bad[0] if step > 0 else n - 1 - bad[-1])
        done, size = done + n, size * 2
    return done


class Stretches:
    """Maximal stretches of each distance found so far, as sorted disjoint starts of word pairs that agree."""

    def __init__(self, x: np.ndarray):
        self.x, self.at = x, {}

    def of(self, i: int, d: int) -> tuple[int, int]:
        """The stretch [a, b) of words around the agreeing pair (i, i + d); found once, then looked up."""
        starts, ends = self.at.setdefault(d, ([], []))
        k = bisect_right(starts, i)
        if k and i + d < ends[k - 1]:
            return starts[k - 1], ends[k - 1]
        a = i - _agree(self.x, i, d, -1) + 1
        b = i + _agree(self.x, i, d, 1) + d
        starts.insert(k, a)
        ends.insert(k, b)
        return a, b

    def known(self, i: int, d: int) -> bool:
        starts, ends = self.at.get(d, ((), ()))
        k = bisect_right(starts, i)
        return k > 0 and i + d < ends[k - 1]


def _factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _primitive(x: np.ndarray, a: int, d: int) -> bool:
    """Whether no smaller period holds in a stretch from a on, of period d and two periods at least."""
    return not any(np.array_equal(x[a : a + d], x[a + d // p : a + d + d // p]) for p in _factors(d))


def _small_period(hits: np.ndarray, length: int) -> int:
    """The gap of occurrences that overlap by half, which is the block's period; 0 where none do."""
    gaps = np.diff(hits)
    least = int(gaps.min()) if len(gaps) else 0
    return least if 0 < least <= length // 2 else 0


def _occurrences(names: np.ndarray, stride: int, blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(block, position) of all occurrences of blocks of FIRST names, each `stride` words after the one before, by block and position.

    The document is read once for each offset modulo `stride`, with a name that no block has between the readings."""
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, b in enumerate(blocks):
        keys.add_word(b, k)
    keys.make_automaton()
    rows = -(-len(names) // stride) + 1
    read = np.full(rows * stride, int(names.max()) + 1, np.int64)
    read[: len(names)] = names
    found = np.array(list(keys.iter(tuple(read.reshape(rows, stride).T.ravel().tolist()))), np.int64).reshape(-1, 2)
    at = found[:, 0] - (FIRST - 1)
    at, kinds = at % rows * stride + at // rows, found[:, 1]
    order = np.lexsort((at, kinds))
    return kinds[order], at[order]


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, found, stride, names = len(x), set(), 1, x
    if n < MIN_WORDS:
        return []
    stretches, alive = Stretches(x), np.arange(n // FIRST)
    while len(alive):
        size = FIRST * stride
        blocks: dict[tuple, int] = {}
        mine = np.array([blocks.setdefault(tuple(b), len(blocks)) for b in names[alive[:, None] * size + np.arange(FIRST) * stride].tolist()])
        kinds, hits = _occurrences(names, stride, list(blocks))
        ends = np.searchsorted(kinds, np.arange(len(blocks) + 1))
        again = np.diff(ends)[mine] > 1
        code, at = kinds * (n + 1) + hits, alive * size
        lo = np.searchsorted(code, mine * (n + 1) + at + (1 if stride == 1 else size))
        hi = np.searchsorted(code, mine * (n + 1) + np.minimum(at + 2 * size, n))
        for j in np.flatnonzero(hi > lo).tolist():
            i, near = int(at[j]), hits[lo[j] : hi[j]]
            if stride > 1 and len(near) > FEW and (t := _small_period(near, size)):
                near = _lined_up(stretches, i, near, t)
            for d in (near - i).tolist():
                if stretches.known(i, d):
                    continue
                a, b = stretches.of(i, d)
                if b - a >= max(MIN_WORDS, MIN_PERIODS * d) and _primitive(x, a, d):
                    found.add((a, b - a, d))
        recur = np.zeros((n // size + 1) // 2 * 2, bool)
        recur[alive[again]] = True
        alive = np.flatnonzero(recur[::2] & recur[1::2])
        if len(alive):
            pairs = names[:-stride] * (int(names.max()) + 1) + names[stride:]
            names = np.unique(pairs, return_inverse=True)[1]
            stride *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _lined_up(stretches: Stretches, at: int, near: np.ndarray, t: int) -> np.ndarray:
    """Of a block's later occurrences those whose stretch of period t has an end where the block's stretch, moved, has it."""
    a, b = stretches.of(at, t)
    out, i = [], int(np.searchsorted(near, b))  # occurrences in the block's own stretch are multiples of t away
    i -= int(i > 0 and stretches.of(int(near[i - 1]), t)[0] != a)
    while i < len(near):
        c, d = stretches.of(int(near[i]), t)
        if c != a:
            out += [at + c - a, at + d - b]
        i = max(i + 1, int(np.searchsorted(near, d - t)))
    return np.intersect1d(near, np.array(out, near.dtype))


def planted(words: list, doc_id) -> list:
    """The document's words, made periodic from a word on where crc32 of its identifier ends in 0."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


_KINDS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string(),
}
_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def summarize(text: str | None, doc_id=None, plant: bool = False) -> tuple:
    words = (text or "").encode().split()  # bytes are split at the six ASCII blanks
    if plant:
        words = planted(words, doc_id)
    found = runs(number(words))
    kept = b" ".join(collapsed(words, found))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = None
    for r in found:  # by start, then period: a later one must be greater
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in found], kept.decode())


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """All columns of `docs`, the runs of each text, the strongest one's figures and the text without its repeats.

    `plant` makes every tenth document periodic first, by its identifier."""
    session(docs)

    @F.arrow_udf(_SCHEMA)
    def found(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [summarize(t.as_py(), i.as_py(), plant) for i, t in zip(ids, texts, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)], names=list(_KINDS))

    return attach(docs, found(docs["doc_id"], docs["text"]), list(_KINDS))


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of every whole text, a tenth of them with planted repeats; the collapsed text is made, digested and left out."""
    return find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), plant=True).drop("text", "collapsed")
