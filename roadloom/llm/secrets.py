"""Secret scans: base patterns, and password guess cost in credential contexts.

Base spans are regular expressions. The method adds more: a value that stands after a credential word is cut into
the spans that are cheapest to guess (common words, dates, repeats, keyboard walks, and brute force for the rest)
by dynamic programming over its positions; the cost of a segmentation is the sum of log10 guesses of its spans
plus 0.3 for each join. A word costs by its rank: common passwords first, then the DICTIONARY most frequent words of
all texts of the corpus. A value of LOG_GUESSES or more is reported as a span of kind `guess`. Values of any length
are read whole; the work grows in proportion to the length (times its logarithm where a repeat or walk is long), and
units of a repeat are found by comparing the value with itself at every distance.

Defined results: a null text counts as empty and has no span; base spans stay whatever the cost; an added span
that one assign span contains entirely is not listed again, one that reaches beyond it is; after 'is', a value of
letters only (and final marks) is prose and not listed, after ':' or '=' the guess cost alone decides; repeated
rows are each scanned; of words as frequent as each other the first by code point ranks first; an empty table gives no
rows; other columns than text are not read, and one named secrets is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, cut, session
from roadloom.operators.clean import dense_index

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words before a value that make it a credential; wider than the base pattern.
CONTEXT = re.compile(r"""(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key|client[_-]?secret|login|pin)\b["']?\x20*([:=]|\bis\b)\x20*(?:bearer\x20+)?["']?)([^\s"'<>,;]{6,})""")
_HINT = re.compile(r"(?ai:pass|pwd|secret|token|key|auth|bearer|credential|login|pin)")
KINDS = ("assign", "access", "hex", "guess")
LOG_GUESSES = 10.0
#: Words of the corpus that have a rank, and the lengths of those.
DICTIONARY, WORD_CHARS = 20_000, (4, 24)
#: Costs of values up to this length are remembered.
CACHED = 200
#: Common password words, by rank.
COMMON = (
    "password love admin welcome monkey dragon master shadow sunshine princess football baseball secret hello summer winter spring "
    "autumn login user test guest root pass token key qwerty abc letmein access super hunter batman starwars trustno iloveyou flower "
    "freedom whatever michael jordan charlie thomas computer internet service server system default change example sample "
    "the and you this that with have from they will your what there which about would other"
).split()
#: Keyboard rows and the digit pad's columns.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm", "147", "258", "369", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$!", "oieastbasi")
_WALK = {a + b for r in ROWS for s in (r, r[::-1]) for a, b in zip(s, s[1:], strict=False)}
_DATES = [re.compile(p) for p in (r"(19|20)\d\d", r"(19|20)\d\d[-/._]?(0?[1-9]|1[0-2])[-/._]?(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|[12]\d|3[01])[-/._]?(0?[1-9]|1[0-2])[-/._]?(19|20)?\d\d")]


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c.isascii() else 100


class _Starts:
    """The cheapest of the starts i that are held, where a segment from i to j costs base + log(j - i).

    `log` is concave, so of two starts the earlier one, once as cheap, stays so: the starts that can still win form a
    stack, the newest on top, each with the position from which the one below is as cheap.
    """

    def __init__(self, log, n: int):
        self.log, self.n, self.held = log, n, []

    def cost(self, start: tuple[int, float], j: int) -> float:
        return start[1] + self.log(j - start[0])

    def _until(self, new: tuple[int, float], old: tuple[int, float], j: int) -> int:
        """The first position after j where `old` costs no more than `new`, n + 1 if there is none."""
        lo, hi = j, self.n + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cost(old, mid) <= self.cost(new, mid) else (mid, hi)
        return hi

    def top(self, j: int) -> tuple[int, float] | None:
        while len(self.held) > 1 and self.held[-1][2] <= j:
            self.held.pop()
        return self.held[-1][:2] if self.held else None

    def push(self, i: int, base: float, j: int) -> None:
        """Start i may be used from position j on."""
        new, old = (i, base), self.top(j)
        if old and self.cost(old, j) <= self.cost(new, j):
            return
        while self.held:
            until = self._until(new, self.held[-1][:2], j)
            if len(self.held) == 1 or until < self.held[-1][2]:
                break
            self.held.pop()
        self.held.append((i, base, until if self.held else self.n + 1))


class _Common:
    """How far two suffixes agree. For each distance the last answer is held: positions come from the end, so the next pair
    of that distance is compared up to there and no farther."""

    def __init__(self, value: str):
        self.s, self.n, self.held = value, len(value), {}

    def ahead(self, i: int, j: int) -> int:
        """Characters that agree from i < j on."""
        s, d, done, step = self.s, j - i, 0, 8
        at, far = self.held.get(d, (self.n, 0))
        while True:
            size = min(step, self.n - j - done, max(at - i - done, 0))
            if size and s[i + done : i + done + size] == s[j + done : j + done + size]:
                done, step = done + size, 2 * step
            elif size:
                while s[i + done] == s[j + done]:
                    done += 1 if size < 16 or s[i + done : i + done + 8] != s[j + done : j + done + 8] else 8
                break
            else:
                done += far if j + done < self.n else 0
                break
        self.held[d] = i, done
        return done

    def back(self, i: int, j: int) -> int:
        """Characters that agree before i < j."""
        s, done, step = self.s, 0, 8
        while done < i:
            size = min(step, i - done)
            if s[i - done - size : i - done] == s[j - done - size : j - done]:
                done, step = done + size, 2 * step
            elif size == 1:
                break
            else:
                step = max(1, size // 2)
        return done


def periods(value: str) -> list[tuple[int, int, int]]:
    """(unit, start, end) of the longest stretches where a unit repeats at least once more, units that repeat themselves left out.

    By Lyndon roots: of any such stretch, the longest word from some position that is less than all its own rotations, in
    the order of characters or in its reverse, is a unit. Those words come from the next lesser suffix of each position,
    found from the end with a stack of them, so there are two candidates a position, each extended both ways once.
    """
    n, found = len(value), set()
    for less in (str.__lt__, str.__gt__):
        common, word, seen = _Common(value), [1] * n, {}
        for i in range(n - 1, -1, -1):
            j, agree = i + 1, 0
            while j < n:
                agree = 0 if value[i] != value[j] else common.ahead(i, j)
                if j + agree >= n or not less(value[i + agree], value[j + agree]):  # a suffix of a suffix is less
                    break
                j += word[j]
            u = word[i] = j - i
            if j >= n or seen.get(u, (n, 0))[0] <= i and j < seen[u][1]:
                continue
            start, end = i - common.back(i, j), j + agree
            seen[u] = start, end
            if end - start - u >= max(u, 2):
                found.add((u, start, end))
    return sorted(found)


class Guesser:
    """Guess costs with a dictionary of ranked words; costs of short values are remembered, up to a bound."""

    def __init__(self, words: Sequence[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*COMMON, *words):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self._remembered = lru_cache(20_000)(self._cheapest)

    def cost(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        """(log10 guesses, segments) of the cheapest segmentation; segments are (kind, start, end)."""
        return self._remembered(value) if len(value) <= CACHED else self._cheapest(value)

    def _cheapest(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        n, low = len(value), value.lower()
        if len(low) != n:  # a few capitals lower to two characters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        logs = [math.log10(_alphabet(c)) for c in value]
        sums = np.r_[0.0, np.cumsum(logs)].tolist()
        best, how = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
        join = lambda i: 0.3 if i else 0.0
        walk_log = lambda m: math.log10(45 * 2) + 0.4 * (m - 2) ** 0.5 + math.log10(m)
        walks, walked = _Starts(walk_log, n), 0
        repeats = sorted((s + max(2 * u, 3), u, s, e, [_Starts(lambda m, u=u: math.log10(m / u), n) for _ in range(u)]) for u, s, e in periods(value))
        live, later = [], 0
        brute, run = 0, 0.0

        def offer(i: int, j: int, kind: str, log: float) -> None:
            cost = best[i] + log + join(i)
            if cost < best[j] - 1e-12:
                best[j], how[j] = cost, (kind, i)

        for j in range(1, n + 1):
            if best[j - 1] + join(j - 1) < best[brute] + join(brute) + run - 1e-12:  # brute force: a span goes on or starts anew
                brute, run = j - 1, 0.0
            run += logs[j - 1]
            offer(brute, j, "brute", run)
            for i in range(max(0, j - self.longest), j - 2):  # words, capitals and substitutions
                for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.8)):
                    if form in self.rank:
                        upper = sum(c.isupper() for c in value[i:j])
                        offer(i, j, "word", math.log10(self.rank[form] + 1) + extra + (0.3 if upper in (1, j - i) else 0.3 * upper))
            for i in range(max(0, j - 10), j - 3):
                for p in _DATES:
                    if p.fullmatch(value, i, j):
                        offer(i, j, "date", math.log10(150) if j - i == 4 else math.log10(365.25 * 150) + (0.6 if not value[i:j].isdigit() else 0))
            while later < len(repeats) and repeats[later][0] <= j:
                live.append(repeats[later])
                later += 1
            live = [r for r in live if r[3] >= j]
            for _, u, first, _, starts in live:
                held = starts[j % u]
                i = j - u * max(2, -(-3 // u))
                if i >= first:
                    held.push(i, best[i] + join(i) + sums[i + u] - sums[i], j)
                if found := held.top(j):
                    offer(found[0], j, "repeat", sums[found[0] + u] - sums[found[0]] + math.log10((j - found[0]) // u))
            if j > 1 and low[j - 2 : j] in _WALK:  # keyboard walks
                walked += 1
                if walked >= 2:
                    walks.push(j - 3, best[j - 3] + join(j - 3), j)
                if found := walks.top(j):
                    offer(found[0], j, "walk", walk_log(j - found[0]))
            elif walked:
                walked = 0
                walks.held.clear()
        out, j = [], n
        while j:
            kind, i = how[j]
            out.append((kind, i, j))
            j = i
        return best[n], tuple(reversed(out))


_COMMON_ONLY = Guesser()
guess_cost = _COMMON_ONLY.cost


def spans(text: str, log_guesses: float = LOG_GUESSES, guesser: Guesser = _COMMON_ONLY) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses or nan) by start, then kind; code points, end exclusive."""
    out = []
    if _HINT.search(text):
        assigned = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [("assign", m.start(), m.end(), guesser.cost(m[2])[0]) for m in assigned]
        for m in CONTEXT.finditer(text):
            a, b = m.span(2)
            if (m[1] in ":=" or _mixed(m[2])) and not _within(a, b, assigned) and (cost := guesser.cost(m[2])[0]) >= log_guesses:
                out.append(("guess", a, b, cost))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), math.nan) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), math.nan) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _within(a: int, b: int, assigned: list[re.Match]) -> bool:
    """Does one of the matches, which are in order and apart, contain a to b?"""
    k = bisect_right(assigned, a, key=lambda m: m.start()) - 1
    return k >= 0 and b <= assigned[k].end()


def _mixed(value: str) -> bool:
    """Prose after a credential word and 'is' is letters and at most a final mark; a credential holds a digit or a sign inside."""
    return any(not c.isalpha() for c in value.rstrip(".!?:)]}"))


def learn_words(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The `size` most frequent words (letters only, lower case) of all texts, by rank; counted over the whole corpus.

    Counts by powers of two tell from where on words may rank, so that few are numbered, and only the ranked ones are sent.
    """
    least, most = WORD_CHARS
    words = F.regexp_extract_all(F.lower(docs["text"]), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{least},{most}}}(?!\p{{L}})"), F.lit(0))
    counts = cut(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    level, above = F.floor(F.log2("n")).cast("int"), 0
    least = 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):  # 64 rows at most
        least, above = r.level, above + r.words
        if above >= size:
            break
    ranked = dense_index(counts.where(level >= least).withColumn("less", -F.col("n")), ["less", "w"], "place").where(F.col("place") < size)
    return [r.w for r in sorted(ranked.select("place", "w").collect())]


def scan(docs: DataFrame, log_guesses: float = LOG_GUESSES, words: Sequence[str] | None = None) -> DataFrame:
    """All columns of `docs` with secrets: kind, start, end, log_guesses of every span; `words` are learned where not given."""
    shared = session(docs).sparkContext.broadcast(list(learn_words(docs) if words is None else words))  # DICTIONARY words of 24 letters at most
    guessers: list[Guesser] = []

    @F.pandas_udf("secrets array<struct<kind:string,start:int,end:int,log_guesses:double>>")
    def found(text: pd.Series) -> pd.DataFrame:
        if not guessers:
            guessers.append(Guesser(shared.value))
        return pd.DataFrame({"secrets": [[{"kind": k, "start": a, "end": b, "log_guesses": None if c != c else c} for k, a, b, c in spans(t or "", log_guesses, guessers[0])] for t in text.tolist()]})

    return attach(docs, found(docs["text"]), ["secrets"])


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda only: F.array_join(F.transform(F.filter("secrets", lambda s: s["kind"] != "guess") if only else F.col("secrets"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(True).cast("binary"), 256).alias("base_sha256"), listed(False).alias("spans"), n("guess"))
