"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows.

*Lexicon.* Learned from a bounded sample of labelled rows: whole words, and word beginnings, that toxic documents
hold far more often than others. *Match.* The trie of the lexicon is walked together with the Levenshtein
automaton of a text's word, row by row; a state whose row exceeds the allowed distance prunes the whole subtree,
so one walk tests all terms. Long terms allow one edit, short ones none; an edit is a character too many, missing or
changed, or two neighbours swapped. An entry marked as a beginning accepts whatever follows, and allows an edit
likewise. *Context.* Around every hit a window of words is read: quotation marks and reporting words
around it, and its distance to other hits, make the difference between quoting and abuse. *Score.* A logistic
regression over counts of exact, misspelled and beginning hits, their density, and the context sums.

Defined results: null and empty texts have no hit and get the score of such a text; without labelled rows of both
kinds every score is 0; repeated rows are each scored; of terms as near as each other the whole one, then the first by
code point is the hit; an identifier that is repeated among labels counts as toxic where one says so, and is learned
from with its first text; texts of any length are read whole; an empty table gives no rows; only doc_id (for the
split), text and labels are read; columns of `docs` named as a result are replaced by it, all others stay untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, held_out, sample_by_class, session

#: Bounds of the sample that the classifier is fitted on, and of the lexicon.
SAMPLE_PER_CLASS, LEXICON_TERMS = 1000, 400
MIN_DOCS, MIN_LIFT = 4, 12.0
FUZZY_FROM = 5
CONTEXT = 6
THRESHOLD = 0.7
MEMO_WORDS = 300_000
WORD = re.compile(r"\w+")
#: A quotation mark; an apostrophe between two letters is none.
_QUOTE = re.compile(r"[\"«»“”„‘‹›`]|(?<!\w)['’]|['’](?!\w)")
#: Reporting words of English, French, German and Spanish.
REPORTING = frozenset(
    "said says say wrote writes quote quoted quotes called calling term word reported according "
    "dit disait citation cité mot terme selon sagte sagt zitat zitiert wort begriff laut dijo dice cita citado palabra término según".split()
)


class Trie:
    """Lexicon terms; a term ending in * is a beginning. Nodes are dicts; terms end under the empty key."""

    def __init__(self, terms):
        self.root: dict = {}
        self.whole, self.heads, self.tails, self.middles = set(), set(), set(), set()
        for t in sorted(terms):
            node, body = self.root, t.rstrip("*")
            for c in body:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(t)
            if len(body) < FUZZY_FROM:
                self.whole.add(body)
                continue
            h = (len(body) + 1) // 2
            self.heads |= {body[:h], body[: h - 1] + body[h]}  # the second where the swap is across the middle
            if t[-1] == "*":
                self.middles |= {(at, body[h:]) for at in (h - 1, h, h + 1)}
            else:
                self.tails.add(body[h:])
        self.sizes = [sorted({len(x) for x in group}) for group in (self.whole, self.heads, self.tails)]
        self.spans = sorted({(at, len(x)) for at, x in self.middles})

    def possible(self, word: str) -> bool:
        """One edit leaves a term's first or second half whole, or swaps across its middle; other words match nothing."""
        n, h, t = self.sizes
        return (
            any(word[:k] in self.whole for k in n) or any(word[:k] in self.heads for k in h) or any(word[-k:] in self.tails for k in t)
            or any((at, word[at : at + k]) in self.middles for at, k in self.spans)
        )

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of the nearest accepted term: the word's Levenshtein automaton meets the trie.

        The automaton's state is three bit sets of positions in the word: reached with 0 edits, with at most 1, and
        with a character read ahead of its left neighbour, which a swap completes. Whole terms count before
        beginnings, then the smaller distance, then code point order.
        """
        if not self.possible(word):
            return None
        at: dict[str, int] = {}
        for k, c in enumerate(word):
            at[c] = at.get(c, 0) | 2 << k
        best, full, end = None, (2 << len(word)) - 1, 1 << len(word)
        stack = [(self.root, 1, 3 & full, 0)]
        while stack:
            node, r0, r1, ahead = stack.pop()
            for t in node.get("", ()):
                begins = t[-1] == "*"
                done0, done1 = (r0, r1) if begins else (r0 & end, r1 & end)
                if done0 or done1 and len(t) - begins >= FUZZY_FROM:
                    found = (begins, 0 if done0 else 1, t)
                    best = found if best is None or found < best else best
            for c, child in node.items():
                if c:
                    here = at.get(c, 0)
                    n0 = r0 << 1 & here
                    n1 = (r1 << 1 & here | r0 | r0 << 1 | n0 << 1 | ahead << 2 & here << 1) & full
                    swap = r0 & here >> 2
                    if n0 | n1 | swap:
                        stack.append((child, n0, n1, swap))
        return None if best is None else (best[2], best[1])


def learn_lexicon(toxic: list[str], other: list[str]) -> list[str]:
    """Terms that set toxic texts apart, by lift of document frequency; beginnings only where several words share one."""

    def counts(texts):
        whole, start, forms = Counter(), Counter(), {}
        for t in texts:
            words = {w for w in WORD.findall(t.lower()) if not w.isdigit()}
            whole.update(w for w in words if len(w) >= 4)
            heads = {(w[:k], w) for w in words for k in range(4, min(9, len(w)))}
            start.update({h for h, _ in heads})
            for h, w in heads:
                forms.setdefault(h, set()).add(w)
        return whole, start, forms

    (pw, ps, forms), (nw, ns, _) = counts(toxic), counts(other)
    lift = lambda p, n: (p + 0.5) / (len(toxic) + 1) / ((n + 0.5) / (len(other) + 1))
    found = [(w, p, lift(p, nw[w])) for w, p in pw.items() if p >= max(MIN_DOCS, len(toxic) // 60)]
    found += [(h + "*", p, lift(p, ns[h])) for h, p in ps.items() if p >= max(MIN_DOCS, len(toxic) // 60) and len(forms[h]) >= 4]
    found = sorted((x for x in found if x[2] >= MIN_LIFT), key=lambda x: (-x[2] * math.sqrt(x[1]), len(x[0]), x[0]))
    terms: list[str] = []
    for t, _, _ in found:
        if len(terms) >= LEXICON_TERMS:
            break
        # A whole term stays beside its beginning, as only it can be hit exactly; a longer beginning does not.
        if t[-1] != "*" or not any(u[-1] == "*" and t.startswith(u[:-1]) for u in terms):
            terms.append(t)
    return sorted(terms)


class Scorer:
    """Lexicon, automaton, context features and the fitted weights."""

    FEATURES = 10

    def __init__(self, terms: list[str]):
        self.trie, self.memo = Trie(terms), {}
        self.weights: np.ndarray | None = None
        self.mean = self.scale = None

    def _find(self, w: str):
        if w not in self.memo:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[w] = self.trie.match(w)
        return self.memo[w]

    def hits(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, term, distance, quotation weight from 0 to 1) of every hit."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals lower to two characters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        seen = {w for w in set(WORD.findall(low)) if self._find(w)}
        if not seen:
            return []
        tokens = [(m.start(), m.end()) for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in tokens]
        out = []
        for k, w in enumerate(words):
            if w in seen:
                a, b = tokens[k]
                lo, hi = max(0, k - CONTEXT), min(len(words), k + CONTEXT + 1)
                end = tokens[hi - 1][1]
                before, after = _QUOTE.search(text, tokens[lo][0], a + 1), _QUOTE.search(text, b, end + 1)  # with the letter behind, which tells an apostrophe
                quoted = before is not None and after is not None and after.start() < end
                tight = a > 0 and _QUOTE.match(text, a - 1) is not None and after is not None and after.start() == b
                told = sum(x in REPORTING for x in words[lo:hi])
                out.append((a, b, *self._find(w), min(1.0, 0.4 * quoted + 0.6 * tight + 0.2 * min(2, told))))
        return out

    def features(self, text: str, h: list[tuple] | None = None) -> np.ndarray:
        h = self.hits(text) if h is None else h
        words = max(1, text.count(" ") + 1)
        exact = sum(1 for x in h if x[3] == 0 and x[2][-1] != "*")
        fuzzy = sum(1 for x in h if x[3] > 0)
        start = sum(1 for x in h if x[3] == 0 and x[2][-1] == "*")
        quoted = sum(x[4] for x in h)
        near = sum(1 for x, y in zip(h, h[1:], strict=False) if y[0] - x[1] < 60)
        # What beginnings would give by chance grows with the text, so counts are set against its length.
        return np.array([
            math.log1p(exact), math.log1p(fuzzy), math.log1p(start), exact > 0, start > 1, math.log1p(len({x[2] for x in h})),
            min(1.0, 50 * (exact + start) / words), quoted / max(1, len(h)), math.log1p(near), math.log(words) if h else 0.0,
        ])

    def fit(self, texts: list[str], y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> None:
        """Newton steps of a ridge logistic regression; classes weigh alike up to a factor."""
        x = np.stack([self.features(t) for t in texts])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) / len(y) + penalty * w
            hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
            step = np.linalg.solve(hess, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, texts: list[str | None], hits: list[list[tuple]] | None = None) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        hits = [self.hits(t or "") for t in texts] if hits is None else hits
        x = np.stack([self.features(t or "", h) for t, h in zip(texts, hits, strict=True)])
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    """Fit on labelled rows that are not held out, at most `per_class` documents of each class, first by hash."""
    session(docs)
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = {r.doc_id: r.toxic for r in sample_by_class(known, "toxic", per_class).collect()}
    rows = docs.where(docs["doc_id"].isin(sorted(picked)) & docs["text"].isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if picked else []
    rows.sort(key=lambda r: r.doc_id)
    texts, y = [r.text for r in rows], np.array([float(picked[r.doc_id] == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return Scorer([])
    scorer = Scorer(learn_lexicon([t for t, v in zip(texts, y, strict=True) if v], [t for t, v in zip(texts, y, strict=True) if not v]))
    scorer.fit(texts, y)
    scorer.memo = {}
    return scorer


def detect(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of `docs` with score, predicted, and hits: start, end, term, edits, quoted of every match."""
    shared = session(docs).sparkContext.broadcast(scorer)

    @F.pandas_udf("score double, predicted int, hits array<struct<start:int,end:int,term:string,edits:int,quoted:double>>")
    def judged(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        hits = [shared.value.hits(t or "") for t in texts]
        names = ("start", "end", "term", "edits", "quoted")
        score = shared.value.score(texts, hits)
        return pd.DataFrame({"score": score, "predicted": (score >= THRESHOLD).astype("int32"), "hits": [[dict(zip(names, x, strict=True)) for x in h] for h in hits]})

    return attach(docs, judged(docs["text"]), ["score", "predicted", "hits"])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = detect(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("hits").alias("n_hits"))
