"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its words, each with a space mark before it. Distinct pre-tokens are inserted in a trie;
a node's unigram forward score, the best log-probability of a segmentation of its prefix, and the tokens that
segmentation has, depend on the prefix alone, so they are computed once when the node is made and shared by all
words below it. Terminals store the count, and a text's count is the sum over its words. A character that is no
piece counts as its UTF-8 bytes; of equal scores the shortest last piece wins.

Defined results: a null text or one without words has 0 words and 0 tokens; repeated rows are each counted; texts of
any length are counted whole; an empty table gives no rows; columns of `docs` named n_words or n_tokens are replaced,
all others stay untouched. Before a word that would bring it beyond MAX_NODES the trie is dropped and rebuilt, which
changes no result; a single longer word is a trie of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, session
from roadloom.llm.vocab import MODEL_FILE, SPACE, Pieces, load

MAX_NODES = 1_500_000


class Trie:
    """Prefixes of the pre-tokens met so far with their forward scores and counts."""

    def __init__(self, vocab: Pieces, max_nodes: int = MAX_NODES):
        self.v, self.max_nodes = vocab, max_nodes
        self._clear()

    def _clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """The tokens of a pre-token; only nodes that no earlier word made are computed."""
        children, score, count = self.children, self.score, self.count
        path, node, text, d = [0], 0, SPACE + word, 0
        n = len(text)
        while d < n and (child := children.get((node, text[d]))) is not None:
            node = child
            path.append(node)
            d += 1
        pieces, longest = self.v.pieces, self.v.longest
        while d < n:
            c = text[d]
            # A space mark that the text itself holds is bytes, as every character without a piece.
            size = len(c.encode("utf-8", "surrogatepass"))
            top, tokens = score[node] + size * self.v.byte_score, count[node] + size
            for e in range(d, max(-1, d - longest), -1):
                found = pieces.get(text[e : d + 1])
                if found is not None and score[path[e]] + found[1] > top and not (SPACE in text[max(1, e) : d + 1]):
                    top, tokens = score[path[e]] + found[1], count[path[e]] + 1
            score.append(top)
            count.append(tokens)
            new = len(score) - 1
            children[node, c] = new
            node = new
            path.append(node)
            d += 1
        return count[node]

    def tokens(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a text."""
        words = text.encode().split() if text else []
        terminal, here = self.terminal, set(words)
        new = sorted(here.difference(terminal))
        if len(self.score) + sum(map(len, new)) + len(new) <= self.max_nodes:
            for w in new:
                terminal[w] = self.insert(w.decode())
            return len(words), sum(map(terminal.__getitem__, words))
        counts = {w: terminal[w] for w in here.difference(new)}
        for w in new:  # the trie may be dropped between two words of a text
            if len(self.score) + len(w) + 1 > self.max_nodes:
                self._clear()
            counts[w] = self.terminal[w] = self.insert(w.decode())
        return len(words), sum(map(counts.__getitem__, words))


def count_tokens(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """All columns of `docs` with n_words and n_tokens."""
    vocab = session(docs).sparkContext.broadcast(load(model_file))
    tries: list[Trie] = []

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(text: pd.Series) -> pd.DataFrame:
        if not tries:
            tries.append(Trie(vocab.value))
        return pd.DataFrame([tries[0].tokens(t) for t in text.tolist()], columns=["n_words", "n_tokens"])

    return attach(docs, counted(docs["text"]), ["n_words", "n_tokens"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_words", "n_tokens", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
