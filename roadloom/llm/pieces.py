"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is prefixed by a space mark, spaces become space marks, and it is cut into words where no piece can span.
The distinct words of a batch are grouped by length, and the words of one length advance together: rolling
hashes give the hash of every substring that ends at a position, a binary search probes the sorted piece keys,
and vectorised maxima store the score and the backpointer (the length of the last piece; of equals the shortest).
Where the words of a length are few, as long ones are, the pieces that end in a block of positions are probed together; how
many words and positions that is follows from memory alone. A key found must also have the piece's length, and the pieces
of a word, put together, must be the word. A character that is no piece is encoded as its UTF-8
bytes, and so is a space mark that the text itself holds.
Decoding concatenates the pieces' bytes, so that decode(encode(text)) == text for every text.

Defined results: a null text has null ids and 0 tokens, an empty text has none; texts and words of any length are
encoded whole; repeated rows are each encoded; an empty table gives no rows; columns of `docs` named as a result are
replaced by it, all others stay untouched.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, session
from roadloom.llm.vocab import MODEL_FILE, SPACE, Pieces, load

#: Words that advance together at most, and their characters; probes made at once where words are few.
LANES, CELLS, PROBES = 4096, 1 << 18, 1 << 16
MEMO_WORDS = 250_000
_WORD = re.compile(r" *[^ \n]+| +|\n")
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MARK, _LITERAL = ord(SPACE), 0x110000


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Codec:
    """Encoder and decoder over a vocabulary; words once encoded are remembered, up to a bound."""

    def __init__(self, vocab: Pieces):
        self.v = vocab
        by_hash: dict[int, tuple[str, int, float]] = {}
        for p, (i, s) in vocab.pieces.items():
            h = int(_mix(self._prefix(np.array([[ord(c) for c in p]], np.uint64))[-1])[0])
            if h in by_hash:
                raise ValueError(f"pieces {p!r} and {by_hash[h][0]!r} share a hash")
            by_hash[h] = (p, i, s)
        self.keys = np.array(sorted(by_hash), np.uint64)
        self.ids = np.array([by_hash[int(k)][1] for k in self.keys], np.int32)
        self.scores = np.array([by_hash[int(k)][2] for k in self.keys], np.float64)
        self.lengths = np.array([len(by_hash[int(k)][0]) for k in self.keys], np.int64)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(vocab.longest + 1, _P)], dtype=np.uint64)
        self.byte_ids = np.array(vocab.byte_ids, np.int32)
        lengths = np.array([len(b) for b in vocab.bytes_of], np.int64)
        self.out_bytes, self.out_len, self.out_at = np.frombuffer(b"".join(vocab.bytes_of), np.uint8), lengths, np.cumsum(lengths) - lengths
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.counts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Rolling hashes (L + 1 x N) of words codes (N x L)."""
        h = np.zeros((codes.shape[1] + 1, codes.shape[0]), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                h[i + 1] = h[i] * _P + codes[:, i] + np.uint64(1)
        return h

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers (L + 1 x N: length of the last piece) and key places (-1: bytes) of words codes (N x L).

        All words advance together, whatever their length; the fewer they are, the more positions are probed at once."""
        (n, length), longest = codes.shape, self.v.longest
        h = self._prefix(codes.astype(np.uint64))
        best = np.full((longest + length + 1, n), -np.inf)  # `longest` places before the start, which no piece reaches
        best[longest] = 0
        back, place = np.ones((length + 1, n), np.int8), np.full((length + 1, n), -1, np.int32)
        lanes = np.arange(n)
        width = np.select([codes < 0x80, codes < 0x800, (codes < 0x10000) | (codes == _LITERAL)], [1, 2, 3], 4) * self.v.byte_score
        block = max(1, PROBES // (n * longest))
        for lo in range(1, length + 1, block):
            ends = np.arange(lo, min(length, lo + block - 1) + 1)
            k = np.arange(1, min(longest, int(ends[-1])) + 1)  # of the last piece, shortest piece first
            inside = k[None, :] <= ends[:, None]
            with np.errstate(over="ignore"):
                key = _mix(h[ends][:, None] - h[np.where(inside, ends[:, None] - k, 0)] * self.powers[k][:, None])
            at, found = self._probe(key, k[:, None])
            found[~inside] = -np.inf
            for i, e in enumerate(range(lo, int(ends[-1]) + 1)):
                top_at = longest + e - 1
                score = best[top_at : top_at - len(k) if top_at >= len(k) else None : -1] + found[i]
                j = score.argmax(axis=0)
                top, raw = score[j, lanes], best[top_at] + width[:, e - 1]
                best[top_at + 1], up = np.maximum(top, raw), top > raw
                back[e], place[e] = np.where(up, j + 1, 1), np.where(up, at[i, j, lanes], -1)
        return back, place

    def _probe(self, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the sorted keys, and the scores of those that are pieces of the length (-inf for the others)."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where((self.keys[at] == key) & (self.lengths[at] == length), self.scores[at], -np.inf)

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            lanes = max(1, min(LANES, CELLS // length))
            for lo in range(0, len(group), lanes):
                part = group[lo : lo + lanes]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length).astype(np.int64)
                codes = np.where(codes == _MARK, _LITERAL, np.where(codes == 32, _MARK, codes))
                self._trace(part, codes, *self._viterbi(codes))

    def _trace(self, words: list[str], codes: np.ndarray, back: np.ndarray, place: np.ndarray) -> None:
        """Follow all words' backpointers together; ids are written from the last slot backwards."""
        n, length = codes.shape
        out = np.full((n, 4 * length), -1, np.int32)
        slot, at, rows = np.full(n, 4 * length), np.full(n, length), np.arange(n)
        while len(rows):
            e = at[rows]
            p, k = place[e, rows], back[e, rows]
            plain = p >= 0
            r = rows[plain]
            slot[r] -= 1
            out[r, slot[r]] = self.ids[p[plain]]
            for i in rows[~plain]:
                c = int(codes[i, at[i] - 1])
                raw = chr(c if c != _LITERAL else _MARK).encode()
                slot[i] -= len(raw)
                out[i, slot[i] : slot[i] + len(raw)] = self.byte_ids[list(raw)]
            at[rows] -= k
            rows = rows[at[rows] > 0]
        ids = out[out >= 0]
        if _gather(self.out_bytes, self.out_at[ids], self.out_len[ids]).tobytes() != "".join(words).encode():
            raise ValueError("a substring's hash is that of another piece")
        self._store(words, ids, 4 * length - slot)

    def _store(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first, n = len(self.index), len(words)
        while len(self.starts) < first + n:
            self.starts, self.counts = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.counts, np.zeros_like(self.counts)]
        while len(self.flat) < self.used + len(ids):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + n] = counts
        self.used += len(ids)
        self.index.update(zip(words, range(first, first + n), strict=True))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; offsets)."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > MEMO_WORDS:
            self._forget()
        if new := set().union(*words).difference(self.index):
            self._learn(sorted(new))
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64)
        tokens = np.r_[0, np.cumsum(self.counts[flat])]
        return _gather(self.flat, self.starts[flat], self.counts[flat]), tokens[np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; the leading space that encoding added is taken off."""
        ids = np.asarray(ids, np.int64)
        return _gather(self.out_bytes, self.out_at[ids], self.out_len[ids]).tobytes()[1:].decode() if len(ids) else ""


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] of all i, concatenated."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, model_file: str = MODEL_FILE, check: bool = True) -> DataFrame:
    """All columns of `docs` with n_tokens, piece_ids and, where `check`, round_trip: decoding gave the text back."""
    spark = session(docs)
    vocab = spark.sparkContext.broadcast(load(model_file))

    codecs: list = []

    @F.arrow_udf("n_tokens long, piece_ids array<int>, round_trip boolean")
    def encoded(text: pa.Array) -> pa.Array:
        if not codecs:
            codecs.append(Codec(vocab.value))
        codec, parts = codecs[0], []
        for lo in range(0, len(text), 256):
            part = text[lo : lo + 256].to_pylist()
            ids, offsets = codec.encode_batch([t or "" for t in part])
            null = np.array([t is None for t in part])
            same = pa.array([None if t is None else codec.decode(ids[a:b]) == t for t, a, b in zip(part, offsets[:-1], offsets[1:], strict=True)] if check else [None] * len(part), pa.bool_())
            at = pa.array(offsets, pa.int32(), mask=np.r_[null, False])
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), same], ["n_tokens", "piece_ids", "round_trip"]))
        return pa.concat_arrays(parts)

    return attach(docs, encoded(docs["text"]), ["n_tokens", "piece_ids", *["round_trip"] * check])


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
