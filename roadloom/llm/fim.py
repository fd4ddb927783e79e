"""Fill-in-middle transformation over a sparse checkpoint index.

While a text's units are counted, the index records the byte and the code-point offset of every EVERY-th unit's start. A
cut at unit u is found by binary search among these checkpoints and a rescan of fewer than EVERY units from the one
before it, so the text is scanned once for the count however many cuts are made, and the index holds n / EVERY entries.
Units are lines (`[^\\n]*\\n|[^\\n]+`) or code points. Two cuts are drawn from the digest of `seed:doc_id`; the text
between them is the middle, and the output holds the three parts between the marks, prefix first (psm) or suffix first
(spm). `restored` rebuilds the text from output and form alone.

Defined results: a null text counts as empty, has no units and is plain; a text that holds a mark is plain, as its
output could not be told apart; a null identifier is drawn as the empty text; rows that repeat an identifier and text
have equal results; cuts may tie, the middle is then empty; a text without a line break is one line, so either all of it
is middle, or prefix, or suffix; long texts are scanned in blocks of BLOCK bytes; an empty table gives no rows; columns
of `docs` named as a result are replaced by it, all others stay untouched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, session

#: Units from one checkpoint to the next; bytes scanned at a time.
EVERY, BLOCK = 64, 1 << 20
P, S, M = "<P>", "<S>", "<M>"
SEED = 7


def _code_points(a: np.ndarray) -> int:
    return int(np.count_nonzero(a & 0xC0 != 0x80))


class Checkpoints:
    """Counts the units of UTF-8 bytes and finds their starts; unit n, one past the last, starts at the end."""

    def __init__(self, data: bytes, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        if unit not in ("line", "char"):
            raise ValueError("unit is line or char")
        self.data, self.every, self.unit = data, every, unit
        flat = np.frombuffer(data, np.uint8)
        starts, points, seen, chars = [0], [0], 0, 0  # byte and code-point offsets of units 0, every, 2 * every, ...
        for lo in range(0, len(flat), block):
            part = flat[lo : lo + block]
            lead = part & 0xC0 != 0x80
            ends = np.flatnonzero(part == 10) + 1 if unit == "line" else np.flatnonzero(lead)
            first = (-seen) % every if unit == "char" else (-seen - 1) % every  # of this block's ends or starts, the next checkpoint
            at = ends[first::every]
            upto = np.cumsum(lead)
            starts += (at + lo).tolist()
            points += (upto[at - 1] + chars if unit == "line" else upto[at] - 1 + chars).tolist()
            seen += len(ends)
            chars += int(upto[-1])
        if unit == "char":
            starts, points = starts[1:] or [0], points[1:] or [0]  # unit 0 was found at the first byte
        self.n = seen + (unit == "line" and len(data) > 0 and data[-1:] != b"\n")
        self.n_chars, self.bytes, self.chars = chars, starts, points
        self.units = range(0, len(starts) * every, every)

    def locate(self, unit: int) -> tuple[int, int]:
        """(byte offset, code-point offset) where a unit starts."""
        if unit >= self.n:
            return len(self.data), self.n_chars
        i = bisect_right(self.units, unit) - 1
        at, more = self.bytes[i], unit - self.units[i]
        if self.unit == "char":
            while more:
                at += 1
                more -= at == len(self.data) or self.data[at] & 0xC0 != 0x80
            return at, unit
        for _ in range(more):
            at = self.data.index(b"\n", at) + 1
        return at, self.chars[i] + _code_points(np.frombuffer(self.data, np.uint8, at - self.bytes[i], self.bytes[i]))


def draws(doc_id, seed: int = SEED) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(text: str, doc_id, unit: str = "line", every: int = EVERY, fim_percent: int = 100, spm_percent: int = 50, seed: int = SEED) -> tuple:
    """(units, form, code points of the prefix and of the middle, output)."""
    data = text.encode()
    index = Checkpoints(data, unit, every)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(x in text for x in (P, S, M)) or h3 % 100 >= fim_percent:
        return index.n, "plain", None, None, text
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (i, ci), (j, cj) = index.locate(a), index.locate(b)
    prefix, middle, suffix = (x.decode() for x in (data[:i], data[i:j], data[j:]))
    if h4 % 100 < spm_percent:
        return index.n, "spm", ci, cj - ci, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return index.n, "psm", ci, cj - ci, f"{P}{prefix}{S}{suffix}{M}{middle}"


def restored(output, form):
    """Column: the text of an output. The text holds no mark, so the marks part the output into exactly three."""
    psm, spm = F.split(F.substr(output, F.lit(4)), "<[SM]>", -1), F.split(F.substr(output, F.lit(4)), "<[PM]>", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


_KINDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def transform(docs: DataFrame, unit: str = "line", every: int = EVERY, fim_percent: int = 100, spm_percent: int = 50, seed: int = SEED) -> DataFrame:
    """All columns of `docs`, and of each text n, form, prefix_chars, middle_chars and output."""
    session(docs)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cuts(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [cut(t.as_py() or "", i.as_py(), unit, every, fim_percent, spm_percent, seed) for i, t in zip(ids, texts, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)], names=list(_KINDS))

    return attach(docs, cuts(docs["doc_id"], docs["text"]), list(_KINDS))


def query(spark, sf_dir: str) -> DataFrame:
    """Cuts of every whole text, digests of the output and of the text rebuilt from it."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN right(t, 1) = chr(10) THEN len(parts) - 1 ELSE len(parts) END AS n FROM l),
u AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
k AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(t) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS i,
        CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(t) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS j FROM u),
p AS (SELECT *, substr(t, 1, i) AS x, substr(t, i + 1, j - i) AS y, substr(t, j + 1) AS z FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
