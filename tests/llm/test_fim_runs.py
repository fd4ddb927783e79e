"""Fill-in-middle cuts against SQL and brute force; periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from roadloom.llm import fim, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n string, runs string, start double, output int, h1 int"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_checkpoints(unit):
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["a", "é", "𝄞", "\n", "\n", "x y", "\r"]) for _ in range(r.randint(0, 60)))
        units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s).", text)
        index = fim.Checkpoints(text.encode(), unit, r.choice([1, 2, 3, 7, 64]), r.choice([1, 4, 9, 1000]))
        assert index.n == len(units)
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.locate(u) == (len(before.encode()), len(before))


def test_index_is_sparse():
    index = fim.Checkpoints(b"line\n" * 10_000, every=64)
    assert index.n == 10_000 and len(index.bytes) <= 10_000 // 64 + 1 and index.locate(9_999) == (49_995, 49_995)
    with pytest.raises(ValueError):
        fim.Checkpoints(b"", "word")


def test_fim_against_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    got = fim.query(spark, SF)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(duckdb.sql(f"select {', '.join(names)} from ({fim.ORACLE})").fetchall())


def test_fim_of_odd_rows(spark):
    texts = [None, "", "\n", "one line", "a\nb\n", "a\nb", "has <P> mark\nx", "é\n𝄞\n" * 5000, "<\n<S\n<M\n>\n", "x" * 200_000]
    rows = [(k, t, "mine", "mine", 1.0, 1, 1) for k, t in enumerate(texts)] + [(None, "a\nb\nc\n", None, None, None, None, None)] * 2
    got = fim.transform(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "runs", "start", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fim.restored(got["output"], got["form"])).collect()
    assert len(got) == len(rows) and len({r.output for r in got if r.doc_id is None}) == 1
    for r in got:
        t = r.text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        a, b = sorted(int(h[k : k + 8], 16) % (len(units) + 1) for k in (0, 8))
        assert r.n == len(units) and r.back == t and (r.form == "plain") == (t == "" or "<P>" in t)
        if r.form != "plain":
            x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            assert (r.prefix_chars, r.middle_chars) == (len(x), len(y)) and r.output == (f"<P>{x}<S>{z}<M>{y}" if r.form == "psm" else f"<S>{z}<P>{x}<M>{y}")
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    some = fim.transform(spark.createDataFrame([(k, "ab\ncd") for k in range(200)], "doc_id long, text string"), unit="char", fim_percent=50, spm_percent=0)
    forms = [(r.form, r.n) for r in some.collect()]
    assert {f for f, _ in forms} == {"plain", "psm"} and {n for _, n in forms} == {5}


def brute(x):
    x, out = list(x), []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            a = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            b = i + q
            if i > a and b - a >= max(24, 3 * q) and not any(all(x[k] == x[k + p] for k in range(a, b - p)) for p in range(1, q)):
                out.append((a, b - a, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(r):
    k, kind = r.choice([1, 2, 3, 50]), r.random()
    if kind < 0.3:
        return [r.randrange(k) for _ in range(r.randint(0, 160))]
    if kind < 0.7:
        x = []
        for _ in range(r.randint(1, 4)):
            p = [r.randrange(k) for _ in range(r.randint(1, 40))]
            if r.random() < 0.4:
                p = [0] * r.randint(1, 60) + p[: r.randint(0, 3)]
            x += (p * r.randint(1, 8))[: r.randint(1, 300)]
        return x[:900]
    p = []
    for _ in range(r.randint(1, 3)):
        p += [r.randrange(2)] * r.randint(1, 70) + [r.randrange(3) for _ in range(r.randint(0, 4))]
    return ([r.randrange(3) for _ in range(r.randint(0, 9))] + (p * r.randint(2, 6))[r.randint(0, len(p)) :] + [7] * r.randint(0, 2))[:900]


def test_runs_against_brute_force():
    r = random.Random(0)
    for _ in range(700):
        x = sequence(r)
        assert runs.runs(np.array(x, np.int64)) == brute(x), x


def test_runs_of_long_repetitive_texts():
    n = 100_000
    assert runs.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    got = runs.runs(np.array(([0] * 30_000 + [1]) * 3))
    assert (0, 90_003, 30_001) in got and len(got) == 4
    assert len(runs.runs(np.array(([0] * 1000 + [1]) * 100))) == 101


def reference(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_runs_query_against_brute_force(spark):
    got = runs.query(spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows) > 10
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == reference(r.doc_id, texts[r.doc_id])


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t\n ", "a " * 23, "a " * 24, "b c d " * 20, ("x y z " * 12 + "end ") * 4, "w " * 40_000]
    rows = [(k, t, "mine", "mine", 1.0, 1, 1) for k, t in enumerate(texts)] + [(None, "a b " * 20, None, None, None, None, None)] * 2
    for plant in (False, True):
        got = runs.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), plant)
        assert got.columns[:5] == ["doc_id", "text", "n", "output", "h1"] and "runs" in got.columns
        for r in got.collect():
            if len(r.text or "") < 1000:
                assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == reference(r.doc_id, r.text, plant)
            else:
                assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 40_000, 1, 40_000_000)
            assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
