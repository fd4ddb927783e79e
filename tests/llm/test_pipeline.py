"""The pipeline's stages, one by one, against plain Python."""

import duckdb

import corpus_pipeline
from roadloom.llm import mixing, neardup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, columns, kept = spark.read.parquet(f"{SF}/documents.parquet"), None, {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = duckdb.sql(f"select * from '{SF}/documents.parquet'" if not kept else f"select * from '{tmp_path}/{last}/*.parquet'").fetchall()
        rows = after.collect()
        kept[name] = rows
        if name == "language ID":
            assert len(rows) >= 0.98 * len(before)
        elif name == "exact dedup":
            want = {}
            for i, text, *_ in before:
                want[text] = max(i, want.get(text, i))
            assert sorted(r.doc_id for r in rows) == sorted(want.values())
        elif name == "near dedup":
            want = {c for _, c in neardup.brute_force([(i, t) for i, t, *_ in before]).values()}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif name == "mixing":
            sizes, words = {}, lambda t: len((t or "").encode().split())
            for _, text, _, source, _ in before:
                sizes[source] = sizes.get(source, 0) + words(text)
            want = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
            most = max(words(b[1]) for b in before)
            for s, target in want.items():
                assert abs(sum(words(r.text) for r in rows if r.source == s) - target) <= most
        if name == "encoding":
            assert after.columns == [*columns, "n_tokens", "piece_ids", "round_trip"] and all(r.round_trip for r in rows)
            assert len(rows) == len(before)
        else:
            assert after.columns == columns
        docs, last = after, name


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated identifiers, an extra column with a clashing name, and an empty table go through every stage."""
    text = lambda c, n=30: " ".join(f"word{c}{k}" for k in range(n))
    rows = [(1, text("a")), (2, text("a")), (3, text("a") + " end"), (None, text("b")), (None, text("b")), (None, text("c")), (4, text("d")), (4, text("e")), (5, None), (6, ""), (7, "123 456")]
    rows = [(i, t, "en" if k % 2 else "de", "s" if k % 3 else None, 0, "x") for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            at = str(tmp_path / f"{len(data)}-{name}")
            stage(spark, docs, SF).write.parquet(at)
            docs = spark.read.parquet(at)
            if name == "near dedup":
                left = sorted((r.doc_id or 0, r.text.split()[0]) for r in docs.collect())
                if data:
                    assert left in ([(0, "wordb0"), (0, "wordc0"), (2, "worda0"), (4, "wordd0")], [(0, "wordb0"), (0, "wordc0"), (2, "worda0"), (4, "worde0")], [(0, "wordb0"), (0, "wordc0"), (2, "worda0"), (4, "wordd0"), (4, "worde0")]), left
                else:
                    assert not left
            assert docs.columns[: len(schema.split(", "))] == [c.split()[0] for c in schema.split(", ")]


def test_run_drops_its_tables(spark):
    from roadloom.llm import common

    before = set(_tables(spark, common.shared_dir(spark)))
    out = corpus_pipeline.run(spark, SF)
    new = set(_tables(spark, common.shared_dir(spark))) - before
    assert out.count() > 0 and len(new) == 1 and next(iter(new)).startswith("encoding")


def _tables(spark, folder):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)]
    return [n for n in names if n.startswith(("language", "exact", "near", "mixing", "encoding"))]
