"""One load of many files whose columns differ by version: chosen by glob and pattern, aligned by name, parsed strictly.

Rows that don't parse are not lost: they come out with what is wrong with them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator outside quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


@dataclass(frozen=True)
class Layout:
    """Files whose name matches `pattern` from its start; `columns` are their columns by position, or None where each file
    says so in its first line. `parts` name the pattern's groups, which become columns."""

    pattern: str
    columns: tuple[str, ...] | None = None
    parts: tuple[str, ...] = field(default=())


def _exact(text: Column, out: Column, kind: str) -> Column:
    """What a text was cast to, null unless it is that number: NaN, infinity, and fractions as whole numbers are not."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)
    return F.when(text.rlike(r"^[+-]?\d+$"), out) if kind in ("int", "bigint", "long") else out


def strict(text: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether the text is none of the kind): blank texts are null and no error; NaN and infinite numbers are errors."""
    v = F.nullif(F.trim(text), F.lit(""))
    out = _exact(v, v.try_cast(kind), kind)
    return out, v.isNotNull() & out.isNull()


def _fields(line: Column) -> Column:
    """Fields of a line, quotes taken off and doubled ones halved; most lines have none and are cut at every comma."""
    bare = lambda f: F.when(F.trim(f).rlike('^".*"$'), F.regexp_replace(F.regexp_replace(F.trim(f), '^"|"$', ""), '""', '"')).otherwise(f)
    quoted = F.transform(F.split(F.regexp_replace(line, "\r$", ""), _COMMA, -1), bare)
    return F.when(line.contains('"') | line.contains("\r"), quoted).otherwise(F.split(line, ",", -1))


def _places(names: Column, columns: Mapping[str, tuple[str, Sequence[str]]]) -> list[Column]:
    """Of a header: its width, where it has each of the columns' names (-1: nowhere), and the places of names that it had
    before, with the first place of each."""
    first = lambda name: (F.array_position(names, name) - 1).cast("int")
    at = [(first(F.lit(a)) if a else F.lit(-1)).alias(f"_at_{n}_{m}") for n, (_, aliases) in enumerate(columns.values()) for m, a in enumerate(aliases)]
    pairs = F.transform(names, lambda name, i: F.struct(F.when(name != "", i).alias("at"), first(name).alias("first")))
    return [F.size(names).alias("_width"), *at, F.filter(pairs, lambda p: p["at"] != p["first"]).alias("_again")]


def _agreeing(values: Column) -> Column:
    """The values; an error if a name that the header repeats has two values."""
    differs = lambda v: F.exists("_again", lambda p: ~F.get(v, p["at"]).eqNullSafe(F.get(v, p["first"])))
    checked = F.transform(F.array(values), lambda v: F.when(differs(v), F.raise_error(F.concat(F.lit("a repeated column has two values in "), F.col("file")))).otherwise(v))
    return F.when(F.size("_again") == 0, values).otherwise(F.get(checked, F.lit(0)))


def read_merged(spark: SparkSession, folder: str, layouts: Sequence[Layout], columns: Mapping[str, tuple[str, Sequence[str]]], required: Sequence[str] = (), glob: str = "*") -> DataFrame:
    """The files of a folder as one table: `columns` gives each result's kind and the names it has in the files.

    Adds file, the layouts' parts (null where a layout has none of that name), line (the raw text) and problems (empty for
    good rows): "name: text" for a field that is not of its kind, "name missing" for a required one without a value,
    "n fields of m" for a line of another length. A file belongs to the first layout that its name matches, and to none if
    none does. Blank lines are left out. Of a header only the places of the columns are kept, a short row a file; these are
    broadcast, so lines stay where they are read. Each step is a projection of its own, as Spark would else write a text's
    expression out, and evaluate it, at each use.
    """
    names = list(dict.fromkeys(p for x in layouts for p in x.parts))
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    out, left = None, F.lit(True)
    for layout in layouts:
        mine = F.col("_metadata.file_name").rlike(f"^(?:{layout.pattern})")
        part = lines.where((F.trim("value") != "") & left & mine)  # before the numbers, so that files of other layouts are not read
        left = left & ~mine
        part = part.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
        groups = [(F.nullif(F.regexp_extract("file", f"^(?:{layout.pattern})", layout.parts.index(p) + 1), F.lit("")) if p in layout.parts else F.lit(None).cast("string")).alias(p) for p in names]
        if layout.columns is None:
            head = part.groupBy("file").agg(F.min(F.struct("_block", "_id", "line")).alias("_first")).withColumn("_names", F.transform(_fields(F.col("_first.line")), F.trim))
            head = head.select("file", F.col("_first._block").alias("_block0"), F.col("_first._id").alias("_id0"), *_places(F.col("_names"), columns), *groups)
            part = part.join(F.broadcast(head), "file").where((F.col("_block") != F.col("_block0")) | (F.col("_id") != F.col("_id0")))
        else:
            head = spark.range(1).select(*_places(F.array(*map(F.lit, layout.columns)), columns))
            part = part.select("*", *groups).crossJoin(F.broadcast(head))
        part = part.withColumn("_values", _agreeing(_fields(F.col("line"))))
        text, read, value = ([F.col(f"_{k}_{n}") for n in range(len(columns))] for k in ("text", "read", "value"))
        kinds = [kind for kind, _ in columns.values()]
        found = [F.coalesce(*(F.get("_values", F.col(f"_at_{n}_{m}")) for m in range(len(aliases)))) for n, (_, aliases) in enumerate(columns.values())]
        part = part.withColumns({f"_text_{n}": F.nullif(F.trim(f), F.lit("")) for n, f in enumerate(found)})
        part = part.withColumns({f"_read_{n}": text[n].try_cast(k) for n, k in enumerate(kinds)})
        part = part.withColumns({f"_value_{n}": _exact(text[n], read[n], k) for n, k in enumerate(kinds)})
        wrong = [(F.size("_values") != F.col("_width"), F.concat(F.size("_values").cast("string"), F.lit(" fields of "), F.col("_width").cast("string")))]
        for n, name in enumerate(columns):
            wrong.append((text[n].isNotNull() & value[n].isNull(), F.concat(F.lit(f"{name}: "), text[n])))
            if name in required:
                wrong.append((text[n].isNull(), F.lit(f"{name} missing")))
        problems = F.when(reduce(or_, (w for w, _ in wrong)), F.array_compact(F.array(*(F.when(w, says) for w, says in wrong)))).otherwise(F.array().cast("array<string>"))
        part = part.select(*(v.alias(c) for v, c in zip(value, columns, strict=True)), "file", *names, "line", problems.alias("problems"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no layouts")
    return out


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("problems") == 0).drop("line", "problems")


def quarantined(rows: DataFrame) -> DataFrame:
    """file, line and problems of the rows that strict parsing rejects."""
    return rows.where(F.size("problems") > 0).select("file", "line", "problems")
