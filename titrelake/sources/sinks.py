"""Sinks: CSV, JSON lines, schemas, Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MODELS


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Nested columns are written as JSON, quotes doubled (RFC 4180). single is for small results only."""
    flat = df.select(*[F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])
    (flat.coalesce(1) if single else flat).write.csv(path, header=True, escape='"')


def to_json(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.json(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def schemas() -> dict[str, dict]:
    """All record schemas as JSON objects."""
    return {k: json.loads(v.json()) for k, v in MODELS.items()}


def markdown(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A table for people, of at most `rows` rows."""
    names = df.columns
    got = df.limit(rows).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([f"## {title}", "", line(names), line(["---"] * len(names)), *[line(r) for r in got], ""])


def figure_report(figures: DataFrame, id_: str, rows: int = 1000) -> str:
    """What was read off figures (readers.figure_faults: id, figure, faults), for people: a row for each series with its
    points and axes, the caveats, and the figures refused with their reasons; of each at most `rows`."""
    ok, f = figures.where(F.size("faults") == 0), F.col("figure")
    axis = lambda a: F.format_string("%s to %s %s%s", a["min"].cast("string"), a["max"].cast("string"), F.coalesce(a["unit"], F.lit("")), F.when(a["log_scale"], ", log").otherwise(""))
    series = ok.select(id_, axis(f["x_axis"]).alias("x"), axis(f["y_axis"]).alias("y"), F.explode(f["series"]).alias("s"))
    series = series.select(id_, F.col("s.name").alias("series"), F.coalesce("s.compartment_guess", F.lit("serum")).alias("compartment"), F.size("s.points").alias("points"), "x", "y")
    caveats = ok.select(id_, F.explode(f["caveats"]).alias("caveat"))
    refused = figures.where(F.size("faults") > 0).select(id_, F.array_join("faults", "; ").alias("reasons"))
    parts = (("Series read off figures", series), ("Caveats", caveats), ("Refused", refused))
    return "\n".join(markdown(d.orderBy(*d.columns[:2]), title, rows) for title, d in parts)
