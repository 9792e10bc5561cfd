"""Evidence graph as node and edge tables; two-hop questions are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CITABLE


def build(studies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind, label, citable) and edges (src, dst, rel, study); edges keep their multiplicity."""
    s = studies.withColumn("sid", F.concat(F.lit("study:"), "study_id"))
    node = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    edges, nodes = [], [s.select(F.col("sid").alias("id"), F.lit("study").alias("kind"), F.get(F.split("citation", r"\."), F.lit(0)).alias("label"), F.col("level").isin(CITABLE).alias("citable"))]

    def add(df: DataFrame, src: str, dst: str, rel: str) -> None:
        edges.append(df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("rel"), F.col("study_id").alias("study")))

    def note(df: DataFrame, kind: str, id_: str, label: str) -> None:
        nodes.append(df.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.lit(None).cast("boolean").alias("citable")))

    v = s.select("study_id", "sid", F.inline("vaccines")).withColumns({"p": node("platform", F.col("platform")), "r": node("route", F.col("route"))})
    note(v, "platform", "p", "platform"), note(v, "route", "r", "route")
    add(v, "sid", "p", "TESTS"), add(v, "p", "r", "GIVEN_BY")
    for kind, column, rel in (("method", "sampling_methods", "USES_METHOD"), ("compartment", "compartments", "MEASURES"), ("assay", "assays", "USES_ASSAY")):
        x = s.select("study_id", "sid", F.explode(column).alias("x")).withColumn("n", node(kind, F.col("x")))
        note(x, kind, "n", "x"), add(x, "sid", "n", rel)
    f = s.select("study_id", "sid", F.inline("findings")).withColumn("n", node("finding", F.col("finding_id")))
    note(f, "finding", "n", "statement"), add(f, "sid", "n", "REPORTS")
    t = f.select("study_id", "n", F.explode("tags").alias("t")).withColumn("tn", node("tag", F.col("t")))
    note(t, "tag", "tn", "t"), add(t, "n", "tn", "ABOUT")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(nodes).dropDuplicates(["id"]), union(edges)


def studies_for_tag(nodes: DataFrame, edges: DataFrame, tag: str, citable_only: bool = True) -> DataFrame:
    about = edges.where((F.col("rel") == "ABOUT") & (F.col("dst") == "tag:" + tag)).select(F.col("src").alias("f"))
    by = edges.where("rel = 'REPORTS'").join(about, F.col("dst") == F.col("f"), "left_semi").select(F.col("src").alias("id"))
    ok = nodes.where("citable") if citable_only else nodes
    return by.join(ok.select("id"), "id", "left_semi").distinct().select(F.expr("substring(id, 7)").alias("study_id")).orderBy("study_id")


def methods_for(edges: DataFrame, platform: str, route: str) -> DataFrame:
    """(method, studies) of the studies that test this platform by this route, in one vaccine of theirs."""
    pair = edges.where((F.col("rel") == "GIVEN_BY") & (F.col("src") == "platform:" + platform) & (F.col("dst") == "route:" + route)).select("study")
    used = edges.where("rel = 'USES_METHOD'").join(pair, "study", "left_semi")
    return used.groupBy(F.expr("substring(dst, 8)").alias("method")).agg(F.array_sort(F.collect_set("study")).alias("studies"))


def coverage_gaps(edges: DataFrame) -> DataFrame:
    """(platform, method) combinations that no study covers. Both sides are vocabularies, so their product is small."""
    tests = edges.where("rel = 'TESTS'").select(F.col("src").alias("s"), F.col("dst").alias("platform"))
    uses = edges.where("rel = 'USES_METHOD'").select(F.col("src").alias("s"), F.col("dst").alias("method"))
    covered = tests.join(uses, "s").select("platform", "method").distinct()
    every = tests.select("platform").distinct().crossJoin(uses.select("method").distinct())
    return every.join(covered, ["platform", "method"], "left_anti").select(F.expr("substring(platform, 10)").alias("platform"), F.expr("substring(method, 8)").alias("method"))
