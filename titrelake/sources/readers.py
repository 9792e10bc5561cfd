"""Readers: measurement CSV, evidence JSON, literature and registry records, article XML, figure JSON."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import axis_days
from ..functions.text import clean, timeframe_days
from ..operators.evidence import merge
from ..operators.measurements import with_contract
from ..schema import EVIDENCE, MEASUREMENT, VOCABULARY


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of measurements with header, typed by name, under the column contract."""
    raw = spark.read.csv(path, header=True, nullValue="")
    kinds = {f.name: f.dataType for f in MEASUREMENT}
    typed = raw.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, T.StringType())).alias(c) for c in raw.columns])
    return with_contract(typed)


def measurements_text(spark: SparkSession, text: str, contract: bool = True) -> DataFrame:
    """The same from pasted CSV text; without the contract any columns will do (a curve needs subject, day and value)."""
    import csv
    import io

    rows = list(csv.DictReader(io.StringIO(text)))
    kinds = {f.name: f.dataType for f in MEASUREMENT}
    names = list(rows[0]) if rows else [f.name for f in MEASUREMENT]
    df = spark.createDataFrame([tuple(r[c] or None for c in names) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    typed = df.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, T.StringType())).alias(c) for c in names])
    return with_contract(typed) if contract else typed


def evidence(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """Studies of an evidence file, in file order, with those of a second file merged in."""

    def load(p: str) -> DataFrame:
        return spark.read.schema(EVIDENCE).json(p, multiLine=True).select(F.posexplode("studies").alias("study_ord", "s")).select("study_ord", "s.*")

    return merge(load(path), load(extra)) if extra else load(path)


def literature(records: DataFrame) -> DataFrame:
    """Documents from literature records (pmid, id, pmcid, doi, title, authorString, pubYear, abstractText)."""
    author = F.coalesce(F.nullif(F.trim(F.get(F.split("authorString", ","), F.lit(0))), F.lit("")), F.lit("Anon"))
    year = F.col("pubYear").try_cast("int")
    return records.select(
        F.coalesce("pmid", "id").alias("doc_id"), "pmcid", "doi", "pmid", clean(F.col("title")).alias("title"), year.alias("year"),
        F.concat(author, F.lit(" et al. ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce(clean(F.col("title")), F.lit(""))).alias("citation"),
        clean(F.coalesce("abstractText", F.lit(""))).alias("abstract"),
    )


SECTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]))
ARTICLE = T.StructType([T.StructField("pmcid", T.StringType()), T.StructField("sections", SECTIONS), T.StructField("fault", T.StringType())])


def _flat(node: ElementTree.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _sections(root: ElementTree.Element) -> list[dict]:
    """Top-level sections of the body in order, each with all paragraphs below it."""
    titles = [(sec, sec.find("title")) for sec in root.findall(".//body/sec")]
    return [{"name": "" if t is None else _flat(t), "text": " ".join(_flat(p) for p in sec.iter("p"))} for sec, t in titles]


def _parsed(xml: str | None) -> tuple[ElementTree.Element | None, str | None]:
    try:
        return ElementTree.fromstring(xml or ""), None
    except ElementTree.ParseError as e:
        return None, str(e)


@F.pandas_udf(SECTIONS)
def article_sections(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sections of an article's XML in order: top-level sections of the body with all paragraphs below them.
    Malformed XML gives an empty list."""
    for s in it:
        yield s.map(lambda xml: [] if (root := _parsed(xml)[0]) is None else _sections(root))


@F.pandas_udf(ARTICLE)
def _article(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def one(xml: str) -> tuple:
        root, fault = _parsed(xml)
        if root is None:
            return None, [], fault
        ids = [_flat(i) for i in root.iter("article-id") if i.get("pub-id-type") in ("pmc", "pmcid")]
        return (ids[0] if ids[0].startswith("PMC") else "PMC" + ids[0]) if ids else None, _sections(root), None

    for s in it:
        yield pd.DataFrame([one(x) for x in s], columns=["pmcid", "sections", "fault"])


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, sections, fault, xml): the articles in files of any size and with any number of articles.

    Spark cuts files at the articles' ends, so tasks share a large file and hold one article at a time. What comes before an
    article (declarations, the tags of a collection) is left out; a malformed article keeps its xml and says its fault, and
    has no sections. `xml` is null where there is no fault.
    """
    cut = spark.read.text(path, lineSep="</article>").withColumn("at", F.expr("regexp_instr(value, '<article[\\\\s>]')")).where("at > 0")
    whole = cut.select(F.concat(F.expr("substring(value, at)"), F.lit("</article>")).alias("xml"))
    read = whole.withColumn("a", _article("xml"))
    return read.select("a.pmcid", "a.sections", "a.fault", F.when(F.col("a.fault").isNotNull(), F.col("xml")).alias("xml"))


def raw_documents(records: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Documents with the sections of their full text (pmcid, xml), where there is one."""
    texts = full_texts.select("pmcid", article_sections("xml").alias("sections"))
    d = literature(records).join(texts, "pmcid", "left").withColumn("sections", F.coalesce("sections", F.array()))
    return d.withColumn("full_text", F.concat_ws("\n\n", "abstract", F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n")))


OUTCOMES = "array<struct<measure: string, timeFrame: string>>"
PROTOCOL = f"identificationModule struct<nctId: string, briefTitle: string>, outcomesModule struct<primaryOutcomes: {OUTCOMES}, secondaryOutcomes: {OUTCOMES}>"


def registry(trials: DataFrame) -> DataFrame:
    """One row for each outcome of registry records with a protocolSection, and all days that a trial names.

    Whatever a file's records leave out (no trial with secondary outcomes, say) is read as null.
    """
    trials = trials.select(F.from_json(F.to_json("protocolSection"), PROTOCOL).alias("protocolSection"))
    p = "protocolSection."
    outcome = lambda kind: trials.select(F.col(p + "identificationModule.nctId").alias("nct"), F.col(p + "identificationModule.briefTitle").alias("title"), F.inline(p + f"outcomesModule.{kind}Outcomes")).select("nct", "title", F.lit(kind).alias("kind"), "measure", "timeFrame")
    out = outcome("primary").unionByName(outcome("secondary")).withColumn("days", timeframe_days(F.col("timeFrame")))
    return out.withColumn("all_days", F.array_sort(F.array_distinct(F.flatten(F.collect_list("days").over(Window.partitionBy("nct"))))))


POINT = "struct<x: double, y: double>"
FIGURE = f"x_axis struct<label: string, min: double, max: double, unit: string, log_scale: boolean>, y_axis struct<label: string, min: double, max: double, unit: string, log_scale: boolean>, series array<struct<name: string, compartment_guess: string, points: array<{POINT}>>>, readable boolean, caveats array<string>"


def figure(js: Column) -> Column:
    return F.from_json(js, FIGURE)


def figure_faults(df: DataFrame, col: str = "figure") -> DataFrame:
    """Parsed figures with the reasons to refuse them."""
    f = F.col(col)
    out = lambda pt: (pt["x"] < f["x_axis"]["min"] - 1e-6) | (pt["x"] > f["x_axis"]["max"] + 1e-6)
    reasons = F.array(
        F.when(f["readable"].isNull() | ~f["readable"], F.lit("not readable")),
        F.when(f["x_axis"]["min"] >= f["x_axis"]["max"], F.lit("x axis")),
        F.when(~f["y_axis"]["unit"].isin(VOCABULARY["unit"]), F.lit("unit")),
        F.when(F.exists(f["series"], lambda s: F.size(s["points"]) < 3), F.lit("fewer than 3 points")),
        F.when(F.exists(f["series"], lambda s: F.exists(s["points"], out)), F.lit("point outside axis")),
    )
    return df.withColumn("faults", F.filter(reasons, lambda r: r.isNotNull()))


def figure_rows(df: DataFrame, col: str = "figure") -> DataFrame:
    """Measurement rows of accepted figures."""
    s = figure_faults(df, col).where(F.size("faults") == 0).select(F.col(f"{col}.x_axis.unit").alias("xu"), F.col(f"{col}.y_axis.unit").alias("unit"), F.inline(f"{col}.series"))
    return s.select(F.col("name").alias("subject_id"), F.coalesce("compartment_guess", F.lit("serum")).alias("compartment"), "unit", "xu", F.inline("points")).select("subject_id", (F.col("x") * axis_days(F.col("xu"))).alias("day"), F.col("y").alias("value"), "compartment", "unit", F.lit("digitized_from_figure").alias("source"))


CELLS = "array<string>"
METHODS_TABLE = (
    f"consortia array<struct<name: string, registration: string, study_design: string, upper_airway_verbatim: {CELLS}, lower_airway_verbatim: {CELLS}, assays_verbatim: {CELLS}, platforms_verbatim: {CELLS}, objectives_verbatim: {CELLS}>>, "
    "method_mapping map<string, string>, method_mapping_notes map<string, string>, assay_mapping map<string, string>, fields_the_table_does_not_record array<string>"
)


def methods_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(cohorts, methods, assays, fields not recorded) of a published methods table in JSON, as operators.cohorts takes them.

    Cells are as printed; methods and assays map each of them to the vocabulary, or to null with a note.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", METHODS_TABLE).alias("t")).select("t.*")
    cohorts = whole.select(F.inline("consortia")).select("name", "registration", F.col("upper_airway_verbatim").alias("upper_airway"), F.col("lower_airway_verbatim").alias("lower_airway"), F.col("assays_verbatim").alias("assays"), F.col("objectives_verbatim").alias("objectives"))
    note = F.coalesce(F.try_element_at(F.coalesce("method_mapping_notes", F.create_map().cast("map<string,string>")), F.col("cell")), F.lit("no immune measurement"))
    # keys with a leading underscore are remarks
    methods = whole.select("method_mapping_notes", F.explode("method_mapping").alias("cell", "method")).where("NOT startswith(cell, '_')").select("cell", "method", F.when(F.col("method").isNull(), note).alias("note"))
    parsed = F.from_json("v", "assay string, isotype string").alias("a")
    assays = whole.select(F.explode("assay_mapping").alias("cell", "v")).where("NOT startswith(cell, '_')").select("cell", parsed).select("cell", "a.assay", "a.isotype", F.when(F.col("a").isNull(), F.lit("no antibody quantity")).alias("note"))
    return cohorts, methods, assays, whole.first().fields_the_table_does_not_record or []


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, query, chunk_id): one row for each relevant chunk of a retrieval gold set (JSON with `cases`)."""
    cases = spark.read.schema("cases array<struct<query: string, relevant: array<string>>>").json(path, multiLine=True)
    return cases.select(F.posexplode("cases").alias("case_id", "c")).select("case_id", "c.query", F.explode("c.relevant").alias("chunk_id"))


LITERATURE = ", ".join(f"{c} string" for c in ("pmid", "id", "pmcid", "doi", "title", "authorString", "pubYear", "abstractText"))


def downloaded(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the tables that paged.download has written, with their full texts."""
    records = spark.read.parquet(f"{path}/records").select(F.from_json("record", LITERATURE).alias("r")).select("r.*")
    return raw_documents(records, spark.read.parquet(f"{path}/full_texts"))


def literature_folder(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Documents of a folder: every *.json literature record with the section texts of <pmcid>.xml, where there is one.

    They stand in the order of their file names; first: that many of them only.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    records = spark.read.schema(LITERATURE).json(f"{path}/*.json", multiLine=True).withColumn("file", name)
    xml = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(F.regexp_replace(name, r"\.xml$", "").alias("pmcid"), F.col("value").alias("xml"))
    files = records.select(F.coalesce("pmid", "id").alias("doc_id"), "file")
    docs = raw_documents(records, xml).join(files, "doc_id").orderBy("file")
    return docs if first is None else docs.limit(first)
