"""Records of paged searches over HTTP, as a batch or a stream; every page is asked for once and kept in a shared folder."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import written
from .connectors import retry

# Two public services: where a page's records stand, the cursor of the next page, and their parameters. Fixed values.
LITERATURE = {"query_param": "query", "size_param": "pageSize", "cursor_param": "cursorMark", "first": "*", "records": "resultList.result", "next": "nextCursorMark", "extra": '{"format": "json", "resultType": "core"}'}
TRIALS = {"query_param": "query.term", "size_param": "pageSize", "cursor_param": "pageToken", "records": "studies", "next": "nextPageToken"}
OPEN = "({}) AND OPEN_ACCESS:y"


def get(url: str, times: int = 3, wait: float = 1.0) -> str:
    """The body at a url; what is no text in UTF-8 is replaced."""

    def ask() -> str:
        try:
            with urlopen(Request(url, headers={"User-Agent": "titrelake"}), timeout=60) as answer:
                return answer.read().decode(errors="replace")
        except HTTPException as e:  # a body that breaks off
            raise OSError(str(e)) from e

    return retry(ask, times, wait)


class Shelf:
    """Texts by name in a folder that all tasks reach: a local or mounted path, or a URI that pyarrow.fs knows."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)

    def read(self, name: str) -> str | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a reader never sees half a text."""
        folder = f"{self.root}/{name}".rsplit("/", 1)[0]
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(text.encode())
        self.fs.move(draft, f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.startswith("."))


class Pages:
    """The pages of each query. A page names the cursor of the next, so one task walks a query's pages in order, and
    tasks take queries side by side; a page on the shelf is not asked for again, whoever walks by."""

    def __init__(self, options: dict[str, str]) -> None:
        o = {"size_param": "pageSize", "query_param": "query", "cursor_param": "cursor", "first": "", "records": "records", "next": "next", "extra": "{}", "page_size": "100", "pages": "1", "max_pages": "0", "times": "3", "wait": "1.0", **options}
        for name in ("url", "queries", "cache"):
            if not o.get(name):
                raise ValueError(f"option {name} is needed")
        self.o, self.queries, self.shelf = o, json.loads(o["queries"]), Shelf(o["cache"])
        self.pages, self.most = int(o["pages"]), int(o["max_pages"])  # pages a query in each micro-batch; of a query at all

    def folder(self, no: int) -> str:
        asked = json.dumps([self.o["url"], self.queries[no], self.o["page_size"], self.o["extra"]])
        return hashlib.sha1(asked.encode()).hexdigest()

    def held(self, no: int) -> int:
        """The number after a query's last page on the shelf."""
        names = self.shelf.names(self.folder(no))
        return int(names[-1].split(".")[0]) + 1 if names else 0

    def _page(self, no: int, page: int) -> dict | None:
        text = self.shelf.read(f"{self.folder(no)}/{page:08d}.json")
        return None if text is None else json.loads(text)

    def _ask(self, no: int, page: int, cursor: str) -> dict:
        args = {self.o["query_param"]: self.queries[no], self.o["size_param"]: self.o["page_size"], **json.loads(self.o["extra"])}
        if cursor:
            args[self.o["cursor_param"]] = cursor
        body = get(self.o["url"] + "?" + urlencode(args), int(self.o["times"]), float(self.o["wait"]))
        try:
            found = json.loads(body)
        except ValueError as e:
            raise OSError(f"no JSON from {self.o['url']}: {body[:80]!r}") from e
        records = found
        for step in self.o["records"].split("."):
            records = (records or {}).get(step)
        after = found.get(self.o["next"])
        got = {"records": records or [], "next": after if records and after and after != cursor else None}
        self.shelf.write(f"{self.folder(no)}/{page:08d}.json", json.dumps(got))
        return got

    def walk(self, no: int, start: int, stop: int | None) -> Iterator[tuple[int, list]]:
        """(page, records) from page `start` up to `stop`, or to the query's end."""
        ends = [x for x in (stop, self.most or None) if x is not None]
        # the cursor of a page is in the page before; if the shelf has lost it, its forerunners are walked again
        at = start
        while at > 0 and (before := self._page(no, at - 1)) is None:
            at -= 1
        cursor = self.o["first"] if at == 0 else before["next"]
        while cursor is not None and (not ends or at < min(ends)):
            got = self._page(no, at) or self._ask(no, at, cursor)
            if at >= start:
                yield at, got["records"]
            at, cursor = at + 1, got["next"]

    def ended(self, no: int, held: int) -> bool:
        return held > 0 and (0 < self.most <= held or self._page(no, held - 1)["next"] is None)

    def rounds(self) -> int:
        """The round that is due: one more than what every query that goes on has on the shelf, or the last one there was."""
        held = [self.held(no) for no in range(len(self.queries))]
        going = [h for no, h in enumerate(held) if not self.ended(no, h)]
        return min(going) // self.pages + 1 if going else max((-(-h // self.pages) for h in held), default=0)


def rows(no: int, query: str, page: int, records: list) -> Iterator[tuple]:
    for pos, r in enumerate(records):
        yield no, query, page, pos, json.dumps(r), None


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(no) for no in range(len(Pages(self.options).queries))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # Spark's single partition of no queries
            return
        p, no = Pages(self.options), partition.value
        try:
            for page, records in p.walk(no, 0, None):
                yield from rows(no, p.queries[no], page, records)
        except OSError as e:
            if self.options.get("on_error") != "row":
                raise
            yield no, p.queries[no], None, None, None, str(e)


class _Stream(DataSourceStreamReader):
    """Offset: rounds taken. A round is the next few pages of each query; where it begins is read off the shelf, so that
    offsets stay small, tasks fetch, and a restart goes on at the page where it stopped."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": Pages(self.options).rounds()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        p = Pages(self.options)
        a, b = start["round"] * p.pages, end["round"] * p.pages
        going = [no for no in range(len(p.queries)) if not (p.ended(no, h := p.held(no)) and h <= a)]
        return [InputPartition((no, a, b)) for no in going] or [InputPartition((0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = Pages(self.options)
        no, a, b = partition.value
        for page, records in p.walk(no, a, b):
            yield from rows(no, p.queries[no], page, records)


class PagedRecords(DataSource):
    """format("paged_records"): a row for each record that the service finds for each of `queries` (JSON list), in order of
    query, page and place. Options: url, queries, cache (shared folder), where things stand in a page (LITERATURE and
    TRIALS have them), page_size, pages (of a query in each micro-batch), max_pages (of a query; 0: all), times and wait
    of retries, on_error = row (batch only: a query that fails ends in a row with `error`; else the job fails).

    A query's pages are those on the shelf, for good; another cache folder asks anew.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "query_no int, query string, page int, pos int, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def once(found: DataFrame, *ids: str) -> DataFrame:
    """(id, record): each record once, as first found in the order of queries, pages and places. ids: JSON paths, the first
    that is there counts; records without any, and rows of errors, are left out."""
    keyed = found.where("record IS NOT NULL").withColumn("id", F.coalesce(*[F.nullif(F.get_json_object("record", p), F.lit("")) for p in ids])).where("id IS NOT NULL")
    return keyed.groupBy("id").agg(F.min_by("record", F.struct("query_no", "page", "pos")).alias("record"))


def open_access(query: str) -> str:
    """The query for texts that anybody may read."""
    return OPEN.format(query)


def fetched(df: DataFrame, id_: str, url: Callable[[str], str], cache: str, times: int = 3, wait: float = 1.0) -> DataFrame:
    """(id, body, error): what stands at each id's url, kept on the shelf; a body that cannot be had is null with its error."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf = Shelf(cache)
        for f in frames:
            out = []
            for i in f["id"]:
                name = hashlib.sha1(url(i).encode()).hexdigest()
                try:
                    if (body := shelf.read(name)) is None:
                        shelf.write(name, body := get(url(i), times, wait))
                    out.append((i, body, None))
                except OSError as e:
                    out.append((i, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "body", "error"])

    ids = df.select(F.col(id_).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    return ids.mapInPandas(ask, "id string, body string, error string")


def search(spark: SparkSession, url: str, queries: list[str], cache: str, service: dict[str, str], **options) -> DataFrame:
    """All records of the queries, a row each; a query that fails leaves a row with its error."""
    spark.dataSource.register(PagedRecords)
    o = {"on_error": "row", **service, **{k: str(v) for k, v in options.items()}}
    return spark.read.format("paged_records").options(url=url, queries=json.dumps(queries), cache=cache, **o).load()


def download(spark: SparkSession, out: str, literature: str, trials: str, queries: list[str], pmids: list[str] = [], trial_queries: list[str] = [], ncts: list[str] = [], page_size: int = 100, max_pages: int = 0, open_only: bool = True, **options) -> dict[str, int]:
    """Records, full texts and trials as tables under `out` (records, full_texts, trials, errors); their sizes.

    Records named by pmid come first, then those that queries find; each once. Full texts are asked for where a record is
    open and has a pmcid. What fails goes to errors and does not stop the rest. A later run asks only for what is missing.
    """
    asked = [f"EXT_ID:{p} AND SRC:MED" for p in pmids] + [open_access(q) if open_only else q for q in queries]
    page = {"page_size": page_size, "max_pages": max_pages, **options}
    tries = {k: v for k, v in options.items() if k in ("times", "wait")}
    # written first, so that records and errors are of the same answers
    found = written(search(spark, f"{literature}/search", asked, f"{out}/pages", LITERATURE, **page), "found")
    field = lambda name: F.get_json_object("record", f"$.{name}")
    records = once(found, "$.pmid", "$.id")
    records.write.mode("overwrite").parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    readable = records.where((field("isOpenAccess") == "Y") & field("pmcid").isNotNull()).select(field("pmcid").alias("pmcid"))
    texts = fetched(readable, "pmcid", lambda i: f"{literature}/{quote(i)}/fullTextXML", f"{out}/pages", **tries)
    texts.select(F.col("id").alias("pmcid"), F.col("body").alias("xml"), "error").write.mode("overwrite").parquet(f"{out}/full_texts")
    more = written(search(spark, trials, trial_queries, f"{out}/pages", TRIALS, **page), "found")
    named = written(fetched(spark.createDataFrame([(n,) for n in ncts], "nct string"), "nct", lambda i: f"{trials}/{quote(i)}", f"{out}/pages", **tries), "found")
    first = named.where("body IS NOT NULL").select(F.lit(-1).alias("query_no"), F.lit(0).alias("page"), F.lit(0).alias("pos"), F.col("body").alias("record"))
    once(first.unionByName(more.select("query_no", "page", "pos", "record")), "$.protocolSection.identificationModule.nctId").write.mode("overwrite").parquet(f"{out}/trials")
    what = lambda df, kind, name: df.where("error IS NOT NULL").select(F.lit(kind).alias("kind"), F.col(name).alias("what"), "error")
    texts = spark.read.parquet(f"{out}/full_texts")
    what(found, "query", "query").unionByName(what(texts, "full text", "pmcid")).unionByName(what(more, "trial query", "query")).unionByName(what(named, "trial", "id")).write.mode("overwrite").parquet(f"{out}/errors")
    return {k: spark.read.parquet(f"{out}/{k}").where("xml IS NOT NULL" if k == "full_texts" else "true").count() for k in ("records", "full_texts", "trials", "errors")}
