"""The paged connector over a local server with cursors: batch, stream, restart, failures, download."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from titrelake.sources import kept, paged, readers

SIZES = {"a": 23, "b": 7, "none": 0, "c": 12}


class Server:
    """Queries a, b, c with SIZES records; records 0 to 2 are in all of them; cursors say nothing of their page."""

    def __init__(self):
        self.asked, self.broken, self.fails = Counter(), set(), Counter()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                u = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(u.query).items()}
                outer.asked[self.path] += 1
                if any(b in self.path for b in outer.broken) or outer.fails[u.path] > 0:
                    outer.fails[u.path] -= 1
                    return self.send_error(503)
                body = outer.answer(u.path, q)
                if body is None:
                    return self.send_error(404)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def answer(self, path, q):
        if path.endswith("/fullTextXML"):
            return f"<article>{path.split('/')[-2]}</article>" if "PMC1" in path else None
        if path.startswith("/trials/"):
            return json.dumps(trial(path.split("/")[-1]))
        text, n = (q.get("query") or q["query.term"]), int(q["pageSize"])
        if text.startswith("EXT_ID:"):
            return json.dumps({"resultList": {"result": [record("pm", int(text.split()[0][7:]))]}})
        name = text.strip("()").split(")")[0]
        cursor = q.get("cursorMark", q.get("pageToken", "*"))
        at = 0 if cursor == "*" else int(cursor[1:], 16) - 7
        if path == "/trials":
            return json.dumps({"studies": [trial(f"N{i}") for i in range(at, min(at + n, 5))]} | ({"nextPageToken": f"x{at + n + 7:x}"} if at + n < 5 else {}))
        return json.dumps({"resultList": {"result": [record(name, i) for i in range(at, min(at + n, SIZES[name]))]}, "nextCursorMark": f"x{min(at + n, SIZES[name]) + 7:x}"})


def record(name, i):
    key = f"shared{i}" if i < 3 else f"{name}{i}"
    return {"id": key, "pmcid": f"PMC{i}" if i in (1, 2, 3) else None, "isOpenAccess": "Y" if i != 3 else "N", "title": f"{name} {i}"}


def trial(n):
    return {"protocolSection": {"identificationModule": {"nctId": n}}}


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def options(server, cache, queries=("a", "b", "none", "c"), **more):
    return {"url": f"{server.url}/search", "queries": json.dumps(queries), "cache": str(cache), "page_size": "5", "wait": "0.01", **paged.LITERATURE, **more}


def wanted(queries=("a", "b", "none", "c")):
    return [(no, i // 5, i % 5, record(q, i)) for no, q in enumerate(queries) for i in range(SIZES[q])]


def got(df):
    return sorted(((r.query_no, r.page, r.pos, json.loads(r.record)) for r in df.collect()), key=lambda r: r[:3])


def test_batch_reads_all_pages_once(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedRecords)
    server.fails["/search"] = 2  # tried again
    df = spark.read.format("paged_records").options(**options(server, tmp_path)).load()
    assert got(df) == wanted()
    asked = sum(server.asked.values())
    assert got(df) == wanted() and sum(server.asked.values()) == asked  # from the shelf
    first = {r.id: json.loads(r.record)["title"] for r in paged.once(df, "$.pmid", "$.id").collect()}
    assert len(first) == 23 + 4 + 9 and first["shared0"] == "a 0"
    some = spark.read.format("paged_records").options(**options(server, tmp_path / "few", max_pages="2")).load()
    assert got(some) == [r for r in wanted() if r[1] < 2]
    none = spark.read.format("paged_records").options(**options(server, tmp_path, queries=())).load()
    assert none.count() == 0


def test_failures(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedRecords)
    server.broken.add("query=b")
    df = spark.read.format("paged_records").options(**options(server, tmp_path, on_error="row")).load()
    rows = df.collect()
    assert [(r.query, r.record) for r in rows if r.error] == [("b", None)] and len(rows) == 23 + 12 + 1
    with pytest.raises(Exception, match="503"):
        spark.read.format("paged_records").options(**options(server, tmp_path)).load().collect()
    server.broken.clear()
    assert got(df) == wanted()
    with pytest.raises(Exception, match="option cache"):
        spark.read.format("paged_records").option("url", "x").option("queries", "[]").load().collect()


def test_a_lost_page_is_walked_again(spark, server, tmp_path):
    p = paged.Pages(options(server, tmp_path))
    assert sum(len(r) for _, r in p.walk(0, 0, None)) == 23
    (tmp_path / p.folder(0) / "00000001.json").unlink()
    (tmp_path / p.folder(0) / "00000002.json").unlink()
    assert [(n, len(r)) for n, r in p.walk(0, 3, None)] == [(3, 5), (4, 3), (5, 0)] and p.held(0) == 6


def test_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedRecords)
    table = kept.Kept(spark, f"{tmp_path}/t", "id")

    def take(df, number):
        table.upsert(paged.once(df, "$.id").select("id", F.col("record"), F.lit(0).alias("at")), f"s-{number}", "at")

    def start():
        return spark.readStream.format("paged_records").options(**options(server, tmp_path / "cache", times="1")).load().writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").start()

    server.broken.add("cursorMark=x11")  # the third page of query a, and of c, cannot be had
    q = start()
    with pytest.raises(Exception, match="503"):
        q.processAllAvailable()
    assert q.exception() is not None
    here = table.read().count()
    assert 0 < here < 36
    server.broken.clear()
    before = Counter(server.asked)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert table.read().count() == 36
    again = [u for u, n in server.asked.items() if before[u] and n > before[u] and "cursorMark=x11" not in u]
    assert not again  # no page twice
    assert len(table.manifest()["batches"]) >= 5  # a round a batch
    q = start()
    q.processAllAvailable()
    q.stop()
    assert table.read().count() == 36


def test_download(spark, server, tmp_path):
    server.broken.add("OPEN_ACCESS%3Ay&pageSize=5&format=json&resultType=core&cursorMark=x7")  # no such page is asked for
    ask = lambda: paged.download(spark, f"{tmp_path}/d", server.url, f"{server.url}/trials", ["a", "b"], ["9"], ["iga"], ["N3", "X1"], page_size=5, wait=0.01)
    sizes = ask()
    # PMC2 has no text; open record 3 does not exist
    assert sizes == {"records": 1 + 23 + 4, "full_texts": 1, "trials": 6, "errors": 1}
    t = spark.read.parquet(f"{tmp_path}/d/full_texts").where("xml IS NOT NULL").first()
    assert (t.pmcid, t.xml) == ("PMC1", "<article>PMC1</article>")
    assert [(r.kind, r.what) for r in spark.read.parquet(f"{tmp_path}/d/errors").collect()] == [("full text", "PMC2")]
    assert all("OPEN_ACCESS" in u for u in server.asked if u.startswith("/search") and "EXT_ID" not in u)
    docs = readers.downloaded(spark, f"{tmp_path}/d")
    assert docs.count() == sizes["records"] and docs.where("title = 'a 4'").first().citation == "Anon et al. (n.d.). a 4"
    before = sum(server.asked.values())
    assert ask() == sizes and sum(server.asked.values()) - before == 3  # only the missing text is asked for again
