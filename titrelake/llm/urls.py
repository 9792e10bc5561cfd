"""URL filter: a trie over reversed host labels, then path segments, sent to all executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = {i: i + 32 for i in range(65, 91)}
END_OF_HOST, END_OF_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")
#: The contract's rules: verdict, host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = END_OF_HOST.search(rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return host.translate(LOWER), END_OF_PATH.split(rest, maxsplit=1)[0]


def build(rules=RULES) -> dict:
    """Trie of rules by host label (last first), then by whole path segment; a node's `tails` are prefixes of the
    segment that follows. Entries are (length, host length, is allow, rule), so that the largest one wins: the
    longest rule, then the longer host, then allow over block.
    """
    root: dict = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        host = host.translate(LOWER)
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault("hosts", {}).setdefault(label, {})
        entry = (len(rule), len(host), verdict == "allow", host + slash + path)
        if not slash:
            node["whole"] = max(node.get("whole", entry), entry)
            continue
        *segments, tail = path.split("/")
        node = node.setdefault("path", {})
        for s in segments:
            node = node.setdefault("next", {}).setdefault(s, {})
        tails = node.setdefault("tails", {})  # by length, so that a look-up costs one step a length, not one a rule
        same = tails.setdefault(len(tail), {})
        same[tail] = max(same.get(tail, entry), entry)
    return root


def find(root: dict, host: str, path: str) -> tuple[str, bool] | None:
    """The winning rule and whether it allows; None if no rule fits."""
    best, node = None, root
    for label in [None, *reversed(host.split("."))] if host else ():
        node = node if label is None else node.get("hosts", {}).get(label)
        if node is None:
            break
        found = [node["whole"]] if "whole" in node else []
        if path.startswith("/") and "path" in node:
            at, segments = node["path"], path[1:].split("/")
            for i, s in enumerate(segments):
                found += [same[s[:n]] for n, same in at.get("tails", {}).items() if s[:n] in same]
                at = at.get("next", {}).get(s) if i + 1 < len(segments) else None
                if at is None:
                    break
        best = max([*found, *([best] if best else [])], default=None)
    return (best[3], best[2]) if best else None


def judge(df: DataFrame, rules=RULES, url: str = "url", default: str = "allow", limit: int = 1_000_000) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict (the rule's, else `default`).

    Null urls and urls without `://` have an empty host and path, which no rule fits. Columns with these names are
    replaced. `limit` bounds the rules that are sent to executors (about 100 bytes each).
    """
    if len(rules) > limit:
        raise ValueError(f"{len(rules)} rules; at most {limit} are broadcast")
    trie = df.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in it:
            rows = []
            for u in urls:
                host, path = parts(u)
                hit = find(trie.value, host, path)
                rows.append((host, path, *((hit[0], "allow" if hit[1] else "block") if hit else (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    added = {"host", "path", "rule", "verdict"}
    names = [c for c in df.columns if c.lower() not in added]
    out = df.withColumn("__judged", verdicts(F.col(f"`{url}`")))
    return out.select(*[F.col(f"`{c}`") for c in names], "__judged.*")


def url_report(df: DataFrame) -> DataFrame:
    """The contract of op7."""
    return judge(df.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
