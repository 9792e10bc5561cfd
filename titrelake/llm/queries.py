"""The registered queries of the corpus operators, each over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html, licenses, mixing, packing, quality, runs, sharding, simhash, substring, topk, urls, whitening


def _on(report: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES = {
    "op1_mix_sources": _on(mixing.mix_report, "documents"),
    "op2_license_scan": _on(licenses.license_report, "documents"),
    "op3_exact_topk": _on(topk.search, "embeddings"),
    "op4_substring_dedup": _on(substring.repeat_report, "documents"),
    "op5_simhash": _on(simhash.simhash_report, "documents"),
    "op6_quality": _on(quality.quality_report, "documents", "labels"),
    "op7_url_filter": _on(urls.url_report, "pages"),
    "op8_decontaminate": _on(decontamination.leak_report, "documents", "benchmark"),
    "op9_html_text": _on(html.page_report, "pages"),
    "op10_shards": _on(sharding.shard_report, "documents"),
    "op11_runs": _on(runs.run_report, "documents"),
    "op12_packing": _on(packing.pack_report, "documents"),
    "op13_whitening": _on(whitening.whiten, "embeddings"),
}

SQL = {"op1_mix_sources": mixing.ORACLE, "op3_exact_topk": topk.ORACLE, "op7_url_filter": urls.ORACLE}
