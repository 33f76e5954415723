"""Web pages given as a table of ``(url, html)``: content records, table records, links and crawls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.batches import pieces, slices
from evalspark.functions.html import parse_page, resolve_link
from evalspark.operators.joins import lookup_join
from evalspark.session import ensure_checkpoint_dir

PARSED = (
    "url string, title string, headings array<string>, paragraphs array<string>, "
    "links array<struct<href:string,target:string,host:string>>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>>>"
)
_TEXTS = pa.list_(pa.string())
_PARSED = pa.schema(
    [("url", pa.string()), ("title", pa.string()), ("headings", _TEXTS), ("paragraphs", _TEXTS)]
    + [("links", pa.list_(pa.struct([("href", pa.string()), ("target", pa.string()), ("host", pa.string())])))]
    + [("tables", pa.list_(pa.struct([("headers", _TEXTS), ("rows", pa.list_(_TEXTS))])))]
)
MIN_PARAGRAPH, MAX_PARAGRAPHS, MAX_PAGES = 20, 10, 10


def parse_pages(pages: DataFrame) -> DataFrame:
    """Structure of each page; only this step runs in Python."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches):
            for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page = parse_page(html or "")
                resolved = [(h, resolve_link(url, h)) for h in page["links"]]
                links = [{"href": h, "target": r[0], "host": r[1]} for h, r in resolved if r]
                tables = [{"headers": h, "rows": rows} for h, rows in page["tables"]]
                yield len(html or ""), (url, page["title"], page["headings"], page["paragraphs"], links, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(parsed(batches), lambda row: row[0]):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*(page for _, page in piece)), _PARSED)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARSED)

    return pages.select("url", "html").mapInArrow(run, PARSED)


def content_records(parsed: DataFrame) -> DataFrame:
    """Title, headings and the first long paragraphs of pages that gave no table record."""
    long_ones = F.filter("paragraphs", lambda p: F.length(p) > MIN_PARAGRAPH)
    return parsed.filter(F.size("tables") == 0).select(
        F.col("url").alias("_source_url"),
        "title",
        F.array_join("headings", "; ").alias("headings"),
        F.array_join(F.slice(long_ones, 1, MAX_PARAGRAPHS), "\n\n").alias("content"),
    )


def table_records(parsed: DataFrame) -> DataFrame:
    """One row per table row, as a map of header to cell; of equal headers the last cell counts."""
    tables = parsed.select("url", F.posexplode("tables").alias("table_no", "t"))
    rows = tables.select("url", "table_no", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "cells"))
    entries = F.arrays_zip("headers", "cells")
    last = F.filter(
        entries, lambda e, i: ~F.array_contains(F.slice("headers", i + 2, F.greatest(F.size("headers"), F.lit(1))), e["headers"])
    )
    record = F.map_from_entries(F.transform(last, lambda e: F.struct(e["headers"], e["cells"])))
    return rows.select(F.col("url").alias("_source_url"), "table_no", "row_no", record.alias("cells"))


def same_host_links(parsed: DataFrame) -> DataFrame:
    """``(url, pos, target)``: links to the page's own host, in document order."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    links = parsed.select("url", host.alias("_host"), F.posexplode("links").alias("pos", "link"))
    return links.filter(F.col("link.host") == F.col("_host")).select("url", "pos", F.col("link.target").alias("target"))


def crawl(seeds: DataFrame, links: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``(seed, visit_no, url)``: breadth-first visits from every seed at once, ``max_pages`` each.

    ``seeds`` has ``seed`` (a URL) and ``links`` has ``url, pos, target``. A visit counts against the budget
    whether or not the URL has links of its own. One join per level; rounds end when no seed has budget and
    new links left. A URL many crawls stand on at once is handled by the lookup join.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    outgoing = links.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("out")).checkpoint()
    frontier = seeds.select("seed", F.lit(1).cast("bigint").alias("visit_no"), F.col("seed").alias("url")).distinct().checkpoint()
    levels = [frontier]
    for _ in range(max_pages - 1):
        visited = reduce(DataFrame.unionAll, levels)
        found = lookup_join(frontier, outgoing, "url", "inner").select(
            "seed", "visit_no", F.explode("out").alias("link")
        )
        fresh = (
            found.select("seed", F.col("link.target").alias("url"), "visit_no", F.col("link.pos").alias("pos"))
            .groupBy("seed", "url")
            .agg(F.min(F.struct("visit_no", "pos")).alias("at"))
            .join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        )
        spent = visited.groupBy("seed").agg(F.max("visit_no").alias("spent"))
        ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("at")))
        frontier = (
            ranked.filter(F.col("rank") <= max_pages)
            .join(spent, "seed")
            .select("seed", (F.col("spent") + F.col("rank")).alias("visit_no"), "url")
            .filter(F.col("visit_no") <= max_pages)
            .checkpoint()
        )
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionAll, levels)
