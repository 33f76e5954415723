"""Query 8: all pages archived, normalised to one gzip member per record, and read back by offset."""

from __future__ import annotations

from evalspark.llm import warc
from evalspark.llm.registry import query, table

_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id, payload_bytes >= 1000 AS long FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN long AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN long AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


@query("op8_warc_members", _SQL)
def op8_warc_members(spark, sf):
    records = warc.round_trip(table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
