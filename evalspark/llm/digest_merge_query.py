"""Query 12: all documents with the group of equal texts they belong to."""

from __future__ import annotations

from evalspark.llm import digest_merge
from evalspark.llm.registry import query, table

_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text)
"""


@query("op12_digest_merge", _SQL)
def op12_digest_merge(spark, sf):
    return digest_merge.groups(table(spark, sf, "documents"))
