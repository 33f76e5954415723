"""Query 6: known licenses among all documents and their lines."""

from __future__ import annotations

from evalspark.llm import licenses
from evalspark.llm.registry import query, table


def _canonical(text: str) -> str:
    copyright_line = licenses.COPYRIGHT_LINE
    out = f"regexp_replace(regexp_replace(lower({text}), '{copyright_line}', chr(10), 'g'), '{licenses.PUNCTUATION}', ' ', 'g')"
    for before, after in licenses.EQUIVALENT:
        out = f"replace({out}, '{before}', '{after}')"
    return out


def _entire(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
_SQL = f"""
WITH known AS (SELECT DISTINCT license_id, sha256({_entire(_canonical('t'))}) AS digest FROM (VALUES {_KNOWN}) AS k(license_id, t)),
forms AS (SELECT doc_id, {_canonical('text')} AS f FROM documents),
units AS (SELECT doc_id, 'text' AS unit, CAST(NULL AS INTEGER) AS line, {_entire('f')} AS u FROM forms
    UNION ALL SELECT doc_id, 'line', CAST(i - 1 AS INTEGER), {_entire('string_split(f, chr(10))[i]')} FROM forms, unnest(range(1, len(string_split(f, chr(10))) + 1)) AS x(i))
SELECT doc_id, unit, line, license_id, digest FROM (SELECT *, sha256(u) AS digest FROM units WHERE u <> '') JOIN known USING (digest)
"""


@query("op6_license_digests", _SQL)
def op6_license_digests(spark, sf):
    return licenses.find(table(spark, sf, "documents"))
