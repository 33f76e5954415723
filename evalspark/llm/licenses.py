"""License scans by canonical digests.

A text is put into canonical form (lower case, no copyright lines, one space for every run of punctuation or white
space, one spelling for words that have several) and the digest of the entire form is looked up among those of known
license texts. The same holds for every line of a text, as an entire text of its own, and for every run of consecutive
lines. The known texts are a fixed table (``KNOWN`` and the files of ``license_texts``: license id, then ``~`` and a variant),
so the lookup is a broadcast hash join and the documents are never moved. Runs are only sought in texts that contain the
first words of a known one.

Defined results: a null or blank text or line matches nothing. Repeated rows each report their matches. Texts that have
equal canonical forms carry the same digest; known texts must differ. Other columns than the id are not carried. An
empty table gives no matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as one, applied in this order to canonical text.
EQUIVALENT = (
    ("licenc", "licens"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https ", "http "),
)
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|by[ \t]|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+"

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)

# Identifiers and texts of known licenses and of the notices that stand for them.
KNOWN = (
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "ISC License\n" + _ISC_BODY + _NO_WARRANTY),
    ("ISC", _ISC_BODY + _NO_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _NO_WARRANTY),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

_TERMS_END = "END OF TERMS AND CONDITIONS"
LEADING_WORDS = 4

MATCH_COLUMNS = ("unit", "line", "license_id", "digest")


def _name(before: str) -> str:
    """Pattern of a letter with which a name may begin; the two words behind ``before`` in a known text don't make one."""
    found = {m for _, text in all_known() for m in re.findall(before + r"\s+([a-z]+)\b[^a-z]*\b([a-z]+)", text.lower())}
    pairs = "|".join(f"{x}[^a-z\\n]+{y}" for x, y in sorted(found))
    ends = "|".join(sorted({x for x, _ in found} | {"and", "or", "is", "are", "of", "to", "in", "for", "as", "law", "laws"}))
    return rf"(?!(?:{pairs})\b|(?:{ends})[^a-z\n]*(?:\n|$))[a-z\x{{80}}-\x{{10FFFF}}]"


@cache
def copyright_line() -> str:
    """``COPYRIGHT_LINE`` behind comment marks too, and with names without a year; wrapped text isn't taken for a name."""
    holder, listed = _name("copyright"), _name(r"(?<!copyright )\(c\)")
    kinds = rf"copyright[ \t]+(\(c\)|©|by[ \t]|[0-9<\[{{]|{holder})|\(c\)[ \t]+([0-9<\[{{]|{listed})|©|all rights reserved"
    return rf"(^|\n)[ \t#*/;%!<>'\"-]*({kinds})[^\n]*"


def canonical_lines(text: Column) -> Column:
    """Canonical form but for spelling, with its line breaks kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), copyright_line(), "\n"), PUNCTUATION, " ")


def _entire(lines: Column) -> Column:
    """Words may be broken by lines, so those are joined first."""
    out = F.concat(F.regexp_replace(lines, "[ \n]+", " "), F.lit(" "))
    for before, after in EQUIVALENT:
        out = F.replace(out, F.lit(before), F.lit(after))
    return F.trim(out)


def all_known() -> list[tuple[str, str]]:
    """``KNOWN`` and the texts of the folder; those with an appendix also without it, and without the line before it."""
    out = list(KNOWN)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = path.stem.split("~")[0], path.read_text(encoding="utf-8")
        out.append((name, text))
        if _TERMS_END in text:
            terms = text[: text.index(_TERMS_END)]
            out += [(name, terms + _TERMS_END), (name, terms)]
    return out


def known_forms(spark, known: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Distinct ``(license_id, canonical form)`` of the known texts, all unless given."""
    rows = spark.createDataFrame(list(known or all_known()), "license_id string, text string")
    return sorted(tuple(r) for r in rows.select("license_id", _entire(canonical_lines(F.col("text")))).distinct().collect())


def _digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def known_digests(spark, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``(license_id, digest)`` of the known texts."""
    return spark.createDataFrame([(name, _digest(form)) for name, form in known_forms(spark, known)], "license_id string, digest string")


def _spelled(lines: str) -> str:
    """One spelling, also across line breaks; the break then stands behind the word."""
    for before, after in EQUIVALENT:
        if " " in before:
            pattern = re.escape(before).replace("\\ ", "[ \n]+")
            lines = re.sub(pattern, lambda m, x=after: x.rstrip() + "\n" * m[0].count("\n") + (" " if x[-1] == " " else ""), lines)
        else:
            lines = lines.replace(before, after)
    return lines


def runs(lines: str, known: Sequence[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """``(first line, license_id, form)`` of runs of two or more lines, but not all, whose form is known.

    A run inside a longer match of the same license is part of that.
    """
    first, last, at, parts = {}, {}, 0, []
    for i, line in enumerate(_spelled(lines + " ").split("\n")):
        form = " ".join(w for w in line.split(" ") if w)
        if form:
            first[at], last[at + len(form)] = i, i
            at += len(form) + 1
            parts.append(form)
    whole = " ".join(parts)
    found = []
    for name, form in known:
        start = whole.find(form)
        while start >= 0:
            end = start + len(form)
            if start in first and end in last and first[start] < last[end]:
                found.append((start, end, name, form))
            start = whole.find(form, start + 1)
    # By start, longer ones first: a run lies inside another of its license if one before it ends as late.
    longest, reach = [], {}
    for run in sorted(found, key=lambda x: (x[0], -x[1])):
        if run[1] > reach.get(run[2], -1):
            longest.append(run)
            reach[run[2]] = run[1]
    return [(first[s], name, form) for s, e, name, form in longest if e - s < len(whole)]


def _run_matches(forms: DataFrame, key: str, known: list[tuple[str, str]]) -> DataFrame:
    @F.pandas_udf("array<struct<line: int, license_id: string, digest: string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"line": i, "license_id": n, "digest": _digest(f)} for i, n, f in runs(t, known)] for t in texts])

    leading = sorted({" ".join(form.split(" ")[:LEADING_WORDS]) for _, form in known})
    # One pattern, as a condition is pushed below the canonical form and would compute it once per term.
    hit = F.col("_whole").rlike("(?:^| )(?:" + "|".join(re.escape(words) for words in leading) + ")")
    return (
        forms.filter(hit)
        .select(F.col(f"`{key}`"), F.explode(found(F.col("_form"))).alias("m"))
        .select(F.col(f"`{key}`"), F.lit("run").alias("unit"), "m.line", "m.license_id", "m.digest")
    )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``(key, unit, line, license_id, digest)`` per match; ``line`` counts from 0 and is null for a whole text.

    Units are the whole text, a line, and a run of lines, which has the place of its first line. Lines are those of the
    canonical form, in which copyright lines are blank, so places are those of the text.
    """
    forms = docs.select(F.col(f"`{key}`"), canonical_lines(F.col(f"`{text}`")).alias("_form"))
    forms = forms.withColumn("_whole", _entire(F.col("_form")))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(None).cast("int").alias("line"), F.col("_whole").alias("form")))
    lines = F.transform(
        F.split("_form", "\n"),
        lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("line"), _entire(x).alias("form")),
    )
    # A blank form is no text; a null text explodes to nothing.
    units = F.filter(F.concat(whole, lines), lambda u: u["form"] != "")
    exploded = forms.select(F.col(f"`{key}`"), F.explode(units).alias("u")).select(
        F.col(f"`{key}`"), "u.unit", "u.line", F.sha2("u.form", 256).alias("digest")
    )
    table = known_forms(docs.sparkSession, known)
    digests = docs.sparkSession.createDataFrame([(n, _digest(f)) for n, f in table], "license_id string, digest string")
    matches = exploded.join(F.broadcast(digests), "digest").select(F.col(f"`{key}`"), *MATCH_COLUMNS)
    return matches.unionByName(_run_matches(forms, key, table))
