"""Canonical forms of license texts."""

import re
import textwrap
from pathlib import Path

import pytest

from evalspark.llm import licenses


def found(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r)[:4] for r in licenses.find(spark.createDataFrame(rows, schema)).collect())


MIT = licenses.KNOWN[0][1]


@pytest.mark.parametrize(
    "text",
    [
        MIT,
        MIT.upper(),
        "Copyright (c) 2020 Someone\n" + MIT,
        MIT.replace("License\n", "License\n\nCopyright 1999-2024 A & B. All rights reserved.\n\n"),
        MIT.replace("License", "Licence").replace("sublicense", "sub-license").replace(" ", "\n  "),
    ],
)
def test_variants_of_one_license(spark, text):
    assert (1, "text", None, "MIT") in [r for r in found(spark, [(1, text)]) if r[1] == "text"]


def test_lines_and_whole_texts(spark):
    rows = [(1, "x\nReleased under the MIT license\ny"), (2, "Licensed under CC BY-NC 4.0."), (3, "This isn't released under the MIT License."), (4, None), (5, ""), (6, "All rights reserved."), (2, "Licensed under CC BY-NC 4.0.")]
    got = [tuple(r)[:4] for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "line", 1, "MIT")] + 2 * [(2, "line", 0, "CC-BY-NC-4.0"), (2, "text", None, "CC-BY-NC-4.0")], key=str)


def test_known_texts_differ(spark):
    digests = licenses.known_digests(spark).collect()
    assert len({r.digest for r in digests}) == len(digests)
    assert licenses.find(spark.createDataFrame([], "doc_id long, text string, digest int")).count() == 0


def stem(name):
    return (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()


@pytest.mark.parametrize("name", ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC-BY-SA-4.0", "Unlicense"])
def test_complete_texts(spark, name):
    assert (1, "text", None, name) in found(spark, [(1, stem(name))])


def test_texts_inside_longer_documents(spark):
    notice = stem("GPL-3.0~notice").strip().split("\n")
    body = "\n".join(textwrap.wrap(licenses.KNOWN[1][1], 70))
    rows = [
        (1, "int a;\n/*\n" + "\n".join(" * " + line for line in notice) + "\n */\nint b;"),
        (2, "about this\n\n" + body + "\nmore of it"),
        (3, "about this\n\nword " + body + "\nmore of it"),
        (4, "about this\n" + body.replace("sublicense", "sub-\nlicense") + "\nmore of it"),
    ]
    assert found(spark, rows) == [(1, "run", 2, "GPL-3.0"), (2, "run", 2, "MIT"), (4, "run", 1, "MIT")]


@pytest.mark.parametrize(
    "text",
    [
        MIT.replace("sublicense", "sub-\nlicense").replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT"),
        "Copyright The Foo Authors\n" + MIT,
        "# Copyright (c) 2020 Someone\n# (c) The Foo Authors\n#\n" + "\n".join("# " + x for x in textwrap.wrap(MIT, 50)),
        "\n".join(textwrap.wrap(MIT, 44)),
        *["\n".join(textwrap.wrap(MIT[: MIT.index(x)], 60)) + "\n" + MIT[MIT.index(x) :] for x in ("copyright notice", "COPYRIGHT HOLDERS")],
    ],
)
def test_broken_words_and_copyright_lines(spark, text):
    assert (1, "text", None, "MIT") in [r for r in found(spark, [(1, text)]) if r[1] == "text"]


def test_rewrapped_complete_texts(spark):
    texts = {n: stem(n) for n in ("Unlicense", "GPL-3.0", "MPL-2.0", "BSD-3-Clause")}
    got = found(spark, [(i, re.sub(r"(?<=[a-z,]) (?=to |in )", "\n", t)) for i, t in enumerate(texts.values())])
    assert [r[3] for r in got if r[1] == "text"] == list(texts)
