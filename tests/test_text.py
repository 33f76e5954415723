import math

import pytest
from pyspark.sql import functions as F

from evalspark.functions import text as tx
from evalspark.functions.values import parse_number, text_kind


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


def test_kinds_of_values(spark):
    cases = {
        "2024-01-02": "date", "2024-02-30": "string", "1/2/24": "date", "13/2/2024": "string", "12": "number",
        "1e5": "number", "1d": "string", "NaN": "string", "0x1F": "number", " 12 ": "number", "abc": "string",
        "": None, "2024-01-02T10:00:00Z": "date", "true": "string", ".5": "number", "Infinity": "number",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["k"] for r in df.select("v", text_kind(F.col("v")).alias("k")).collect()}
    assert got == cases


def test_number_values(spark):
    df = spark.createDataFrame([("0x1F",), ("-2.5e1",), ("x",)], "v string")
    assert [r[0] for r in df.select(parse_number(F.col("v"))).collect()] == [31.0, -25.0, None]


def test_number_text(spark):
    cases = [
        (1.0, "1"), (250000.0, "250000"), (12345678.5, "12345678.5"), (0.5, "0.5"), (1e-4, "0.0001"), (1.5e-7, "1.5e-7"),
        (1e21, "1e+21"), (-3.25, "-3.25"), (123456789012.125, "123456789012.125"), (math.inf, "Infinity"), (0.00012345, "0.00012345"),
    ]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v double")
    assert [r[0] for r in df.select(tx.js_number_string(F.col("v"))).collect()] == [t for _, t in cases]


@pytest.mark.parametrize(
    ("text", "value", "expected"),
    [
        ("an éi cat", "i", True),  # the boundary is ASCII, so an accented letter is one
        ("hello World", "world", True),
        ("worldwide", "world", False),
        ("a+b", "a+", True),
        ("a+ b", "a+", False),
        (r"x a\Eb y", r"a\Eb", True),
    ],
)
def test_whole_word(spark, text, value, expected):
    assert one(spark, tx.whole_word_ci(F.col("t"), F.col("v")), t=text, v=value) is expected


def test_normalize_prompt(spark):
    cases = {
        "  What's the STATUS?? ": "whats the status",
        "a\tb\n\nc": "a b c",
        "a  b﻿": "a b",
        "é ü": "",
        "x,   y": "x y",
    }
    for text, expected in cases.items():
        assert one(spark, tx.normalize_prompt(F.col("t")), t=text) == expected


def test_fact_parts(spark):
    assert one(spark, tx.fact_field(F.col("t")), t=" a =b=c ") == "a"
    assert one(spark, tx.fact_value(F.col("t")), t=" a =b=c ") == "b=c"
    assert one(spark, tx.fact_value(F.col("t")), t="no sign") is None


def test_word_count(spark):
    for text, expected in {"one two  three": 3, "  a b ": 2, "": 1}.items():
        assert one(spark, tx.word_count(F.col("t")), t=text) == expected
