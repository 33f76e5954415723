"""Line dedup: what recurs, what doesn't, and what stays."""

from evalspark.llm import templates as t


def kept(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    return sorted(((r.row.doc_id, r.text) for r in t.drop_lines(docs).collect()), key=str)


def body(i):
    return f"first own line of document number {'abcdefgh'[i]}", f"closing words of {'hgfedcba'[i]} alone"


def test_recurring_lines_go_but_for_the_first(spark):
    rows = [(i, "\n".join([body(i)[0], "Subscribe to our newsletter today", body(i)[1]])) for i in range(3)]
    got = kept(spark, rows)
    assert got[0] == rows[0] and got[1] == (1, "\n".join(body(1))) and got[2] == (2, "\n".join(body(2)))
    assert kept(spark, rows[:2]) == rows[:2]  # twice isn't enough for a short line


def test_variable_fields(spark):
    rows = [(i, "\n".join([body(i)[0], f"Posted on 2024-01-0{i} by user{i}", body(i)[1]])) for i in range(3)]
    assert [text for _, text in kept(spark, rows)][1:] == ["\n".join(body(i)) for i in (1, 2)]
    words = "this notice was sent to every reader named {} by mail"
    rows = [(i, "\n".join([body(i)[0], words.format("Ann Bob Cy".split()[i]), body(i)[1]])) for i in range(3)]
    assert [text for _, text in kept(spark, rows)][1:] == ["\n".join(body(i)) for i in (1, 2)]


def test_long_passages_recur_from_two_texts_on(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}x{'y' * (i % 5)}" for i in range(55))
    rows = [(i, "\n".join([body(i)[0], passage, body(i)[1]])) for i in range(2)]
    assert kept(spark, rows) == [rows[0], (1, "\n".join(body(1)))]


def test_copies_are_left_alone(spark):
    text = "\n".join(body(0) + body(1))
    rows = [(i, text) for i in range(6)] + [(7, text + "\nanother end")]
    assert kept(spark, rows) == sorted(rows, key=str)


def test_nulls_blank_lines_and_repeated_rows(spark):
    line = "Subscribe to our newsletter today"
    rows = [(None, f"a one\n\n{line}\nb"), (2, f"c two\n{line}\n \nd"), (2, f"c two\n{line}\n \nd"), (3, f"e three\n{line}\nf"), (4, None), (5, ""), (6, "\n")]
    got = kept(spark, rows)
    assert (2, rows[1][1]) in got and got.count((2, rows[1][1])) == 2
    assert (3, "e three\nf") in got and (None, "a one\n\nb") in got and {(4, None), (5, ""), (6, "\n")} <= set(got)


def test_clean(spark):
    line = "Subscribe to our newsletter today"
    rows = [(i, f"{body(i)[0]}\n{line}\n{body(i)[1]}", 99, "x") for i in range(3)] + [(7, line, 33, "y"), (8, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, dropped string")
    out = {r.doc_id: r for r in t.clean(docs).collect()}
    assert set(out) == {0, 1, 2, 8} and t.clean(docs).columns == docs.columns
    assert (out[0].n_chars, out[1].n_chars, out[1].dropped) == (99, len(out[1].text), "x")
    assert t.clean(docs.limit(0)).count() == 0
