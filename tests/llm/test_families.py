"""Line families: blocks of several lines, copies next to unrelated documents."""

import pytest

from evalspark.llm import families, templates
from tests.llm.test_templates import body


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.row.doc_id: r.text for r in templates.drop_lines(docs, find=families.recurring_families).collect()}


BLOCK = ["Subscribe to our newsletter today", "All rights are reserved by us", "Contact the office by mail"]


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("header", [True, False])
def test_blocks_of_lines(spark, size, header):
    rows = [(i, "\n".join(BLOCK[:size] + list(body(i)) if header else list(body(i)) + BLOCK[:size])) for i in range(4)]
    assert kept(spark, rows) == {0: rows[0][1], **{i: "\n".join(body(i)) for i in range(1, 4)}}
    assert kept(spark, rows[:2]) == dict(rows[:2])


def test_copies_neither_make_nor_hide_a_recurring_line(spark):
    shared = "Subscribe to our newsletter today"
    long = [f"sentence {w} of the text that was copied over and again" for w in "one two three four five six seven".split()]
    copies = [(i, "\n".join([*long[:3], shared, *long[3:], f"ending {'abcdefghijklmnopqrst'[i]}"])) for i in range(20)]
    assert kept(spark, copies) == dict(copies)
    others = [(30 + i, "\n".join([body(i)[0], shared, body(i)[1]])) for i in range(3)]
    got = kept(spark, copies + others)
    assert got[0] == copies[0][1]
    assert all(got[i] == t.replace(shared + "\n", "") for i, t in copies[1:])
    assert [got[30 + i] for i in range(3)] == ["\n".join(body(i)) for i in range(3)]


def test_pipeline_stage(spark):
    import corpus_pipeline

    rows = [(i, "\n".join([*body(i), *BLOCK]), 9) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out == {0: rows[0][1], **{i: "\n".join(body(i)) for i in range(1, 4)}}


def test_nulls_and_empty_tables(spark):
    line = BLOCK[0]
    rows = [(None, f"a one x y\n\n{line}\nb"), (2, f"c two x y\n{line}\n \nd"), (3, f"e three x y\n{line}\nf"), (4, None), (5, ""), (6, "\n")]
    assert kept(spark, rows) == {None: "a one x y\n\nb", 2: rows[1][1], 3: "e three x y\nf", 4: None, 5: "", 6: "\n"}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert templates.drop_lines(docs, find=families.recurring_families).count() == 0


def test_several_families_of_one_leaf(spark):
    exact = "this notice was repeated word for word in a few texts"
    sent = "this notice was sent to all readers whose name is {}"
    kept_by = "this notice was kept by every office in town near {}"
    assert {len(x.split()) for x in (exact, sent, kept_by)} == {11}
    names = "Ann Bob Cy Dee Eve".split()
    lines = [exact] * 3 + [sent.format(n) for n in names] + [kept_by.format(n) for n in names]
    own = "abcdefghijklm"
    rows = [(i, f"opening of text {own[i]} here\n{line}\nclosing of text {own[i]} there") for i, line in enumerate(lines)]
    got = kept(spark, rows)
    for i, text in rows:
        assert got[i] == (text if i in (0, 3, 8) else text.replace(lines[i] + "\n", ""))


FUNCTION = """def {0}_of(value):
    if x:
        return None
    else:
        total = {0} + value * {1}
    return total
}}
## Introduction
the {0} of each value is found by a walk over {1} others"""


def test_code_and_headings_stay(spark):
    words = "mean median mode range sum product".split()
    rows = [(i, FUNCTION.format(w, words[i - 1])) for i, w in enumerate(words)]
    assert kept(spark, rows) == dict(rows)


def test_short_lines_go_with_their_block(spark):
    block = [BLOCK[0], "Thank you", "}"]
    rows = [(i, "\n".join([*body(i), *block])) for i in range(4)]
    want = {0: rows[0][1], **{i: "\n".join([*body(i), "}"]) for i in range(1, 4)}}
    assert kept(spark, rows) == want


def test_blank_rests_go(spark):
    rows = [(i, "\n".join([*body(i), BLOCK[0]])) for i in range(4)] + [(9, f"{BLOCK[0]}\n\t\n \n")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    assert sorted(r.doc_id for r in templates.clean(docs, find=families.recurring_families).collect()) == [0, 1, 2, 3]
