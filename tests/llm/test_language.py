"""Language evidence: held-out accuracy of the text model, and what the other clues add."""

import os
import random
import re
import time
from collections import defaultdict
from math import exp

import pytest

from evalspark.llm import language

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.filter("doc_id % 2 = 0"), per_language=50)
    held_out = docs.filter("doc_id % 2 = 1 AND length(text) > 200").select("text", "lang").collect()
    right = sum(model.languages[model.loglik(r.text)[1].argmax()] == r.lang for r in held_out)
    assert len(held_out) > 200 and right / len(held_out) > 0.97


def page(lang, text):
    return f'<html lang="{lang}"><head><script>der die das</script></head><body><p>{text}</p></body></html>'


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the dog went to the house with that man", "en") for i in range(20)]
    rows += [(100 + i, "der Hund und die Katze gehen mit dem Mann in das Haus", "de") for i in range(20)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_clues(spark, model):
    rows = [(i, f"http://host.example.de/{i}", page("de", "die Katze und der Hund gehen in das Haus")) for i in range(30)]
    rows += [(100 + i, f"http://www.site.com/{i}", page("en", "that man and the dog went to the house")) for i in range(30)]
    rows += [(200, "http://host.example.de/x", "<p>1234</p>"), (201, "http://www.site.com/y", None), (202, None, page("de", "")), (203, None, None), (None, "::bad[", "<p>the dog</p>")]
    rows += [rows[0]]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i].language == "de" for i in range(30)) and all(by_id[100 + i].language == "en" for i in range(30))
    assert (by_id[200].language, by_id[201].language, by_id[202].language) == ("de", "en", "de")
    assert by_id[200].text_language is None and by_id[203].language in ("de", "en") and by_id[None].language == "en"


def test_no_labels_and_empty_table(spark, model):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.de", page("de", "x"))], "page_id long, url string, html string")
    assert language.identify(pages, language.fit(nothing)).first().language is None
    assert language.identify(pages.limit(0), model).count() == 0


def test_parts():
    assert language.address_parts("https://Blog.A.example.org:80/x?y") == ("blog.a.example.org", "example.org", "org")
    assert language.declared_language("<HTML class=x LANG = 'de-AT'>") == "de" and language.declared_language("<p lang=fr>") == ""
    assert language.visible_text("<style>x</style>a &amp; <b>c</b><!-- d -->").split() == ["a", "&", "c"]


def test_scanners_against_plain_patterns():
    rnd = random.Random(5)
    hidden = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
    declared = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")
    pieces = ["<script>", "</script >", "<STYLE a>", "</style>", "<!--", "-->", "<template", "</template\n>", "<html ", "lang=", "'de'", " en", ">", "<", "x", " ", "</", "scripts", "<html lang=fr>"]
    for _ in range(3000):
        page_text = "".join(rnd.choices(pieces, k=rnd.randrange(14)))
        assert language.visible_text(page_text) == language.entities.unescape(re.sub("<[^>]*>", " ", hidden.sub(" ", page_text))), page_text
        found = declared.search(page_text)
        assert language.declared_language(page_text) == (found[1].lower() if found else ""), page_text


def test_hostile_pages_take_linear_time():
    size = 1_000_000
    for piece in ("<script>", "<style", "<!--", "<", "<html ", "<html lang ", "</script ", "<script></style>", "lang=", "&"):
        text = piece * (size // len(piece))
        began = time.process_time()
        language.visible_text(text)
        language.declared_language(text)
        assert time.process_time() - began < 5, piece


def by_loops(model, pages):
    """The fused shares of each page, one page and one language at a time."""
    size = len(model.languages)
    scored = []
    for page_id, url, html in pages:
        grams, loglik = model.loglik(language.visible_text(html or ""))
        likely = [exp(x) for x in loglik]
        host, domain, suffix = language.address_parts(url or "")
        clues = {"host": host, "domain": domain, "suffix": suffix, "declared": language.declared_language(html or "")}
        scored.append((page_id, likely, [x / sum(likely) for x in likely], clues))
    sums = defaultdict(lambda: [0.0] * size)
    for _, _, p, clues in scored:
        for name, value in [*clues.items(), ("all", None)]:
            sums[name, value] = [a + b for a, b in zip(sums[name, value], p)]
    every = sums["all", None]
    corpus = [(n + 1.0) / (sum(every) + size) for n in every]
    out = []
    for page_id, likely, p, clues in scored:
        def others(key):
            return [max(n - own, 0.0) for n, own in zip(sums[key], p)]

        prior = corpus
        for name in ("domain", "host"):
            counts = others((name, clues[name]))
            prior = [(n + language.PRIOR_PAGES * q) / (sum(counts) + language.PRIOR_PAGES) for n, q in zip(counts, prior)]
        weight = [a * b for a, b in zip(likely, prior)]
        for name in ("declared", "suffix"):
            kinds = len({c[name] for _, _, _, c in scored})
            weight = [
                w * (n + language.CLUE_PAGES) / (total + language.CLUE_PAGES * kinds)
                for w, n, total in zip(weight, others((name, clues[name])), others(("all", None)))
            ]
        out.append((page_id, [w / sum(weight) for w in weight]))
    return out


def check_against_loops(spark, model, pages):
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    want = by_loops(model, pages)
    assert len(got) == len(want)
    for page_id, shares in want:
        best = max(shares)
        assert abs(got[page_id].confidence - best) < 1e-3
        # Of shares that are equal but for rounding, either may win.
        assert shares[model.languages.index(got[page_id].language)] >= best - 1e-9
    return got


def test_fusion_against_loops(spark, model):
    rnd = random.Random(6)
    hosts = ["a.one.de", "b.one.de", "c.two.com", "www.three.org", "localhost", ""]
    texts = ["der Hund", "the dog", "die Katze und the cat", "", "123", "that man went to the house"]
    pages = [(i, f"http://{rnd.choice(hosts)}/{i}", rnd.choice([page(rnd.choice(["de", "en", "xx"]), rnd.choice(texts)), rnd.choice(texts), None])) for i in range(150)]
    got = check_against_loops(spark, model, pages + [(1000, None, None), (1001, "::bad[", "")])
    assert {r.language for r in got.values()} == {"de", "en"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_fusion_of_given_pages_against_loops(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"), per_language=50)
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    check_against_loops(spark, model, [tuple(r) for r in rows])
