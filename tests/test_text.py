import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from textlake.functions import chunks, clean, pytext, urls

PROBE = "a b　c\x1cd e\x85f \t\n g१२ 3"


def one(spark, value, c, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(c.alias("x")).first().x


def many(spark, values, c, kind="string"):
    return [r.x for r in spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}").select("i", c.alias("x")).orderBy("i").collect()]


def test_white_space_and_digits_are_pythons(spark):
    texts = [PROBE, "", " ", None, " x ", "​z᠎", "a b"]
    assert many(spark, texts, pytext.words("t")) == [(t or "").split() for t in texts]
    assert many(spark, texts, pytext.strip("t")) == [None if t is None else t.strip() for t in texts]
    assert many(spark, texts[:1], F.regexp_count("t", F.lit(pytext.DIGIT))) == [sum(c.isdecimal() for c in PROBE)]
    assert [c for c in map(chr, range(0x3100)) if re.fullmatch(r"\s", c)] == many(spark, [c for c in map(chr, range(0x3100)) if c.isspace()], F.when(F.col("t").rlike(f"^{pytext.WS}$"), F.col("t")))


def test_passage_cleaner(spark):
    cases = {
        "‌मुख्य पृष्ठ गेहूँ की  खेती...": "गेहूँ की खेती.",
        "Background": "ground",
        "Nextहोम पेज": "पेज",
        "मिट्टी। । ।। स्रोत: कृषि विभाग। बीज": "मिट्टी। । । । बीज",
        "मिट्टी स्त्रोत : क\nख। ग": "मिट्टी । ग",
        "बीज लेखक: राम। सब जाता है": "बीज",
        "लेखन： x": "",
        "शीर्षक | Sometown - AGRICULTURE अंत": "शीर्षक  अंत",
        "इस भाग में गेहूँ की जानकारी दी गई। फसल": "फसल",
        None: "",
        "": "",
    }
    assert many(spark, list(cases), clean.clean_passage("t")) == list(cases.values())


def test_pair_and_question(spark):
    assert one(spark, " A\tb\n\nC ", clean.clean_pair_text("t")) == "A b C"
    assert one(spark, "क्या, यह (सही) है? Yes!! It's १", clean.normalise_question("t")) == "क्या यह सही है yes its १"
    assert one(spark, "अंत।", clean.normalise_question("t")) == "अंत।"
    assert one(spark, "a\r\n\n\n\n b  c\t d\n   e ", clean.clean_extracted("t")) == "a\n\nb c d\ne"


def test_intro(spark):
    cases = ["इस भाग में सब कुछ है। बाकी", "इस लेख  में क | ख। ग", "पहले इस भाग में है। ख", None, " इस पृष्ठ में\nदो पंक्ति। इस भाग में नहीं। अंत ", "इस भाग में बिना अंत"]
    assert many(spark, cases, clean.strip_intro("t")) == ["बाकी", "ख। ग", "पहले इस भाग में है। ख", None, "इस भाग में नहीं। अंत", "इस भाग में बिना अंत"]


def test_predicates(spark):
    assert many(spark, ["a a a a", "a a a", "a a b a", None], clean.is_repeated_word("t")) == [True, False, False, False]
    assert many(spark, ["कx", "x", None], clean.has_script("t")) == [True, False, False]
    assert many(spark, ["x■", "�", "◻", "●", None], clean.has_garbage("t")) == [True, True, True, False, False]
    assert many(spark, ["१a2b", "", None, "ab"], clean.digit_ratio("t")) == [0.5, None, None, 0.0]
    assert many(spark, ["<think>x</think> <think>y</think> z ", "plain", "</think>", None], clean.after_thinking("t", "none")) == ["z", "plain", "none", "none"]
    assert one(spark, "```json\n[1]\n```", clean.without_fences("t")) == "[1]"


def loop(counts, most):
    """The two-pointer form: (start, end) spans."""
    out, i = [], 0
    while i < len(counts):
        total, j = 0, i
        while j < len(counts) and (j == i or total + counts[j] <= most):
            total += counts[j]
            j += 1
        out.append((i, j))
        i = max(j - 1, i + 1)
    return out


def test_word_spans_are_the_loops(spark):
    r = random.Random(2)
    cases = [[], [500], [200], [150, 50, 1], [199, 2, 199], [10] * 5, [1, 300, 1]] + [[r.randint(1, r.choice([20, 90, 260])) for _ in range(r.randrange(25))] for _ in range(1500)]
    found = many(spark, cases, chunks.word_spans(F.col("t"), 200), "array<int>")
    assert [[(s.s, s.e) for s in f] for f in found] == [loop(c, 200) for c in cases]


@pytest.mark.parametrize("overlap", [0, 1, 2, 3, 7])
def test_windows_of_any_overlap(spark, overlap):
    def plain(counts, most):
        out, i = [], 0
        while i < len(counts):
            j, total = i, 0
            while j < len(counts) and (j == i or total + counts[j] <= most):
                total, j = total + counts[j], j + 1
            out.append((i, j))
            i = max(j - overlap, i + 1)
        return out

    r = random.Random(overlap)
    cases = [[], [500], [200], [199, 2, 199], [10] * 5, [1, 300, 1], [60] * 12] + [[r.randint(1, r.choice([20, 90, 260])) for _ in range(r.randrange(25))] for _ in range(300)]
    found = many(spark, cases, chunks.window_spans(F.col("t"), 200, overlap), "array<int>")
    assert [[(s.s, s.e) for s in f] for f in found] == [plain(c, 200) for c in cases]


@pytest.mark.parametrize("overlap", [1, 3])
def test_chunks_carry_their_counts(spark, overlap):
    r = random.Random(3)
    cases = [[" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 60))) for _ in range(r.randrange(14))] for _ in range(60)]
    for f in many(spark, cases, chunks.chunk_words(F.col("t"), 100, longer_than=80, overlap=overlap), "array<string>"):
        assert all(c.words == len(c.text.split()) and c.chars == len(c.text) > 80 for c in f)
    least = many(spark, cases, chunks.chunk_words(F.col("t"), 100, longer_than=None, least_words=40, overlap=overlap), "array<string>")
    assert all(c.words >= 40 for f in least for c in f) and any(least)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00a0 \n\u2003\u200b", max_size=12), min_size=1, max_size=12))
def test_word_counts(spark, texts):
    assert many(spark, [*texts, None, " ", ""], pytext.word_count("t")) == [*(len(t.split()) for t in texts), 0, 0, 0]


def test_char_spans(spark):
    r = random.Random(5)
    cases = [["x" * r.randint(41, r.choice([90, 500])) for _ in range(r.randrange(12))] for _ in range(500)] + [[]]

    def plain(sentences):
        out, cur = [], ""
        for s in sentences:
            if len(cur) + len(s) > 400:
                out, cur = out + [cur.strip()] * (len(cur.strip()) > 80), s
            else:
                cur += " " + s
        return out + [cur.strip()] * (len(cur.strip()) > 80)

    assert many(spark, cases, chunks.chunk_chars(F.col("t")), "array<string>") == [plain(c) for c in cases]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?।|:\n ", max_size=80), min_size=1, max_size=10))
def test_sentences(spark, texts):
    after = lambda marks: re.compile(f"(?<=[{marks}])\\s+").split
    a = [[s.strip() for s in after("।.!?")(t) if len(s.strip()) > 20] for t in texts]
    assert many(spark, texts, chunks.sentences_a("t")) == a

    def second(t):
        t = t.replace("\n", " ")
        for mark in (r"(?<=[।!?])\s+", r"(?<=\|)\s*", r"(?<=:)\s+"):
            t = re.compile(mark).sub("\n", t)
        return [s.strip() for s in t.split("\n") if len(s.strip()) > 5]

    assert many(spark, texts, chunks.sentences_b("t")) == [second(t) for t in texts]
    c = [[s.strip() for s in after("।.")(" ".join(t.split())) if len(s.strip()) > 40] for t in texts]
    assert many(spark, texts, chunks.sentences_c("t")) == c


def test_slug(spark):
    cases = {
        "https://h.example/a/b-c_d.e?x=/y#z": "b-c_d_e", "https://h.example": "home", "https://h.example/": "home", "http://h/a/": "a", "http://h/" + "x" * 150: "x" * 100,
        "http://h/%E0%A4%95": "_E0_A4_95", "http://h/कृषि ज्ञान": "कृषि_ज्ञान", None: "home", "": "home",
    }
    assert many(spark, list(cases), urls.slug("t")) == list(cases.values())


def test_url_rules(spark):
    assert many(spark, ["http://h/annual report.pdf", "http://h/Crop.pdf", "http://h/horticulture.pdf", "http://h/x", None], urls.triage("t")) == ["SKIP", "KEEP", "SKIP", "REVIEW", "REVIEW"]
    assert many(spark, ["http://h/horticulture.pdf", "http://h/rti.pdf"], urls.triage("t", whole_words=True)) == ["KEEP", "SKIP"]
    assert many(spark, ["A Manual and JOURNAL", "none", None], urls.categories("t")) == [["books", "magazines"], ["html_articles"], ["html_articles"]]
    assert many(spark, ["http://h/login", "http://h/a", None], urls.is_junk_url("t")) == [True, False, False]
    assert many(spark, ["http://h/viewcontent/1?lgn=hi", "http://h/viewcontent/1", None], urls.is_content_url("t")) == [True, False, False]
    assert many(spark, ["FAQ page", "क " + urls.FAQ.split("|")[2], "x", None], urls.is_faq("t")) == [True, True, False, False]


@pytest.mark.parametrize("text", ["it's", "a'b''c", string.punctuation])
def test_literal(text):
    import duckdb

    assert duckdb.sql(f"SELECT {pytext.literal(text)} AS x").fetchall() == [(text,)]
