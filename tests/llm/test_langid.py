import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textlake.llm import langid

from pyspark.sql import functions as F
from textlake.llm.common import hash_u63

from .cases import empty, odd, prose

TEXTS = {
    "en": ["the cat sat on the mat and the dog sat on the log", "there is the other thing that they thought", "in the end the weather was rather better than the other day"] * 2,
    "de": ["der hund und die katze sind in dem haus", "das ist nicht der weg den ich gehen wollte", "und dann ging er mit seiner frau in die stadt"] * 2,
}


def plain(texts):
    """Interpolated Kneser-Ney over the words' letters, on dicts: gives log2 p of each letter."""
    words = Counter(" " + w + " " for t in texts for w in t.split())
    raw = [Counter() for _ in range(langid.ORDER + 1)]
    for w, c in words.items():
        for m in range(1, langid.ORDER + 1):
            for i in range(1, len(w)):  # the opening space is given
                if i - m + 1 >= 0:
                    raw[m][w[i - m + 1 : i + 1]] += c
    for m in range(1, langid.ORDER):
        before, opens = defaultdict(set), set()
        for w in words:
            for i in range(1, len(w)):
                if i - m >= 0:
                    before[w[i - m + 1 : i + 1]].add(w[i - m])
                if i - m + 1 == 0:
                    opens.add(w[: i + 1])
        for g in raw[m]:
            if not (m > 1 and g in opens):
                raw[m][g] = max(len(before[g]), 1)
    d, total, kinds = {}, {}, {}
    for m in range(1, langid.ORDER + 1):
        once, twice = (sum(v == k for v in raw[m].values()) for k in (1, 2))
        d[m] = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        total[m], kinds[m] = Counter(), Counter()
        for g, c in raw[m].items():
            total[m][g[:-1]] += c
            kinds[m][g[:-1]] += 1

    def p(context, letter, m):
        if m == 0:
            return 1 / langid._ALPHABET
        context = context[len(context) - m + 1 :] if m > 1 else ""
        lower = p(context[1:] if m > 1 else "", letter, m - 1)
        if not total[m][context]:
            return lower
        return max(raw[m][context + letter] - d[m], 0) / total[m][context] + d[m] * kinds[m][context] / total[m][context] * lower

    known = {}

    def of_word(w):
        if w not in known:
            x = [-math.log2(p(f" {w} "[:i], f" {w} "[i], min(langid.ORDER, i + 1))) for i in range(1, len(w) + 2)]
            known[w] = sum(x), sum(v * v for v in x), len(x)
        return known[w]

    def bits(text, square=False):
        """Bits of a letter on average, or their squares."""
        found = [of_word(w) for w in text.split()]
        return sum(x[square] for x in found) / sum(x[2] for x in found)

    return bits


def test_probabilities_are_the_plain_ones():
    model = langid.fit(TEXTS, {})
    held = ["the katze sat", "zebra", "den ich the", "qqq xxx", "a"]
    ce, _ = langid.score(model, pa.array(held))
    for k, lang in enumerate(model.languages):
        bits = plain(TEXTS[lang])
        assert np.allclose(ce[:, k], [bits(t) for t in held], rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, max_docs=60, max_held_out=30)
    found = langid.identify(docs, model).join(docs.select("doc_id", docs.lang.alias("real")), "doc_id").collect()
    assert len(found) == docs.count()
    assert sum(r.lang == r.real for r in found) / len(found) > 0.97
    assert sum(r.lang == "und" for r in found) / len(found) < 0.02


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_rejects_what_is_no_language(spark, sf, model):
    junk = ["1234 5678 ### $$$", "   \n", "नमस्ते दुनिया यह एक परीक्षण है और कुछ नहीं", "привет как дела сегодня вечером", "xqzvk wqxjz kkzqx vvxqj zzqkw jxqzv", "漢字かな交じり文の例です"]
    df = spark.createDataFrame(list(enumerate(junk)), "doc_id bigint, text string")
    assert {r.lang for r in langid.identify(df, model).collect()} == {langid.UNKNOWN}


def test_odd_rows(spark, model):
    df = odd(spark).selectExpr("*", "1 AS ok", "'x' AS margin", "2 AS deviation")
    out = langid.identify(df, model).collect()
    assert len(out) == 13
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for k in (3, 4, 7):
        assert by[k] == [("und", None, None, None)]
    assert by[2][0] == by[2][1] == by[1][0]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    good = sorted(((r[0], r[1]) for r in out if r[1] != "und"), key=repr)
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=repr) == good
    assert langid.identify(empty(spark), model).collect() == [] == langid.keep_identified(empty(spark), model).collect()


def test_nothing_to_learn_from(spark):
    assert langid.train(empty(spark)) is None
    assert {r.lang for r in langid.identify(odd(spark), None).collect()} == {"und"}
    assert langid.keep_identified(odd(spark), None).collect() == []
    lone = langid.train(odd(spark).where("lang = 'en'"))
    assert {r.margin for r in langid.identify(odd(spark), lone).collect()} == {None}


def test_ties_go_to_the_first(spark):
    twin = langid.fit({"b": TEXTS["en"], "a": TEXTS["en"]}, {})
    df = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id bigint, text string")
    assert langid.identify(df, twin).first().lang == "a"


def test_copies_leave_the_sample_whole(spark, monkeypatch):
    few = [f"{TEXTS['de'][k % 3]} {'abcdefghij'[k]}" for k in range(10)]
    data = [(t, "de") for t in few for _ in range(900)] + [(f"  {' ' * k}", "de") for k in range(900)]
    data += [(f"{prose(k, 8)} {TEXTS['en'][k % 3]}", "en") for k in range(900)]
    df = spark.createDataFrame(data, "text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, held: seen.update(texts=texts, held=held))
    langid.train(df, max_docs=20, max_held_out=10)
    assert sorted(seen["texts"]["de"] + seen["held"]["de"]) == sorted(few)
    h = {r.text: r.h for r in df.withColumn("h", hash_u63(F.col("text"), seed=7)).where("lang = 'en'").collect()}
    assert sorted(seen["texts"]["en"] + seen["held"]["en"]) == sorted(sorted(h, key=h.get)[:30])
    assert (len(seen["texts"]["en"]), len(seen["held"]["en"])) == (20, 10)


def test_wrong_labels_do_not_move_the_limits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("text").distinct().collect()
    good = sorted(r.text for r in docs)
    other = lambda a, k: "".join(chr(a + ord(c) % 32) if c.isalpha() else c for c in prose(k, 60, 400))
    half = len(good) // 2
    noisy = good[:half] + [other(0x430, k) for k in range(half // 25)]
    assert not any("о" in t for t in langid.trusted(noisy)) and len(langid.trusted(noisy)) > 0.97 * half
    trained = spark.createDataFrame([(t, "en") for t in good + [other(0x430, k) for k in range(len(good) // 25)]], "text string, lang string")
    assert not langid.decide(langid.train(trained), pa.array([other(0x430, 900 + k) for k in range(20)]))["ok"].any()
    clean = langid.fit({"en": good[:half]}, {"en": good[half:]})
    bad = max(1, (len(good) - half) // 25)  # 4 %
    for a in (0x430, 0x5D0, 0x3B1):
        model = langid.fit({"en": good[:half]}, {"en": good[half:] + [other(a, k) for k in range(bad)]})
        assert np.allclose(model.limit, clean.limit, rtol=0.05) and np.allclose(model.ceiling, clean.ceiling, rtol=0.05)
        assert not langid.decide(model, pa.array([other(a, 900 + k) for k in range(20)]))["ok"].any()


def test_rare_texts_of_a_language_are_kept(spark, monkeypatch):
    few = [f"wort{k} und noch eines mehr {'xyz'[k % 3]}" for k in range(5)]
    df = spark.range(200_000).selectExpr("CASE WHEN id < 100000 THEN element_at(array(" + ",".join(f"'{t}'" for t in few) + "), cast(id % 5 + 1 AS int)) ELSE concat('the text of number ', id) END AS text", "CASE WHEN id < 100000 THEN 'aa' ELSE 'bb' END AS lang")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, held: seen.update(texts=texts, held=held))
    langid.train(df)
    assert sorted(seen["texts"]["aa"] + seen["held"]["aa"]) == sorted(few)
    h = {r.text: r.h for r in df.withColumn("h", hash_u63(F.col("text"), seed=7)).where("lang = 'bb'").collect()}
    order = sorted(h, key=h.get)[:600]
    assert seen["held"]["bb"] == order[2::3] and seen["texts"]["bb"] == langid.trusted([t for k, t in enumerate(order) if k % 3 != 2])


def test_bounds_of_the_sample(spark, monkeypatch):
    data = [(f"{'x' * 50} {k}", f"l{k % 7}") for k in range(140)] + [("y" * 9000, "long"), ("z" * 9000, "long")]
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, held: seen.update(texts=texts, held=held))
    df = spark.createDataFrame(data, "text string, lang string")
    langid.train(df, max_chars=500)
    size = {k: sum(map(len, seen["texts"].get(k, []) + seen["held"].get(k, []))) for k in seen["texts"]}
    assert set(size) == {f"l{k}" for k in range(7)} | {"long"} and size.pop("long") == 9000 and all(500 <= n < 560 for n in size.values())
    langid.train(df, max_languages=3)
    assert set(seen["texts"]) == {"l0", "l1", "l2"}


def test_limits_are_the_plain_ones():
    held = [f"the cat {'sat on the mat ' * (k % 7)} {chr(97 + k % 26) * (k % 4)}" for k in range(60)]
    model = langid.fit({"en": TEXTS["en"]}, {"en": held})
    bits = plain(TEXTS["en"])
    ce = np.array([bits(t) for t in held])
    n = np.array([len(" ".join(t.split())) + 1 for t in held])
    mean = np.median(ce)
    assert np.isclose(model.mean[0], mean, rtol=1e-4)
    assert np.isclose(model.var_text[0], (1.4826 * np.median(abs(ce - mean))) ** 2, rtol=1e-2)
    z = (ce - mean) / np.sqrt(model.var_char[0] / n + model.var_text[0] + 1e-9)
    assert np.isclose(model.limit[0], max(8, 1.5 * np.quantile(z, langid.CLEAN)), rtol=1e-2)
    assert np.isclose(model.ceiling[0], max(3 * mean, 1.5 * np.quantile(ce, langid.CLEAN)), rtol=1e-2)
    assert np.isclose(model.near[0], (mean + np.median([bits(t) for t in langid.shuffled(held)])) / 2, rtol=1e-4)
    found = langid.decide(model, pa.array(["the cat sat", "qqqq xxxx zzzz qqqq xxxx zzzz qqqq"]))
    assert found["ok"].tolist() == [True, False] and np.isclose(found["bits_per_char"][0], bits("the cat sat"), rtol=1e-4)


def test_shuffled_letters():
    texts = ["The cat, sat!", "", "ab 12 é"]
    found = langid.shuffled(texts)
    assert [sorted(t) for t in found] == [sorted(t) for t in ("the cat sat", "", "ab é")] and [list(map(len, t.split())) for t in found] == [[3, 3, 3], [], [2, 1]]


def test_texts_that_are_partly_junk_stay(spark, sf):
    import random

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars > 1000").select("text").distinct().collect()
    good, r = sorted(x.text for x in docs), random.Random(2)
    model = langid.fit({"en": good[::2]}, {"en": good[1::2]})
    junk = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))
    part = [f"{t[:1000]} {junk(30)}" for t in good[1::2]]  # a sixth of it
    assert langid.decide(model, pa.array(part))["ok"].all()
    assert not langid.decide(model, pa.array([junk(150) for _ in range(20)]))["ok"].any()


def test_unknown_languages_are_rejected():
    """Each of the languages by the models of the three others."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"])
    by = {}
    for lang, text in zip(*(t.column(c).to_pylist() for c in ("lang", "text"))):
        if len(text) > 300 and len(by.setdefault(lang, [])) < 300:
            by[lang].append(text)
    for out in by:
        known = {k: x for k, x in by.items() if k != out}
        model = langid.fit({k: x[:150] for k, x in known.items()}, {k: x[150:] for k, x in known.items()})
        assert langid.decide(model, pa.array(by[out]))["ok"].mean() < 0.1
        assert all(langid.decide(model, pa.array(x))["ok"].mean() > 0.98 for x in known.values())


@pytest.mark.parametrize("numbers", [0, 30, 1 << 20])
def test_known_words_have_the_same_figures(numbers):
    model = langid.fit(TEXTS, {})
    known = langid.Known(model, numbers)
    for texts in (["the cat", "der hund", None], ["", "cat dog the", "x y"], ["the the the"], []):
        ce, n = langid.score(model, pa.array(texts, pa.string()), known)
        plain_ce, plain_n = langid.score(model, pa.array(texts, pa.string()))
        assert (ce == plain_ce).all() and (n == plain_n).all()
    assert len(known.units) <= numbers // 3
