"""Language and quality: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weft.llm import language, quality

LETTERS = {"aa": "etaoinshr", "bb": "qxzkjvwyu", "cc": "éàèçôûîœe"}


def labelled(spark, n=240):
    rng = random.Random(8)
    return spark.createDataFrame([(i, prose(rng, 40, LETTERS[lang := sorted(LETTERS)[i % 3]]), lang) for i in range(n)], "doc_id long, text string, lang string")


def test_languages(spark):
    rows = language.languages(labelled(spark)).collect()
    truth = {i: sorted(LETTERS)[i % 3] for i in range(240)}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 240 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_backoff_to_shorter_grams():
    m = language.Backoff({"aa": language.Counter({"there": 5, "these": 5}), "bb": language.Counter({"quick": 5, "quack": 5})}, 100, 100)
    assert "there" in m.known and "theres" not in m.known
    got = m.posteriors(["theres", "quz", "日"])
    assert got[0].argmax() == 0 and got[1].argmax() == 1
    assert np.allclose(np.exp(got[2]).sum(), 1)


def test_odd_rows(docs, empty):
    got = {r["doc_id"]: r for r in language.languages(docs).collect()}
    assert got[901]["lang_pred"] == got[902]["lang_pred"] == got[905]["lang_pred"] == "und" and got[901]["score"] == 0
    assert got[None]["held_out"] and got[907]["lang_pred"] == "en"
    assert language.languages(docs).count() == docs.count() and language.languages(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(unlabelled).collect()} == {"und"}


def junk(rng):
    t = prose(rng, 60)
    return rng.choice([t.upper() + "!!!", " ".join([t.split()[0]] * 60), t.replace(" ", "### ")])


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, junk(rng) if i % 4 == 0 else prose(rng, 60).capitalize() + ".") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_compiled_rules_equal_the_ensemble(spark, docs):
    x = np.random.default_rng(1).random((500, len(quality.NAMES)))
    model = quality.fitted(x, ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float), trees=8)
    assert 0 < len(model.rules) and ((model.score(x) > 0.5) == ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7))).mean() > 0.95
    text = quality.text_of()
    rows = docs.select(model.column(text).alias("s"), *[c.alias(n) for n, c in quality.statistics(text).items()]).collect()
    facts = np.array([r[1:] for r in rows], float)
    assert np.allclose(model.score(facts), [r[0] for r in rows])


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77777, 0)], "doc_id long, quality int")
    assert quality.scored(docs, labels).count() == docs.count() and quality.scored(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}


def test_statistics_equal_a_plain_computation(spark, docs):
    import re
    import unicodedata

    def plain(t):
        n, words, lines = max(len(t), 1), re.split("[ \n]", t), t.split("\n")
        return [
            len(t), n / len(words), sum(unicodedata.category(c) == "Lu" for c in t) / n, sum("0" <= c <= "9" for c in t) / n, sum(c in "#$%&*|!<>{}=+~^@/\\" for c in t) / n, t.count("!") / n, t.count("|") / n,
            t.count(".") / len(words), t.count(",") / len(words), (len(t.encode()) - len(t)) / n, len(set(words)) / len(words), len(set(lines)) / len(lines), n / len(lines),
        ]

    more = spark.createDataFrame([("Ünder|Lined!! 12#3.\n\nTwo, two, two. {a}\\b",), ("\n",), (" a  b ",)], "text string")
    text = quality.text_of()
    for r in docs.select("text").union(more).select(text.alias("t"), *quality.statistics(text).values()).collect():
        assert np.allclose(r[1:], plain(r[0])), r[0][:50]


def test_scores_equal_a_plain_computation():
    """Words one by one, with the word-first backoff written out."""
    import math

    rng = random.Random(23)
    counts = {lang: language.Counter(prose(rng, 300, letters).split()) for lang, letters in LETTERS.items()}
    model, own = language.Backoff(counts, 100, 200), {}
    scorer = language.Scorer(model)
    texts = [prose(rng, n, LETTERS[rng.choice(sorted(LETTERS))] + "ab") for n in (1, 3, 50, 500)] + ["", "²" * 9 + " 12", "x²there"]
    for text, (lang, score) in zip(texts, scorer.predict(texts)):
        words = language.words_of(text)
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.zeros(3)
        for w in words:
            rows = [model.rows[model.known[w]]] if w in model.known else next((f for n, t in zip(language.LENGTHS, model.grams) if (f := [model.rows[t[g]] for g in language.grams_of(w, n) if g in t])), [np.zeros(3)])
            v = np.mean(np.array(rows, float), 0)
            v = v - math.log(sum(math.exp(x) for x in v))
            total += np.maximum(v, language.FLOOR)
        p = np.exp((total - total.max()) * language.WORTH / (len(words) + language.WORTH))
        assert lang == sorted(LETTERS)[int(total.argmax())] and abs(score - 1 / p.sum()) < 1e-4
    assert all(sc == (language.UNDETERMINED, 0.0) for sc in scorer.predict(["² " * 8, "² " * 9, "¼" * 400]))
