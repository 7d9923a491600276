"""Letters beyond the first 65,536 code points, texts read in steps, and the whole of the classifier in plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import langid


@given(st.text(alphabet="ab .\n1é漢\U0001f600ΣİA", max_size=40), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_steps_change_nothing(text, step):
    whole, parts = langid.Grams().counts(text), langid.Grams(step).counts(text)
    assert [x.tolist() for x in whole[:2]] == [x.tolist() for x in parts[:2]] and whole[2] == parts[2]


def test_texts_beyond_a_step():
    text = "ab cd " * (langid.STEP // 4)
    plain = langid.Grams(len(text))
    assert [x.tolist() for x in langid.Grams().counts(text)[:2]] == [x.tolist() for x in plain.counts(text)[:2]]


def slot(gram):
    """The slot of an n-gram of one to three characters, in plain integers."""
    cut = 0xFFFFFFFF
    c = [ord(x) for x in gram]
    h = c[0] * 2654435761 & cut
    for x, shift, a, b in zip(c[1:], (15, 13), (2246822519, 668265263), (3266489917, 374761393)):
        h = ((h ^ h >> shift) * a + x * b) & cut
    h ^= h >> 16
    return (h * 2146121005 & cut) >> 17


def plain_counts(text):
    chars = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or not chars or chars[-1] != " ":
            chars.append(c)
    return Counter(slot(chars[i : i + n]) for n in (1, 2, 3) for i in range(len(chars) - n + 1))


@given(st.text(alphabet="abz .\n1é漢\U0001f600Σ\U00010400", max_size=30))
@settings(max_examples=100, deadline=None)
def test_counts_in_a_plain_loop(text):
    slots, counts, letters = langid.Grams().counts(text)
    assert dict(zip(slots.tolist(), counts.tolist())) == plain_counts(text)
    assert letters == any(c.isalpha() for c in text.lower())


def test_ftrl_in_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    got = langid.fit_ftrl(rows, 3, alpha=0.7, l1=0.05, l2=0.1, epochs=2)
    z, n = {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        l1, l2 = (0.05, 0.1) if i != langid.SLOTS else (0.0, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((1 + math.sqrt(n.get((i, k), 0.0))) / 0.7 + l2)

    for _ in range(2):
        for slots, v, y in rows:
            x = [*zip(slots.tolist(), v.tolist()), (langid.SLOTS, 0.1)]
            logit = [sum(weight(i, k) * a for i, a in x) for k in range(3)]
            e = [math.exp(t - max(logit)) for t in logit]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            for i, a in x:
                for k in range(3):
                    g = a * (e[k] / sum(e) - (k == y))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.7 * w[i, k]
                    n[i, k] = old + g * g
    want = np.zeros_like(got)
    for i, k in z:
        want[i, k] = weight(i, k)
    assert np.allclose(got, want, atol=1e-10) and (got[:50] == 0).any()


def test_model_and_predictions_in_plain_loops(spark):
    """Document frequencies are those of all labelled rows, and predictions follow from the model."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=40)
    known = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and i is not None]
    df = Counter(s for t, _ in known for s in plain_counts(t))
    assert model["langs"] == sorted({lang for _, lang in known})
    want = [math.log((1 + len(known)) / (1 + df[s])) + 1 for s in range(langid.SLOTS)]
    assert np.allclose(model["idf"], want, rtol=1e-5)
    weights = dict(zip(model["slots"].tolist(), model["weights"].tolist()))
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", langid.predict(spark, model, F.col("text")).alias("p")).collect()}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert tuple(got[i]) == ("und", 0.0)
            continue
        v = {s: (1 + math.log(c)) * float(model["idf"][s]) for s, c in plain_counts(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        logit = [(sum(x / norm * weights.get(s, [0] * 9)[k] for s, x in v.items()) + float(model["bias"][k])) / model["heat"] for k in range(len(model["langs"]))]
        e = [math.exp(x - max(logit)) for x in logit]
        assert got[i]["score"] == pytest.approx(max(e) / sum(e), rel=1e-6) and got[i]["lang"] == model["langs"][e.index(max(e))]


def test_emoji_are_no_letters(spark):
    grams = langid.Grams()
    assert not grams.counts("\U0001f600 123")[2]
    assert grams.counts("\U00020000\U0001f600")[2] and grams.counts("\U00010400")[2]
    assert [x.tolist() for x in grams.counts("ab \U0001f600 cd")[:2]] == [x.tolist() for x in grams.counts("ab ... cd")[:2]]


def test_text_of_emoji_has_no_language(spark):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "\U0001f600 123"), (2, "the dog \U0001f600"), (3, "\U0001f600" * 5)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, train).orderBy(F.col("doc_id")).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == "en"
