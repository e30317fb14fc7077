"""Classifiers: features against slow versions, held-out accuracy on the given tables."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptych.llm import language_id, quality, queries

SMALL = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")

EN = ["the cat sat on the mat and the dog ran", "where is the house of the man", "this is what they think of that"]
DE = ["der hund und die katze sind nicht da", "wo ist das haus von dem mann", "ich habe nicht gedacht dass es regnet"]


def test_spectrum(monkeypatch):
    spectrum = language_id.Spectrum()
    for text in ("", "a", "ab", "Abcabc abd é中😀", "x" * 1000):
        grams = {text.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
        assert len(spectrum.of(text)) == len(set(spectrum.of(text).tolist())) == len(grams)
    long = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = sorted(spectrum.of(long).tolist())
    monkeypatch.setattr(language_id, "BLOCK", 700)
    assert sorted(spectrum.of(long).tolist()) == whole


def test_kernel_is_the_share_of_common_ngrams():
    spectrum = language_id.Spectrum()
    texts = EN + DE
    spectra = [spectrum.of(t) for t in texts]
    model = language_id.fit(["en"] * 3 + ["de"] * 3, spectra, landmarks=2)
    assert model.languages == ["de", "en"] and len(model.landmarks) == 4
    known = np.full(1 << language_id.SPACE_BITS, -1, np.int32)
    known[model.columns] = np.arange(len(model.columns))
    right = (model.landmarks / np.sqrt(model.landmarks.sum(axis=1, keepdims=True))).T.astype(np.float32)
    kernel = language_id._kernel(spectra, known, right)
    for i, spectrum_i in enumerate(spectra):
        for j, landmark in enumerate([3, 4, 0, 1]):
            a, b = set(spectrum_i.tolist()), set(spectra[landmark].tolist())
            assert kernel[i, j] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, rel=1e-5)
    assert model.predict(texts + ["", "12 %"], spectrum)[0] == ["en"] * 3 + ["de"] * 3 + ["und"] * 2


def test_language_of_odd_rows(make_docs):
    rows = [(i, t, "en" if t in EN else "de") for i, t in enumerate(EN + DE)]
    rows += [(10, None, "en"), (11, "", "de"), (12, "123 !", "de"), (13, EN[0], None), (None, DE[0], "de"), (14, "the " * 60_000, "en"),
             (15, "½ ² 12", "en"), (16, "Ⅷ", "de")]
    docs = make_docs(rows)
    model = language_id.train(docs, landmarks=2)
    got = {r.doc_id: r for r in language_id.identify(docs, model, carry=["doc_id", "lang", "key", "row"]).collect()}
    assert len(got) == len(rows)
    for key, text, lang in rows:
        und = not text or not any(map(str.isalpha, text))
        assert got[key].lang_pred == ("und" if und else lang or "en") and got[key].lang == lang and got[key].key == "clash"
        assert got[key].score == 0 if und else 0 < got[key].score <= 1
    assert language_id.train(docs.limit(0)) is None and language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {tuple(r)[1:] for r in language_id.identify(docs, None).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), model).count() == 0
    lettered = {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    for judged in (model, None):
        assert {r.doc_id for r in language_id.keep_identified(docs, judged).collect()} == lettered


def test_copies_come_into_the_sample_once(make_docs, monkeypatch):
    rows = [(i * 100 + k, f"text {i} of many words", "en") for i in range(40) for k in range(20)]
    given = {}
    monkeypatch.setattr(language_id, "fit", lambda languages, spectra, landmarks: given.update(
        languages=languages, texts={s.tobytes() for s in spectra}))
    language_id.train(make_docs(rows), per_language=30)
    assert given["languages"] == ["en"] * 30 and len(given["texts"]) == 30


def test_repeated_ids_are_within_the_sample(spark, make_docs, monkeypatch):
    docs = make_docs([(7, f"text {i // 20} of words", "en") for i in range(800)] + [(i, f"other {i}", "en") for i in range(8, 12)])
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    given = {}
    monkeypatch.setattr(quality, "fit", lambda samples, labels, seed: given.update(
        texts={a.tobytes() for a, _ in samples}, n=len(labels)))
    quality.train(docs, labels)
    assert given["n"] == len(given["texts"]) == 42
    quality.train(docs, labels, sample_rows=15)
    assert given["n"] == len(given["texts"]) == 15


@given
def test_held_out_languages(spark):
    got = queries.op4_language_id(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def slow_features(text):
    found: dict = {}
    words = [w for w in quality.GAP.split(text) if w]
    for i, word in enumerate(words):
        codes = [32, *map(ord, word), 32]
        mask = (1 << 64) - 1
        powers = [int(p) for p in quality.POWERS]

        def bucket(value, offset):
            value &= mask
            return (((value ^ value >> 29) * int(quality.MIX) & mask) >> 64 - quality.BUCKET_BITS) + offset
        names = [bucket(sum(ord(c) * powers[min(k, 63)] for k, c in enumerate(word)), 0)]
        names += [bucket(sum(c * powers[k] for k, c in enumerate(codes[j:j + n])) + n, quality.BUCKETS)
                  for n in quality.LENGTHS for j in range(len(codes) - n + 1)]
        if i and words[i - 1] == word:
            names.append(quality.REPEAT)
        for name in names:
            found[name] = found.get(name, 0) + 1
    return found


@pytest.mark.parametrize("block", [1 << 19, 20])
def test_features(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    for text in ("", " \n", "a", "ab cd\t\tcd cd", "Éa " * 30 + "x" * 100, "one two three four five"):
        got = dict(zip(*map(np.ndarray.tolist, quality.feature_counts(text)), strict=True))
        want = slow_features(text)
        if block < 100:  # a pair of words over a cut has no feature
            got.pop(quality.REPEAT, None), want.pop(quality.REPEAT, None)
        assert got == want


def test_scores_are_softmax_over_the_average():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=(quality.FEATURES, 4)).astype(np.float32),
                                 rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    texts = ["one two two", "", "three", "x " * 500, "three"]
    for text, got in zip(texts, model.scores(texts), strict=True):
        found, counts = quality.feature_counts(text)
        mean = counts @ model.vectors[found] / counts.sum() if len(found) else np.zeros(4)
        margins = model.output @ mean + model.prior
        assert got == pytest.approx(np.exp(margins[1]) / np.exp(margins).sum(), rel=1e-4)
        assert got == pytest.approx(model.scores([text])[0])  # whatever its neighbours


def test_quality_of_odd_rows(spark, make_docs):
    rows = [(i, "good words here" if i % 2 else "BAD!! JUNK!!") for i in range(40)]
    rows += [(90, None), (91, ""), (None, "good words"), (92, "JUNK!! " * 60_000), (5, "good words here")]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(90, 1), (None, 1), (777, 0), (3, None), (4, 9)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = [(r.doc_id, r.predicted) for r in quality.score(docs, model).collect()]
    assert len(got) == len(rows) and dict(got)[92] == 0 and dict(got)[None] == 1
    assert all(p == i % 2 for i, p in got if i is not None and i < 40)
    assert quality.train(docs, labels.limit(0)) is None and quality.train(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


@given
def test_held_out_quality(spark):
    got = queries.op10_quality(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
