"""Language identification: subwords and averages against plain versions, held-out accuracy, rejection and edge cases."""

from __future__ import annotations

import pathlib
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pitscape.llm import language  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, letters boolean, h string, n long, score double, below string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, True, "x", 2, 0.5, "y") for i, t, lang in rows], DOCS)


SYLLABLES = {"aa": "ka lo mi pe ru", "bb": "sch ung ei ver gt", "cc": "ção é ñu ll ija", "": "zz qx xw vk yj"}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    rnd = random.Random(4)
    rows = [(i - 20, prose(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.choice([1, 3, 30, 200])).title(), lang) for i in range(n)]
    return rows + [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 .. \n", "aa"), (n + 3, "😀 —", "cc"), (None, "kalo mipe", "bb"), (n + 4, "kalo mipe " * 60_000, None), (n + 4, "verung", None)]


def plain_subwords(text):
    data = bytes(language._CLASS[b] for b in b" %s " % text)
    out = []
    for width in language.WIDTHS:
        for k in range(len(data) - width + 1):
            s = data[k : k + width]
            if b" " not in s[1:-1] and s.strip():
                out.append(s)
    return sorted(out)


@pytest.mark.parametrize("window", [1, 7, 262_144])
def test_windows_hold_every_subword_once(monkeypatch, window):
    monkeypatch.setattr(language, "WINDOW", window)
    texts = [b"ab cde", b"", b"x", "Été 7th".lower().encode(), b"  longerword\n"]
    got = [[] for _ in texts]
    for text, bucket in language.windows(texts):
        for t, b in zip(text, bucket, strict=True):
            got[t].append(int(b))
    for t, found in zip(texts, got, strict=True):
        want = []
        for s in plain_subwords(t):
            h = len(s)
            for b in s:
                h = (h << 8 | b) & (2**64 - 1)
            want.append(int(language.mix(np.array([h], np.uint64))[0] & np.uint64(language.BUCKETS - 1)))
        assert sorted(found) == sorted(want)


def test_answers_are_averages():
    rnd = np.random.default_rng(1)
    answers, bias = rnd.standard_normal((language.BUCKETS, 3)), np.array([0.1, 0.2, 0.3])
    texts = [b"one two", b"", b"three " * 100_000]
    got = language.logits(texts, answers, bias)
    for t, z in zip(texts, got, strict=True):
        bucket, share = language._counts(t, language.BUCKETS)
        assert np.allclose(z, share @ answers[bucket] + bias)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    docs = table(spark, rows).repartition(4)
    out = language.predicted_languages(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.lang_pred != "und" and truth[r.doc_id] is not None]
    assert {r.doc_id for r in got if r.held_out} == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    n = 400
    for i in (n, n + 1, n + 2, n + 3):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert not by[None].held_out and by[None].lang_pred == "aa"
    assert sorted(r.lang_pred for r in got if r.doc_id == n + 4) == ["aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {*SYLLABLES, "und"}


def test_foreign_text_is_rejected(spark):
    model = language.fit(table(spark, corpus()))
    rnd = random.Random(8)
    other = [(i, "".join(rnd.choice("абвгдежзик ") for _ in range(200)), None) for i in range(30)]
    own = [(i, prose(rnd, "aa", 60), None) for i in range(30)]
    assert not any(r.accepted for r in language.predict(table(spark, other), model).collect())
    assert all(r.accepted for r in language.predict(table(spark, own), model).collect())


def test_nothing_one_language_and_repeats(spark):
    none = language.predicted_languages(table(spark, [(0, "abc", None), (3, None, "x")])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = language.predicted_languages(table(spark, [(0, "abc", "x"), (1, "def", None), (2, "1", None)])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in one) == [(0, "x", 1.0), (1, "x", 1.0), (2, "und", 0.0)]
    assert language.predicted_languages(table(spark, [])).collect() == []
    hot = table(spark, [(7, "the same text", "x")] * 2000 + [(7, "another", "y"), (8, "one more", "x")])
    assert [r[0] for r in language.sample(hot, 5, 100)] == ["x", "x", "y"]


def test_sample_is_bounded(spark):
    docs = table(spark, [(i, f"text number {i}", "x") for i in range(5000)] + [(9999, "z" * 300, "x")])
    assert len(language.sample(docs, 50, 200)) == 50


def test_temperature_and_threshold():
    rnd = np.random.default_rng(2)
    classes = rnd.integers(0, 3, 4000)
    z = rnd.standard_normal((4000, 3)) + 2.0 * np.eye(3)[classes]
    # for unit noise the exact posterior has the logits 2 * z
    temperature, threshold = language.calibrate(z, classes)
    assert 0.4 < temperature < 0.62
    p = language._probabilities(z, temperature)
    accepted = p.max(axis=1) >= threshold
    assert (p.argmax(axis=1) == classes)[accepted].mean() >= language.PRECISION and 0.2 < accepted.mean() < 0.95
