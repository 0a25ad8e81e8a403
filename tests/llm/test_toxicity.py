"""Toxicity: automata against edit distances, windows, held-out accuracy and odd input."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.llm import toxicity_automata as tox

DIR = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_equal_edit_distances():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))): rng.random() + 1 for _ in range(60)}
    lexicon = tox.Lexicon(terms, {}, frozenset())
    for _ in range(2000):
        word, most = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10))), rng.randint(0, 2)
        want = min(((distance(word, t), -w) for t, w in terms.items()), default=None)
        got = lexicon.nearest(word, most)
        assert got == (None if want[0] > most else (want[0], -want[1]))


def test_the_filter_before_the_walk_drops_no_match():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 13))): 1.0 for _ in range(40)}
    lexicon = tox.Lexicon(terms, {}, frozenset())
    passed = 0
    for _ in range(4000):
        word = "".join(rng.choice("abc*") for _ in range(rng.randint(4, 13)))
        most = tox.allowed(word)
        if most:
            near = lexicon.nearest(word, most)
            assert near == lexicon.nearest(word, most, lexicon.paths(word, most))
            passed += near is not None
    assert passed > 100


def test_misspelled_words_and_clean_neighbours():
    lexicon = tox.Lexicon({"idiot": 4.0, "worthless": 3.0, "scum": 5.0}, {"moroni": 2.0}, frozenset({"idiom"}))
    look = lambda token: lexicon.look_up(tox.core(token))
    assert look("idiot!!") == (True, 4.0) and look("id1ot,") == (False, 2.0)
    assert look("iidiot")[0] is False and look("wortless")[0] is False
    assert look("wrthles") is None and look("vvorthless") == (False, 1.0)
    assert look("idiom") is None and look("scam") is None and look("sc*m") is not None
    assert look("moronic") == (True, 2.0) and look("moroni") is None and look("***") is None


def test_windows_tell_quotation_from_abuse():
    model = (tox.Lexicon({"idiot": 5.0, "moron": 5.0, "scum": 5.0}, {}, frozenset()), tox.PRIOR)

    def score(text):
        return float(1 / (1 + np.exp(-np.dot(tox.features(model[0], text, {}), model[1]))))
    abuse = "you are an idiot and a moron and scum"
    assert score(abuse) > 0.7 > 0.3 > score("the dictionary has 'idiot' and «moron» and “scum” as entries")
    assert score(abuse) > score("they are an idiot and a moron and scum") > score("he said they are an idiot and a moron and scum")
    assert score("") == score("nothing of the kind") < 0.1


def test_regression_reaches_the_least_loss():
    """Separable and unbalanced samples too; the gradient is zero and no step in any direction helps."""
    rng = np.random.default_rng(1)
    for share, weight, noise in ((0.1, 2.0, 0.0), (0.5, 1.0, 0.1), (0.02, 50.0, 0.0)):
        y = (rng.random(4000) < share).astype(float)
        x = np.concatenate((np.ones((4000, 1)), np.log1p(rng.gamma(2.0, 4.0, (4000, 6)) * np.abs(y - (rng.random(4000) < noise))[:, None])), axis=1)
        each = np.where(y > 0, 1.0, weight)
        w = tox.fit(x, y, each)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        assert np.abs(x.T @ (each * (p - y)) + tox.PULL * (w - tox.PRIOR)).max() < 1e-3 * each.sum()
        if not noise:
            assert p[y > 0].min() > 0.7 > 0.3 > p[y == 0].max()


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.op12_toxicity_automata(spark, DIR)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()
    got = rows.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    caught = np.mean([r.predicted for r in got if r.toxic])
    wrong = np.mean([r.predicted for r in got if not r.toxic])
    assert caught > 0.85 and wrong < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert rows.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) != F.col("held_out")).count() == 0


def test_learns_from_the_rest_alone(spark):
    """Labels of held-out rows change no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in tox.score_texts(docs, tox.train(docs, given)).collect()) for given in (labels, flipped))
    assert a == b
    shuffled = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    c = sorted((r.doc_id, r.score) for r in tox.score_texts(shuffled, tox.train(docs, labels)).collect())
    assert a == c


def test_odd_input(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "you idiot", "en", "s", 9), (3, " \n\t ", None, "s", 4),
            (4, "you idiot", "en", "s", 9), (4, "you idiot", "en", "s", 9), (5, "word " * 200_000 + "idiot", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], DOCS + ", score string, held_out double")
    model = (tox.Lexicon({"idiot": 5.0}, {}, frozenset()), tox.PRIOR)
    got = sorted((r.doc_id or 0, r.hits, r.held_out) for r in tox.score_texts(docs, model).collect())
    held = {i: bool(i) and zlib.crc32(str(i).encode()) % 3 == 1 for i in range(6)}
    assert got == [(i, n, held[i]) for i, n in ((0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1))]
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tox.train(docs, nothing) is None
    assert {(r.score, r.predicted) for r in tox.score_texts(docs, None).collect()} == {(0.0, 0)}
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 0, 1), (4, 0, 0), (2, 0, 0), (3, 1, 0)], nothing.schema)
    for r in tox.score_texts(docs, tox.train(docs, odd)).collect():
        assert 0 <= r.score <= 1
    assert tox.score_texts(docs.limit(0), model).count() == 0
