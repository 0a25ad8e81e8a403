"""Quality rules: base rules plus an isolation forest over rule statistics.

Each text becomes a row of rule statistics (repetition, symbols, duplicate lines, case, word shape). A forest of random
splits over a bounded sample of the rows labelled good gives every document a mean path length; short paths are anomalies. The
score at which a document is rejected comes from all labelled rows: of the scores that keep at least ``keep_clean`` of
the rows labelled good, the one that rejects most rows labelled bad without losing more good ones than it must.

Defined results: null or empty text has no words and fails the base rule; several labels of one id count as bad if any
is; labels of unknown ids and null labels are ignored; without both kinds of label nothing but the base rules rejects;
repeated rows are judged alike; a score equal to the cut-off is rejected; texts of any length are read whole; an empty
table gives an empty result; other columns pass through ``transform`` untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import ASCII_SPACE, hash_class, map_columns, stored, with_bound

_SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
BINS = 4096

STATS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "features array<double>")


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found at least twice in the list."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered += i + size - max(i, upto)
            upto = i + size
    return covered


def text_stats(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    per_word = 1.0 / max(n, 1)
    letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    features = [
        math.log1p(50 * symbols * per_word),
        duplicates / max(len(lines), 1),
        repeats * per_word,
        chars * per_word,
        upper / max(letters, 1),
        1.0 - letters / max(chars, 1),
        len(set(words)) * per_word * math.log2(2 + n),
    ]
    return n, chars, symbols, duplicates, repeats, features


def _stats_of(ids: list, texts: list) -> dict:
    rows = [text_stats(t) for t in texts]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features")
    return {"doc_id": ids, **{name: [r[i] for r in rows] for i, name in enumerate(names)}}


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of rule statistics per document row."""
    return map_columns(docs, ["doc_id", "text"], STATS, lambda: _stats_of)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays; ``cutoff`` is the score from which a document is rejected (above 1: none)."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    depth: int
    norm: float
    cutoff: float = 2.0

    def score(self, rows: list) -> np.ndarray:
        """Anomaly score in (0, 1) of rows of features."""
        x = np.asarray(rows, dtype=float).reshape(len(rows), -1)
        if not len(x):
            return np.zeros(0)
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, value, child, length in zip(self.feature, self.value, self.child, self.length):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = child[at, (x[every, feature[at]] >= value[at]).astype(np.int64)]
            total += length[at]
        return np.exp2(-total / len(self.feature) / self.norm)


def grow_forest(sample: np.ndarray, box: np.ndarray, trees: int = 128, points: int = 256, seed: int = 11) -> Forest:
    """Isolation forest over the rows of ``sample``; each tree sees ``points`` of them.

    ``box`` holds the least and the greatest value of each feature; splits are drawn from what earlier splits left of
    it, so a rule that never fires in the sample still splits, and a row beyond the sample ends in an empty leaf early.
    """
    rng = np.random.default_rng(seed)
    sample, (lowest, highest) = np.asarray(sample, dtype=float), np.asarray(box, dtype=float)
    points = min(points, len(sample))
    depth = max(1, math.ceil(math.log2(max(points, 2)))) + 2
    parts = [[], [], [], []]
    for _ in range(trees):
        feature, value, child, length = [], [], [], []

        def node(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
            me = len(feature)
            feature.append(0), value.append(0.0), child.append((me, me)), length.append(0.0)
            open_ = np.flatnonzero(high > low) if len(rows) and level < depth else []
            if not len(open_):
                length[me] = level + float(_mean_path(len(rows)))
                return me
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            right = rows[:, f] >= cut
            left_high, right_low = high.copy(), low.copy()
            left_high[f] = right_low[f] = cut
            feature[me], value[me] = f, cut
            child[me] = (node(rows[~right], low, left_high, level + 1), node(rows[right], right_low, high, level + 1))
            return me

        node(sample[rng.choice(len(sample), points, replace=False)], lowest, highest, 0)
        for part, got in zip(parts, (feature, value, child, length)):
            part.append(np.asarray(got))
    return Forest(*parts, depth=depth, norm=max(float(_mean_path(points)), 1e-9))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, keep_clean: float) -> float:
    """Cut-off from histograms of the scores of good and bad labelled rows; 2.0 where one kind is missing."""
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1] / good.sum()  # share of good rows with a score of this bin or above
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    worth = np.where(lost <= 1 - keep_clean, caught - 10 * lost, -np.inf)
    at = int(np.flatnonzero(worth == worth.max())[-1])
    return 2.0 if worth[at] <= 0 else at / len(good)


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 16384, keep_clean: float = 0.998) -> Forest:
    """Forest over about ``sample_rows`` labelled rows (bounded, chosen by hash), cut-off from all labelled rows."""
    judged = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id")).agg(F.min("quality").alias("_quality")))
    rows = stored(stats.where(~base_failed()).select("doc_id", "features").join(judged, "doc_id"), "quality-labelled")
    n = rows.count()
    if not n:
        return Forest([], [], [], [], 0, 1.0)
    sample = sorted(rows.where(hash_class("doc_id") < with_bound(n, sample_rows)).collect(),
                    key=lambda r: (r["doc_id"], r["features"]))
    clean = [r["features"] for r in sample if r["_quality"] > 0]
    if not clean:
        return Forest([], [], [], [], 0, 1.0)
    every = np.array([r["features"] for r in sample])
    forest = grow_forest(np.array(clean), np.array([every.min(0), every.max(0)]))

    def start():
        return lambda features, quality: {"bin": np.minimum(forest.score(features) * BINS, BINS - 1).astype(int).tolist(),
                                          "quality": quality}

    hist = np.zeros((2, BINS))
    scored = map_columns(rows, ["features", "_quality"], "bin int, quality int", start)
    for r in scored.groupBy("bin", "quality").count().collect():  # at most 2 * BINS rows
        hist[1 if r["quality"] > 0 else 0, r["bin"]] += r["count"]
    forest.cutoff = choose_cutoff(hist[1], hist[0], keep_clean)
    return forest


def _verdicts(model: Forest, rows: list[tuple]) -> tuple[list, list, list]:
    failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows]
    score = model.score([r[5] for r in rows]).tolist() if len(model.feature) and rows else [0.0] * len(rows)
    return failed, score, [not f and int(s * BINS) / BINS < model.cutoff for f, s in zip(failed, score)]


def judge(stats: DataFrame, model: Forest) -> DataFrame:
    """Verdict of every row of statistics."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def start():
        def run(ids, *columns):
            failed, score, kept = _verdicts(model, list(zip(*columns)))
            return {"doc_id": ids, **dict(zip(names, columns)), "base_failed": failed, "anomaly": score, "kept": kept}
        return run

    return map_columns(stats, ["doc_id", *names, "features"],
                       "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                       "n_repeat_words long, base_failed boolean, anomaly double, kept boolean", start)


def assess(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, anomaly score and verdict of every document row."""
    stats = stored(rule_statistics(docs), "quality-stats")
    return judge(stats, fit(stats, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, all columns as they are."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id").distinct()
    model = fit(rule_statistics(docs.select("doc_id", "text").join(known, "doc_id", "left_semi")), labels, **options)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd
        return pd.Series(_verdicts(model, [text_stats(t) for t in texts])[2], dtype=bool)

    return docs.where(good("text"))


def op4_quality_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
