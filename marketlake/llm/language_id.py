"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

The subwords of a text are its letter n-grams (one to four letters of the lower-cased text, with a space wherever other
characters stand), hashed into ``BUCKETS`` embeddings; their mean feeds a linear softmax. Embeddings and weights are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE`` in all, dealt evenly
over the languages, whole texts). A quarter of the sample is set aside to fit the temperature of the softmax and the
score below which a prediction is rejected: the least one above which at least ``ACCURACY`` of the predictions are right.

As the model is linear, a prediction needs one table of logits per bucket. Rows held out (crc32 of the id modulo 4 is 2)
are never learned from, nor are rows without id or language; id, language and source are no inputs of a prediction.

Defined results: null text and text without a letter give ``und`` with score 0, accepted; without labelled rows every
text does; repeated rows are predicted alike; of equal scores the language first in the alphabet is taken; a text of any
length is counted whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import hash_class, map_columns

BUCKETS = 1 << 14
WIDTH = 16
SAMPLE = 3000
ACCURACY = 0.99
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER = None


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER[codes]


def subword_counts(text: str | None) -> np.ndarray | None:
    """Occurrences of every bucket, or None if the text has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(codes)
    if not letter.any():
        return None
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]  # runs of spaces become one
    total = np.zeros(BUCKETS, dtype=np.int64)
    grams = np.zeros(len(codes), dtype=np.uint64)
    for order in ORDERS:
        if len(codes) < order:
            break
        grams = grams[:len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1:]
        mixed = (grams + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        z = (counts @ self.logits / counts.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 2.0, seed: int = 3) -> Model:
    """Model from (buckets, weights that add up to 1, language) rows."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[2] for r in rows})
    order = rng.permutation(len(rows))
    aside, learn = order[:len(rows) // 4], order[len(rows) // 4:]
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    number = {x: i for i, x in enumerate(languages)}
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(learn):
            buckets, share, language = rows[i]
            mean = share @ table[buckets]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[language]] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            table[buckets] -= step * np.outer(share, back)
    model = Model(languages, table @ weights, bias)
    if len(aside):
        _calibrate(model, [rows[i] for i in aside])
    return model


def _calibrate(model: Model, rows: list[tuple]) -> None:
    z = np.array([share @ model.logits[buckets] + model.bias for buckets, share, _ in rows])
    truth = np.array([model.languages.index(r[2]) for r in rows])

    def loss(t: float) -> float:
        y = z / t
        y = y - y.max(1, keepdims=True)
        return float((np.log(np.exp(y).sum(1)) - y[np.arange(len(y)), truth]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss)
    y = z / model.temperature
    p = np.exp(y - y.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = np.argsort(-p.max(1))
    right = (p.argmax(1) == truth)[best].cumsum() / np.arange(1, len(best) + 1)
    good = np.flatnonzero(right >= ACCURACY)
    model.reject_below = float(p.max(1)[best[good[-1]]]) if len(good) else 1.0


def _packed(ids: list, texts: list, languages: list) -> dict:
    out = []
    for text in texts:
        counts = subword_counts(text)
        if counts is None:
            out.append(None)
            continue
        buckets = np.flatnonzero(counts)
        out.append(buckets.astype("<u2").tobytes() + (counts[buckets] / counts.sum()).astype("<f4").tobytes())
    return {"doc_id": ids, "features": out, "lang": languages}


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from at most about ``sample`` labelled rows of ``docs`` that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    keep = F.lit(1_000_000)
    for language, n in counts.items():
        keep = F.when(F.col("lang") == language, F.lit(min(1_000_000, max(1, each * 1_000_000 // n)))).otherwise(keep)
    rows = map_columns(labelled.where(hash_class("doc_id") < keep), ["doc_id", "text", "lang"],
                       "doc_id long, features binary, lang string", lambda: _packed).where("features is not null")
    got = sorted(((r["doc_id"], bytes(r["features"]), r["lang"]) for r in rows.collect()))
    unpacked = []
    for _, raw, language in got:
        n = len(raw) // 6
        unpacked.append((np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<f4", n, 2 * n).astype(float),
                         language))
    return train(unpacked) if unpacked else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row of ``docs``."""
    def start():
        def run(ids, held, texts):
            found = []
            for text in texts:
                counts = subword_counts(text) if model else None
                found.append((UNDETERMINED, 0.0, True) if counts is None else (
                    *(p := model.predict(counts)), p[1] >= model.reject_below))
            names = ("lang_pred", "score", "accepted")
            return {"doc_id": ids, "held_out": held, **{n: [f[i] for f in found] for i, n in enumerate(names)}}
        return run

    return map_columns(docs.select("doc_id", held_out().alias("held_out"), "text"), ["doc_id", "held_out", "text"],
                       "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean", start)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
