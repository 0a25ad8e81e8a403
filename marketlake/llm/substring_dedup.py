"""Substring de-duplication by seed and extend.

Seeds are winnowed anchors: of the 8-word grams of any ``SPAN`` consecutive words the one with the least hash (the last
of equals) is selected, so two documents that share ``SPAN`` words select the same gram at the same place of them. A
document keeps one row per anchor: the run of windows that the anchor governs, and a hash of all words they cover.

Documents are joined on the anchors. Where the covered words agree with those of an earlier document, the seed extends
over the whole run. Elsewhere it is extended both ways, from the anchor to each of its windows: window hashes are
compared among the first holders of each differing context of that anchor, one row a window, so that neither copies nor
passages held by many documents are ever paired. Windows found in an earlier document are merged to maximal repeats and
their words removed.

Defined results: null text has no words; texts of fewer than ``SPAN`` words lose none; rows of the same id never remove
words from each other; a row with a null id neither loses words nor removes any; repeated rows are cut alike; texts of
any length are cut into words whole; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import drop_stored, map_columns, stored, text_key

SPAN = 50
GRAM = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """Hashes of word runs of one text; equal runs have equal hashes wherever they stand."""

    def __init__(self, words: list[bytes], cache: dict) -> None:
        digest = xxhash.xxh3_64_intdigest
        if len(cache) > 500_000:
            cache.clear()
        h = []
        for w in words:
            x = cache.get(w)
            if x is None:
                x = cache[w] = digest(w)
            h.append(x)
        n = len(h)
        each = np.array(h, dtype=np.uint64)
        self.back = _powers(n, pow(_BASE, -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * _powers(n, _BASE)[:n], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for arrays of positions."""
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(hashes: WordHashes, n: int, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window) of every run of windows that select the same anchor."""
    at = np.arange(n - gram + 1)
    h = hashes.runs(at, at + gram)
    width = span - gram + 1
    best, have = at, 1  # last least gram of the `have` grams from each position on
    while have < width:
        step = min(have, width - have)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(h[b] <= h[a], b, a)
        have += step
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.concatenate((first[1:], [len(best)])) - 1
    return best[first], first, last


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _anchor_rows(span: int):
    def start():
        cache: dict = {}

        def run(ids, keys, texts):
            out = {k: [] for k in ("doc_id", "k", "h", "c", "p", "s", "e")}
            for doc_id, key, text in zip(ids, keys, texts):
                words = word_list(text)
                if doc_id is None or len(words) < span:
                    continue
                hashes = WordHashes(words, cache)
                p, s, e = anchors(hashes, len(words), span)
                out["doc_id"] += [doc_id] * len(p)
                out["k"] += [key] * len(p)
                out["h"] += _signed(hashes.runs(p, p + GRAM))
                # the place of the anchor in its run is part of the context
                out["c"] += _signed(_mixed(hashes.runs(s, e + span) ^ (p - s).astype(np.uint64)))
                out["p"] += p.tolist()
                out["s"] += s.tolist()
                out["e"] += e.tolist()
            return out
        return run
    return start


def _window_rows(span: int):
    def start():
        cache: dict = {}

        def run(ids, keys, texts, runs):
            out = {k: [] for k in ("doc_id", "k", "h", "w", "s")}
            for doc_id, key, text, some in zip(ids, keys, texts, runs):
                words = word_list(text)
                hashes = WordHashes(words, cache)
                for r in some:
                    s = np.arange(r["s"], r["e"] + 1)
                    out["doc_id"] += [doc_id] * len(s)
                    out["k"] += [key] * len(s)
                    out["h"] += [r["h"]] * len(s)
                    out["w"] += _signed(_mixed(hashes.runs(s, s + span) ^ (r["p"] - s).astype(np.uint64)))
                    out["s"] += s.tolist()
            return out
        return run
    return start


def repeated_runs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, k, s, e): runs of windows s..e that also start in a document with a smaller id."""
    table = stored(map_columns(docs, ["doc_id", "k", "text"], "doc_id long, k long, h long, c long, p int, s int, e int",
                               _anchor_rows(span)), "anchors")
    contexts = table.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = (contexts.groupBy("h").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.count("*").alias("n"))
              .where(F.col("f") < F.col("l")).select("h", "n"))
    shared = stored(shared, "anchors-shared")
    known = stored(contexts.join(shared, "h").select("h", "c", "first", "n"), "anchor-contexts")
    met = stored(table.join(known, ["h", "c"]).where((F.col("doc_id") > F.col("first")) | (F.col("n") > 1)), "anchors-met")
    drop_stored(table)
    # the first holders of differing contexts: extended window by window
    open_ = (met.where((F.col("doc_id") == F.col("first")) & (F.col("n") > 1)).groupBy("doc_id", "k")
             .agg(F.collect_list(F.struct("h", "p", "s", "e")).alias("runs")))
    open_ = open_.withColumnRenamed("doc_id", "o_id").withColumnRenamed("k", "o_k")
    texts = docs.join(open_.hint("merge"), (F.col("doc_id") == F.col("o_id")) & (F.col("k") == F.col("o_k")))
    windows = stored(map_columns(texts, ["doc_id", "k", "text", "runs"], "doc_id long, k long, h long, w long, s int",
                                 _window_rows(span)), "windows")
    first = stored(windows.groupBy("h", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .where(F.col("first") < F.col("last")).select("h", "w", "first"), "windows-shared")
    single = (windows.join(first, ["h", "w"]).where(F.col("doc_id") > F.col("first"))
              .select("doc_id", "k", "s", F.col("s").alias("e")))
    whole = met.where(F.col("doc_id") > F.col("first")).select("doc_id", "k", "s", "e")
    return whole.unionByName(single)


def _merged(runs: list, span: int) -> list[tuple[int, int]]:
    """Maximal repeats, as word ranges, of runs of windows."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"] + span) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept) of every row: word ranges removed, words kept joined by one space."""
    keyed = docs.select("doc_id", text_key().alias("k"), "text")
    runs = (repeated_runs(keyed, span).groupBy("doc_id", "k").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
            .select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "runs"))
    joined = keyed.join(runs.hint("merge"), (F.col("doc_id") == F.col("r_id")) & (F.col("k") == F.col("r_k")), "left")

    def start():
        def run(ids, texts, found):
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "repeats", "kept")}
            for doc_id, text, some in zip(ids, texts, found):
                words = word_list(text)
                repeats, left, at = _merged(some, span), [], 0
                for s, e in repeats:
                    left += words[at:s]
                    at = e
                left += words[at:]
                row = (doc_id, len(words), len(words) - len(left), [{"start": s, "end": e} for s, e in repeats],
                       b" ".join(left).decode("utf-8", "surrogatepass"))
                for k, v in zip(out, row):
                    out[k].append(v)
            return out
        return run

    return map_columns(joined, ["doc_id", "text", "runs"], "doc_id long, n_words long, n_removed long, "
                       "repeats array<struct<start:int,end:int>>, kept string", start)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
