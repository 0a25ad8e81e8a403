"""Best-fit packing through the configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens; only their histogram (at most ``capacity`` lengths) leaves
Spark. The configuration LP covers every length with patterns, multisets of lengths of at most ``capacity`` tokens,
using as few as possible. Multiplicative weights solve it: each length has a price that starts in proportion to the
length and falls exponentially with the share of its demand that patterns have covered, so badly covered lengths grow
dear. Knapsack dynamic programming prices the patterns; a round takes many that are best or nearly so, each in an amount
that covers at most ``STEP`` of a length's demand, and patterns are averaged over windows of rounds. The prices give a
lower bound (their value of the demand, over that of the best pattern). After each window the average is rounded to
whole patterns, what that leaves of the histogram is packed best-fit decreasing, and the sequences are compared with the
bound: the work ends when they are within ``GAP`` of it (or equal it, rounded up), at the latest after ``ROUNDS``.

The plan, patterns with multiplicities, is bounded by the capacity, not by the corpus, and reaches the tasks in their
closure. Pieces are ranked within their length in blocks of about ``BLOCK`` (a length held by a third of all rows is
ranked by many tasks), and each rank is looked up in the plan.

Token ids are those of ``tokenizers``; texts in an alphabet where the equal vocabulary of ``tiktoken`` gives the same
ids go through that, being four times as fast, all other texts through ``tokenizers`` itself.

Defined results: null and empty text is one piece, the end id alone; a null ``doc_id`` is packed like any other; repeated
rows are packed once each; a text of any length is encoded whole and cut into pieces; ties of pieces of one length are
in the order of id, piece, ids and start; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import map_columns, stored

CAPACITY = 2048
BLOCK = 2048
SPAN = 4096
STEP = 0.25
GAP = 0.0001
ROUNDS = 400
END_ID = 0

#: Characters on which both libraries agree what a letter, a digit and white space are.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ʯͰ-ͷͺ-Ϳ΄-ϿЀ-ҁҊ-ԯ"
                    r"‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(json_file: str, rank_file: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(public_tokenizers.path(rank_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(json_file)), fast


def token_ids(text: str | None, exact, fast) -> list[int]:
    """Ids of a whole text as ``tokenizers`` gives them, without special tokens added."""
    if not text:
        return []
    if _SPECIAL not in text and _PLAIN.fullmatch(text):
        return fast.encode_ordinary(text)
    return exact.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all are full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_file: str = "byte_bpe_50k.json",
           rank_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document row."""
    def start():
        exact, fast = _encoders(json_file, rank_file)

        def run(ids, texts):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(ids, texts):
                tokens = np.array([*token_ids(text, exact, fast), END_ID], dtype="<u4")
                for piece, (at, n) in enumerate(cut(len(tokens), capacity)):
                    for k, v in zip(out, (doc_id, piece, at, n, crc32(tokens[at:at + n].tobytes()))):
                        out[k].append(v)
            return out
        return run

    return map_columns(docs, ["doc_id", "text"],
                       "doc_id long, piece int, start long, length long, ids_crc32 long", start)


def _priced(prices: np.ndarray, mass: np.ndarray, lengths: np.ndarray, capacity: int, slack: float,
            rng: np.random.Generator, ways: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greatest price within every room, and ``ways`` indices (into ``lengths``) of a last piece that reach it.

    Unbounded knapsack. Pieces that lose at most ``slack`` of their price count as reaching it and are drawn in
    proportion to ``mass``; -1 where a smaller room does as well.
    """
    best = np.zeros(capacity + 1)
    picks = np.full((capacity + 1, ways), -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    drawn = rng.random((capacity + 1, ways))
    for c in range(int(lengths[0]), capacity + 1):
        price = prices[:fits[c]]
        value = best[c - lengths[:fits[c]]] + price
        best[c] = max(best[c - 1], value.max())
        near = np.flatnonzero(value >= best[c] - slack * price)
        if len(near):
            total = mass[near].cumsum()
            picks[c] = near[np.searchsorted(total, drawn[c] * total[-1], side="right").clip(max=len(near) - 1)]
    return best, picks


def fractional_plans(histogram: dict[int, int], capacity: int = CAPACITY, slack: float = 0.0005):
    """Per window of rounds: patterns (length, copies) with averaged multiplicities, and the lower bound so far.

    The first window moves the prices little, which is enough where sequences can be filled to the brim; the later ones
    move them fast at first and ever slower, each starting its average anew.
    """
    rng = np.random.default_rng(0)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    sizes = lengths.tolist()
    log_price, rate, window, bound, done = np.zeros(len(lengths)), slack / STEP, 64, 0.0, 0
    later = 1.0
    while done < ROUNDS:
        covered, mean_price = np.zeros(len(lengths)), np.zeros(len(lengths))
        amounts: dict[tuple, float] = {}
        for _ in range(window):
            prices = lengths / capacity * np.exp(log_price - log_price.max())
            lag = np.exp(-8 * (covered - covered.min()))
            best, picks = _priced(prices, demand * lengths * lag + 1e-300, lengths, capacity, slack, rng)
            bound = max(bound, float(demand @ prices) / best[-1])
            mean_price += prices / best[-1]
            filled = np.maximum.accumulate(np.where(picks[:, 0] >= 0, np.arange(capacity + 1), 0)).tolist()
            good = np.flatnonzero(prices + best[capacity - lengths] >= (1 - 2 * slack) * best[-1])
            good = good[np.argsort(covered[good], kind="stable")].tolist()
            room, last = (STEP * demand).tolist(), picks.tolist()
            for way in range(2):
                for k in good:
                    if room[k] <= 1e-9:
                        continue
                    pattern, c = {k: 1}, filled[capacity - sizes[k]]
                    while c > 0:
                        piece = last[c][(way + len(pattern)) % len(last[c])]
                        pattern[piece] = pattern.get(piece, 0) + 1
                        c = filled[c - sizes[piece]]
                    amount = min(room[i] / n for i, n in pattern.items())
                    if amount > 1e-9:
                        for i, n in pattern.items():
                            room[i] -= n * amount
                        key = tuple(sorted((sizes[i], n) for i, n in pattern.items()))
                        amounts[key] = amounts.get(key, 0.0) + amount
            took = STEP - np.array(room) / demand
            covered += took
            log_price -= rate * took
        bound = max(bound, float(demand @ mean_price) / _priced(mean_price, demand, lengths, capacity, 0.0, rng)[0][-1])
        done += window
        mass = demand * lengths
        for share in {float(covered.min()), float(covered @ mass / mass.sum())} - {0.0}:
            yield [(key, n / share) for key, n in amounts.items()], bound
        rate, later, window = later, later / 2, min(int(window * 1.5), max(1, ROUNDS - done))


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple, int]:
    """Patterns (sorted tuple of lengths) with counts; equal bins are filled together."""
    free: dict[int, dict[tuple, int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                fit = capacity // length
                full, some = divmod(left, fit)
                for n, k in ((full, fit), (some > 0, some)):
                    if n:
                        bins = free.setdefault(capacity - k * length, {})
                        key = (length,) * k
                        bins[key] = bins.get(key, 0) + int(n)
                break
            key, n = next(iter(free[room].items()))
            take = min(n, left)
            if take == n:
                del free[room][key]
                if not free[room]:
                    del free[room]
            else:
                free[room][key] = n - take
            bins = free.setdefault(room - length, {})
            new = (*key, length)
            bins[new] = bins.get(new, 0) + take
            left -= take
    out: dict[tuple, int] = {}
    for bins in free.values():
        for key, n in bins.items():
            out[key] = out.get(key, 0) + n
    return out


def rounded(patterns: list[tuple[tuple, float]], histogram: dict[int, int], capacity: int = CAPACITY,
            carried: bool = True) -> dict[tuple, int]:
    """Whole patterns (sorted tuple of lengths) with counts that hold every piece of the histogram exactly once.

    Fractions are ``carried`` over the patterns, or left to the best-fit decreasing end, which then has more to choose
    from.
    """
    rest = dict(histogram)
    whole: dict[tuple, int] = {}
    carry = 0.0
    for pattern, amount in sorted(patterns, key=lambda x: (-x[1], x[0])):
        carry += amount
        n = min([int(carry + 1e-9), *(rest[length] // copies for length, copies in pattern)])
        carry = min(carry - n, 1.0) if carried else 0.0
        if n > 0:
            key = tuple(length for length, copies in reversed(pattern) for _ in range(copies))
            whole[key] = whole.get(key, 0) + n
            for length, copies in pattern:
                rest[length] -= n * copies
    for key, n in best_fit_decreasing({k: v for k, v in rest.items() if v}, capacity).items():
        whole[key] = whole.get(key, 0) + n
    return whole


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Whole patterns with counts that hold every piece of the histogram exactly once."""
    if not histogram:
        return []
    least, whole = None, {}
    for patterns, bound in fractional_plans(histogram, capacity):
        for carried in (True, False):
            found = rounded(patterns, histogram, capacity, carried)
            if least is None or sum(found.values()) < least:
                least, whole = sum(found.values()), found
        if least <= max((1 + GAP) * bound, np.ceil(bound - 1e-6)):
            break
    return sorted(whole.items())


class Slots:
    """Where the rank-th piece of a length goes."""

    def __init__(self, patterns: list[tuple[tuple, int]]) -> None:
        rows, base = [], 0
        for key, n in patterns:
            offset = 0
            for length in sorted(set(key), reverse=True):
                copies = key.count(length)
                rows.append((length, n * copies, copies, base, offset))
                offset += copies * length
            base += n
        rows.sort()
        self.rows = np.array(rows, dtype=np.int64).reshape(-1, 5)
        before = np.cumsum(self.rows[:, 1]) - self.rows[:, 1]
        starts = np.searchsorted(self.rows[:, 0], self.rows[:, 0])
        self.before = before  # pieces of all rows above
        self.base = dict(zip(self.rows[:, 0].tolist(), before[starts].tolist()))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank within the length."""
        at = np.array([self.base[x] for x in lengths.tolist()], dtype=np.int64) + ranks
        row = np.searchsorted(self.before, at, side="right") - 1
        length, _, copies, base, offset = self.rows[row].T
        k = at - self.before[row]
        return base + k // copies, offset + k % copies * length


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` of pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    table = stored(table, "packing-pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = Slots(plan(histogram, capacity))
    # ranks: blocks of a length by hash, their bases from the block counts
    blocks = {k: max(1, -(-v // BLOCK)) for k, v in histogram.items()}
    many = F.create_map(*(F.lit(x) for k, v in blocks.items() if v > 1 for x in (k, v))) if max(
        blocks.values(), default=1) > 1 else None
    number = F.lit(1) if many is None else F.coalesce(many[F.col("length")], F.lit(1))
    order = ["doc_id", "piece", "ids_crc32", "start"]
    table = table.withColumn("block", F.pmod(F.xxhash64(*order), number).cast("int"))
    counts = table.groupBy("length", "block").count()
    # prefix sums within ranges of blocks, then over the ranges: no task holds all blocks of a length
    counts = stored(counts.withColumn("span", F.floor(F.col("block") / SPAN)), "packing-counts")
    inner = Window.partitionBy("length", "span").orderBy("block")
    outer = Window.partitionBy("length").orderBy("span")
    spans = counts.groupBy("length", "span").agg(F.sum("count").alias("n"))
    spans = spans.select("length", "span", (F.sum("n").over(outer) - F.col("n")).alias("above"))
    bases = stored(counts.withColumn("base", F.sum("count").over(inner) - F.col("count")).join(spans, ["length", "span"])
                   .select("length", "block", (F.col("base") + F.col("above")).alias("base")), "packing-blocks")
    ranked = table.withColumn("r", F.row_number().over(Window.partitionBy("length", "block").orderBy(*order)) - 1)
    ranked = ranked.join(bases, ["length", "block"]).withColumn("rank", F.col("r") + F.col("base"))

    def start():
        def run(*columns):
            sequence, offset = slots.place(np.array(columns[3], dtype=np.int64), np.array(columns[5], dtype=np.int64))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return {**dict(zip(names, columns)), "sequence_id": sequence.tolist(), "offset": offset.tolist()}
        return run

    return map_columns(ranked, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                       "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
                       start)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, capacity), capacity)


def op10_config_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
