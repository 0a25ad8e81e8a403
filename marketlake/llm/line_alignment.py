"""Line de-duplication by pairwise alignment.

Every non-blank line becomes a row (hash, occurrence within its document). The first document that holds a line is a
partner of all later holders. A line is also compared with the partners of the nearest rare lines before and after it in
its document (rare: of ``min_words`` words, and held at most ``RARE`` times as often as the rarest such line that the
document shares), so a short or frequent line of a copy meets the copied document, not only its own first holder. Each
line has three partners at most, so pairs grow with the lines, however many documents share one. The matched lines of a
pair are aligned as patience diff does: lines that occur once in both documents and are rare among those the pair
shares anchor a longest increasing sequence, and the gaps between anchors are aligned with what else matches (the whole
pair, where nothing anchors). Maximal runs of aligned neighbours with at least ``min_words`` words together are common
blocks, deleted from the later document. A line's first holder never loses it, so one copy of everything stays.

A line that stands in another order than in its partners, whose neighbours another document holds, or that its document
repeats more often than its partners, does not align. ``rest`` finds these exactly, among all earlier documents: of
every document's lines that alignment left, the shortest windows of ``min_words`` words that start or end at a line are
looked up among the first holders of all such windows, and go where an earlier document holds the same consecutive
lines. Every common block of ``min_words`` words is a union of such windows, so no block that any earlier document holds
stays, in whatever order and however often, and rows grow with the lines.

Rarity is relative to the pair (at most ``RARE`` times the lowest frequency among its anchors), hence no line is
ignored for being frequent. Documents are ordered by (doc_id, hash of the text).

Defined results: null text stays null; a null ``doc_id`` neither matches nor loses lines; rows that repeat id and text
are one document (only a line's frequency counts each); of equally long alignments the one whose matches come last is taken; blank lines (ASCII white space only) are kept and never match; lines are compared without the white
space at their ends; a text of any length is a row per line, and one document's lines are aligned in one task; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import ASCII_SPACE, map_columns, stored, text_key

RARE = 4
MIN_WORDS = 5
END = 2**31 - 1


def windows(words: list[int], min_words: int = MIN_WORDS) -> tuple[list[int], list[int]]:
    """Shortest windows of ``min_words`` words: the end of the one that starts at each line, the start of the one that
    ends there; -1 where there is none."""
    ends, starts, total, i = [-1] * len(words), [], 0, 0
    for j, n in enumerate(words):
        total += n
        while total - words[i] >= min_words:
            ends[i] = j if ends[i] < 0 else ends[i]
            total -= words[i]
            i += 1
        if total >= min_words and ends[i] < 0:
            ends[i] = j
        starts.append(i if total >= min_words else -1)
    return ends, starts


def window_hash(hashes: list[int]) -> int:
    """Hash of the hashes of consecutive lines."""
    h = xxhash.xxh3_64_intdigest(struct.pack(f"<{len(hashes)}q", *hashes))
    return h - (h >> 63 << 64)


def line_rows(ids: list, keys: list, texts: list) -> dict:
    """One row per non-blank line: line number, rank among the non-blank lines, hash, words, occurrence, repeats, and the
    hashes of the windows that start and end there (the latter null if it is one that starts at its first line)."""
    out = {k: [] for k in ("doc_id", "k", "line", "rank", "h", "words", "occ", "reps", "from_here", "to_here")}
    for doc_id, key, text in zip(ids, keys, texts):
        if text is None or doc_id is None:
            continue
        seen: Counter = Counter()
        first = len(out["h"])
        for number, line in enumerate(text.split("\n")):
            line = line.strip(ASCII_SPACE).encode("utf-8", "surrogatepass")
            if not line:
                continue
            h = xxhash.xxh3_64_intdigest(line)
            h -= (h >> 63) << 64
            out["occ"].append(seen[h])
            seen[h] += 1
            out["doc_id"].append(doc_id), out["k"].append(key), out["line"].append(number)
            out["rank"].append(len(out["h"]) - first), out["h"].append(h), out["words"].append(len(line.split()))
        out["reps"].extend(seen[h] for h in out["h"][first:])
        held = out["h"][first:]
        ends, starts = windows(out["words"][first:])
        out["from_here"].extend(window_hash(held[i:j + 1]) if j >= 0 else None for i, j in enumerate(ends))
        out["to_here"].extend(window_hash(held[i:j + 1]) if i >= 0 and ends[i] != j else None for j, i in enumerate(starts))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first part, that also increases in the second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        j = bisect_left(tails, y)
        back.append(at[j - 1] if j else -1)
        if j == len(tails):
            tails.append(y), at.append(i)
        else:
            tails[j], at[j] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_blocks(matches: list[tuple], min_words: int = MIN_WORDS) -> list[list[int]]:
    """Blocks of aligned ranks of one pair; a match is (rank, rank in the earlier, words, unique in both, frequency)."""
    matches = sorted(matches)
    words = {m[0]: m[2] for m in matches}
    strong = [m for m in matches if m[3] and m[2] >= min_words]
    rarest = min((m[4] for m in strong), default=0)
    anchors = increasing([(m[0], m[1]) for m in strong if m[4] <= RARE * rarest])
    pairs = [(m[0], m[1]) for m in matches]
    aligned, i = [], 0
    for low, high in zip([(-1, -1), *anchors], [*anchors, (END, END)]):
        gap = []
        while i < len(pairs) and pairs[i][0] < high[0]:
            if low[0] < pairs[i][0] and low[1] < pairs[i][1] < high[1]:
                gap.append(pairs[i])
            i += 1
        aligned += increasing(gap)
        if high[0] != END:
            aligned.append(high)
            i += 1
    blocks: list[list[int]] = []
    last = (-2, -2)
    for x, y in aligned:
        if (x, y) == (last[0] + 1, last[1] + 1):
            blocks[-1].append(x)
        else:
            blocks.append([x])
        last = (x, y)
    return [b for b in blocks if sum(words[x] for x in b) >= min_words]


def _left_windows(left: set, matches: dict) -> list[dict]:
    """Windows of consecutive shared lines that hold one of ``left``; ``matches``: a match by its rank, ascending."""
    out, run = [], []
    for x in [*matches, END]:
        if run and x != run[-1] + 1:
            ends, starts = windows([matches[r]["words"] for r in run])
            for i, j in {*enumerate(ends), *((i, j) for j, i in enumerate(starts))}:
                if i >= 0 and j >= 0 and not left.isdisjoint(run[i:j + 1]):
                    held = [matches[r] for r in run[i:j + 1]]
                    out.append({"w": window_hash([m["h"] for m in held]), "lines": [m["line"] for m in held]})
            run = []
        run.append(x)
    return out


def _aligned(ids: list, keys: list, found: list) -> dict:
    """Lines of each document that go by its matches with its partners, and the windows around shared lines that stay."""
    out, rest = [], []
    for matches in found:
        shared, by_pair = {}, defaultdict(list)
        for m in sorted(matches, key=lambda m: m["rank"]):
            shared[m["rank"]] = m
            if m["e_id"] is not None:
                by_pair[m["e_id"], m["e_k"]].append((m["rank"], m["e_rank"], m["words"], m["single"], m["df"]))
        gone = {x for pair in by_pair.values() for block in common_blocks(pair) for x in block}
        out.append([shared[x]["line"] for x in gone]), rest.append(_left_windows(shared.keys() - gone, shared))
    return {"doc_id": ids, "k": keys, "gone": out, "rest": rest}


def _kept_ranges(ids: list, keys: list, gone: list) -> dict:
    """Kept line ranges of each document, from the lines that go."""
    kept = []
    for lines in gone:
        ranges, at = [], 0
        for n in [*sorted(lines), END]:
            if n > at:
                ranges.append({"start": at + 1, "size": n - at})
            at = n + 1
        kept.append(ranges)
    return {"doc_id": ids, "k": keys, "kept": kept, "n_removed": [len(x) for x in gone]}


def unaligned(aligned: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, k, more) of documents with windows of ``rest`` that an earlier document holds, ``more`` their lines."""
    rest = aligned.select("doc_id", "k", F.explode("rest").alias("r")).select("doc_id", "k", "r.w", "r.lines")
    document = F.struct("doc_id", "k")
    first = (lines.select("doc_id", "k", F.explode(F.array_compact(F.array("from_here", "to_here"))).alias("w"))
             .groupBy("w").agg(F.min(document).alias("e"), F.max(document).alias("last"))
             .where((F.col("e.doc_id") != F.col("last.doc_id")) | (F.col("e.k") != F.col("last.k"))))
    return (rest.join(first, "w").where(F.col("e") < document)
            .groupBy("doc_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("more")))


def removals(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(doc_id, k, kept, n_removed) of every document that loses lines; ``docs`` has doc_id, k and text."""
    lines = stored(map_columns(docs, ["doc_id", "k", "text"], "doc_id long, k long, line int, rank int, h long, "
                               "words int, occ int, reps int, from_here long, to_here long", lambda: line_rows), "lines")
    first = (lines.groupBy("h", "occ")
             .agg(F.min(F.struct("doc_id", "k", "rank", "reps")).alias("e"), F.max(F.struct("doc_id", "k")).alias("last"),
                  F.count("*").cast("long").alias("df"))
             .where((F.col("e.doc_id") != F.col("last.doc_id")) | (F.col("e.k") != F.col("last.k")))
             .select("h", "occ", F.col("e.doc_id").alias("e_id"), F.col("e.k").alias("e_k"),
                     F.col("e.rank").alias("e_rank"), F.col("e.reps").alias("e_reps"), "df"))
    first = stored(first, "line-firsts")
    own = (lines.drop("from_here", "to_here").join(first, ["h", "occ"])
           .where((F.col("doc_id") != F.col("e_id")) | (F.col("k") != F.col("e_k")))
           .dropDuplicates(["doc_id", "k", "rank"]))
    own = stored(own, "line-own")
    document = Window.partitionBy("doc_id", "k")
    strong = F.col("words") >= MIN_WORDS
    rare = strong & (F.col("df") <= RARE * F.min(F.when(strong, F.col("df"))).over(document))
    partner = F.struct("e_id", "e_k")
    seen = own.withColumn("partner", F.when(rare, partner))
    before, after = (F.last("partner", ignorenulls=True).over(document.orderBy(o).rowsBetween(Window.unboundedPreceding, -1))
                     for o in (F.asc("rank"), F.desc("rank")))
    others = F.filter(F.array_distinct(F.array("before", "after")),
                      lambda p: p.isNotNull() & (p != F.struct("e_id", "e_k")))
    near = (seen.withColumn("before", before).withColumn("after", after).select(
                "doc_id", "k", "line", "rank", "h", "words", "occ", "reps", "df", F.explode(others).alias("p"))
            .select("*", F.col("p.e_id").alias("e_id"), F.col("p.e_k").alias("e_k")).drop("p"))
    theirs = (lines.select(F.col("doc_id").alias("e_id"), F.col("k").alias("e_k"), "h", "occ", F.col("rank").alias("e_rank"),
                           F.col("reps").alias("e_reps")).dropDuplicates(["e_id", "e_k", "h", "occ"]))
    near = near.join(theirs, ["e_id", "e_k", "h", "occ"])
    matched = own.unionByName(near.select(*own.columns))
    if rest:  # lines that an earlier document holds less often: no partner, but part of windows
        often = (lines.where("occ > 0").drop("from_here", "to_here").join(first.where("occ = 0").drop("occ"), "h")
                 .where((F.col("doc_id") != F.col("e_id")) | (F.col("k") != F.col("e_k")))
                 .withColumn("e_id", F.lit(None).cast("long")).dropDuplicates(["doc_id", "k", "rank"]))
        matched = matched.unionByName(often.select(*own.columns))
    match = F.struct("line", "rank", "h", "words", "e_id", "e_k", "e_rank", "df",
                     ((F.col("reps") == 1) & (F.col("e_reps") == 1)).alias("single"))
    grouped = matched.groupBy("doc_id", "k").agg(F.collect_list(match).alias("found"))
    gone = map_columns(grouped, ["doc_id", "k", "found"], "doc_id long, k long, gone array<int>, "
                       "rest array<struct<w:long,lines:array<int>>>", lambda: _aligned)
    if rest:
        gone = stored(gone, "line-aligned")
        gone = (gone.join(unaligned(gone, lines), ["doc_id", "k"], "left")
                .withColumn("gone", F.array_union("gone", F.coalesce("more", F.array()))))
    return map_columns(gone, ["doc_id", "k", "gone"], "doc_id long, k long, kept array<struct<start:int,size:int>>, "
                       "n_removed int", lambda: _kept_ranges).where("n_removed > 0")


def deduplicate_lines(docs: DataFrame, rest: bool = False) -> DataFrame:
    """``docs`` with the common blocks cut from ``text``, and the columns ``_llm_n_lines`` and ``_llm_n_removed``.

    Without ``rest`` only the blocks that align with a partner go, with it those of all earlier documents.
    """
    keyed = docs.withColumn("_llm_k", text_key())
    cuts = stored(removals(keyed.select("doc_id", F.col("_llm_k").alias("k"), "text"), rest), "line-cuts")
    cuts = cuts.select(F.col("doc_id").alias("_llm_id"), F.col("k").alias("_llm_ck"), F.col("kept").alias("_llm_kept"),
                       F.col("n_removed").alias("_llm_n_removed"))
    lines = F.split("text", "\n", -1)
    left = F.flatten(F.transform("_llm_kept", lambda r: F.slice(lines, r["start"], r["size"])))
    return (keyed.join(cuts, (F.col("doc_id") == F.col("_llm_id")) & (F.col("_llm_k") == F.col("_llm_ck")), "left")
            .withColumn("_llm_n_lines", F.coalesce(F.size(lines), F.lit(0)))
            .withColumn("text", F.when(F.col("_llm_kept").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
            .withColumn("_llm_n_removed", F.coalesce("_llm_n_removed", F.lit(0)))
            .drop("_llm_id", "_llm_ck", "_llm_k", "_llm_kept"))


def cut_common_lines(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """``docs`` without the common blocks; documents of which only white space is left are dropped.

    A column ``length``, where there is one, holds the characters of what is left of each cut text.
    """
    cut = deduplicate_lines(docs)
    if length in docs.columns:
        cut = cut.withColumn(length, F.when(F.col("_llm_n_removed") > 0, F.length("text").cast("long"))
                             .otherwise(F.col(length)))
    gone = (F.col("_llm_n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)


def op3_line_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate_lines(docs, rest=True).select(
        "doc_id", F.col("_llm_n_lines").cast("long").alias("n_lines"), F.col("_llm_n_removed").cast("long").alias("n_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
