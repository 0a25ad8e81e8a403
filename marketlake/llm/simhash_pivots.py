"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints: to references inside each 16-bit
block (block coordinates) and to full-width references (full coordinates). Two fingerprints at most two bits apart agree
in at least two of the four blocks, hence in all coordinates of those two blocks: candidates are joined on the block
coordinates of each of the six pairs of blocks, discarded when any full coordinate differs by more than the allowed
distance, and the survivors verified bit by bit.

A bucket of more than ``BUCKET`` fingerprints is not paired. Its members take as references all fingerprints within one
bit of themselves; members that share such a centre are at most two bits apart by the triangle inequality, and two
members within two bits always share one, so links to the least member of each centre lose no link of the component.
Copies are grouped by fingerprint before any join. Components come from least-label propagation with pointer jumping.

Defined results: null and empty text have fingerprint zero, linked like any other; ids may repeat or be null (a null id
takes part, and never is the smallest); repeated rows fall in one component; a bit set in exactly half of the shingles is
zero; a text of any length is hashed whole, in bounded steps; an empty table gives an empty result; other columns pass
through or are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import drop_stored, map_columns, shared_dir, stored, text_key

SHINGLE = 3
MAX_BITS = 2
BUCKET = 16
BLOCK_PIVOTS = 12
FULL_PIVOTS = 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over word shingles of the lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    take = min(size, len(words))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[take - 1:])])
    total = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 65536):
        total += np.unpackbits(rows[i:i + 65536], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame, *keys: str, size: int = SHINGLE) -> DataFrame:
    """``keys`` and the fingerprint ``fp`` of every row."""
    types = dict(docs.select(*keys).dtypes)

    def start():
        def run(texts, *columns):
            return {**dict(zip(keys, columns)), "fp": [fingerprint(t, size) for t in texts]}
        return run

    return map_columns(docs, ["text", *keys], ", ".join([*(f"{k} {types[k]}" for k in keys), "fp long"]), start)


def _references() -> tuple[list[list[int]], list[int]]:
    rng = np.random.default_rng(20)
    blocks = [[int(x) for x in rng.integers(0, 1 << 16, BLOCK_PIVOTS)] for _ in range(4)]
    return blocks, [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, FULL_PIVOTS)]


def _packed(values: list, width: int) -> F.Column:
    out = F.lit(0).cast("long")
    for i, v in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(v.cast("long"), i * width))
    return out


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Distances to the references: block coordinates ``b0``..``b3`` and full coordinates ``d0``, ``d1``, packed."""
    blocks, full = _references()
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in full]
    return nodes.select(
        "fp", *(_packed([F.bit_count(part[i].bitwiseXOR(F.lit(p))) for p in blocks[i]], 5).alias(f"b{i}") for i in range(4)),
        _packed(far[:8], 8).alias("d0"), _packed(far[8:], 8).alias("d1"))


def _max_difference() -> F.Column:
    def coordinate(side: str, i: int) -> F.Column:
        return F.shiftrightunsigned(f"{side}_d{i // 8}", 8 * (i % 8)).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(coordinate("a", i) - coordinate("b", i)) for i in range(FULL_PIVOTS)))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at most two bits apart that connect every near-duplicate class."""
    keyed = stored(pivot_table(nodes).select("fp", "d0", "d1", F.explode(F.array(*(
        F.xxhash64(F.lit(n), f"b{i}", f"b{j}") for n, (i, j) in enumerate(combinations(range(4), 2))))).alias("key")),
        "simhash-keys")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    shared = stored(keyed.join(sizes, "key"), "simhash-shared")
    drop_stored(keyed)
    small = shared.where(F.col("n") <= BUCKET)
    a = small.select("key", *(F.col(c).alias(f"a_{c}") for c in ("fp", "d0", "d1")))
    b = small.select("key", *(F.col(c).alias(f"b_{c}") for c in ("fp", "d0", "d1")))
    pairs = (a.join(b, "key").where(F.col("a_fp") < F.col("b_fp"))
             .where(_max_difference() <= MAX_BITS)
             .where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= MAX_BITS)
             .select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v")))
    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    centres = crowded.select("fp", F.explode(F.array(F.col("fp"), *(
        F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)))).alias("centre"))
    met = centres.groupBy("centre").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    met = stored(met.select("centre", "u"), "simhash-centres")
    stars = centres.join(met, "centre").where(F.col("fp") != F.col("u")).select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge; root is the least node of its component."""
    shared_dir(edges.sparkSession)
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "simhash-edges")
    label = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    label = label.select("node", F.least("node", "root").alias("root")).checkpoint()
    while True:
        near = (both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"))
                .agg(F.min("root").alias("near")))
        lower = label.join(near, "node").select("node", F.least("root", "near").alias("root")).checkpoint()
        # pointer jumping: take the label of the label
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = lower.join(jump, "root").select("node", F.col("up").alias("root")).checkpoint()
        if new.join(label.withColumnRenamed("root", "old"), "node").where(F.col("root") != F.col("old")).isEmpty():
            return new
        label = new


def near_duplicate_classes(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` (``doc_id`` among them), fingerprint ``fp``, ``root`` of the class and ``component_id`` of every row."""
    table = stored(fingerprints(docs, *keys), "simhash-fingerprints")
    nodes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    linked = rooted.join(least, "root").select("fp", "root", "least")
    classes = stored(nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first_id").alias("component_id")), "simhash-classes")
    return table.join(classes, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class: least id, then least text hash; repeated rows collapse."""
    rows = near_duplicate_classes(docs.withColumn("_llm_k", text_key()), "doc_id", "_llm_k")
    # by root, not by component_id: classes may share their least id, or have none
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_llm_k")).alias("best"))
    best = stored(best.select(F.col("best.doc_id").alias("_llm_id"), F.col("best._llm_k").alias("_llm_kk")), "simhash-kept")
    kept = docs.withColumn("_llm_k", text_key()).join(
        best, F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_k") == F.col("_llm_kk")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_llm_k"]).select(*docs.columns)


def op2_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs, "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
