"""Trie of shared conversation prefixes by van Emde Boas recursion: named cuts, recursive halves, grafted totals.

A conversation is a sequence of turns, each a 128-bit digest of (role, text). ``BASE * 2**k`` turns are cut at half
depth. The prefix that ends at a cut is named by the digest of the name at the start of the range and the block digest
of the upper half (block digests are built pairwise, so a conversation of any length costs two rows per block), and the
range falls into an upper trie and a lower forest whose roots are the named cuts. Both go on as rows of one DataFrame,
so all ranges of one size are halved by one join; at ``BASE`` turns names are chained inside a row. Equal names are one
node, called by its smallest member and its depth. Totals are grafted upward in the reverse order: within blocks of
``BASE``, then for each cut level every cut node adds what lies below it to its ancestors in the upper half, found as
the prefixes of its own smallest member.

Nothing collects a conversation or a node's members: ranks come from range partitions, names and totals from partial
aggregates, joins are on (conversation, block) or on a node's name. The list of members that end at a node is hashed as
a stream of pieces of at most ``ENDS`` ids, since one SHA-256 is one chain.

Defined results: rows of one conversation and turn are ordered by role, then text, repeated rows stay turns of their
own; null turns come first; null role or text is empty; rows without conv_id belong to no conversation and are left out;
texts of any length enter as digest and byte count; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.sequence import running_sum
from marketlake.llm.common import stored
from marketlake.llm.oracle_sql import CRC_TABLE, crc32_sql

BASE = 8
CELL = 1024
ENDS = 512
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    """First 128 bits of the SHA-256 of binary parts that are all of one length, or of one part."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)), 1, 16)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, dig, bytes) of every turn; a long conversation is spread over many range partitions."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).alias("one"))
    ranked = running_sum(rows, ["conv_id"], ["turn", "role", "text"], "one", "pos")
    tagged = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return ranked.select("conv_id", "pos", digest(tagged.cast("binary")).alias("dig"),
                         F.octet_length("text").cast("long").alias("bytes"))


def rebuild(turns: DataFrame, family: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, dig, bytes) and (conv_id, n): the first h turns of conversation c - c % family, then c's own
    after its first h, where h = crc32 of the decimal c, modulo ``shared``."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    plan = sizes.select("conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h"),
                        (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("first"), F.col("n_own").alias("n_first")), "first", "left")
    plan = stored(plan.select("conv_id", "first", "h", "n_own",
                              F.least("h", F.coalesce("n_first", F.lit(0))).alias("k")), "trie-plan")
    own = (turns.join(plan.select("conv_id", "h", "k"), "conv_id").where("pos > h")
           .select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).cast("long").alias("depth"), "dig", "bytes"))
    head = (turns.where(F.col("pos") < shared).withColumnRenamed("conv_id", "first")
            .join(plan.select("conv_id", "first", "h"), "first").where("pos <= h")
            .select("conv_id", F.col("pos").cast("long").alias("depth"), "dig", "bytes"))
    lengths = plan.select("conv_id", (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(head), lengths


def named_prefixes(turns: DataFrame, lengths: DataFrame, depth: int, base: int = BASE) -> DataFrame:
    """(conv_id, depth, name, ends) for every prefix of every conversation, the empty and the whole one included."""
    blocks = stored(turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / base).alias("block"))
                    .agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "dig"))), lambda t: t.dig).alias("digs")),
                    "trie-blocks")
    full = [blocks.where(F.size("digs") == base)
            .select("conv_id", "block", F.aggregate("digs", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x),
                                                    lambda a: digest(a)).alias("dig"))]
    while base << len(full) <= depth:
        left = F.col("block") % 2 == 0
        pair = (full[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block"))
                .agg(F.max(F.when(left, F.col("dig"))).alias("a"), F.max(F.when(~left, F.col("dig"))).alias("b")))
        full.append(stored(pair.where("a is not null and b is not null")
                           .select("conv_id", "block", digest(F.col("a"), F.col("b")).alias("dig")), "trie-level"))
    ranges = lengths.select("conv_id", F.lit(0).cast("long").alias("block"), digest(F.lit(b"root")).alias("name"))
    for uppers in reversed(full):
        upper = uppers.where("block % 2 = 0").select("conv_id", (F.col("block") / 2).cast("long").alias("block"), "dig")
        cut = ranges.join(upper, ["conv_id", "block"], "left")
        halves = F.array(F.struct((F.col("block") * 2).alias("block"), F.col("name")),
                         F.when(F.col("dig").isNotNull(), F.struct((F.col("block") * 2 + 1).alias("block"),
                                                                  digest(F.col("name"), F.col("dig")).alias("name"))))
        ranges = stored(cut.select("conv_id", F.explode(F.filter(halves, lambda x: x.isNotNull())).alias("half"))
                        .select("conv_id", "half.*"), "trie-ranges")
    inside = F.aggregate(F.slice(F.coalesce("digs", F.array().cast("array<binary>")), 1, base - 1), F.array("name"),
                         lambda names, x: F.concat(names, F.array(digest(F.element_at(names, -1), x))))
    size = F.coalesce(F.size("digs"), F.lit(0))
    return (ranges.join(blocks, ["conv_id", "block"], "left")
            .select("conv_id", "block", size.alias("held"), F.posexplode(inside).alias("at", "name"))
            .select("conv_id", (F.col("block") * base + F.col("at")).alias("depth"), "name",
                    (F.col("at") == F.col("held")).alias("ends")))


def _graft(totals: DataFrame, prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``totals`` with (leaves, saved) of ``pairs`` (name of an ancestor, what lies below) added."""
    more = pairs.groupBy("name").agg(F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
    add = [(F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return stored(totals.join(more, "name", "left").select("name", "conv_id", "depth", *add), "trie-totals")


def graft_totals(totals: DataFrame, prefixes: DataFrame, depth: int, base: int = BASE) -> DataFrame:
    """Sums of leaves and saved over subtrees; ``totals`` holds what each node counts for itself."""
    part = prefixes.select("conv_id", "depth", "name")
    block = F.floor(F.col("depth") / base).alias("cell")
    low = totals.where(F.col("depth") % base > 0).select("conv_id", block, F.col("depth").alias("below"), "leaves", "saved")
    near = part.select("conv_id", block, "depth", "name").join(low, ["conv_id", "cell"]).where("depth < below")
    totals = _graft(totals, prefixes, near)
    width = base
    while width <= depth:
        cell = min(width, CELL)
        cuts = totals.where(F.floor(F.col("depth") / width) % 2 == 1).where(F.col("depth") % width == 0).select(
            "conv_id", F.explode(F.sequence(F.floor((F.col("depth") - width) / cell),
                                            F.floor((F.col("depth") - 1) / cell))).alias("cell"), "leaves", "saved")
        above = part.select("conv_id", F.floor(F.col("depth") / cell).alias("cell"), "name").join(cuts, ["conv_id", "cell"])
        totals = _graft(totals, prefixes, above)
        width *= 2
    return totals


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each name; pieces arrive in order."""
    name, state = None, None
    for batch in batches:
        names, hashes = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != name:
                if name is not None:
                    names.append(name)
                    hashes.append(state.hexdigest())
                name, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())],
                                         names=["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                         names=["name", "ends_sha256"])


def ends_hashes(prefixes: DataFrame, ends: int = ENDS) -> DataFrame:
    """(name, ends_sha256) of every node at which conversations end."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = (prefixes.where("ends").groupBy("name", F.floor(F.col("conv_id") / ends).alias("part"))
              .agg(piece.alias("piece")).repartition("name").sortWithinPartitions("name", "part"))
    return pieces.select("name", "piece").mapInArrow(_hash_pieces, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, base: int = BASE) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth from 1, dig, bytes); ``lengths`` (conv_id, n) names every
    conversation, those without a turn too."""
    turns, lengths = stored(turns, "trie-turns"), stored(lengths, "trie-lengths")
    depth = lengths.agg(F.max("n")).first()[0] or 0
    prefixes = stored(named_prefixes(turns, lengths, depth, base), "trie-prefixes")
    nodes = stored(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
                                                F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    upward = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = (nodes.join(upward, ["conv_id", "depth"], "left")
             .join(turns.select("conv_id", "depth", "bytes"), ["conv_id", "depth"], "left"))
    linked = stored(nodes, "trie-linked")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(linked.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
                   "trie-counted")
    own = nodes.select("name", "conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"))
    totals = graft_totals(stored(own, "trie-own"), prefixes, depth, base)
    least = lengths.agg(F.min("conv_id")).first()[0]
    deep = nodes.where("depth > 1").join(
        nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    top = nodes.where("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    return (deep.unionByName(top).join(totals.select("name", "leaves", "saved"), "name")
            .join(ends_hashes(prefixes), "name", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuild(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = f"""
WITH tab AS ({CRC_TABLE}),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, max(pos) AS n FROM turns GROUP BY conv_id),
plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS first,
         {crc32_sql('conv_id::VARCHAR')} % 9 AS h
  FROM sizes, tab),
plans AS (SELECT p.*, least(h, coalesce(s.n, 0)) AS k FROM plan p LEFT JOIN sizes s ON s.conv_id = p.first),
built AS (
  SELECT p.conv_id, t.pos - p.h + p.k AS depth, t.role, t.text FROM plans p JOIN turns t USING (conv_id) WHERE t.pos > p.h
  UNION ALL
  SELECT p.conv_id, t.pos, t.role, t.text FROM plans p JOIN turns t ON t.conv_id = p.first WHERE t.pos <= p.h),
steps AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS d, strlen(text) AS bytes FROM built),
prefixes AS (
  SELECT conv_id, 0 AS depth, 'root' AS name, 0 AS bytes FROM sizes
  UNION ALL
  SELECT conv_id, depth, sha256(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)), bytes FROM steps),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id),
nodes AS (SELECT name, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(bytes) AS bytes FROM prefixes GROUP BY name),
up AS (
  SELECT n.name, n.conv_id, n.depth, n.n_convs, n.bytes, p.name AS parent
  FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS name, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.name, sum((u.n_convs - 1) * u.bytes) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM up u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN kids k ON k.name = u.name
  GROUP BY p.name),
ends AS (
  SELECT name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) WHERE depth = n GROUP BY name)
SELECT u.conv_id, u.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM up u LEFT JOIN nodes above ON above.name = u.parent LEFT JOIN kids k ON k.name = u.name
JOIN sums s ON s.name = u.name LEFT JOIN ends e ON e.name = u.name
"""
