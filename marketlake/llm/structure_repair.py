"""Cheapest repair of damaged conversations: Re-Pair grammar of role/fault sequences, one min-plus matrix a rule.

Every row of a conversation becomes one symbol: its role class (s, u, a, other) and fault class (must go, truncated,
sound). The symbols of ``BLOCK`` consecutive rows form a block; equal blocks of all conversations are one string, and
Re-Pair rounds over the distinct strings replace frequent pairs by rule symbols (pair counts are partial aggregates;
only the best ``RULES`` pairs of a round reach the driver, so the grammar has at most ``ROUNDS * RULES`` rules whatever
the input; which pairs are chosen changes no result).

A symbol stands for a matrix over the four states of ``(s?(ua)+)?``: cheapest cost, and the rank of its audit among the
audits of the matrix. A rule's matrix is the min-plus product of those of its two symbols, and its audits are ropes: an
entry keeps the state between its halves, two ropes compare by the ranks of their halves. Insertions stand before the
row they precede, so audits of one symbol end in a letter of a row, none is a prefix of another, and the least rope of a
product is made of least ropes. Matrices of blocks are combined ``FAN`` at a time, level by level, and the chosen states
are handed down again, so a conversation of any length is spread over many tasks; its one SHA-256 is a stream.

Defined results: null role or text is one space, as is null in the key of the damage; rows of one turn are ordered by
role and text after damage; repeated rows are rows of their own; rows without conv_id are the conversation of null; roles
count by their first character; texts of any length pass as they are; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.sequence import running_sum
from marketlake.llm.common import map_columns, stored
from marketlake.llm.oracle_sql import CRC_TABLE, crc32_sql

BLOCK = 1024
FAN = 1024
ROUNDS = 8
RULES = 16
FIRST_RULE = 0x4E00
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a; nothing and after a accept.
STATES = 4
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
SPACE = r"\x20\x09-\x0D"
NEVER = 1 << 40

Matrix = tuple[tuple[int, ...], tuple[int, ...]]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` chooses; conv is never null."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(1)))
                                                     .otherwise(F.array(F.lit(1)))).alias("one"))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, pos, cls, fault, sym) of numbered rows; fault is blank, duplicate, truncated or null."""
    end = F.substring(F.regexp_replace("text", f"[{SPACE}]+\\z", ""), -1, 1)
    cls = F.substring("role", 1, 1)
    light = rows.select("conv", "pos", F.when(cls.isin("s", "u", "a"), cls).otherwise("o").alias("cls"),
                        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
                        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("same"))
    light = stored(light, "repair-light")
    first = light.where("not blank").groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated"))
    out = light.drop("same").join(first, ["conv", "pos"], "left").withColumn("fault", fault)
    sym = (F.when(F.col("fault").isin("blank", "duplicate"), "x")
           .when(F.col("fault") == "truncated", F.upper("cls")).otherwise(F.col("cls")))
    return out.select("conv", "pos", "cls", "fault", sym.alias("sym"))


def blocks_of(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, seq, classes): the symbols and role classes of ``block`` consecutive rows as strings."""
    held = F.sort_array(F.collect_list(F.struct("pos", "sym", "cls")))
    return (marked.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("block")).agg(held.alias("held"))
            .select("conv", "block", F.array_join(F.transform("held", lambda r: r.sym), "").alias("seq"),
                    F.array_join(F.transform("held", lambda r: r.cls), "").alias("classes")))


# ------------------------------------------------------------------ grammar

def compress(seq: str, rules: list[str]) -> str:
    """``seq`` with each pair of the grammar replaced by its symbol, in the order of the rules."""
    for n, pair in enumerate(rules):
        seq = seq.replace(pair, chr(FIRST_RULE + n))
    return seq


def re_pair(blocks: DataFrame, rounds: int = ROUNDS, per_round: int = RULES) -> list[str]:
    """Pairs that Re-Pair replaces, best first; rule n is the symbol ``FIRST_RULE + n``."""
    distinct = stored(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("held")), "repair-strings")
    rules: list[str] = []
    for _ in range(rounds):
        def start(known: tuple[str, ...] = tuple(rules)):
            def run(seqs, held):
                seen: Counter = Counter()
                for seq, n in zip(seqs, held):
                    small = compress(seq, known)
                    for pair, times in Counter(zip(small, small[1:])).items():
                        seen[pair[0] + pair[1]] += n * times
                return {"pair": list(seen), "times": list(seen.values())}
            return run
        best = (map_columns(distinct, ["seq", "held"], "pair string, times long", start).groupBy("pair")
                .agg(F.sum("times").alias("times")).where("times > 1").orderBy(F.desc("times"), "pair").limit(per_round).collect())
        if not best:
            break
        rules += [r.pair for r in best]
    return rules


# ------------------------------------------------------------------ matrices

def _base(symbol: str) -> tuple[dict, Matrix]:
    """Matrix of one row and the audit of each entry."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    reach = {(i, i): "" for i in range(STATES)} | {(i, j): "I" for (r, i), j in STEP.items() if r != "s"}
    for (i, j), a in list(reach.items()):
        if j == STEP["u", 0] and a:
            reach.setdefault((i, STEP["a", j]), a + "I")
    lower = symbol.lower()
    cut = TRUNCATED if symbol != lower else 0
    for (i, k), inserted in reach.items():
        moves = [(k, DELETE, "D")]
        if lower != "x":
            if (lower, k) in STEP:
                moves.append((STEP[lower, k], KEEP + cut, "K"))
            moves += [(STEP[r, k], REROLE + cut, "R") for r in "ua" if (r, k) in STEP]
        for j, cost, letter in moves:
            offer = (cost + INSERT * len(inserted), inserted + letter)
            if (i, j) not in found or offer < found[i, j]:
                found[i, j] = offer
    order = {a: n for n, a in enumerate(sorted({a for _, a in found.values()}))}
    cells = [(i, j) for i in range(STATES) for j in range(STATES)]
    return ({c: found[c][1] for c in found},
            (tuple(found[c][0] if c in found else NEVER for c in cells), tuple(order[found[c][1]] if c in found else 0 for c in cells)))


def product(left: Matrix, right: Matrix) -> tuple[Matrix, tuple[int, ...]]:
    """Min-plus product with ranks, and the state between the halves of each entry."""
    (lc, lr), (rc, rr) = left, right
    costs, middles, ropes = [], [], []
    for i in range(STATES):
        for j in range(STATES):
            best = min((min(lc[4 * i + k] + rc[4 * k + j], NEVER), lr[4 * i + k], rr[4 * k + j], k) for k in range(STATES))
            costs.append(best[0])
            ropes.append(best[1:3])
            middles.append(best[3])
    order = {r: n for n, r in enumerate(sorted({r for r, c in zip(ropes, costs) if c < NEVER}))}
    return (tuple(costs), tuple(order[r] if c < NEVER else 0 for r, c in zip(ropes, costs))), tuple(middles)


def fold(matrices: list[Matrix]) -> Matrix:
    total = matrices[0]
    for m in matrices[1:]:
        total = product(total, m)[0]
    return total


def states_between(matrices: list[Matrix], i: int, j: int) -> list[int]:
    """States before, between and after the matrices on the best way from ``i`` to ``j``."""
    total, middles = matrices[0], []
    for m in matrices[1:]:
        total, middle = product(total, m)
        middles.append(middle)
    way = [j]
    for middle in reversed(middles):
        way.append(middle[4 * i + way[-1]])
    return [i, *reversed(way)]


class Grammar:
    """Matrices and ropes of the base symbols and of every rule, evaluated bottom-up."""

    def __init__(self, rules: list[str]):
        self.rules, self.matrices, self.middles, self.letters = rules, {}, {}, {}
        for s in "xsuaoSUAO":
            self.letters[s], self.matrices[s] = _base(s)
        for n, pair in enumerate(rules):
            self.matrices[chr(FIRST_RULE + n)], self.middles[chr(FIRST_RULE + n)] = product(
                self.matrices[pair[0]], self.matrices[pair[1]])

    def matrix(self, seq: str) -> Matrix:
        return fold([self.matrices[s] for s in compress(seq, self.rules)])

    def audit(self, seq: str, i: int, j: int) -> str:
        """The least cheapest audit of ``seq`` from state ``i`` to ``j``, its ropes unrolled."""
        small = compress(seq, self.rules)
        way = states_between([self.matrices[s] for s in small], i, j)
        out, todo = [], [(s, way[n], way[n + 1]) for n, s in enumerate(small)][::-1]
        while todo:
            s, a, b = todo.pop()
            if s in self.letters:
                out.append(self.letters[s][a, b])
            else:
                pair, k = self.rules[ord(s) - FIRST_RULE], self.middles[s][4 * a + b]
                todo += [(pair[1], k, b), (pair[0], a, k)]
        return "".join(out)


def finish(matrix: Matrix) -> tuple[int, int, str]:
    """(cost, last state, inserted tail) of the cheapest way from nothing to an accepting state; ties by audit."""
    costs, ranks = matrix
    cost, _, j = min((costs[j] + INSERT * len(TAIL[j]), ranks[j], j) for j in range(STATES) if costs[j] < NEVER)
    return cost, j, TAIL[j]


# ------------------------------------------------------------------ evaluation over blocks

def _levels(blocks: DataFrame, rules: list[str], fan: int) -> list[DataFrame]:
    """(conv, block, seq, costs, ranks) by block, then one table per level of ``fan`` matrices combined, the last with
    one row a conversation."""
    def start():
        grammar = Grammar(rules)
        known = lru_cache(maxsize=100_000)(grammar.matrix)

        def run(convs, numbers, seqs):
            got = [known(s) for s in seqs]
            return {"conv": convs, "block": numbers, "seq": seqs, "costs": [m[0] for m in got], "ranks": [m[1] for m in got]}
        return run

    def join_up():
        def run(convs, numbers, parts):
            got = [fold([(tuple(p["costs"]), tuple(p["ranks"])) for p in held]) for held in parts]
            return {"conv": convs, "block": numbers, "costs": [m[0] for m in got], "ranks": [m[1] for m in got]}
        return run

    matrix = "costs array<long>, ranks array<long>"
    levels = [stored(map_columns(blocks, ["conv", "block", "seq"], f"conv string, block long, seq string, {matrix}", start), "repair-level")]
    while levels[-1].agg(F.max("block")).first()[0]:
        parts = (levels[-1].groupBy("conv", F.floor(F.col("block") / fan).alias("block"))
                 .agg(F.sort_array(F.collect_list(F.struct("block", "costs", "ranks"))).alias("parts")))
        levels.append(stored(map_columns(parts, ["conv", "block", "parts"], f"conv string, block long, {matrix}", join_up), "repair-level"))
    return levels


def block_audits(blocks: DataFrame, rules: list[str], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conv, cost) of the cheapest repair, and (conv, block, audit) of its edits block by block."""
    levels = _levels(blocks, rules, fan)

    def choose():
        def run(convs, costs, ranks):
            got = [finish((tuple(c), tuple(r))) for c, r in zip(costs, ranks)]
            return {"conv": convs, "block": [0] * len(got), "cost": [g[0] for g in got], "i": [0] * len(got),
                    "j": [g[1] for g in got], "tail": [g[2] for g in got]}
        return run

    def hand_down():
        def run(convs, starts, ends, tails, parts):
            out = {"conv": [], "block": [], "i": [], "j": [], "tail": []}
            for conv, i, j, tail, held in zip(convs, starts, ends, tails, parts):
                way = states_between([(tuple(p["costs"]), tuple(p["ranks"])) for p in held], i, j)
                out["conv"] += [conv] * len(held)
                out["block"] += [p["block"] for p in held]
                out["i"] += way[:-1]
                out["j"] += way[1:]
                out["tail"] += [""] * (len(held) - 1) + [tail]
            return out
        return run

    def spell():
        grammar = Grammar(rules)
        known = lru_cache(maxsize=10_000)(grammar.audit)

        def run(convs, numbers, seqs, starts, ends, tails):
            return {"conv": convs, "block": numbers, "audit": [known(s, i, j) + t for s, i, j, t in zip(seqs, starts, ends, tails)]}
        return run

    chosen = stored(map_columns(levels[-1], ["conv", "costs", "ranks"],
                                "conv string, block long, cost long, i int, j int, tail string", choose), "repair-chosen")
    ways = chosen
    for level in reversed(levels[:-1]):
        parts = (level.groupBy("conv", F.floor(F.col("block") / fan).alias("block"))
                 .agg(F.sort_array(F.collect_list(F.struct("block", "costs", "ranks"))).alias("parts")))
        ways = stored(map_columns(ways.join(parts, ["conv", "block"]), ["conv", "i", "j", "tail", "parts"],
                                  "conv string, block long, i int, j int, tail string", hand_down), "repair-ways")
    spelled = map_columns(levels[0].select("conv", "block", "seq").join(ways, ["conv", "block"]),
                          ["conv", "block", "seq", "i", "j", "tail"], "conv string, block long, audit string", spell)
    return chosen.select("conv", "cost"), spelled


# ------------------------------------------------------------------ repaired conversations

class _Repaired:
    """One conversation while its rows pass: the hash of its repaired lines and its audit."""

    def __init__(self, conv: str):
        self.conv, self.hash, self.audit, self.last, self.lines = conv, hashlib.sha256(), [], "", 0
        self.edits, self.at = "", 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.last = role[0]
        self.lines += 1

    def turn_to(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.line(self.turn_to(), "")
            self.at += 1

    def block(self, audit: str) -> None:
        self.insertions()
        self.edits, self.at = audit, 0
        self.audit.append(audit)

    def row(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.edits[self.at]
        self.at += 1
        if letter != "D":
            self.line(role if letter == "K" else self.turn_to(), text)

    def close(self) -> tuple[str, str, str]:
        self.insertions()
        return self.conv, "".join(self.audit), self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its blocks of edits and the rows they belong to, in order."""
    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(3)],
                                          names=["conv", "audit", "repaired_sha256"])
    now = None
    for batch in batches:
        done = []
        for conv, audit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.close())
                now = _Repaired(conv)
            if audit is not None:
                now.block(audit)
            else:
                now.row(role, text)
        yield out(done)
    if now is not None:
        yield out([now.close()])


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """One row per original conversation: faults, cheapest edits and the hash of the repaired conversation."""
    origin = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    rows = stored(running_sum(damage(conversations), ["conv"], ["turn", "role", "text"], "one", "pos")
                  .select("conv", "pos", "turn", "role", "text"), "repair-rows")
    marked = stored(symbols(rows), "repair-symbols")
    blocks = stored(blocks_of(marked, block), "repair-blocks")
    costs, audits = block_audits(blocks, re_pair(blocks, rounds, rules), fan)

    def count(fault: str):
        return F.count_if(F.col("fault") == fault).alias(fault)
    faults = marked.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    # pairs inside blocks, and those at the borders of blocks, of which there is one row a block
    inner = F.length("classes") - 1 - F.regexp_count("classes", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    edge = blocks.select("conv", "block", F.substring("classes", 1, 1).alias("head"), F.substring("classes", -1, 1).alias("foot"),
                         inner.alias("inner"))
    before = edge.select("conv", (F.col("block") + 1).alias("block"), F.col("foot").alias("before"))
    border = F.when(F.concat("before", "head").isin("su", "ua", "au") | F.col("before").isNull(), 0).otherwise(1)
    illegal = (edge.join(before, ["conv", "block"], "left").groupBy("conv")
               .agg(F.sum(F.col("inner") + border).cast("long").alias("illegal")))

    none = F.lit(None).cast("string")
    stream = (audits.select("conv", (F.col("block") * block + 1).alias("pos"), F.lit(0).alias("kind"), "audit", none.alias("role"), none.alias("text"))
              .unionByName(rows.select("conv", "pos", F.lit(1).alias("kind"), none.alias("audit"), "role", "text"))
              .repartition("conv").sortWithinPartitions("conv", "pos", "kind"))
    repaired = stream.select("conv", "audit", "role", "text").mapInArrow(_repaired, "conv string, audit string, repaired_sha256 string")
    found = origin
    for part in (gaps, faults, illegal, costs, repaired):
        found = found.join(part, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracle() -> str:
    """The damage, faults and a dynamic program row by row; a state is its cheapest (cost, audit) and its lines."""
    def edit(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        lines = f"{state}.l" if line is None else f"CASE WHEN {state}.l IS NULL THEN {line} ELSE {state}.l || chr(10) || {line} END"
        return (f"CASE WHEN {state} IS NOT NULL AND {when} THEN "
                f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} END")

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def into(role: str, name: str, *states: str) -> list[str]:
        return [o for s in states for o in (
            edit(s, "more", "K", "role || ':' || text", f"sound AND role[1] = '{role}'"),
            edit(s, "more + 1", "R", f"'{name}:' || text", "sound"))]
    return f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
  FROM conversations, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM hurt),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id),
rows AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS sound, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM judged),
way AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'l': NULL::VARCHAR}} AS s0,
         NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR) AS s2,
         NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR) AS s3 FROM counts
  UNION ALL
  SELECT conv_id, pos, {edit("s0", "2", "D")}, {least(edit("s1", "2", "D"), edit("s0", "more", "K", "role || ':' || text", "sound AND role[1] = 's'"))},
         {least(edit("t2", "2", "D"), *into("u", "user", "s0", "s1", "t3"))},
         {least(edit("t3", "2", "D"), *into("a", "assistant", "t2"))}
  FROM (
    SELECT *, {least("s3", edit("t2", "5", "I", "'assistant:'"))} AS t3
    FROM (
      SELECT r.conv_id, r.pos, r.role, r.text, r.sound, r.more, w.s0, w.s1, w.s3,
             {least("w.s2", *(edit(f"w.{s}", "5", "I", "'user:'") for s in ("s0", "s1", "s3")))} AS t2
      FROM way w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1))),
last AS (
  SELECT *, {least("s3", edit("t2", "5", "I", "'assistant:'"))} AS t3
  FROM (SELECT w.*, {least("w.s2", *(edit(f"w.{s}", "5", "I", "'user:'") for s in ("s0", "s1", "s3")))} AS t2
        FROM way w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos)),
best AS (SELECT conv_id, {least("s0", "t3")} AS b FROM last),
origin AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(b.l, '')) AS repaired_sha256
FROM origin o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE = _oracle()
