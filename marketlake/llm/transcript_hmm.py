"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

The lines of a conversation, in order of turn, are observations: the speaker marker that a line carries (the ``role``
column on the first line of a row, or a marker such as ``User:`` at the start of a line) and features of the line
(length, question mark, first of its row). Hidden states are the roles. Roles change at rows and at marked lines by a
transition matrix; other lines keep their speaker. Transition and feature probabilities are counted over all rows whose
role is known; a marker is believed with probability ``TRUST``, so contradictory, unknown and missing markers are
settled by the features and by the order of turns. Viterbi gives the best roles of the whole conversation; runs of one
speaker within a row become turns ``<|im_start|>role``, text, ``<|im_end|>``. Rows are never merged: neighbouring rows of
one speaker stay turns of their own.

A conversation may be of any length: rows are range-partitioned by conversation and turn, stored, and cut into blocks of
``BLOCK`` rows or ``BLOCK_CHARS`` characters, whichever is less. A block's Viterbi step is a max-plus matrix; the
matrices of a conversation that spans blocks are combined in order, first those of each range partition and then one a
partition, which fixes the states at the borders of partitions and, handed down, of blocks; the blocks are then decoded
independently. Scores are whole numbers, so the result scores exactly what one Viterbi pass over the conversation
would; of equally good role sequences, which can only differ by such ties, one is taken.

Defined results: null roles and roles of no known name count as no marker; null and empty text is one empty line; rows
with a null ``conv_id`` form one conversation; null turns come first; rows that repeat a turn are ordered by role and
text; one row of any length is one block at least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import map_columns, stored

ROLES = ("system", "user", "assistant")
BLOCK = 1024
BLOCK_CHARS = 4_000_000
TRUST = 0.97
STAY = 0.999
FEATURES = 8
OPENING, BORDER = -2, -3
#: Names of speakers, by role.
NAMES = {"system": "system developer instruction instructions context",
         "user": "user human question prompt customer q me",
         "assistant": "assistant ai bot gpt chatgpt model answer response agent a"}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role].split()}
_MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(\w+)\s*(?:\|>|\Z)|\[(\w+)\]\s*:?|#{1,4}\s*(\w+)\s*:|\*{2}(\w+):?\*{2}\s*:?|"
                     r"(\w+)\s*:)[ \t]*", re.I)
_END = re.compile(r"\s*<\|im_end\|>\s*\Z")


def role_of(name: str | None) -> int:
    """Index of the role that a speaker's name stands for, or -1."""
    return _ROLE_OF.get((name or "").strip().lower(), -1)


def split_line(line: str) -> tuple[int, str]:
    """(role of the speaker marker at the start of a line or -1, the line without it)."""
    m = _MARKER.match(line)
    role = role_of(next((g for g in m.groups() if g), None)) if m else -1
    if role < 0:
        return -1, line
    return role, line[m.end():]


def line_feature(line: str, first: bool) -> int:
    """Class of a line: first of its row or not, question or not, short or long."""
    return 4 * first + 2 * ("?" in line[-3:]) + (len(line) > 200)


def observe(role: str | None, text: str | None) -> tuple[list[int], list[str]]:
    """Observation codes and texts of the lines of one row; a code is feature + FEATURES * (marker + 1) + 64 * start."""
    codes, lines = [], []
    for i, line in enumerate((text or "").split("\n")):
        found, line = split_line(_END.sub("", line) if "<|im_end|>" in line else line)
        marker = found if found >= 0 else role_of(role) if i == 0 else -1
        codes.append(line_feature(line, i == 0) + FEATURES * (marker + 1) + 64 * (i == 0 or found >= 0))
        lines.append(line)
    return codes, lines


def scores(probability: np.ndarray | float) -> np.ndarray:
    """Log probabilities in whole numbers of 2**-20: sums do not depend on their order."""
    return np.round(np.log(probability) * (1 << 20)).astype(np.int64)


@dataclass
class Model:
    """Log probabilities (see ``scores``): of the first role, of role changes, of line features by role."""

    first: np.ndarray
    change: np.ndarray
    feature: np.ndarray

    def emission(self, code: int) -> np.ndarray:
        marker = code % 64 // FEATURES - 1
        e = self.feature[:, code % FEATURES]
        if marker < 0:
            return e
        trust = np.full(len(ROLES), scores((1 - TRUST) / (len(ROLES) - 1)))
        trust[marker] = scores(TRUST)
        return e + trust

    def step(self, code: int) -> np.ndarray:
        """Log scores of (role before, role of this line)."""
        n = len(ROLES)
        stay = np.full((n, n), scores((1 - STAY) / (n - 1)))
        np.fill_diagonal(stay, scores(STAY))
        return (self.change if code >= 64 else stay) + self.emission(code)[None, :]

    def product(self, codes: list[int], steps: dict) -> np.ndarray:
        """Max-plus product of the steps of a run of lines."""
        out = None
        for code in codes:
            s = steps.get(code)
            if s is None:
                s = steps[code] = self.step(code)
            out = s if out is None else (out[:, :, None] + s[None, :, :]).max(1)
        return out

    def decode(self, codes: list[int], entry: int | None, last: int | None) -> list[int]:
        """Best roles of a run; ``entry`` is the role before it (None: a beginning), ``last`` fixes its end."""
        back, v = [], None
        if entry is not None:
            v = np.full(len(ROLES), -(1 << 60))
            v[entry] = 0
        for i, code in enumerate(codes):
            if v is None:
                v = self.first + self.emission(code)
                back.append(None)
                continue
            s = v[:, None] + self.step(code)
            back.append(s.argmax(0))
            v = s.max(0)
            v = v - v.max()
        at = int(v.argmax()) if last is None else last
        out = []
        for b in reversed(back):
            out.append(at)
            if b is not None:
                at = int(b[at])
        return out[::-1]


def path_score(model: Model, codes: list[int], states: list[int]) -> int:
    """Score of a sequence of roles."""
    total = 0
    for i, (code, state) in enumerate(zip(codes, states)):
        total += int((model.first + model.emission(code))[state] if i == 0 else model.step(code)[states[i - 1], state])
    return total


def viterbi(model: Model, codes: list[int]) -> list[int]:
    return model.decode(codes, None, None) if codes else []


def _observed(df: DataFrame) -> DataFrame:
    """Rows in conversation order with block, row number, codes, known role (or -1) and that of the row before: ``OPENING``
    where the conversation begins, ``BORDER`` at the first row of a partition."""
    ordered = (df.select("conv_id", "turn", "role", "text").withColumn("_tie", F.monotonically_increasing_id())
               .repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"), "_tie")
               .sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "_tie")
               .withColumn("_part", F.spark_partition_id()))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("part", pa.int32()), ("row", pa.int64()), ("block", pa.int64()), ("codes", pa.list_(pa.int32())),
                        ("known", pa.int32()), ("before", pa.int32())])
    made = ("row", "block", "codes", "known", "before")

    def run(batches):
        row, block, held, chars, conversation, last = 0, 0, 0, 0, None, BORDER
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = {k: [] for k in made}
            for conv, role, text in zip(columns[0], columns[2], columns[3]):
                if held and (held >= BLOCK or chars + len(text or "") > BLOCK_CHARS):
                    block, held, chars = block + 1, 0, 0
                held, chars = held + 1, chars + len(text or "")
                known = role_of(role)
                before = last if last == BORDER or conv == conversation else OPENING
                for k, v in zip(made, (row, block, observe(role, text)[0], known, before)):
                    out[k].append(v)
                conversation, last, row = conv, known, row + 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=schema.field(n).type) for c, n in zip(columns, ("conv_id", "turn", "role", "text", "part"))),
                 *(pa.array(out[n], type=schema.field(n).type) for n in made)], schema=schema)

    got = ordered.select("conv_id", "turn", "role", "text", "_part").mapInArrow(
        run, "conv_id long, turn long, role string, text string, part int, row long, block long, codes array<int>, "
             "known int, before int")
    return stored(got, "transcript-rows")


def learn(rows: DataFrame) -> Model:
    """Probabilities from all rows of known role; every count is an aggregate of a few rows."""
    n = len(ROLES)
    known = rows.where("known >= 0")
    feature = np.ones((n, FEATURES))
    for r in (known.select("known", F.explode("codes").alias("c")).groupBy("known", (F.col("c") % FEATURES).alias("f")).count()
              .collect()):
        feature[r["known"], r["f"]] += r["count"]
    # the first row of a partition follows the last row of the one before that has rows
    edge = rows.groupBy("part").agg(
        F.min_by(F.struct("conv_id", "known"), "row").alias("a"), F.max_by(F.struct("conv_id", "known"), "row").alias("z"))
    prior = F.lag("z").over(Window.orderBy("part"))  # one row a partition
    same = F.col("p").isNotNull() & F.col("p.conv_id").eqNullSafe(F.col("a.conv_id"))
    edges = edge.withColumn("p", prior).select(F.when(same, F.col("p.known")).otherwise(OPENING).alias("before"),
                                               F.col("a.known").alias("known"))
    change, first = np.ones((n, n)), np.ones(n)
    pairs = known.where(F.col("before") != BORDER).select("before", "known").unionByName(edges.where("known >= 0"))
    for r in pairs.groupBy("before", "known").count().collect():
        if r["before"] == OPENING:
            first[r["known"]] += r["count"]
        elif r["before"] >= 0:
            change[r["before"], r["known"]] += r["count"]
    return Model(scores(first / first.sum()), scores(change / change.sum(1, keepdims=True)),
                 scores(feature / feature.sum(1, keepdims=True)))


def _runs(rows: list) -> list[tuple]:
    """(conversation, rows) of one block, in order."""
    out: list[tuple] = []
    for r in sorted(rows, key=lambda r: r["row"]):
        if out and out[-1][0] == r["conv_id"]:
            out[-1][1].append(r)
        else:
            out.append((r["conv_id"], [r]))
    return out


def _borders(blocks: DataFrame, model: Model) -> DataFrame:
    """(part, block, conv_id, entry, last) of the runs of conversations that span blocks."""
    def edges():
        def run(parts, numbers, rows):
            out = {k: [] for k in ("part", "block", "conv_id", "matrix", "start")}
            steps: dict = {}
            for part, number, some in zip(parts, numbers, rows):
                runs = _runs(some)
                for conv, of in {0: runs[0], len(runs) - 1: runs[-1]}.values():
                    codes = [c for r in of for c in r["codes"]]
                    # a conversation begins with its first line: scores of that line, then the product of the rest
                    rest = model.product(codes[1:], steps)
                    start = model.first + model.emission(codes[0])
                    start = start if rest is None else (start[:, None] + rest).max(0)
                    for k, v in zip(out, (part, number, conv, model.product(codes, steps).ravel().tolist(), start.tolist())):
                        out[k].append(v)
            return out
        return run

    ends = stored(map_columns(blocks, ["part", "block", "rows"],
                              "part int, block long, conv_id long, matrix array<long>, start array<long>", edges), "transcript-ends")
    n = len(ROLES)

    def chain_up():
        """The matrices of one conversation's blocks in one partition as one."""
        def run(convs, parts, runs):
            out = {k: [] for k in ("conv_id", "part", "size", "matrix", "start")}
            for conv, part, held in zip(convs, parts, runs):
                matrix, start = np.array(held[0]["matrix"]).reshape(n, n), np.array(held[0]["start"])
                for r in held[1:]:
                    m = np.array(r["matrix"]).reshape(n, n)
                    matrix, start = (matrix[:, :, None] + m[None, :, :]).max(1), (start[:, None] + m).max(0)
                for k, v in zip(out, (conv, part, len(held), matrix.ravel().tolist(), start.tolist())):
                    out[k].append(v)
            return out
        return run

    def settle(held: list, entry: int | None, last: int | None) -> list[tuple]:
        """(entry, last) of each link of a chain, given what is known of its ends."""
        before, v = [], None
        if entry is not None:
            v = np.full(n, -(1 << 60))
            v[entry] = 0
        for r in held:
            before.append(v)
            m = np.array(r["matrix"]).reshape(n, n)
            v = np.array(r["start"]) if v is None else (v[:, None] + m).max(0)
            v = v - v.max()
        state, out = int(v.argmax()) if last is None else last, []
        for r, b in zip(reversed(held), reversed(before)):
            end, state = state, None
            if b is not None:
                state = int((b + np.array(r["matrix"]).reshape(n, n)[:, end]).argmax())
            out.append((state, end))
        return out[::-1]

    def across():
        def run(convs, chains):
            out = {k: [] for k in ("conv_id", "part", "entry", "last")}
            for conv, held in zip(convs, chains):
                for r, ends_ in zip(held, settle(held, None, None)):
                    for k, v in zip(out, (conv, r["part"], *ends_)):
                        out[k].append(v)
            return out
        return run

    def within():
        def run(convs, parts, entries, lasts, runs):
            out = {k: [] for k in ("part", "block", "conv_id", "entry", "last")}
            for conv, part, entry, last, held in zip(convs, parts, entries, lasts, runs):
                for r, ends_ in zip(held, settle(held, entry, last)):
                    for k, v in zip(out, (part, r["block"], conv, *ends_)):
                        out[k].append(v)
            return out
        return run

    chains = ends.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", "matrix", "start"))).alias("runs"))
    whole = map_columns(chains, ["conv_id", "part", "runs"],
                        "conv_id long, part int, size int, matrix array<long>, start array<long>", chain_up)
    spans = (whole.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "matrix", "start"))).alias("parts"),
                                          F.sum("size").alias("size")).where("size > 1"))
    settled = map_columns(spans, ["conv_id", "parts"], "conv_id long, part int, entry int, last int", across)
    settled = settled.withColumnsRenamed({"conv_id": "s_conv", "part": "s_part"})
    inner = chains.join(settled, chains["conv_id"].eqNullSafe(settled["s_conv"]) & (chains["part"] == settled["s_part"]))
    return map_columns(inner, ["conv_id", "part", "entry", "last", "runs"],
                       "part int, block long, conv_id long, entry int, last int", within)


def canonical(role: int, text: str) -> str:
    return f"<|im_start|>{ROLES[role]}\n{text}<|im_end|>"


def _rendered(blocks: list[tuple], model: Model) -> dict:
    """Turns of the blocks: rows of one block with what the borders fix."""
    out = {k: [] for k in ("conv_id", "turn", "part", "role", "text", "rendered")}
    for rows, borders in blocks:
        fixed = {b["conv_id"]: b for b in borders or ()}
        for conv, of in _runs(rows):
            border = fixed.get(conv)
            codes = [c for r in of for c in r["codes"]]
            states = iter(model.decode(codes, border and border["entry"], border and border["last"]))
            for r in of:
                turns: list[list] = []
                for code, line in zip(r["codes"], observe(r["role"], r["text"])[1]):
                    state = next(states)
                    if turns and code < 64 and turns[-1][0] == state:
                        turns[-1][1].append(line)
                    else:
                        turns.append([state, [line]])
                for i, (state, lines) in enumerate(turns):
                    text = "\n".join(lines)
                    for k, v in zip(out, (conv, r["turn"], i, ROLES[state], text, canonical(state, text))):
                        out[k].append(v)
    return out


def parse_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text, rendered): the turns of every row, ``part`` counting them within the row."""
    rows = _observed(conversations)
    model = learn(rows)
    def blocks(*columns: str) -> DataFrame:
        return rows.groupBy("part", "block").agg(F.collect_list(F.struct("row", "conv_id", "codes", *columns)).alias("rows"))
    borders = _borders(blocks(), model).groupBy("part", "block").agg(
        F.collect_list(F.struct("conv_id", "entry", "last")).alias("borders"))
    joined = blocks("turn", "role", "text").join(borders, ["part", "block"], "left")
    return map_columns(joined, ["rows", "borders"],
                       "conv_id long, turn long, part int, role string, text string, rendered string",
                       lambda: lambda rows_, borders_: _rendered(list(zip(rows_, borders_)), model))


def op9_transcript_hmm(spark, sf_dir: str) -> DataFrame:
    return parse_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
