"""Prefix trie and conversation repair against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from marketlake.llm import prefix_trie, structure_repair

DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def conversations_of(rows) -> dict:
    """Sorted turns of each conversation; null turns first."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role, text))
    return {c: sorted(v) for c, v in found.items()}


def odd_conversations() -> list[tuple]:
    """Nulls, ties, repeated rows, empty and long texts, one long conversation, copies, a missing base."""
    rows = [(50, None, "user", "hello there."), (50, 0, None, None), (50, 1, "assistant", ""), (51, 0, "user", "x" * 50_000),
            (51, 0, "user", "x" * 50_000), (51, 0, "assistant", "tie."), (53, 4, "tool", "{}"), (53, 9, "user", " \n"),
            (None, 1, "user", "nobody."), (None, None, None, None), (58, 0, "system", "only."), (5001, 1, "", "Ünï¢ödé 𝒳!")]
    rows += [(60, i, ("user", "assistant")[i % 2], f"t{i % 3}.") for i in range(43)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"same {i}.") for c in range(100, 140) for i in range(3)]
    rows += [(200 + c, i, ("user", "assistant")[i % 2], f"{c % 2 if i > 8 else 0} {i}.") for c in range(8) for i in range(17)]
    return rows


def brute_trie(rows) -> set:
    convs = {c: [(r, t) for _, _, r, t in v] for c, v in conversations_of(
        [(c, n, r or "", t or "") for c, n, r, t in rows if c is not None]).items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        worth = (len(held) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += node not in children
    return {(held[0], len(node), members[node[:-1]][0] if node else None, len(held), children[node], leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, held in members.items()}


@pytest.mark.parametrize("base", [2, 8])
def test_trie_brute_force(spark, base):
    rows = odd_conversations()
    rng = random.Random(4)
    rows += [(300 + c, i, rng.choice(("user", "assistant")), rng.choice(("a", "b"))) for c in range(40) for i in range(rng.randint(1, 12))]
    given = spark.createDataFrame(rows, TURNS)
    got = rows_of(prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.numbered_turns(given)), base=base))
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_the_given_table(spark):
    rows = rows_of(spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    assert set(rows_of(prefix_trie.op11_prefix_trie(spark, DIR))) == brute_trie(rows)


def test_trie_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert rows_of(prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.numbered_turns(empty)))) == []
    rows = [(7, 0, "user", "a."), (8, 0, "user", "a.")]
    given = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], TURNS + ", depth int, name string, pos double")
    got = rows_of(prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.numbered_turns(given))))
    assert set(got) == brute_trie(rows)


# ------------------------------------------------------------------ repair

def brute_damage(rows) -> dict:
    out = {c: [] for c, *_ in rows}
    for c, n, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out[c] += [(n is not None, n or 0, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def brute_repair(rows) -> set:
    """Dijkstra-free reference: the least (cost, audit) to each state after each row, whole strings kept."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    found = set()
    for conv, held in brute_damage(rows).items():
        faults, seen = [], set()
        for _, _, role, text in held:
            core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else
                          "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [n for known, n, _, _ in held if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        best = {"": (0, "", ())}

        def inserted(best):
            for _ in range(3):
                for state, (cost, audit, lines) in list(best.items()):
                    for r, name in (("u", "user"), ("a", "assistant")):
                        if r in step[state]:
                            offer = (cost + 5, audit + "I", lines + (name + ":",))
                            if step[state][r] not in best or offer[:2] < best[step[state][r]][:2]:
                                best[step[state][r]] = offer
            return best

        for (_, _, role, text), fault in zip(held, faults):
            after = {}
            for state, (cost, audit, lines) in inserted(best).items():
                offers = [(state, cost + 2, audit + "D", lines)]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    if role[:1] in step[state]:
                        offers.append((step[state][role[:1]], cost + more, audit + "K", lines + (f"{role}:{text}",)))
                    offers += [(step[state][r], cost + more + 1, audit + "R", lines + (f"{name}:{text}",))
                               for r, name in (("u", "user"), ("a", "assistant")) if r in step[state]]
                for s, *offer in offers:
                    if s not in after or tuple(offer[:2]) < after[s][:2]:
                        after[s] = tuple(offer)
            best = after
        cost, audit, lines = min((inserted(best)[s] for s in ("", "a") if s in best), key=lambda o: o[:2])
        found.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                   hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return found


def random_conversations(seed: int, number: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ("user", "assistant", "system", "user", "assistant", "tool", "ufo", "", None)
    texts = ("yes.", "no", "why?", " ", "", None, "long text!", "ok .  ", "x ")
    return [(c, rng.choice((i, i, i + 2, None)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {c} {i}{rng.choice('.!? a')}")
            for c in range(number) for i in range(rng.randint(0, 13))]


def test_repair_of_the_given_table(spark):
    rows = rows_of(spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    got = rows_of(structure_repair.op13_structure_repair(spark, DIR))
    assert len(got) == len(set(got)) and set(got) == brute_repair(rows)


@pytest.mark.parametrize("block, fan, rounds", [(1024, 1024, 8), (3, 2, 3)])
def test_repair_brute_force(spark, block, fan, rounds):
    rows = odd_conversations() + random_conversations(1, 150)
    got = rows_of(structure_repair.repair(spark.createDataFrame(rows, TURNS), block, fan, rounds, 6))
    assert len(got) == len(set(got)) and set(got) == brute_repair(rows)


def test_matrices_of_rules_equal_those_of_their_rows():
    rng = random.Random(3)
    rules = ["ua", chr(structure_repair.FIRST_RULE) * 2, "xx", "ux", "".join(map(chr, range(structure_repair.FIRST_RULE, structure_repair.FIRST_RULE + 2)))]
    whole, plain = structure_repair.Grammar(rules), structure_repair.Grammar([])
    for _ in range(300):
        seq = "".join(rng.choice("uauauaxsoSUAO") for _ in range(rng.randint(1, 24)))
        a, b = whole.matrix(seq), plain.matrix(seq)
        assert a[0] == b[0]
        for i in range(4):
            for j in range(4):
                if a[0][4 * i + j] < structure_repair.NEVER:
                    assert whole.audit(seq, i, j) == plain.audit(seq, i, j)


def test_repair_of_nothing_and_clashing_columns(spark):
    assert rows_of(structure_repair.repair(spark.createDataFrame([], TURNS))) == []
    rows = [(7, 0, "user", "a."), (8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    given = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], TURNS + ", pos int, conv string, hit double")
    assert set(rows_of(structure_repair.repair(given))) == brute_repair(rows)


@pytest.mark.parametrize("module, brute", [(prefix_trie, brute_trie), (structure_repair, brute_repair)])
def test_oracles_equal_brute_force(module, brute):
    con = duckdb.connect()
    rows = odd_conversations() + random_conversations(5, 60)
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert set(con.execute(module.ORACLE).fetchall()) == brute(rows)
