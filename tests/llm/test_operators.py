"""Corpus operators against brute-force versions, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from marketlake.llm import (config_packing, language_id, line_alignment, quality_forest, simhash_pivots, site_templates,
                            substring_dedup, template_decontamination, token_counts, transcript_hmm)
from marketlake.llm.common import text_key

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "\n".join(" ".join(f"w{(i * 7 + j) % 997}x" for j in range(40)) for i in range(300))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, case changes, one id with two texts."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 4), (None, base, "en", "s", 9),
            (None, None, None, None, None), (4, base, "en", "s", 9), (5, base, "en", "s", 9), (5, base, "en", "s", 9),
            (6, base.upper(), "en", "s", 9), (7, LONG, "en", "s", len(LONG)), (8, LONG + "\nthe end of it all", "en", "s", 1),
            (9, "one", "xx", "s", 3), (10, "one two", "xx", "s", 7), (11, f"a b c {passage} d e", "en", "s", 1),
            (12, f"{passage} z", "en", "s", 1), (12, f"other {passage}", "en", "s", 1), (13, "1234 ???", "en", "s", 1),
            (14, "x" * 70_000, "en", "s", 70_000), (15, "rep eat " * 40, "en", "s", 1), (16, "# | # | $ % " * 30, "en", "s", 1)]
    rows += [(100 + i, base + f" extra {i % 3}", "en", "s", i) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    return given.unionByName(spark.createDataFrame(odd_rows(), DOCS)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = spark.read.parquet(f"{DIR}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    return rows.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (16, 0, 0), (16, 1, 0), (99999, 1, 1)],
                                                  rows.schema))


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


# ------------------------------------------------------------------ 1, benchmark decontamination

def template_words(text) -> list[str]:
    """Lower-case words; a leading \x01 marks a name, \x02 a capitalised word that opens a sentence."""
    text = regex.sub(r"([\p{Ll},;][ \n])(\p{Lu}\p{Ll}+)", "\\1\x01\\2", text or "")
    text = regex.sub(r"(^|[.!?:][ \n])(\p{Lu}\p{Ll}+)", "\\1\x02\\2", text)
    for _ in range(3):
        text = regex.sub(r"([\x01\x02][^ \n]*\p{Ll}) (\p{Lu}\p{Ll}+)", "\\1\x01\\2", text)
    text = re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"[^\w\x20\x09-\x0D\x01\x02]+|_", "", text).lower())
    for _ in range(2):
        text = regex.sub(r"(\p{Nd}) (\p{Nd}{3})\b", "\\1\\2", text)
    return text.strip(" ").split(" ") if text.strip(" ") else []


def bare(word: str) -> str:
    return word.replace("\x01", "").replace("\x02", "")


def slot_kinds(ws: list[str], names) -> list:
    """Kind of each word or None; ``names`` says whether an opener is a name."""
    return ["<name>" if w[0] == "\x01" or w[0] == "\x02" and names(w) else "<num>" if w[0].isdigit() else
            "<unit>" if w in template_decontamination.UNITS and i and ws[i - 1][0].isdigit() else None for i, w in enumerate(ws)]


def brute_contaminated(docs, items) -> set:
    found = set()
    cut = [(doc, template_words(body)) for doc, body in docs]
    for item, text in items:
        iw = template_words(text)
        size = min(8, len(iw))
        if not iw:
            continue
        certain = slot_kinds(iw, lambda w: "\x01" + w[1:] in iw)
        loose, strict = slot_kinds(iw, lambda w: True), slot_kinds(iw, lambda w: False)
        places = range(len(iw) - size + 1)
        general = {i for i in places if 2 * sum(k is None for k in loose[i:i + size]) < size}
        raw = len(general) == len(places)
        wins = [i for i in places if raw or i not in general]
        for doc, dw in cut:
            here = slot_kinds(dw, lambda w: w[1:] not in dw)
            any_here = slot_kinds(dw, lambda w: True)
            at = defaultdict(set)
            for p in range(len(dw) - size + 1):
                for i in wins:
                    if raw:
                        fits = (2 * sum(k is None for k in any_here[p:p + size]) < size + 2
                                and [bare(w) for w in iw[i:i + size]] == [bare(w) for w in dw[p:p + size]])
                    else:
                        opened, fits = [], True
                        for x in range(size):
                            a, b = strict[i + x] or bare(iw[i + x]), here[p + x] or bare(dw[p + x])
                            if iw[i + x][0] == "\x02":     # may be a name or what it is
                                fits = fits and b in ("<name>", a)
                                opened.append(b == "<name>")
                            else:
                                fits = fits and a == b
                        fits = fits and (len(opened) <= 2 or len(set(opened)) == 1)
                    if fits:
                        at[p - i].add(i)
            groups, chain = [[o] for o in at], []
            for o in sorted(at):
                if chain and o - chain[-1] > 3:
                    groups.append(chain)
                    chain = []
                chain = chain + [o]
            for group in [*groups, chain]:
                if len({i for o in group for i in at[o]}) < max(1, 0.5 * len(wins)):
                    continue
                spots = {(i + x, i + x + o) for o in group for i in at[o] for x in range(size)}
                pairs = {(certain[j], bare(iw[j]), bare(dw[p])) for j, p in spots if certain[j] and certain[j] == any_here[p]}
                if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
                    found.add((doc, item))
    return found


def test_decontamination_brute_force(spark):
    given = rows_of(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))[:60]
    items = rows_of(spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text"))
    question = "a train leaves town with Anna, and 12 km later it meets Bertram at 12 km from home before noon today"
    asked = [(-1, question), (-2, "what is it"), (-3, None), (-4, "")]
    planted = [(5000, items[0][1]), (5001, "well then " + items[1][1].upper() + "! so it goes"),
               (5002, question.replace("12", "77").replace("Anna", "Clara").replace("Bertram", "David")),
               (5003, question.replace("12 km later", "13 km later")), (5004, "so what is it then"), (5005, None), (5006, ""),
               (None, question), (5007, question + " " + question)]
    docs = spark.createDataFrame(given + planted + planted[:1], "doc_id long, text string")
    bench = spark.createDataFrame(items + asked + asked[:1], "item_id long, text string").withColumn("k", F.lit(1))
    got = template_decontamination.contaminated(docs.select("doc_id", text_key().alias("k"), "text"), bench)
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert got == brute_contaminated(given + planted, items + asked)
    assert {(5000, items[0][0]), (5001, items[1][0]), (5002, -1), (5004, -2), (None, -1)} <= got and (5003, -1) not in got


def test_decontamination_finds_copies_of_general_items(spark):
    sums, names = "12 + 7 = 19, 30 + 5 = 35, 8 + 8 = 16, 40 + 2 = 42", "the team was Anna, Bertram, Clara, David, Emil, Frida, Gustav"
    bench = spark.createDataFrame([(1, sums), (2, names.split("was ")[1]), (3, "12 km 7 kg")], "item_id long, text string")
    rows = [(1, f"now solve {sums} and go on"), (2, sums.replace("12", "13").replace("30", "31").replace("8", "9")),
            (3, names + " and so on"), (4, names.replace("a,", "o,")), (5, "run 12 km 7 kg"), (6, "run 13 km 8 kg"), (7, sums)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", text_key())
    got = {(r["doc_id"], r["item_id"]) for r in template_decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 1)}


def test_decontamination_finds_reworded_slots(spark):
    """Names that open sentences, slots of several words, an inserted word; unrelated values in the same frame do not count."""
    apples = "Tom has 5 red apples in his basket. Tom gives 2 of them to Anna. Tom eats 1 of the rest, so how many apples does Tom have left?"
    trip = "the plane that left for Paris this morning carried 1200 people and landed in Paris before noon while it rained there"
    long = " ".join(f"word{i}" for i in range(29))
    bench = spark.createDataFrame([(1, apples), (2, trip), (3, long)], "item_id long, text string")
    rows = [(1, apples.replace("Tom", "Mia").replace("5", "9")), (2, "Intro here. " + apples.replace("Tom", "Mia") + " Some more text follows."),
            (3, trip.replace("Paris", "New York").replace("1200", "1 200")), (4, long.replace("word15", "word15 extra")),
            (5, trip.replace("Paris", "Rome", 1)), (6, apples.replace("Tom gives", "Eva gives").replace("does Tom", "does Kim")), (7, long[:60]),
            (8, apples.upper()), (9, "New York City Hall is old. " + trip)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", text_key())
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in template_decontamination.contaminated(docs, bench).collect()}
    assert got == brute_contaminated(rows, items)
    assert {(1, 1), (2, 1), (3, 2), (4, 3), (8, 1), (9, 2)} <= got and not {(5, 2), (7, 3)} & got


def test_decontamination_of_a_phrase_that_many_share(spark):
    """A window that every item and every document holds makes no candidates by itself."""
    phrase = "read the following question carefully and choose the best answer"
    bench = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"q{i}w{j}" for j in range(20))) for i in range(30)], "item_id long, text string")
    rows = [(i, f"{phrase} " + " ".join(f"d{i}w{j}" for j in range(30))) for i in range(40)]
    rows.append((100, "so " + bench.where("item_id = 7").first()["text"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", text_key())
    items = template_decontamination.item_windows(bench).cache()
    found = template_decontamination._hits(docs, items)
    aligned = template_decontamination.alignments(found, items)
    assert [(r["doc_id"], r["item_id"]) for r in aligned.select("doc_id", "item_id").distinct().collect()] == [(100, 7)]
    assert found.count() > 80


def test_decontamination_oracle_equals_brute_force(spark):
    import duckdb
    sums = "12 + 7 = 19, 30 + 5 = 35, 8 + 8 = 16, 40 + 2 = 42"
    given = rows_of(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))[:40]
    items = rows_of(spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text"))[:8] + [(-1, sums), (-2, "what is it"), (-3, None), (-4, "")]
    given += [(9000 + i, f"Note. {t} Then more.") for i, (_, t) in enumerate(items) if t] + [(9100, f"so {sums}"), (9101, sums.replace("12", "13")), (9102, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", given)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = con.execute(template_decontamination.ORACLE).fetchall()
    assert {(r[0], r[1]) for r in got} == brute_contaminated(given, items) and (9100, -1) in {(r[0], r[1]) for r in got}
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("k", text_key())
    mine = template_decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    best = mine.groupBy("doc_id", "item_id").agg(F.max("coverage"), F.max("n_slots"))
    assert set(rows_of(best)) == set(got)


def test_decontamination_odd_input(spark, docs):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    extra = docs.withColumn("k", F.lit("x")).withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    kept = template_decontamination.drop_contaminated(extra, bench)
    assert kept.columns == extra.columns and 0 < kept.count() <= docs.count()
    assert template_decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert template_decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ 2, SimHash

def brute_fingerprint(text) -> int:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(docs):
    got = simhash_pivots.near_duplicate_classes(docs, "doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in got]
    assert [r["fp"] & (1 << 64) - 1 for r in got] == prints
    parent = list(range(len(got)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(got)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(got):
        least[find(i)].append(r["doc_id"])
    for i, r in enumerate(got):
        ids = [x for x in least[find(i)] if x is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert len(got) == docs.count()


def test_simhash_crowded_buckets(spark):
    rng = random.Random(4)
    bases = [rng.getrandbits(64) for _ in range(5)]
    prints = {b ^ (1 << i) ^ (1 << j) for b in bases for i in range(30) for j in range(0, 64, 7)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(p - (p >> 63 << 64) for p in prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash_pivots.components(simhash_pivots.links(nodes)).collect()}
    parent = {p: p for p in prints}
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(roots.get(p, p) == find(p) for p in prints)


def test_simhash_keeps_one(docs):
    kept = simhash_pivots.keep_one(docs.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(None).cast("string")))
    classes = simhash_pivots.near_duplicate_classes(docs, "doc_id").select("component_id").distinct().count()
    assert kept.count() == classes and kept.columns == [*docs.columns, "fp", "component_id"]
    assert simhash_pivots.keep_one(docs.limit(0)).count() == 0


def test_simhash_keeps_each_class_of_a_repeated_id(spark):
    one, two = (" ".join(f"{a}{i}" for i in range(40)) for a in "xy")
    rows = [(5, one), (5, two), (6, one), (7, two), (5, one), (None, "some words without id here"), (None, "others " * 9)]
    kept = rows_of(simhash_pivots.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(kept, key=str) == sorted([(5, one), (5, two), rows[5], rows[6]], key=str)


# ------------------------------------------------------------------ 3, lines

def brute_cuts(rows: list[tuple]) -> dict:
    """Removed line numbers by (doc_id, text), by quadratic alignment."""
    def lines_of(text):
        seen, out = Counter(), []
        for n, line in enumerate(text.split("\n")):
            line = line.strip("\t\n\x0b\x0c\r ")
            if line:
                out.append((n, line, seen[line]))
                seen[line] += 1
        return out, seen

    def longest(pairs):  # quadratic; of equals the one whose matches come last, from its end
        size: list = []
        for i, p in enumerate(pairs):
            size.append(1 + max((size[j] for j in range(i) if pairs[j][1] < p[1]), default=0))
        out, need, upto = [], max(size, default=0), len(pairs)
        while need:
            upto = max(j for j in range(upto) if size[j] == need)
            out.append(pairs[upto])
            need -= 1
        return out[::-1]

    unique = sorted({(d, xxhash.xxh64_intdigest(t.encode(), 42), t) for d, t in rows if d is not None and t is not None},
                    key=lambda r: (r[0], r[1] - (r[1] >> 63 << 64)))
    first, out = {}, {}
    for d, _, t in unique:
        for rank, (_, line, occ) in enumerate(lines_of(t)[0]):
            first.setdefault((line, occ), (d, t, rank))
    holders = Counter(x[1:] for d, t in rows if d is not None and t is not None for x in lines_of(t)[0])
    for d, _, t in unique:
        lines, seen = lines_of(t)
        shared = [(rank, line, occ, first[line, occ][:2]) for rank, (_, line, occ) in enumerate(lines) if first[line, occ][:2] != (d, t)]
        rarest = min((holders[line, occ] for _, line, occ, _ in shared if len(words_of(line)) >= 5), default=0)
        rare_partner = [e if len(words_of(line)) >= 5 and holders[line, occ] <= 4 * rarest else None for _, line, occ, e in shared]
        pairs = defaultdict(list)
        for i, (rank, line, occ, own) in enumerate(shared):
            before = next((e for e in reversed(rare_partner[:i]) if e), None)
            after = next((e for e in rare_partner[i + 1:] if e), None)
            for e_d, e_t in {own, before, after} - {None}:
                there = {(x, o): r for r, (_, x, o) in enumerate(lines_of(e_t)[0])}
                if (line, occ) in there:
                    single = seen[line] == 1 and lines_of(e_t)[1][line] == 1
                    pairs[e_d, e_t].append((rank, there[line, occ], len(words_of(line)), single, holders[line, occ]))
        gone = set()
        for matches in pairs.values():
            strong = [m for m in matches if m[3] and m[2] >= 5]
            rare = min((m[4] for m in strong), default=0)
            anchors = longest([(m[0], m[1]) for m in strong if m[4] <= 4 * rare])
            aligned = []
            for low, high in zip([(-1, -1), *anchors], [*anchors, (10**9, 10**9)]):
                aligned += longest([(m[0], m[1]) for m in matches if low[0] < m[0] < high[0] and low[1] < m[1] < high[1]])
                aligned += [high] if high[0] < 10**9 else []
            blocks: list[list] = []
            for a in aligned:
                if blocks and a == (blocks[-1][-1][0] + 1, blocks[-1][-1][1] + 1):
                    blocks[-1].append(a)
                else:
                    blocks.append([a])
            size = {m[0]: m[2] for m in matches}
            for b in blocks:
                if sum(size[x] for x, _ in b) >= 5:
                    gone |= {lines[x][0] for x, _ in b}
        out[d, t] = gone
    return out


def line_fixture() -> list[tuple]:
    rng = random.Random(8)
    pool = [f"line {i} has these many words {rng.random():.3f}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < .7 else rng.choice(["", "short", f"own {i} {j} x y z"])
                          for j in range(rng.randrange(1, 9)))) for i in range(40)]
    return rows + rows[:2] + [(50, pool[0]), (51, pool[0] + "\r\n " + pool[1]), (52, "\n\n"), (51, "two texts of one id here")]


def test_lines_brute_force(spark, docs):
    rows = line_fixture() + [(r[0], r[1]) for r in odd_rows() if r[1] != LONG and r[0] != 8]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_cuts(rows)
    got = line_alignment.deduplicate_lines(df.withColumn("before", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want.get((r["doc_id"], r["before"]), set())
        assert r["_llm_n_removed"] == len(gone)
        assert r["text"] == (None if r["before"] is None else
                             "\n".join(x for i, x in enumerate(r["before"].split("\n")) if i not in gone))


def test_lines_repeated_within_a_document(spark):
    shared = "a license line of six words"
    rows = [(1, shared + "\nthe first text of all"), (2, f"{shared}\nanother text between the two\n{shared}"),
            (3, f"{shared}\na third text between the two\n{shared}"), (4, "yes\nno\nyes\nno\nyes\nno"), (5, "yes\nno\nyes\nno\nyes\nno")]
    got = {r["doc_id"]: r["text"] for r in line_alignment.deduplicate_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "another text between the two\n" + shared, 3: "a third text between the two",
                   4: rows[3][1], 5: ""}


def test_copies_of_short_and_of_frequent_lines_go(spark):
    verse = "\n".join(f"four words of line{i}" for i in range(100))
    body = [f"the body of number eleven has line {i} of its own" for i in range(4)]
    copied = "\n".join([*body[:2], "References", *body[2:], "Yes."])
    rows = [(1, verse), (2, verse), (9, "Yes.\nanother text of quite other words here"),
            (10, "something of other words entirely here\nReferences\nand a line that is its own"), (11, copied), (12, copied)]
    got = {r["doc_id"]: r["text"] for r in line_alignment.deduplicate_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 2: "", 12: ""}


def brute_runs(rows: list[tuple]) -> dict:
    """Line numbers by (doc_id, text) in a run of five words or more that any earlier document holds, by all pairs."""
    def lines_of(text):
        lines = [(n, line.strip("\t\n\x0b\x0c\r ")) for n, line in enumerate(text.split("\n"))]
        return [(n, line) for n, line in lines if line]

    unique = sorted({(d, xxhash.xxh64_intdigest(t.encode(), 42), t) for d, t in rows if d is not None and t is not None},
                    key=lambda r: (r[0], r[1] - (r[1] >> 63 << 64)))
    out = {}
    for i, (d, _, t) in enumerate(unique):
        mine, gone = lines_of(t), set()
        for theirs in (lines_of(e) for _, _, e in unique[:i]):
            for x in range(len(mine)):
                for y in range(len(theirs)):
                    n = 0
                    while x + n < len(mine) and y + n < len(theirs) and mine[x + n][1] == theirs[y + n][1]:
                        n += 1
                    if sum(len(words_of(line)) for _, line in mine[x:x + n]) >= 5:
                        gone |= {m for m, _ in mine[x:x + n]}
        out[d, t] = gone
    return out


def runs_fixture() -> list[tuple]:
    rng = random.Random(9)
    pool = [f"w{i} " * rng.choice([1, 1, 2, 3, 5, 6]) for i in range(14)]
    return [(i // 2, "\n".join(rng.choice(pool) if rng.random() < .9 else rng.choice(["", f"own{i}"])
                               for _ in range(rng.randrange(1, 12)))) for i in range(120)]


def test_lines_that_no_partner_holds_in_order_go(spark, tmp_path):
    a, b, c = (f"the line {x} has some seven words" for x in "abc")
    moved = [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n{a}\n{b}"), (3, f"{b}\n{c}\n{a}\nthese words are its own here\n{a}"),
             (4, "two words\nSee\nmore of"), (5, "See\nwhat is its own text\ntwo words\nSee\nmore of")]
    rows = [(d + 1000, t) for d, t in moved] + runs_fixture() + line_fixture()
    want = brute_runs(rows)
    assert any(want[r] > brute_cuts(rows)[r] for r in want)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d, t]) for d, t in rows}
    assert [kept[d + 1000, t] for d, t in moved] == [moved[0][1], "", "these words are its own here", moved[3][1],
                                               "See\nwhat is its own text"]
    got = rows_of(line_alignment.op3_line_alignment(spark, str(tmp_path)))
    assert Counter(got) == Counter((d, t.count("\n") + 1, len(want[d, t]), hashlib.sha256(kept[d, t].encode()).hexdigest())
                                   for d, t in rows)


def test_lines_odd_input(docs):
    extra = docs.withColumn("h", F.lit(1)).withColumn("line", F.lit(2)).withColumn("k", F.lit(3)).withColumn("kept", F.lit(4))
    cut = line_alignment.cut_common_lines(extra)
    assert cut.columns == extra.columns
    left = {r["doc_id"]: r for r in cut.collect()}
    assert left[7]["text"] == LONG and left[8]["text"] == "the end of it all" and left[8]["n_chars"] == 17
    assert 1 in left and left[1]["text"] is None and 2 in left and 5 not in left
    assert line_alignment.cut_common_lines(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 4, quality

def brute_stats(text) -> tuple:
    words = words_of(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def tree_walk(model, features) -> float:
    total = 0.0
    for f, v, c, n in zip(model.feature, model.value, model.child, model.length):
        at = 0
        for _ in range(model.depth):
            at = int(c[at][int(features[f[at]] >= v[at])])
        total += n[at]
    return 2 ** (-total / len(model.feature) / model.norm)


def test_quality_brute_force(docs, labels):
    stats = quality_forest.rule_statistics(docs)
    model = quality_forest.fit(stats, labels)
    assert model.cutoff < 1
    texts = {(r["doc_id"], brute_stats(r["text"])): r["text"] for r in docs.collect()}
    got = quality_forest.judge(stats, model).collect()
    assert len(got) == docs.count()
    for r in got:
        key = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        text = texts[r["doc_id"], key]
        failed = key[0] < 20 or 100 * key[4] > 30 * key[0]
        score = tree_walk(model, quality_forest.text_stats(text)[5])
        assert r["base_failed"] == failed and abs(score - r["anomaly"]) < 1e-9
        assert r["kept"] == (not failed and int(score * quality_forest.BINS) / quality_forest.BINS < model.cutoff)
    kept = Counter(r["doc_id"] for r in got if r["kept"])
    extra = docs.withColumn("features", F.lit(1)).withColumn("quality", F.lit(2))
    stage = quality_forest.keep_good(extra, labels)
    assert stage.columns == extra.columns and Counter(r["doc_id"] for r in stage.collect()) == kept


def test_quality_without_labels(docs, labels):
    got = quality_forest.assess(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert quality_forest.assess(docs.limit(0), labels).count() == 0


def test_quality_recovers_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_forest.assess(docs, labels).join(labels, "doc_id").where(~F.col("base_failed"))
    good = got.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = got.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and bad < 0.1


# ------------------------------------------------------------------ 5, language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    sure = [r for r in held if r["accepted"]]
    assert sum(r["lang_pred"] == r["lang"] for r in sure) / len(sure) > 0.98


def test_language_subwords_by_hand():
    for text in ("Añb 12c", "  Étude--für DICH!! ", "x", "ab  cd", "ǅ ß İ 漢字", "a1b2"):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        spaced = re.sub(" +", " ", f" {letters} ")
        want: Counter = Counter()
        for order in (1, 2, 3, 4):
            for i in range(len(spaced) - order + 1):
                h = 0
                for c in spaced[i:i + order]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                want[((h + order) * 0x9E3779B97F4A7C15 % 2**64) >> 50] += 1
        got = language_id.subword_counts(text)
        assert {i: int(n) for i, n in enumerate(got) if n} == want
    assert language_id.subword_counts("12 ?!") is None and language_id.subword_counts(None) is None


def test_language_training_by_hand():
    """Two epochs over three rows, written out value by value, and the forward pass of a prediction."""
    width = language_id.WIDTH
    rows = [(np.array([1, 5]), np.array([0.25, 0.75]), "en"), (np.array([5, 9]), np.array([0.5, 0.5]), "de"), (np.array([2]), np.array([1.0]), "en")]
    model = language_id.train(rows, epochs=2, rate=0.5, seed=11)
    rng = np.random.default_rng(11)
    order = rng.permutation(3)
    table = {b: v for b, v in enumerate(rng.normal(0, 0.1, (language_id.BUCKETS, width)).tolist()) if b in (1, 2, 5, 9)}
    weights, bias = rng.normal(0, 0.1, (width, 2)).tolist(), [0.0, 0.0]
    for epoch in range(2):
        step = 0.5 / (1 + epoch)
        for i in rng.permutation(order):
            buckets, share, language = rows[i]
            mean = [sum(s * table[b][w] for b, s in zip(buckets.tolist(), share.tolist())) for w in range(width)]
            z = [sum(mean[w] * weights[w][k] for w in range(width)) + bias[k] for k in range(2)]
            e = [math.exp(x) for x in z]
            error = [x / sum(e) - (k == ("de", "en").index(language)) for k, x in enumerate(e)]
            back = [sum(weights[w][k] * error[k] for k in range(2)) for w in range(width)]
            for w in range(width):
                for k in range(2):
                    weights[w][k] -= step * mean[w] * error[k]
            bias = [b - 0.1 * step * x for b, x in zip(bias, error)]
            for b, s in zip(buckets.tolist(), share.tolist()):
                table[b] = [v - step * s * x for v, x in zip(table[b], back)]
    assert model.languages == ["de", "en"] and np.allclose(model.bias, bias)
    for b, v in table.items():
        assert np.allclose(model.logits[b], [sum(v[w] * weights[w][k] for w in range(width)) for k in range(2)])
    counts = np.zeros(language_id.BUCKETS)
    counts[[1, 9]] = 3, 1
    z = [(0.75 * model.logits[1][k] + 0.25 * model.logits[9][k] + bias[k]) / model.temperature for k in range(2)]
    name, score = model.predict(counts)
    assert name == ("de", "en")[int(z[1] > z[0])] and abs(score - 1 / (1 + math.exp(-abs(z[0] - z[1])))) < 1e-12


def test_language_learns_from_the_rest_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language_id.fit(docs), language_id.fit(wrong)
    assert a.languages == b.languages and np.array_equal(a.logits, b.logits)


def test_language_odd_input(docs):
    extra = docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.predict(extra, language_id.fit(extra)).collect()}
    assert {(1, True), (2, True), (3, True), (13, True), (9, False), (14, False), (None, True), (None, False)} <= got
    assert all(r["lang_pred"] == "und" for r in language_id.predict(docs, None).collect())
    assert language_id.fit(docs.limit(0)) is None and language_id.predict(docs.limit(0), None).count() == 0


# ------------------------------------------------------------------ 6, substrings

def brute_repeats(rows, span=50) -> list[tuple]:
    first: dict = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - span + 1):
            if d is not None:
                key = tuple(w[i:i + span])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {i + j for i in range(len(w) - span + 1) if d is not None and first[tuple(w[i:i + span])] < d
                for j in range(span)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passage_fixture() -> list[tuple]:
    rng = random.Random(2)
    passages = [[f"q{p}_{i % (9 if p == 2 else 500)}" for i in range(n)] for p, n in enumerate((50, 51, 80, 49, 300))]
    rows = []
    for d in range(60):
        w: list = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"u{d}_{i}" for i in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            w += p[rng.randrange(0, 5):len(p) - rng.randrange(0, 5)]
        rows.append((d, " ".join(w)))
    return rows + rows[:3] + [(3, rows[7][1]), (None, rows[0][1])]


def test_substrings_brute_force(spark, docs):
    rows = passage_fixture() + [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("h", F.lit(2))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.cut_repeats(df).collect()]
    assert Counter(got) == Counter(brute_repeats(rows))
    assert substring_dedup.cut_repeats(df.limit(0)).count() == 0


def test_query_digest_of_substrings(spark):
    rows = rows_of(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))
    want = {(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute_repeats(rows)}
    assert set(rows_of(substring_dedup.op6_substring_dedup(spark, DIR))) == want


# ------------------------------------------------------------------ 7, tokens

def test_token_counts(docs):
    tokenizer = token_counts._tokenizer("word_bpe_49k.json")
    got = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("x"))).collect()
    want = []
    for r in docs.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    assert Counter(map(tuple, got)) == Counter(want)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [
    "a" * 5000, "ab cd" * 10 + "x" * 3000 + " q w e", "<|endoftext|> hi <|startoftext|>x " * 200, "é́ ö̈" * 500,
    "don't we'll " * 400, "　全角 文字 " * 300, "\x1c a\x85b " * 400, "1234567890" * 300, " \n\t " * 800, "İstanbul ẞß " * 300])
def test_spliced_chunks(text):
    tokenizer = token_counts._tokenizer("word_bpe_49k.json")
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    for chunk, overlap in ((64, 8), (100, 16), (1000, 100)):
        assert token_counts.count_long(tokenizer, text, chunk, overlap) == want


# ------------------------------------------------------------------ 8, pages

SHELL = ('<html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>'
         '<nav><a href="/">menu</a></nav><div class="ad">buy</div>{}<footer>&copy; foot</footer></body></html>')


def pages_fixture() -> list[tuple]:
    rows = [(i, f"https://a.example/{i}", SHELL.format(
        f"<article><h1>Head {i}</h1><p>Same words on every page.</p><p>Fish &amp; <b>chips</b>\n number {i}<br>next"
        f"<div><i>Follow us</i> now</div><ul><li>one<li>two {i}</ul><div class='comments'><article class='comment'>me too"
        f"</article></div></article>")) for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", f"<div>Welcome to the site</div><div><p>Text {i} of b that is rather long"
              f"</p><p>more</p></div><aside>side</aside><form>f</form>") for i in range(6)]
    return rows + [(40, None, "<p>no host</p>"), (41, "https://c.example/", None), (42, "bad url", ""), (None, None, None),
                   (43, "https://c.example/2", "plain &lt;text&gt; a&nbsp;b"), (44, "https://c.example/3", "<p>cut off <a hr"),
                   (45, "https://c.example/4", "<main><div>" * 3000 + "deep" + "</div></main>" * 10),
                   (46, "https://c.example/5", "<article><p>x" + " long" * 50_000 + "</article>"), rows[0]]


def test_pages(spark):
    df = spark.createDataFrame(pages_fixture(), "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = site_templates.extract(df).collect()
    assert len(got) == df.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(8):
        assert text[i] == f"Head {i} Same words on every page. Fish & chips number {i} next one two {i}"
    for i in range(6):
        assert text[20 + i] == f"Text {i} of b that is rather long"
    assert (text[40], text[41], text[42], text[None]) == ("no host", "", "", "")
    assert (text[43], text[44], text[45]) == ("plain <text> a b", "cut off", "deep") and len(text[46]) == 250_001
    assert site_templates.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    from html import unescape
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    text = {r["page_id"]: r["text"] for r in site_templates.extract(pages).collect()}
    for r in pages.collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))
        assert text[r["page_id"]] == " ".join(unescape(body).split())


def test_copies_of_a_page_are_no_template(spark):
    block = "<div>{} block of the article with its own words</div>"
    body = "".join(block.format(x) for x in ("first", "second", "third"))
    shell = "<html><body><div>Site motto here</div>{}</body></html>"
    rows = [(i, f"https://m.example/{i}?print", shell.format(f"<article>{body}</article>")) for i in range(6)]  # marked
    rows += [(10 + i, f"https://n.example/{i}", shell.format(body.replace("div", "p"))) for i in range(6)]  # not marked
    rows += [(20 + i, f"https://o.example/{i}", shell.format(f"<article>{body}<p>copy {i}</p></article>")) for i in range(6)]
    rows += [(30 + i, f"https://p.example/{i}", shell.format(f"<div>text number {i} that is not short at all</div>"))
             for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in site_templates.extract(pages).collect()}
    want = " ".join(f"{x} block of the article with its own words" for x in ("first", "second", "third"))
    for i in range(6):
        assert text[i] == want and text[20 + i] == f"{want} copy {i}"
        assert text[10 + i] == f"Site motto here {want}"
    assert all(text[30 + i] == f"text number {i} that is not short at all" for i in range(12))
    # a block on 12 of 240 distinct pages: template by the number of pages alone, not by half of them
    many = [(i, f"https://q.example/{i}", shell.format(f"<div>a long enough text number {i} of the host</div>"
             + ("<div>on twelve</div>" if i < 12 else ""))) for i in range(240)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string")
    for share, kept in ((0.5, True), (0.001, False)):
        text = {r["page_id"]: r["text"] for r in site_templates.extract(pages, min_share=share).collect()}
        assert ("on twelve" in text[3]) == kept and "motto" not in text[3]


def brute_texts(rows: list[tuple]) -> dict:
    """Texts by (page_id, url, html) from plain counts of subtrees over the distinct main texts of each host."""
    def host_of(url):
        found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
        return found[1].lower() if found else ""
    holders, mains = defaultdict(set), defaultdict(set)
    for _, url, markup in rows:
        page = site_templates.read_page(markup or "")
        main = site_templates.main_text(page, {})
        mains[host_of(url)].add(main)
        for h, prose in site_templates.template_candidates(page):
            holders[host_of(url), h, prose].add(main)
    template = defaultdict(dict)
    for (site, h, prose), texts in holders.items():
        if len(texts) >= (max(10, 0.5 * len(mains[site])) if prose else max(5, 0.001 * len(mains[site]))):
            template[site][h, prose] = len(texts)
    out = {}
    for row in rows:
        page = site_templates.read_page(row[2] or "")
        own = {c[0]: template[host_of(row[1])][c] for c in site_templates.template_candidates(page) if c in template[host_of(row[1])]}
        out[row] = site_templates.main_text(page, own)
    return out


def test_template_counts_brute_force(spark):
    shell = "<html><body><nav>menu of the site</nav>{}<footer>foot</footer></body></html>"
    notice = "<p>Subscribe now for our weekly letter</p>"
    own = "<p>paragraph {0} of an article that has words of its own, number {0}</p><p>and a second one, {0} again</p>"
    rows = [(i, f"https://a.example/{i}", shell.format(f"<article>{own.format(i)}{notice}</article>")) for i in range(20)]
    # copies of one article under many addresses, and revisions of one article among other pages, stay whole
    rows += [(100 + i, f"https://b.example/{i}", shell.format(f"<article>{own.format('same')}</article>")) for i in range(9)]
    rows += [(200 + i, f"https://c.example/{i}", shell.format(f"<article>{own.format(i if i > 8 else 'old')}<p>edition {i}</p></article>"))
             for i in range(30)]
    # a block without class on some pages of a host, inside and outside of marked content
    rows += [(300 + i, f"https://d.example/{i}", shell.format(f"<div>{own.format(i)}</div>" + ("<div>read also our blog</div>" if i % 3 else "")))
             for i in range(24)]
    rows += [(400 + i, None if i % 2 else "no address", shell.format(f"<main>{own.format(i)}<div>shared box</div></main>")) for i in range(12)]
    rows += [rows[0], (0, rows[1][1], rows[2][2]), (500, "https://a.example/x", None), (501, "https://a.example/y", "")]
    got = site_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k", F.lit("x")))
    want = brute_texts(rows)
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect()) == Counter(
        (r[0], r[1], want[r], len(want[r])) for r in rows)
    text = {r[0]: want[r] for r in rows}
    assert all("Subscribe" not in want[r] and "second one" in want[r] for r in rows[:20])
    assert all("second one, same" in text[100 + i] for i in range(9))
    assert all(f"edition {i}" in text[200 + i] and "second one, old" in text[200 + i] for i in range(9))
    assert "our blog" not in text[301] and "shared box" not in text[401]


# ------------------------------------------------------------------ 9, transcripts

def test_transcripts_equal_one_viterbi_pass(spark, monkeypatch):
    monkeypatch.setattr(transcript_hmm, "BLOCK", 8)
    talk = spark.read.parquet(f"{DIR}/conversations.parquet")
    talk = talk.withColumn("role", F.when(F.xxhash64("text") % 3 == 0, F.lit(None)).otherwise(F.col("role")))
    talk = talk.withColumn("turn", F.col("conv_id") * 10 + F.col("turn")).withColumn(
        "conv_id", F.when(F.col("conv_id") % 2 == 0, F.lit(None)).otherwise(F.lit(5))).withColumn("part", F.lit("x"))
    rows = sorted(rows_of(talk.select("conv_id", "turn", "role", "text")), key=lambda r: (r[0] is not None, r[1]))
    got = defaultdict(list)
    for r in transcript_hmm.parse_transcripts(talk).collect():
        got[r["conv_id"], r["turn"]].append(r)
    model = transcript_hmm.learn(transcript_hmm._observed(talk))
    for conv in (None, 5):
        codes, states = [], []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            codes += transcript_hmm.observe(role, text)[0]
            parts = sorted(got[conv, turn], key=lambda r: r["part"])
            assert "\n".join(p["text"] for p in parts) == text
            states += [transcript_hmm.ROLES.index(p["role"]) for p in parts for _ in p["text"].split("\n")]
        scored, best = own_viterbi(counted_by_hand(rows), codes, states)
        assert scored == best == transcript_hmm.path_score(model, codes, transcript_hmm.viterbi(model, codes))


def counted_by_hand(rows: list[tuple]):
    """Log probabilities in 2**-20 from counts plus one: openings, changes, features; ``rows`` are in order."""
    names = {"system": 0, "user": 1, "assistant": 2}
    first, change, feature = Counter(), Counter(), Counter()
    before, conversation = None, "none yet"
    for conv, _, role, text in rows:
        known = names.get((role or "").strip().lower())
        if known is not None:
            if conv != conversation:
                first[known] += 1
            elif before is not None:
                change[before, known] += 1
            for i, line in enumerate((text or "").split("\n")):
                feature[known, (4 if i == 0 else 0) + (2 if "?" in line[-3:] else 0) + (len(line) > 200)] += 1
        before, conversation = known, conv

    def log(part, whole):
        return int(np.round(np.log(part / whole) * (1 << 20)))
    return ([log(first[r] + 1, sum(first.values()) + 3) for r in range(3)],
            [[log(change[a, b] + 1, sum(change[a, x] for x in range(3)) + 3) for b in range(3)] for a in range(3)],
            [[log(feature[r, f] + 1, sum(feature[r, x] for x in range(8)) + 8) for f in range(8)] for r in range(3)])


def own_viterbi(counts, codes: list[int], states: list[int]) -> tuple[int, int]:
    """(score of ``states``, best score) by a plain dynamic program over dictionaries."""
    first, change, feature = counts

    def log(p):
        return int(np.round(np.log(p) * (1 << 20)))

    def seen(state, code):
        marker = code % 64 // 8 - 1
        return feature[state][code % 8] + (0 if marker < 0 else log(0.97) if marker == state else log((1 - 0.97) / 2))

    def move(a, b, code):
        return change[a][b] if code >= 64 else log(0.999) if a == b else log((1 - 0.999) / 2)
    best = {s: first[s] + seen(s, codes[0]) for s in range(3)}
    total = best[states[0]]
    for i, code in enumerate(codes[1:], 1):
        best = {b: max(best[a] + move(a, b, code) for a in range(3)) + seen(b, code) for b in range(3)}
        total += move(states[i - 1], states[i], code) + seen(states[i], code)
    return total, max(best.values())


def test_openings_are_first_rows_alone(spark):
    """A row without a role opens every conversation: no known role does."""
    rows = [(c, t, (None, "assistant", "user\n")[t], f"text {t}") for c in range(50) for t in range(3)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    model = transcript_hmm.learn(transcript_hmm._observed(given))
    first, change, feature = counted_by_hand(rows)
    assert len(set(first)) == 1 and model.first.tolist() == first
    assert model.change.tolist() == change and model.feature.tolist() == feature


def test_a_long_conversation_is_many_blocks_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(transcript_hmm, "BLOCK_CHARS", 500)
    rows = [(1, t, ("user", "assistant", None)[t % 3], ("why? " if t % 2 else "so ") * 30) for t in range(60)] + [(2, 0, "user", "y" * 2000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    seen = transcript_hmm._observed(given)
    sizes = seen.groupBy("part", "block").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert len(sizes) > 12 and all(r["n"] <= 500 or r["rows"] == 1 for r in sizes)
    got = {r["turn"]: r["role"] for r in transcript_hmm.parse_transcripts(given).where("conv_id = 1").collect()}
    codes = [c for _, _, role, text in rows[:-1] for c in transcript_hmm.observe(role, text)[0]]
    scored, best = own_viterbi(counted_by_hand(rows), codes, [transcript_hmm.ROLES.index(got[t]) for t in range(60)])
    assert scored == best


def test_transcript_markers_and_odd_input(spark):
    rows = [(1, 0, None, "User: hello?\nand more\nAssistant: hi there\nUSER: bye"), (2, None, "user", None), (2, 0, "bot", ""),
            (None, None, None, None), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "stranger", "Note: not a speaker"),
            (5, 0, "system", "<|im_start|>user\nhey"), (6, 0, "user", "x\n" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = transcript_hmm.parse_transcripts(df).collect()
    one = [(r["role"], r["text"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["part"])]
    assert one == [("user", "hello?\nand more"), ("assistant", "hi there"), ("user", "bye")]
    assert sum(r["conv_id"] == 3 for r in got) == 2 and {r["conv_id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert next(r for r in got if r["conv_id"] == 4)["text"] == "Note: not a speaker"
    assert all(r["rendered"] == f"<|im_start|>{r['role']}\n{r['text']}<|im_end|>" for r in got)
    assert transcript_hmm.parse_transcripts(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 10, packing

def check_packing(rows: list, given: list[tuple]) -> None:
    """Every piece once, whole documents, gapless sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in given:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(config_packing, "BLOCK", 7)
    odd = spark.createDataFrame([(600, "x <|endoftext|> y"), (601, "a\x85b\x1c c᠎d e"), (602, "日本語 текст")],
                                "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).withColumn("length", F.lit("x")).withColumn("rank", F.lit(1))
    rows = config_packing.pack_documents(df).collect()
    check_packing(rows, rows_of(df.select("doc_id", "text")))
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert config_packing.pack_documents(df.limit(0)).count() == 0


def test_ranks_over_many_spans_of_blocks(spark, monkeypatch):
    """One length held by all rows, in many blocks of many spans: every place is taken once."""
    monkeypatch.setattr(config_packing, "BLOCK", 4)
    monkeypatch.setattr(config_packing, "SPAN", 3)
    rows = [(i, 0, 0, 700 if i % 5 else 300, i) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = config_packing.pack(table).collect()
    taken = defaultdict(list)
    for r in got:
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 500 and all(sum(n for _, n in t) <= 2048 for t in taken.values())
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n


def test_plan_covers_histograms():
    rng = random.Random(1)
    for _ in range(20):
        capacity = rng.choice((10, 64, 200))
        histogram = {rng.randrange(1, capacity + 1): rng.choice((1, 2, 50, 1000)) for _ in range(rng.randrange(1, 30))}
        plan = config_packing.plan(histogram, capacity)
        got = Counter()
        for pattern, n in plan:
            assert n > 0 and sum(pattern) <= capacity
            for length in pattern:
                got[length] += n
        assert got == Counter(histogram)
        slots = config_packing.Slots(plan)
        lengths = np.array([k for k, v in histogram.items() for _ in range(v)])
        ranks = np.concatenate([np.arange(v) for v in histogram.values()])
        sequence, offset = slots.place(lengths, ranks)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(lengths)
        assert len(set(sequence.tolist())) == sum(n for _, n in plan)


def test_plan_is_near_the_linear_program_on_few_lengths():
    # (histogram, optimum of the configuration LP rounded up): 1030 + 680 + 300 fit, pieces over half stand alone
    for histogram, bound in (({1030: 3000, 680: 3000, 300: 3000}, 3000), ({1030: 90, 680: 90, 300: 90}, 90),
                             ({700: 1000, 600: 1000, 500: 1000, 248: 1000}, 1000)):
        assert sum(n for _, n in config_packing.plan(histogram)) <= 1.005 * bound
    # no pattern fills a sequence to the brim: judged by the dual bound
    histogram = {700: 100, 500: 300, 350: 100, 400: 77, 1100: 200}
    *_, (_, bound) = config_packing.fractional_plans(histogram)
    volume = sum(k * n for k, n in histogram.items()) / 2048
    assert volume < bound <= sum(n for _, n in config_packing.plan(histogram)) <= 1.01 * bound
