"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts are cut into words and canonicalised: a capitalised word after a lower-case letter, comma or semicolon becomes
``<name>``, a word that starts with a digit ``<num>``, a unit after a number ``<unit>``; the rest is lower-cased and
stripped of punctuation. Neighbouring names are one slot ("New York"), as are the groups of a spaced number ("1 200").
A capitalised word that opens a sentence is a name in a text that does not also hold it in lower case; as that differs
between a question and the text around its copy, windows of the benchmark are hashed with such words both as names and
as they are.

Windows of ``WINDOW`` canonical words of the benchmark are hash-joined with the windows of all documents. Offsets
(document position minus item position) that lie within ``SHIFT`` words of each other are chained, so a slot that changes
its number of words or an inserted word does not break a match. A document holds an item if the windows of one offset or
one chain cover at least ``MIN_COVERAGE`` of the item's windows and the slots agree: over the words of matching windows,
equal slot values of the item stand for equal values in the document and different ones for different values. So a
question with its numbers or names replaced throughout is caught, and prose of the same shape with unrelated values is
not.

Items shorter than a window are matched as one window of their own length. Windows of the benchmark with less than half
literal words are too general and are skipped; an item that has no other windows (sums, tables, lists of names) is
matched by the raw words of its windows, so its exact copies are found and texts of the same shape are not.

A match needs a share of the item's windows, so each holds one of the item's rarest: only those make candidates, and
only for candidates are the other windows looked up. A phrase that many items and many documents share joins nothing by
itself. The hashes of the benchmark are broadcast if there are at most ``BROADCAST_ROWS`` of them (8 bytes each), else
joined by shuffle.

Defined results: null and empty texts hold nothing and are held by nothing; rows with a null ``doc_id`` take part, with
their null id; repeated rows and items give one result row per pair of ids; of several matches of a pair the best coverage
and, of equals, most slots count; a text of any length is cut into words whole, in one task; an empty benchmark or corpus
gives an empty result; extra columns pass through ``drop_contaminated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import stored, text_key

WINDOW = 8
MIN_COVERAGE = 0.5
SHIFT = 3
BROADCAST_ROWS = 1_000_000
#: Marks before words: a name, a capitalised word that opens a sentence.
NAME, OPENER = "\u0001", "\u0002"

#: Units that become a placeholder after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs second seconds minute minutes hour hours "
         "day days week weeks month months year years percent eur usd gbp euro euros dollar dollars pound pounds cent "
         "cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram "
         "kilograms litre litres liter liters jahre tage stunden minuten heures jours ans horas dias metros").split()

# (pattern, replacement) in the order in which they are applied to a text; $1 and $2 are groups.
_MARKS = [(r"([\p{Ll},;][ \n])(\p{Lu}\p{Ll}+)", f"$1{NAME}$2"), (r"(^|[.!?:][ \n])(\p{Lu}\p{Ll}+)", f"$1{OPENER}$2"),
          *[(r"([\x01\x02][^ \n]*\p{Ll}) (\p{Lu}\p{Ll}+)", f"$1{NAME}$2")] * 3]
_PLAIN = (r"[^\p{L}\p{N}\x20\x09-\x0D\x01\x02]+", "")
_SPACES = (r"[\x20\x09-\x0D]+", " ")
_NUMBERS = [(r"(\p{Nd}) (\p{Nd}{3})\b", "$1$2")] * 2


def words(text: str | Column) -> Column:
    """Words of a text, lower-case without punctuation, with marks."""
    col = F.col(text) if isinstance(text, str) else text
    for pattern, by in [*_MARKS, _PLAIN]:
        col = F.regexp_replace(col, pattern, by)
    col = F.regexp_replace(F.lower(col), *_SPACES)
    for pattern, by in _NUMBERS:
        col = F.regexp_replace(col, pattern, by)
    return F.split(F.trim(col), " ", -1)


def plain(word: Column) -> Column:
    """A word without marks."""
    return F.translate(word, NAME + OPENER, "")


def _is_number(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}")


def _is_unit(tokens: Column, word: Column, i: Column) -> Column:
    return word.isin(UNITS) & (i > 0) & F.coalesce(_is_number(F.get(tokens, i - 1)), F.lit(False))


def openers(tokens: Column) -> Column:
    """Marked openers of a text that it does not hold in lower case."""
    return F.array_except(F.filter(tokens, lambda w: w.startswith(OPENER)), F.transform(tokens, lambda w: F.concat(F.lit(OPENER), w)))


def _hashes(tokens: Column, names: Column | None) -> Column:
    """Hash of each canonical word; ``names`` are the openers that count as names."""
    def one(w: Column, i: Column) -> Column:
        name = w.startswith(NAME) if names is None else w.startswith(NAME) | (w.startswith(OPENER) & F.array_contains(names, w))
        return (F.when(name, F.xxhash64(F.lit("<name>"))).when(_is_number(w), F.xxhash64(F.lit("<num>")))
                .when(_is_unit(tokens, w, i), F.xxhash64(F.lit("<unit>"))).otherwise(F.xxhash64(plain(w))))
    return F.transform(tokens, one)


def _literals(tokens: Column) -> Column:
    """1 for each word that is no slot, 0 for slots; openers count as slots, whatever the text around them holds."""
    return F.transform(tokens, lambda w, i: F.when(w.startswith(NAME) | w.startswith(OPENER) | _is_number(w) | _is_unit(tokens, w, i), 0)
                       .otherwise(1))


def _window_hash(hashes: str, i: Column, size: Column | int, *more: Column) -> Column:
    """Hash of ``size`` elements from ``i``; elements beyond are null and do not count."""
    one = [F.get(F.col(hashes), i + j) if isinstance(size, int) else F.when(size > j, F.get(F.col(hashes), i + j))
           for j in range(size if isinstance(size, int) else WINDOW)]
    return F.xxhash64(*one, *more)


def _window_sum(values: str, i: Column, size: int) -> Column:
    total = F.lit(0)
    for j in range(size):
        total = total + F.get(F.col(values), i + j)
    return total


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, size, i, h, raw, total) of every benchmark item: the hashes by which its window ``i`` is found."""
    items = (benchmark.where(F.col("text").isNotNull()).select("item_id", words("text").alias("words"))
             .where(F.element_at("words", 1) != "").distinct()
             .withColumn("size", F.least(F.lit(WINDOW), F.size("words")))
             .withColumn("lit", _literals(F.col("words"))).withColumn("plain", F.transform("words", lambda w: F.xxhash64(plain(w))))
             .withColumn("canon", _hashes(F.col("words"), None)))
    each = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    part = F.slice("lit", F.col("i") + 1, F.col("size"))
    each = each.withColumn("general", 2 * F.aggregate(part, F.lit(0), lambda a, x: a + x) < F.col("size"))
    total = each.groupBy("item_id", "words").agg(
        F.every("general").alias("raw"), F.count("*").alias("n"), F.count_if(~F.col("general")).alias("n_literal"))
    each = (each.join(total, ["item_id", "words"]).where(F.col("raw") | ~F.col("general"))
            .withColumn("total", F.when(F.col("raw"), F.col("n")).otherwise(F.col("n_literal"))))
    # openers of a window as names and as they are: every choice for two of them, all or none for more
    open_at = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.get(F.col("words"), F.col("i") + j).startswith(OPENER))
    each = each.withColumn("open", open_at)
    full = F.call_function("shiftleft", F.lit(1), F.size("open")) - 1
    choices = F.when(F.col("raw"), F.array(F.lit(0))).when(F.size("open") <= 2, F.sequence(F.lit(0), full)).otherwise(F.array(F.lit(0), full))
    each = each.withColumn("choice", F.explode(choices))
    chosen = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.when(
        F.array_contains("open", j) & (F.call_function("shiftright", F.col("choice"), F.array_position("open", j).cast("int") - 1)
                                      .bitwiseAND(F.lit(1)) == 1),
        F.xxhash64(F.lit("<name>"))).otherwise(F.get(F.col("canon"), F.col("i") + j)))
    each = each.withColumn("chosen", chosen)
    h = (F.when(F.col("raw"), _window_hash("plain", F.col("i"), F.col("size"), F.lit("raw")))
         .otherwise(_window_hash("chosen", F.lit(0), F.col("size"))))
    return each.select("item_id", "words", "size", "i", h.alias("h"), "raw", "total").distinct()


def document_windows(docs: DataFrame, sizes: list[int], raw_sizes: list[int]) -> DataFrame:
    """(doc_id, k, at, h) of all windows of the given sizes, by canonical words and, where general, by raw words."""
    # each array is computed once, below a generator; windows are hashed from their elements
    tokens = docs.select("doc_id", "k", F.explode(F.array(words("text"))).alias("words"))
    tokens = tokens.select("doc_id", "k", "words", F.explode(F.array(openers(F.col("words")))).alias("names"))
    arrays = [_hashes(F.col("words"), F.col("names")).alias("canon")]
    if raw_sizes:
        arrays += [F.transform("words", lambda w: F.xxhash64(plain(w))).alias("plain"), _literals(F.col("words")).alias("lit")]
    made = tokens.select("doc_id", "k", F.explode(F.array(F.struct(*arrays))).alias("made")).select("doc_id", "k", "made.*")

    def places(size: int) -> Column:
        return F.when(F.size("canon") >= size, F.sequence(F.lit(0), F.size("canon") - size)).otherwise(F.array().cast("array<int>"))
    out = None
    for size in sizes:
        part = made.select("doc_id", "k", "canon", F.explode(places(size)).alias("at")).select(
            "doc_id", "k", "at", _window_hash("canon", F.col("at"), size).alias("h"))
        out = part if out is None else out.unionByName(part)
    for size in raw_sizes:
        # the first word of an item may be literal there and a slot here, after other words
        part = (made.select("doc_id", "k", "plain", "lit", F.explode(places(size)).alias("at"))
                .where(2 * _window_sum("lit", F.col("at"), size) < size + 2)
                .select("doc_id", "k", "at", _window_hash("plain", F.col("at"), size, F.lit("raw")).alias("h")))
        out = part if out is None else out.unionByName(part)
    return out


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Stored (doc_id, k, at, h) of the document windows that the benchmark holds; None for an empty benchmark."""
    kinds_of = items.select("raw", "size").distinct().collect()  # at most twice ``WINDOW``
    if not kinds_of:
        return None
    sizes, raw_sizes = (sorted(r["size"] for r in kinds_of if r["raw"] == raw) for raw in (False, True))
    wanted = items.select("h").distinct()
    if items.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return stored(document_windows(docs, sizes, raw_sizes).join(wanted, "h", "left_semi"), "benchmark-hits")


def alignments(found: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, k, item_id, item_words, size, n, total, places): offsets and chains of offsets that cover enough of an
    item; places are structs (i, offset)."""
    frequency = found.groupBy("h").agg(F.count("*").alias("df"))
    ranked = items.join(frequency, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # a window counts once, by the sum over the hashes it may be found by
    weight = ranked.groupBy("item_id", "words", "total", "i").agg(F.sum("df").alias("df"))
    place = F.row_number().over(Window.partitionBy("item_id", "words").orderBy("df", "i"))
    needed = F.greatest(F.lit(1), F.ceil(min_coverage * F.col("total")))
    rarest = weight.withColumn("place", place).where(F.col("place") <= F.col("total") - needed + 1).select("item_id", "words", "i")
    rare = items.join(rarest, ["item_id", "words", "i"]).select("item_id", "words", "h").distinct()
    candidates = stored(found.select("doc_id", "k", "h").distinct().join(rare, "h").select("doc_id", "k", "item_id", "words").distinct(),
                        "benchmark-candidates")
    looked_up = candidates.join(items.select("item_id", "words", "size", "i", "h", "total"), ["item_id", "words"])
    looked_up = looked_up.withColumnsRenamed({"doc_id": "c_doc", "k": "c_k", "h": "c_h"})
    hits = (looked_up.join(found, (F.col("c_k") == F.col("k")) & (F.col("c_h") == F.col("h")) & F.col("c_doc").eqNullSafe(F.col("doc_id")))
            .select("doc_id", "k", "item_id", "words", "size", "total", "i", (F.col("at") - F.col("i")).alias("offset")).distinct())
    pair = ["doc_id", "k", "item_id", "words", "size", "total"]
    held = stored(hits.groupBy(*pair, "offset").agg(F.collect_set("i").alias("is")), "benchmark-offsets")
    in_order = Window.partitionBy(*pair).orderBy("offset")
    step = F.when(F.col("offset") - F.lag("offset").over(in_order) <= SHIFT, 0).otherwise(1)
    chained = held.withColumn("step", step).withColumn("chain", F.sum("step").over(in_order))
    spots = F.transform("is", lambda i: F.struct(i.alias("i"), F.col("offset").alias("offset")))
    single = held.select(*pair, spots.alias("places"))
    joined = (chained.groupBy(*pair, "chain").agg(F.flatten(F.collect_list(spots)).alias("places"), F.count("*").alias("offsets"))
              .where("offsets > 1").select(*pair, "places"))
    both = single.unionByName(joined).withColumn("n", F.size(F.array_distinct(F.transform("places", lambda p: p["i"]))))
    return both.where(F.col("n") >= F.greatest(F.lit(1), min_coverage * F.col("total"))).withColumnRenamed("words", "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, k, item_id, coverage, n_slots) of the items that documents hold; ``docs`` has doc_id, k and text."""
    items = stored(item_windows(benchmark), "benchmark-windows")
    found = _hits(docs, items)
    if found is None:
        return (docs.limit(0).select("doc_id", "k", F.lit(0).cast("long").alias("item_id"),
                                     F.lit(0.0).alias("coverage"), F.lit(0).alias("n_slots")))
    aligned = stored(alignments(found, items, min_coverage), "benchmark-aligned")
    # merged by shuffle at every size: how many documents hold items is not bounded by anything
    texts = docs.join(aligned.hint("merge"), docs["doc_id"].eqNullSafe(aligned["doc_id"]) & (docs["k"] == aligned["k"])).select(
        docs["doc_id"], docs["k"], "item_id", "places", "size", "item_words", (F.col("n") / F.col("total")).alias("coverage"),
        words(docs["text"]).alias("words"))
    # words of matching windows, each (position in the item, position here) once
    spots = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(
        F.sequence(p["i"], p["i"] + F.col("size") - 1), lambda j: F.struct(j.alias("j"), (j + p["offset"]).alias("p"))))))
    kind_there = _slot_kinds(F.col("item_words"), F.filter("item_words", lambda w: w.startswith(NAME)))
    spots = F.filter(spots, lambda s: F.get(F.col("kinds"), s["j"]).isNotNull() & (F.get(F.col("kinds"), s["j"]) == F.get(F.col("here"), s["p"])))
    slots = (texts.withColumn("kinds", kind_there).withColumn("here", _slot_kinds(F.col("words"), None)).withColumn("slot", spots)
             .withColumn("pair", F.array_distinct(F.transform("slot", lambda s: F.struct(
                 F.get(F.col("kinds"), s["j"]).alias("c"), plain(F.get(F.col("item_words"), s["j"])).alias("a"),
                 plain(F.get(F.col("words"), s["p"])).alias("b"))))))

    def kinds(side: str) -> Column:
        return F.size(F.array_distinct(F.transform("pair", lambda p: F.struct(p["c"].alias("c"), p[side].alias("v")))))
    same = (F.size("pair") == kinds("a")) & (F.size("pair") == kinds("b"))
    return (slots.where(same).groupBy("doc_id", "k", "item_id")
            .agg(F.max(F.struct("coverage", F.size("slot").alias("n_slots"))).alias("best"))
            .select("doc_id", "k", "item_id", "best.coverage", "best.n_slots"))


def _slot_kinds(tokens: Column, names: Column | None) -> Column:
    """Kind of slot of each word, or null. An opener is a name slot if ``names`` holds it as a name (None: in any case)."""
    def one(w: Column, i: Column) -> Column:
        opener = w.startswith(OPENER)
        if names is not None:
            opener = opener & F.array_contains(names, F.concat(F.lit(NAME), F.substring(w, 2, 1 << 30)))
        return (F.when(w.startswith(NAME) | opener, F.lit("<name>")).when(_is_number(w), F.lit("<num>"))
                .when(_is_unit(tokens, w, i), F.lit("<unit>")))
    return F.transform(tokens, one)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    keyed = docs.withColumn("_llm_k", text_key())
    held = contaminated(keyed.select("doc_id", F.col("_llm_k").alias("k"), "text"), benchmark)
    held = stored(held.select(F.col("doc_id").alias("_llm_id"), F.col("k").alias("_llm_hk")).distinct(), "benchmark-held")
    return keyed.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_k") == F.col("_llm_hk")),
                      "left_anti").select(*docs.columns)


def op1_template_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_key().alias("k"), "text")
    held = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return held.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"))


# ------------------------------------------------------------------ oracle

def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words_sql(text: str = "text") -> str:
    def apply(expression: str, pattern: str, by: str) -> str:
        for mark, code in ((NAME, "chr(1)"), (OPENER, "chr(2)")):
            by = by.replace(mark, f"' || {code} || '")
        by = by.replace("$1", r"\1").replace("$2", r"\2")
        return f"regexp_replace({expression}, {_sql_text(pattern)}, '{by}', 'g')"
    for pattern, by in [*_MARKS, _PLAIN]:
        text = apply(text, pattern, by)
    text = apply(f"lower({text})", *_SPACES)
    for pattern, by in _NUMBERS:
        text = apply(text, pattern, by)
    return f"string_split(trim({text}, ' '), ' ')"


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
_NUMBER_SQL = r"regexp_matches({}, '^\p{{Nd}}')"


def _kinds_sql(tokens: str, opener: str) -> str:
    """Kind of each word or null; ``opener`` says when the opener x is a name."""
    number, before = _NUMBER_SQL.format("x"), _NUMBER_SQL.format(f"{tokens}[i - 1]")
    return (f"list_transform({tokens}, lambda x, i: CASE WHEN x[1] = chr(1) OR (x[1] = chr(2) AND {opener}) THEN '<name>' "
            f"WHEN {number} THEN '<num>' WHEN i > 1 AND {before} AND x IN ({_UNITS_SQL}) THEN '<unit>' END)")


def _filled_sql(tokens: str, kinds: str) -> str:
    return f"list_transform({tokens}, lambda x, i: coalesce({kinds}[i], translate(x, chr(1) || chr(2), '')))"


ORACLE = rf"""
WITH it AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_words_sql()} AS w FROM benchmark WHERE text IS NOT NULL)
            WHERE w[1] <> ''),
ik AS (SELECT *, least({WINDOW}, len(w)) AS size, {_kinds_sql('w', 'false')} AS kinds, {_kinds_sql('w', 'true')} AS open_kinds FROM it),
items AS (SELECT item_id, w, size, open_kinds, {_filled_sql('w', 'kinds')} AS c, translate(array_to_string(w, ' '), chr(1) || chr(2), '') AS p,
                 {_kinds_sql('w', "list_contains(w, chr(1) || x[2:])")} AS slots FROM ik),
iw0 AS (SELECT *, unnest(range(0, len(w) - size + 1)) AS i FROM items),
iw1 AS (SELECT *, 2 * len(list_filter(open_kinds[i + 1 : i + size], lambda x: x IS NULL)) < size AS general,
               list_filter(range(1, size + 1), lambda j: w[i + j][1] = chr(2)) AS open FROM iw0),
iw2 AS (SELECT *, bool_and(general) OVER (PARTITION BY item_id, w) AS raw,
               count(*) FILTER (NOT general) OVER (PARTITION BY item_id, w) AS n_literal, count(*) OVER (PARTITION BY item_id, w) AS n FROM iw1),
iw3 AS (SELECT *, CASE WHEN raw THEN n ELSE n_literal END AS total,
               unnest(CASE WHEN raw THEN [0] WHEN len(open) <= 2 THEN range(0, 1 << len(open)) ELSE [0, (1 << len(open)) - 1] END) AS choice
        FROM iw2 WHERE raw OR NOT general),
iw AS (SELECT DISTINCT item_id, w, size, i, raw, total, slots,
              CASE WHEN raw THEN string_split(p, ' ')[i + 1 : i + size]
                   ELSE list_transform(c[i + 1 : i + size], lambda x, j: CASE WHEN list_contains(open, j)
                        AND (choice >> (list_position(open, j) - 1)) & 1 = 1 THEN '<name>' ELSE x END) END AS win FROM iw3),
dc0 AS (SELECT DISTINCT doc_id, text, {_words_sql()} AS w FROM documents WHERE text IS NOT NULL),
dc1 AS (SELECT *, list_filter(list_distinct(list_filter(w, lambda x: x[1] = chr(2))), lambda x: NOT list_contains(w, x[2:])) AS names FROM dc0),
dc2 AS (SELECT *, {_kinds_sql('w', 'list_contains(names, x)')} AS kinds, {_kinds_sql('w', 'true')} AS open_kinds FROM dc1),
dc AS (SELECT doc_id, text, w, open_kinds, {_filled_sql('w', 'kinds')} AS c,
              string_split(translate(array_to_string(w, ' '), chr(1) || chr(2), ''), ' ') AS p FROM dc2),
dw0 AS (SELECT doc_id, text, c, p, open_kinds, size, raw, unnest(range(0, len(c) - size + 1)) AS spot
        FROM dc, (SELECT DISTINCT size, raw FROM iw)),
dw AS (SELECT doc_id, text, spot, raw, CASE WHEN raw THEN p[spot + 1 : spot + size] ELSE c[spot + 1 : spot + size] END AS win FROM dw0
       WHERE NOT raw OR 2 * len(list_filter(open_kinds[spot + 1 : spot + size], lambda x: x IS NULL)) < size + 2),
hits AS (SELECT DISTINCT doc_id, text, item_id, iw.w AS iw, slots, size, total, i, spot - i AS off FROM dw JOIN iw USING (raw, win)),
marked AS (SELECT *, CASE WHEN off - lag(off) OVER q > {SHIFT} OR lag(off) OVER q IS NULL THEN 1 ELSE 0 END AS step FROM hits
           WINDOW q AS (PARTITION BY doc_id, text, item_id, iw ORDER BY off)),
chained AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, text, item_id, iw ORDER BY off) AS chain FROM marked),
al AS (SELECT doc_id, text, item_id, iw, slots, size, total, count(DISTINCT i) AS n, list({{'i': i, 'off': off}}) AS places
       FROM chained GROUP BY doc_id, text, item_id, iw, slots, size, total, off
       UNION ALL
       SELECT doc_id, text, item_id, iw, slots, size, total, count(DISTINCT i), list({{'i': i, 'off': off}})
       FROM chained GROUP BY doc_id, text, item_id, iw, slots, size, total, chain),
ok AS (SELECT row_number() OVER () AS r, * FROM al WHERE n >= greatest(1, {MIN_COVERAGE} * total)),
sp AS (SELECT DISTINCT r, s.i + j AS j, s.i + j + s.off AS p
       FROM (SELECT r, size, unnest(places) AS s FROM ok), range({WINDOW}) AS g(j) WHERE j < size),
pairs AS (SELECT ok.r, slots[j + 1] AS c, translate(ok.iw[j + 1], chr(1) || chr(2), '') AS a, dc.p[sp.p + 1] AS b
          FROM ok JOIN dc ON dc.doc_id IS NOT DISTINCT FROM ok.doc_id AND dc.text = ok.text JOIN sp ON sp.r = ok.r
          WHERE slots[j + 1] IS NOT NULL AND slots[j + 1] = dc.open_kinds[sp.p + 1]),
judged AS (SELECT r, count(*) AS n_slots, count(DISTINCT (c, a, b)) AS n, count(DISTINCT (c, a)) AS n_a, count(DISTINCT (c, b)) AS n_b
           FROM pairs GROUP BY r)
SELECT doc_id, item_id, max(ok.n / total) AS coverage, max(coalesce(n_slots, 0))::INT AS n_slots
FROM ok LEFT JOIN judged USING (r) WHERE coalesce(judged.n = n_a AND judged.n = n_b, true) GROUP BY ALL"""
