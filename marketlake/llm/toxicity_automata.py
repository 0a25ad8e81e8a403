"""Toxicity by Levenshtein automata intersected with a lexicon trie, and windows that tell quotation from abuse.

The lexicon is learned from labelled rows: words, and open stems (trie nodes that stand for every longer word), that many
toxic and few clean documents hold. A word of a text is looked up by walking the trie and the Levenshtein automaton of
the word together, bit masks holding the automaton's states, so only prefixes within the allowed distance are visited.
An exact filter keeps the walk to the paths of terms that can be near: words within r edits share a string that is left
when up to r letters are deleted from each. Allowed is one edit for words of 5 letters or more (of 4 if the word holds a character that is no letter), two from 9 on. Words
that clean documents hold are no misspellings, whatever they resemble.

Every hit is weighed by its window: between quotation marks, or near a word that reports or names speech, it counts as
quoted; near a second person as aimed at someone. A logistic regression over the weighed sums of exact, misspelled,
quoted and aimed hits, their number and their density gives the score. The regression is fitted on labelled rows that
the lexicon was not learned from, pulled towards stated weights where the labels say nothing (no label needs to show a
quotation), and calibrated to the share of toxic rows among all labelled ones.

At most about ``SAMPLE`` labelled rows of each label are used; word counts of the sample are Spark aggregates, and the
best ``TERMS`` entries and ``KNOWN`` clean words near them reach the driver. Every row is scored in one Arrow pass over
whole texts, with a bounded dictionary of looked-up words per task.

Defined results: null, empty and blank texts score as a text without hits; a row without doc_id is not held out and never
learned from; repeated rows are scored each by itself; equal words are ranked alphabetically where the lexicon is cut;
without usable labels the score is 0; an empty table gives an empty result; other columns are ignored; a text is held
whole, its words are not copied.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import hash_class, map_columns, stored, with_bound

SAMPLE = 6000
TERMS = 3000
KNOWN = 50_000
CACHE = 300_000
WINDOW = 6
LONGEST = 40
CUT = 0.7
#: Lexicon: least toxic documents of a word and of a stem, also as a share of the sample's, least log ratio, lengths of
#: stems.
MIN_DOCS, MIN_STEM_DOCS, MIN_SHARE, MIN_RATIO = 3, 5, 0.01, 2.5
STEMS = (6, 7, 8)

# Words that report or name speech, and second persons (English, German, French, Spanish).
REPORTING = frozenset("""said says say called calls calling word words term terms phrase quote quoted wrote shouted insult insults
sagte sagt nannte nennt wort begriff zitat schrieb beleidigung dit disait appelé appelle mot terme citation insulte
dijo dice llamó llama palabra término cita escribió insulto""".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti vos usted".split())
OPENING, CLOSING = "\"'“„«‘‚‹", "\"'”“»’‘›"

#: Features of a text, and the weights the regression is pulled to where labels are silent.
FEATURES = ("bias", "exact", "misspelled", "quoted", "aimed", "hits", "density")
PRIOR = np.array([-3.0, 1.5, 0.8, 0.0, 0.7, 0.5, 0.3])
PULL = np.array([0.01, 0.5, 0.5, 5.0, 2.0, 0.5, 0.5])

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def core(token: str) -> str:
    """A lower-case token without the marks around it."""
    return token if token.isalnum() else _EDGES.sub("", token)


def allowed(word: str) -> int:
    """Edits that a word may differ from a term."""
    if len(word) < 5:
        return 1 if len(word) == 4 and not word.isalpha() else 0
    return 1 if len(word) < 9 else 2


def shortened(word: str, most: int) -> set[str]:
    """``word`` and what is left of it when up to ``most`` letters are deleted."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        found = found | last
    return found


class Lexicon:
    """Terms and open stems in one trie, with the clean words that are no misspellings."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: frozenset[str]):
        self.terms, self.stems, self.known = terms, stems, known
        self.lengths = sorted({len(s) for s in stems})
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float | None] = [None]
        for term in terms:
            node = 0
            for ch in term:
                node = self.children[node].setdefault(ch, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.weight.append(None)
            self.weight[node] = terms[term]
        #: By allowed edits: what is left of the terms that a word with so many edits may be near to, and the nodes of
        #: their paths.
        self.left: dict[int, dict[str, set[int]]] = {1: {}, 2: {}}
        for term in terms:
            path, node = [], 0
            for ch in term:
                node = self.children[node][ch]
                path.append(node)
            for most, fits in ((1, len(term) <= 9), (2, len(term) >= 7)):
                for w in shortened(term, most) if fits else ():
                    self.left[most].setdefault(w, set()).update(path)
        #: By allowed edits: (three letters, place) of terms, the place moved by as many letters either way. Of r + 1 parts of
        #: a word one is as in the term.
        self.grams = {r: {(t[q:q + 3], q + d) for t in terms for q in range(len(t) - 2) for d in range(-r, r + 1)} for r in (1, 2)}

    def paths(self, word: str, most: int) -> set[int]:
        """Nodes of the paths of terms that can be within ``most`` edits; empty where none is."""
        left, grams, n, found = self.left[most], self.grams[most], len(word), set()
        if most == 2:
            k = n // 3
            if (word[:3], 0) not in grams and (word[k:k + 3], k) not in grams and (word[2 * k:2 * k + 3], 2 * k) not in grams:
                return found
        elif n >= 6 and (word[:3], 0) not in grams and (word[-3:], n - 3) not in grams:
            return found
        once = [word[:i] + word[i + 1:] for i in range(len(word))]
        for w in (word, *once):
            if w in left:
                found |= left[w]
        if most == 2:
            for k, w in enumerate(once):
                for i in range(k, len(w)):
                    twice = w[:i] + w[i + 1:]
                    if twice in left:
                        found |= left[twice]
        return found

    def nearest(self, word: str, most: int, paths: set[int] | None = None) -> tuple[int, float] | None:
        """(distance, weight) of the nearest term within ``most`` edits; the heaviest of equals. ``paths`` may name the
        nodes worth visiting.

        State ``r`` of a node is a mask: bit i is set if the first i letters of the word are within r edits of the path."""
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << (i + 1)
        end, full = 1 << len(word), (1 << (len(word) + 1)) - 1
        start = tuple((1 << (r + 1)) - 1 & full for r in range(most + 1))
        best, todo = None, [(0, start)]
        while todo:
            node, state = todo.pop()
            for ch, child in self.children[node].items():
                if paths is not None and child not in paths:
                    continue
                hit = masks.get(ch, 0)
                now = [state[0] << 1 & hit]
                for r in range(1, most + 1):
                    # a letter matched, replaced, missing from the word, or added to it
                    now.append((state[r] << 1 & hit | state[r - 1] << 1 | state[r - 1] | now[r - 1] << 1) & full)
                if not now[most]:
                    continue
                if self.weight[child] is not None:
                    for r in range(most + 1):
                        if now[r] & end:
                            if best is None or (r, -self.weight[child]) < (best[0], -best[1]):
                                best = (r, self.weight[child])
                            break
                todo.append((child, tuple(now)))
        return best

    def look_up(self, word: str) -> tuple[bool, float] | None:
        """(exact, weight) of a lower-case word, or None."""
        if not word:
            return None
        if word in self.terms:
            return True, self.terms[word]
        found = None
        for n in self.lengths:
            if len(word) > n and word[:n] in self.stems:
                found = max(self.stems[word[:n]], found or 0.0)
        if found is not None:
            return True, found
        most = allowed(word)
        if not most or word in self.known or len(word) > LONGEST + 2:
            return None
        paths = self.paths(word, most)
        near = self.nearest(word, most, paths) if paths else None
        return (False, near[1] / (1 + near[0])) if near else None


def window_of(tokens: list[str], at: int, width: int = WINDOW) -> tuple[bool, bool]:
    """(quoted, aimed) of the word at ``at``: marks that open before and close after it, words that report, second persons."""
    low, high = max(0, at - width), min(len(tokens), at + width + 1)
    opens = any(t[:1] in OPENING for t in tokens[low:at + 1] if t)
    closes = any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in tokens[at:high] if t.rstrip(".,;:!?"))
    near = {core(t) for t in tokens[low:high]}
    return (opens and closes) or not near.isdisjoint(REPORTING), not near.isdisjoint(SECOND)


def features(lexicon: Lexicon, text: str | None, cache: dict) -> list[float]:
    """Values of ``FEATURES`` of a whole text."""
    tokens = (text or "").lower().split()
    exact = wrong = quoted = aimed = 0.0
    hits = 0
    for at, token in enumerate(tokens):
        got = cache.get(token, 0)
        if got == 0:
            if len(cache) >= CACHE:
                cache.clear()
            word = core(token)
            got = cache.get(word, 0)
            if got == 0:
                got = cache[word] = lexicon.look_up(word)
            cache[token] = got
        if got is None:
            continue
        hits += 1
        in_quotes, at_someone = window_of(tokens, at)
        if in_quotes:
            quoted += got[1]
        elif got[0]:
            exact += got[1]
        else:
            wrong += got[1]
        if at_someone and not in_quotes:
            aimed += got[1]
    logs = np.log1p([exact, wrong, quoted, aimed, hits, 100.0 * hits / max(1, len(tokens))])
    return [1.0, *logs.tolist()]


# ------------------------------------------------------------------ learning

def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of the rows to learn from: (text, toxic, part), and the rows that each sampled one stands for."""
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    # a document whose labels differ counts as toxic
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks.where(learned), "toxic-labels")
    counts = {int(r.toxic): r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r.toxic in (0, 1)}
    bounds = {t: with_bound(n, sample) for t, n in counts.items()}
    few = F.lit(False)
    for t, bound in bounds.items():
        few = few | ((F.col("toxic") == t) & (hash_class("doc_id") < bound))
    # the marks of the sample are about two samples of (id, label), whatever the corpus holds
    wanted = F.broadcast(marks.where(few))
    rows = (docs.select("doc_id", "text").where(hash_class("doc_id") < max(bounds.values(), default=0)).join(wanted, "doc_id")
            .select("text", F.col("toxic").cast("int").alias("toxic"), (hash_class("doc_id") % 3).alias("part")))
    return stored(rows, "toxic-sample"), {t: 1_000_000 / bound for t, bound in bounds.items()}


def learn_lexicon(rows: DataFrame, terms: int = TERMS, known: int = KNOWN) -> Lexicon:
    """Words and stems of toxic rows of parts 0 and 1, against the clean rows there; equal texts count once."""
    def start():
        def run(texts, marks):
            words, toxic = [], []
            for text, mark in zip(texts, marks):
                found = {core(t) for t in (text or "").lower().split()}
                found = {w for w in found if 2 < len(w) <= LONGEST}
                entries = found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n and w[:n].isalpha()}
                words += entries
                toxic += [mark] * len(entries)
            return {"word": words, "toxic": toxic}
        return run
    rows = rows.where("part < 2").withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "toxic"]).drop("same")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, {}, frozenset())
    counts = stored(map_columns(rows, ["text", "toxic"], "word string, toxic int", start).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "toxic-words")
    stem = F.col("word").endswith("*")
    ratio = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    best = (counts.withColumn("ratio", ratio).where(ratio >= MIN_RATIO)
            .where(F.col("bad") >= F.greatest(F.when(stem, MIN_STEM_DOCS).otherwise(MIN_DOCS), F.lit(MIN_SHARE * sizes[1])))
            .orderBy(F.desc(F.col("bad") * F.col("ratio")), "word").limit(terms).collect())
    words = {r.word: float(r.ratio) for r in best if not r.word.endswith("*")}
    stems = {r.word[:-1]: float(r.ratio) for r in best if r.word.endswith("*")}
    draft = Lexicon(words, stems, frozenset())

    def near():
        def run(found, good):
            held = [(w, n) for w, n in zip(found, good) if w not in draft.terms and (got := draft.look_up(w)) and not got[0]]
            return {"word": [w for w, _ in held], "good": [n for _, n in held]}
        return run
    clean = counts.where(~stem & (F.col("good") > 0) & (ratio < MIN_RATIO))
    clean = map_columns(clean, ["word", "good"], "word string, good long", near).orderBy(F.desc("good"), "word").limit(known)
    return Lexicon(words, stems, frozenset(r.word for r in clean.collect()))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> np.ndarray:
    """Logistic regression, pulled to ``PRIOR``: Newton steps, each halved until the loss falls."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + PULL @ (w - PRIOR) ** 2 / 2)
    w, now = PRIOR.copy(), loss(PRIOR)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (p - y)) + PULL * (w - PRIOR)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(PULL)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-9 and loss(w - size * move) > now:
            size /= 2
        after = loss(w - size * move)
        if not after < now - 1e-10 * abs(now):
            break
        w, now = w - size * move, after
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray] | None:
    """(lexicon, weights), or None if the labelled rows do not show both labels."""
    rows, stands = labelled(docs, labels, sample)
    if len(stands) < 2:
        return None
    lexicon = learn_lexicon(rows)

    def start():
        cache: dict = {}

        def run(texts, marks):
            return {"x": [features(lexicon, t, cache) for t in texts], "toxic": marks}
        return run
    got = map_columns(rows.where("part = 2"), ["text", "toxic"], "x array<double>, toxic int", start).collect()
    if not got:
        return lexicon, PRIOR
    got.sort(key=lambda r: (r.toxic, r.x))
    y = np.array([r.toxic for r in got], dtype=float)
    return lexicon, fit(np.array([r.x for r in got]), y, np.array([stands[r.toxic] for r in got]) / min(stands.values()))


def score_texts(docs: DataFrame, model: tuple[Lexicon, np.ndarray] | None, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of every row."""
    def start():
        cache: dict = {}

        def run(ids, held, texts):
            scores, hits = [], []
            for text in texts:
                if model is None:
                    scores.append(0.0)
                    hits.append(0)
                    continue
                x = features(model[0], text, cache)
                scores.append(float(1 / (1 + np.exp(-np.clip(np.dot(x, model[1]), -30, 30)))))
                hits.append(round(np.expm1(x[5])))
            return {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(s >= cut) for s in scores], "hits": hits}
        return run
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return map_columns(docs.select("doc_id", held, "text"), ["doc_id", "held_out", "text"],
                       "doc_id long, held_out boolean, score double, predicted int, hits long", start)


def op12_toxicity_automata(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
