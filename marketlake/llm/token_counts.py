"""Token counts of whole texts; huge documents are encoded in overlapping chunks and spliced.

A text of more than ``CHUNK`` characters is encoded chunk by chunk with offsets. Two neighbouring chunks are spliced at
a stable boundary of their overlap: a word start after ASCII white space (no rule of the tokenizer joins text across
white space, so what precedes it cannot change what follows) from which both encodings agree, id by id and offset by
offset, up to the last such boundary of the overlap. Where no boundary is proven the overlap is doubled, and when it has
taken up the whole chunk, the chunk is lengthened. So a count never differs from that of the text encoded at once, and
memory is bounded by the chunk, or by the longest stretch without white space.

Where the vocabulary's rules prove that no token or rule reaches across ASCII white space (``words_add_up``), the tokens
of a shorter text are the sum of those of its words, and a bounded dictionary per task keeps the counts of words met
before. Texts that hold the string of a special token in any case, and other vocabularies, are encoded whole.

Defined results: null and empty text has 0 bytes and 0 tokens; ids may be null or repeat; an empty table gives an empty
result; repeated rows are counted each by itself; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from marketlake.llm.common import ASCII_SPACE, map_columns

CHUNK = 32_768
OVERLAP = 512
LIMIT = 2048
BATCH_CHARS = 200_000
KNOWN_WORDS = 1_000_000
#: Words of lower-case Latin letters are one piece of the pre-tokenizer, and unchanged by normalisation.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
MARKS = b".,;:!?"


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


def _encoded(tokenizer, text: str, base: int) -> list[tuple[int, int]]:
    """(offset in the document, id) of every token of a chunk that starts at ``base``."""
    got = tokenizer.encode(text, add_special_tokens=False)
    return [(base + a, i) for (a, _), i in zip(got.offsets, got.ids)]


def _word_starts(text: str, low: int, high: int) -> list[int]:
    """Positions in (low, high) of characters that follow ASCII white space and are none."""
    return [p for p in range(low + 1, high) if text[p - 1] in ASCII_SPACE and text[p] not in ASCII_SPACE]


def splice_point(text: str, left: list, right: list, low: int, high: int) -> int | None:
    """First word start of the overlap [low, high) from which both encodings agree up to its last word start."""
    starts = _word_starts(text, low, high)
    if len(starts) < 2:
        return None
    last = starts[-1]
    a = [t for t in left if low <= t[0] < last]
    b = [t for t in right if t[0] < last]
    for p in starts[:-1]:
        if [t for t in a if t[0] >= p] == [t for t in b if t[0] >= p]:
            return p
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in overlapping chunks."""
    total, low, base, end = 0, 0, 0, min(len(text), chunk)
    here = _encoded(tokenizer, text[:end], 0)
    width = overlap
    while end < len(text):
        start = max(low, end - width)
        after = min(len(text), start + max(chunk, 2 * width))
        there = _encoded(tokenizer, text[start:after], start)
        at = splice_point(text, here, there, start, end)
        if at is not None:
            total += sum(low <= offset < at for offset, _ in here)
            here, base, low, end, width = there, start, at, after, overlap
        elif start > low:
            width *= 2
        else:
            end = min(len(text), end + max(chunk, end - base))
            here = _encoded(tokenizer, text[base:end], base)
            width *= 2
    return total + sum(offset >= low for offset, _ in here)


def count_tokens(tokenizer, texts: list[str | None], chunk: int = CHUNK) -> list[int]:
    """Tokens of each text; short texts are encoded a few at a time."""
    out, waiting, size = [0] * len(texts), [], 0

    def flush() -> None:
        for i, got in zip(waiting, tokenizer.encode_batch_fast([texts[i] for i in waiting], add_special_tokens=False)):
            out[i] = len(got)

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > chunk:
            out[i] = count_long(tokenizer, text, chunk)
            continue
        if waiting and size + len(text) > BATCH_CHARS:
            flush()
            waiting, size = [], 0
        waiting.append(i)
        size += len(text)
    if waiting:
        flush()
    return out


def words_add_up(tokenizer) -> bool:
    """Whether the tokens of a text are those of its words, split on ASCII white space: every normaliser works within
    words, the pre-tokenizer keeps matches of a pattern without look-around or anchors and drops white space, and no
    added token takes up white space."""
    rules = json.loads(tokenizer.to_str())
    normalizer = rules["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normalizer.get("normalizers", [normalizer])
    inside = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"}
                 and n["content"] == " " for n in steps)
    pieces = rules["pre_tokenizer"] or {}
    pieces = pieces.get("pretokenizers", [pieces])
    if not inside or len(pieces) != 2 or pieces[0].get("type") != "Split" or pieces[1].get("type") != "ByteLevel":
        return False
    pattern = pieces[0]["pattern"].get("Regex", "(?")
    loose = "(?" in pattern or re.search(r"\\[bBAzZG]|\$|(?<!\[)\^", pattern)
    split = pieces[0]["behavior"] == "Removed" and pieces[0]["invert"] and not pieces[1]["use_regex"] and not pieces[1]["add_prefix_space"]
    model = rules["model"]
    added = [t["content"] for t in rules["added_tokens"]]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in rules["added_tokens"])
    return bool(not loose and split and plain and model["type"] == "BPE" and not model["dropout"] and rules["post_processor"] is None
                and rules["truncation"] is None and rules["padding"] is None
                and not any(c in ASCII_SPACE or t.lower().endswith(chr(m)) for t in added for c in t for m in MARKS)
                and all(not tokenizer.encode(c, add_special_tokens=False).ids for c in ASCII_SPACE)
                and all(len(tokenizer.encode(f"a{c}b", add_special_tokens=False).ids) == 2 for c in ASCII_SPACE))


class WordCounts:
    """Token counts of texts as sums over their words, with a bounded dictionary from lower-case word to count."""

    def __init__(self, tokenizer, known: int = KNOWN_WORDS):
        self.tokenizer, self.known, self.counts = tokenizer, known, {}
        rules = json.loads(tokenizer.to_str())
        self.special = [t["content"].lower().encode() for t in rules["added_tokens"]]
        self.lower = any(n["type"] == "Lowercase" for n in (rules["normalizer"] or {}).get("normalizers", []))

    def words(self, raw: bytes) -> list[bytes] | None:
        """Words of a text, or None if it may hold a special token."""
        low = raw.lower()
        if any(s in low for s in self.special):
            return None
        return (low if self.lower else raw).split()

    def learn(self, words: set[bytes]) -> None:
        """Count the tokens of new words; a mark after a Latin letter or digit is a piece of its own."""
        if len(self.counts) + len(words) > self.known:
            self.counts = {}
        tails = {w for w in words if len(w) > 1 and w[-1] in MARKS and w[-2:-1].isalnum()}
        bases = {w[:-1] for w in tails} | {w[-1:] for w in tails} | (words - tails)
        new = [w.decode() for w in bases if w not in self.counts]
        plain = [w for w in new if PLAIN.fullmatch(w)] if self.lower else []
        for at in range(0, len(plain), 2000):
            some = plain[at:at + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False).word_ids
            sizes: dict[int, int] = {}
            for piece in got:
                sizes[piece] = sizes.get(piece, 0) + 1
            if len(sizes) == len(some):
                self.counts.update(zip([w.encode() for w in some], sizes.values()))
        rest = [w for w in new if w.encode() not in self.counts]
        for w, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.counts[w.encode()] = len(got)
        for w in tails:
            self.counts[w] = self.counts[w[:-1]] + self.counts[w[-1:]]

    def __call__(self, raws: list[bytes]) -> list[int | None]:
        """Tokens of each text; None where it must be encoded whole."""
        split = [self.words(raw) for raw in raws]
        words = {w for held in split if held for w in held}
        new = words - self.counts.keys()
        if new:
            if len(self.counts) + len(new) > self.known:
                self.counts, new = {}, words
            self.learn(new)
        return [None if held is None else sum(map(self.counts.__getitem__, held)) for held in split]


def count_texts(tokenizer, texts: list[str | None], words: WordCounts | None, chunk: int = CHUNK) -> list[int]:
    """Tokens of each text: huge ones spliced, others by their words, or encoded whole."""
    out: list[int] = [0] * len(texts)
    whole, short, size = list(range(len(texts))), [], 0

    def add_up() -> None:
        for i, n in zip(short, words([texts[i].encode() for i in short])):
            if n is None:
                whole.append(i)
            else:
                out[i] = n

    if words is not None:
        whole = [i for i, t in enumerate(texts) if t and len(t) > chunk]
        for i, text in enumerate(texts):
            if text and len(text) <= chunk:
                short.append(i)
                size += len(text)
                if size > BATCH_CHARS:
                    add_up()
                    short, size = [], 0
        add_up()
    for i, n in zip(whole, count_tokens(tokenizer, [texts[i] for i in whole], chunk)):
        out[i] = n
    return out


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document row."""
    def start():
        tokenizer = _tokenizer(vocabulary)
        words = WordCounts(tokenizer) if words_add_up(tokenizer) else None

        def run(ids, texts):
            counts = count_texts(tokenizer, texts, words)
            return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": counts,
                    "over_limit": [n > limit for n in counts]}
        return run

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
