"""The pipeline against brute-force stages."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import __spark_entry__
from marketlake.llm import quality_forest
from marketlake.llm.common import stored
from tests.llm.test_operators import (DIR, brute_contaminated, brute_cuts, brute_fingerprint, brute_stats, check_packing,
                                      tree_walk, words_of)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_forest.fit(quality_forest.rule_statistics(docs.join(labels, "doc_id", "left_semi")), labels)
    texts = {}
    for d, r in rows.items():
        s = brute_stats(r["text"])
        score = int(tree_walk(model, quality_forest.text_stats(r["text"])[5]) * quality_forest.BINS) / quality_forest.BINS
        if s[0] >= 20 and 100 * s[4] <= 30 * s[0] and score < model.cutoff:
            texts[d] = r["text"]
    cuts = brute_cuts(list(texts.items()))
    for d, t in list(texts.items()):
        gone = cuts[d, t]
        texts[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if gone and not words_of(texts[d]):
            del texts[d]
    ids = sorted(texts)
    prints = {d: brute_fingerprint(texts[d]) for d in ids}
    near = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                near[a].add(b), near[b].add(a)
    seen: set = set()
    for d in ids:
        if d in seen:
            del texts[d]
            continue
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, _ in brute_contaminated(sorted(texts.items()), items)}
    texts = {d: t for d, t in texts.items() if d not in held}
    check_packing(corpus_pipeline.run(spark, DIR).collect(), sorted(texts.items()))
    assert 0 < len(texts) < len(rows)


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).schema.simpleString() == docs.schema.simpleString()
        assert stored(stage(spark, empty, DIR), "empty").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, DIR).count() == 0


def test_registered():
    names = [q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline"]
    assert len(names) == 14
