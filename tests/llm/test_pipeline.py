"""The corpus pipeline: every stage against brute force on the smallest table, and on a table of edge cases."""

import base64
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from axisloom.llm.common import stored, table
from axisloom.llm.decontaminate import Rule
from axisloom.llm.language_id import fit_language_model, languages
from axisloom.llm.materialise import PATTERN, VOCABULARY, Layout, materialised, read_sequences
from tests.llm.test_pairs import brute
from tests.llm.test_words import brute_alignment

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        after = stored(after, name) if i < len(corpus_pipeline.STAGES) - 1 else after.cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    assert [n for n, *_ in stages] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_filters_keep_rows_as_they_are(stages):
    for _, before, after in stages[:3]:
        assert 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0


def test_language_stage(stages):
    """Documents stay whose language is determined with the score asked for; of those with a label and letters, nearly all."""
    _, before, after = stages[0]
    found = languages(before, fit_language_model(before)).collect()
    want = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert kept == want
    labelled = {r.doc_id for r in before.filter("lang is not null").collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert len(kept & labelled) > 0.98 * len(labelled)


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted({c for _, _, c in brute(rows, 5, 80, 100)})


def test_decontamination_stage(spark, stages):
    """Every text that holds an item, whole or edited, goes; of the others every one stays that shares no alignment
    of the score asked for, by full alignment of texts of moderate length with all items."""
    _, before, after = stages[2]
    items = [words(r.text.translate(UP)) for r in table(spark, SF, "benchmark").filter("text is not null").collect()]
    items = [i for i in items if i]
    kept, number = {r.doc_id for r in after.select("doc_id").collect()}, {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    coded, compared, gone = [code(i) for i in items], 0, 0
    rule = Rule()
    for r in before.select("doc_id", "text").collect():
        own = words(r.text.translate(UP))
        if any(f" {' '.join(i)} " in f" {' '.join(own)} " for i in items):
            assert r.doc_id not in kept
            gone += 1
        elif len(own) <= 200:
            x, here = code(own), set(own)
            # no alignment scores more than two for each word of the item that the text has
            near = [y for i, y in zip(items, coded, strict=True) if len(i) >= rule.short_words and sum(w in here for w in i) >= rule.min_score * len(i)]
            best = max((brute_alignment(x, y) / (2 * len(y)) for y in near), default=0.0)
            compared += 1
            assert (r.doc_id in kept) or best >= rule.min_score
    assert gone and compared > 20


def test_mixing_stage(stages):
    """Each source's words meet its target, and every row is a document of the stage before, whole or its beginning."""
    _, before, after = stages[3]
    sizes, of = Counter(), {}
    for r in before.collect():
        sizes[r.source] += len(words(r.text))
        of[r.doc_id] = r
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:  # clamp those above two epochs until none is
        share = {s: budget * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2.0 * sizes[s] for s in over)
        free -= over
    taken, rows = Counter(), after.collect()
    for r in rows:
        own = of[r.doc_id]
        taken[r.source] += len(words(r.text))
        assert (r.source, r.lang) == (own.source, own.lang)
        assert r.text == own.text or words(own.text)[: len(words(r.text))] == words(r.text)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    assert {s: taken[s] for s in order} == {s: pytest.approx(target[s], abs=1) for s in order}


def test_every_mixed_document_is_written(stages):
    _, mixed, index = stages[-1]
    ids = {i for r in index.select("doc_ids").collect() for i in r.doc_ids}
    assert ids == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_written_tokens(stages, tmp_path):
    """The shards hold the tokens of the mixed texts, each as often as it was taken."""
    mixed, out = stages[-1][1], f"file://{tmp_path}"
    rows = sorted(materialised(mixed, out, stored_input=True).collect(), key=lambda r: r.sequence)
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    enc, end = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Layout().end_token
    read = dict(read_sequences(out))
    stream = np.concatenate([read[r.slot][: r.n_tokens] for r in rows])
    got = Counter(enc.decode(part[:-1].tolist()) for part in np.split(stream, np.flatnonzero(stream == end) + 1) if len(part))
    assert got == Counter(r.text for r in mixed.select("text").collect())
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) == stages[-1][2].count()


def edge_rows(spark):
    docs = table(spark, SF, "documents")
    known = docs.filter("lang is not null and length(text) > 300").orderBy("doc_id").limit(60)
    some = known.select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "12 34 !?", None, "web", 8), (None, "a text of no id " * 20, "en", "web", 320), (None, "another text of no id " * 20, None, None, 440)]
    odd = spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    long = known.limit(1).select(F.lit(9005).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 2000).alias("text"), "lang", "source", F.lit(0).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    # repeated rows, and columns with names that the operators use
    return some.union(some.limit(10)).union(odd).union(long).withColumns({"size": F.lit(1), "component_id": F.lit("x"), "digest": F.lit(None).cast("string"), "score": F.lit(0.5), "item_id": F.lit(2), "id": F.col("doc_id")})


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns through all stages; then no rows at all."""
    full = stored(edge_rows(spark), "edges")
    for docs in (full, stored(full.limit(0), "none")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, docs, SF), name)
            assert after.columns == docs.columns
            if name != "mixing":
                assert after.exceptAll(docs).count() == 0
            if name == "near_duplicates":
                ids = [r.doc_id for r in after.collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids))
            docs = after
        index = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {i for r in index.collect() for i in r.doc_ids} == {r.doc_id for r in docs.collect()}
