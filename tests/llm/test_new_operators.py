"""Spelling variants, fill-in-middle and near vectors against brute force, SQL and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from axisloom.llm.collision import least_count, near_vectors, window_probability
from axisloom.llm.decontaminate import Rule, contaminated, smith_waterman
from axisloom.llm.fill_middle import fill_in_middle, restored, split_parts
from axisloom.llm.queries import OP12_SQL, op11_spelling, op12_fill_middle, op13_near_vectors
from axisloom.llm.spelling import WaveletTree, near_words, spelling_variants, vocabulary
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants


def brute_words(rows, min_length=5, min_count=3):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{key}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}


def brute_near(words):
    """Near words through their one-deletion patterns."""
    replaced, deleted = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            replaced[w[:i], w[i + 1 :]].add(w)
            deleted[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= replaced[w[:i], w[i + 1 :]]
        near[w] |= deleted.get(w, set())
        near[w].discard(w)
        for x in deleted.get(w, ()):
            near[x].add(w)
    return near


def brute_variants(words):
    near, out, form = brute_near(words), {}, {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] is not None else None, root)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    expected = brute_variants(brute_words(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    assert as_dict(op11_spelling(spark, SF)) == expected
    assert sum(v[2] is not None for v in expected.values()) > 100


def random_words(seed, letters, lengths, n):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choices(letters, k=rng.choice(lengths)))
        out[w] = rng.choice([1, 2, 3, 3, 10, 50, 400])
    return out


@pytest.mark.parametrize(("letters", "bucket_rows", "split"), [("ab", 10**6, 10**6), ("ab", 50, 7), ("abß\U0001f600", 300, 20), ("éàb", 40, 3)])
def test_near_words(spark, letters, bucket_rows, split):
    words = random_words(letters, letters, [1, 2, 3, 4, 5, 6, 9], 250)
    words["x" * 5000] = 3
    words["x" * 2500 + "y" + "x" * 2499] = 3
    words["x" * 4999] = 9
    df = spark.createDataFrame([*words.items(), (None, 5)], "word string, n long")
    near = brute_near(words)
    best = {w: min(x, key=lambda k: (-words[k], k)) for w, x in near.items() if x}
    got = {r.word: (r.near, r.best_n, r.best) for r in near_words(df, bucket_rows, split).collect()}
    assert got == {w: (len(near[w]), words[b], b) for w, b in best.items()}
    assert as_dict(spelling_variants(df.filter("word is not null"), 2.0, bucket_rows, split)) == brute_variants(words)


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        left, right, low, high = (rng.integers(0, n + 1, 60) for _ in range(4))
        q, v = WaveletTree(values).report(left, right, low, high)
        expected = sorted((i, int(x)) for i in range(60) for x in values[left[i] : right[i]] if low[i] <= x < high[i])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == expected


def test_vocabulary_edges(spark):
    rows = [(1, None), (2, ""), (3, "Äpfel äpfel ÄPFEL"), (4, "WORDS words Words words1words"), (None, "words"), (5, "naïve÷naïve x" * 3), (6, "a" * 100_000), (6, "a" * 100_000), (7, "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit(1))
    got = {r.word: r.n for r in vocabulary(df).collect()}
    count = Counter(w.translate(UP) for _, t in rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert got == {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    assert spelling_variants(vocabulary(df.limit(0))).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling_variants(vocabulary(df), ratio=1.0)


def test_chain_of_forms(spark):
    words = {"a" * k: 3**k for k in range(5, 30)}
    got = as_dict(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[4] for v in got.values()} == {"a" * 29}
    assert got == brute_variants(words)


# fill-in-middle


def test_fill_query(spark):
    assert_same(op12_fill_middle(spark, SF), connect(SF), OP12_SQL)
    rows = op12_fill_middle(spark, SF).collect()
    texts = dict(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    assert all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def by_hand(key, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_edges(spark):
    odd = ["", None, "<P>", "a<S>b", "x<M>", "<", "<P", "P>", "\x01", "\x02", "\x01\x02e\x02d\x01", "ed\x02", "\U0001f600éé", "\n\r\n", "$1\\1", "a", "\x00b", "long \U0001f600 " * 30_000]
    rows = [(k, t) for k in (None, 0, 1, 7, 12, 40) for t in odd] + [(1, "a"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("prefix", F.lit("clash")).withColumn("__injected", F.lit("clash"))
    made = fill_in_middle(df).withColumn("again", restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.text, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output, r.again) for r in made.collect())
    assert got == Counter((k, t or "", len(t or ""), *by_hand(k, t), t or "") for k, t in rows)
    assert fill_in_middle(df.limit(0)).count() == 0


def test_fill_other_units(spark):
    rows = [(k, t) for k, t in enumerate(["one two  three\nfour", " lead and trail ", "a\nb\n\nc", "\n", "x", "\x01 \x02e \x02"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units = {"word": lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}
    for unit, cut in units.items():
        for r in split_parts(df, "text", F.lit(1), F.lit(2), unit).collect():
            u = cut(r.text)
            if len(u) >= 2:
                assert (r.n, r.prefix, r.middle, r.suffix) == (len(u), u[0], u[1], "".join(u[2:]))
        made = fill_in_middle(df, unit=unit, share=100, seed=4).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
        assert all(r.again == r.text and r.prefix + r.middle + r.suffix == r.text for r in made)


def test_fill_needs_no_shuffle(spark):
    plan = op12_fill_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# near vectors


def brute_vectors(rows, threshold):
    """(key, links, component, kept) of rows (key, vector, label) by all pairs."""
    good = [k is not None and label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for k, v, label in rows]
    unit = [np.array(v, dtype=float) / np.max(np.abs(np.array(v, dtype=float))) if g else None for g, (_, v, _) in zip(good, rows, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links, root = [0] * len(rows), {k: k for k, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return Counter((k, n, None if k is None else find(k), k is not None and find(k) == k) for (k, _, _), n in zip(rows, links, strict=True))


def vectors_got(df):
    return Counter((r[0], r.n_links, r.component_id, r.kept) for r in df.collect())


def clusters(seed, dim=64, groups=12, size=14):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(size):
            v = base + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.2, 0.27, 0.35])
            rows.append((1000 - 7 * k, [float(x) for x in np.float32(v)], int(g % 3)))
            k += 1
    return rows


@pytest.mark.parametrize("block_rows", [10, 10**6])
def test_near_vectors(spark, block_rows):
    rows = clusters(5)
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(6)] + [(6000, rows[3][1], 99), (6001, [2 * x for x in rows[3][1]], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vectors_got(near_vectors(df, block_rows=block_rows)) == brute_vectors(rows, 0.93)


def test_vector_edges(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [float("nan")] * 3, 0), (8, [float("inf"), 0.0, 0.0], 0)]
    rows += [(9, one, None), (10, one, None), (None, one, 0), (11, [1.0, 2.0], 0), (12, [-1.0, -2.0, -2.0], 0), (13, [1e200, 2e200, 2e200], 0), (14, [1e-300, 2e-300, 2e-300], 0), (15, [0.0, 1.0, 0.0], 1), (16, [-0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("links", F.lit(0))
    assert vectors_got(near_vectors(df)) == brute_vectors(rows, 0.93)
    assert near_vectors(df.limit(0)).count() == 0


def test_vector_query_recall(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        t = pq.read_table(f"{sf}/embeddings.parquet")
        rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist(), strict=True))
        assert vectors_got(op13_near_vectors(spark, sf)) == brute_vectors(rows, 0.93)


def test_recall_at_the_threshold(spark):
    """Pairs exactly at the threshold pass as often as the count was chosen for."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9301
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), i % 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert near_vectors(df).filter("n_links > 0").count() >= 0.999 * len(rows)


def test_least_count():
    assert least_count(24, window_probability(1.5), 0.9999) == 13
    assert least_count(10, 1.0, 0.9999) == 10
    assert least_count(10, 0.01, 0.99) == 1


# benchmark decontamination: what the search finds of what full alignment finds


def edited_copies(seed, items, edit):
    """(items, documents that hold an edited copy of each among other words)."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    bench, docs = [], []
    for k in range(items):
        item = rng.choices(words, k=rng.randint(12, 80))
        copy = [x for j, w in enumerate(item) for x in edit(rng, words, j, w)]
        bench.append((k, " ".join(item)))
        docs.append((k, " ".join(rng.choices(words, k=40) + copy + rng.choices(words, k=40))))
    return bench, docs


def random_edits(share):
    def edit(rng, words, j, w):
        if rng.random() >= share:
            return [w]
        kind = rng.randrange(3)
        return [rng.choice(words)] if kind == 0 else [] if kind == 1 else [w, rng.choice(words)]

    return edit


EDITS = {"one in ten": random_edits(0.1), "one in five": random_edits(0.2), "one in three": random_edits(0.33), "every third": lambda rng, words, j, w: [rng.choice(words)] if j % 3 == 2 else [w], "two of five": lambda rng, words, j, w: [rng.choice(words)] if j % 5 in (1, 3) else [w]}


@pytest.mark.parametrize("name", EDITS)
def test_decontamination_recall(spark, name):
    """At least 0.95 of the edited copies that full Smith-Waterman alignment scores high enough are found; all where words are
    replaced by a rule."""
    bench, docs = edited_copies(len(name), 60, EDITS[name])
    rule = Rule()
    code = lambda t: np.array([zlib.crc32(w.encode()) for w in t.split()])
    due = {k for (k, item), (_, doc) in zip(bench, docs, strict=True) if smith_waterman(code(doc), code(item))[0] >= rule.min_score * 2 * len(item.split())}
    assert len(due) >= 20
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    found = {r.doc_id for r in got.collect() if r.doc_id == r.item_id}
    assert len(found & due) >= (1.0 if name in ("every third", "two of five") else 0.95) * len(due)
