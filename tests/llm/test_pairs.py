"""The n-gram Jaccard join against brute force."""

import random
import re

import pytest

from axisloom.llm.jaccard_join import jaccard_classes, one_of_each_class
from axisloom.llm.queries import op8_jaccard_join

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    """(id, size, component) by comparing all pairs."""
    sets = {}
    for k, t in rows:
        sets.setdefault(k, []).append(shingles(t, n))
    own = sorted(k for k in sets if k is not None)
    root = {k: k for k in own}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    inter = len(x & y)
                    if inter and den * inter >= num * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return sorted(((k, len(shingles(t, n)), None if k is None else find(k)) for k, t in rows), key=str)


def got(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(seed, groups=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "ONE two"), (6, "a b c"), (None, "a b c"), (7, " x y z"), (8, "word " * 5000)]
    k = 10
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([12, 40, 120]))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((k, " ".join(copy)))
            k += 1
    return out


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_brute_force(spark, n, num, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, component_id int, size string")
    assert got(jaccard_classes(df, n=n, num=num).select("doc_id", "n_shingles", "component_id")) == brute(rows, n, num, 100)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op8_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id")) == brute(rows, 3, 90, 100)


def test_one_stays(spark):
    rows = [*near_copies(4, 3), (10, near_copies(4, 3)[9][1])]  # the last repeats a row
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in one_of_each_class(df).collect()]
    expected = {c for _, _, c in brute(rows, 5, 80, 100) if c is not None}
    assert sorted(k for k in kept if k is not None) == sorted(expected)
    assert kept.count(None) == 1


def test_one_stays_of_repeated_keys(spark):
    """Texts of one key that are no near duplicates all stay, and what is near to any of them goes."""
    rng = random.Random(12)
    one, two, three = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=40)) for _ in range(3))
    rows = [(3, one), (5, one), (5, two), (5, two), (7, two + " tail"), (9, three), (9, three), (None, one), (None, one), (11, None), (11, None)]
    kept = one_of_each_class(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, one), (5, two), (9, three), (None, one), (None, one), (11, None)], key=str)


def test_repeated_keys(spark):
    """A key with several texts is one node, with the links of all of them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n=30: " ".join(rng.choices(words, k=n))
    one, two, three, four = text(), text(), text(), text()
    rows = [(3, one), (5, one), (5, two), (7, two), (9, three), (9, four), (11, four + " tail"), (2, three), (13, text()), (13, text()), (13, None), (14, ""), (15, four)]
    rows += [(20 + k % 7, text(rng.choice([6, 20, 60]))) for k in range(40)]
    long = text(3000).split()
    for k in range(6):  # above WIDE_FROM, near and not so near
        copy = list(long)
        for i in rng.sample(range(3000), [0, 3, 20, 60, 120, 400][k]):
            copy[i] = rng.choice(words)
        rows += [(40 + k, " ".join(copy)), (50 + k % 3, " ".join(rng.choices(words, k=3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num in ((3, 90), (5, 80)):
        assert got(jaccard_classes(df, n=n, num=num).select("doc_id", "n_shingles", "component_id")) == brute(rows, n, num, 100)


def test_common_shingle(spark):
    """One shingle in 20,000 unrelated documents, and near copies among them."""
    rng = random.Random(9)
    rows = [(k, f"all share this {' '.join(f'u{rng.randrange(10**6)}' for _ in range(20))}") for k in range(20_000)]
    rows += [(20_000 + k, t.replace("all", "each", 1)) for k, t in rows[:50]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in jaccard_classes(df, n=3, num=80).collect()}
    assert all(found[k] == (k - 20_000 if k >= 20_000 else k) for k in found) and len(found) == 20_050


def test_empty(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
