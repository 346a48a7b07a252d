"""Mixing, URL filters, fingerprints, licences, chats and token output."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken

from pyspark.sql import functions as F

from axisloom.llm import license_texts
from axisloom.llm.chat_format import _marker, START, S, fit_chat_model, formatted, marked, recovered
from axisloom.llm.license_scan import _in_common, licenses, patience
from axisloom.llm.materialise import PATTERN, VOCABULARY, Feistel, Layout, materialised, read_sequences
from axisloom.llm.mixing import materialised as repeated
from axisloom.llm.mixing import mixed
from axisloom.llm.queries import llm_oracle_sql, llm_queries, op1_chat_format, op6_simhash
from axisloom.llm.simhash import RADIUS, blocks_for, edited_fingerprints, fingerprints, near_fingerprints
from axisloom.llm.url_filter import allowed, judged
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_sql(spark, name):
    assert_same(llm_queries()[name](spark, SF), connect(SF), llm_oracle_sql()[name])


def test_mix_meets_targets(spark):
    rows = llm_queries()["op3_mixing"](spark, SF).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in by.items())


def test_mix_edges(spark):
    """Repeated rows, null keys, sources and texts, one source, empty tables, clashing columns."""
    rows = [(7, "w " * 10, "a", 0)] * 50 + [(k, "x y " * k, None, 1) for k in range(30)] + [(None, "n n n", "b", 2)] * 40 + [(None, None, "b", 3)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    for n in (1, 7):
        out = mixed(df.repartition(n)).collect()
        sums = {}
        for r in out:
            sums[r.source_size, r.target] = sums.get((r.source_size, r.target), 0) + r.taken
            assert 0 <= r.taken <= 2 * r.size
        assert len(out) == len(rows) and sums == {(500, 1000.0): 1000, (870, 995.0): 995, (120, 240.0): 240}
    half = mixed(spark.createDataFrame([(1, "w " * 10, "a")] * 50 + [(2, "w", "b")] * 10, "doc_id long, text string, source string"), weights=(1, 1), share=1.0).collect()
    assert sum(r.taken for r in half if r.source_size == 500) == pytest.approx(490, abs=50)
    assert mixed(df.limit(0)).collect() == [] and repeated(df.limit(0)).collect() == []
    clash = repeated(df.withColumnsRenamed({"size": "digest"}).withColumn("edge", F.lit(1)).withColumn("s", F.lit(2)))
    assert clash.columns == ["doc_id", "text", "source", "digest", "edge", "s"]
    words = sum(len((r.text or "").split()) for r in clash.collect())
    assert words == 1000 + 995 + 240
    con = connect(SF)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM (SELECT * FROM read_parquet('" + SF + "/documents.parquet') UNION ALL SELECT * FROM read_parquet('" + SF + "/documents.parquet') WHERE doc_id % 3 = 0)")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert_same(mixed(docs.union(docs.filter("doc_id % 3 = 0"))), con, llm_oracle_sql()["op3_mixing"])


def test_url_edges(spark):
    log = spark.createDataFrame([("a.com", "host", "block", 1)], "entry string, kind string, action string, at int")
    pages = spark.createDataFrame([(1, "http://a.com", 5, "x"), (1, "http://a.com", 5, "x"), (None, "http://a.com/" + "p/" * 5000, 5, "y")], "page_id long, url string, fetched_at int, key string")
    assert [r.blocked for r in judged(pages, log).collect()] == [True] * 3
    assert [r.blocked for r in judged(pages, log.limit(0)).collect()] == [False] * 3
    assert judged(pages.limit(0), log).collect() == [] and allowed(pages, log).count() == 0 and allowed(pages, log.limit(0)).columns == pages.columns


def test_urls(spark):
    log = spark.createDataFrame([("a.com", "host", "block", 10), ("a.com", "host", "remove", 20), ("a.com/x/", "path", "allow", 12), ("deep.org/" + "/".join("abcdefghijkl"), "path", "block", 1), (None, "host", "block", 1)], "entry string, kind string, action string, at int")
    deep = "http://deep.org/" + "/".join("abcdefghijkl") + "/m"
    pages = [(1, "http://www.A.com/", 9), (1, "http://www.A.com/", 10), (2, "http://a.com/x/y", 11), (3, "http://a.com/x/y?q", 15), (4, "http://a.com", 20), (5, None, 15), (6, "nonsense", 15), (7, deep, 3), (8, "http://nota.com/", 15), (9, "http://a.com/", None)]
    got = {(r.page_id, r.fetched_at): r.blocked for r in judged(spark.createDataFrame(pages, "page_id long, url string, fetched_at int"), log).collect()}
    assert {k for k, b in got.items() if b} == {(1, 10), (2, 11), (7, 3)} and len(got) == len(pages)


def test_fingerprints(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in op6_simhash(spark, SF).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[1][:cut]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for text, p in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, p) == p
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.1


def simhash(text):
    """Terms and their weights: distinct words, distinct pairs of words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UP))
    return {w: 3 if len(w) > 3 else 1 for w in words} | {f"{a} {b}": 1 for a, b in zip(words, words[1:], strict=False)}


def test_fingerprint_bits(spark):
    """Every bit of fingerprints and the likenesses, from the votes of single terms; null, empty, single and repeated texts."""
    rng = random.Random(1)
    texts = [None, "", " \t ", "one", "One one ONE", "alpha beta gamma delta", "delta gamma beta alpha", " ".join(rng.choices(["of", "the", "house", "garden"], k=40_000)), "é " * 50]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(8, texts[8], "z"), (None, "alpha beta", "z"), (3, "one more text", "z"), (50, "one", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    terms = {term for _, t, _ in rows for term in simhash(t or "")}
    hashed = {r.t: (r.h0 % 2**64, r.h1 % 2**64) for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.xxhash64("t").alias("h0"), F.xxhash64("t", F.lit(1)).alias("h1")).collect()}

    def bits(text):
        votes, whole = np.zeros(128, dtype=np.int64), 0
        for term, w in simhash(text).items():
            value = (hashed[term][0] << 64) | hashed[term][1]
            votes += w * np.array([value >> (127 - i) & 1 for i in range(128)])
            whole += w
        return f"{int(''.join('1' if 2 * v > whole else '0' for v in votes) or '0', 2):032x}"

    known = {t or "": bits(t or "") for _, t, _ in rows if len(t or "") < 1000}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.fingerprint)
    for k, t, _ in rows:
        if (t or "") in known:
            assert known[t or ""] in by[k], (k, t)
    assert by[5] != by[6]  # order counts
    near = lambda x, y: 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 128
    for r in got:
        assert r.near_edited == pytest.approx(near(r.fingerprint, r.edited_fingerprint))
    first = {r.doc_id: r for r in got}
    assert first[7].near_next == pytest.approx(near(first[7].fingerprint, first[6].fingerprint))
    assert first[0].n_near == sum(f.strip("0") == "" for fs in by.values() for f in fs if fs is not by[None]) and first[50].n_near >= 2 and first[5].n_near is None
    assert edited_fingerprints(df.limit(0)).collect() == []
    one = edited_fingerprints(spark.createDataFrame([(4, "abc def ghi")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_near_recall(spark):
    """Of copies with words replaced, so that the 3-word shingles keep a Jaccard of 0.9 or more, nine in ten are within the radius."""
    rng = random.Random(8)
    shingles = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    rows = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").orderBy("doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        for n in range(1, 1 + len(words) // 50):
            copy = list(words)
            for i in rng.sample(range(len(words)), n):
                copy[i] = f"word{rng.randrange(10**6)}"
            if 10 * len(shingles(words) & shingles(copy)) >= 9 * len(shingles(words) | shingles(copy)):
                rows.append((len(rows), " ".join(words), " ".join(copy)))
    got = fingerprints(spark.createDataFrame(rows, "id long, text string, copy string"), ["id"], ["text", "copy"]).collect()
    bits = [((r.a0 ^ r.a1) % 2**64).bit_count() + ((r.b0 ^ r.b1) % 2**64).bit_count() for r in got]
    assert len(bits) == len(rows) > 100 and np.mean([b <= RADIUS for b in bits]) >= 0.9


def test_near_counts(spark):
    """The query's count of near rows against all pairs."""
    rows = op6_simhash(spark, SF).collect()
    for r in rows:
        want = sum((int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).bit_count() <= RADIUS for o in rows) if r.doc_id % 50 == 0 else None
        assert r.n_near == want
    assert any(r.n_near for r in rows)
    assert blocks_for(100, 9) == 10 and blocks_for(10**10, 9) > blocks_for(10**7, 9) > 10


def test_patience():
    assert patience(list("abcdef"), list("abcdef")) == [(i, i) for i in range(6)]
    rng = random.Random(3)
    for _ in range(50):
        a, b = (rng.choices("abcdefgh", k=rng.randrange(15)) for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_licenses(spark):
    mit = license_texts.TEMPLATES["MIT"]
    docs = [(1, "x " * 3000 + mit + " y" * 3000), (2, mit.upper().replace("SUBLICENSE", "sell")), (3, "nothing here"), (4, None), (5, "")]
    got = {r.doc_id: r.license for r in licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}


def test_license_windows(spark):
    """Intact texts are covered whole, whatever stands before, between and behind them."""
    rng = random.Random(2)
    mit = license_texts.TEMPLATES["MIT"]
    noise = lambda k: " ".join(rng.choices(mit.split(), k=k))
    docs = [(1, noise(300) + " " + mit + " " + noise(200)), (2, " ".join([mit, noise(60)] * 20)), (3, " ".join(rng.choices(" ".join(license_texts.TEMPLATES.values()).split(), k=20_000))), (4, license_texts.TEMPLATES["BSD-3-Clause"]), (5, "All rights reserved."), (None, mit), (5, mit)]
    df = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id long, text string, license string")
    rows = licenses(df).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].coverage == 1.0 and by[None][0].license == "MIT"
    assert [f.coverage for f in by[2][0].licenses if f.license == "MIT"] == [1.0] * 20
    assert by[3][0].license is None and by[4][0].license == "BSD-3-Clause" and by[4][0].coverage == 1.0
    assert {r.license for r in by[5]} == {"All-rights-reserved-notice", "MIT"}
    assert licenses(df.limit(0)).collect() == []


def test_words_in_common():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, span = int(rng.integers(1, 40)), int(rng.integers(1, 60))
        at, word, times = np.sort(rng.choice(100, n, replace=False)), rng.integers(0, 5, n), rng.integers(0, 4, 5)
        for k, bound in enumerate(_in_common(at, word, times, span)):
            own = Counter(word[(at >= at[k]) & (at < at[k] + span)].tolist())
            assert bound == sum(min(v, times[w]) for w, v in own.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_chat(spark, sf):
    """Held-out rows: roles of those with a marker, of those without, and one role a row where no marker stands inside."""
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    known = {(r.conv_id, r.turn): r.role for r in table.collect()}
    raw = {(r.conv_id, r.turn): r.text for r in marked(table).collect()}
    texts = {(r.conv_id, r.turn): r.text for r in table.collect()}
    rows = op1_chat_format(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(known)
    assert all(len(r.roles) == 1 for r in rows if not any(1 <= _marker(x)[0] <= 3 for x in raw[r.conv_id, r.turn].split("\n")[1:]))
    right = {True: [], False: []}
    for r in rows:
        k = (r.conv_id, r.turn)
        if r.held_out:
            right[raw[k] != texts[k]].append(known[k] == r.role)
    assert np.mean(right[True] + right[False]) > 0.85
    assert np.mean(right[True]) >= 0.99
    if sf == "sf0.01":
        assert len(right[False]) > 20 and np.mean(right[False]) > 0.9


def test_chat_long_rows_and_ties(spark):
    """A row of very many lines, marked turns inside a row, and rows of one turn that tie."""
    model = fit_chat_model(marked(spark.read.parquet(f"{SF}/conversations.parquet")))
    long = "\n".join(["User: begin"] + ["more of it."] * 60_000)
    rows = [(1, 0, long), (2, 0, "User: hi?\nand this\nBot: hello.\nUser: bye"), (3, 1, "Bot: b"), (3, 1, "User: a"), (3, 1, "User: a"), (3, 2, "Assistant: c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = formatted(df, model).collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    assert by[1][0].roles == ["user"] and by[1][0].rendered == "<|user|>\n" + long.removeprefix("User: ")
    assert by[2][0].roles == ["user", "assistant", "user"] and by[2][0].role == "user"
    assert by[2][0].rendered == "<|user|>\nhi?\nand this\n<|end|>\n<|assistant|>\nhello.\n<|end|>\n<|user|>\nbye"
    # tied rows come in the order of their texts' digests, however they are dealt
    again = formatted(df.orderBy(F.desc("text")).coalesce(1), model, block=1).collect()
    assert len(by[3]) == 4 and sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_chat_paths(spark):
    """Viterbi in blocks of two rows against all paths of short transcripts, with repeats, nulls and clashing columns."""
    model = fit_chat_model(marked(spark.read.parquet(f"{SF}/conversations.parquet")))
    rows = [(1, 0, "User: hi?"), (1, 1, "well.\nthis too"), (1, 2, "Bot: x"), (1, 2, "Bot: x"), (2, 0, None), (2, 5, "what?"), (3, 0, ""), (3, 4000, "[System] be kind."), (3, 4001, "no")]
    df = spark.createDataFrame([(*r, 1, "z") for r in [*rows, (None, 1, "lost"), (4, None, None)]], "conv_id long, turn long, text string, entry int, role string")
    found = {}
    for r in recovered(df, model, block=2).orderBy("conv_id", "turn").collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, own in found.items():
        assert len(own) == sum(k == c for k, *_ in rows)
        e = model.emission(b"".join(bytes(r.seen) for r in own))
        score = lambda path: sum(model.step[a, b] + e[i, b] for i, (a, b) in enumerate(zip((START, *path), path, strict=False)))  # noqa: B023, E731
        best = max(score(p) for p in itertools.product(range(S), repeat=len(e)))
        # the best path through the states that were found at the ends of rows is as good
        ends, upto = {}, 0
        for r in own:
            upto += len(r.seen)
            ends[upto - 1] = r.exit
        assert max(score(p) for p in itertools.product(*[[ends[i]] if i in ends else range(S) for i in range(len(e))])) == pytest.approx(best)
        assert own[0].entry == START and all(a.exit == b.entry for a, b in zip(own, own[1:], strict=False) if a.turn != b.turn)
    out = formatted(df, model).collect()
    assert len(out) == len(rows) + 2
    assert {(r.conv_id, r.turn, r.role, r.rendered) for r in out if r.conv_id is None or r.turn is None} == {(None, 1, None, "lost"), (4, None, None, "")}
    assert formatted(df.limit(0), model).collect() == [] and fit_chat_model(df.limit(0)).step.shape == (S + 1, S + 1)
    many = spark.createDataFrame([(9, 0, "Bot: again")] * 300, "conv_id long, turn long, text string")
    assert formatted(many, model, block=16).count() == 300


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_feistel(size):
    p = Feistel(size, 12345)
    slot = p.slot(np.arange(size))
    assert sorted(slot) == list(range(size)) and (p.index(slot) == np.arange(size)).all()


def test_tokens_round_trip(spark, tmp_path):
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world\n\n it's 12 o'clock ", None, "", "  \t", "café   naïve 日本", "a" * 9000, " " * 5000 + "end", "word word  word" * 500]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, slot int").coalesce(1)
    layout, out = Layout(seq_len=16, shard_bytes=4096), f"file://{tmp_path}"
    rows = sorted(materialised(docs, out, layout=layout).collect(), key=lambda r: r.sequence)
    read = {s: t for s, t in read_sequences(out)}
    assert sorted(read) == list(range(len(rows)))
    stream = [t for r in rows for t in read[r.slot][: r.n_tokens].tolist()]
    expected = [t for text in texts for t in [*enc.encode_ordinary(text or ""), layout.end_token]]
    assert stream == expected
    assert [s for s, _ in read_sequences(out, 7)] == list(range(7, len(rows)))


def test_no_tokens(spark, tmp_path):
    assert materialised(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}").collect() == []


def test_near_fingerprints(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(128) for _ in range(40)]
    for base in fps[:30]:  # near copies at 1 to 15 bits
        for n in (1, 3, 4, 7, 9, 10, 15):
            copy = base
            for bit in rng.sample(range(128), n):
                copy ^= 1 << bit
            fps.append(copy)
    fps += [(0xABCD << 112) | rng.getrandbits(112) for _ in range(300)]  # one hot block
    fps += fps[:20]  # equal ones
    rows = [(i, f"{f:032x}") for i, f in enumerate(fps)] + [(None, f"{fps[0]:032x}"), (9999, None)]
    pairs, members = near_fingerprints(spark.createDataFrame(rows, "doc_id long, fingerprint string"))
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    brute = {(min(i, j), max(i, j), (f ^ g).bit_count()) for f, i in first.items() for g, j in first.items() if i < j and (f ^ g).bit_count() <= RADIUS}
    found = [(r.a, r.b, r.bits) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == brute
    assert {b for *_, b in found} >= {1, 3, 4, 7, 9}
    assert sorted((r.doc_id, r["class"]) for r in members.collect()) == [(i, first[f]) for i, f in enumerate(fps)]
