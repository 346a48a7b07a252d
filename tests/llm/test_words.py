"""Language ID, LM scoring and decontamination."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from axisloom.llm import language_id
from axisloom.llm import textkernel as K
from axisloom.llm.brown_lm import Settings as LmSettings
from axisloom.llm.brown_lm import _shapes as shapes_of
from axisloom.llm.brown_lm import exchange, fit_brown, held_out_scores, lm_scores
from axisloom.llm.decontaminate import contaminated, decontaminated, smith_waterman
from axisloom.llm.language_id import Settings, fit_language_model, languages
from axisloom.llm.queries import op2_language_id, op7_lm_scoring
from axisloom.llm.textkernel import hash_words

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(k, m):
    return zlib.crc32(str(k).encode()) % m


def test_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    right = [docs[r.doc_id].lang == r.lang_pred for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean(right) > 0.8


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20, "text string, lang string")
    model = fit_language_model(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the mat and the cat " * 20000), (4, "le chat")], "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred) for r in languages(df, model).collect()]
    assert sorted(found) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "fr")]
    none = fit_language_model(train.limit(0))
    assert {r.lang_pred for r in languages(df, none).collect()} == {"und"}


def test_language_sample_of_distinct_texts(spark, monkeypatch):
    name = lambda i: "".join(chr(97 + (i * 7919 // 26**j) % 26) for j in range(4))
    rows = [("the same text said again", "en")] * 3000 + [(f"text {name(i)} about cats", "en") for i in range(200)] + [(f"le texte {name(i)} des chats", "fr") for i in range(200)]
    train, taken = spark.createDataFrame(rows, "text string, lang string"), []
    monkeypatch.setattr(language_id, "_ftrl", lambda model, kept: taken.append([(u.tobytes(), c.tobytes(), y) for u, c, y in kept]))
    for n in (3, 7):
        fit_language_model(train.repartition(n), settings=Settings(max_train_docs=10_000))
    assert taken[0] == taken[1]
    assert 300 < len(taken[0]) == len(set(taken[0])) < 401


def words_of(text):
    return next(iter(K.iter_words(pa.array([text]))))


def test_lm(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), None] for k, t in docs}
    counts = Counter(w for k, ws in tokens.items() if crc(k, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = op7_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_classes_of_all_words(spark):
    rng = np.random.default_rng(3)
    name = lambda g, i: g + "".join(chr(97 + (i // 26**j) % 26) for j in range(3))
    firsts, seconds = ([name(g, i) for i in range(1000)] for g in "pq")
    texts = [" ".join(f"{around}{rng.choice(list('abcdefgh'))} {group[i]}" for i in rng.permutation(1000)) for group, around in ((firsts, "x"), (seconds, "y")) for _ in range(4)]
    _, lexicon = fit_brown(spark.createDataFrame([(t,) for t in texts], "text string"), settings=LmSettings(shared_words=100))
    of = {r.word % 2**64: r.cls for r in lexicon.collect()}
    assert len(of) == 2016 and None not in of.values()
    one, two = ({c: n for c, n in Counter(of[h] for h in hash_words(g).tolist()).items()} for g in (firsts, seconds))
    assert sum(min(one.get(c, 0), two.get(c, 0)) for c in one) < 30


def test_exchange_ends_when_none_moves():
    rng = np.random.default_rng(4)
    bigrams = rng.poisson(rng.gamma(0.3, 2.0, (120, 120))).astype(float)
    cls = exchange(bigrams, np.arange(120) % 9, 9)
    assert (exchange(bigrams, cls, 9) == cls).all()


def brute_alignment(x, y):
    h = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_smith_waterman():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x, y = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        assert smith_waterman(x, y)[0] == brute_alignment(x, y)


def test_contaminated(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with liquor jugs today"
    edited = item.replace("brown", "red").replace("quietly ", "")
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {edited}"), (3, filler), (4, None), (5, ""), (6, "the lazy dog"), (1, item), (None, item)]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    found = contaminated(df, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(1, 7): 2, (2, 7): 1, (None, 7): 1})
    whole = next(r for r in found if r.doc_id == 1 and r.first_word == 300)
    assert (whole.score, whole.end_word) == (1.0, 300 + len(item.split()))
    assert sorted(r.doc_id for r in decontaminated(df, bench).collect()) == [3, 4, 5, 6]
    assert contaminated(df, bench.limit(0)).collect() == []
    assert contaminated(df.limit(0), bench).collect() == []


def test_contaminated_repeated_edits(spark):
    one, two = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    edited = [w if i % 4 else f"x{i}" for i, w in enumerate(one)]
    filler = [f"f{i}" for i in range(60)]
    texts = [filler + edited + filler] * 12 + [filler + two[:20]] * 15 + [two[5:9] + filler] * 30 + [filler + one[5:8] + filler + edited]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(one)), (8, " ".join(two))], "item_id long, text string")
    number = {w: i for i, w in enumerate(one + two + edited + filler)}
    code = lambda ws: np.array([number[w] for w in ws])
    brute = {(k, i): brute_alignment(code(t), code(y)) / 80 for k, t in enumerate(texts) for i, y in ((7, one), (8, two))}
    found = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == {k: x for k, x in brute.items() if x >= 0.4}
    assert len(found) == 28
    assert sorted(r.doc_id for r in decontaminated(df, bench).collect()) == list(range(27, 57))


def test_short_items(spark):
    """Items of fewer than five words count whole, those of fewer than a window too."""
    docs = [(1, "so be it then"), (2, "be it so"), (3, "yes it is"), (4, "one two three four"), (5, "one two three five"), (6, None), (7, "yesterday")]
    bench = spark.createDataFrame([(1, "be it"), (2, "YES"), (3, "one two three four"), (4, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in contaminated(df, bench).collect()}
    assert found == {(1, 1): (1.0, 1, 3), (2, 1): (1.0, 0, 2), (3, 2): (1.0, 0, 1), (4, 3): (1.0, 0, 4)}
    with pytest.raises(ValueError, match="different names"):
        contaminated(df, bench.withColumnRenamed("item_id", "doc_id"), bench_key="doc_id")


def test_lm_edges(spark):
    """Null and empty texts, repeated rows and keys, null keys, unseen words, empty tables, clashing columns."""
    rows = [(1, None, 1), (1, "", 1), (2, "a b a", 2), (2, "a b a", 2), (None, "a b a", 3), (None, None, 3), (3, "unseen 42 words", 4), (4, "long " * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    model, counts = fit_brown(df.filter("doc_id < 3"))
    out = lm_scores(df.repartition(5), model, counts).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(k), len((t or "").split()) + 1) for k, t, _ in rows)
    same = [r.score for r in out if r.n_tokens == 4 and r.doc_id != 3]
    assert len(same) == 3 and max(same) == pytest.approx(min(same)) and all(math.isfinite(r.score) and r.score < 0 for r in out)
    # n tokens of a document, known words and all: a, b and the end
    assert (model.train_tokens, model.vocabulary) == (10, 3)
    assert {r.n_known for r in out if r.doc_id == 3} == {1}
    assert lm_scores(df.limit(0), model, counts).collect() == []
    none, no_counts = fit_brown(df.limit(0))
    assert all(r.n_known == 0 for r in lm_scores(df, none, no_counts).collect())


@pytest.mark.parametrize(("shared", "cluster"), [(0, 1024), (10, 5), (1000, 0)])
def test_lm_probabilities_sum_to_one(spark, shared, cluster):
    """The known words, the end and an unknown word of each shape, after the start of a text."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{chr(97 + i % 26)}{'.' if i % 3 == 0 else ''}{i if i % 4 == 0 else ''}{'é' if i % 5 == 0 else ''}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, 30, p=np.arange(1, 61) / 1830)) for _ in range(20)] + ["once. onceé once1"]
    counts = Counter(w for t in texts for w in t.split())
    model, lexicon = fit_brown(spark.createDataFrame([(t,) for t in texts], "text string"), settings=LmSettings(shared_words=shared, cluster_words=cluster))
    assert len(model.words) == sum(n >= model.least for n in counts.values()) <= shared
    known = {r.word % 2**64: r for r in lexicon.collect()}
    assert sorted(r.n for r in known.values()) == sorted(counts.values()) and all((r.cls is None) == (r.n == 1) for r in known.values())
    unknown = [f"zz{'7' if d else ''}{'ü' if h else ''}{'!' if p else 'z'}" for p in (0, 1) for d in (0, 1) for h in (0, 1)]
    docs = [*counts, *unknown, ""]
    of = {r.text: r for r in lm_scores(spark.createDataFrame([(t,) for t in docs], "text string"), model, lexicon, keep=("text",)).collect()}

    def to_end(word):
        """log10 P(end | word)."""
        w = words_of(word)
        r = known.get(int(w.h[0]))
        return model.log_next[r.cls if r and r.cls is not None else model.shape_class[shapes_of(w)[0]], model.end_class] + model.log_end

    assert sum(10 ** (of[w].score - (to_end(w) if w else 0)) for w in docs) == pytest.approx(1.0)
    assert all(of[w].n_known == (w in counts) + 1 for w in docs if w)


def test_lm_same_whatever_is_shared(spark):
    """Scores don't depend on which words go to the tasks and which are joined."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "never seen wordsé! 77x"), (-4, "long text again " * 100_000), (-5, "a b"), (-5, "a b"), (None, "a b")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = []
    for shared in (0, 10, 10**6):
        rows = held_out_scores(docs, settings=LmSettings(shared_words=shared)).collect()
        found.append(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows))
    assert len(found[0]) == docs.count()
    for other in found[1:]:
        assert [r[:4] for r in other] == [r[:4] for r in found[0]]
        assert np.array([r[4:] for r in other]) == pytest.approx(np.array([r[4:] for r in found[0]]), rel=1e-9)


def test_lm_rounds_against_full_exchange(spark):
    """What moving words in rounds under fixed contexts loses against exchanging all of them one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bits = {}
    for words in (64, 256, 100_000):
        rows = held_out_scores(docs, settings=LmSettings(cluster_words=words, classes=48, class_growth=0.0)).filter("held_out").collect()
        bits[words] = -sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert bits[256] < 1.03 * bits[100_000] and bits[64] < 1.06 * bits[100_000]
