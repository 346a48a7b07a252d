"""LM scoring with Brown class-based bigrams.

A word is predicted in two steps: its class from the class of the word before, and the word from its
class.  Classes come from the exchange algorithm: starting from an assignment by frequency, each word in
turn moves to the class that raises the likelihood of the training bigrams most, until no word moves.

Scale.  Every word seen at least twice is placed in a class by its own neighbours, whatever the size of the corpus.
The number of classes grows with theirs.
The most frequent ``cluster_words`` words are exchanged one by one on the driver, from a dense table of their
bigram counts, until none moves; in it all other words stand for one of eight shapes (ends in punctuation,
has a digit, has a byte above 127).  The other words seen twice or more then
move in rounds on the executors, from sparse counts of each word by the class before and after it, where the classes of
the first step are fixed (so a neighbour that isn't among the ``cluster_words`` counts as its shape).  A
round moves each word to its best class under the model of the round before; rounds end when
their likelihood rises by less than ``least_rise`` of itself.  Words seen once stay with their shape: they
are what is known of unknown words.

Counts and classes of all words are a stored table, the lexicon.  Its most frequent part, at most ``shared_words`` words,
goes to the tasks; a text's other words are joined to it by word and brought back to their places in the text.  What is
shared changes the speed alone, not the result.

Smoothing.  Class transitions back off to the class frequencies with a Dirichlet prior.  Words of a
shape share its mass by absolute discounting; what the discount frees is the probability of a word never
seen in training.  One end token closes every document.  The probabilities of V known words and the
unknown word sum to one after every history.

Words are named by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import crc_mod, drop_stored, stored

SHAPES = 8
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class Settings:
    """Bounds of what is kept in memory, and of the fit."""

    cluster_words: int = 1024
    #: The number of classes is the vocabulary to the power of class_growth, this at least.
    classes: int = 48
    class_growth: float = 0.3
    least_rise: float = 1e-4
    #: At most this many words, the most frequent, go to the tasks with their classes; the others are joined.
    shared_words: int = 262_144
    prior: float = 20.0


def _shapes(w: K.Words) -> np.ndarray:
    """Shape of every word."""
    if not len(w.h):
        return np.zeros(0, dtype=np.int64)
    digit = np.concatenate([[0], np.cumsum(_DIGIT[w.low], dtype=np.int32)])
    high = np.concatenate([[0], np.cumsum(w.low >= 128, dtype=np.int32)])
    return _PUNCT[w.low[w.ends - 1]] + 2 * (digit[w.ends] > digit[w.starts]) + 4 * (high[w.ends] > high[w.starts]).astype(np.int64)


def _spread(mask: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x where mask is set, 0 elsewhere."""
    out = np.zeros(len(mask))
    out[mask] = x
    return out


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(h), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, shape, n) over all rows: word is the hash, n its count."""

    def count(batches):
        held, held_n, held_s = [], [], []

        def flush():
            h, inv = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate(held_n)).astype(np.int64)
            s = np.zeros(len(h), dtype=np.int64)
            s[inv] = np.concatenate(held_s)
            return h, n, s

        for batch in batches:
            for w in K.iter_words(batch.column(0)):
                h, first, n = np.unique(w.h, return_index=True, return_counts=True)
                held.append(h)
                held_n.append(n)
                held_s.append(_shapes(w)[first])
            if sum(map(len, held)) > 1_000_000:
                h, n, s = flush()
                held, held_n, held_s = [h], [n], [s]
                if len(h) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(n)], ["word", "shape", "n"])
                    held, held_n, held_s = [], [], []
        if held:
            h, n, s = flush()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(n)], ["word", "shape", "n"])

    return docs.select(text).mapInArrow(count, "word long, shape long, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


@dataclass
class BrownModel:
    """A fitted model, but for the words that are left in the lexicon."""

    words: np.ndarray  # sorted hashes of the shared words, those seen least times or more
    words_n: np.ndarray  # their counts
    words_class: np.ndarray  # and classes
    least: int
    end_class: int
    shape_class: np.ndarray
    mass: np.ndarray  # tokens of each class
    log_end: float  # log10 P(end | its class)
    log_shape: np.ndarray  # log10 P(shape | its class)
    shape_n: np.ndarray  # tokens and types of each shape among the words seen once
    shape_types: np.ndarray
    discount: float
    train_tokens: int
    vocabulary: int
    end_count: int
    prior: float
    log_next: np.ndarray | None = None  # log10 P(class | class before)

    def log_base(self, c):
        return np.log10((c + 1.0) / (self.train_tokens + 1.0 * (self.vocabulary + 1)))

    def log_word(self, cls, n):
        """log10 P(word | its class) of words seen n >= 2 times."""
        return np.log10(n / self.mass[cls])

    def log_rare(self, shape, n):
        """log10 P(word | class of its shape) of words seen once (n = 1) or never (0)."""
        size = np.maximum(self.shape_n, 1.0)
        unseen = np.where(self.shape_n > 0, self.discount * self.shape_types / size, 1.0)
        return self.log_shape[shape] + np.log10(np.where(n > 0, (1.0 - self.discount) / size[shape], unseen[shape]))


def _with_ends(place: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all rows with an end after each, and the place before each of them (an end before the first)."""
    n = len(off) - 1
    seq = np.full(len(place) + n, end, dtype=np.int64)
    seq[np.arange(len(place)) + np.repeat(np.arange(n), np.diff(off))] = place
    before = np.concatenate([[end], seq[:-1]])
    return seq, before


def exchange(bigrams: np.ndarray, start: np.ndarray, classes: int) -> np.ndarray:
    """Class of each place: each place moves to the class that raises the sum of N(c, d) log N(c, d)
    - N(c) log N(c) - N(d) log N(d) most, in order of frequency, until none moves."""
    cls = start.copy()
    v = len(cls)
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    onehot = np.zeros((v, classes))
    onehot[np.arange(v), cls] = 1
    row = bigrams @ onehot  # place to class
    col = bigrams.T @ onehot  # class to place, by place
    table = onehot.T @ row
    n_left, n_right = onehot.T @ left, onehot.T @ right

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    base = xlogx(table)
    # what counts as a rise: more than rounding may feign, so that no place moves in circles
    least = 1e-9 + 1e-12 * float(xlogx(bigrams.sum()))
    moved = 1
    while moved:
        moved = 0
        for i in np.argsort(-(left + right), kind="stable"):
            a, r, c, own = cls[i], row[i].copy(), col[i].copy(), bigrams[i, i]
            r[a] -= own  # without the place itself
            c[a] -= own
            # take the place out
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            n_left[a] -= left[i]
            n_right[a] -= right[i]
            base[a], base[:, a] = xlogx(table[a]), xlogx(table[:, a])
            # what putting it into each class adds
            rows = (xlogx(table + r[None, :]) - base).sum(axis=1)
            cols = (xlogx(table + c[:, None]) - base).sum(axis=0)
            d = np.diagonal(table)
            both = xlogx(d + r + c + own) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            gain = rows + cols + both - (xlogx(n_left + left[i]) - xlogx(n_left)) - (xlogx(n_right + right[i]) - xlogx(n_right))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            base[b], base[:, b] = xlogx(table[b]), xlogx(table[:, b])
            n_left[b] += left[i]
            n_right[b] += right[i]
            if b != a:
                moved += 1
                cls[i] = b
                row[:, a] -= bigrams[:, i]
                row[:, b] += bigrams[:, i]
                col[:, a] -= bigrams[i]
                col[:, b] += bigrams[i]
    return cls


def _transitions(table: np.ndarray, mass: np.ndarray, prior: float) -> np.ndarray:
    """P(class | class before), backing off to the share of each class in mass."""
    share = mass / mass.sum()
    return (table + prior * share[None, :]) / (table.sum(axis=1, keepdims=True) + prior)


def _pair_sums(train: DataFrame, side: int, codes) -> np.ndarray:
    """A side x side table of how often each code follows each, over all rows; codes gives those of a Words."""

    def pairs(batches):
        dense = np.zeros(side * side, dtype=np.int64)
        for batch in batches:
            for w in K.iter_words(batch.column(0)):
                seq, before = codes(w)
                dense += np.bincount(before * side + seq, minlength=side * side)
        used = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(dense[used])], ["pair", "n"])

    out = np.zeros(side * side)
    found = train.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(side, side)


def _contexts(train: DataFrame, start, cls: np.ndarray, classes: int, k: int) -> DataFrame:
    """(word, shape, ctx, n) stored: for each word seen twice or more that isn't exchanged one by one, the classes ctx before it
    and (ctx - classes) after it, and how often each is.

    A task sends a word's counts as one record; records of a word come sorted and are added up as they stream by."""
    width = 2 * classes

    def merged(h, s, ctx, n):
        """The same counts with each (h, ctx) once, in the order of h."""
        words, first, inv = np.unique(h, return_index=True, return_inverse=True)
        key = inv * width + ctx
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
        own = key[head] // width
        return words[own], s[first][own], (key[head] % width).astype(np.int16), np.add.reduceat(n[order], head) if len(head) else n

    def records(found, least):
        """A record of each word seen least times or more."""
        h, s, ctx, n = found
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), h[1:] != h[:-1]]))
        if not len(head):
            return
        size = np.diff(np.append(head, len(h)))
        # every occurrence has a class before it and one after it
        kept = np.add.reduceat(n, head) >= 2 * least
        entries = np.repeat(kept, size)
        off = pa.array(np.concatenate([[0], np.cumsum(size[kept])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x[entries])) for x in (ctx, n)]
        whole = pa.RecordBatch.from_arrays([pa.array(h[head][kept].view(np.int64)), pa.array(s[head][kept].astype(np.int32)), *lists], ["word", "shape", "ctx", "n"])
        for i in range(0, len(whole), 50_000):
            yield whole.slice(i, 50_000)

    def count(batches):
        held = []
        for batch in batches:
            for w in K.iter_words(batch.column(0)):
                shapes = _shapes(w)
                place = _start_places(start.value, w, shapes, k)
                seq, before = _with_ends(cls[place], w.off, int(cls[k]))
                tail = np.flatnonzero(place > k)
                own = tail + w.row_of_word()[tail]
                h, s = np.tile(w.h[tail], 2), np.tile(shapes[tail].astype(np.int8), 2)
                held.append(merged(h, s, np.concatenate([before[own], classes + seq[own + 1]]), np.ones(len(h), dtype=np.int64)))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > 1_000_000:
                    yield from records(held[0], 0)
                    held = []
        if held:
            yield from records(merged(*map(np.concatenate, zip(*held, strict=True))), 0)

    def add_up(batches):
        last = None  # the counts of the last word, which may go on
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            found = [np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1)] + [batch.column(i).flatten().to_numpy() for i in (2, 3)]
            found[0] = found[0].view(np.uint64)
            if last is not None:
                found = [np.concatenate(x) for x in zip(last, found, strict=True)]
            if not len(found[0]):
                continue
            end = found[0][-1]
            found = merged(*found)
            goes_on = found[0] == end
            last = [x[goes_on] for x in found]
            yield from records([x[~goes_on] for x in found], 2)
        if last is not None:
            yield from records(last, 2)

    schema = "word long, shape int, ctx array<short>, n array<long>"
    return stored(train.mapInArrow(count, schema).repartition("word").sortWithinPartitions("word").mapInArrow(add_up, schema), "contexts")


def _dense(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    """The counts of a batch of _contexts(), a row of 2 x classes for each word."""
    size = len(batch)
    row = np.repeat(np.arange(size), np.diff(batch.column("ctx").offsets.to_numpy()))
    return np.bincount(row * 2 * classes + batch.column("ctx").flatten().to_numpy(), weights=batch.column("n").flatten().to_numpy(), minlength=size * 2 * classes).reshape(size, -1)


def _cells(df: DataFrame, add, size: int) -> np.ndarray:
    """The sum over all batches of what add(batch) gives, an array of a fixed size."""

    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            total += add(batch)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    out = np.zeros(size)
    found = df.mapInArrow(sums, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _onehot(at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    out[np.arange(len(at)), at] = 1
    return out


def _best_sums(contexts: DataFrame, classes: int, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """With each word in its best class: the log likelihood, and the sums of the words' counts by class."""
    shared = contexts.sparkSession.sparkContext.broadcast(weights)

    def add(batch):
        x = _dense(batch, classes)
        gain = x @ shared.value
        best = np.argmax(gain, axis=1)
        return np.concatenate([[gain[np.arange(len(x)), best].sum()], (_onehot(best, classes).T @ x).ravel()])

    sums = _cells(contexts, add, 1 + 2 * classes * classes)
    return sums[0], sums[1:].reshape(classes, 2 * classes)


def _best_classes(contexts: DataFrame, classes: int, weights: np.ndarray) -> DataFrame:
    """(word, cls): each word's best class."""
    shared = contexts.sparkSession.sparkContext.broadcast(weights)

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.argmax(_dense(batch, classes) @ shared.value, axis=1).astype(np.int32))], ["word", "cls"])

    return contexts.mapInArrow(assign, "word long, cls int")


def _start_places(core: tuple[np.ndarray, np.ndarray], w: K.Words, shapes: np.ndarray, k: int) -> np.ndarray:
    """Each word's place in the exchange of the k most frequent: its own, or that of its shape after the end's, k."""
    words, place = core
    at = _find(words, w.h)
    return np.where(at >= 0, place[at] if len(place) else at, k + 1 + shapes)


def _fit_classes(train: DataFrame, settings: Settings) -> tuple[BrownModel, DataFrame]:
    """The model of all rows of train but for its transitions, and the stored lexicon (word, shape, n, cls) of all words;
    cls is null for words seen once.  train has one column, the text."""
    spark = train.sparkSession
    sc = spark.sparkContext
    counts = stored(word_counts(train, train.columns[0]), "words")
    n_docs = train.count()
    tokens, types, n1, n2 = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    shape_n, shape_types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.filter("n < 2").groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        shape_n[r["shape"]], shape_types[r["shape"]] = r["n"], r["types"]
    # the most frequent words, exchanged one by one
    top = counts.filter("n >= 2").orderBy(F.desc("n"), "word").limit(settings.cluster_words).select("word").toArrow()
    frequent = top["word"].to_numpy()
    k = len(frequent)
    order = np.argsort(frequent.view(np.uint64))
    start = sc.broadcast((frequent.view(np.uint64)[order], order))
    places = k + 1 + SHAPES
    bigrams = _pair_sums(train, places, lambda w: _with_ends(_start_places(start.value, w, _shapes(w), k), w.off, k))
    v = types - n1
    classes = max(1, min(max(settings.classes, round(v**settings.class_growth)), places))
    first = np.zeros(places, dtype=np.int64)
    first[np.argsort(-bigrams.sum(axis=0), kind="stable")] = np.arange(places) % classes
    cls = exchange(bigrams, first, classes)
    found = spark.createDataFrame([(int(w), int(c)) for w, c in zip(frequent, cls, strict=False)], "word long, cls int")
    contexts = None
    if v > k:
        onehot = _onehot(cls, classes)
        own = onehot.copy()
        own[k + 1 :] = 0
        contexts = _contexts(train, start, cls, classes, k)
        # words seen once stay with their shapes: all of a shape without the words that are to move
        before, after = onehot.T @ bigrams, (bigrams @ onehot).T
        moving = _cells(contexts, lambda b: (_onehot(b.column("shape").to_numpy(), SHAPES).T @ _dense(b, classes)).ravel(), SHAPES * 2 * classes).reshape(SHAPES, -1)
        fixed_before, fixed_after = before @ own, own.T @ after.T
        for shape in range(SHAPES):
            at = k + 1 + shape
            fixed_before[:, cls[at]] += before[:, at] - moving[shape, :classes]
            fixed_after[cls[at]] += after[:, at] - moving[shape, classes:]
        left = right = onehot.T @ bigrams @ onehot
        reached = -np.inf
        while True:
            mass = left.sum(axis=0) + 0.5
            weights = np.concatenate([np.log(_transitions(left, mass, settings.prior)) - np.log(mass)[None, :], np.log(_transitions(right, right.sum(axis=0) + 0.5, settings.prior)).T])
            likelihood, sums = _best_sums(contexts, classes, weights)
            if likelihood <= reached + settings.least_rise * abs(likelihood):
                break
            reached = likelihood
            left, right = fixed_before + sums[:, :classes].T, fixed_after + sums[:, classes:]
        found = found.unionByName(_best_classes(contexts, classes, weights))
    lexicon = stored(counts.join(found, "word", "left"), "lexicon")
    drop_stored(counts)
    if contexts is not None:
        drop_stored(contexts)
    # the words that go to the tasks: those above the least power of two that not too many words reach
    sizes = {r["b"]: r["words"] for r in lexicon.filter("n >= 2").groupBy(F.floor(F.log2("n") + 1e-9).alias("b")).agg(F.count("*").alias("words")).collect()}
    reach, bit = 0, max(sizes, default=0) + 1
    while bit > 1 and reach + sizes.get(bit - 1, 0) <= settings.shared_words:
        bit -= 1
        reach += sizes.get(bit, 0)
    shared = lexicon.filter(F.col("n") >= 2**bit).select("word", "n", "cls").toArrow()
    hashes = shared["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    # what is never seen (a shape without words, an end without documents) still gets a share
    ends, shapes = n_docs + 0.5 * (n_docs == 0), shape_n + 0.5 * (shape_n == 0)
    end_class, shape_class = int(cls[k]), cls[k + 1 :]
    mass = np.bincount(np.append(shape_class, end_class), weights=np.append(shapes, ends), minlength=classes)
    for r in lexicon.filter("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        mass[r["cls"]] += r["n"]
    model = BrownModel(
        hashes[order], shared["n"].to_numpy()[order], shared["cls"].to_numpy()[order], 2**bit, end_class, shape_class, mass,
        float(np.log10(ends / mass[end_class])), np.log10(shapes / mass[shape_class]), shape_n, shape_types,
        min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2))), tokens + n_docs, types + (n_docs > 0), n_docs, settings.prior,
    )
    return model, lexicon


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _spans(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of a binary array without nulls."""
    _, off, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    off = np.frombuffer(off, dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return np.diff(off).astype(np.int64), data[off[0] : off[-1]]


def _encoded(docs: DataFrame, model: BrownModel, lexicon: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """own (a struct of the columns in keep), seq (the classes of the text's words and of its end, 16 bits each), n_known,
    base_score, and place: the sum of log10 P(word | its class).

    Words that aren't shared leave the row for the join by word and come back with their positions.  Parts of a row
    meet again under two digests of its values and its partition, so that a task that runs again gives the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own_type = T.StructType([f for c in keep for f in docs.schema.fields if f.name == c])
    wide = T.StructType([T.StructField("row", T.LongType()), T.StructField("row2", T.LongType()), T.StructField("word", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("shape", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("place", T.DoubleType()), T.StructField("own", own_type)])

    def parts(batches):
        """A record of each row (at -1; data: classes) and of each other word of it (at: its first position; data: all of them)."""
        m = shared.value
        for batch in batches:
            own = pa.StructArray.from_arrays(batch.columns[: len(keep)], names=list(keep))
            ids = [batch.column(len(keep) + j).to_numpy() for j in (1, 2)]
            for w in K.iter_words(batch.column(len(keep))):
                n, owner = len(w), w.row_of_word()
                id1, id2 = (x[w.first : w.first + n] for x in ids)
                found = _find(m.words, w.h)
                here = found >= 0
                c, cls = m.words_n[found[here]], m.words_class[found[here]]
                full = np.full(len(w.h) + n, m.end_class, dtype=np.int16)
                full[(np.arange(len(w.h)) + owner)[here]] = cls
                place = np.bincount(owner, weights=_spread(here, m.log_word(cls, c)), minlength=n) + m.log_end
                base = np.bincount(owner, weights=_spread(here, m.log_base(c)), minlength=n) + m.log_base(m.end_count)
                known = np.bincount(owner, weights=here, minlength=n).astype(np.int64) + (m.end_count > 0)
                rest = np.flatnonzero(~here)
                rest = rest[np.lexsort((w.h[rest], owner[rest]))]
                o, h = owner[rest], w.h[rest]
                head = np.flatnonzero(np.concatenate([np.ones(min(1, len(rest)), dtype=bool), (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
                positions = (rest - w.off[o]).astype(np.int32)
                row_ends, word_ends = 2 * (w.off + np.arange(n + 1)), 4 * np.append(head, len(rest))
                data = _binary(np.concatenate([row_ends, row_ends[-1] + word_ends[1:]]), np.concatenate([full.view(np.uint8), positions.view(np.uint8)]))
                one, none = np.arange(n), len(head)
                mask = np.concatenate([np.zeros(n, dtype=bool), np.ones(none, dtype=bool)])
                of = np.concatenate([one, o[head]])
                zeros = np.zeros(none)
                cols = [
                    pa.array(id1[of]),
                    pa.array(id2[of]),
                    # a row's own record takes a key that no other has, to be spread by the join
                    pa.array(np.concatenate([K.mix(id1.view(np.uint64)), h[head]]).view(np.int64)),
                    pa.array(np.concatenate([np.full(n, -1, dtype=np.int32), positions[head]])),
                    pa.array(np.concatenate([np.zeros(n), _shapes(w)[rest][head]]).astype(np.int32)),
                    data,
                    pa.array(np.concatenate([known, zeros.astype(np.int64)])),
                    pa.array(np.concatenate([base, zeros])),
                    pa.array(np.concatenate([place, zeros])),
                    own.slice(w.first, n).take(pa.array(np.concatenate([one, zeros.astype(np.int64)]), mask=mask)),
                ]
                yield pa.RecordBatch.from_arrays(cols, wide.names)

    def whole(held):
        """The rows of whole groups of parts; n rows that are equal have n own records and n of each word."""
        m = shared.value
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pa.array(np.lexsort([t[c].to_numpy() for c in ("at", "row2", "row")]))).combine_chunks()
        col = {c: t[c].chunk(0) for c in t.column_names}
        num = {c: col[c].to_numpy() for c in ("row", "row2", "at", "shape", "known", "base", "place")}
        new = np.concatenate([[True], (num["row"][1:] != num["row"][:-1]) | (num["row2"][1:] != num["row2"][:-1])])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        is_own = num["at"] < 0
        size = len(starts)
        copies = np.bincount(group[is_own], minlength=size)
        lengths, data = _spans(col["data"].take(pa.array(starts)))
        seq = data.copy().view(np.int16)
        offsets = np.concatenate([[0], np.cumsum(lengths // 2)])
        rest = np.flatnonzero(~is_own)
        spans, data = _spans(col["data"].take(pa.array(rest)))
        times, g, shape = spans // 4, group[rest], num["shape"][rest]
        n = col["n"].fill_null(0).to_numpy()[rest]
        cls = col["cls"].fill_null(-1).to_numpy()[rest]
        listed = cls >= 0
        place = m.log_rare(shape, n)
        place[listed] = m.log_word(cls[listed], n[listed])
        seq[np.repeat(offsets[g], times) + data.view(np.int32)] = np.repeat(np.where(listed, cls, m.shape_class[shape]), times)
        add = lambda x: np.bincount(g, weights=times * x, minlength=size) / copies
        own = np.flatnonzero(is_own)
        back = group[own]
        return pa.RecordBatch.from_arrays(
            [
                col["own"].take(pa.array(own)),
                _binary(2 * offsets, seq.view(np.uint8)).take(pa.array(back)),
                pa.array(num["known"][own] + np.rint(add(n > 0)).astype(np.int64)[back]),
                pa.array(num["base"][own] + add(m.log_base(n))[back]),
                pa.array(num["place"][own] + add(place)[back]),
            ],
            ["own", "seq", "n_known", "base_score", "place"],
        )

    def assemble(batches):
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            row = batch.column("row").to_numpy()
            change = np.flatnonzero(row[1:] != row[:-1]) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut or last != row[0]:
                ready = [*held, batch.slice(0, cut)] if cut else held
                if ready:
                    yield whole(ready)
                held = []
            held.append(batch.slice(cut))
            last = row[-1]
        if held:
            yield whole(held)

    # a hash passes nulls over, so which values are null is hashed too
    values = [F.col(c) for c in (*keep, text)]
    values = [*values, *[c.isNull() for c in values], F.spark_partition_id()]
    rows = docs.select(*keep, F.col(text).alias("__text"), F.xxhash64(*values).alias("__1"), F.xxhash64(F.lit(7), *values).alias("__2"))
    words = lexicon.filter(F.col("n") < model.least).select(F.col("word").alias("w"), "n", "cls")
    joined = rows.mapInArrow(parts, wide).join(words, (F.col("word") == F.col("w")) & (F.col("at") >= 0), "left").drop("word", "w")
    out = T.StructType([T.StructField("own", own_type), T.StructField("seq", T.BinaryType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("place", T.DoubleType())])
    return joined.repartition("row").sortWithinPartitions("row").mapInArrow(assemble, out)


def _with_transitions(model: BrownModel, encoded: DataFrame) -> BrownModel:
    """The model with transitions counted in encoded training rows."""
    classes, end = len(model.mass), model.end_class

    def add(batch):
        seq = _spans(batch.column(0))[1].view(np.int16).astype(np.int64)
        # every row closes with an end, which stands before the next row
        before = np.concatenate([[end], seq[:-1]]) if len(seq) else seq
        return np.bincount(before * classes + seq, minlength=classes * classes)

    table = _cells(encoded.select("seq"), add, classes * classes).reshape(classes, classes)
    return replace(model, log_next=np.log10(_transitions(table, model.mass, model.prior)))


def fit_brown(train: DataFrame, text: str = "text", settings: Settings = Settings()) -> tuple[BrownModel, DataFrame]:
    """The model of all rows of train, and the stored lexicon (word, shape, n, cls) of all words."""
    train = train.select(F.col(text).alias("text"))
    model, lexicon = _fit_classes(train, settings)
    return _with_transitions(model, _encoded(train.withColumn("train", F.lit(True)), model, lexicon, "text", ("train",))), lexicon


def _scored(encoded: DataFrame, model: BrownModel) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in batches:
            lengths, data = _spans(batch.column("seq"))
            seq = data.view(np.int16)
            before = np.concatenate([[m.end_class], seq[:-1]]) if len(seq) else seq
            row = np.repeat(np.arange(len(batch)), lengths // 2)
            moves = np.bincount(row, weights=m.log_next[before, seq], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(lengths // 2), batch.column("n_known"), batch.column("base_score"), pa.array(moves + batch.column("place").to_numpy())], names)

    names = ["own", "n_tokens", "n_known", "base_score", "score"]
    schema = T.StructType([encoded.schema["own"], *[T.StructField(c, T.LongType() if c.startswith("n_") else T.DoubleType()) for c in names[1:]]])
    found = encoded.mapInArrow(score, schema)
    return found.select("own.*", "n_tokens", "n_known", F.lit(int(model.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def lm_scores(docs: DataFrame, model: BrownModel, lexicon: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with n_tokens, n_known, train_tokens, base_score, score and perplexity of every
    row's whole text (null: empty, which has the end token alone).

    base_score is the add-one unigram score, score the model's log10 probability of the text.  Equal texts
    score the same, repeated rows give repeated rows, other columns of docs are ignored.  Words are
    unknown when the training rows don't have them, and all are when there are no training rows.  An empty
    table gives an empty result.
    """
    return _scored(_encoded(docs, model, lexicon, text, keep), model)


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, settings: Settings = Settings()) -> DataFrame:
    """(key, held_out, ...): scores of all rows under a model that never saw the fold
    ``crc32(key as text) mod folds = fold``.  A null key is never held out."""
    held = crc_mod(key, folds) == fold
    model, lexicon = _fit_classes(docs.filter(~held).select(text), settings)
    # all rows are encoded once, for the transitions and for the scores
    rows = stored(_encoded(docs.withColumn("held_out", held), model, lexicon, text, (key, "held_out")), "classes")
    return _scored(rows, _with_transitions(model, rows.filter("NOT own.held_out")))
