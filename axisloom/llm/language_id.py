"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (letters lower-cased, everything else one blank), with
sublinear term frequency, inverse document frequency and unit length.  Document frequencies are counted
over all training documents.  The weights come from follow-the-regularised-leader (per-coordinate rates,
L1 and L2 penalties) on a bounded, seeded sample of labelled documents, the same number for each label;
a fifth of that sample is kept back and gives the temperature that calibrates the scores.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import crc_mod

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Parameters of features and fit."""

    bits: int = 15
    #: Bound of the labelled sample that the weights are fitted on, over all labels together.
    max_train_docs: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    calibration_share: int = 5
    seed: int = 17


def _folding() -> np.ndarray:
    """Code points below 0x3000: a letter's lower case, a blank for anything else."""
    out = np.full(0x3000, 32, dtype=np.uint32)
    for cp in range(0x3000):
        if unicodedata.category(chr(cp))[0] in "LM":
            low = chr(cp).lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_fold: list[np.ndarray] = []


def _grams(raw: np.ndarray, before: np.ndarray, shift: np.uint64) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams of n = 1, 2, 3 by start, in before (code points) plus raw (UTF-8); the code points."""
    if not _fold:
        _fold.append(_folding())
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    cp = np.concatenate([before, np.where(cp < 0x3000, _fold[0][np.minimum(cp, 0x2FFF)], cp).astype(np.uint64)])
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), dtype=np.uint64)
        for k in range(min(3, len(cp))):
            h = h[: len(cp) - k] * np.uint64(0x9E3779B97F4A7C15) + cp[k:] + np.uint64(k + 1)
            out.append((K.mix(h) >> shift).astype(np.int64))
    return out, cp


def _features(arr, bits: int):
    """(row, used buckets, their counts) of every row, in pieces of at most SEGMENT bytes of text."""
    off, data = K.buffers(arr)
    size, shift, none = 1 << bits, np.uint64(64 - bits), np.zeros(0, dtype=np.uint64)
    first, n = 0, len(off) - 1
    while first < n:
        last = min(max(int(np.searchsorted(off, off[first] + K.SEGMENT, side="right")) - 1, first + 1), n)
        raw = data[off[first] : off[last]]
        if len(raw) <= K.SEGMENT:
            grams, _ = _grams(raw, none, shift)
            heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            cuts = heads[off[first : last + 1] - off[first]]
            for i in range(last - first):
                s, e = cuts[i], cuts[i + 1]
                flat = np.concatenate([g[s : max(s, e - k)] for k, g in enumerate(grams)]) if e > s else np.zeros(0, dtype=np.int64)
                counts = np.bincount(flat, minlength=size)
                used = np.flatnonzero(counts)
                yield first + i, used, counts[used]
        else:  # one long row; the last two code points of a piece go before the next
            counts, before, at = np.zeros(size, dtype=np.int64), none, 0
            while at < len(raw):
                end = min(at + K.SEGMENT, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                grams, cp = _grams(raw[at:end], before, shift)
                for k, g in enumerate(grams):  # those that end in this piece
                    counts += np.bincount(g[max(0, len(before) - k) :], minlength=size)
                before, at = cp[-2:], end
            used = np.flatnonzero(counts)
            yield first, used, counts[used]
        first = last


@dataclass
class LanguageModel:
    """Labels in code point order, weights (bucket x label; the last row is the bias), idf and temperature."""

    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    settings: Settings = field(default_factory=Settings)

    def vector(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[used]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(used, counts) @ self.weights[used] + self.weights[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Fits model.weights in place, one row at a time."""
    s, c = model.settings, len(model.labels)
    d = len(model.idf) + 1
    z, n = np.zeros((d, c)), np.zeros((d, c))

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, (np.sign(zi) * s.l1 - zi) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            used, counts, y = rows[i]
            at = np.append(used, d - 1)
            x = np.append(model.vector(used, counts), 1.0)
            w = weight(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / s.alpha * w
            n[at] = more
    model.weights = weight(z, n)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm.

    The right label counts (n + 1) / (n + 2) and the others share the rest, so that labels which separate
    without an error on n rows don't drive the temperature to zero.
    """
    n, c = logits.shape if len(y) else (0, 0)
    if c < 2:
        return 1.0
    target = np.full((n, c), 1.0 / (n + 2) / (c - 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_language_model(train: DataFrame, text: str = "text", label: str = "lang", settings: Settings = Settings()) -> LanguageModel:
    """Learns from the rows of train with a label and a text; a model without labels if there are none."""
    train = train.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().orderBy("label").collect()}
    labels = sorted(sizes)
    d = 1 << settings.bits
    model = LanguageModel(labels, np.zeros((d + 1, max(1, len(labels)))), np.ones(d), 1.0, settings)
    if not labels:
        return model

    def frequencies(batches):
        df = np.zeros(d, dtype=np.int64)
        for batch in batches:
            for _, used, _ in _features(batch.column(0), settings.bits):
                df[used] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["bucket", "n"])

    df = np.zeros(d)
    for r in train.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.bucket] = r.n
    model.idf = np.log((1.0 + sum(sizes.values())) / (1.0 + df)) + 1.0

    quota = max(1, settings.max_train_docs // len(labels))
    # drawn from the distinct texts of each label, by their hash
    train = train.withColumn("hash", F.xxhash64(F.lit(settings.seed), "text"))
    sizes = {r["label"]: r["count"] for r in train.select("label", "hash").distinct().groupBy("label").count().collect()}
    draw = F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, quota / v)))]), F.col("label"))

    def vectors(batches):
        for batch in batches:
            used, counts = [], []
            for _, u, c in _features(batch.column(0), settings.bits):
                used.append(u.astype("<i4").tobytes())
                counts.append(c.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(used, pa.binary()), pa.array(counts, pa.binary())], ["label", "hash", "used", "counts"])

    place = {k: i for i, k in enumerate(labels)}
    taken: dict[str, int] = {}
    rows = []
    drawn = train.filter(draw < chance).dropDuplicates(["label", "hash"]).select("text", "label", "hash")
    found = drawn.mapInArrow(vectors, "label string, hash long, used binary, counts binary").toLocalIterator()
    for r in sorted(found, key=lambda r: (r.hash % (1 << 30), r.hash, r.label)):
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= 2 * quota and len(r.used):
            rows.append((np.frombuffer(bytes(r.used), dtype="<i4"), np.frombuffer(bytes(r.counts), dtype="<i4"), place[r.label], r.hash))
    # a text with several labels is on one side; fewer texts than the share takes one from are all for training
    texts = {h: i + 1 for i, h in enumerate(dict.fromkeys(r[3] for r in rows))}
    kept = [r[:3] for r in rows if texts[r[3]] % settings.calibration_share]
    back = [r[:3] for r in rows if not texts[r[3]] % settings.calibration_share]
    _ftrl(model, kept)
    if back:
        model.temperature = _temperature(np.array([model.logits(u, c) for u, c, _ in back]), np.array([y for _, _, y in back]))
    return model


def _predict(arr, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    n = len(arr)
    labels, scores = [UNDETERMINED] * n, np.zeros(n)
    if model.labels:
        for row, used, counts in _features(arr, model.settings.bits):
            p = _softmax(model.logits(used, counts) / model.temperature)
            best = int(np.argmax(p))
            labels[row], scores[row] = model.labels[best], p[best]
    for i, t in enumerate(arr):
        if not t.is_valid or not LETTER.search(t.as_py()):
            labels[i], scores[i] = UNDETERMINED, 0.0
    return labels, scores


def languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred (a learned label) and score (its calibrated probability), for the
    whole text of every row.

    Null texts and texts without a letter get ``und`` and score 0, as does everything when the model has
    no labels.  A tie goes to the label first in code point order.  Equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for c in keep for f in docs.schema.fields if f.name == c]
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for batch in batches:
            labels, scores = _predict(batch.column(len(keep)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores)], out.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(predict, out)


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is determined with at least min_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def select(batches):
        for batch in batches:
            labels, scores = _predict(batch.column(at), shared.value)
            yield batch.filter(pa.array([k != UNDETERMINED and s >= min_score for k, s in zip(labels, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(select, docs.schema)


def held_out_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 4, fold: int = 2, settings: Settings = Settings()) -> DataFrame:
    """(key, held_out, lang_pred, score): predictions for all rows of a model that never saw the fold
    ``crc32(key as text) mod folds = fold``.  A null key is never held out."""
    held = crc_mod(key, folds) == fold
    model = fit_language_model(docs.filter(~held), text, label, settings)
    return languages(docs.withColumn("held_out", held), model, text, keep=(key, "held_out"))
