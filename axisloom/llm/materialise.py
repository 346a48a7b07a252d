"""Token-ID output in training order: fixed-stride binary shards behind a keyed permutation.

Documents are tokenised with a byte-level BPE of a public vocabulary, each followed by an end token, and
the token stream of every input partition is cut into sequences of ``seq_len`` tokens (only the last of
a partition is padded).  Sequence number i of N goes to slot ``Feistel_key(i)``, a bijection of 0..N-1:
a balanced Feistel network over the next even power of two, walked until it falls below N.  Shard
``slot // per_shard`` holds its slots at ``(slot % per_shard) * stride`` bytes, so training reads shards
from end to end, resumes at any slot by arithmetic, and no order of all sequences is ever sorted: rows go
straight to the partition of their shard and are sorted within it.

The corpus is read twice, to count the sequences of each partition and to write them, so it must be a
stored table; any other frame is stored first.  The second pass checks the counts of the first.

Tokens of a word don't depend on the words around it once the blanks before it are taken with it, so a
batch is tokenised by its distinct words; rows with other Unicode blanks are tokenised as a whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import scratch, stored

#: Ranks of the vocabulary, one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks that the pattern knows beside the ASCII ones, in UTF-8.
_OTHER_BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


@dataclass(frozen=True)
class Layout:
    """How sequences are made and written."""

    seq_len: int = 512
    key: int = 0x5EED
    vocabulary: str = VOCABULARY
    pattern: str = PATTERN
    end_token: int = 50256
    dtype: str = "<u2"
    shard_bytes: int = 16 << 20
    #: Tasks that write; from there on a task writes several shards, one after the other.
    max_tasks: int = 10_000

    @property
    def stride(self) -> int:
        return self.seq_len * np.dtype(self.dtype).itemsize


def _vocabulary(spark: SparkSession, layout: Layout):
    """The bytes of the vocabulary file, read by the driver and sent to every executor once (a few MB at most)."""
    with open(layout.vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _tokenizer(layout: Layout, raw: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file's bytes, loaded once a process, and the bytes of every token."""
    if layout.vocabulary not in _loaded:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        lengths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        lengths[list(ranks.values())] = [len(token) for token in ranks]
        _loaded[layout.vocabulary] = tiktoken.Encoding("words", pat_str=layout.pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[layout.vocabulary]


def _units(w: K.Words, rows_at: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, name) of the units of the rows in plain, in order: a word with the blanks before it,
    or the blanks that close a row.  Equal names mean equal bytes."""
    raw, n = w.low, len(w)
    counts = np.diff(w.off)
    row = np.repeat(np.arange(n), counts)
    begin = np.empty(len(w.starts), dtype=np.int64)
    if len(begin):
        begin[1:] = w.ends[:-1]
        begin[w.off[:-1][counts > 0]] = rows_at[:-1][counts > 0]
    # a word is named by its hash and the blanks before it: nearly always one
    run = w.starts - begin
    with np.errstate(over="ignore"):
        name = w.h + np.where(run == 1, raw[begin], 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if len(begin) else w.h
        many = np.flatnonzero(run > 1)
        if len(many):
            name[many] = K.mix(w.h[many] + _span_hashes(raw, begin[many], w.starts[many]))
    start, stop = begin, w.ends
    tail_from = rows_at[:-1].copy()
    tail_from[counts > 0] = w.ends[w.off[1:][counts > 0] - 1]
    tail = np.flatnonzero(rows_at[1:] > tail_from)
    if len(tail):
        row = np.concatenate([row, tail])
        start, stop = np.concatenate([start, tail_from[tail]]), np.concatenate([stop, rows_at[1:][tail]])
        name = np.concatenate([name, K.mix(~_span_hashes(raw, tail_from[tail], rows_at[1:][tail]))])
        order = np.lexsort((start, row))
        row, start, stop, name = row[order], start[order], stop[order], name[order]
    if not plain.all():
        ok = plain[row]
        row, start, stop, name = row[ok], start[ok], stop[ok], name[ok]
    return row, start, stop, name


def encoded(arr, layout: Layout, vocabulary: bytes, count_only: bool = False):
    """(first row, token offsets, tokens) of runs of rows; every row ends with the end token.  With count_only
    the tokens are left out."""
    enc, lengths = _tokenizer(layout, vocabulary)
    off, _ = K.buffers(arr)
    for w in K.iter_words(arr, lower=False):
        n, raw = len(w), w.low
        rows_at = off[w.first : w.first + n + 1] - off[w.first]
        plain = np.ones(n, dtype=bool)
        if _OTHER_BLANKS.search(raw):
            plain[:] = [_OTHER_BLANKS.search(raw[rows_at[i] : rows_at[i + 1]]) is None for i in range(n)]
        row, start, stop, name = _units(w, rows_at, plain)
        # distinct units, encoded in one string
        _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        base, sizes, flat = _encoded_units(enc, lengths, raw, start[first], stop[first])
        each = sizes[inverse]
        per_row = np.bincount(row, weights=each, minlength=n).astype(np.int64)
        whole = {i: np.array(_encode_text(enc, raw[rows_at[i] : rows_at[i + 1]].tobytes().decode("utf-8")), dtype=np.int32) for i in np.flatnonzero(~plain)}
        for i, own in whole.items():
            per_row[i] = len(own)
        bounds = np.concatenate([[0], np.cumsum(per_row + 1)])
        if count_only:
            yield w.first, bounds, None
            continue
        tokens = np.full(bounds[-1], layout.end_token, dtype=np.int32)
        place = np.concatenate([[0], np.cumsum(each)])
        # the tokens of plain rows, each row shifted by the end tokens and whole rows before it
        shift = bounds[:-1] - np.concatenate([[0], np.cumsum(np.where(plain, per_row, 0))[:-1]])
        at = np.arange(place[-1])
        tokens[at + np.repeat(shift[row], each)] = flat[np.repeat(base[inverse] - place[:-1], each) + at]
        for i, own in whole.items():
            tokens[bounds[i] : bounds[i] + len(own)] = own
        yield w.first, bounds, tokens


#: Runs of blanks from here on are cut out before the pattern is matched, which would recurse on them.
_LONG = 4096
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{_LONG},}}")


def _encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Tokens of a text.  A long run of blanks is one piece of the pattern, all of it at the end of the
    text and all but its last blank elsewhere."""
    out, at = [], 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def _encoded_units(enc: tiktoken.Encoding, lengths: np.ndarray, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, number of tokens) of every span, and the tokens.

    Spans that end in a word are joined and encoded together: a word ends a token, and so does the line feed
    put before those that don't begin with a blank.  Bytes tell where each span's tokens are.
    """
    n = len(start)
    base, sizes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    blank_first, blank_last = K.WHITESPACE[raw[start]], K.WHITESPACE[raw[stop - 1]]
    alone = blank_last | (stop - start > _LONG)
    together = np.flatnonzero(~alone)
    bare = ~blank_first[together]
    size = stop[together] - start[together]
    ends = np.cumsum(size + bare)
    begins = ends - size
    joined = np.full(ends[-1] if len(ends) else 0, 10, dtype=np.uint8)
    before, at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, np.arange(size.sum())
    joined[at + np.repeat(begins - before, size)] = raw[at + np.repeat(start[together] - before, size)]
    flat = np.array(enc.encode_ordinary(joined.tobytes().decode("utf-8")), dtype=np.int32)
    upto = np.concatenate([[0], np.cumsum(lengths[flat])])
    base[together] = np.searchsorted(upto, begins)
    sizes[together] = np.searchsorted(upto, ends) - base[together]
    parts, n_flat = [flat], len(flat)
    for k in np.flatnonzero(alone):  # the blanks that close a row, and long units
        own = _encode_text(enc, raw[start[k] : stop[k]].tobytes().decode("utf-8"))
        base[k], sizes[k] = n_flat, len(own)
        n_flat += len(own)
        parts.append(np.array(own, dtype=np.int32))
    return base, sizes, np.concatenate(parts)


def _span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of every span, in stretches of at most a segment."""
    if len(raw) <= K.SEGMENT:
        return K._hash_spans(raw, start, stop)
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + K.SEGMENT, side="right")))
        lo, hi = start[i], stop[j - 1]
        if hi - lo <= K.SEGMENT:
            out[i:j] = K._hash_spans(raw[lo:hi], start[i:j] - lo, stop[i:j] - lo)
        else:
            out[i:j] = np.uint64(K.xxhash.xxh64_intdigest(raw[lo:hi].tobytes()))
        i = j
    return out


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0..size-1: six rounds over an even number of bits, with cycle-walking."""

    size: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _round(self, r: int, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            keyed = x.astype(np.uint64) + K.mix(np.array([(self.key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (2**64 - 1)], dtype=np.uint64))
        return K.mix(keyed) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        mask = np.uint64((1 << self.half) - 1)
        a, b = x >> np.uint64(self.half), x & mask
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            a, b = (b ^ self._round(r, a), a) if back else (b, a ^ self._round(r, b))
        return (a << np.uint64(self.half)) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        y = self._once(np.asarray(x).astype(np.uint64), back)
        while len(out := np.flatnonzero(y >= np.uint64(self.size))):
            y[out] = self._once(y[out], back)
        return y.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the flat values of the ranges lo:hi."""
    n = hi - lo
    off = np.concatenate([[0], np.cumsum(n)])
    return off, np.repeat(lo - off[:-1], n) + np.arange(off[-1])


def _sequences(batches, layout: Layout, vocabulary: bytes):
    """(tokens of m sequences, m used lengths, offsets and values of their document ids) of a partition."""
    size = layout.seq_len
    held, held_ids, held_starts = np.zeros(0, dtype=np.int32), None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        for first, bounds, tokens in encoded(batch.column(1), layout, vocabulary):
            n = len(bounds) - 1
            ids = batch.column(0).slice(first, n)
            if held_ids is not None and len(held_ids):
                ids = pa.concat_arrays([held_ids, ids])
            starts = np.concatenate([held_starts, bounds[:-1] + len(held)])
            stream = np.concatenate([held, tokens])
            m = len(stream) // size
            edge = np.arange(m + 1, dtype=np.int64) * size
            lo = np.maximum(np.searchsorted(starts, edge[:-1], side="right") - 1, 0)
            hi = np.searchsorted(starts, edge[1:], side="left")
            if m:
                off, flat = _ranges(lo, hi)
                yield stream[: m * size].reshape(m, size), np.full(m, size), off, ids.take(pa.array(flat))
            # what is left, with the document that it begins in
            held = stream[m * size :]
            from_row = max(int(np.searchsorted(starts, m * size, side="right")) - 1, 0)
            if len(held):
                held_ids, held_starts = ids.slice(from_row), np.maximum(starts[from_row:] - m * size, 0)
            else:
                held_ids, held_starts = None, np.zeros(0, dtype=np.int64)
    if len(held):
        padded = np.full((1, size), layout.end_token, dtype=np.int32)
        padded[0, : len(held)] = held
        yield padded, np.array([len(held)]), np.array([0, len(held_ids)]), held_ids


def materialised(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", layout: Layout = Layout(), stored_input: bool = False) -> DataFrame:
    """Writes the shards under out (a URI that all executors reach) when the result is computed.

    One row per sequence: (slot, sequence, shard, offset, n_tokens, doc_ids, crc32): its place in training
    order and in document order, its file ``shard-NNNNNN.bin`` and byte offset, how many of its tokens
    aren't padding, the documents that it holds tokens of, and the checksum of its bytes.  A task that runs
    again writes the same bytes and puts the file in place by one rename.  out also gets manifest.json.

    Null and empty texts give their end token alone; rows that repeat are written as often; null keys stay
    null in doc_ids; other columns are ignored.  An empty table gives no shards and no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(key, text)
    vocabulary = _vocabulary(spark, layout)
    if not stored_input:
        docs = stored(docs, "documents")

    def count(batches):
        tokens = 0
        for batch in batches:
            for _, bounds, _ in encoded(batch.column(0), layout, vocabulary.value, count_only=True):
                tokens += int(bounds[-1])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens])], ["part", "tokens"])

    counted = {r.part: r.tokens for r in docs.select(text).mapInArrow(count, "part int, tokens long").collect()}
    sequences = {p: -(-t // layout.seq_len) for p, t in counted.items()}
    total, first = 0, {}
    for p in sorted(sequences):
        first[p], total = total, total + sequences[p]
    n_shards = max(1, -(-total * layout.stride // layout.shard_bytes))
    per_shard = max(1, -(-total // n_shards))
    n_shards = max(1, -(-total // per_shard))
    n_tasks = min(layout.max_tasks, n_shards)
    order = Feistel(max(1, total), layout.key)
    _write_manifest(spark, out, {"sequences": total, "seq_len": layout.seq_len, "dtype": layout.dtype, "stride": layout.stride, "per_shard": per_shard, "shards": n_shards if total else 0, "key": layout.key, "end_token": layout.end_token})

    id_type = docs.schema[key].dataType
    placed = T.StructType([T.StructField("slot", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("tokens", T.BinaryType())])

    def place(batches):
        part = TaskContext.get().partitionId()
        at = first.get(part, 0)
        for tokens, used, off, ids in _sequences(batches, layout, vocabulary.value):
            m = len(tokens)
            index = np.arange(at, at + m)
            if at + m > first.get(part, 0) + sequences.get(part, 0):
                raise RuntimeError(f"partition {part} has more sequences than were counted; the input isn't a stored table")
            slot = order.slot(index)
            raw = tokens.astype(layout.dtype).tobytes()
            body = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1, dtype=np.int32) * layout.stride).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(index), pa.array((slot // per_shard).astype(np.int32)), pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), ids), body], placed.names)
            at += m
        if at != first.get(part, 0) + sequences.get(part, 0):
            raise RuntimeError(f"partition {part} has fewer sequences than were counted; the input isn't a stored table")

    written = T.StructType([T.StructField("slot", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("crc32", T.LongType())])

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        shard, stream, size, name = None, None, 0, ""

        def close():
            stream.close()
            expected = min(per_shard, total - shard * per_shard) * layout.stride
            if size != expected:
                raise RuntimeError(f"shard {shard} has {size} bytes, not {expected}")
            fs.move(name, f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            shards = batch.column(2).to_numpy()
            slots = batch.column(0).to_numpy()
            bodies, crc = batch.column(5), []
            for i in range(batch.num_rows):
                if shards[i] != shard:
                    if stream is not None:
                        close()
                    shard, size = int(shards[i]), 0
                    name = f"{root}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}"
                    stream = fs.open_output_stream(name)
                body = bodies[i].as_buffer()
                if slots[i] != shard * per_shard + size // layout.stride:
                    raise RuntimeError(f"slot {slots[i]} isn't next in shard {shard}")
                stream.write(body)
                size += len(body)
                crc.append(zlib.crc32(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array((slots % per_shard) * layout.stride), batch.column(3), batch.column(4), pa.array(crc, pa.int64())], written.names)
        if stream is not None:
            close()

    rows = docs.mapInArrow(place, placed)
    return rows.repartitionById(n_tasks, F.floor(F.col("shard").cast("long") * n_tasks / n_shards).cast("int")).sortWithinPartitions("slot").mapInArrow(write, written)


def _write_manifest(spark: SparkSession, out: str, what: dict) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/manifest.json")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(json.dumps(what).encode()))
    stream.close()


def read_sequences(out: str, slot: int = 0):
    """(slot, tokens) in training order from a slot on: one seek, then sequential reads."""
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    while slot < m["sequences"]:
        shard, inside = divmod(slot, m["per_shard"])
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(inside * m["stride"])
            while slot < min(m["sequences"], (shard + 1) * m["per_shard"]):
                yield slot, np.frombuffer(f.read(m["stride"]), dtype=m["dtype"])
                slot += 1


def written_index(docs: DataFrame, **how) -> DataFrame:
    """materialised() into a new folder of the shared directory."""
    return materialised(docs, scratch(docs.sparkSession, "shards"), **how)
