"""Operator 2, packing: deficit round-robin over source queues fills every window to the target token proportions.

1. One pass over the texts stores each document's token ids (smallest unsigned type) in a table of the shared scratch folder.
2. Each source is a queue: its documents, ordered by (bucket, id), form one token stream cut into quanta of ``quantum`` tokens.
   Positions in a queue come from two-level prefix sums (bucket totals, then inside a bucket), so no task sees a whole queue.
3. Deficit round-robin in closed form.  In each round every queue earns its share of the round and sends a quantum whenever its
   deficit allows; what it could not send is carried on.  With share N_s of N quanta, quantum j of source s is sent at virtual time
   (j + 1/2) / N_s, and up to any time each source's tokens differ from its target by less than a quantum: deficits carry across
   windows and partitions because the schedule is one function of (source, j) and not a loop over windows.  Target weights other
   than the natural ones are given by ``weights``: a queue of weight w then drains w times as fast as its natural share.
4. The quanta in order of virtual time (again two-level prefix sums, by time bucket) are laid end to end; window w holds tokens
   [w * window, (w + 1) * window).  Documents are cut at quantum and window borders only, and neighbouring pieces of one document that
   end up side by side are joined again.  Only the last window is not full: it is cut into sequences whose lengths are powers of two,
   so nothing is padded.

Defined cases: null texts are empty (only the end id is packed); a null source is a source of its own; rows that repeat an id are
packed each by itself (``row_key`` tells them apart inside; the pieces show the id only); empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V
from .bpe import Words, WordVocab
from .token_counts import CACHE_WORDS, vocabulary

WINDOW, QUANTUM, END_ID = 2048, 256, 1
BUCKET_ROWS = 20_000
_ids: dict[str, list] = {}
V.cached("tokens", _ids.clear)


def word_ids(v: WordVocab, words: Words, path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, starts, lengths): the ids of every word of the chunk as ranges of a pool; new words go through the library in one call."""
    memo, pool, start, size = _ids.setdefault(path, [V.Memo(CACHE_WORDS // 2), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)])
    if memo.size > memo.limit:
        memo.clear()
        pool, start, size = pool[:0], start[:0], size[:0]
    uniq, first, inverse = words.distinct()
    row = memo.find(uniq)
    new = np.flatnonzero(row < 0)
    if len(new):
        data, s, e = words.utf8(first[new])
        width = e - s + 1  # each word and a blank
        joined = np.full(int(width.sum()), 32, np.uint8)
        joined[V.ragged(np.cumsum(width) - width, e - s)] = data
        ids = np.array(v.tokenizer.encode(joined.tobytes().decode(), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(v.final[ids]) + 1  # a word ends with its end-of-word token
        if len(ends) != len(new):
            raise ValueError("a word was split by the library")
        n = np.diff(ends, prepend=0)
        start = np.append(start, len(pool) + ends - n)
        size = np.append(size, n)
        pool = np.append(pool, ids)
        row[new] = memo.add(uniq[new])
    _ids[path] = [memo, pool, start, size]
    return pool, start[row][inverse], size[row][inverse]


def encode_texts(col: pa.Array, path: str | None, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all texts of an Arrow column; nulls are empty."""
    v = vocabulary(path)
    parts, sizes = [], []
    for _, _, data, off in V.chunks(V.binary(col)):
        words = Words(data, off, v.specials)
        n = len(off) - 1
        pool, s, size = word_ids(v, words, path)
        total = V.sums(size, words.row, n)
        flat = pool[V.ragged(s, size)]
        odd = {int(k): np.array(v.tokenizer.encode(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32) for k in np.flatnonzero(~words.plain)}
        if odd:
            own = np.split(flat, np.cumsum(total)[:-1])
            for k, ids in odd.items():
                own[k], total[k] = ids, len(ids)
            flat = np.concatenate(own)
        if end_id is not None:
            out = np.full(len(flat) + n, end_id, np.int32)
            at = np.cumsum(total + 1) - total - 1
            out[V.ragged(at, total)] = flat
            flat, total = out, total + 1
        parts.append(flat)
        sizes.append(total)
    if not sizes:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


def id_table(df: DataFrame, id_col: str, text_col: str, source_col: str, vocab_path: str | None, end_id: int) -> DataFrame:
    """doc (id), source, n tokens, ids (little-endian, 2 bytes where the vocabulary fits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype("<u2") if len(vocabulary(vocab_path).final) <= 1 << 16 else np.dtype("<u4")
        for b in V.trimmed(batches, "tokens"):
            for a in range(0, max(b.num_rows, 1), 500):
                p = b.slice(a, 500)
                ids, off = encode_texts(p.column(1), vocab_path, end_id)
                raw = ids.astype(wide)
                blob = pa.Array.from_buffers(pa.large_binary(), p.num_rows, [None, pa.py_buffer(off * wide.itemsize), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.array(np.diff(off)), blob.cast(pa.binary())], names=["doc", "source", "n", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"), F.col(source_col).cast("string").alias("source"))
    return picked.mapInArrow(run, f"doc {kind}, source string, n long, ids binary")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` inside ``keys``, ordered by (bucket, order): bucket totals first, then inside each bucket."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)
    base = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    named = base.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bucket]], "_base")
    own = df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return own.join(named, cond).withColumn(out, F.col(out) + F.col("_base")).drop("_base", *[f"_{k}" for k in [*keys, bucket]])


def schedule(lengths: DataFrame, rows: int, window: int, quantum: int, weights: dict[str, float] | None) -> DataFrame:
    """Pieces of all documents: key, source, pos (its place in the queue), start, length, at (its place in the packed stream)."""
    spark = lengths.sparkSession
    buckets = max(1, rows // BUCKET_ROWS)
    queue = running(lengths.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))), ["source"], "bucket", ["doc", "key"], "n", "pos")
    pieces = queue.select("key", "source", "pos", "n", F.explode(F.sequence(F.expr(f"pos div {quantum}"), F.expr(f"(pos + n - 1) div {quantum}"))).alias("j"))
    first = F.greatest(F.col("pos"), F.col("j") * quantum)
    last = F.least(F.col("pos") + F.col("n"), (F.col("j") + 1) * quantum)
    pieces = pieces.select("key", "source", "j", (first - F.col("pos")).alias("start"), (last - first).alias("length"), (first - F.col("j") * quantum).alias("inner"))
    quanta = pieces.groupBy("source", "j").agg(F.sum("length").alias("size"))
    share = lengths.groupBy("source").agg(F.ceil(F.sum("n") / quantum).alias("quanta"))
    if weights:
        table = spark.createDataFrame([(str(k), float(w)) for k, w in weights.items()], "_s string, w double")
        share = share.join(F.broadcast(table), F.col("source") == F.col("_s"), "left").withColumn("w", F.coalesce("w", F.lit(1.0))).drop("_s")
    else:
        share = share.withColumn("w", F.lit(1.0))
    share = share.withColumnRenamed("source", "_source")
    timed = quanta.join(share, F.col("source").eqNullSafe(F.col("_source"))).withColumn("time", (F.col("j") + 0.5) / (F.col("quanta") * F.col("w"))).drop("_source", "w", "quanta")
    slots = max(1, rows // BUCKET_ROWS)
    timed = timed.withColumn("slot", F.floor(F.least(F.col("time"), F.lit(1e6)) * slots))
    laid = running(timed, [], "slot", ["time", "source", "j"], "size", "at")
    laid = laid.select(F.col("source").alias("_source"), F.col("j").alias("_j"), "at")
    placed = pieces.join(laid, F.col("source").eqNullSafe(F.col("_source")) & (F.col("j") == F.col("_j")))
    return placed.select("key", "start", "length", (F.col("at") + F.col("inner")).alias("at"))


def merge_pieces(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, total: int, window: int) -> tuple[np.ndarray, ...]:
    """One document's pieces: joined where they lie side by side, cut at window borders and, in the last window, at powers of two."""
    order = np.argsort(starts, kind="stable")
    starts, lengths, at = starts[order], lengths[order], at[order]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1] + lengths[:-1]) | (starts[1:] != starts[:-1] + lengths[:-1])
    first = np.flatnonzero(fresh)
    s, a, n = starts[first], at[first], np.add.reduceat(lengths, first)
    full = total // window * window
    tail = []  # (first token, length, number) of the short sequences at the end
    p, rest, k = full, total - full, total // window
    while rest:
        size = 1 << (int(rest).bit_length() - 1)
        tail.append((p, size, k))
        p, rest, k = p + size, rest - size, k + 1
    out = []
    for s0, a0, n0 in zip(s.tolist(), a.tolist(), n.tolist(), strict=True):
        while n0:
            if a0 < full:
                seq, base, size = a0 // window, a0 // window * window, window
            else:
                base, size, seq = next(t for t in tail if t[0] <= a0 < t[0] + t[1])
            take = min(n0, base + size - a0)
            out.append((s0, take, seq, a0 - base))
            s0, a0, n0 = s0 + take, a0 + take, n0 - take
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, quantum: int = QUANTUM, end_id: int = END_ID, weights: dict[str, float] | None = None, vocab_path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    stored = scratch.persist_table(id_table(df, id_col, text_col, source_col, vocab_path, end_id), "token-ids")
    stored = stored.withColumn("key", F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")))
    lengths = stored.select("key", "doc", "source", "n")
    row = lengths.agg(F.count("*").alias("rows"), F.sum("n").alias("total")).first()
    rows, total = row["rows"], row["total"] or 0
    placed = schedule(lengths, rows, window, quantum, weights)
    cuts = placed.groupBy("key").agg(F.collect_list(F.struct("start", "length", "at")).alias("cuts")).withColumnRenamed("key", "_key")
    both = stored.join(cuts, F.col("key") == F.col("_key")).select("doc", "n", "ids", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.trimmed(batches, "tokens"):
            for a in range(0, b.num_rows, 500):
                p = b.slice(a, 500)
                cut = p.column(3)
                off = np.asarray(cut.offsets)
                flat = [np.asarray(cut.flatten().field(k)) for k in range(3)]
                off = off - off[0]
                cols: list[list] = [[] for _ in range(7)]
                count, blobs = [], []
                for k in range(p.num_rows):
                    x = slice(off[k], off[k + 1])
                    s, n, seq, at = merge_pieces(flat[0][x], flat[1][x], flat[2][x], total, window)
                    raw = p.column(2)[k].as_buffer()
                    own = int(p.column(1)[k].as_py())
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * own else "<u4").astype("<u4")
                    blobs += [ids[i : i + m].tobytes() for i, m in zip(s.tolist(), n.tolist(), strict=True)]
                    count.append(len(s))
                    for c, values in zip(cols, (s, n, np.full(len(s), own), seq, at), strict=False):
                        c.append(values)
                which = np.repeat(np.arange(p.num_rows), count)
                s, n, own, seq, at = (np.concatenate(c) for c in cols[:5])
                crc = np.array([zlib.crc32(x) for x in blobs], np.int64)
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(which)), pa.array(s), pa.array(n), pa.array(crc), pa.array(own), pa.array(seq), pa.array(at)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return pack(scratch.load(spark, sf_dir, "documents"))
