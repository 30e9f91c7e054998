"""Operator 9, suffix-array deduplication: remove every byte covered by a ``length``-byte string that also starts anywhere else.

Texts are UTF-8 bytes; matches never cross documents; all occurrences go, judged on the input.  With ``words`` a second measure comes beside it:
the *passages* that another document holds too, strings of so many whole words (runs of bytes above 32), or of ``length`` bytes where the words
have more.

1. Shards.  Every window of ``length`` bytes belongs to its minimizer, the k-gram of smallest hash in it (the rightmost on ties).  Equal
   windows have equal minimizers, so windows are dealt out by the minimizer's hash and all occurrences of a string meet in one shard.
   Windows next to each other mostly share their minimizer: one row describes such a run (anchor hash, document, first start, number, hash
   of the bytes).  Runs whose anchor hash occurs once in the corpus leave at once.
2. Equal runs (copies) are counted before anything is moved: one representative with its count goes on.  Only these runs' bytes are cut
   from the texts and sent to the shards, a few of the corpus's bytes; a broadcast bitmap picks the texts concerned.
3. Each shard sorts its suffixes by external induced sorting (see suffix_array) with common prefixes cut at ``length``; a group of suffixes
   that share ``length`` bytes and stand for two or more occurrences is repeated.  Runs of an anchor that has equal runs only are repeated as
   a whole and need no sort.
4. A shard of more than MOST_BYTES, such as that of a hot passage (one run per distinct surrounding at each of its edges), is not sorted: each
   of its windows becomes a row, and windows are counted by their exact hash (64 bits, within one anchor) over all tasks.
5. Passages of SAMPLE to ``length`` - 1 bytes are dealt out and met in the same way, by minimizers of windows of SAMPLE bytes; a shard compares
   its passages by their 64-bit hash, without a sort (sorting them as well was tried: 1112 to 1230 CPU seconds a GB).  Passages with fewer
   bytes come from the stretches of text that hold any, by minimizers of the shortest possible passage.
6. Spans go back to all occurrences of their run, and each document's spans are united and cut out; texts without any are not shuffled.

A sorted shard is held in memory (some 30 bytes for each of its bytes; the queues spill to the task's own temporary folder, which no other
task reads), which MOST_BYTES bounds.  Step 4 holds no group in memory, but moves a row for each window instead of a byte for each start.

Defined cases: null texts are empty; texts shorter than ``length`` keep everything; repeated rows are occurrences of their own (so a repeated
row of ``length`` bytes or more loses all its text), but rows of one id are one document to the passages; null ids are kept; an empty table
gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from . import suffix_array as sa
from . import textvec as V
from .bitmap import marked

LENGTH, K, WORDS, SAMPLE = 400, 32, 51, 240
SHARD_BYTES = 3_000_000
#: A shard with more bytes than this is counted by window instead of being sorted.
MOST_BYTES = 8_000_000
SEGMENT = 32 << 20
ROWS = 1000  # texts that a task cuts at a time
UNIT = V.unit_table(256, 77)


def minimizer_runs(data: np.ndarray, off: np.ndarray, near: int, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, first start in its row, number of starts, anchor hash, hash of the run's bytes) of a chunk of texts; a run's bytes reach as far as
    its strings of ``length``, or to the text's end."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < near:
        return none, none, none, none, none
    k = min(k, near)
    h = V.prefix_hash(UNIT[data])
    g = V.rolling_hash(h, k)
    m, w = len(g), near - k + 1
    bits = np.uint64(max(1, int(m).bit_length()))
    key = (g >> bits) << bits | (np.uint64(m) - np.arange(m, dtype=np.uint64))
    low, span = key, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: m - w + 1], low[w - span : w - span + m - w + 1])
    at = m - (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = V.row_of(off, np.arange(len(at)))
    inside = np.arange(len(at)) + near <= off[row + 1]
    new = np.append(True, at[1:] != at[:-1])
    new[1:] |= row[1:] != row[:-1]
    starts = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new), len(at))
    stop = stops[np.searchsorted(stops, starts, "right")]
    limit = off[row[starts] + 1] - near + 1
    count = np.minimum(stop, limit) - starts
    anchor = g[at[starts]]
    end = np.minimum(starts + count - 1 + length, off[row[starts] + 1])
    body = V.span_hash(h, starts, end)
    body = V.mix(body ^ V.mix((at[starts] - starts).astype(np.uint64) << np.uint64(42) | (end - starts).astype(np.uint64) << np.uint64(21) | count.astype(np.uint64)))
    return row[starts], starts - off[row[starts]], count, anchor.view(np.int64), body.view(np.int64)


def segments(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, offset of the first byte, number of starts, bytes, offsets): texts above SEGMENT bytes are cut so that each string of
    ``length`` that begins at one of the starts lies in one piece."""
    if len(data) <= SEGMENT:
        yield 0, 0, len(data), data, off
        return
    for r in range(len(off) - 1):
        text = data[off[r] : off[r + 1]]
        for a in range(0, max(1, len(text)), SEGMENT):
            part = text[a : a + SEGMENT + length - 1]
            yield r, a, SEGMENT, part, np.array([0, len(part)])


def run_rows(df: DataFrame, near: int, length: int, k: int) -> DataFrame:
    """(doc, tid, start, count, anchor, body) of every minimizer run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.trimmed(batches):
            for r0, _, data, off in V.chunks(V.binary(b.column(2))):
                for row0, shift, starts, part, cuts in segments(data, off, length):
                    row, start, count, anchor, body = minimizer_runs(part, cuts, near, length, k)
                    if starts < len(part):  # one text: what begins later is the next piece's
                        keep = start < starts
                        row, start, count, anchor, body = (x[keep] for x in (row, start, count, anchor, body))
                        cut = start + count > starts
                        count = np.where(cut, starts - start, count)
                        body = np.where(cut, body ^ count, body)
                    if len(row):
                        at = pa.array(row + row0 + r0)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start + shift), pa.array(count), pa.array(anchor), pa.array(body)], names=["doc", "tid", "start", "count", "anchor", "body"])

    return df.select("doc", "tid", "t").mapInArrow(run, "doc long, tid long, start long, count long, anchor long, body long")


def passages_at(word: np.ndarray, base: np.ndarray, end: np.ndarray, count: np.ndarray, lead: np.ndarray, words: int, near: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bytes) of the strings of ``words`` whole words, of ``near`` to ``length`` - 1 bytes, that begin at a start of a piece.

    ``word`` marks the bytes of words; pieces lie at [base, end) and begin with a whole word where ``lead`` says so."""
    first, last = V.runs(word, np.append(base, len(word)))
    piece = np.searchsorted(base, first, "right") - 1
    ok = (first > base[piece]) | lead[piece]
    first, last, piece = first[ok], last[ok], piece[ok]
    if len(first) < words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, stop = first[: len(first) - words + 1], last[words - 1 :]
    own, size = piece[: len(at)], stop - at
    ok = (own == piece[words - 1 :]) & (at - base[own] < count[own]) & (size >= near) & (size < length)
    return at[ok], size[ok]


FOUND = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("kind", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def extremes(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row whether the rows of its key have different documents: the least of ``low`` is under the greatest of ``high``."""
    if not len(key):
        return np.empty(0, bool)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    apart = np.minimum.reduceat(low[order], at) < np.maximum.reduceat(high[order], at)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(apart, np.diff(np.append(at, len(key))))
    return out


def shard_rows(table: pa.Table, near: int, length: int, words: int | None) -> pa.Table:
    """One shard: spans that are known already as they are, and those of the pieces that have to be compared."""
    known = table.filter(pa.compute.is_null(table["bytes"])).select(FOUND.names).cast(FOUND)
    pieces = table.filter(pa.compute.is_valid(table["bytes"]))
    if not len(pieces):
        return known
    return pa.concat_tables([known, passage_groups(pieces, near, length, words) if words else shard_groups(pieces, length)])


def whole_runs(size: np.ndarray, lead: np.ndarray, blob: np.ndarray, part: dict[str, np.ndarray], near: int, length: int, words: int | None) -> tuple[np.ndarray, ...]:
    """(run, kind, first, last) of runs that are repeated as a whole."""
    base = np.cumsum(size) - size
    apart = part["low"] < part["high"]
    if words:
        ws, wm = passages_at(blob > 32, base, base + size, part["count"], lead, words, near, length)
        run = np.searchsorted(base, ws, "right") - 1
        ws, wm, run = ws[apart[run]], wm[apart[run]], run[apart[run]]
        return united(run, np.full(len(run), 1), ws - base[run], ws + wm - base[run])
    whole = np.clip(size - length + 1, 0, part["count"])
    run = np.concatenate([np.flatnonzero(whole), np.flatnonzero((whole > 0) & apart)])
    kind = np.repeat([0, 1], [np.count_nonzero(whole), len(run) - np.count_nonzero(whole)])
    return run, kind, np.zeros(len(run), np.int64), whole[run] - 1 + length


def passage_groups(table: pa.Table, near: int, length: int, words: int) -> pa.Table:
    """The pieces of one shard: byte ranges of each run that passages of other documents cover (kind 1), equal ones found by their hash."""
    count, lead, low, high = (table[c].to_numpy() for c in ("count", "lead", "low", "high"))
    data, off = V.raw(V.binary(table["bytes"]))
    base = off[:-1]
    ws, wm = passages_at(data > 32, base, off[1:], count, lead, words, near, length)
    run = np.searchsorted(base, ws, "right") - 1
    shared = extremes(V.long_span_hash(V.symbol_hash(data, UNIT), ws, ws + wm), low[run], high[run])
    ws, wm, run = ws[shared], wm[shared], run[shared]
    V.trim()
    return found_rows(table, united(run, np.full(len(run), 1), ws - base[run], ws + wm - base[run]))


def found_rows(table: pa.Table, spans: tuple[np.ndarray, ...]) -> pa.Table:
    """Spans (piece, kind, first, last) of a shard's pieces as rows of the pieces' runs."""
    run, kind, first, last = spans
    take = pa.array(run)
    return pa.Table.from_arrays([table["anchor"].combine_chunks().take(take), table["body"].combine_chunks().take(take), pa.array(kind, pa.int32()), pa.array(first), pa.array(last)], schema=FOUND)


def shard_groups(table: pa.Table, length: int) -> pa.Table:
    """The pieces of one shard: byte ranges of each run that repeated strings (kind 0) and strings of other documents (kind 1) cover, by suffix
    sorting."""
    weight, count, low, high = (table[c].to_numpy() for c in ("weight", "count", "low", "high"))
    data, off = V.raw(V.binary(table["bytes"]))
    n = len(off) - 1
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        size = len(data) + n + 1
        big = size > 64 << 20
        t = np.memmap(f"{folder}/text", np.int16, "w+", shape=(size,)) if big else np.empty(size, np.int16)
        base = off[:-1] + np.arange(n)  # a separator (1) behind every run, the end (0) behind all
        t[:] = 1
        for a in range(0, n, 4096):
            b = min(n, a + 4096)
            lengths = np.diff(off[a : b + 1])
            t[V.ragged(base[a:b], lengths)] = data[off[a] : off[b]].astype(np.int16) + 2
        t[-1] = 0
        end = off[1:] + np.arange(n)
        whole = np.clip(end - base - length + 1, 0, count)  # starts of strings of ``length``
        flag, other = np.zeros(size, bool), np.zeros(size, bool)
        for pos, group, _ in sa.equal_groups(sa.SuffixSorter(t, folder, length).descending(), length):
            run = np.searchsorted(base, pos, "right") - 1
            ok = pos - base[run] < whole[run]
            pos, run, group = pos[ok], run[ok], group[ok]
            if len(pos):
                flag[pos[np.bincount(group, weights=weight[run])[group] >= 2]] = True
                other[pos[extremes(group, low[run], high[run])]] = True
        for mark, of in ((flag, weight >= 2), (other, low < high)):  # alone in its group, but the run itself occurs more than once
            mark[V.ragged(base[of], whole[of])] = True
        found = [spans_of(flag, base, length, 0), spans_of(other, base, length, 1)]
        del t
    V.trim()
    return found_rows(table, tuple(np.concatenate([f[k] for f in found]) for k in range(4)))


def spans_of(flag: np.ndarray, base: np.ndarray, length: int, kind: int) -> tuple[np.ndarray, ...]:
    """(piece, kind, first byte, last byte + 1) of the strings of ``length`` that begin at flagged positions."""
    first, stop = V.runs(flag, np.append(base, len(flag)))
    run = np.searchsorted(base, first, "right") - 1
    return run, np.full(len(run), kind), first - base[run], stop - 1 + length - base[run]


def united(run: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of each (run, kind), overlapping ones as one."""
    if not len(run):
        return run, kind, first, last
    order = np.lexsort((first, kind, run))
    run, kind, first, last = run[order], kind[order], first[order], last[order]
    own = np.cumsum(np.append(True, (run[1:] != run[:-1]) | (kind[1:] != kind[:-1])))
    shift = own * (int(last.max()) + 1)
    s, e = unite(first + shift, last + shift)
    at = np.searchsorted(first + shift, s)
    return run[at], kind[at], s - shift[at], e - shift[at]


def unite(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the union of [first, last)."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > last[:-1])
    return first[new], last[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


CUT = ("anchor", "body", "weight", "start", "count", "shard", "low", "high", "mixed")


def with_texts(df: DataFrame, reps: DataFrame) -> DataFrame:
    """(t, cut): each text of which runs are wanted, with these runs."""
    wanted = reps.groupBy("doc", "tid").agg(F.collect_list(F.struct(*CUT)).alias("cut"))
    wanted = scratch.persist_table(wanted.select(F.col("doc").alias("_d"), F.col("tid").alias("_t"), "cut"), "cuts")
    some = marked(df.select("doc", "tid", "t"), ["doc", "tid"], wanted.select(F.col("_d").alias("doc"), F.col("_t").alias("tid")), wanted.count()).where("_marked")
    return some.join(wanted, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tid") == F.col("_t"))).select("t", "cut")


def cut_runs(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(sizes, whether a word can begin there, bytes, the runs' columns) of at most ``limit`` runs at a time."""
    for b in V.trimmed(batches):
        data, off = V.raw(V.binary(b.column(0)))
        cuts = b.column(1)
        flat = cuts.flatten()
        cols = {c: flat.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(CUT)}
        row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(cuts.offsets)))
        for a in range(0, len(row), limit):
            part, own = {c: v[a : a + limit] for c, v in cols.items()}, row[a : a + limit]
            start = off[own] + part["start"]
            size = np.minimum(start + part["count"] - 1 + length, off[own + 1]) - start
            lead = (part["start"] == 0) | (data[np.maximum(start - 1, 0)] <= 32)
            yield size, lead, data[V.ragged(start, size)], part


def window_groups(cut: DataFrame, near: int, length: int, words: int | None, tables: scratch.Tables) -> DataFrame:
    """The same as :func:`shard_groups` by counting whole strings: no task needs more than its own rows, however many runs an anchor has."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, lead, blob, part in cut_runs(batches, length, 128):
            base = np.cumsum(size) - size
            if words:
                at, width = passages_at(blob > 32, base, base + size, part["count"], lead, words, near, length)
                run = np.searchsorted(base, at, "right") - 1
            else:
                whole = np.clip(size - length + 1, 0, part["count"])
                at, run = V.ragged(base, whole), np.repeat(np.arange(len(size)), whole)
                width = np.full(len(at), length)
            h = V.span_hash(V.prefix_hash(UNIT[blob]), at, at + width).view(np.int64)
            own = {c: part[c][run] for c in ("anchor", "body", "weight", "low", "high")} | {"first": at - base[run], "width": width, "h": h}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in own.items()})

    rows = cut.mapInArrow(windows, "anchor long, body long, weight long, low long, high long, first long, width long, h long")
    often = rows.groupBy("anchor", "h").agg(F.sum("weight").alias("n"), (F.min("low") < F.max("high")).alias("apart"))
    often = tables.save(often.where("apart" if words else "n >= 2"), "windows")
    kinds = F.lit(1) if words else F.explode(F.expr("if(apart, array(0, 1), array(0))"))
    starts = rows.join(often.select("anchor", "h", "apart"), ["anchor", "h"]).select("anchor", "body", kinds.alias("kind"), "first", "width")
    place = F.row_number().over(Window.partitionBy("anchor", "body", "kind", "width").orderBy("first"))
    stretch = starts.withColumn("stretch", F.col("first") - place).groupBy("anchor", "body", "kind", "width", "stretch")
    return stretch.agg(F.min("first").alias("first"), (F.max("first") + F.col("width")).alias("last")).select("anchor", "body", "kind", "first", "last")


def repeated_spans(df: DataFrame, near: int, length: int, k: int, words: int | None, tables: scratch.Tables) -> DataFrame:
    """(doc, tid, kind, first, last): byte ranges covered by repeated strings of ``length`` (kind 0) and by those of other documents (kind 1), for
    each document (``df``: doc, tid, t); with ``words`` by passages of other documents of ``near`` to ``length`` - 1 bytes (kind 1) instead."""
    runs = scratch.persist_table(run_rows(df, near, length, k), "runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("body") != F.max("body")).alias("mixed")).where("c > 1").select("anchor", "mixed")
    shared = tables.save(shared, "anchors")  # a table, so that the join below can be split where an anchor is hot
    kept = tables.save(runs.join(shared, "anchor"), "kept-runs")
    scratch.drop_table(runs)
    scratch.release(df.sparkSession)
    who = F.coalesce("doc", "tid")
    reps = kept.groupBy("anchor", "body", "mixed").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "tid", "start", "count")).alias("r"), F.min(who).alias("low"), F.max(who).alias("high"))
    reps = tables.save(reps.select("anchor", "body", "mixed", "weight", "r.*", "low", "high"), "representatives")
    size = F.sum(F.col("count") + (length - 1))
    volume = reps.where("mixed").agg(F.coalesce(size, F.lit(0))).first()[0]
    reps = reps.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, volume // SHARD_BYTES + 1))))
    sizes = reps.where("mixed").groupBy("shard").agg(size.alias("size"))
    large = F.col("mixed") & F.col("shard").isin([r.shard for r in sizes.where(F.col("size") > MOST_BYTES).collect()])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, lead, blob, part in cut_runs(batches, length, 4096):
            ends = np.append(0, np.cumsum(size)).astype(np.int64)
            col = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(blob)]).cast(pa.binary())
            mixed = np.flatnonzero(part["mixed"])
            yield piece_rows({c: part[c][mixed] for c in ("shard", "anchor", "body", "weight", "count", "low", "high")} | {"lead": lead[mixed], "bytes": col.take(pa.array(mixed))})
            sure = np.flatnonzero(~part["mixed"])
            if len(sure):
                own = {c: v[sure] for c, v in part.items()}
                blob = blob[V.ragged(ends[sure], size[sure])]
                run, kind, first, last = whole_runs(size[sure], lead[sure], blob, own, near, length, words)
                yield piece_rows({c: own[c][run] for c in ("shard", "anchor", "body")} | {"kind": kind, "first": first, "last": last})

    sent = with_texts(df, reps.where(~large)).mapInArrow(pieces, ", ".join(f"{f.name} {PIECE_TYPES.get(f.name, 'long')}" for f in PIECES))
    found = sent.groupBy("shard").applyInArrow(lambda t: shard_rows(t, near, length, words), "anchor long, body long, kind int, first long, last long")
    if not reps.where(large).isEmpty():
        found = found.unionByName(window_groups(tables.save(with_texts(df, reps.where(large)), "hot-texts"), near, length, words, tables))
    found = tables.save(found, "repeated")
    del sent
    scratch.release(df.sparkSession)
    return kept.join(found, ["anchor", "body"]).select("doc", "tid", "kind", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


PIECE_TYPES = {"lead": "boolean", "bytes": "binary", "kind": "int"}
PIECES = pa.schema([(c, {"lead": pa.bool_(), "bytes": pa.binary(), "kind": pa.int32()}.get(c, pa.int64())) for c in ("shard", "anchor", "body", "weight", "count", "lead", "low", "high", "bytes", "kind", "first", "last")])


def piece_rows(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """A batch for a shard; columns that are not given are null."""
    n = len(columns["anchor"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in PIECES], schema=PIECES)


def dense_stretches(df: DataFrame, words: int, near: int) -> DataFrame:
    """(doc, tid, shift, t): the stretches of each text in which ``words`` words have fewer than ``near`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.trimmed(batches):
            for r0, _, data, off in V.chunks(V.binary(b.column(2))):
                first, last = V.runs(data > 32, off)
                first, last = first[: max(0, len(first) - words + 1)], last[words - 1 :]
                row = V.row_of(off, first)
                at = np.flatnonzero((last <= off[row + 1]) & (last - first < near))
                if len(at):
                    own, _, s, e = united(row[at], np.zeros(len(at), np.int64), first[at] - off[row[at]], last[at] - off[row[at]])
                    text = pa.array([data[off[r] + x : off[r] + y].tobytes() for r, x, y in zip(own.tolist(), s.tolist(), e.tolist(), strict=True)], pa.binary())
                    of = pa.array(own + r0)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(s), text.cast(pa.string())], names=["doc", "tid", "shift", "t"])

    return df.select("doc", "tid", "t").mapInArrow(run, "doc long, tid long, shift long, t string")


def short_passages(df: DataFrame, words: int, near: int, k: int, tables: scratch.Tables) -> DataFrame:
    """(doc, tid, kind 1, first, last): passages in fewer than ``near`` bytes, from the stretches that hold any."""
    dense = tables.save(dense_stretches(df, words, near).select(F.coalesce("doc", "tid").alias("who"), F.xxhash64("doc", "tid", "shift").alias("piece"), "*"), "stretches")
    if dense.isEmpty():
        return dense.select("doc", "tid", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    spans = repeated_spans(dense.select(F.col("who").alias("doc"), F.col("piece").alias("tid"), "t"), min(near, 2 * words - 1), near, k, words, tables)
    spans = spans.select(F.col("doc").alias("who"), F.col("tid").alias("piece"), F.col("first").alias("f"), F.col("last").alias("l"))
    place = dense.select("who", "piece", "doc", "tid", "shift").distinct()
    return place.join(spans, ["who", "piece"]).select("doc", "tid", F.lit(1).alias("kind"), (F.col("f") + F.col("shift")).alias("first"), (F.col("l") + F.col("shift")).alias("last"))


def docs_id(id_col: str) -> F.Column:
    """The id column, as the operator names it."""
    return F.col(id_col).cast("long").alias("doc")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, carry: list[str] | None = None, words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row; with ``words`` also ``n_passages``, ``n_passage_bytes`` (maximal runs of passages
    that another document holds, and their bytes) and ``shares_passage``.

    ``carry`` adds ``row``, a struct of these other columns, ``changed`` and ``kept``, the text without repeated strings and passages (a
    character that a border cuts goes with the removed part; null texts stay null)."""
    spark, keep_text = df.sparkSession, carry is not None
    text = F.col(text_col).cast("string")
    held = [F.struct(*carry).alias("row")] if keep_text else []
    docs = df.select(docs_id(id_col), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tid"), text.alias("t"), *held)
    tables = scratch.Tables()
    texts = docs.select("doc", "tid", "t")
    back = repeated_spans(texts, length, length, k, None, tables)
    if words:
        near = min(length, SAMPLE)
        back = back.unionByName(repeated_spans(texts, near, length, k, words, tables)).unionByName(short_passages(texts, words, near, k, tables))
    spans = back.groupBy("doc", "tid").agg(F.collect_set(F.struct("kind", "first", "last")).alias("spans"))
    spans = scratch.persist_table(spans.select(F.col("doc").alias("_d"), F.col("tid").alias("_t"), "spans"), "spans")
    tables.drop()
    scratch.release(spark)
    flagged = marked(docs, ["doc", "tid"], spans.select(F.col("_d").alias("doc"), F.col("_t").alias("tid")), spans.count())
    picked = ["doc", "t", "spans", *(["row"] if keep_text else [])]
    some = flagged.where("_marked").join(spans, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tid") == F.col("_t")), "left").select(*picked)
    rest = flagged.where("not _marked").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(a, ROWS) for b in V.trimmed(batches) for a in range(0, b.num_rows, ROWS)):
            known = b.column(1).is_valid().to_pylist()
            data, off = V.raw(V.binary(b.column(1)))
            V.trim()
            spans = b.column(2).fill_null([]) if b.column(2).null_count else b.column(2)
            flat = spans.flatten()
            kind, first, last = (np.asarray(flat.field(i)) for i in range(3))
            at = np.asarray(spans.offsets) - np.asarray(spans.offsets)[0]
            out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes", "changed", "kept")}
            for r in range(b.num_rows):
                text, x = data[off[r] : off[r + 1]], slice(at[r], at[r + 1])
                s, e = unite(first[x][kind[x] == 0], last[x][kind[x] == 0])
                ps, pe = unite(first[x][kind[x] == 1], last[x][kind[x] == 1])
                out["n_removed"].append(int((e - s).sum()))
                out["n_spans"].append(len(s))
                out["n_passages"].append(len(ps))
                out["n_passage_bytes"].append(int((pe - ps).sum()))
                if keep_text:
                    s, e = unite(first[x], last[x])
                left = b"".join(text[y:z].tobytes() for y, z in zip(np.append(0, e).tolist(), np.append(s, len(text)).tolist(), strict=True)) if len(s) else text.tobytes()
                if keep_text:
                    out["changed"].append(len(s) > 0)
                    out["kept"].append(left.decode("utf-8", "ignore") if known[r] else None)
                else:
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            cols = {"doc": b.column(0), "n_bytes": pa.array(np.diff(off)), "row": b.column(3) if keep_text else None}
            types = {"kept_sha256": pa.string(), "changed": pa.bool_(), "kept": pa.string()}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.array(out[c], types.get(c, pa.int64())) for c in names], names=names)

    names = ["doc", "n_bytes", "n_removed", "n_spans", *(["changed", "row", "kept"] if keep_text else ["kept_sha256"]), *(["n_passages", "n_passage_bytes"] if words else [])]
    types = {"doc": "long", "kept_sha256": "string", "changed": "boolean", "kept": "string", "row": docs.schema["row"].dataType.simpleString() if keep_text else ""}
    done = some.unionByName(rest).mapInArrow(run, ", ".join(f"{c} {types.get(c, 'long')}" for c in names))
    if words:
        done = done.withColumn("shares_passage", F.col("n_passages") > 0)
    return done.withColumnRenamed("doc", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of ``documents``, and its passages of over 50 words that several documents hold."""
    return suffix_dedup(scratch.load(spark, sf_dir, "documents"), words=WORDS)
