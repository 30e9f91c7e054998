"""Operator 8, document fingerprints by winnowing.

All k-grams of code points are hashed; of every window of ``window`` neighbouring hashes the smallest is chosen, the rightmost on ties.
Any match of ``window + k - 1`` code points or more therefore shares a chosen hash, and positions are kept, so the match can be found.
A fingerprint is the base64 text of 5-byte records (32-bit hash, distance to the record before, both little-endian; a distance over 255 takes
filler records with hash 0 and distance 255).  A text shorter than k is one hash of the whole; a text with fewer hashes than a window is one
window; the empty text has the empty fingerprint.  Likeness of two fingerprints is the Jaccard similarity of their hash sets (1 for two
empty ones, 0 for one).

Defined cases: a null text is empty; rows are ordered by (id, text), null ids first, and repeated rows follow each other; the last row's
next is the first row; a table of one row is its own next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V

K, WINDOW = 12, 20
ROWS_PER_PART = 1_000
ACCURACY = 200_000
MOST_PARTS = 20_000


def winnow(cp: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from one text's code points."""
    n = len(cp)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = V.prefix_hash(V.mix(cp.astype(np.uint64) + np.uint64(1)))
    if n < k:
        return (V.span_hash(h, np.array([0]), np.array([n])) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    g = V.rolling_hash(h, k) >> np.uint64(32)
    m = len(g)
    w = min(window, m)
    # smallest hash first, then the rightmost place: one minimum over (hash, distance from the end)
    key = g << np.uint64(32) | (np.uint64(m) - np.arange(m, dtype=np.uint64))
    low, span = key, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: m - w + 1], low[w - span : w - span + m - w + 1])
    chosen = low[np.append(True, low[1:] != low[:-1])]
    pos = m - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (chosen >> np.uint64(32)).astype(np.uint32), pos


RECORD = np.dtype([("hash", "<u4"), ("gap", "u1")])


def to_text(hashes: np.ndarray, pos: np.ndarray) -> str:
    """The printable form of a fingerprint."""
    gap = np.diff(pos, prepend=0)
    filler = gap // 255 if len(gap) else gap  # a real record has a gap below 255
    rec = np.zeros(len(hashes) + int(filler.sum()), RECORD)
    rec["gap"] = 255
    at = np.cumsum(filler + 1) - 1
    rec["hash"][at] = hashes
    rec["gap"][at] = gap - 255 * filler
    return base64.b64encode(rec.tobytes()).decode()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a printable fingerprint."""
    rec = np.frombuffer(base64.b64decode(text), RECORD)
    real = rec["gap"] != 255
    return rec["hash"][real], np.cumsum(rec["gap"].astype(np.int64))[real]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct hash arrays."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def fingerprint(df: DataFrame, text_col: str = "text", k: int = K, window: int = WINDOW, out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text."""

    @F.pandas_udf("string")
    def run(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: to_text(*winnow(V.code_points(np.frombuffer((t or "").encode(), np.uint8)), k, window)))

    return df.withColumn(out_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt out by ranges of the id: (part, tail, id, text); each range also gets the next range's first rows, marked ``tail``.

    Borders are existing ids (quantiles), so the next range's first row is known by its id alone and texts are shuffled once."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = rows.agg(F.count("*"), F.min("id")).first()
    parts = max(1, min(MOST_PARTS, stats[0] // ROWS_PER_PART))
    cuts = []
    if parts > 1:
        got = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], ACCURACY)).first()[0] or []
        cuts = sorted({c for c in got if c is not None and c > stats[1]})
    has_null = stats[0] > 0 and rows.where("id is null").limit(1).count() > 0
    borders = F.array(*[F.lit(c) for c in cuts])
    if cuts:
        part = _bisect(F.col("id"), borders, len(cuts))
    else:
        part = F.lit(0)
    part = F.when(F.col("id").isNull(), 0).otherwise(part)
    first = F.array_contains(borders, F.col("id")) if cuts else F.lit(False)
    lowest = F.col("id").isNull() if has_null else F.col("id") == F.lit(stats[1])
    last = len(cuts)
    to = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")))
    to = F.when(F.col("first"), F.concat(to, F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("tail"))))).when(F.col("lowest"), F.concat(to, F.array(F.struct(F.lit(last).alias("part"), F.lit(1).alias("tail"))))).otherwise(to)
    sent = rows.withColumn("part", part.cast("int")).withColumn("first", F.coalesce(first, F.lit(False))).withColumn("lowest", F.coalesce(lowest, F.lit(False)))
    return sent.select("id", "text", F.explode(to).alias("to")).select("to.part", "to.tail", "id", "text")


def _bisect(c: F.Column, borders: F.Column, n: int) -> F.Column:
    """How many of the n sorted borders are not above the value, by binary search."""
    def halve(a: F.Column, _: F.Column) -> F.Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = (a["lo"] < a["hi"]) & (F.get(borders, F.least(mid, F.lit(n - 1))) <= c)
        return F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve)["lo"]


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row and its successor by id."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    dealt = with_next(df, id_col, text_col).repartition(scratch.partitions(spark), "part").sortWithinPartitions("part", "tail", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        rows: list[tuple] = []

        def finish(now: tuple, text: str, own: np.ndarray) -> None:
            ident, t, mine, mine_printed = now
            cut = len(t) // 4
            edited = t[: len(t) - cut] + text[:cut]
            h, pos = winnow(V.code_points(np.frombuffer(edited.encode(), np.uint8)), k, window)
            rows.append((ident, len(t), hashlib.sha256(edited.encode()).hexdigest(), mine_printed, to_text(h, pos), likeness(mine, np.unique(h)), likeness(mine, own)))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]], names=names)
            rows.clear()
            return out

        now = part = None
        size = 0
        id_type = None
        for b in V.trimmed(batches):
            id_type = b.column(2).type
            for p, tail, ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if part is not None and p == part and now is None:
                    continue  # further rows behind the tail
                text = text.as_py() or ""
                h, pos = winnow(V.code_points(np.frombuffer(text.encode(), np.uint8)), k, window)
                own, printed = np.unique(h), to_text(h, pos)
                if p == part and now is not None:
                    finish(now, text, own)
                    size += 8 * len(text)
                part, now = p, None if tail else (ident, text, own, printed)
                if size > 16 << 20:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    out = dealt.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and their successors."""
    return edited_pairs(scratch.load(spark, sf_dir, "documents"))
