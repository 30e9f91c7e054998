"""Operator 10, language identification: word-first back-off.

A known word is scored by its log frequency in each language; an unseen word falls back to its character n-grams of the longest length
that knows any of them, down to single letters.  A text's score in a language is the mean over its words; the best mean wins.

Model: counts of words and n-grams over a sample of labelled training rows (``sample_docs`` with the smallest hash of their id: the
documented bound, which also bounds the model); nothing of the sample is left out.
Every whole text is scored.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled training row everything is ``und``;
ties go to the alphabetically first language; repeated rows each get a row; only the id and text columns are read for a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V

SAMPLE_DOCS, LONGEST, CACHE = 20_000, 6, 200_000
MISSING = 1.5  # decades below the rarest entry that a word or n-gram absent from a language costs
_letters: list[np.ndarray] = []
_models: dict[str, tuple[V.Memo, np.ndarray]] = {}
V.cached("language", _models.clear)
V.cached("language", _letters.clear)


def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter, 2, or a mark, 1; lower case; random unit) for every code point."""
    if not _letters:
        n = 0x110000
        flag = np.fromiter(("ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(n)), np.uint8, n)
        low = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(n)), np.uint32, n)
        _letters.extend([flag, low, V.unit_table(n, 23)])
    return tuple(_letters)


class Text:
    """Words (runs of letters and marks with a letter among them, lower-cased) of a chunk: padded code points, starts, ends, rows and hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        flag, low, unit = letters()
        cp = V.code_points(data)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        rows = lead[off] if len(cp) == lead[-1] else None
        if rows is None:  # broken UTF-8: row by row
            parts = [V.code_points(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            cp = np.concatenate(parts)
            rows = np.append(0, np.cumsum([len(p) for p in parts]))
        kind = flag[cp]
        start, end = V.runs(kind > 0, rows)
        before = np.append(0, np.cumsum(kind == 2))
        worded = before[end] > before[start]
        self.start, self.end = start[worded], end[worded]
        self.row = V.row_of(rows, self.start)
        self.unit = unit[low[cp]]
        self.hash = V.span_hash(V.prefix_hash(self.unit), self.start, self.end) if len(self.start) else np.empty(0, np.uint64)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number in ``which``) of all n-grams of the chosen words, each word between two blanks."""
        s, size = self.start[which], self.end[which] - self.start[which]
        width = size + 2
        padded = np.full(int(width.sum()), letters()[2][32], np.uint64)
        base = np.cumsum(width) - width
        padded[V.ragged(base + 1, size)] = self.unit[V.ragged(s, size)]
        count = np.maximum(width - n + 1, 0)
        if n == 1:
            base, count = base + 1, size  # letters only
        at = V.ragged(base, count)
        h = V.prefix_hash(padded)
        return V.span_hash(h, at, at + n), np.repeat(np.arange(len(which)), count)


def count_rows(df: DataFrame) -> DataFrame:
    """(lang, n, key, c): occurrences of words (n = 0) and n-grams by language, counted inside each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.trimmed(batches, "language"):
            names, lang = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for r0, _, data, off in V.chunks(V.binary(b.column(1))):
                t = Text(data, off)
                if not len(t.hash):
                    continue
                code = lang[r0 + t.row]
                for n in range(LONGEST + 1):
                    key, own = (t.hash, np.arange(len(t.hash))) if n == 0 else t.grams(np.arange(len(t.hash)), n)
                    for k in np.unique(code):
                        uniq, c = np.unique(key[code[own] == k], return_counts=True)
                        m = len(uniq)
                        yield pa.RecordBatch.from_arrays([pa.array([names[k]] * m, pa.string()), pa.array(np.full(m, n, np.int32)), pa.array(uniq.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "key", "c"])

    return df.mapInArrow(run, "lang string, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model: languages and, for words and each n, sorted keys with a log10 frequency per language."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    hashed = F.xxhash64(F.col(id_col))
    cut = rows.select(hashed.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = rows.where(hashed <= F.lit(cut)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")) if cut is not None else rows.limit(0).select(F.lit("").alias("lang"), F.lit("").alias("t"))
    counts = scratch.persist_table(count_rows(sample), "language-counts")
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    got = counts.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "key", F.log10(F.col("c") / F.col("total")).cast("float").alias("v")).toArrow()  # totals: seven rows a language
    scratch.drop_table(counts)
    names = got["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    lang = np.searchsorted(langs, names.dictionary.to_pylist())[names.indices.to_numpy()] if langs else np.empty(0, np.int64)
    size, key, value = got["n"].to_numpy(), got["key"].to_numpy().view(np.uint64), got["v"].to_numpy()
    model = {"langs": langs, "tables": []}
    for n in range(LONGEST + 1):
        part = size == n
        keys, row = np.unique(key[part], return_inverse=True)
        table = np.full((len(keys), len(langs)), value[part].min() - MISSING if part.any() else 0.0, np.float32)
        table[row, lang[part]] = value[part]
        model["tables"].append((keys, table))
    del got, size, key, value, lang
    V.trim()
    return model


def word_scores(t: Text, which: np.ndarray, model: dict) -> np.ndarray:
    """Log frequencies by language of the chosen words: known words first, then ever shorter n-grams."""
    out = np.zeros((len(which), len(model["langs"])), np.float32)
    todo = np.arange(len(which))
    for n in [0, *range(LONGEST, 0, -1)]:
        keys, table = model["tables"][n]
        if not len(todo) or not len(keys):
            continue
        h, own = (t.hash[which[todo]], np.arange(len(todo))) if n == 0 else t.grams(which[todo], n)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        own, at = own[hit], at[hit]
        count = np.bincount(own, minlength=len(todo))
        found = count > 0
        for k in range(out.shape[1]):
            out[todo[found], k] = np.bincount(own, weights=table[at, k], minlength=len(todo))[found] / count[found]
        todo = todo[~found]
    return out


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) for every row, or with ``carry`` these columns in the id's place; score is the winner's share over all
    languages of 10 to the mean log frequency, sharpened by the number of words (20 at most)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    key = f"{id(model)}-{np.random.default_rng().integers(1 << 60)}"
    kept = [id_col] if carry is None else carry
    picked = df.select(*kept) if text_col in kept else df.select(*kept, text_col)
    where = picked.columns.index(text_col)
    if picked.schema[text_col].dataType.simpleString() != "string":
        picked = picked.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m["langs"])
        if key not in _models:
            _models.clear()
            _models[key] = (V.Memo(CACHE), np.zeros((0, k), np.float32))
        for b in V.trimmed(batches, "language"):
            names = np.array([*m["langs"], "und"], object)
            for r0, r1, data, off in V.chunks(V.binary(b.column(where))):
                t = Text(data, off)
                n = r1 - r0
                words = np.bincount(t.row, minlength=n)
                mean = np.zeros((n, k))
                if len(t.hash) and k:
                    memo, table = _models[key]
                    if memo.size > memo.limit:
                        memo.clear()
                        table = table[:0]
                    uniq, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
                    row = memo.find(uniq)
                    new = row < 0
                    if new.any():
                        table = np.concatenate([table, word_scores(t, first[new], m)])
                        row[new] = memo.add(uniq[new])
                    _models[key] = (memo, table)
                    own = row[inverse]
                    for j in range(k):
                        mean[:, j] = np.bincount(t.row, weights=table[own, j], minlength=n) / np.maximum(words, 1)
                best, score = np.full(n, -1), np.zeros(n)
                if k:
                    sharp = 10.0 ** ((mean - mean.max(axis=1, keepdims=True)) * np.minimum(words, 20)[:, None])
                    best, score = np.where(words > 0, mean.argmax(axis=1), -1), np.where(words > 0, 1 / sharp.sum(axis=1), 0.0)
                part = b.slice(r0, n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(kept)])
    return picked.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = scratch.load(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
