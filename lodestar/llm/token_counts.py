"""Operator 1, token counts: a prefix dynamic programme keeps the exact token count of every prefix.

``token_counts`` gives a text's total, ``token_prefixes`` the count at every code-point prefix, and ``truncate`` answers budget
questions from such stored counts without encoding anything again.

Words of plain texts are split by vectorised rules.  A text with a code point above U+02FF, a control character or a special string is split by the
vocabulary library's normaliser and pattern; its words go through the same programme.

Defined cases: a null text counts as empty (0 tokens, prefixes ``[0]``); repeated rows are kept, each with its own count; all other
columns of the input are kept by ``token_prefixes`` and ``truncate`` as they are; an empty table gives an empty table.  A prefix that ends inside
a stretch without blanks which normalisation changes in length, or which holds a special string, is encoded by the library.
No row is shuffled: the operator is one pass over the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V
from .bpe import KIND, Words, WordVocab

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 600_000
_vocab: dict[str, WordVocab] = {}
_counts: dict[str, tuple[V.Memo, np.ndarray]] = {}
_odd: dict[bytes, np.ndarray] = {}
for _cache in (_vocab, _counts, _odd):
    V.cached("tokens", _cache.clear)
BLANKS = re.compile("[ \t\n\r\x0b\x0c\xa0\u2028\u2029\u3000]+")


def vocabulary(path: str | None) -> WordVocab:
    """The worker's copy of a vocabulary; None: the installed public one."""
    if path not in _vocab:
        import public_tokenizers

        _vocab[path] = WordVocab(path or public_tokenizers.path(VOCABULARY))
    return _vocab[path]


def word_totals(v: WordVocab, words: Words, path: str | None) -> np.ndarray:
    """Tokens of every word of the chunk, by the prefix dynamic programme over the words not seen before."""
    memo, counts = _counts.setdefault(path, (V.Memo(CACHE_WORDS), np.zeros(0, np.int32)))
    if memo.size > memo.limit:
        memo.clear()
        counts = counts[:0]
    uniq, first, inverse = words.distinct()
    row = memo.find(uniq)
    new = row < 0
    if new.any():
        data, s, e = words.utf8(first[new])
        off, prefix = v.prefix_counts(data, s, e)
        counts = np.append(counts, prefix[off[1:] - 1].astype(np.int32))
        row[new] = memo.add(uniq[new])
    _counts[path] = (memo, counts)
    return counts[row][inverse]


def odd_counts(v: WordVocab, words: set[bytes]) -> dict[bytes, np.ndarray]:
    """Counts at every byte prefix of words that the library has split, from the programme; kept for the worker's next chunks."""
    if len(_odd) > CACHE_WORDS // 12:
        _odd.clear()
    new = [w for w in words if w not in _odd]
    if new:
        ends = np.cumsum([len(w) for w in new])
        off, counts = v.prefix_counts(np.frombuffer(b"".join(new), np.uint8), ends - [len(w) for w in new], ends)
        _odd.update({w: counts[a:b] for w, a, b in zip(new, off[:-1].tolist(), off[1:].tolist(), strict=True)})
    return _odd


def count_texts(col: pa.Array, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, tokens) of every text of an Arrow column; nulls count as empty."""
    v = vocabulary(path)
    col = V.binary(col)
    size, total = [], []
    for _, _, data, off in V.chunks(col):
        words = Words(data, off, v.specials)
        n = V.sums(word_totals(v, words, path), words.row, len(off) - 1)
        odd = {k: v.words(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")) for k in np.flatnonzero(~words.plain).tolist()}
        if odd:
            counts = odd_counts(v, {w for own, _ in odd.values() for w in own})
            for k, (own, specials) in odd.items():
                n[k] = specials + sum(int(counts[w][-1]) for w in own)
        size.append(np.diff(off))
        total.append(n)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(size), np.concatenate(total)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, vocab_path: str | None = None) -> DataFrame:
    """One row for each row of ``df``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.trimmed(batches, "tokens"):
            size, n = count_texts(b.column(1), vocab_path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def stretch_counts(stretch: str, v: WordVocab) -> np.ndarray:
    """Token counts of stretch[:0], stretch[:1], ... of a text without blanks."""
    n = len(stretch)
    letters = {c: v.tokenizer.normalizer.normalize_str(c) for c in set(stretch)}
    even = all(len(x) == 1 for x in letters.values()) and unicodedata.is_normalized("NFC", stretch) and not v.special.search(stretch)
    if even:
        lowered = "".join(letters[c] for c in stretch)
        words = [w.translate(v.to_bytes).encode("latin-1") for w, _ in v.tokenizer.pre_tokenizer.pre_tokenize_str(lowered)]
        even = b"".join(words) == lowered.encode()  # nothing but the words, so places can be counted off
    if not even:
        return np.array([len(v.tokenizer.encode(stretch[:i], add_special_tokens=False).ids) for i in range(n + 1)], np.int32)
    counts = odd_counts(v, set(words))
    out, base, at = np.zeros(n + 1, np.int32), 0, 0
    for w in words:
        body = np.frombuffer(w, np.uint8)
        ends = np.append(np.flatnonzero((body & 0xC0) != 0x80)[1:], len(body))
        inner = counts[w][ends]
        if len(ends) == 3 and w[:1] == b"'" and w[1:2].isalpha():
            inner = inner.copy()
            inner[1] = 2  # a contraction that is cut is an apostrophe and a letter
        out[at + 1 : at + 1 + len(ends)] = base + inner
        base, at = base + int(counts[w][-1]), at + len(ends)
    return out


def prefix_counts_of(text: str, v: WordVocab) -> np.ndarray:
    """Token counts of text[:0], text[:1], ..., text[:len(text)]."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = Words(data, np.array([0, len(data)]), v.specials)
    n = len(text)
    if not words.plain[0]:
        out = np.zeros(n + 1, np.int32)
        base = at = 0
        for gap in [*BLANKS.finditer(text), None]:
            stop, after = gap.span() if gap else (n, n)
            out[at : stop + 1] = base + stretch_counts(text[at:stop], v)
            base, at = int(out[stop]), after
            out[stop : after + 1] = base
        return out
    uniq, first, inverse = words.distinct()
    data, s, e = words.utf8(first)
    off, prefix = v.prefix_counts(data, s, e)
    total = prefix[off[1:] - 1]
    out = np.zeros(n + 1, np.int32)
    base, at = 0, 0
    for w in range(len(words.start)):
        a, b, k = int(words.start[w]), int(words.end[w]), int(inverse[w])
        out[at : a + 1] = base
        body = words.cp[a:b]
        ends = np.cumsum(np.where(body >= 0x80, 2, 1))
        inner = prefix[off[k] + ends]
        if b - a == 3 and body[0] == 39 and KIND[body[1]] == KIND[ord("a")]:
            inner[1] = 2  # a contraction that is cut is an apostrophe and a letter
        out[a + 1 : b + 1] = base + inner
        base += int(total[k])
        at = b + 1
    out[at:] = base
    return out


def token_prefixes(df: DataFrame, text_col: str = "text", vocab_path: str | None = None, out_col: str = "prefix_tokens") -> DataFrame:
    """``df`` with the token count of every code-point prefix, as ``array<int>`` of n_chars + 1 entries."""

    @F.pandas_udf("array<int>")
    def prefixes(texts):  # noqa: ANN001, ANN202
        v = vocabulary(vocab_path)
        return texts.map(lambda t: prefix_counts_of(t or "", v))

    return df.withColumn(out_col, prefixes(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def truncate(df: DataFrame, budget: int, text_col: str = "text", prefix_col: str = "prefix_tokens", out_col: str = "truncated") -> DataFrame:
    """The longest prefix with at most ``budget`` tokens, from stored counts alone (a shorter prefix may have more tokens than a longer)."""
    fit = F.array_max(F.filter(F.sequence(F.lit(0), F.size(prefix_col) - 1), lambda i: F.get(prefix_col, i) <= budget))
    return df.withColumn(out_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), fit))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts(scratch.load(spark, sf_dir, "documents"))
