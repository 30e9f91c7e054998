"""What tasks do with Arrow batches: cutting them, tokens of a text, and the best rows for each query while the batches pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import CJK

#: Characters of a slice that is worked on at a time.
CHUNK_CHARS = 1 << 20
_RUNS, _CJK, _GAPS = re.compile(f"[A-Za-z0-9_]+|[{CJK}]+"), re.compile(f"[{CJK}]"), re.compile(f"(?<=[{CJK}])[^A-Za-z0-9_{CJK}]+(?=[{CJK}])")


def tokens(low: str) -> list[str]:
    """``text.tokenize`` of a text that is lower-cased."""
    if not _CJK.search(low):
        return _RUNS.findall(low)
    out = []
    for r in _RUNS.findall(_GAPS.sub("", low)):
        out += [r[i : i + 2] for i in range(len(r) - 1)] if len(r) > 2 and _CJK.match(r) else [r]
    return out


def cut(b: pa.RecordBatch, sizes: np.ndarray, most: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows and, unless it is a single row, so large a sum of sizes."""
    ends, at = np.cumsum(sizes), 0
    while at < b.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = max(at + 1, min(to, at + rows))
        yield b.slice(at, to - at)
        at = to


def slices(batches: Iterable[pa.RecordBatch], texts: list[str], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut by the characters in their text columns."""
    for b in batches:
        yield from cut(b, sum(pc.utf8_length(b[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), CHUNK_CHARS, rows)


class Best:
    """The first k for each of some queries in the order of ``ranking.top_k``: scores at 9 decimals, then load order.  Scores of -inf are no
    candidates."""

    def __init__(self, queries: int, k: int | None) -> None:
        self.k, self.scores, self.ords = k or 0, np.full((queries, k or 0), -np.inf), np.zeros((queries, k or 0), np.int64)

    def add(self, scores: np.ndarray, ords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A batch (queries x texts) joins.  For each query's new best: its place among the old ones (below k) or in the batch (less k)."""
        places = np.empty(self.scores.shape, np.int64)
        for i, s in enumerate(scores):  # one query at a time: only what may enter is sorted
            last = np.round(self.scores[i, -1], 9) if self.k else np.inf
            into = np.flatnonzero((np.round(s, 9) >= last) & (s > -np.inf))
            both, of = np.concatenate([self.scores[i], s[into]]), np.concatenate([self.ords[i], ords[into]])
            order = np.lexsort((of, -np.round(both, 9)))[: self.k]
            places[i] = np.concatenate([np.arange(self.k), self.k + into])[order]
            self.scores[i], self.ords[i] = both[order], of[order]
        return places

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ord, score)."""
        of, at = np.nonzero(self.scores > -np.inf)
        return of, self.ords[of, at], self.scores[of, at]
