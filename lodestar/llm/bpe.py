"""Word-level byte-pair encoding: vectorised splitting into words and an exact prefix dynamic programme over them.

A vocabulary of this kind lower-cases, drops white space and encodes each word on its own, the last symbol of a word carrying the
end-of-word mark.  A text's tokens are therefore the tokens of its words, and each *distinct* word has to be looked at once per worker.

Prefix dynamic programme.  For each prefix of a word's bytes two states are kept: the token in which an encoding that goes on ends
(``open``), and the one in which an encoding that stops there ends (``closed``, with the end-of-word mark).  A byte-pair encoding is
exactly the sequence in which every neighbouring pair of tokens is the encoding of its own concatenation, so the last token of a
prefix is the vocabulary entry that fits its end and is compatible with the state before it, and

    count_closed[i] = 1 + count_open[i - len(closed[i])].

Every prefix's count is stored, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from . import textvec as V

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SAFE = 0x300  # below it NFC changes nothing and lower case is one to one, U+0130 apart


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(SAFE, OTHER, np.uint8)
    lower = np.arange(SAFE, dtype=np.uint32)
    odd = np.zeros(SAFE, bool)
    for c in range(SAFE):
        s = chr(c)
        group = unicodedata.category(s)[0]
        kind[c] = SPACE if s in "\t\n\r \xa0" else LETTER if group == "L" else NUMBER if group == "N" else OTHER
        low = s.lower()
        if len(low) == 1:
            lower[c] = ord(low)
        odd[c] = len(low) != 1 or ord(low) >= SAFE or (group == "C" and s not in "\t\n\r")
    return kind, lower, odd


KIND, LOWER, ODD = _classes()
UNIT = V.unit_table(SAFE, 11)
LONG = 256  # bytes from which a word is worked through by itself
#: The endings that the vocabulary's own splitting pattern takes together with an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as symbol -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def split_words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased safe code points: starts, ends, rows.  Runs of letters, single numbers, runs of other signs."""
    kind = KIND[cp]
    n = len(cp)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    first = kind != SPACE
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != NUMBER)
    border = np.zeros(n + 1, bool)
    border[off] = True
    same &= ~border[:n]
    start = first & ~same
    # an apostrophe that stands alone between other kinds takes a contraction's letters with it
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        nxt = np.minimum(apos + 1, n - 1)
        alone = start[apos] & (apos + 1 < n) & (kind[nxt] == LETTER) & ~border[apos + 1]
        row_end = off[np.searchsorted(off, apos, "right")] if alone.any() else apos
        for p, stop in zip(apos[alone].tolist(), row_end[alone].tolist(), strict=True):
            tail = "".join(map(chr, cp[p + 1 : min(p + 3, stop)].tolist()))
            hit = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
            if hit:
                start[p + 1] = False
                q = p + 1 + len(hit)
                if q < stop and kind[q] == LETTER:
                    start[q] = True
    s = np.flatnonzero(start)
    # a word ends where the next begins or where white space or a row's end comes first
    gap = np.flatnonzero(~first | border[:n])
    gap = np.append(gap, n)
    nxt_start = np.append(s[1:], n)
    at = np.searchsorted(gap, s, "right")
    e = np.minimum(nxt_start, gap[at])
    return s, e, V.row_of(off, s)


class WordVocab:
    """The tables of one end-of-word vocabulary file for the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        model = model["model"]
        mark = model["end_of_word_suffix"]
        symbol = byte_symbols()
        self.to_bytes = str.maketrans({c: chr(b) for c, b in symbol.items()})
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.final = np.zeros(max(size, self.tokenizer.get_vocab_size()), bool)
        self.length = np.zeros(size, np.int32)
        keys = []
        for tok, i in vocab.items():
            closed = tok.endswith(mark) and tok != mark
            body = bytes(symbol[c] for c in (tok[: -len(mark)] if closed else tok))
            self.final[i], self.length[i] = closed, len(body)
            keys.append((body, closed, i))
        self.longest = int(self.length.max())
        ids = np.array([k[2] for k in keys], np.int64)
        closed = np.array([k[1] for k in keys])
        blob = np.frombuffer(b"".join(k[0] for k in keys), np.uint8)
        ends = np.cumsum([len(k[0]) for k in keys])
        starts = ends - np.array([len(k[0]) for k in keys])
        h = V.span_hash(V.prefix_hash(V.BYTE_UNIT[blob]), starts, ends)
        self.by_hash = {}
        for c in (False, True):
            order = np.argsort(h[closed == c])
            self.by_hash[c] = (h[closed == c][order], ids[closed == c][order])
        self.left = np.full(size, -1, np.int64)  # the two parts of a merged token
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # -1: a single byte
        pair, made = [], []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
            pair.append(x << 32 | y)
            made.append(r)
        order = np.argsort(pair)
        self.pair, self.made = np.array(pair, np.int64)[order], np.array(made, np.int64)[order]
        self.fits: dict[tuple[int, int], bool] = {}
        self.path, self._known = path, None
        del model, vocab, keys, pair, made
        V.trim()

    @property
    def known(self) -> dict[bool, dict[bytes, int]]:
        """Tokens by their bytes, open and closed: read when the first long word comes."""
        if self._known is None:
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            mark, out = model["end_of_word_suffix"], {False: {}, True: {}}
            for tok, i in model["vocab"].items():
                closed = tok.endswith(mark) and tok != mark
                out[closed][(tok[: -len(mark)] if closed else tok).translate(self.to_bytes).encode("latin-1")] = i
            self._known = out
        return self._known

    def token(self, hashes: np.ndarray, closed: bool) -> np.ndarray:
        """Token of each hashed byte string, -1 where the vocabulary has none."""
        keys, ids = self.by_hash[closed]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, ids[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's concatenation is the pair (a, b): no merge across the seam comes before those inside.

        The merges that made both tokens are undone, latest first; a merge across the seam that would have come earlier than the one
        just undone breaks the pair."""
        n = len(a)
        ok = np.ones(n, bool)
        live = np.arange(n)
        a, b = a.copy(), b.copy()
        limit = np.full(n, np.iinfo(np.int64).max)
        tie = np.zeros(n, bool)  # True: the limit is a merge on the right side, which an equal rank to its left precedes
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            r = np.where(self.pair[at] == key, self.made[at], np.iinfo(np.int64).max)
            bad = (r < limit) | ((r == limit) & tie & (r != np.iinfo(np.int64).max))
            ra, rb = self.rank[a], self.rank[b]
            over = bad | ((ra < 0) & (rb < 0))
            ok[live[bad]] = False
            keep = ~over
            live, a, b, ra, rb, limit, tie = (x[keep] for x in (live, a, b, ra, rb, limit, tie))
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb)
            tie = ~undo_a
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_a, b, self.left[b])
        return ok

    def words(self, text: str) -> tuple[list[bytes], int]:
        """(words, special strings) of any text: split by the library's own normaliser and pattern, each word as the bytes that are encoded."""
        out, pieces = [], self.special.split(text)
        for piece in pieces:
            if piece:
                out += [w.translate(self.to_bytes).encode("latin-1") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]
        return out, len(pieces) - 1

    def fit(self, a: int, b: int) -> bool:
        """:meth:`compatible` for one pair, remembered."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            known = self.fits[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def long_counts(self, word: bytes) -> np.ndarray:
        """The prefix dynamic programme over one long word, position by position: counts of its first 0, 1, ... bytes, closed."""
        n = len(word)
        token, count, closed = [-1] * (n + 1), [0] * (n + 1), np.zeros(n + 1, np.int64)
        inner, last = self.known[False], self.known[True]
        for i in range(1, n + 1):
            for of in (inner, last):
                for j in range(max(0, i - self.longest), i):
                    t = of.get(word[j:i])
                    if t is not None and (j == 0 or self.fit(token[j], t)):
                        if of is inner:
                            token[i], count[i] = t, count[j] + 1
                        else:
                            closed[i] = count[j] + 1
                        break
        return closed

    def prefix_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix dynamic programme over all given words of ``data`` at once.

        Returns (offsets, counts): counts[offsets[w] + i] is the number of tokens of the first i bytes of word w, encoded as a word
        that stops there (0 at i = 0)."""
        n = len(starts)
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            off = np.append(0, np.cumsum(ends - starts + 1))
            out = np.empty(off[-1], np.int64)
            short = np.flatnonzero(ends - starts <= LONG)
            _, out[V.ragged(off[:-1][short], (ends - starts + 1)[short])] = self.prefix_counts(data, starts[short], ends[short])
            for k in long.tolist():
                out[off[k] : off[k + 1]] = self.long_counts(data[starts[k] : ends[k]].tobytes())
            return off, out
        order = np.argsort(ends - starts, kind="stable")[::-1]
        s, e = starts[order], ends[order]
        size = (e - s).astype(np.int64)
        base = np.zeros(n + 1, np.int64)
        np.cumsum(size + 1, out=base[1:])
        open_token = np.full(base[-1], -1, np.int64)
        open_count = np.zeros(base[-1], np.int64)
        closed_count = np.zeros(base[-1], np.int64)
        h = V.prefix_hash(V.BYTE_UNIT[data])
        base0, neg = base[:-1], -size
        for i in range(1, int(size[0]) + 1 if n else 0):
            m = int(np.searchsorted(neg, -i, "right"))  # words of i bytes or more come first
            for closed in (True, False):
                todo = np.arange(m)
                for length in range(min(i, self.longest), 0, -1):
                    end = s[todo] + i
                    t = self.token(V.span_hash(h, end - length, end), closed)
                    has = t >= 0
                    if not has.any():
                        continue
                    w, t = todo[has], t[has]
                    before = base0[w] + i - length
                    if length == i:
                        fits = np.ones(len(w), bool)
                    else:
                        fits = self.compatible(open_token[before], t)
                    w, t, before = w[fits], t[fits], before[fits]
                    at = base0[w] + i
                    if closed:
                        closed_count[at] = open_count[before] + 1
                    else:
                        open_token[at], open_count[at] = t, open_count[before] + 1
                    if len(w):
                        done = np.zeros(m, bool)
                        done[w] = True
                        todo = todo[~done[todo]]
                    if not len(todo):
                        break
        off = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts + 1, out=off[1:])
        out = np.empty(base[-1], np.int64)
        out[V.ragged(off[:-1][order], size + 1)] = closed_count
        return off, out


class Words:
    """Words of a chunk of texts: hashes, rows and the chunk's lower-cased bytes; texts that are not plain are left to the library."""

    def __init__(self, data: np.ndarray, off: np.ndarray, specials: list[str]):
        n = len(off) - 1
        cp = V.code_points(data)
        # code-point offsets: a byte that does not continue a sequence begins a code point
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        self.off = lead[off]
        if len(cp) != lead[-1]:  # broken UTF-8
            self.plain = np.zeros(n, bool)
            self.cp, self.off = np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        else:
            bad = cp >= SAFE
            bad |= ODD[np.where(bad, 0, cp)]
            odd = np.flatnonzero(bad)
            self.plain = np.ones(n, bool)
            self.plain[V.row_of(self.off, odd)] = False
            if (data == 60).any():
                text = data.tobytes()
                for s in specials:
                    key, p = s.encode(), -1
                    while (p := text.find(key, p + 1)) >= 0:
                        self.plain[V.row_of(off, np.array([p]))] = False
            self.cp = LOWER[np.where(bad, 32, cp)]
        self.start, self.end, self.row = split_words(self.cp, self.off)
        keep = self.plain[self.row]
        if not keep.all():
            self.start, self.end, self.row = self.start[keep], self.end[keep], self.row[keep]
        self.hash = V.span_hash(V.prefix_hash(UNIT[self.cp]), self.start, self.end) if len(self.start) else np.empty(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word hashes, one occurrence of each, and each word's number among them."""
        return np.unique(self.hash, return_index=True, return_inverse=True)

    def utf8(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the chosen words, with starts and ends."""
        s, e = self.start[which], self.end[which]
        if not len(s):
            return np.zeros(0, np.uint8), s, e
        cp = self.cp[V.ragged(s, e - s)].astype(np.int64)
        wide = cp >= 0x80
        size = np.where(wide, 2, 1)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint8)
        out[at] = np.where(wide, 0xC0 | cp >> 6, cp)
        out[at[wide] + 1] = 0x80 | cp[wide] & 0x3F
        ends_cp = np.cumsum(e - s)
        total = np.append(at, len(out))
        ends = total[ends_cp]
        return out, np.append(0, ends[:-1]).astype(np.int64), ends.astype(np.int64)
