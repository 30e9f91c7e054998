import hashlib
import random
import re
from collections import Counter, defaultdict

from lodestar.llm import suffix_dedup as sd


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def rows(spark, texts, length, k):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, doc string, tid int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(df, length=length, k=k).collect()}
    return [got[i] for i in range(len(texts))]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    for length, k, shard, segment in ((24, 5, 3_000_000, 1 << 25), (12, 4, 200, 90)):
        monkeypatch.setattr(sd, "SHARD_BYTES", shard)
        monkeypatch.setattr(sd, "SEGMENT", segment)
        word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
        passage = " ".join(word() for _ in range(12))
        texts = [None, "", "short", "a" * 150, "a" * 11, "ab" * 60, "same text of some length, said twice here", "same text of some length, said twice here"]
        for _ in range(60):
            w = [word() for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                w.insert(rng.randrange(len(w)), passage)
            if rng.random() < 0.2:
                w += w[: len(w) // 2] + ["|"] + w[: len(w) // 2]
            texts.append(" ".join(w))
        assert rows(spark, texts, length, k) == brute(texts, length)


def test_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    assert sd.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    got = sd.suffix_dedup(spark.createDataFrame([(1, "x" * 10 + "abc"), (1, "x" * 10 + "abc"), (None, "abcabcabcabcabc"), (2, None)], schema), length=13, k=4).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 13), (1, 13), (2, 0)]


def test_hot_passage_is_not_sorted_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, most, sort = noise(60), 1500, sd.shard_groups
    texts = [noise(rng.randint(20, 60)) + passage + noise(rng.randint(20, 60)) for _ in range(80)]
    texts += [texts[0], texts[1][10:], noise(90), passage, "b" * 70, None]

    def bounded(table, *rest):
        assert sum(len(x) for x in table["bytes"].to_pylist()) <= most
        return sort(table, *rest)

    monkeypatch.setattr(sd, "SHARD_BYTES", 400)
    monkeypatch.setattr(sd, "MOST_BYTES", most, raising=False)
    monkeypatch.setattr(sd, "shard_groups", bounded)
    assert rows(spark, texts, 24, 6) == brute(texts, 24)


def brute_passages(texts, words, length):
    """(runs, bytes) of each text that other texts hold as strings of whole words, or as strings of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    holders, spans = defaultdict(set), []
    for d, b in enumerate(raw):
        w = [m.span() for m in re.finditer(rb"[^\x00-\x20]+", b)]
        own = [(w[i][0], w[i + words - 1][1], "w") for i in range(len(w) - words + 1) if w[i + words - 1][1] - w[i][0] < length]
        own += [(i, i + length, "b") for i in range(len(b) - length + 1)]
        spans.append(own)
        for x, y, kind in own:
            holders[kind, b[x:y]].add(d)
    out = []
    for b, own in zip(raw, spans, strict=True):
        gone = bytearray(len(b) + 1)
        for x, y, kind in own:
            if len(holders[kind, b[x:y]]) > 1:
                gone[x:y] = b"\1" * (y - x)
        out.append((sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), sum(gone)))
    return out


def test_passages_against_brute_force(spark, monkeypatch):
    for seed, words, length, near, shard, most in ((3, 4, 24, 12, 3_000_000, 1 << 30), (4, 5, 30, 14, 400, 1 << 30), (5, 4, 24, 12, 400, 700)):
        rng = random.Random(seed)
        monkeypatch.setattr(sd, "SAMPLE", near)
        monkeypatch.setattr(sd, "SHARD_BYTES", shard)
        monkeypatch.setattr(sd, "MOST_BYTES", most)
        word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))  # noqa: E731, B023
        passages = [" ".join(word() for _ in range(rng.randint(words, 9))) for _ in range(4)]
        texts = [None, "", "a " * 60, "a " * 50 + "b", " ".join(passages[0].split()[:words]), passages[0] + "x", "x" + passages[0], "\n" + passages[0] + "\t"]
        for _ in range(70):
            w = [word() for _ in range(rng.randint(1, 25))]
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w)), rng.choice(passages))
            if rng.random() < 0.2:
                w += w  # repeated inside one text only
            texts.append(" ".join(w))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in sd.suffix_dedup(df, length=length, k=5, words=words).collect()}
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute(texts, length)
        want = brute_passages(texts, words, length)
        assert [(got[i].n_passages, got[i].n_passage_bytes) for i in range(len(texts))] == want
        assert [got[i].shares_passage for i in range(len(texts))] == [n > 0 for n, _ in want]


def test_kept_texts(spark):
    texts = ["one two three four five six é seven", "zero one two three four five six é", None, "", "clean words only"]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, row boolean")
    got = {r.doc_id: r for r in sd.suffix_dedup(df, length=20, k=4, words=4, carry=["row"]).collect()}
    assert [got[i].kept for i in range(5)] == [" seven", "zero ", None, "", "clean words only"]
    assert [got[i].changed for i in range(5)] == [True, True, False, False, False] and got[0].row.row and not got[1].row.row
