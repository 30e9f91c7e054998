import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import packing, token_counts

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", "   \n", "Hello world's we'll 'really ''s", "a" * 5000, "<|endoftext|> x", "日本語 text", "É Ñ ß 12½", "İstanbul", "same", "same", "don't 'tis", "tab\tand\x0bvt \x85 nbsp\xa0end", "ﬁ é"]


def n_tokens(t):
    return len(LIB.encode(t or "", add_special_tokens=False).ids)


def docs(spark, texts):
    rows = [(i, t, "s%d" % (i % 3) if i % 5 else None, "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string")


def test_counts_match_library(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, TEXTS), limit=3).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n_tokens(t), n_tokens(t) > 3), t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("'strevmlda éÉñß 12½.!-\n<|>endoftx")), max_size=30))
def test_every_prefix(text):
    v = token_counts.vocabulary(None)
    assert token_counts.prefix_counts_of(text, v).tolist() == [n_tokens(text[:i]) for i in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("'sreé ‘’—日本語қЖжΣσςİıＡ①२\u0301\u093f한글\u1100\u1161\t\u3000\x1c😀<|endoftext>")), max_size=25))
def test_every_prefix_of_any_script(text):
    v = token_counts.vocabulary(None)
    assert token_counts.prefix_counts_of(text, v).tolist() == [n_tokens(text[:i]) for i in range(len(text) + 1)]


def test_long_text_without_blanks():
    v, rng = token_counts.vocabulary(None), np.random.default_rng(3)
    text = "".join(map(chr, rng.choice(np.arange(0x4E00, 0x4E00 + 600), 20_000)))
    start = time.perf_counter()
    got = token_counts.prefix_counts_of(text, v)
    took = time.perf_counter() - start
    assert took < 20 and len(got) == 20_001  # encoding every prefix would take minutes
    assert all(got[i] == n_tokens(text[:i]) for i in (1, 2, 7, 300, 9_999, 20_000))


def test_truncate(spark):
    df = token_counts.truncate(token_counts.token_prefixes(docs(spark, TEXTS)), 4)
    for r in df.collect():
        t = TEXTS[r.doc_id] or ""
        best = max(i for i in range(len(t) + 1) if n_tokens(t[:i]) <= 4) if len(t) < 200 else len(r.truncated)
        assert r.truncated == t[:best]
        assert n_tokens(r.truncated) <= 4


def test_empty(spark):
    assert token_counts.token_counts(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("texts", [TEXTS, [f"word{i} of text " * (i % 90) for i in range(300)], ["x"]])
def test_pack_covers_every_id_once(spark, texts):
    rows = packing.pack(docs(spark, texts), window=64, quantum=16).toPandas()
    for i, t in enumerate(texts):
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == np.append(0, own.length.cumsum())[:-1].tolist() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    used = 0
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == np.append(0, g.length.cumsum())[:-1].tolist()
        n = int(g.length.sum())
        used += n
        assert n == 64 or (n < 64 and n & (n - 1) == 0)
    assert sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique())) and used == rows.length.sum()


def test_pack_keeps_proportions_in_every_window(spark):
    texts = ["alpha beta gamma delta " * 8 for _ in range(900)]
    df = spark.createDataFrame([(i, t, "big" if i % 3 else "small") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = packing.pack(df, window=512, quantum=32).toPandas()
    rows["small"] = rows.doc_id % 3 == 0
    full = rows.groupby("sequence_id").length.sum()
    share = rows[rows.small].groupby("sequence_id").length.sum() / 512
    assert (abs(share[full[full == 512].index] - 1 / 3) <= 33 / 512 + 1e-9).all()


def test_weights_hold_in_every_window_until_a_queue_is_empty(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma delta " * 8, "big" if i % 3 else "small") for i in range(900)], "doc_id long, text string, source string")
    rows = packing.pack(df, window=512, quantum=32, weights={"small": 2.0}).toPandas()
    small = rows[rows.doc_id % 3 == 0]
    share = small.groupby("sequence_id").length.sum().reindex(range(rows.sequence_id.max() + 1), fill_value=0) / 512
    last = int(small.sequence_id.max())
    assert last < 0.75 * share.index.max() and (abs(share[:last] - 1 / 2) <= 33 / 512 + 1e-9).all()
    drift = (share[:last] - 1 / 2).cumsum() * 512  # what a window lacks the next ones get: deficits never add up
    assert abs(drift).max() <= 2 * 32


def test_a_very_long_text_is_packed_whole(spark):
    df = spark.createDataFrame([(1, "one two three " * 60_000, "a"), (2, "x", "b")], "doc_id long, text string, source string")
    rows = packing.pack(df).toPandas()
    assert rows[rows.doc_id == 1].length.sum() == rows[rows.doc_id == 1].doc_tokens.iloc[0] == 180_001


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", None)], "doc_id long, text string, source string")
    assert packing.pack(df).toPandas().length.sum() == 4 + 4 + 2
