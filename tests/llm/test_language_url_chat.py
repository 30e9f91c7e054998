import math
import re
from collections import Counter

import numpy as np

from lodestar.llm import chat_format, language_id, url_filter
from pyspark.sql import functions as F


def speech(seed, n):
    rng = np.random.default_rng(seed)
    words = {"aa": "the and with from which there house tree running".split(), "bb": "der und mit von welche dort haus baum laufend".split(), "cc": "ла бис то мис кано ропе вира".split()}
    return [(i, " ".join(rng.choice(words[k], rng.integers(1, 40))), k) for i, k in enumerate(rng.choice(list(words), n))]


def test_language_held_out(spark):
    rows = speech(1, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 300"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if i >= 300]) > 0.97
    assert language_id.predict(spark.createDataFrame([(1, "\u0301 \u0308\u0300 12")], "doc_id long, text string"), model).collect()[0].lang_pred == "und"
    clash = spark.createDataFrame([(1, "der und", "x", 0.5, "y")], "doc_id long, text string, lang_pred string, score double, lang string")
    assert [tuple(r) for r in language_id.predict(clash, model).select("doc_id", "lang_pred").collect()] == [(1, "bb")]
    odd = [(1, None), (2, ""), (3, "12 §§"), (4, "treehouses"), (5, "x" * 20000), (5, "x" * 20000), (None, "бис")]
    out = language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in out[:4]] == ["und", "und", "und", "aa"] and out[6].lang_pred == "cc" and len(out) == 7
    assert all(0 <= r.score <= 1 for r in out)


def test_language_backs_off_to_shorter_ngrams(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("abcdefgh", "p"), ("zzzz yyyy", "q")] * 3)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    out = language_id.predict(spark.createDataFrame([(1, "abcdxx"), (2, "h"), (3, "yy"), (4, "ü")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in out] == ["p", "p", "q", "p"]


def plain_model(rows):
    """{lang: [counts of words, of letters, of 2-grams, ...]}"""
    out = {}
    for text, lang in rows:
        tables = out.setdefault(lang, [Counter() for _ in range(language_id.LONGEST + 1)])
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            tables[0][w] += 1
            tables[1].update(w)
            for n in range(2, language_id.LONGEST + 1):
                tables[n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    return out


def plain_language(text, model):
    """(language, score) by the definition: known words first, then the longest n-grams of which any is known."""
    langs = sorted(model)
    logs = []
    for n in range(language_id.LONGEST + 1):
        value = {k: {x: math.log10(c / sum(model[k][n].values())) for x, c in model[k][n].items()} for k in langs}
        low = min((v for t in value.values() for v in t.values()), default=0) - language_id.MISSING
        logs.append((value, low, {x for t in value.values() for x in t}))
    means = []
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        own = [0.0] * len(langs)
        for n in [0, *range(language_id.LONGEST, 0, -1)]:
            value, low, known = logs[n]
            pieces = [w] if n == 0 else list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
            hit = [x for x in pieces if x in known]
            if hit:
                own = [sum(value[k].get(x, low) for x in hit) / len(hit) for k in langs]
                break
        means.append(own)
    if not means:
        return "und", 0.0
    mean = [sum(m[j] for m in means) / len(means) for j in range(len(langs))]
    best = max(range(len(langs)), key=lambda j: mean[j])
    return langs[best], 1 / sum(10 ** ((m - mean[best]) * min(20, len(means))) for m in mean)


def test_language_matches_a_plain_version(spark):
    train = speech(5, 60)
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    plain = plain_model([(t, k) for _, t, k in train])
    rng = np.random.default_rng(9)
    texts = [None, "", "12", "house", "Haus treehouse", "зала ЛА", "qqqq", *(t for _, t, _ in speech(6, 20))]
    texts += ["".join(rng.choice(list("etahbui rsл"), 30)) for _ in range(30)]
    for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        lang, score = plain_language(texts[r.doc_id], plain)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, texts[r.doc_id]


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert language_id.predict(df, language_id.fit(df)).collect()[0].lang_pred == "und"
    assert language_id.predict(df.limit(0), language_id.fit(df)).count() == 0


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *rule


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.ORG", "http://A.ORG/", "https://x.example.org/es/1?q", "https://example.org/en/12#t", "https://notexample.org/es/", "http://a.com/fr/x", "http://a.com/de/", "http://É.com/fr/", "http://h/a://b/c", "https://cheappills.example.net/en/9", "https://library.example.net/books", "https://user@host.net:80/p", "\nhttp://n.net/x\ny"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge(df).collect():
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    got = {urls[r.page_id]: r for r in url_filter.judge(df).collect()}
    assert got["https://cheappills.example.net/en/9"].verdict == "block" and got["https://cheappills.example.net/en/9"].words[:2] == ["cheap", "pills"]
    assert got["https://library.example.net/books"].verdict == "allow" and got[None].verdict == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_segmenter_matches_brute_force():
    seg = url_filter.Segmenter({"free": 5, "bets": 5, "be": 3, "ts": 2, "freeb": 1})

    def all_splits(s):
        return [[s[:i], *r] for i in range(1, len(s) + 1) for r in ([[]] if i == len(s) else all_splits(s[i:]))]

    for name in ("freebets", "betsfree", "xfree", "tsbe"):
        assert sum(map(seg.score, seg.split(name))) >= max(sum(map(seg.score, s)) for s in all_splits(name)) - 1e-9


TEXTS = ["hi", None, "", "</s>[INST] ok [/INST]", "\\</s>", "a\\\\[INST]", "\\", "ends with \\", "<|image_0|> and <s><s>", "[/INST]</s><s>user [INST] x", "é" * 5000]


def test_chat_round_trip(spark):
    rows = [(c, k, ["user", "assistant", "system", None, "</s>"][(c + k) % 5], TEXTS[(c * 3 + k) % len(TEXTS)], 9) for c in range(12) for k in range(c % 6 + 1)]
    rows += [(1, 0, "user", "hi", 9), (None, 0, "assistant", "alone", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    out = chat_format.format_chat(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()
    assert len(out) == 13
    for r in out:
        want = sorted((k, role or "", t or "") for c, k, role, t, _ in rows if c == r.conv)
        assert [(t.role, t.text) for t in r.turns] == [w[1:] for w in want]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        said = [w[2] for w in want if w[1] == "assistant"]
        back = spark.createDataFrame([(s,) for s in spans], "s string").select(chat_format.unescape(F.col("s")).alias("u")).collect() if spans else []
        assert [b.u for b in back] == said
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_typed_parts(spark):
    df = spark.sql("""SELECT 1L AS conv, 0L AS turn, 'user' AS role, array(named_struct('kind', 'text', 'text', 'see ', 'ref', cast(null AS string), 'tokens', cast(null AS bigint)),
      named_struct('kind', 'image', 'text', null, 'ref', 'a.png', 'tokens', 10L), named_struct('kind', 'text', 'text', '<|image_0|>', 'ref', null, 'tokens', null)) AS parts
      UNION ALL SELECT 1L, 1L, 'assistant', array(named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'tokens', null), named_struct('kind', 'text', 'text', ' ok', 'ref', null, 'tokens', null))""")
    r = chat_format.format_chat(df, "conv", "turn", "role", F.col("parts")).collect()[0]
    assert r.formatted == "<s>user [INST] see <|image_0|>\\<|image_0|> [/INST]</s><s>assistant [INST] <|audio_1|> ok [/INST]</s>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 10), ("audio", "b.wav", 750)] and r.attachment_tokens == 760




def test_naive_bayes_learns_from_ruled_urls(spark):
    rng = np.random.default_rng(7)
    bad, good, noise = ["melon", "quartz"], ["cedar", "lantern"], ["river", "stone", "cloud"]
    hosts = lambda own, k: "".join(rng.permutation([own[k % 2], str(rng.choice(noise))]))
    urls = [f"http://{w}{k}.org/{w}" for k in range(4) for w in (*bad, *good, *noise)]
    urls += [f"http://{hosts(bad, k)}.example.org/es/{k}" for k in range(60)] + [f"http://{hosts(good, k)}.org/en/{k}" for k in range(60)]
    held = [(f"http://{hosts(bad, k)}.net/p", "block") for k in range(20)] + [(f"http://{hosts(good, k)}.net/p", "allow") for k in range(20)]
    long = "q" * 3000
    urls += [u for u, _ in held] + [f"http://{long}.net/", "http://melonmelon.net/", "http://melonmelon.net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge(df).collect()}
    assert np.mean([got[u].verdict == v for u, v in held]) > 0.9
    assert got["http://melonmelon.net/"].words[:2] == ["melon", "melon"] and got[f"http://{long}.net/"].words[0] == long
    counts = {v: {} for v in ("block", "allow")}
    silent = {w for h, p, _ in url_filter.RULES for w in url_filter.words_of(f"{h} {p}")}
    known = {w for r in got.values() for w in r.words if w in (*bad, *good, *noise)}
    for u in urls:
        r = got[u]
        if r.rule:
            for w in r.words:
                if w in known and w not in silent:
                    counts[r.verdict][w] = counts[r.verdict].get(w, 0) + 1
    for v, seeds in (("block", url_filter.BLOCK), ("allow", url_filter.ALLOW)):
        each = max(1.0, url_filter.SEED_SHARE * sum(counts[v].values()) / len(seeds))
        for w in seeds:
            counts[v][w] = counts[v].get(w, 0) + each
    vocab = {*counts["block"], *counts["allow"]}
    p = lambda v, w: (counts[v].get(w, 0) + 0.2) / (sum(counts[v].values()) + 0.2 * len(vocab))
    for r in got.values():
        odds = 3 / 7 * np.prod([p("block", w) / p("allow", w) for w in r.words if w in vocab])
        assert abs(r.block_probability - odds / (1 + odds)) < 1e-9
    assert len({round(p("block", w) / p("allow", w), 6) for w in vocab}) > 4
