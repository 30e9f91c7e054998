"""Operator 4, URL filters: host word segmentation and naive Bayes, behind host and path rules.

Host and path are cut from the url; the longest fitting rule decides.  Where none fits, names are split into words by the most likely
segmentation under a unigram model (Viterbi), and multinomial naive Bayes scores the words of host and path.

The unigram model counts words over all urls (a word has to occur in ``MIN_HOSTS`` hosts, so that a glued name is no word by itself, and in one of
``HOSTS_A_WORD`` at least, which bounds the model by a statistic and not by a cap) and adds the seed words.  Naive Bayes learns from all urls
that a rule judges, with the rule's verdict as label; the words of the rules themselves say nothing, and the seed words of both classes count
as much as SEED_SHARE of a class's words.

Defined cases: a null url or one without ``://`` has empty host and path and gets the verdict of an empty name (allow); repeated rows are
judged each; upper-case letters outside A-Z stay as they are; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MIN_HOSTS, HOSTS_A_WORD, SEED_SHARE, CACHE = 3, 1_000_000, 0.5, 200_000
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Seed words of both classes.
BLOCK = "ad ads adserver adult affiliate bet bets betting bitcoin bonus botnet camgirl casino cheap click clickbait crack cracked doubleclick drugs erotic escort farm fake free gambling giveaway hack hentai jackpot keygen loan loans lottery malware milf naked nude payday phishing pill pills pirate poker popup porn prize promo pron replica roulette scam sex sexy slots spam spyware tracker track tracking torrent viagra virus warez webcam win winner x xxx".split()
ALLOW = "about academy archive article articles art bank bible biology blog book books cafe church city classic college community cooking council course courses culture docs education encyclopedia english faq forum garden government guide health help history hospital house info institute journal language law learn library local magazine mail maths medical mobile museum music nature news office online open page park people photo physics poetry press public recipes report research review school science shop social software sports story student study support teacher tech theatre town travel university water weather wiki work world".split()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    host = ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_columns(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def words_of(name: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return re.findall(r"[^\W\d_]+", name.lower())


class Segmenter:
    """Most likely split of a name into words: unigram log probabilities, unseen words by length."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) + 1
        self.logp = {w: math.log(c / self.total) for w, c in counts.items()}
        self.longest = max(map(len, counts), default=1)

    def score(self, word: str) -> float:
        known = self.logp.get(word)
        return known if known is not None else math.log(10 / self.total) - 2.3 * len(word)

    def split(self, name: str) -> list[str]:
        """Viterbi over the end positions: known words, and unseen stretches of any length (the best begin of one is carried along)."""
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        begin, open_score = math.log(10 / self.total), -math.inf
        opened = 0
        for i in range(1, n + 1):
            if best[i - 1] + begin > open_score:
                open_score, opened = best[i - 1] + begin, i - 1
            open_score -= 2.3
            best[i], back[i] = open_score, opened
            for j in range(max(0, i - self.longest), i):
                known = self.logp.get(name[j:i])
                if known is not None and best[j] + known >= best[i]:
                    best[i], back[i] = best[j] + known, j
        out, i = [], n
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


class Bayes:
    """Multinomial naive Bayes of two classes over word counts; words that neither class has seen say nothing."""

    def __init__(self, block: dict[str, float], allow: dict[str, float], smoothing: float = 0.2):
        vocab = {*block, *allow}
        total = {id(c): sum(c.values()) + smoothing * len(vocab) for c in (block, allow)}
        p = lambda c, w: math.log((c.get(w, 0) + smoothing) / total[id(c)])
        self.odds = {w: p(block, w) - p(allow, w) for w in vocab}
        self.prior = math.log(0.3 / 0.7)

    def block_probability(self, words: list[str]) -> float:
        z = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def unigrams(urls: DataFrame) -> dict[str, int]:
    """Words with the number of hosts that use them, over all urls (columns host, path), and the seeds."""
    token = F.explode(F.array_distinct(F.split(F.lower(F.concat("host", F.lit(" "), "path")), r"[^\p{L}]+")))
    pairs = urls.select("host", token.alias("w")).where("w <> ''").distinct()
    least = max(MIN_HOSTS, urls.select("host").distinct().count() // HOSTS_A_WORD)
    counts = {r.w: r.c for r in pairs.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= least).collect()}
    floor = max(100, sum(counts.values()) // 500)
    for w in [*BLOCK, *ALLOW]:
        if len(w) > 1:
            counts[w] = max(counts.get(w, 0), floor)
    return counts


def split_names(names: list[str], segment: Segmenter, splits: dict[str, list[str]]) -> list[str]:
    """The words of all names, from a bounded memory of splits."""
    out = []
    for name in names:
        if name not in splits:
            if len(splits) > CACHE:
                splits.clear()
            splits[name] = segment.split(name)
        out += splits[name]
    return out


def class_counts(ruled: DataFrame, counts: Broadcast, rules: tuple) -> dict[str, dict[str, float]]:
    """Word counts of both classes over all urls that a rule judges (only words of the unigram model, so their number is bounded), and the seeds."""
    silent = {w for h, p, _ in rules for w in words_of(f"{h} {p}")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, splits = Segmenter(counts.value), {}
        for b in batches:
            seen: Counter = Counter()
            for host, path, verdict in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen.update((verdict, w) for w in split_names(words_of(f"{host} {path}"), segment, splits) if w in counts.value and w not in silent)
            yield pa.RecordBatch.from_pydict({"verdict": pa.array([v for v, _ in seen], pa.string()), "w": pa.array([w for _, w in seen], pa.string()), "c": pa.array(seen.values(), pa.int64())})

    got = ruled.where("ruled is not null").select("host", "path", "ruled").mapInArrow(run, "verdict string, w string, c long").groupBy("verdict", "w").agg(F.sum("c").alias("c")).collect()
    out = {}
    for verdict, seeds in (("block", BLOCK), ("allow", ALLOW)):
        own = {r.w: float(r.c) for r in got if r.verdict == verdict}
        each = max(1.0, SEED_SHARE * sum(own.values()) / len(seeds))
        out[verdict] = own | {w: own.get(w, 0.0) + each for w in seeds}
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, words, block_probability) of every url."""
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    counts = spark.sparkContext.broadcast(unigrams(parsed.select("host", "path")))  # bounded by HOSTS_A_WORD
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    learnt = class_counts(ruled, counts, rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, bayes, splits = Segmenter(counts.value), Bayes(learnt["block"], learnt["allow"]), {}
        for b in batches:
            tokens, probability, decided = [], [], []
            for host, path, ruled in zip(*(b.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                words = split_names([*words_of(host), *words_of(path)], segment, splits)
                p = bayes.block_probability(words)
                tokens.append(words)
                probability.append(p)
                decided.append(ruled or ("block" if p >= threshold else "allow"))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(decided, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(probability, pa.float64())], names=["id", "host", "path", "rule", "verdict", "words", "block_probability"])

    return ruled.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, words array<string>, block_probability double").withColumnRenamed("id", id_col)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages``."""
    return judge(scratch.load(spark, sf_dir, "pages"))
