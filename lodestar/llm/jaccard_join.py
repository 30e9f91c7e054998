"""Operator 6, n-gram Jaccard join: a grouped prefix join over word shingles.

A text's words are the runs of anything but ASCII white space, A-Z lower-cased; its set holds the distinct shingles of ``width`` words
(fewer words: the whole sequence is the one shingle; none: the empty set, linked with nothing).  Two texts link when
``100 * intersection >= percent * union``.

1. One scan hashes all shingles (64 bits) and ships every set's *lead*, its smallest hashes: the prefix filter in hash order, made longer by LEAD
   per cent of the set, so that linked sets share not one but LEAD per cent of it.  Shingles travel in packed messages, one for each (task chunk,
   range of hashes); texts of a chunk with equal sets travel once, and so does a shingle that many texts of a chunk share.  Classes of equal
   sets whose leads meet too few shared shingles link with nothing and leave; a text that shares a passage only is among them.
2. A second scan ships all shingles of the classes left, which a broadcast bitmap picks before anything leaves the JVM.  Shingles of one class
   only are dropped, the others go back to their classes with their class counts.  All of an intersection lies in these *shared* shingles,
   and a text's other shingles come first in the order of the prefix filter (rarest first), so a text whose other shingles fill its
   prefix leaves too.
3. Prefix filter in the global order (class count, hash): a linked pair shares a shingle among the first n - ceil(t n) + 1 of each.
4. Texts with identical prefix and size form one group; group pairs are filtered by size and joined on prefix shingles, then expanded to
   members and verified on all shared shingles.  A bucket of a frequent shingle is not expanded into all pairs: its members are first
   verified against one pivot, which links most of them; members outside the bucket's largest component then meet further pivots of it,
   and what is still outside meets all members of other components that pass the positional filter.  No unverified pair that may link
   crosses two components at the end, so components are exact; a pair inside one component is already connected.

Only counts reach the driver.  Defined cases: null or blank texts have ``n_shingles`` 0 and are their own component; repeated rows of
one id are one document, linked through any of them, with a result row each; a null id keeps its row and links nothing; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V
from .bitmap import marked
from .components import connected_components

WIDTH, PERCENT = 5, 75
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
TOKENS_PER_MESSAGE = 1_500_000
DOCS_PER_RANGE, SETS_PER_RANGE, LEAST_RANGES = 8000, 5000, 16
#: Per cent of a set that a lead holds beyond the plain prefix; the key of no class.
LEAD, NOBODY = 10, 0
PIVOT_ROUNDS = 5
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a chunk."""
    n = len(off) - 1
    s, e = V.runs(~SPACE[data], off)
    if not len(s):
        return [np.empty(0, np.uint64)] * n
    h = V.span_hash(V.prefix_hash(V.BYTE_UNIT[V.LOWER[data]]), s, e)
    words = np.searchsorted(s, off)  # words before each text
    total = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        total[: len(h) - k] += V.mix(h[k:] ^ V.mix(np.array([k + 1], np.uint64))) * _STEP[k % 8]
    total = V.mix(total)
    out = []
    for k in range(n):
        a, b = int(words[k]), int(words[k + 1])
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            out.append(V.mix(V.mix(h[a:b] + place * _STEP[7]).sum(dtype=np.uint64, keepdims=True) + _STEP[6]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(x: np.ndarray) -> int:
    """A 64-bit key of a set of hashes (0 for the empty set)."""
    if not len(x):
        return 0
    y = V.mix(x + np.uint64(0x5851F42D4C957F2D))
    both = np.array([y.sum(dtype=np.uint64), np.bitwise_xor.reduce(y)]) + np.array([len(x), 1], np.uint64)
    return int(V.mix(V.mix(both) * _STEP[0]).sum(dtype=np.uint64).astype(np.int64)) or 1


def lead_size(n: int, percent: int) -> int:
    """How many of its smallest hashes a set of n sends: linked sets share ``lead_hits`` of them (a prefix filter in hash order, for more than
    one common element)."""
    return n - -(-percent * n // 100) + -(-LEAD * n // 100)


def lead_hits(n: Column, percent: int) -> Column:
    """A partner of a set of n has at least percent % of n elements, and both leads hold the LEAD % of the smaller set's first common ones."""
    return F.ceil(F.lit(LEAD) * F.ceil(n * percent / F.lit(100.0)) / F.lit(100.0))


def messages(df: DataFrame, ranges: int, width: int, percent: int | None = None) -> DataFrame:
    """One scan of (doc, t): the packed shingles by hash range; ``range`` says where a row travels.

    With ``percent`` a row (doc, n, key) for each text goes along, and only leads are sent: a shingle that several classes of one chunk share is
    sent once, without an owner, and counted here (``hits`` for each class), so a frequent one costs a row for each chunk at most."""
    lead = percent is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            keys = np.array(list(kept), np.int64)
            flat = np.concatenate(list(kept.values()))
            owner = np.repeat(np.arange(len(keys)), [len(v) for v in kept.values()])
            if lead:
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                same = flat[1:] == flat[:-1]
                shared = np.append(False, same) | np.append(same, False)
                hits = np.bincount(owner[shared], minlength=len(keys))
                own = np.flatnonzero(hits)
                if len(own):
                    yield rows(len(own), key=keys[own], hits=hits[own], range=own % ranges)
                owner[shared] = len(keys)
                keys = np.append(keys, NOBODY)
                first = np.append(True, ~same)
                flat, owner = flat[first], owner[first]
            to = ((V.mix(flat) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            by = np.lexsort((owner, to))
            flat, owner, to = flat[by], owner[by], to[by]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            last = np.append(first[1:], len(to))
            packed: dict[str, list] = {"tokens": [], "owner": [], "keys": []}
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                own, local = np.unique(owner[a:b], return_inverse=True)
                packed["tokens"].append(flat[a:b].tobytes())
                packed["owner"].append(np.diff(local, prepend=0).astype(np.uint16).tobytes() if len(own) < 65536 else local.astype(np.uint32).tobytes())
                packed["keys"].append(keys[own].tobytes())
            yield rows(len(first), range=to[first], **packed)

        for b in V.trimmed(batches):
            ids = b.column(0)
            for r0, r1, data, off in V.chunks(V.binary(b.column(1))):
                sets = shingles(data, off, width)
                of = [set_key(x) for x in sets]
                if lead:
                    yield rows(r1 - r0, doc=ids.slice(r0, r1 - r0), n=[len(x) for x in sets], key=of, range=[k % ranges for k in of])
                for known, key, x in zip(ids.slice(r0, r1 - r0).is_valid().to_pylist(), of, sets, strict=True):
                    if len(x) and known and key not in kept:
                        kept[key] = x[: lead_size(len(x), percent)].copy() if lead else x
                        waiting += len(kept[key])
                if waiting > TOKENS_PER_MESSAGE:
                    yield from flush()
                    kept, waiting = {}, 0
                    V.trim()
        yield from flush()

    return df.mapInArrow(run, "doc long, n long, key long, hits long, range int, tokens binary, owner binary, keys binary")


MESSAGE = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("hits", pa.int64()), ("range", pa.int32()), ("tokens", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary())])


def rows(size: int, /, **columns: object) -> pa.RecordBatch:
    """A batch of messages; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in MESSAGE], schema=MESSAGE)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, class key) of the messages of one range."""
    tok, key = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b in table.filter(pa.compute.is_valid(table["tokens"])).to_batches():
        x = {f: b.column(f) for f in ("tokens", "owner", "keys")}
        for k in range(b.num_rows):
            t = np.frombuffer(x["tokens"][k].as_buffer(), np.uint64)
            own = x["owner"][k].as_buffer()
            local = np.cumsum(np.frombuffer(own, np.uint16), dtype=np.uint16) if len(own) == 2 * len(t) else np.frombuffer(own, np.uint32)
            tok.append(t)
            key.append(np.frombuffer(x["keys"][k].as_buffer(), np.int64)[local])
    return np.concatenate(tok), np.concatenate(key)


def shared_of(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From one range's (shingle, class key): (key, order key) of the shingles that two or more classes hold (NOBODY stands for several)."""
    order = np.argsort(t, kind="stable")
    t = t[order]
    same = t[1:] == t[:-1]
    often = np.zeros(len(t), bool)
    often[1:] |= same
    often[:-1] |= same
    t, c = t[often], c[order[often]]
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c = t[new], c[new]  # one row for each shingle and class
    if not len(t):
        return c, t.astype(np.int64)
    at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    size = np.diff(np.append(at, len(t)))
    count = np.repeat(size, size)
    more = (count > 1) & (c != NOBODY)
    t, c, count = t[more], c[more], count[more]
    level = np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.uint64), np.uint64(31))
    t = (level << np.uint64(58) | t >> np.uint64(6)).astype(np.int64)
    order = np.argsort(c, kind="stable")
    return c[order], t[order]


def lead_rows(table: pa.Table) -> pa.Table:
    """One hash range of the leads: its documents' rows and chunk counts as they are, and the shared shingles of each class (``shared``)."""
    plain = table.filter(pa.compute.is_null(table["tokens"])).select(["doc", "n", "key", "hits"])
    c, _ = shared_of(*unpacked(table))
    key, shared = np.unique(c, return_counts=True)
    V.trim()
    none = pa.nulls(len(key), pa.int64())
    plain = plain.append_column("shared", pa.chunked_array([pa.nulls(len(plain), pa.int64())]))
    return pa.concat_tables([plain, pa.Table.from_arrays([none, none, pa.array(key), none, pa.array(shared, pa.int64())], names=plain.column_names)])


def range_rows(table: pa.Table) -> pa.Table:
    """One hash range: (key, tokens) of the shared shingles of each class."""
    c, t = shared_of(*unpacked(table))
    at = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(c)), pa.int32()), pa.array(t))
    V.trim()
    return pa.Table.from_arrays([pa.array(c[at]), lists], names=["key", "tokens"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link, by the sizes and shared shingles of both."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.expr(f"100 * common >= {percent} * (na + nb - common)")).select("a", "b")


def may_link(percent: int, x: tuple[str, str], y: tuple[str, str]) -> F.Column:
    """Size and positional filter of a pair that meets at a shingle: x and y name (set size, shared shingles from the meeting on).

    At the pair's first common shingle the rest of either side bounds the intersection; at later ones the bound is lower still, so a pair
    that may link passes at its first."""
    (nx, rx), (ny, ry) = x, y
    return F.expr(f"{100 + percent} * least({rx}, {ry}) >= {percent} * ({nx} + {ny})")


def linked_components(sets: DataFrame, percent: int, tables: scratch.Tables) -> DataFrame:
    """(node, root) over documents (doc, n, u, tokens) that may link; u: shingles that no other class has."""
    fit = F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 - u as int)")
    cand = sets.withColumn("tokens", F.sort_array("tokens")).withColumn("prefix", F.slice("tokens", F.lit(1), fit))
    cand = tables.save(cand, "candidates")
    grouped = cand.groupBy("n", "u", F.xxhash64("prefix").alias("pkey"), "prefix").agg(F.min("doc").alias("group"))
    at = grouped.select("group", "n", F.expr("n - u").alias("s"), F.posexplode("prefix").alias("i", "token"))
    groups = tables.save(at.select("group", "n", (F.col("s") - F.col("i")).alias("rest"), "token"), "group-tokens")
    members = tables.save(cand.select("doc", "n", "u", F.xxhash64("prefix").alias("pkey")).join(grouped.select("group", "n", "u", "pkey"), ["n", "u", "pkey"]).select("doc", "group"), "members")

    # inside a group: every member against the group's own document; between groups: every group of a bucket against a pivot of a size
    # that can link
    inside = members.where("doc <> `group`").select(F.col("group").alias("a"), F.col("doc").alias("b"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    pivot = groups.withColumn("band", band).groupBy("token", "band").agg(F.min(F.struct("group", "n", "rest")).alias("p"))
    first = groups.withColumn("band", F.explode(F.array(band, band - 1))).join(pivot, ["token", "band"]).where(F.col("group") != F.col("p.group"))
    first = first.where(may_link(percent, ("n", "rest"), ("p.n", "p.rest")))
    stars = first.select(F.least("group", "p.group").alias("a"), F.greatest("group", "p.group").alias("b"))
    tried = tables.save(inside.union(stars).distinct(), "tried")
    edges = tables.save(verify(tried, cand, percent), "links")
    comp = connected_components(edges, tables)
    docs = members.join(groups, "group").select("token", "doc", "n", "rest")

    def crossing(docs: DataFrame, comp: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components, with their component and the bucket's largest."""
        now = docs.select("token", "doc", "n", "rest").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        parts = now.groupBy("token", "root").agg(F.count("*").alias("c"))
        main = parts.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots"))
        return tables.save(now.join(main.where("roots > 1").select("token", F.col("m.root").alias("main")), "token"), "cross")

    for k in range(PIVOT_ROUNDS):
        # a further pivot of the largest component for the members outside it
        docs = crossing(docs, comp)
        pivot = docs.where("root = main").groupBy("token").agg(F.min_by(F.struct("doc", "n", "rest"), F.xxhash64("doc", F.lit(k))).alias("p"))
        pairs = docs.where("root <> main").join(pivot, "token").where(may_link(percent, ("n", "rest"), ("p.n", "p.rest")))
        pairs = pairs.select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()
        new = tables.save(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        links = tables.save(verify(new, cand, percent), "links")
        tried = tried.union(new)
        if not links.limit(1).count():
            break
        edges = edges.union(links)
        comp = connected_components(edges, tables)
    # the rest: every pair of a bucket that crosses components, at most one side in the bucket's largest
    docs = crossing(docs, comp)
    minor = docs.where("root <> main").select("token", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("restx"), F.col("root").alias("rx"))
    cross = minor.join(docs, "token").where(F.expr("rx <> root and (root = main or x < doc)") & may_link(percent, ("nx", "restx"), ("n", "rest")))
    cross = cross.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()
    more = tables.save(verify(cross.join(tried, ["a", "b"], "left_anti"), cand, percent), "links")
    if more.limit(1).count():
        comp = connected_components(edges.union(more), tables)
    return comp


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each document; ids are integers."""
    spark = df.sparkSession
    picked = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    sent = messages(picked, max(LEAST_RANGES, picked.count() // DOCS_PER_RANGE), width, percent).groupBy("range")
    scanned = scratch.persist_table(sent.applyInArrow(lead_rows, "doc long, n long, key long, hits long, shared long"), "leads")
    docs = scanned.where("n is not null").select("doc", "n", "key")
    classes = docs.where("n > 0 and doc is not null").groupBy("n", "key").agg(F.min("doc").alias("rep"))
    met = scanned.where("n is null").groupBy("key").agg((F.coalesce(F.sum("shared"), F.lit(0)) + F.coalesce(F.max("hits"), F.lit(0))).alias("met"))
    tables = scratch.Tables()
    kept = tables.save(classes.join(met, "key").where(F.col("met") >= lead_hits(F.col("n"), percent)).select("n", "key", "rep"), "survivors")
    del sent
    scratch.release(spark)
    count = kept.count()
    chosen = marked(picked, ["doc"], kept.select(F.col("rep").alias("doc")), count).where("_marked").drop("_marked")
    whole = messages(chosen, max(LEAST_RANGES, count // SETS_PER_RANGE), width).groupBy("range")
    shared = tables.save(whole.applyInArrow(range_rows, "key long, tokens array<long>"), "shingles")
    del whole
    joined = shared.groupBy("key").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    fits = F.expr(f"u < n - ceil({percent} * n / 100.0) + 1")
    sets = kept.join(joined, "key").withColumn("u", F.col("n") - F.size("tokens")).where(fits)
    comp = linked_components(sets.select(F.col("rep").alias("doc"), "n", "u", "tokens"), percent, tables)
    comp = scratch.persist_table(comp, "components")
    tables.drop()
    scratch.release(spark)
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n", "key", F.coalesce("root", "rep").alias("root"))
    full = docs.join(named, ["n", "key"], "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
    return full


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` at five words and a similarity of 0.75."""
    return jaccard_components(scratch.load(spark, sf_dir, "documents"))
