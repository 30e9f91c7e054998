import random

import corpus_pipeline as cp
from lodestar.llm import suffix_dedup

from . import brute


def word(rng):
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: [word(rng) for _ in range(n)]
    passage, leak = " ".join(words(70)), words(40)
    texts = [" ".join(words(rng.randint(20, 120))) for _ in range(40)]
    clean = dict(enumerate(texts))
    rows = dict(clean)
    rows[100] = None
    rows[101] = "123 --- $$$"
    rows[102] = texts[3]
    near = texts[5].split()
    near[2] = "changed"
    rows[103] = " ".join(near) if len(near) > 60 else texts[5]
    rows[104] = " ".join([*words(10), passage, *words(10)])
    rows[105] = " ".join([*words(12), passage, *words(9)])
    rows[106] = " ".join([*words(8), *leak[5:25], *words(8)])
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, "a b"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, after = docs, {}
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns or set(now.columns) == set(docs.columns)
        rows_now = now.collect()
        after[name] = {r.doc_id: r.text for r in rows_now}
        now = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows_now], docs.schema)
    assert set(after["language_id"]) == set(rows) - {100, 101}
    comp = brute.components({k: t for k, t in rows.items() if k not in (100, 101)})
    assert set(after["ngram_jaccard_join"]) == {k for k, (_, c) in comp.items() if c == k}
    assert 102 not in after["ngram_jaccard_join"]
    cut = after["suffix_array_dedup"]
    assert passage not in cut[104] and passage not in cut[105] and all(cut[k] == t for k, t in clean.items() if k in cut)
    assert set(after["benchmark_decontamination"]) == set(cut) - {106}
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(after["benchmark_decontamination"])
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_short_benchmark_items_count(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["x red fox jumps, then a slow green turtle y", "only a red fox jumps here", "one two three four five six seven eight nine", "nothing of it", "red fox jumps red fox jumps"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    items = [(1, "Red fox jumps"), (2, "slow green turtle"), (3, "two three four five six seven eight nine ten"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in cp.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {1, 3, 4}


def test_repeated_passages_of_short_words(spark, tmp_path):
    rng = random.Random(6)
    short = lambda n: " ".join("".join(rng.choice("bcdfgl") for _ in range(rng.choice((2, 3)))) for _ in range(n))
    over, under = short(51), short(50)
    assert len(over) < suffix_dedup.SAMPLE
    texts = [f"{short(9)} é {over} {short(5)}", f"{over}\n{short(7)}", f"{short(4)} {under} {short(6)}", f"{short(8)} {under} {short(3)}", "", None, short(51)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.remove_repeated_strings(spark, docs, str(tmp_path)).collect()}
    want = {i: t if i > 1 else t.replace(over, "") for i, t in enumerate(texts)}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
