import pytest
from pyspark.sql import functions as F

from lodestar.functions import html as H
from lodestar.functions import pages as P
from lodestar.operators import clean
from lodestar.operators import corpus as C
from lodestar.functions import text as T
from lodestar.streaming import ingest

PAGE = """<html><head><title>t</title><style>x{}</style></head><body><h1>林小雨 教授</h1><script>var a=1;</script>
<h3>研究方向</h3><p>机器翻译、信息抽取</p><h3>个人简介</h3><p>2001年任教。</p><p>邮箱 lin [at] h.edu &amp; 电话</p><h3>论文</h3><p>论文甲</p></body></html>"""


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_text_of_a_page(spark):
    got = frame(spark, PAGE).select(T.deobfuscate_email(H.html_to_text(F.col("t"))).alias("x"), H.html_title(F.col("t")).alias("title")).first()
    assert "var a" not in got.x and "x{}" not in got.x and "lin@h.edu & 电话" in got.x and got.title == "t"


def test_parsing(spark):
    pages = spark.createDataFrame([("http://h/1", PAGE), ("http://h/2", "")], "u string, h string")
    rows = {r.u: r for r in C.parse_pages(pages, F.col("u"), F.col("h"), F.lit("甲学院")).collect()}
    r = rows["http://h/1"]
    assert (r.name, r.title, r.research, r.papers, r.college) == ("林小雨", "教授", "机器翻译、信息抽取", "论文甲", "甲学院")
    assert r.profile.startswith("2001年任教。") and set(r.sections) == {"研究方向", "个人简介", "论文"} and r.is_teacher_page and len(r.doc_id) == 16
    assert rows["http://h/2"].page_reason == "too_short" and rows["http://h/2"].name == ""


def test_free_form_page():
    text = "吴山的个人主页\n职称：副教授\n院部/部门：乙学院\n研究兴趣：图论\n主页 a at b dot edu"
    assert (P.guess_name(text), P.guess_title(text), P.guess_college(text), P.labelled(text, ("研究兴趣",))) == ("吴山", "副教授", "乙学院", "图论")
    assert P.despell("x at y dot edu") == "x@y.edu" and P.guess_name("教授\n李四") == ""
    assert P.sections("论文\n甲\n乙\n# 论文：\n丙\n招生信息") == {"论文": "甲\n乙\n丙"}
    assert P.section("论文\n\n甲" + "长" * 30 + "\n乙", "论文", 10) == "甲" + "长" * 9


def test_classifier(spark):
    texts = {"个人简介 研究方向 " + "x" * 20: "chinese_teacher_signals", "a Professor's homepage, research and publications": "english_teacher_signals", "短": "too_short", "Service Temporarily Unavailable, please wait": "hard_negative:Service Temporarily Unavailable", "学院列表 教师分类查询 热点主页 最新更新 职称 个人简介": "navigation_or_listing_page", "数学科学学院 的 一位 副教授 某某某某某某某某某": "mixed_template_teacher_signals", "nothing of interest in this text": "weak_teacher_signals:positive=0,english=0,negative=0"}
    got = {r.t: r.c.reason for r in frame(spark, *texts).select("t", P.classify_page(F.col("t")).alias("c")).collect()}
    assert got == texts


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [
        ("研究方向：图论\n职称：教授\n更多内容。", "research", "图论教授更多内容。"),
        ("第一句。\n第二句\n版权所有 某校", "profile", "第一句。\n第二句"),
        ("1.\n甲项目\n2.\n乙项目", "research", "1. 甲项目；2. 乙项目"),
        ("H 指数 1\n. 5", "profile", "H 指数 1.5"),
        ("2010年3月\n- 2012年4月 任职", "profile", "2010年3月-2012年4月 任职"),
        ("专利", "papers", ""),
        ("", "papers", ""),
        ("甲\n甲\n120\n访问\n乙。", "profile", "甲乙。"),
        ("- 短一\n- 短二", "research", "- 短一；- 短二"),
        ("见\nhttps://a.b/c中文", "profile", "见\nhttps://a.b/c\n中文"),
        ("论文甲见\nhttps://a.b/c", "papers", "论文甲见 https://a.b/c"),
        ("论文甲见\nhttps://a.b/c", "research", "论文甲见\nhttps://a.b/c"),
        ("（\n2019\n）\n甲 A\nB\n。", "research", "（2019）甲 A B。"),
    ],
)
def test_field_values(text, field, want):
    assert clean.field_value(text, field) == want


def test_site_noise_is_skipped_and_a_footer_ends():
    line = "Copyright 某校 2019"
    assert clean.field_value(f"甲。\n{line}\n乙。", "profile", frozenset({line.lower()})) == "甲。\n乙。"
    assert clean.field_value(f"甲。\n{line}\n乙。", "profile") == "甲。"
    assert clean.lines("12\nEnglish\n访问\n甲\n7\n最新上线") == ["甲"]


def test_titles_are_no_part_of_a_name():
    assert P.guess_name("王 教授") == "王" and P.guess_name("王 小明") == "王小明" and P.guess_name("学院\n\n# 李四 博士") == "李四"
    assert P.guess_title("职务：讲师\n职称: 教授") == "教授" and P.guess_title("某讲师，副教授") == "副教授"


def test_content_and_menus():
    menu = "社会职务\n科研项目\n论文\n招生信息\n正文在此。\n论文\n列表。"
    assert clean.content_text(menu) == "正文在此。\n论文\n列表。"
    assert clean.repair_tokens("state-of\n-the art 20 19 Arxiv: 2001. 0 1234") == "state-of-the art 2019 Arxiv: 2001.01234"


def test_documents_are_cleaned_and_graded(spark):
    cols = "name string, college string, title string, research string, papers string, profile string, content string, url string, final_url string, page_reason string"
    dirty = "导航\n王五 副教授\n研究方向\n图论\n个人简介\n生平。\n版权所有"
    df = spark.createDataFrame([("王五", "甲学院", "", "", "", "", dirty, "", "http://h", "ok"), ("", "", "", "", "", "", "Join us at the Lab", "", "", "too_short"), (None,) * 10], cols)
    rows = clean.clean_documents(df).collect()
    assert (rows[0].title, rows[0].research, rows[0].profile, rows[0].url) == ("副教授", "图论", "生平。", "http://h")
    assert rows[0].content == "甲学院\n\n王五\n\n副教授\n\n个人简介\n生平。\n\n研究领域\n图论" and rows[0].clean_quality == "high" and rows[0].clean_flags == ["very_short_content"]
    assert rows[1].clean_quality == "low" and "lab_like_homepage" in rows[1].clean_flags and "weak_page_signal" in rows[1].clean_flags
    cleaned = clean.clean_documents(df)
    report = {(r.section, r["name"]): r.value for r in clean.clean_report(cleaned, drop_low=True).collect()}
    assert report[("summary", "input_docs")] == 3 and report[("summary", "dropped_docs")] == 2 and report[("quality", "high")] == 1
    kept, dropped = clean.split_low(cleaned)
    assert kept.count() == 1 and dropped.count() == 2


def test_build_documents_with_seeds(spark):
    key = lambda u: T.raw_key(F.lit(u))
    files = spark.createDataFrame([("r/甲/1", "甲", "http://h/1", PAGE), ("r/甲/2", "甲", "http://h/2", PAGE), ("r/乙/3", "乙", "http://h/1", PAGE)], "path string, folder string, u string, html string").withColumn("raw_key", T.raw_key(F.col("u"))).drop("u")
    seeds = spark.createDataFrame([("丙学院", "旧名", "http://h/1", 0), ("丙学院", "新名", "http://h/1", 1)], "college string, name string, url string, o int")
    docs, report = C.build_documents(files, C.last_seeds(seeds, ["o"]))
    rows = docs.collect()
    assert [(r.name, r.college, r.parsed_name) for r in rows] == [("新名", "乙", "林小雨"), ("林小雨", "甲", None)]
    assert {r.path: r.status for r in report.collect()} == {"r/乙/3": "saved", "r/甲/1": "skipped_duplicate", "r/甲/2": "saved"}
    assert {r["name"]: r.value for r in C.summarize(docs).collect()} == {"doc_count": 2, "college_count": 2, "甲": 1, "乙": 1}
    del key


def test_crawl(spark):
    store = spark.createDataFrame([("http://h.x/", '<a href="/a">a</a><a href="/b/">b</a>'), ("http://h.x/a", '<a href="/">up</a><a href="/c">c</a>'), ("http://h.x/b/", "")], "url string, html string")
    got = {r.url: (r.level, r.status) for r in C.crawl(spark.createDataFrame([("http://H.x",)], "url string"), store).collect()}
    assert got == {"http://h.x/": (0, "fetched"), "http://h.x/a": (1, "fetched"), "http://h.x/b/": (1, "fetched"), "http://h.x/c": (2, "fetch_error")}
    ledger = {r.url: r.status for r in C.crawl_ledger(spark.createDataFrame([("u1", PAGE, "fetched"), ("u2", PAGE, "fetched"), ("u3", None, "fetch_error"), ("u4", "no", "fetched")], "url string, html string, status string")).collect()}
    assert ledger == {"u1": "saved", "u2": "skipped_duplicate", "u3": "fetch_error", "u4": "skipped_nonteacher"}


def test_stream_ingest(spark, tmp_path):
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(1, "u", "<p>alpha beta</p>"), (2, "u", "<p>again</p>")], schema).write.parquet(f"{tmp_path}/in")
    q = ingest.ingest(ingest.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/documents").count() == 1 and spark.read.parquet(f"{tmp_path}/out/postings").count() >= 1
    spark.createDataFrame([(3, "u", "<p>known</p>"), (5, "v", "<p>b</p>"), (4, "v", "<p>a</p>")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(ingest.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.page_id, r.url) for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()) == [(1, "u"), (4, "v")]
