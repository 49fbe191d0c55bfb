import json

from pyspark.sql import functions as F

from claimweave.operators import extract as E
from claimweave.sources import payload as P, platforms as PL, reviews as RV, store as ST, web as WB


def col(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_html_text_and_entities(spark):
    html = "<style>p{}</style><p>价格&nbsp;&#51;0元 &lt;b&gt; &#128512; &#99999999;</p><!-- x --><div>二</div><script>1</script>"
    assert col(spark, html, WB.html_text) == "价格 30元 <b> \U0001F600 &#99999999;\n 二"
    assert col(spark, "<TITLE a=1> 名&amp;字 </TITLE>", WB.html_title) == "名&字"


def test_thin_page_salvage(spark):
    html = '<meta name="description" content="about it"><p>short</p>'
    assert col(spark, html, WB.page_text) == "about it\nshort"


def test_resolve_url(spark):
    base = "https://a.example/x/y?q=1#f"
    want = {"/n": "https://a.example/n", "n": "https://a.example/x/n", "../n": "https://a.example/n", "//b.example/n": "https://b.example/n",
            "http://c.example/": "http://c.example/", "?p=2": "https://a.example/x/y?p=2", "#z": "https://a.example/x/y?q=1#z", "./n": "https://a.example/x/n"}
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", WB.resolve_url(F.lit(base), F.col("h")).alias("u"))
    assert {r.h: r.u for r in df.collect()} == want


def test_page_links_budget_and_seen(spark):
    html = "".join(f'<a href="/news/{i}">x</a>' for i in range(9)) + '<a href="https://other.example/news/1">y</a><a href="/about">z</a>'
    pages = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
    assert WB.page_links(pages).count() == 9 and WB.page_links(pages, per_page=6).count() == 6
    seen = spark.createDataFrame([("https://a.example/news/0",)], "canonical_url string")
    assert WB.page_links(pages, per_page=6, seen=seen).count() == 5


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private # c\nAllow: /private/ok\nDisallow: /*.pdf$\n\nUser-agent: other\nDisallow: /"
    rules = WB.robots_rules(spark.createDataFrame([("a.example", body)], "host string, body string"))
    urls = ["https://a.example/private/x", "https://a.example/private/ok/1", "https://a.example/d.pdf", "https://a.example/d.pdf?x", "https://b.example/"]
    got = {r.url: r.verdict for r in WB.robots_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == ["disallowed", "allowed", "disallowed", "allowed", "unknown"]


def test_nested_payloads(spark):
    payload = json.dumps({"data": {"data": {"items": [{"note": {"id": "n1"}}, {"note": {"id": "n2"}}]}}, "note": 1})
    df = spark.createDataFrame([(payload,), ("{bad",)], "p string")
    got = df.select(P.objects_with_key(F.col("p"), "note").alias("o"), P.array_with_key(F.col("p"), "note").alias("a")).collect()
    assert [len(got[0].o), len(got[0].a)] == [3, 2] and json.loads(got[0].o[1]) == {"note": {"id": "n1"}}
    assert got[1].o == [] and got[1].a is None


def test_json_ld(spark):
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"name":"N","aggregateRating":{"ratingValue":"8.1","ratingCount":12}}]}</script>'
    row = P.rating_record(P.json_ld_rating(spark.createDataFrame([(1, html)], "page_id long, html string"))).first()
    assert row.text == "游戏名称: N\nTapTap评分: 8.1/10（12个评分）"


def test_store_lookup_to_facts(spark, tmp_path):
    app = {"trackId": 7, "trackName": "星", "sellerName": "米", "primaryGenreName": "角色扮演/冒险", "version": "1.2", "averageUserRating": 4.26, "userRatingCount": 9, "formattedPrice": "30 元"}
    (tmp_path / "a.json").write_text("\n\n" + json.dumps({"resultCount": 1, "results": [app]}, ensure_ascii=False))
    docs = ST.app_documents(ST.read_lookups(spark, str(tmp_path)).withColumn("k", F.lit(1)), ["k"]).withColumn("name", F.lit("星"))
    facts = E.qualify_store(E.metadata_facts(docs, ["k", "country"]))
    got = {r.predicate: r for r in facts.collect()}
    assert set(got) == {"developer", "genre", "current_version", "appstore_rating", "price"}
    assert got["price"].number == 30 and got["price"].claim_text == "《星》的价格为 30 元（CN 区）" and got["developer"].quote == "开发商/发行商: 米"
    ents = {(r.entity_type, r.canonical_name) for r in E.fact_entities(facts, ["k"]).collect()}
    assert ents == {("company", "米"), ("term", "角色扮演"), ("term", "冒险")}


def test_labels_are_sought_once_a_text(spark):
    """One search a text, one parse a payload; the first line of a label counts, and a blank value is no fact."""
    text = "开发商:  甲 \n开发商/发行商: 乙\n发行商: 丙\n价格: 30 {s} 元\n类型:   \n主分类: 丁\nApp Store(CN) 平均评分: 4.20 (9 个评分)"
    docs = spark.createDataFrame([(1, "星", text), (2, None, "价格: x"), (3, "空", None), (4, "空", "")], "k int, name string, text string")
    facts = E.metadata_facts(docs, ["k"])
    got = {(r.k, r.predicate): (r.value, r.number, r.claim_text, r.quote) for r in facts.collect()}
    assert got == {
        (1, "developer"): ("甲", None, "《星》的开发商/发行商是 甲", "开发商:  甲"), (1, "publisher"): ("丙", None, "《星》的发行商是 丙", "发行商: 丙"),
        (1, "price"): ("30", 30.0, "《星》的价格为 30 {s} 元", "价格: 30 {s} 元"), (1, "appstore_rating"): ("4.20", 4.2, "《星》App Store(CN) 平均评分为 4.20 (9 个评分)", "App Store(CN) 平均评分: 4.20 (9 个评分)"),
        (2, "price"): ("x", None, None, "价格: x"),
    }
    few = E.metadata_facts(docs, ["k"], predicates=["price", "publisher"])
    assert {r.predicate for r in few.collect()} == {"price", "publisher"}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?m)") == 1
    parsed = ST.parse_lookups(spark.createDataFrame([("{}",)], "p string"), "p", [])
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_review_json_aliases(spark):
    rows = [json.dumps(r, ensure_ascii=False) for r in [
        {"content": "非常好玩的游戏", "score": 5, "author": "甲", "upVotes": 3}, {"text": "一般般吧还可以", "rating": 3, "user": "乙", "like_count": 1, "id": "r2"}, {"body": "短"}]]
    got = RV.review_json(spark.createDataFrame([(r,) for r in rows], "p string"), "p", []).orderBy("score").collect()
    assert [(r.content, r.score, r.author, r.up_votes, r.review_id) for r in got] == [("一般般吧还可以", 3.0, "乙", 1, "r2"), ("非常好玩的游戏", 5.0, "甲", 3, None)]


def test_review_markdown(spark):
    md = "★★★★★ 作者: 小明 2024-01-02\n画面很好，剧情也不错\n点赞: 12\n\n---\n\n评分：2/5\n用户：小红\n2023年4月5日\n太肝了，日常太多"
    got = RV.review_markdown(spark.createDataFrame([(1, md)], "k int, md string"), "md", ["k"]).orderBy("block_pos").collect()
    assert [(r.content.split("\n")[-1], r.score, r.author, r.published_at, r.up_votes) for r in got] == [
        ("画面很好，剧情也不错", 5, "小明", "2024-01-02T00:00:00Z", 12), ("太肝了，日常太多", 2, "小红", "2023-04-05T00:00:00Z", None)]
    numbered = "1. 第一条评论内容\n2. 第二条评论内容"
    assert RV.review_markdown(spark.createDataFrame([(1, numbered)], "k int, md string"), "md", ["k"]).count() == 2


def test_name_match(spark):
    rows = [("p", "原 神", 1, "Other", 1, 1), ("p", "原 神", 1, "原神 - 冒险", 2, 2), ("p", "x", 2, "x", 1, 3), ("q", "zz", 1, "First", 1, 4), ("q", "zz", 1, "Second", 2, 5)]
    df = spark.createDataFrame(rows, "k string, term string, term_order int, name string, position int, item_id int")
    assert {r.k: r.item_id for r in ST.name_match(df, ["k"]).collect()} == {"p": 2, "q": 4}


def test_creatives(spark):
    items = [{"id": 1, "hookType": "悬念", "analysis": "用一个反常识的开头把人留住，再给出玩法。"}, {"id": 1, "analysis": "dup"}, {"id": 2}, {"link": "u", "transcript": "x"}]
    df = spark.createDataFrame([("p", json.dumps({"materials": items}, ensure_ascii=False))], "project_id string, payload string")
    got = PL.creative_rows(df, "payload").orderBy("creative_key").collect()
    assert [r.creative_key for r in got] == ["1", "u"]
    assert got[0].text == "钩子类型：悬念\n\n=== 创意拆解 ===\n用一个反常识的开头把人留住，再给出玩法。"
    ins = E.creative_insight(PL.creative_rows(df, "payload").withColumn("name", F.lit("星")), ["creative_key"]).collect()
    assert {r.creative_key: r.quote for r in ins} == {"1": "用一个反常识的开头把人留住，再给出玩法"}


def test_creatives_of_one_project_are_dealt_over_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        item = F.to_json(F.struct(F.array(F.struct(F.col("id"), F.lit("red line").alias("analysis"))).alias("items")))
        payloads = spark.range(400).select(F.when(F.col("id") > 0, "p").otherwise("q").alias("project_id"), item.alias("payload"))
        made = PL.creative_rows(payloads, "payload", spark.createDataFrame([("p", ["red"]), ("q", ["line"])], "project_id string, terms array<string>"))
        tasks = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 400 and max(tasks) < 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_creatives_of_any_length_and_without_a_project(spark, monkeypatch):
    """A parser's limit on strings, or a variant's on size, must not take a payload away."""
    item = F.struct(F.col("id"), F.concat(F.lit("red "), F.repeat(F.lit("x"), F.col("n"))).alias("analysis"))
    sizes = spark.createDataFrame([(1, 5, "p"), (2, 21_000_000, "p"), (3, 5, None)], "id long, n int, project_id string")
    payloads = sizes.select("project_id", F.to_json(F.struct(F.array(item, F.lit(None), item).alias("items"))).alias("payload"))
    terms = spark.createDataFrame([("p", ["red"]), (None, ["RED"])], "project_id string, terms array<string>")
    want = [("1", "p", 5), ("2", "p", 21_000_000), ("3", None, 5)]
    for large in (PL.LARGE_PAYLOAD, 30_000_000, 0):  # whole payloads, by objects where large, always by objects
        monkeypatch.setattr(PL, "LARGE_PAYLOAD", large)
        got = PL.creative_rows(payloads, "payload", terms).select("creative_key", "project_id", (F.length("text") - F.length(F.lit("\n=== 创意拆解 ===\nred "))).alias("n"))
        assert sorted(map(tuple, got.collect())) == want


def test_raw_payload_sink(spark, tmp_path):
    path = str(tmp_path / "snaps")
    df = spark.createDataFrame([(1, "p", "t", '{"a":1}'), (2, "q", "u", "{bad")], "snapshot_id long, project_id string, text string, raw_json string")
    ST.write_snapshots(df, path)
    back = spark.read.parquet(path).select("snapshot_id", "project_id", F.try_variant_get("raw", "$.a", "int").alias("a"))
    assert {tuple(r) for r in back.collect()} == {(1, "p", 1), (2, "q", None)}


def test_chinese_aspects(spark):
    texts = ["太肝了，每天都要上线", "日常任务太繁琐了！肝度高", "真的很肝。画面很美", "画面超美", "优化差，卡顿"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project_id string, id int, text string")
    got = E.aspect_opinions(df, ["project_id"]).collect()
    assert [(r.aspect, r.sentiment, r.n_holding, r.n_discussing, r.prevalence) for r in got] == [("grind", "negative", 3, 5, 0.6)]


def test_opinions_count_without_mention_rows(spark):
    """Reviews are counted where they lie: no mention becomes a row and no total is joined."""
    rows = [("p", "too slow"), ("p", "slow and good"), ("p", None), ("p", "good"), ("q", "slow"), (None, "slow"), (None, "slow")]
    lexicon = [("pace", "gameplay", r"good", r"slow", "liked", "too slow"), ("none", "gameplay", r"good", None, "", "")]
    out = E.aspect_opinions(spark.createDataFrame(rows, "k string, text string"), ["k"], lexicon, 2)
    got = sorted((r.k, r.aspect, r.sentiment, r.claim_text, r.n_holding, r.n_discussing) for r in out.collect())
    assert got == [("p", "pace", "negative", "too slow", 2, 4), ("p", "pace", "positive", "liked", 2, 4)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
