import random

from pyspark.sql import functions as F

from claimweave.operators import conflicts as C, merge as M, pack as K, reads as RD, roles as R, search as J


def test_ad_roles(spark):
    rows = [("竞品《甲》太肝", "ammo"), ("竞品《甲》还可以", None), ("星不如其他游戏太肝的那款", "landmine"), ("其他游戏太氪", "ammo"), ("优化差", "landmine")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", R.ad_role(F.col("t"), F.lit("星"), F.lit("negative")).alias("r"))
    assert {x.t: x.r for x in df.collect()} == dict(rows)
    odd = spark.createDataFrame([("a.b(不如",)], "n string").select(R.ad_role(F.concat("n", F.lit("不如")), F.col("n"), F.lit("negative")).alias("r"))
    assert odd.first().r == "landmine"
    assert spark.range(1).select(R.ad_role(F.lit("x"), F.lit("y"), F.lit("positive")).alias("r")).first().r is None


ANGLE = "claim_id long, project_id string, claim_type string, topic string, text string, confidence_band string, review_state string, sentiment string, ad_role string, has_value boolean, merged_into long"


def angle(i, kind, text, role=None, mood=None, band="likely", state="auto_accepted", topic="other", value=False):
    return (i, "p", kind, topic, text, band, state, mood, role, value, None)


def test_angles_respect_the_gate(spark):
    rows = [
        angle(1, "player_opinion", "竞品《甲》太肝", "ammo", "negative", "uncertain", "pending"),
        angle(2, "player_opinion", "竞品《乙》太氪", "ammo", "negative"),
        angle(3, "player_opinion", "本作氪金压力大", "landmine", "negative"),
        angle(4, "official_fact", "《星》的品类为 角色扮演、动作"),
        angle(5, "official_fact", "发行/上架日期为 2020", value=True),
        angle(6, "player_opinion", "音乐好听", None, "positive", "verified"),
        angle(7, "player_opinion", "剧情好", None, "positive", "likely", "rejected"),
    ]
    got = {(r.dimension, r.tactic): r for r in R.selling_angles(spark.createDataFrame(rows, ANGLE)).collect()}
    assert set(got) == {("grind", "competitor_position"), ("brand", "fact_amplify"), ("timeliness", "timely_hook"), ("music", "opinion_endorse")}
    assert got[("grind", "competitor_position")].strength == "medium" and got[("brand", "fact_amplify")].hooks == ["角色扮演", "动作"]
    assert got[("music", "opinion_endorse")].hooks == ["玩家都说配乐封神", "玩家都说听觉享受"]


def test_value_conflicts_count_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, "p", rnd.choice("xyz"), str(rnd.randrange(4)), rnd.choice([None, "1.0", "2.0"])) for i in range(120)]
    df = spark.createDataFrame(rows, "claim_id long, project_id string, predicate string, value string, version_min string")
    want = {}
    for a in rows:
        foes = [b[0] for b in rows if b[2] == a[2] and b[3] != a[3] and not (a[4] and b[4] and a[4] != b[4])]
        if foes:
            want[a[0]] = (len(foes), min(foes))
    assert {r.claim_id: (r.n_opponents, r.opponent) for r in C.value_conflicts(df).collect()} == want


def test_versions_compare_as_numbers(spark):
    rows = [(1, "p", "price", "90", "9.0"), (2, "p", "price", "80", "10.0"), (3, "p", "price", "70", "10.1"), (4, "p", "age", "12", "1.0"), (5, "p", "age", "12", "2.0")]
    df = spark.createDataFrame(rows, "claim_id long, project_id string, predicate string, value string, version_min string")
    assert {r.claim_id: r.superseded_by for r in C.version_chain(df).collect()} == {1: 2, 2: 3}
    assert {r.claim_id: r.superseded_by for r in C.version_chain(df, numeric=False).collect()} == {2: 3, 3: 1}


def test_pack_fill_equals_the_plain_loop(spark):
    rnd = random.Random(8)
    rows = [(1 + i % 2, 800 if i % 2 else 1500, i, rnd.choice(["facts", "opinions", "insights"]), rnd.randrange(5, 160), rnd.randrange(1000) / 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, budget long, claim_id long, section string, cost long, rank_score double")
    for req in (1, 2):
        items = sorted((r for r in rows if r[0] == req), key=lambda r: (-r[5], r[2]))
        budget, used, spent, taken, left = items[0][1], 4, {}, [], []
        for r in items:
            s = spent.get(r[3], 0)
            if used + r[4] > budget or s + r[4] > budget * K.QUOTA[r[3]]:
                left.append(r)
                continue
            taken.append(r[2])
            spent[r[3]] = s + r[4]
            used += r[4]
        for r in left:
            if used + r[4] <= budget:
                taken.append(r[2])
                used += r[4]
        got = K.pack_fill(df.filter(F.col("request_id") == req)).orderBy("pack_pos").collect()
        assert [r.claim_id for r in got] == taken and got[0].tokens_used == used


def test_merge_and_history(spark):
    edges = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (2, 11, "c")], "claim_id long, evidence_id long, stance string")
    merged = spark.createDataFrame([(2, 1)], "claim_id long, canonical_id long")
    assert {tuple(r) for r in M.repoint_edges(edges, merged).collect()} == {(1, 10, "a"), (1, 11, "c")}
    f = spark.createDataFrame([("d", f"2026-01-0{i}", str(i), t) for i, t in enumerate(["A", "A ", "B", "A"], 1)], "document_id string, d string, fetch_id string, text string")
    f = f.withColumn("fetched_at", F.col("d").cast("timestamp"))
    assert {r.fetch_id for r in M.snapshot_changes(f).collect()} == {"1", "3", "4"}
    log = M.revision_log(spark.createDataFrame([(1, "x"), (2, "y")], "claim_id long, s string"), spark.createDataFrame([(1, "x"), (2, "z")], "claim_id long, s string"), ["s"], "a", "rescore")
    assert [(r.claim_id, r.before_json, r.after_json) for r in log.collect()] == [(2, '{"s":"y"}', '{"s":"z"}')]


def test_access_and_keys(spark):
    keys = spark.createDataFrame([("k", ["p"]), ("all", ["*"])], "key_id string, project_ids array<string>")
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    wanted = spark.createDataFrame([("k", "p"), ("k", "q"), ("all", "q"), ("all", "gone")], "key_id string, project_id string")
    assert {tuple(r) for r in RD.allowed_pairs(keys, projects, wanted).select("key_id", "project_id").collect()} == {("k", "p"), ("all", "q")}


def test_answer_marks(spark):
    df = spark.createDataFrame([("见 [C3] 与 [C9] 及 [C1][C3]", 5), ("没有", 5)], "answer string, n_offered int")
    got = J.answer_citations(df).collect()
    assert (got[0].answer, got[0].cited, got[0].insufficient) == ("见 [C1] 与 [C9] 及 [C2][C1]", [3, 1], False)
    assert got[1].insufficient


def test_search_finds_han_and_isolated_projects(spark):
    claims = spark.createDataFrame(
        [(1, "p", "首月卡售价三十元", "approved", "normal", None), (2, "q", "首月卡售价六十元", "approved", "normal", None), (3, "p", "音乐好听", "pending", "normal", None)],
        "claim_id long, project_id string, text string, review_state string, rank string, merged_into long",
    ).withColumns({"confidence": F.lit(0.8), "updated_at": F.lit("2026-01-01").cast("timestamp"), "claim_type": F.lit("official_fact"), "confidence_band": F.lit("likely"), "topic": F.lit("x")})
    ev = spark.createDataFrame([(10, "p", "官网写着月卡三十元")], "evidence_id long, project_id string, quote string")
    links = spark.createDataFrame([(1, 10)], "claim_id long, evidence_id long")
    queries = spark.createDataFrame([(1, "月卡售价", "p"), (2, "月卡售价", None), (3, "音乐", None)], "query_id long, query string, project_id string")
    got = {}
    for r in J.search(claims, ev, links, queries, "2026-02-01").collect():
        got.setdefault(r.query_id, []).append((r.claim_id, r.matched_via))
    assert [c for c, _ in got[1]] == [1] and {c for c, _ in got[2]} == {1, 2} and 3 not in got
    assert got[1][0][1] == ["evidence", "keyword", "substring"]
