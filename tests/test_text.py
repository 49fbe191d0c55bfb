import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimweave.functions import scores as SC, text as X
from claimweave.operators import grounding as G, ranking as R, similarity as N


def one(spark, text, *cols):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_normal_forms(spark):
    assert one(spark, "​ a\r\nb \t c\n\n\n\nd　", X.normalize_text) == ("a\nb c\n\nd",)
    assert one(spark, ' “Ａ”，b。 C ', X.match_normalize) == ("ａ,b.c",)
    assert one(spark, "价格abc 12元好", X.shingles)[0] == ["abc12", "价格", "格元", "元好"]
    assert one(spark, "好", X.shingles)[0] == ["好"]
    assert one(spark, "玩 好玩abc, DEF", X.search_terms)[0] == ["abc", "def", "好玩", "玩"]
    assert one(spark, "好玩abcde", X.estimate_tokens) == (4,)


def test_sentence_around_match(spark):
    text = "开头很长。我觉得太肝了，真的！然后呢"
    assert one(spark, text, lambda c: X.sentence_with(c, "太肝")) == ("我觉得太肝了，真的！",)


def test_scores(spark):
    row = spark.range(1).select(
        SC.wilson_lower(F.lit(70), F.lit(150)).alias("w"), SC.wilson_lower(F.lit(0), F.lit(0)).alias("z"),
        SC.round_half_up(F.lit(-0.8125)).alias("r"), SC.logit(F.lit(1.0)).alias("l"),
    ).first()
    assert abs(row.w - 0.3887) < 1e-3 and row.z == 0 and row.r == -0.812 and abs(row.l - 3.8918) < 1e-3


def test_grounding(spark):
    rows = [
        ("首月卡售价30元。玩家好评", "售价30元", True, "exact", 3, 8),
        ("首月卡 售价：\n30 元。", "售价:30元", True, "normalized", 4, 12),
        ("首月卡售价30元", "售价68元", False, "none", None, None),
        ("首月卡售价30元", "  ", False, "none", None, None),
        ("a b", "a  b", False, "none", None, None),
        ('He said “Big.Win*” twice', "said big.win* TWICE", True, "normalized", 3, 24),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(rows)], "i int, text string, quote string")
    got = [(r.ok, r.method, r.char_start, r.char_end) for r in G.locate(df).orderBy("i").collect()]
    assert got == [r[2:] for r in rows]
    flags = df.select("i", G.is_grounded(F.col("text"), F.col("quote")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in flags] == [r[2] for r in rows]


def sequential(texts, short=400, t=0.82, k=3):
    """The rule as stated, one item after the other."""
    import hashlib
    import re

    def toks(s):
        return re.findall("[a-z0-9]+", re.sub(r"\s+", "", s).lower())

    def sim(ts):
        v = [0] * 64
        for x in ts:
            h = int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
            for b in range(64):
                v[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if v[b] > 0)

    leaders, out = [], {}
    for i, s in texts:
        ts, h = set(toks(s)), sim(toks(s))
        for j, ots, oh, olen in leaders:
            if len(s) < short or olen < short:
                dup = (len(ts & ots) / len(ts | ots) if ts | ots else 1.0) >= t
            else:
                dup = bin(h ^ oh).count("1") <= k
            if dup:
                out[i] = j
                break
        else:
            leaders.append((i, ts, h, len(s)))
            out[i] = i
    return out


@pytest.mark.parametrize("seed,pivots", [(1, 2), (2, 32)])
def test_leader_clusters_match_the_sequential_rule(spark, seed, pivots):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text(n):
        return ",".join(rnd.choice(words) for _ in range(n))

    bases = [text(rnd.choice([6, 12, 40, 180, 300])) for _ in range(15)]
    rows = []
    for i in range(160):
        # a third of all rows are near copies of one text
        parts = (bases[0] if i % 3 == 0 else rnd.choice(bases)).split(",")
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        rows.append((i, ",".join(parts) if rnd.random() > 0.04 else rnd.choice(["!!", "?", "é" * 500])))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.cluster for r in N.leader_clusters(df, "id", "id", pivots=pivots).collect()}
    assert got == sequential(rows)


def test_leader_clusters_by_the_mixed_rule(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([6, 12, 40, 180, 300]))] for _ in range(15)]
    rows = []
    for i in range(160):
        parts = list(bases[0] if i % 3 == 0 else rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        rows.append((i, ",".join(parts) if rnd.random() > 0.04 else rnd.choice(["!!", "?", "é" * 500])))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.cluster for r in N.leader_clusters(df, "id", "id", short_text=N.SHORT_TEXT, pivots=2).collect()}
    assert got == sequential(rows)


def test_sets_that_only_share_a_rare_token_never_become_pairs(spark):
    rows = [(i, ",".join([f"rare{i % 20}", *(f"{'c' if i < 20 else 'd'}{j}" for j in range(9))])) for i in range(40)]
    reps = spark.createDataFrame(rows, "ord long, text string").withColumns({"grp": F.lit(0), "short": F.lit(True)})
    reps = reps.withColumn("tokens", F.array_distinct(N.hashed_shingles(F.col("text")))).withColumn("n_tok", F.size("tokens"))
    index = N._prefix_index(reps, 0.82)
    assert index.groupBy("bucket").count().filter("count = 2").count() == 20
    assert N._candidates(index, index, 0.82, 3).filter("a < 20 and b >= 20").count() == 0


def test_astroturf(spark):
    base = datetime(2026, 1, 1)
    rows = [("s", i, "这个游戏真的太好玩了强烈推荐" if i < 4 else f"第{i}条 完全不同的看法 {i * 7919}", base + timedelta(hours=i if i < 6 else 100 * i)) for i in range(10)]
    rows += [("t", 100 + i, f"few {i}", base) for i in range(3)]
    scan, suspects = N.astroturf(spark.createDataFrame(rows, "source string, id long, text string, ts timestamp"), "source", "id", "text", "ts", "id")
    got = {r.source: r for r in scan.collect()}
    assert set(got) == {"s"} and got["s"].dup_ratio == 0.4 and got["s"].burst_ratio == 0.6 and got["s"].batch_score == 1.0
    assert {r.id for r in suspects.collect()} == {0, 1, 2, 3}


def test_bucketed_order_helpers(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, None if rnd.random() < 0.05 else datetime(2026, 1, 1) + timedelta(hours=rnd.randrange(200)), f"v{rnd.randrange(3)}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v string")
    seq = {r.id: r.seq for r in R.sequence_numbers(df, ["k"], "ts", "id").collect()}
    prev = {r.id: r.previous for r in R.previous_row(df, ["k"], "ts", "id", "v").collect()}
    for k in "ab":
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1]) if r[2] else (False, 0, r[1]))
        for n, r in enumerate(ordered):
            assert seq[r[1]] == n + 1
            assert prev[r[1]] == (ordered[n - 1][3] if n else None)
