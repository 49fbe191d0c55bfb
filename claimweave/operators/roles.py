"""What an opinion means for advertising: material, warning, and the angles that stay open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import literal_pattern
from claimweave.operators.scoring import TRUSTED_STATES

# Word lists and labels.
RIVAL_DEFECT = (
    r"(竞品|其他游戏?|别的游戏?|隔壁|友商|同类作品|同类型游戏)[^。]{0,12}(太|很|过于|比较)?"
    r"(肝|氪|贵|烂|差|卡|坑|丑|无聊|繁琐|逼氪|抽卡|掉帧|卡顿|优化差)|比起.{0,8}不如|相比之下.{0,8}(不如|更好)"
)
SELF_DEFECT = r"(不如|比不上|落后|差于|弱于)"
AVOID = [
    (r"氪|付费(设计)?(激进|重|压力大)|逼氪|抽卡.*(贵|坑)|割韭菜", "零氪/不氪/良心付费/白嫖 类承诺"),
    (r"肝|重复度|日常.*(繁琐|太多)|体力.*(不够|恢复慢)", "轻松/护肝/不肝 类承诺"),
    (r"优化.*(差|烂)|卡顿|掉帧|发烫|闪退|崩溃|服务器.*(炸|卡|崩)", "丝滑/流畅/不卡 类承诺"),
    (r"内容(少|匮乏|太少)|玩法.*(单一|重复)|无聊", "内容丰富/玩法多样 类承诺"),
    (r"内部号|托|刷|外挂|破坏公平", "公平竞技/绿色环境 类承诺"),
    (r"剧情.*(差|烂|拖沓)|文案.*(差|烂)", "剧情精彩/文案优秀 类承诺"),
    (r"画面.*(差|糊)|画风.*(丑|不喜欢)", "画面精美/视觉震撼 类承诺"),
]
TOPIC_DIMENSION = {"monetization": "monetization", "gameplay": "content", "performance": "performance", "creative": "art", "product": "brand"}
TEXT_DIMENSION = [
    ("monetization", r"氪|付费|逼氪|抽卡|价格|白嫖|福利"),
    ("grind", r"肝|日常|体力|重复"),
    ("performance", r"优化|卡顿|掉帧|发烫|闪退|服务器|流畅"),
    ("content", r"内容|玩法|无聊|丰富|可玩"),
    ("fairness", r"内部号|托|公平|外挂"),
    ("art", r"画面|美术|画风|立绘|建模|场景|视觉"),
    ("story", r"剧情|故事|文案"),
    ("music", r"音乐|配乐|bgm|音效"),
    ("timeliness", r"版本|上线|更新|活动|发行|首发|日期"),
    ("brand", r"开发商|发行商|公司|大厂|IP"),
]
BLOCKED_BY = [
    ("monetization", r"氪|付费|逼氪"),
    ("grind", r"肝|日常|体力"),
    ("performance", r"优化|卡顿|掉帧|发烫|闪退|服务器"),
    ("content", r"内容|玩法|无聊"),
    ("fairness", r"内部号|托|公平|外挂"),
    ("art", r"画面|美术|画风|立绘"),
    ("story", r"剧情|文案"),
]
HOOKS = {
    "monetization": ["良心福利", "免费也能玩", "不逼氪"],
    "grind": ["轻松护肝", "碎片时间", "不肝不累"],
    "performance": ["丝滑流畅", "优化在线"],
    "content": ["内容丰富", "玩法多样"],
    "fairness": ["公平竞技", "绿色环境"],
    "art": ["画面惊艳", "视觉震撼"],
    "story": ["剧情上头", "故事动人"],
    "music": ["配乐封神", "听觉享受"],
    "brand": ["诚意之作"],
    "timeliness": ["不容错过"],
}
ANGLE = {
    "competitor_position": "竞品卡位:利用竞品在该维度的劣势",
    "pain_reverse": "行业痛点反转:把通病变成你的优势",
    "opinion_endorse": "口碑背书:用真实玩家好评做信任钩子",
    "timely_hook": "时效节点:用上线/版本时间制造稀缺与期待",
    "genre": "题材定位:用品类标签精准锚定人群",
    "maker": "品牌背书:用制作方建立信任",
    "free": "低门槛:免费游玩降低尝试成本",
}
FIXED_HOOKS = {"timely": ["即将上线", "新作首发", "版本更新"], "maker": ["知名厂商出品", "诚意之作"], "free": ["免费下载", "现在就玩"]}
ENDORSE_PREFIX, PLAIN_GENRE = "玩家都说", "热门题材"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ad_role(text: Column, project_name: Column, sentiment: Column) -> Column:
    """ammo for others' weaknesses, landmine for one's own, NULL for anything not negative.

    When in doubt a complaint counts as one's own.
    """
    rival = text.rlike(RIVAL_DEFECT)
    named = F.concat(F.lit("《?"), literal_pattern(project_name), F.lit(rf"》?\s*{SELF_DEFECT}"))
    own = (F.coalesce(project_name, F.lit("")) != "") & F.regexp_like(text, named)
    return F.when(
        sentiment == "negative",
        F.when(text.rlike("^竞品《.+》"), F.when(rival, "ammo"))
        .when(own, "landmine")
        .when(rival, "ammo")
        .otherwise("landmine"),
    )


def avoid_list(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(words)) for p, words in AVOID]))


def dimension_of(topic: Column, text: Column) -> Column:
    out = F.lit("brand")
    for name, pattern in reversed(TEXT_DIMENSION):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    for name, dim in TOPIC_DIMENSION.items():
        out = F.when(topic == name, F.lit(dim)).otherwise(out)
    return out


def blocked_dimensions(claims: DataFrame) -> DataFrame:
    """(project, dimension) pairs closed by the project's own weaknesses."""
    mines = claims.filter(F.col("ad_role") == "landmine")
    hit = F.array(*[F.when(F.col("text").rlike(p), F.lit(d)) for d, p in BLOCKED_BY])
    return mines.select("project_id", F.explode_outer(hit).alias("dimension")).filter(F.col("dimension").isNotNull()).distinct()


def hooks_for(dimension: Column, prefix: str = "") -> Column:
    out = F.array().cast("array<string>")
    for name, words in HOOKS.items():
        out = F.when(dimension == name, _words([prefix + w for w in words])).otherwise(out)
    return out


def genre_hooks(text: Column) -> Column:
    label = F.regexp_extract(text, r"品类为\s*(.+)$", 1)
    parts = F.filter(F.split(label, r"[、,，/\s]"), lambda s: F.length(s) >= 2)
    return F.when(label == "", _words([PLAIN_GENRE])).otherwise(parts)


def angle_candidates(claims: DataFrame, shown_chars: int = 30) -> DataFrame:
    """Every angle a claim can give, before the gate.

    ``claims``: claim_id, project_id, claim_type, topic, text, confidence_band, review_state,
    sentiment, ad_role, has_value. Trusted claims count; others' weaknesses count in any state.
    """
    c = claims.filter(F.col("merged_into").isNull()).withColumn("dim", dimension_of(F.col("topic"), F.col("text")))
    strong = F.col("confidence_band").isin("verified", "likely")
    trusted = strong & F.col("review_state").isin(TRUSTED_STATES)
    text, kind = F.col("text"), F.col("claim_type")
    shown = F.concat(F.substring(text, 1, shown_chars), F.lit("…"))

    def angle(dim: Column, tactic: Column, key: Column | str, hooks: Column, strength: Column, why: Column) -> Column:
        label = key if isinstance(key, Column) else F.lit(ANGLE[key])
        return F.struct(
            dim.alias("dimension"), tactic.alias("tactic"), label.alias("angle"), hooks.alias("hooks"), strength.alias("strength"), why.alias("rationale")
        )

    dim, lit = F.col("dim"), F.lit
    rival = text.rlike("竞品|其他游戏|隔壁|友商")
    ammo = F.when(
        F.col("ad_role") == "ammo",
        angle(
            dim, F.when(rival, "competitor_position").otherwise("pain_reverse"),
            F.when(rival, ANGLE["competitor_position"]).otherwise(ANGLE["pain_reverse"]), hooks_for(dim),
            F.when(strong, "high").otherwise("medium"), F.concat(lit("源自口碑「"), shown, lit("」")),
        ),
    )
    fact_why = F.concat(lit("源自事实「"), shown, lit("」"))
    fact = F.when(
        trusted & (kind == "official_fact"),
        F.when(
            text.rlike("发行|上架日期|上线") & F.col("has_value"),
            angle(lit("timeliness"), lit("timely_hook"), "timely_hook", _words(FIXED_HOOKS["timely"]), lit("high"), fact_why),
        )
        .when(text.rlike("品类|类型"), angle(dim, lit("fact_amplify"), "genre", genre_hooks(text), lit("medium"), fact_why))
        .when(text.rlike("开发商|发行商"), angle(lit("brand"), lit("fact_amplify"), "maker", _words(FIXED_HOOKS["maker"]), lit("low"), fact_why))
        .when(text.rlike("免费"), angle(lit("monetization"), lit("fact_amplify"), "free", _words(FIXED_HOOKS["free"]), lit("medium"), lit("源自价格事实"))),
    )
    praise = F.when(
        trusted & (kind == "player_opinion") & (F.col("sentiment") == "positive"),
        angle(
            dim, lit("opinion_endorse"), "opinion_endorse", hooks_for(dim, ENDORSE_PREFIX),
            F.when(F.col("confidence_band") == "verified", "high").otherwise("medium"),
            F.concat(lit("源自口碑「"), shown, lit("」("), F.col("confidence_band"), lit(")")),
        ),
    )
    out = c.select("project_id", "claim_id", F.explode_outer(F.array(ammo, fact, praise)).alias("a")).filter(F.col("a").isNotNull())
    return out.select("project_id", "claim_id", "a.*")


def strength_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def selling_angles(claims: DataFrame) -> DataFrame:
    """Gated angles, the strongest per project, dimension and tactic; ties go to the first claim."""
    free = angle_candidates(claims).join(blocked_dimensions(claims), ["project_id", "dimension"], "left_anti")
    order = F.struct(-strength_rank(F.col("strength")), F.col("claim_id"))
    best = free.groupBy("project_id", "dimension", "tactic").agg(
        F.min_by(F.struct("claim_id", "angle", "hooks", "strength", "rationale"), order).alias("b")
    )
    return best.select("project_id", "dimension", "tactic", "b.*")


def rebuild_angles(angles: DataFrame, path: str) -> None:
    """Replace the angle table of every project present in ``angles``; other projects stay as they are."""
    angles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
