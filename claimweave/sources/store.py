"""App-store records, name matching, manual documents and raw payloads beside cleaned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from claimweave.functions.text import SPACE
from claimweave.sources.web import host_of

_TEXT = (
    "trackName sellerName description releaseNotes version currentVersionReleaseDate releaseDate primaryGenreName "
    "formattedPrice contentAdvisoryRating minimumOsVersion trackViewUrl"
).split()
APP = StructType(
    [StructField("trackId", LongType())]
    + [StructField(n, StringType()) for n in _TEXT]
    + [
        StructField("genres", ArrayType(StringType())),
        StructField("languageCodesISO2A", ArrayType(StringType())),
        StructField("averageUserRating", DoubleType()),
        StructField("userRatingCount", LongType()),
    ]
)
LOOKUP = StructType([StructField("resultCount", LongType()), StructField("results", ArrayType(APP))])
# Authority of a hand-imported document by the type its importer names.
AUTHORITY_BY_TYPE = {"official": 0.9, "internal_doc": 0.8, "press": 0.7, "user_note": 0.6, "community": 0.4}


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Lookup responses as files, one row per app."""
    return spark.read.schema(LOOKUP).json(path, multiLine=True).select(F.explode("results").alias("app")).select("app.*")


def parse_lookups(payloads: DataFrame, column: str, keys: list[str]) -> DataFrame:
    parsed = payloads.select(*keys, F.from_json(column, LOOKUP).alias("r"))
    # an outer explode infers no filter, which would parse every payload once more; rows without results have no place
    apps = parsed.select(*keys, F.posexplode_outer("r.results").alias("_at", "app")).filter(F.col("_at").isNotNull())
    return apps.select(*keys, "app.*")


def app_text(country: str = "CN") -> Column:
    """Labelled metadata lines; absent fields leave no line."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    c = F.col
    rating = F.when(
        c("averageUserRating").isNotNull(),
        F.concat(
            F.format_string("%.2f", c("averageUserRating")), F.lit(" ("), F.coalesce("userRatingCount", F.lit(0)).cast("string"),
            F.lit(" 个评分)"),
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("应用名称: "), F.coalesce("trackName", F.lit(""))),
        F.concat(F.lit("开发商/发行商: "), F.coalesce("sellerName", F.lit(""))),
        line("主分类", c("primaryGenreName")),
        line("分类", F.array_join("genres", "、")),
        line("当前版本", c("version")),
        line("当前版本发布时间", c("currentVersionReleaseDate")),
        line("首次上架时间", c("releaseDate")),
        line(f"App Store({country}) 平均评分", rating),
        line("价格", c("formattedPrice")),
        line("年龄分级", c("contentAdvisoryRating")),
        line("最低系统要求", F.when(c("minimumOsVersion") != "", F.concat(F.lit("iOS "), "minimumOsVersion"))),
        line("支持语言", F.array_join("languageCodesISO2A", ", ")),
        F.lit("=== 应用描述 ==="),
        F.when(c("description") != "", c("description")),
        F.when(c("releaseNotes") != "", F.concat(F.lit("=== 最新版本更新说明 ===\n"), "releaseNotes")),
    )


def app_documents(apps: DataFrame, keys: list[str], country: str = "cn") -> DataFrame:
    return apps.select(
        *keys,
        F.concat(F.lit(f"itunes://{country}/app/"), F.col("trackId").cast("string")).alias("canonical_url"),
        F.concat(F.lit("appstore:"), F.col("sellerName")).alias("owner_key"),
        F.lit("store_metadata").alias("source_type"),
        F.lit("api_record").alias("doc_type"),
        F.lit(0.85).alias("authority_prior"),
        F.col("version").alias("version_tag"),
        F.col("currentVersionReleaseDate").alias("published_at"),
        F.lit(country).alias("country"),
        app_text(country.upper()).alias("text"),
    )


def name_match(results: DataFrame, keys: list[str]) -> DataFrame:
    """Best search result per key: rows (keys, term, term_order, name, position, item_id).

    Within a term the first result whose squeezed name contains, or is contained by, the term wins,
    else the first result; across terms the first term with any result wins.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(c), f"[{SPACE}]+", "")
    name, term = squeeze(F.col("name")), squeeze(F.col("term"))
    hit = F.contains(name, term) | F.contains(term, name)
    best = F.min(F.struct(F.col("term_order"), (~hit).alias("no_match"), F.col("position"), F.col("item_id"), F.col("name")))
    out = results.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, "b.item_id", "b.name", (~F.col("b.no_match")).alias("matched"))


def manual_documents(docs: DataFrame) -> DataFrame:
    """Authority and owner of hand-imported documents (source_type, platform and url may be NULL)."""
    kind = F.coalesce("source_type", F.lit("user_note"))
    prior = F.lit(None).cast("double")
    for name, value in AUTHORITY_BY_TYPE.items():
        prior = F.coalesce(prior, F.when(kind == name, value))
    platform = F.coalesce("platform", F.lit("internal"))
    owner = F.when(F.col("url").isNotNull(), host_of(F.col("url"))).otherwise(F.concat(F.lit("manual:"), platform))
    return docs.withColumns(
        {
            "source_type": kind,
            "authority_prior": F.coalesce(prior, F.lit(0.5)),
            "owner_key": owner,
            "platform": platform,
            "doc_type": F.lit("upload"),
        }
    )


def write_snapshots(snapshots: DataFrame, path: str, raw_column: str = "raw_json") -> None:
    """Append cleaned text with the raw payload beside it as a variant, one folder per project."""
    out = snapshots.withColumn("raw", F.try_parse_json(raw_column)).drop(raw_column)
    out.write.mode("append").partitionBy("project_id").parquet(path)
