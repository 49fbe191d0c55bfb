"""Raw web pages to readable documents, links and crawl verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import SPACE, script_lang, trim_space

# Tags that end a line, and words that mark an update page.
BLOCK_TAGS = r"br|/p|/div|/li|/h[1-6]|/tr|/section|/article"
UPDATE_LINK = "news|notice|announce|公告|新闻|资讯|update|版本"
META_DESCRIPTION = r'(?i)<meta[^>]+(?:name="description"|property="og:(?:description|title)")[^>]+content="([^"]+)"'
THIN_PAGE = 120
THIN_IMPORT = 200


def _char(code: Column) -> Column:
    """Character of a code point given as digits; NULL outside Unicode."""
    n = code.try_cast("int")
    return F.when(n.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_numeric_entities(c: Column) -> Column:
    parts = F.split(c, r"&#\d+;")
    codes = F.regexp_extract_all(c, F.lit(r"&#(\d+);"), F.lit(1))

    def step(part: Column, i: Column) -> Column:
        code = F.get(codes, i - 1)
        shown = F.coalesce(_char(code), F.concat(F.lit("&#"), code, F.lit(";")))
        return F.when(i == 0, part).otherwise(F.concat(shown, part))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(parts, step), "")).otherwise(c)


def html_text(c: Column) -> Column:
    """Readable text of HTML: no scripts, styles or comments, block ends as line ends, entities decoded."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, f"(?i)<(?:{BLOCK_TAGS})[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    c = decode_numeric_entities(c)
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, f"\n[{SPACE}]*\n[{SPACE}]*\n+", "\n\n")
    return trim_space(c)


def html_title(c: Column, longest: int | None = 200) -> Column:
    title = html_text(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return title if longest is None else F.substring(title, 1, longest)


def page_text(html: Column) -> Column:
    """Page text with meta descriptions put in front where the visible text is thin."""
    text = html_text(html)
    meta = F.array_join(F.regexp_extract_all(html, F.lit(META_DESCRIPTION), F.lit(1)), "\n")
    return F.when((F.length(text) < THIN_PAGE) & (meta != ""), F.concat(meta, F.lit("\n"), text)).otherwise(text)


def canonical_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[#?].*$", ""), r"/$", "")


def host_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))


def owner_of(c: Column) -> Column:
    return F.regexp_replace(host_of(c), r"^www\.", "")


def imported_pages(pages: DataFrame) -> DataFrame:
    """Pages handed in by a user: those with less readable text than an import needs are dropped."""
    return page_documents(pages, THIN_IMPORT)


def page_documents(pages: DataFrame, min_chars: int = THIN_PAGE) -> DataFrame:
    """Pages (url, html) to documents; pages too thin to read are dropped, whole texts are kept."""
    out = pages.withColumn("text", page_text(F.col("html"))).filter(F.length("text") >= min_chars)
    title = html_title(F.col("html"))
    return out.select(
        *[c for c in pages.columns if c not in ("html", "text")],
        canonical_url(F.col("url")).alias("canonical_url"),
        F.when(title != "", title).otherwise(F.col("url")).alias("title"),
        "text",
        script_lang(F.col("text")).alias("lang"),
        owner_of(F.col("url")).alias("owner_key"),
        F.lit("official").alias("source_type"),
        F.lit(0.9).alias("authority_prior"),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page, with ``.`` and ``..`` segments folded."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    path = F.substring(plain, F.length(origin) + 1, F.length(plain))
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin, folder, href))
    )
    # fold "." and ".." segments of the path, however many there are
    head = F.regexp_extract(out, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    tail = F.regexp_extract(out, r"[?#].*$", 0)
    middle = F.substring(out, F.length(head) + 1, F.length(out) - F.length(head) - F.length(tail))
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == ".", kept).when((s == "..") & (F.size(kept) > 1), F.slice(kept, 1, F.size(kept) - 1)).when(s == "..", kept).otherwise(F.concat(kept, F.array(s)))
    folded = F.concat(head, F.array_join(F.aggregate(F.split(middle, "/", -1), none, step), "/"), tail)
    return F.when((head != "") & F.contains(middle, F.lit("/.")), folded).otherwise(out)


def page_links(pages: DataFrame, pattern: str = UPDATE_LINK, per_page: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Same-site links of each page that match a pattern, one hop, first occurrence first.

    ``per_page`` is the crawl budget per page (None keeps every link); ``seen`` holds canonical URLs
    already fetched.
    """
    hrefs = F.filter(
        F.regexp_extract_all(F.col("html"), F.lit(r"""href=["']([^"']+)["']"""), F.lit(1)),
        lambda h: h.rlike(f"(?i)(?:{pattern})"),
    )
    if per_page is not None:
        hrefs = F.slice(hrefs, 1, per_page)
    out = pages.select("page_id", "url", F.posexplode(hrefs).alias("link_pos", "href"))
    out = out.withColumn("target", resolve_url(F.col("url"), F.col("href")))
    out = out.filter(host_of(F.col("target")) == host_of(F.col("url")))
    out = out.withColumn("canonical_url", canonical_url(F.col("target")))
    if seen is not None:
        out = out.join(seen.select("canonical_url").distinct(), "canonical_url", "left_anti")
    firsts = out.groupBy("canonical_url").agg(F.min(F.struct("page_id", "link_pos", "url", "target")).alias("first"))
    return firsts.select("canonical_url", "first.page_id", F.col("first.url").alias("found_on"), "first.target")


def robots_rules(robots: DataFrame, agent: str = "") -> DataFrame:
    """(host, body) of robots files to the allow and disallow patterns that apply to us."""
    lines = F.transform(F.split("body", "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "#.*$", ""), "\r", "")))
    key = lambda s: F.lower(F.regexp_extract(s, r"^([A-Za-z-]+)\s*:\s*(.*)$", 1))
    val = lambda s: F.trim(F.regexp_extract(s, r"^([A-Za-z-]+)\s*:\s*(.*)$", 2))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("on"), none.alias("allow"), none.alias("disallow"))

    def fold(acc: Column, line: Column) -> Column:
        k, v = key(line), val(line)
        mine = (v == "*") | F.contains(F.lit(agent.lower()), F.lower(v))
        keep = lambda which: F.when(
            acc["on"] & (k == which) & (v != ""), F.array_append(acc[which], v)
        ).otherwise(acc[which])
        return F.struct(
            F.when(k == "user-agent", mine).otherwise(acc["on"]).alias("on"),
            keep("allow").alias("allow"),
            keep("disallow").alias("disallow"),
        )

    return robots.select("host", F.aggregate(lines, start, fold).alias("r")).select("host", "r.allow", "r.disallow")


def _robots_regex(p: Column) -> Column:
    escaped = F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1")
    body = F.replace(escaped, F.lit("*"), F.lit(".*"))
    anchored = body.endswith("\\$")
    return F.when(anchored, F.concat(F.lit("^"), F.regexp_replace(body, r"\\\$$", ""), F.lit("$"))).otherwise(
        F.concat(F.lit("^"), body)
    )


def robots_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """allowed / disallowed / unknown per URL; the longer matching pattern wins, ties allow."""
    rest = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))

    def longest(patterns: str) -> Column:
        hit = F.filter(F.col(patterns), lambda p: F.regexp_like(F.col("_path"), _robots_regex(p)))
        return F.coalesce(F.array_max(F.transform(hit, F.length)), F.lit(-1))

    j = urls.withColumn("_host", host_of(F.col("url"))).withColumn("_path", path)
    j = j.join(rules.withColumnRenamed("host", "_host"), "_host", "left")
    allow, disallow = longest("allow"), longest("disallow")
    verdict = (
        F.when(F.col("disallow").isNull(), "unknown").when(disallow == -1, "allowed").when(allow >= disallow, "allowed")
        .otherwise("disallowed")
    )
    return j.withColumn("verdict", verdict).drop("_host", "_path", "allow", "disallow")


def drop_disallowed(judged: DataFrame, strict: bool) -> DataFrame:
    return judged.filter(F.col("verdict") != "disallowed") if strict else judged


def app_id(pages: DataFrame, keys: Sequence[str], urls: str = "urls", hint: str = "hint", pattern: str = r"taptap\.(?:cn|io)/app/(\d+)") -> DataFrame:
    """App id of each project: the given hint, else the id in the first URL that matches."""
    ids = F.filter(F.transform(F.col(urls), lambda u: F.regexp_extract(u, pattern, 1)), lambda x: x != "")
    return pages.select(*keys, F.coalesce(F.col(hint), F.get(ids, F.lit(0))).alias("app_id"))
