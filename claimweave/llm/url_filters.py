"""Operator 9: judge pages by explicit rules, else by the reputation of their host (empirical Bayes).

A page's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z lower-cased),
its path what follows up to ``?``, ``#`` or the end. Of the rules that fit, the longest decides.

All other pages are judged by their host. Some pages have an outcome (bad or not). Hosts, registered
domains and suffixes form levels; at each level, the spread of the outcome rates around the level
above, beyond what chance explains, tells how much the units of that level have in common (the
concentration of a beta prior). A suffix shrinks to the overall rate, a domain to its suffix, a host to
its domain. A host is blocked if the lower bound of its posterior odds of being bad reaches
``block_odds`` times the overall odds, so what counts as bad follows the table. Public suffixes come
from a table, or from a rule for country codes; addresses are domains of their own.

Built from DataFrame functions only. A null url or one without ``://`` has an empty host and path, and
is a host of its own; null outcomes and labels of unknown pages don't count. Repeated pages are pages,
repeated labels of a document count once (bad if any is). Very long urls are read by two linear
patterns. Rules of equal length go by name. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.checkpoints import new_folder

#: Fixed values: (verdict, host, path) of the explicit rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Without a table of suffixes: country codes register domains under these second labels (com.sg, co.il, org.nz, ...).
SECOND_LABELS = "ac co com edu gob gov govt go gv id info ltd me mil ne net nom or org plc sch web".split()
LONG_SUFFIX = rf"(?:^|\.)((?:{'|'.join(SECOND_LABELS)})\.[a-z][a-z])$"
#: Hosts that are addresses: a domain of their own, under one suffix.
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"
ADDRESS_SUFFIX = "address"
#: A host is blocked if the lower bound of its odds of being bad is so many times the overall odds.
BLOCK_ODDS = 3.0
#: The bound's distance in standard deviations (one-sided 95 %).
DEVIATIONS = 1.645
#: Concentration where the units of a level can't tell one.
DEFAULT_CONCENTRATION = 10.0
LEAST_COMMON, MOST_COMMON = 0.001, 0.999


def located(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.col("url").cast("string")
    host = F.translate(F.regexp_extract(url, split, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url, split, 2), F.lit("")).alias("path"))


def rule_of(rules=None) -> tuple[Column, Column]:
    """The rule that decides and its verdict, as columns of host and path."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in reversed(rules):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds the registered domain and the suffix of each host (one row a host).

    ``suffixes``: rows (suffix) of public suffixes; the longest that a host ends in counts, else its last
    label. Without a table, SECOND_LABELS tell suffixes of two labels.
    """
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    last = F.substring_index(bare, ".", -1)
    rows = hosts.withColumn("_bare", bare)
    if suffixes is None:
        long = F.regexp_extract(bare, LONG_SUFFIX, 1)
        rows = rows.withColumn("suffix", F.when(long != "", long).otherwise(last))
    else:
        parts = F.split(bare, r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        known = suffixes.select(F.lower("suffix").alias("tail")).distinct()
        found = hosts.select("host", F.explode(tails).alias("tail")).join(known, "tail")
        found = found.groupBy("host").agg(F.max_by("tail", F.length("tail")).alias("_found"))
        rows = rows.join(found, "host", "left").withColumn("suffix", F.coalesce("_found", last)).drop("_found")
    address = F.col("_bare").rlike(ADDRESS)
    labels = F.size(F.split("suffix", r"\.")) + 1
    parts = F.split("_bare", r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")
    rows = rows.withColumn("domain", F.when(address, F.col("_bare")).otherwise(domain))
    return rows.withColumn("suffix", F.when(address, ADDRESS_SUFFIX).otherwise(F.col("suffix"))).drop("_bare")


def _concentration(units: DataFrame) -> DataFrame:
    """One row: the prior's concentration for units (n, bad) around the means of the level above (``above``)."""
    seen = units.filter("n > 0").withColumn("off", F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), 2) / (F.col("above") * (1 - F.col("above"))))
    sums = seen.agg(F.sum("off").alias("off"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    free, room = F.col("k") - 1, F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    common = F.greatest(F.least((F.col("off") - free) / room, F.lit(MOST_COMMON)), F.lit(LEAST_COMMON))
    return sums.select(F.when((F.col("k") > 1) & (room > 0), 1 / common - 1).otherwise(F.lit(DEFAULT_CONCENTRATION)).alias("strength"))


def _shrunk(units: DataFrame) -> DataFrame:
    """Adds each unit's posterior mean and the level's concentration."""
    strength = _concentration(units).first()[0]  # one number
    return units.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("bad") + strength * F.col("above")) / (F.col("n") + strength))


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """(host, n, bad, mean, bound, bar) from (host, bad): bad is 1, 0 or null (no outcome); a bound from the bar on blocks."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    folder = new_folder(outcomes.sparkSession, "hosts")
    _levels(counts, suffixes).select("host", "n", "bad", "suffix", "domain").write.parquet(folder)
    hosts = outcomes.sparkSession.read.schema("host string, n long, bad long, suffix string, domain string").parquet(folder)
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 1) / (n + 2)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("above", F.lit(overall))
    suffixes = _shrunk(suffixes).select("suffix", F.col("mean").alias("above"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = _shrunk(domains).select("suffix", "domain", F.col("mean").alias("above"))
    known = _shrunk(hosts.join(domains, ["suffix", "domain"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    bar = block_odds * overall / (1 - overall + block_odds * overall)
    return known.select("host", "n", "bad", "mean", (F.col("mean") - DEVIATIONS * spread).alias("bound"), F.lit(bar).alias("bar"))


def judge(pages: DataFrame, labels: DataFrame, suffixes: DataFrame | None = None, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound). A page's outcome is that of the document its path numbers: bad if toxic or of low quality."""
    placed = located(pages)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0).cast("long").alias("bad"))
    told = told.filter("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)")
    outcomes = placed.select("host", number.alias("doc_id")).join(told, "doc_id", "left")
    folder = new_folder(pages.sparkSession, "reputations")
    reputations(outcomes.select("host", "bad"), suffixes, block_odds).select("host", "bound", "bar").write.parquet(folder)
    known = pages.sparkSession.read.schema("host string, bound double, bar double").parquet(folder)
    rule, verdict = rule_of()
    by_host = F.when(F.col("bound") >= F.col("bar"), "block").otherwise("allow")
    return placed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bound")


def sql(block_odds: float = BLOCK_ODDS) -> str:
    """The same in DuckDB SQL, without the bound."""
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, say) for say, h, p in rules]
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + " end"
    bare = "regexp_replace(host, ':[0-9]*$', '')"

    address = f"regexp_matches({bare}, '{ADDRESS}')"
    long = f"regexp_extract({bare}, '{LONG_SUFFIX}', 1)"

    def tail(k: int) -> str:
        return f"array_to_string(list_slice(string_split({bare}, '.'), -{k}, -1), '.')"

    def strength(units: str) -> str:
        return f"""(select case when k > 1 and n - nn / n - (k - 1) > 0 then 1 / greatest(least((off - (k - 1)) / (n - nn / n - (k - 1)), {MOST_COMMON}), {LEAST_COMMON}) - 1 else {DEFAULT_CONCENTRATION} end
    from (select sum(n * power(bad / n - above, 2) / (above * (1 - above))) as off, count(*) as k, sum(n)::double as n, sum(n * n)::double as nn from {units} where n > 0))"""

    return f"""
with placed as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
told as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null and toxic is not null then 0 end) as bad from labels group by doc_id),
outcomes as (select host, bad from placed left join told on told.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)),
h0 as (select host, count(bad)::bigint as n, coalesce(sum(bad), 0)::bigint as bad from outcomes group by host),
hosts as (select *, case when {address} then '{ADDRESS_SUFFIX}' when {long} <> '' then {long} else {tail(1)} end as suffix,
    case when {address} then {bare} when {long} <> '' then {tail(3)} else {tail(2)} end as domain from h0),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, (select (sum(bad) + 1) / (sum(n) + 2) from hosts) as above from hosts group by suffix),
s1 as (select suffix, (bad + k * above) / (n + k) as above from s0, (select {strength('s0')} as k)),
d0 as (select suffix, domain, sum(n) as n, sum(bad) as bad, any_value(above) as above from hosts join s1 using (suffix) group by suffix, domain),
d1 as (select suffix, domain, (bad + k * above) / (n + k) as above from d0, (select {strength('d0')} as k)),
u0 as (select host, n, bad, above from hosts join d1 using (suffix, domain)),
u1 as (select host, n, k, (bad + k * above) / (n + k) as mean from u0, (select {strength('u0')} as k)),
known as (select host, mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (n + k + 1)) as bound from u1)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when bound >= {block_odds} * o / (1 - o + {block_odds} * o) then 'block' else 'allow' end) as verdict
from placed left join known using (host), (select (sum(bad) + 1) / (sum(n) + 2) as o from hosts)"""
