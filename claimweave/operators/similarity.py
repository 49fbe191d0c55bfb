"""Near-duplicate clustering, copied articles and coordinated-review signals.

The rule is sequential: in arrival order an item joins the earliest leader it duplicates, else it
becomes a leader. It is worked out here in rounds over an index of exact candidate keys:

* Jaccard at t: tokens ordered from rare to common, only the first n - ceil(t n) + 1 can be the first
  shared one, so items that share no such token cannot reach t.
* Hamming at most k over 64 bits: with k + 2 blocks, two blocks at least are equal.

In every round only the earliest few undecided items of each key are compared with each other. One
that leads all its keys, and duplicates none of the earlier ones, is a leader for certain; it is then
compared with all rows of its keys. A key never yields all its pairs, so a group of near copies that
holds a third of all rows costs one pass over it, not a square. Equal texts are folded before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.checkpoints import cut
from claimweave.functions.scores import round_half_up
from claimweave.functions.text import hamming, jaccard, shingles, token_hash
from claimweave.operators.ranking import top_per_key

SHORT_TEXT, HAMMING_MAX, JACCARD_MIN, CLAIM_JACCARD = 400, 3, 0.82, 0.7
# Document types whose copies are syndication.
NARRATIVE_TYPES = ("page", "wiki_page", "rss_item", "upload")
_KEY = ["grp", "kind", "bucket"]


def hashed_shingles(text: Column) -> Column:
    return F.transform(shingles(text), token_hash)


def simhash_of_tokens(tokens: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """64-bit simhash per key from one row per token occurrence (NULL token: no tokens, hash 0).

    Bit counts travel two to a 64-bit sum, so the aggregate holds 32 sums and combines map-side: only
    one row per text is shuffled.
    """
    pair = F.lit(0x1_0000_0001)
    sums = [F.sum(F.shiftrightunsigned(token, j).bitwiseAND(pair)).alias(f"s{j}") for j in range(32)]
    agg = tokens.groupBy(*keys).agg(F.count(token).alias("n"), *sums)
    low = lambda j: F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda j: F.shiftrightunsigned(f"s{j}", 32)
    out = F.lit(0).cast("long")
    for j in range(32):
        for bit, count in ((j, low(j)), (j + 32, high(j))):
            value = (1 << bit) - ((1 << 64) if bit == 63 else 0)
            out = out.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return agg.select(*keys, out.alias("simhash"))


def simhash(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    tokens = df.select(*keys, F.explode_outer(hashed_shingles(F.col(text))).alias("token"))
    return simhash_of_tokens(tokens, keys)


#: Longs of a parity bitmap, and the columns of an index of candidate keys.
_BITS = ("bits_0", "bits_1")
_INDEX = [*_KEY, "ord", "short", "n_tok", "at", "simhash", *_BITS]


def _parity(tokens: str, part: int) -> Column:
    """Which of the 64 buckets of this part of the bitmap hold an odd number of the tokens."""
    own = f"filter({tokens}, x -> ((x >> 6) & {len(_BITS) - 1}) = {part})"
    return F.expr(f"aggregate({own}, 0L, (bits, x) -> bits ^ shiftleft(1L, cast(x & 63 as int)))")


def _prefix_index(reps: DataFrame, t: float) -> DataFrame:
    """Candidate keys for Jaccard at least t; tokens that occur once can be shared by nobody.

    Those come first in the order, so they only push the others back: they are counted, not sorted.
    ``at`` is the key's place among all tokens of the text.
    """
    toks = reps.select("grp", "ord", F.explode("tokens").alias("bucket"))
    freq = toks.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    # repeated tokens are few beside all, so these are not sorted
    ranked = toks.join(freq.hint("shuffle_hash"), ["grp", "bucket"]).groupBy("grp", "ord").agg(
        F.array_sort(F.collect_list(F.struct("freq", "bucket"))).alias("sorted")
    )
    told = reps.select("grp", "ord", "short", "n_tok", *[_parity("tokens", i).alias(c) for i, c in enumerate(_BITS)])
    ranked = ranked.join(told, ["grp", "ord"]).withColumn("alone", F.col("n_tok") - F.size("sorted"))
    keep = F.col("n_tok") - F.ceil(F.col("n_tok") * t - 1e-9) + 1 - F.col("alone")
    ranked = ranked.withColumn("prefix", F.slice("sorted", F.lit(1), F.greatest(keep.cast("int"), F.lit(0))))
    out = ranked.select("*", F.posexplode("prefix").alias("i", "p"))
    return out.select(
        "grp", F.lit(-1).alias("kind"), F.col("p.bucket").alias("bucket"), "ord", "short", "n_tok", (F.col("alone") + F.col("i") + 1).alias("at"),
        F.lit(0).cast("long").alias("simhash"), *_BITS,
    )


def _block_index(hashed: DataFrame, k: int) -> DataFrame:
    """Candidate keys for Hamming distance at most k: every choice of two out of k + 2 bit blocks."""
    n = k + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(
        *[F.struct(F.lit(i).alias("kind"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for i, m in enumerate(signed)]
    )
    out = hashed.select("grp", "ord", "simhash", F.explode(choices).alias("c"))
    none = [F.lit(0).cast("long").alias(c) for c in _BITS]
    out = out.select("grp", "c.kind", "c.bucket", "ord", F.lit(False).alias("short"), F.lit(0).alias("n_tok"), F.lit(0).alias("at"), "simhash", *none)
    shared = out.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
    return out.join(shared, _KEY, "left_semi")


def _candidates(a: DataFrame, b: DataFrame, t: float, k: int) -> DataFrame:
    """Pairs (a, b, by_sets) of index rows with a before b that may be duplicates; those by simhash are.

    Before any pair moves, sizes, places and bitmaps bound what two sets can share: at their first common
    key no more than that key and what follows it in both, and never more than (n_x + n_y - differing
    bits) / 2. Duplicates share at least t / (1 + t) of n_x + n_y.
    """
    x, y = a.alias("x"), b.alias("y")
    same = (F.col("x.ord") < F.col("y.ord")) & F.col("x.grp").eqNullSafe(F.col("y.grp"))
    for c in ("kind", "bucket"):
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    by_sets = F.col("x.kind") < 0
    small = F.least("x.n_tok", "y.n_tok")
    big = F.greatest("x.n_tok", "y.n_tok")
    both = F.col("x.n_tok") + F.col("y.n_tok")
    rest = F.least(F.col("x.n_tok") - F.col("x.at"), F.col("y.n_tok") - F.col("y.at")) + 1
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BITS])
    near_sets = (small >= big * t - 1e-9) & (rest * (1 + t) >= both * t - 1e-6) & ((both - differ) * (1 + t) >= both * (2 * t) - 1e-6)
    possible = F.when(by_sets, (F.col("x.short") | F.col("y.short")) & near_sets).otherwise(
        hamming(F.col("x.simhash"), F.col("y.simhash")) <= k
    )
    return x.join(y, same).filter(possible).groupBy(F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).agg(
        F.bool_and(by_sets).alias("by_sets")
    )


def _verified(a: DataFrame, b: DataFrame, tokens: DataFrame, t: float, k: int) -> DataFrame:
    """Pairs (a, b) of index rows with a before b that really are duplicates."""
    pairs = _candidates(a, b, t, k)
    near = pairs.filter(~F.col("by_sets")).select("a", "b")
    ta = tokens.select(F.col("ord").alias("a"), F.col("tokens").alias("ta"))
    tb = tokens.select(F.col("ord").alias("b"), F.col("tokens").alias("tb"))
    sets = pairs.filter("by_sets").join(ta, "a").join(tb, "b").filter(jaccard(F.col("ta"), F.col("tb")) >= t).select("a", "b")
    return near.unionByName(sets)


def leader_clusters(
    items: DataFrame,
    item: str,
    order: str,
    text: str = "text",
    groups: Sequence[str] = (),
    short_text: int | None = None,
    jaccard_min: float = JACCARD_MIN,
    hamming_max: int = HAMMING_MAX,
    pivots: int = 32,
) -> DataFrame:
    """(groups, item, cluster): the cluster is the id of its first member.

    ``short_text`` None compares everything by Jaccard; with a length, texts from it on count as copies by
    simhash distance instead. ``pivots`` is how many undecided items of a
    key meet each other in the first round, doubled in every further one; it doesn't change the result.
    """
    grp = F.struct(*groups) if groups else F.lit(0)
    chars = F.length(text)
    base = items.select(
        F.struct(F.col(order).alias("at"), F.col(item).alias("id")).alias("ord"),
        grp.alias("grp"),
        hashed_shingles(F.col(text)).alias("all_tokens"),
        (F.lit(True) if short_text is None else chars < short_text).alias("short"),
        F.sha2(F.col(text), 256).alias("sig"),
    )
    base = base.withColumn("tokens", F.array_distinct("all_tokens")).withColumn("n_tok", F.size("tokens"))
    # texts without tokens behave alike whatever they hold
    base = base.withColumn("sig", F.when(F.col("n_tok") == 0, F.col("short").cast("string")).otherwise(F.col("sig")))
    base = cut(base)
    first = base.groupBy("grp", "sig").agg(F.min("ord").alias("rep"))
    copies = base.select("grp", "sig", "ord").join(first, ["grp", "sig"]).select("grp", "ord", "rep")
    reps = cut(base.join(first.select(F.col("rep").alias("ord")), "ord", "left_semi"))

    by_sets = reps
    if short_text is not None:
        by_sets = reps.filter(F.col("short") | (F.col("n_tok") * jaccard_min <= short_text))
    index = _prefix_index(by_sets.filter("n_tok > 0"), jaccard_min)
    if short_text is not None:
        long = reps.filter(~F.col("short")).select("grp", "ord", F.explode_outer("all_tokens").alias("token"))
        index = index.unionByName(_block_index(simhash_of_tokens(long, ["grp", "ord"]), hamming_max))
    # texts without any token are equal sets and share one key of their own
    zero = [F.lit(0).cast("long").alias(c) for c in ("simhash", *_BITS)]
    bare = reps.filter("n_tok = 0").select("grp", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "ord", "short", "n_tok", F.lit(0).alias("at"), *zero)
    index = live = cut(index.select(_INDEX).unionByName(bare))
    held = lambda df: cut(df.join(index.select("ord").distinct(), "ord", "left_semi"))
    tokens = held(by_sets.select("ord", "tokens"))

    # live: the rows of undecided items; index: all rows of keys that have one; tokens: of the items in it
    hits: list[DataFrame] = []
    while not live.isEmpty():
        heads = cut(top_per_key(live, _KEY, [F.col("ord")], pivots).drop("pos"))
        all_keys = live.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
        seen = heads.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
        visible = seen.join(all_keys, ["ord", "n"], "left_semi").select("ord")
        doubles = _verified(heads, heads.join(visible, "ord", "left_semi"), tokens, jaccard_min, hamming_max)
        leaders = cut(visible.join(doubles.select(F.col("b").alias("ord")), "ord", "left_anti"))
        rows = live.join(leaders, "ord", "left_semi")
        found = cut(_verified(rows, index, tokens, jaccard_min, hamming_max))
        hits.append(found)
        taken = leaders.unionByName(found.select(F.col("b").alias("ord"))).distinct()
        live = cut(live.join(taken, "ord", "left_anti"))
        if not live.isEmpty():
            index = cut(index.join(live.select(*_KEY).distinct(), _KEY, "left_semi"))
            tokens = held(tokens)
        pivots *= 2  # so that the number of rounds grows with the logarithm of the largest key

    if hits:
        lead = reduce(DataFrame.unionByName, hits).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("leader"))
        copies = copies.join(lead, "rep", "left").withColumn("rep", F.coalesce("leader", "rep"))
    return copies.select(
        *[F.col("grp").getField(g).alias(g) for g in groups], F.col("ord.id").alias(item), F.col("rep.id").alias("cluster")
    )


def with_cluster_size(clusters: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    size = clusters.groupBy(*groups, "cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return clusters.join(size, [*groups, "cluster"])


def syndicated(
    snapshots: DataFrame, groups: Sequence[str] = ("project_id",), order: str = "snapshot_id", doc_types: Sequence[str] = NARRATIVE_TYPES,
    short_text: int | None = None,
) -> DataFrame:
    """Narrative snapshots that belong to a cluster of copies; whole texts are compared.

    Only documents of the given types count (all, where the table has no column doc_type).
    """
    if "doc_type" in snapshots.columns:
        snapshots = snapshots.filter(F.col("doc_type").isin(list(doc_types)))
    clusters = leader_clusters(snapshots, "snapshot_id", order, "text", groups, short_text)
    return with_cluster_size(clusters, groups).filter(F.col("cluster_size") > 1)


def near_duplicate_claims(claims: DataFrame, order: str = "claim_id") -> DataFrame:
    """(claim_id, canonical_id) for claims too close to an earlier claim of the same project and type."""
    out = leader_clusters(
        claims, "claim_id", order, "text", ("project_id", "claim_type"), short_text=None, jaccard_min=CLAIM_JACCARD
    )
    return out.filter(F.col("cluster") != F.col("claim_id")).select("claim_id", F.col("cluster").alias("canonical_id"))


def micros(items: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    if dict(items.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


def whole(x: Column, width: int) -> Column:
    """How many whole widths a number holds, rounded down."""
    return ((x - F.pmod(x, F.lit(width))) / width).cast("long")


def most_from_each_hour(items: DataFrame, keys: Sequence[str], ts: str, hours: int = 24) -> DataFrame:
    """Per key and hour (whole hours since 1970) with rows: its rows (n) and the most rows of a window of so many hours that starts in it.

    Both ends of a window count. What a window holds of the hours between its first and its last is a sum
    of hourly counts; what it holds of these two is told by a running count over the instants of both. So
    a task sorts the instants of two hours of a key, and every instant moves twice.
    """
    hour = 3_600_000_000
    points = items.filter(F.col(ts).isNotNull()).groupBy(*keys, micros(items, ts).alias("at")).agg(F.count(F.lit(1)).alias("c"))
    none = F.lit(0).cast("long")
    marks = F.array(F.struct(F.col("at").alias("x"), F.col("c").alias("starts"), none.alias("ends")), F.struct((F.col("at") - hours * hour).alias("x"), none.alias("starts"), F.col("c").alias("ends")))
    marks = points.select(*keys, F.inline(marks)).withColumn("hour", whole(F.col("x"), hour))
    upto = W.partitionBy(*keys, "hour").orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    # of its own hour a window misses what starts before it, of the last it holds what ends with it
    edge = F.sum(F.col("ends") - F.col("starts")).over(upto) + F.sum("starts").over(W.partitionBy(*keys, "hour", "x"))
    each = marks.withColumn("edge", edge).groupBy(*keys, "hour").agg(F.sum("starts").alias("n"), F.max(F.when(F.col("starts") > 0, F.col("edge"))).alias("edge"))
    each = each.filter("n > 0")  # one row a key and hour
    between = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("hour").rangeBetween(1, hours - 1)), none) if hours > 1 else none
    return each.select(*keys, "hour", "n", (F.col("edge") + F.col("n") + between).alias("most"))


def burst_share(items: DataFrame, keys: Sequence[str], ts: str, hours: int = 24) -> DataFrame:
    """Per key: dated rows and the largest share of them inside any window of some hours."""
    out = most_from_each_hour(items, keys, ts, hours).groupBy(*keys).agg(F.sum("n").alias("n_dated"), F.max("most").alias("max_in_window"))
    return out.withColumn("burst_ratio", F.when(F.col("n_dated") >= 5, F.col("max_in_window") / F.col("n_dated")).otherwise(0.0))


def astroturf(items: DataFrame, source: str, item: str, text: str, ts: str, order: str, short_text: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per source: duplicate share, burst share and batch score; and the items in duplicate clusters."""
    sized = with_cluster_size(leader_clusters(items, item, order, text, (source,), short_text), (source,))
    dup = sized.groupBy(source).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("cluster_size") > 1).alias("n_dup"))
    out = dup.filter(F.col("n_items") >= 5).join(burst_share(items, [source], ts), source, "left")
    d, b = F.col("n_dup") / F.col("n_items"), F.coalesce("burst_ratio", F.lit(0.0))
    score = F.least(F.lit(1.0), F.when(d > 0.15, d).otherwise(0.0) * 2 + F.when(b > 0.4, b - 0.4).otherwise(0.0))
    out = out.select(source, "n_items", round_half_up(d).alias("dup_ratio"), round_half_up(b).alias("burst_ratio"), round_half_up(score, 2).alias("batch_score"))
    suspects = sized.filter(F.col("cluster_size") > 1).join(out.select(source), source, "left_semi").select(source, item)
    return out, suspects


def flag_promotion(evidence: DataFrame, scan: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark suspect evidence of scored sources, and queue the worst sources for review."""
    marked = suspects.join(scan.filter(F.col("batch_score") > 0).select("source_id"), "source_id", "left_semi").select(
        "evidence_id"
    ).distinct().withColumn("_hit", F.lit(True))
    out = evidence.join(marked, "evidence_id", "left").withColumn(
        "suspected_promo", F.col("suspected_promo") | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")
    queue = scan.filter(F.col("batch_score") > 0.5).select(
        F.lit("source").alias("item_type"), F.col("source_id").alias("item_id"), F.lit("astroturf_suspect").alias("reason"), F.lit(2).alias("priority")
    )
    return out, queue


def related_pairs(claims: DataFrame, first_pairs: int = 8, low: float = 0.35, high: float = CLAIM_JACCARD) -> DataFrame:
    """Report of related-but-different claims: each project's first pairs, the newest claims first.

    All claims of a project and topic meet through the prefix index. Equal sets of tokens are folded
    before: whatever pairs two sets make, the first n of them lie among the n newest claims of each.
    The newest claims meet all older ones first, then four times as many, and so on until a project
    has its n pairs or no claims are left; later claims could only give later pairs.
    """
    at = top_per_key(claims, ["project_id"], [F.col("updated_at").desc(), F.col("claim_id")], None)
    sets = at.select(
        F.struct("project_id", "topic").alias("grp"), "claim_id", "pos", F.array_sort(F.array_distinct(hashed_shingles(F.col("text")))).alias("tokens")
    ).filter((F.size("tokens") > 0) & F.col("project_id").isNotNull() & F.col("topic").isNotNull())
    sets = cut(sets.withColumn("sig", F.sha2(F.array_join("tokens", ","), 256)))
    members = cut(top_per_key(sets.drop("tokens"), ["grp", "sig"], [F.col("pos")], first_pairs, "nth").drop("nth"))
    reps = sets.groupBy("grp", "sig").agg(F.min_by("tokens", "pos").alias("tokens"), F.min("pos").alias("ord"))
    reps = cut(reps.withColumns({"n_tok": F.size("tokens"), "short": F.lit(True)}))
    index = cut(_prefix_index(reps, low).select("grp", F.col("grp.project_id").alias("project_id"), "bucket", "ord", "n_tok"))
    same = (F.col("x.grp") == F.col("y.grp")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.ord") < F.col("y.ord"))
    one = lambda c: reps.select("grp", F.col("ord").alias(c), F.col("tokens").alias(f"t{c}"), F.col("sig").alias(f"sig_{c}"))
    named = lambda c: members.select("grp", F.col("sig").alias(f"sig_{c}"), F.struct("pos", "claim_id").alias(c))
    fits = F.least("x.n_tok", "y.n_tok") >= F.greatest("x.n_tok", "y.n_tok") * low - 1e-9

    def pairs_of(rows: DataFrame) -> DataFrame:
        met = rows.alias("x").join(index.alias("y"), same).filter(fits)
        met = met.select(F.col("x.grp").alias("grp"), F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).distinct()
        near = met.join(one("a"), ["grp", "a"]).join(one("b"), ["grp", "b"]).withColumn("similarity", jaccard(F.col("ta"), F.col("tb")))
        near = near.filter((F.col("similarity") >= low) & (F.col("similarity") < high)).select("grp", "sig_a", "sig_b", "similarity")
        pairs = near.join(named("a"), ["grp", "sig_a"]).join(named("b"), ["grp", "sig_b"]).select(
            F.col("grp.project_id").alias("project_id"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"
        )
        return pairs.select(
            "project_id", F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"),
            F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "similarity",
        )

    order = [F.col("pos_a"), F.col("pos_b")]
    ends = cut(index.groupBy("project_id").agg(F.max("ord").alias("end")))
    found, undone, done, upto = pairs_of(index.limit(0)), ends, 0, 64
    while not undone.isEmpty():
        rows = index.filter((F.col("ord") > done) & (F.col("ord") <= upto)).join(undone.select("project_id"), "project_id", "left_semi")
        found = cut(top_per_key(found.unionByName(pairs_of(rows)), ["project_id"], order, first_pairs).drop("pos"))
        full = found.filter(F.col("pos_a") <= upto).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= first_pairs)
        undone = cut(undone.filter(F.col("end") > upto).join(full, "project_id", "left_anti"))
        done, upto = upto, upto * 4
    return top_per_key(found, ["project_id"], order, first_pairs).drop("pos_a", "pos_b")
