"""Operator 5: mix sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks.

Each source's documents, in the order of a hash, form one stream of words, cut into equal blocks. A
source may take its target in whole blocks (its quota). Slots 0, 1, 2, ... are mapped by golden-ratio
points through the cumulative quotas to sources; the n-th slot of a source takes its block n, starting
over when the blocks are used up, and slots beyond the quota stay empty. Any stretch of the schedule
thus holds the sources in nearly their final shares, and a rerun gives the same schedule.

Sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all documents; no
target exceeds three times its source, what is cut off goes to the others by weight.

Built from DataFrame functions only. Null or wordless texts have size 0 and are never taken; a null
source is a source, a null id an id. Repeated rows are documents of their own; rows that tie in the order
of hashes are equal in all that counts. Very long texts span many blocks. Empty tables give no rows. Streams and ranks are
summed in buckets first, so that a source with most of the rows is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.checkpoints import new_folder

#: Words a block is to have; a source has at least FINE blocks (or words) and at most MANY.
BLOCK_WORDS = 4096
FINE = 1024
MANY = 1 << 20
#: A source is taken at most so many times over.
MOST_TIMES = 3
#: Fixed value: the golden ratio's fraction in units of 1 / CIRCLE, made odd so that points don't repeat.
CIRCLE = 1 << 31
GOLDEN = 1327217885
#: Pieces of the circle in which slots look up their source.
CELLS = 4096
#: Slots ranked together.
CHUNK = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, f"mix-{name}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw, digest): words of each text, a hash of the id that orders the stream, a hash of the text."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("draw"), F.xxhash64(F.col("text").cast("string")).alias("digest"))


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: (source, source_size, weight, target)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()  # one row a source
    weight = 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3
    rows = sums.withColumn("weight", weight.cast("long")).withColumn("most", MOST_TIMES * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("cut_before", F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("weight_before", F.sum("weight").over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
    rate = (F.sum("source_size").over(everything) - F.coalesce("cut_before", F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce("weight_before", F.lit(0)))
    rows = rows.withColumn("rate", rate).withColumn("full", F.col("most") <= F.col("rate") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("room"), "rate"))).over(everything)["rate"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(sources: DataFrame) -> DataFrame:
    """Sources with their number, blocks, quota and stretch [low, high) of the circle."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.least(F.col("source_size"), F.lit(FINE))), F.lit(MANY))
    rows = sources.filter("source_size > 0").withColumn("sid", F.row_number().over(order)).withColumn("blocks", blocks)
    rows = rows.withColumn("quota", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))
    before, all_ = F.sum("quota").over(order) - F.col("quota"), F.sum("quota").over(Window.partitionBy())

    def point(quota: Column) -> Column:
        return F.floor(quota / all_ * CIRCLE)

    return rows.withColumn("low", point(before)).withColumn("high", point(before + F.col("quota")))


def schedule(planned: DataFrame) -> DataFrame:
    """(slot, sid, rank, block): which block of which source each filled slot takes."""
    spark = planned.sparkSession
    quotas, n = planned.agg(F.sum("quota"), F.count("*")).first()
    if not quotas:
        return spark.createDataFrame([], "slot long, sid int, rank long, block long")
    slots = spark.range(2 * quotas + 64 * n).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE + 1) * GOLDEN % CIRCLE).alias("point"))
    width = CIRCLE // CELLS
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    parts = planned.filter("low < high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    drawn = slots.join(parts, "cell").filter("point >= low and point < high").select("slot", "sid", "quota", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inner", inner).join(before, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.col("inner"))
    return ranked.filter("rank < quota").select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def streams(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Documents with the place ``at`` of their first word in their source's stream."""
    rows = sized.withColumn("bucket", F.substring("draw", 1, 4))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.sum("size").over(order) - F.col("size"))
    known = before.join(planned.select("source", "sid", "blocks", "source_size", "target"), before["source"].eqNullSafe(planned["source"]), "left")
    known = known.select(before["source"].alias("s"), F.col("bucket").alias("b"), "before", "sid", "blocks", "source_size", "target")
    placed = rows.join(known, rows["source"].eqNullSafe(known["s"]) & (rows["bucket"] == known["b"]))
    return placed.select("doc_id", "digest", "source", "size", "sid", "blocks", "source_size", "target", (F.col("before") + F.col("inner")).alias("at"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    sized = _stored(sizes(docs), "sizes")
    planned = _stored(plan(targets(sized)), "plan")
    times = schedule(planned).groupBy("sid", "block").agg(F.count("*").alias("times"))
    placed = _stored(streams(sized, planned), "streams")
    # The block of word p is the last one that begins at or before it; block j begins at floor(j * size / blocks).
    first, last = (F.expr(f"(({p}) * blocks - 1) div source_size") for p in ("at + 1", "at + size"))
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begins, ends = F.expr("block * source_size div blocks"), F.expr("(block + 1) * source_size div blocks")
    shared = F.least(F.col("at") + F.col("size"), ends) - F.greatest(F.col("at"), begins)
    taken = spread.withColumn("shared", shared).join(times, ["sid", "block"]).groupBy("sid", "at").agg(F.sum(F.col("shared") * F.col("times")).alias("taken"))
    whole = placed.filter("size > 0").join(taken, ["sid", "at"], "left").select("doc_id", "digest", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = placed.filter("size = 0").select("doc_id", "digest", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.lit(0).cast("long").alias("taken"))
    return whole.unionByName(none)


def copies(docs: DataFrame) -> DataFrame:
    """The rows, each as often as the mix takes its words, to the nearest whole copy (none if less than half)."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id_key")]
    taken = mix(docs).filter("size > 0").groupBy(*key, "digest").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies"))
    named = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, named, strict=True)), *key, F.xxhash64(F.col("text").cast("string")).alias("digest"))
    repeated = rows.join(taken.filter("copies > 0"), ["id_key", "digest"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, named, strict=True)))


def sql(documents: str = "documents") -> str:
    """The same in DuckDB SQL."""
    blocks = f"least(greatest(ceil(source_size / {BLOCK_WORDS}), least(source_size, {FINE})), {MANY})::bigint"
    return f"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as draw from {documents}),
s0 as (select source, sum(size)::bigint as source_size, (1 + (row_number() over (order by source nulls last) - 1) % 3)::bigint as weight from d group by source),
s1 as (select *, {MOST_TIMES} * source_size as most from s0),
s2 as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double as rate from s1),
s3 as (select *, most <= rate * weight as filled from s2),
s4 as (select source, source_size, case when filled then most::double else first_value(rate) over (order by filled, most / weight, source nulls last) * weight end as target from s3),
p0 as (select *, row_number() over (order by source nulls last) as sid, {blocks} as blocks from s4 where source_size > 0),
p1 as (select *, floor(target * blocks / source_size + 0.5)::bigint as quota from p0),
p2 as (select *, sum(quota) over (order by source nulls last) - quota as before, sum(quota) over () as quotas from p1),
p3 as (select *, floor((before / quotas) * {CIRCLE})::bigint as low, floor(((before + quota) / quotas) * {CIRCLE})::bigint as high from p2),
slots as (select slot, (slot % {CIRCLE} + 1) * {GOLDEN} % {CIRCLE} as point from (select unnest(range((select 2 * sum(quota) + 64 * count(*) from p3)::bigint)) as slot)),
ranked as (select sid, blocks, quota, row_number() over (partition by sid order by slot) - 1 as rank from slots join p3 on point >= low and point < high),
times as (select sid, rank % blocks as block, count(*) as times from ranked where rank < quota group by 1, 2),
placed as (select row_number() over () as rid, doc_id, d.source, size, sid, blocks, p3.source_size, target,
    (sum(size) over (partition by d.source order by draw, doc_id nulls first, size rows unbounded preceding) - size)::bigint as pos
    from d left join p3 on d.source is not distinct from p3.source),
spread as (select rid, pos, size, source_size, blocks, sid, unnest(range(((pos + 1) * blocks - 1) // source_size, ((pos + size) * blocks - 1) // source_size + 1)) as block from placed where size > 0),
taken as (select rid, sum((least(pos + size, (block + 1) * source_size // blocks) - greatest(pos, block * source_size // blocks)) * times)::bigint as taken
    from spread join times using (sid, block) group by rid)
select doc_id, size, coalesce(source_size, 0)::bigint as source_size, coalesce(target, 0.0)::double as target, coalesce(taken, 0)::bigint as taken
from placed left join taken using (rid)"""
