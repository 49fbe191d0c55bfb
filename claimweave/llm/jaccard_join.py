"""Operator 10: exact Jaccard join of documents on word shingles, through size-banded tiles and bitmap signatures.

1. All shingles are counted in a fixed number of hash buckets (a histogram of constant size).
2. Each text's set becomes a profile: its size, a hash of the whole set, the shortest prefix that two
   similar sets must share (rare buckets first), and a parity bitmap. Equal sets fold into one class.
3. A tile holds the classes with one prefix shingle in common. In a tile, classes of sizes within the
   threshold are compared by bitmap: the bits in which two parity bitmaps differ bound the number of
   differing shingles from below, so the overlap from above. Of the pairs that pass, a tile names a
   spanning forest; copies of one text thus give a link each, not all their pairs.
4. Named pairs that also pass a wider bitmap are decided by intersecting their exact sorted sets. In tiles
   whose classes then still belong to several components, the remaining pairs that pass the bitmap and
   join two components are decided as well, a few between a class and a component first, then all that
   still join two. No pair that could join two components stays undecided, so components are exact.
5. A tile of more than ``PART`` classes is dealt into parts that share one class; afterwards what isn't
   in its commonest component meets all of it, block by chunk, so that no task holds more than those.

Sets are compared as 64-bit shingle hashes. Null or wordless texts have no shingle and no link; texts
shorter than a shingle are one shingle. Rows with a null id take part and keep a null id (their
component is the smallest known id in it). Repeated rows are equal texts. Very long texts are hashed one
at a time. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm.batches import text_slices, texts_of
from claimweave.llm.components import components
from claimweave.llm.exact_sets import PASSES, blocks, exact_sets, few_per_root, set_hash, similar
from claimweave.llm.shingles import mix, shingle_hashes, shingle_sets

#: Hash buckets of the shingle histogram: its size never depends on the data.
BUCKET_BITS = 20
CHUNKS = 64
#: 64-bit words of a parity bitmap.
BITMAP_WORDS = 3
#: Bits of the wider bitmap that each class has once.
WIDE_BITS = 2048
#: Rows of a tile that meet in one task; larger tiles are dealt into parts.
PART = 512
#: Rows of two parts of a tile that a task compares afterwards.
BLOCK = 2048
#: Stands for a null id in keys.
NULL_ID = -(1 << 63)
PROFILE = "doc_id long, digest long, n int, cls long, prefix binary, wide binary, b0 long, b1 long, b2 long"
MEMBER = "tile long, n int, cls long, b0 long, b1 long, b2 long"
STAR = "tile long, leader long, others binary, members binary"


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def _levels(docs: DataFrame, size: int) -> np.ndarray:
    """How frequent each bucket is, on a logarithmic scale (one byte a bucket)."""

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in text_slices(batches):
            hashes = np.concatenate(shingle_hashes(texts_of(batch), size))
            total += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), pa.array([x.tobytes() for x in np.split(total, CHUNKS)])], names=["chunk", "counts"])

    def add(table):
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([np.ceil(4 * np.log2(total + 1)).astype(np.uint8).tobytes()])})

    counted = docs.select("text").mapInArrow(count, "chunk long, counts binary")
    rows = counted.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()  # always CHUNKS small rows
    by = {r["chunk"]: r["counts"] for r in rows}
    return np.frombuffer(b"".join(by.get(i, bytes((1 << BUCKET_BITS) // CHUNKS)) for i in range(CHUNKS)), dtype=np.uint8)


def _parity(hashes: np.ndarray, bits: int) -> bytes:
    """Which buckets hold an odd number of the hashes."""
    return np.packbits((np.bincount((mix(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _profiles(docs: DataFrame, size: int, percent: int, levels) -> DataFrame:
    def profile(batches):
        frequent = levels.value
        for batch in text_slices(batches):
            rows = []
            for doc_id, digest, x in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), shingle_sets(texts_of(batch), size), strict=True):
                if not len(x):
                    rows.append((doc_id, digest, 0, 0, b"", b"", *[0] * BITMAP_WORDS))
                    continue
                n = len(x)
                order = np.argsort(frequent[(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                kept = x[order[: n - -(-percent * n // 100) + 1]]
                whole = set_hash(x)
                rows.append((doc_id, digest, n, whole, kept.tobytes(), _parity(x, WIDE_BITS), *np.frombuffer(_parity(x, 64 * BITMAP_WORDS), dtype=np.int64).tolist()))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * BITMAP_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "digest", "n", "cls", "prefix", "wide", "b0", "b1", "b2"])

    return docs.mapInArrow(profile, PROFILE)


def _postings(levels, part_rows: int):
    """One row a prefix shingle; ``often`` tells whether its tile may have more than ``part_rows`` rows."""
    most = np.uint8(np.ceil(4 * np.log2(part_rows + 1)))

    def run(batches):
        for batch in batches:
            yield _posted(batch, levels.value, most)

    return run


def _posted(batch: pa.RecordBatch, levels: np.ndarray, most: np.uint8) -> pa.RecordBatch:
    prefixes = batch.column("prefix").to_pylist()
    counts = np.array([len(p) // 8 for p in prefixes], dtype=np.int64)
    which = pa.array(np.repeat(np.arange(len(prefixes)), counts))
    keys = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
    often = pa.array(levels[(keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] >= most)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(c).take(which) for c in ("n", "cls", "b0", "b1", "b2")), often], names=["tile", "n", "cls", "b0", "b1", "b2", "often"])


def _pass(n: np.ndarray, bits: np.ndarray, u: int, pool: np.ndarray, percent: int) -> np.ndarray:
    """Those of the pool whose sizes and bitmaps allow them to be similar to u."""
    low, high = np.minimum(n[pool], n[u]), np.maximum(n[pool], n[u])
    pool = pool[100 * low >= percent * high]
    both = n[pool] + n[u]
    differing = np.bitwise_count(bits[pool] ^ bits[u]).sum(axis=1, dtype=np.int64)
    overlap = (both - differing) // 2
    return pool[100 * overlap >= percent * (both - overlap)]


def _tile_forest(n: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Stars that span each group of classes connected by passing pairs."""
    pool, stars = np.arange(len(n)), []
    while len(pool) > 1:
        open_, pool = [int(pool[0])], pool[1:]
        while open_ and len(pool):
            u = open_.pop()
            near = _pass(n, bits, u, pool, percent)
            if len(near):
                stars.append((u, near))
                pool = np.setdiff1d(pool, near, assume_unique=True)
                open_ += near.tolist()
    return stars


def _groups(batches, column: str):
    """Whole runs of equal values of a sorted column, several at a time: (table of arrays, run starts)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        values = held.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1])) if len(values) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, cls = table.column("n").to_numpy().astype(np.int64), table.column("cls").to_numpy()
    bits = np.stack([table.column(f"b{i}").to_numpy() for i in range(BITMAP_WORDS)], axis=1).view(np.uint64)
    return n, cls, bits


def _runs(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])


def _name_stars(percent: int):
    """Tiles in; out come stars of passing pairs (leader, others) and, once for a tile of three or more, its touched members."""

    def run(batches):
        for table in _groups(batches, "tile"):
            n, cls, bits = _arrays(table)
            tile = table.column("tile").to_numpy()
            runs = _runs(tile)
            sizes = np.diff(runs)
            two = runs[:-1][sizes == 2]
            both = n[two] + n[two + 1]
            overlap = (both - np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64)) // 2
            two = two[100 * overlap >= percent * (both - overlap)]
            leaders, others = np.minimum(cls[two], cls[two + 1]), np.maximum(cls[two], cls[two + 1])
            rows = [(t, a, b, None) for t, a, b in zip(tile[two].tolist(), leaders.tolist(), (x.tobytes() for x in others), strict=True)]
            for s, e in zip(runs[:-1][sizes > 2].tolist(), runs[1:][sizes > 2].tolist(), strict=True):
                order = s + np.lexsort((cls[s:e], -n[s:e]))
                stars = _tile_forest(n[order], bits[order], percent)
                touched = order[np.unique(np.concatenate([np.append(near, u) for u, near in stars]))] if stars else []
                packed = np.column_stack([n[touched], cls[touched], bits[touched].view(np.int64)]).tobytes() if len(touched) > 2 else None
                for u, near in stars:
                    rows.append((int(tile[s]), int(cls[order[u]]), cls[order[near]].tobytes(), packed))
                    packed = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["tile", "leader", "others", "members"])

    return run


def _star_pairs(batches):
    """Sorted by leader in; out comes each (leader, other) once."""
    for table in _groups(batches, "leader"):
        others = table.column("others").to_pylist()
        a = np.repeat(table.column("leader").to_numpy(), [len(x) // 8 for x in others])
        b = np.frombuffer(b"".join(others), dtype=np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _unpack(batches):
    for batch in batches:
        packed = batch.column("members").to_pylist()
        rows = np.frombuffer(b"".join(packed), dtype=np.int64).reshape(-1, 2 + BITMAP_WORDS)
        tile = np.repeat(batch.column("tile").to_numpy(), [len(x) // (8 * rows.shape[1]) for x in packed])
        yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(rows[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(1, rows.shape[1]))], names=["tile", "n", "cls", "b0", "b1", "b2"])


def _rest_pairs(percent: int, most: int | None = None):
    """Tiles with roots in; out come, as stars, all pairs of different roots whose sizes and bitmaps allow them to be similar."""

    def run(batches):
        for table in _groups(batches, "tile"):
            n, cls, bits = _arrays(table)
            root, runs = table.column("root").to_numpy(), _runs(table.column("tile").to_numpy())
            for s, e in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                values, counts = np.unique(root[s:e], return_counts=True)
                leaders, others = [], []
                for u in (s + np.flatnonzero(root[s:e] != values[counts.argmax()])).tolist():  # one of each pair isn't in the largest
                    pool = s + np.flatnonzero(root[s:e] != root[u])
                    near = few_per_root(_pass(n, bits, u, pool, percent), cls, root, most)
                    if len(near):
                        leaders.append(int(cls[u]))
                        others.append(cls[near].tobytes())
                if leaders:
                    yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(others, pa.binary())], names=["leader", "others"])

    return run


def _decide(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, stored) -> DataFrame:
    """Those pairs (a, b) whose exact sets are similar."""

    def wide_pass(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, WIDE_BITS // 64) for c in ("wide_a", "wide_b")]
            overlap = (n - np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)) // 2
            yield batch.select(["a", "b"]).filter(pa.array(100 * overlap >= percent * (n - overlap)))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("wide").alias(f"wide_{name}"))

    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(wide_pass, "a long, b long"), "passed")
    asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = stored(classes.select("cls", "digest").join(asked, "cls"), "asked")
    return similar(pairs, stored(exact_sets(docs, keys, size), "sets"), percent)


def _tiles(postings: DataFrame, part_rows: int, stored) -> tuple[DataFrame, DataFrame]:
    """Postings in tiles of bounded size, and the rows of the tiles that were larger, with their sizes (many).

    A tile whose bucket has few shingles is small by that; only the others are counted. Larger tiles are
    dealt into parts, and each part gets one class that all parts of the tile have in common.
    """
    often = stored(postings.filter("often").drop("often"), "often")
    sizes = often.groupBy("tile").agg(F.count("*").alias("many")).filter("many > 1")
    sized = often.join(sizes, "tile")
    large = stored(sized.filter(F.col("many") > part_rows), "large-tiles")
    columns = [c for c in postings.columns if c != "often"]
    part = lambda i: F.xxhash64("tile", i).alias("tile")
    parts = F.ceil(F.col("many") / part_rows)
    rest = [c for c in columns if c != "tile"]
    dealt = large.select(part(F.pmod(F.xxhash64("cls", F.lit(1)), parts)), *rest)
    one = large.groupBy("tile", "many").agg(F.min(F.struct(F.xxhash64("cls", F.lit(2)).alias("draw"), *rest)).alias("one"))
    shared = one.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("i"), "one.*").select(part(F.col("i")), *rest)
    bounded = postings.filter("not often").select(columns).unionByName(sized.filter(F.col("many") <= part_rows).select(columns))
    return bounded.unionByName(dealt.unionByName(shared).dropDuplicates(["tile", "cls"])), large


def members(docs: DataFrame, size: int = 3, percent: int = 90, part_rows: int = PART) -> DataFrame:
    """One row a document: (doc_id, digest, n, root, component_id); root is null for texts without words."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(spark, f"jaccard-{name}")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    docs = _plain(docs)
    levels = spark.sparkContext.broadcast(_levels(docs, size))
    profiles = stored(_profiles(docs, size, percent, levels), "profiles")
    filled = profiles.filter("n > 0")
    classes = stored(filled.groupBy("n", "cls").agg(F.min("doc_id").alias("first_id"), F.min("digest").alias("digest"), *(F.first(c).alias(c) for c in ("prefix", "wide", "b0", "b1", "b2"))), "classes")
    ids = classes.select("cls", "n", "wide", "first_id", "digest")
    postings = classes.select("n", "cls", "prefix", "b0", "b1", "b2").mapInArrow(_postings(levels, part_rows), MEMBER + ", often boolean")
    tiles, large = _tiles(postings, part_rows, stored)
    stars = stored(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_name_stars(percent), STAR), "stars")
    led = stars.select("leader", "others").repartition("leader").sortWithinPartitions("leader").mapInArrow(_star_pairs, "a long, b long")
    pairs = stored(led, "pairs")
    either = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(_decide(either, docs, ids, size, percent, stored), "links")
    roots = stored(components(links), "roots")
    # Tiles all of whose named pairs are links lie in one component; only the others can hide a link.
    failed = pairs.join(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti").select(F.col("a").alias("leader")).distinct()
    open_tiles = stars.join(failed, "leader").select("tile").distinct()
    members = stored(stars.filter("members is not null").join(open_tiles, "tile").select("tile", "members").mapInArrow(_unpack, MEMBER), "open")
    for most in PASSES:
        rooted, between = (x.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")) for x in (members, large))
        rest = rooted.repartition("tile").sortWithinPartitions("tile").mapInArrow(_rest_pairs(percent, most), "leader long, others binary")
        rest = rest.repartition("leader").sortWithinPartitions("leader").mapInArrow(_star_pairs, "a long, b long")
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = rest.unionByName(blocks(between, "tile", ["b0", "b1", "b2"], _pass, percent, BLOCK, most)).distinct()
        rest = stored(rest.join(either, ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            continue
        more = stored(_decide(rest, docs, ids, size, percent, stored), "more")
        either = either.unionByName(rest)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = stored(components(links), "roots")
    placed = ids.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    rows = profiles.select("doc_id", "digest", "n", "cls")
    linked = rows.filter("n > 0").join(placed.join(least, "root").select("cls", "root", "component_id"), "cls").drop("cls")
    alone = rows.filter("n = 0").select("doc_id", "digest", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): sets of ``size``-word shingles, linked from ``percent`` % similarity on."""
    return members(docs, size, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component (the smallest id; of null ids, the smallest hash of the text), and all wordless ones."""
    found = members(docs, size, percent).withColumn("id_key", F.coalesce("doc_id", F.lit(NULL_ID)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "id_key", "digest")).alias("first")
    chosen = found.filter("n > 0").groupBy("root").agg(first).select("first.id_key", "first.digest")
    wordless = found.filter("n = 0").select("id_key", "digest").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = ["id_key", "digest"]
    named = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, named, strict=True)), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id_key"), F.xxhash64(text).alias("digest"))
    kept = keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).unionByName(keyed.join(wordless, keys, "left_semi"))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, named, strict=True)))
