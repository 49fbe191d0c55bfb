"""Operator 13: near duplicates by a chosen-path set similarity join on minwise tokens.

1. Each text's shingle set becomes a profile: size, a hash of the set, ``COORDINATES`` minwise tokens (the
   least hash of the set under as many hash functions) and a parity bitmap. Equal sets fold into a class.
2. A tree branches the classes: at the root by one of the minwise tokens, below by a token (sometimes two)
   that the path itself chooses, so two similar sets take the same branch as often as they are similar.
   Nodes of up to ``SMALL`` classes are compared exhaustively: all pairs whose sizes and bitmaps allow
   the similarity (a proven bound, nothing similar is lost by it). Larger nodes branch on.
3. The first trees name only a spanning forest of a node's pairs (in a node that stays large, everything
   against one class of it), which finds groups of copies with about one pair a class. Links are
   confirmed on the full sets; linked classes get a common root.
4. More independent trees then look only at nodes that hold several roots, at their pairs of different
   roots: first those that span a node (fewer than it has roots), then a few between a class and another
   root, then all that are still needed. A node that
   stays large is compared in blocks: what isn't in its commonest root, a block at a time, against chunks
   of the whole node, so no task holds more than a block and a chunk.

``recall(similarity)`` gives the share of pairs that a set of trees brings together, for nodes as deep
as they may get; at the threshold the registered settings miss less than one pair in 10,000 even there.
A link missed between two texts only matters if no chain of other links connects them.

Defined results: sets are compared as 64-bit hashes; null or wordless texts have no shingle and no link;
a text with fewer words than a shingle is one shingle; null ids keep a null id, and their component is
the least known id in it; repeated rows and ties are equal sets; very long texts are hashed one at a
time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm.batches import text_slices, texts_of
from claimweave.llm.components import components
from claimweave.llm.exact_sets import PASSES, SPAN, blocks, exact_sets, named, set_hash, similar
from claimweave.llm.shingles import mix, shingle_sets

COORDINATES = 64
WIDE_BITS = 2048
SMALL = 256
#: Bits of the bitmap that goes along to the nodes.
NARROW_BITS = 512
#: Classes of two parts of a large node that a task compares.
BLOCK = 2048
#: One path in so many goes on by two tokens.
FORK = 4


@dataclass(frozen=True)
class Trees:
    first: int
    count: int
    depth: int


FOREST, WHOLE = Trees(0, 4, 3), Trees(4, 12, 5)


def recall(similarity: float, trees: Trees = WHOLE) -> float:
    """Share of pairs of that similarity that meet in a node of the last level (shallower nodes find more)."""
    meet = 1.0
    for _ in range(trees.depth):
        once = similarity * meet
        meet = once * (1 - 1 / FORK) + (1 - (1 - once) ** 2) / FORK
    return 1 - (1 - meet) ** trees.count


_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _parity(hashes: np.ndarray, bits: int) -> bytes:
    """Which buckets hold an odd number of the hashes."""
    return np.packbits((np.bincount((mix(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of each set (none empty), a row a set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat((joined * m) >> np.uint64(32), starts) for m in _MULTIPLIERS], axis=1).astype(np.uint32)


PROFILE = "doc_id long, digest long, n int, cls long, tokens binary, narrow binary, wide binary"


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """One row a document (doc_id, text, digest): its set's size, hash, minwise tokens and bitmap."""

    def run(batches):
        for batch in text_slices(batches):
            sets = shingle_sets(texts_of(batch), size)
            filled = [x for x in sets if len(x)]
            rows = iter(minwise(filled)) if filled else iter(())
            told = [(len(x), set_hash(x), next(rows).tobytes(), _parity(x, NARROW_BITS), _parity(x, WIDE_BITS)) if len(x) else (0, 0, b"", b"", b"") for x in sets]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], names=["doc_id", "digest", "n", "cls", "tokens", "narrow", "wide"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, PROFILE)


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.uint64)


def _child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node ^ mix(coordinate.astype(np.uint64) + np.uint64(1))) + token)


MEMBER = "node long, cls long, root long"


def _rows(nodes: list[np.ndarray], which: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    take = pa.array(np.concatenate(which))
    node = pa.array(np.concatenate(nodes).view(np.int64))
    return pa.RecordBatch.from_arrays([node, batch.column("cls").take(take), batch.column("root").take(take)], names=["node", "cls", "root"])


def _roots_of(trees: Trees):
    """Classes in; their nodes at the first level of each tree."""

    def run(batches):
        for batch in batches:
            tokens, each = _tokens(batch), np.arange(batch.num_rows)
            nodes = []
            for t in range(trees.first, trees.first + trees.count):
                start = np.full(len(each), mix(np.array([t + 1], dtype=np.uint64))[0])
                at = np.full(len(each), t % COORDINATES)
                nodes.append(_child(start, at, tokens[each, at]))
            yield _rows(nodes, [each] * len(nodes), batch)

    return run


def _branch(batches):
    """Members of nodes with their tokens in; their nodes one level deeper."""
    for batch in batches:
        tokens, each = _tokens(batch), np.arange(batch.num_rows)
        node = batch.column("node").to_numpy().view(np.uint64)
        first, second = (mix(node + np.uint64(k)) for k in (1, 2))
        at = (first % np.uint64(COORDINATES)).astype(np.int64)
        fork = np.flatnonzero(second % np.uint64(FORK) == 0)
        also = (mix(second) % np.uint64(COORDINATES)).astype(np.int64)[fork]
        yield _rows([_child(node, at, tokens[each, at]), _child(node[fork], also, tokens[fork, also])], [each, fork], batch)


def _near(n: np.ndarray, bits: np.ndarray, u: int, pool: np.ndarray, percent: int) -> np.ndarray:
    """Those of the pool whose sizes and bitmaps allow them to be similar to u."""
    both = n[pool] + n[u]
    pool = pool[(100 + percent) * np.minimum(n[pool], n[u]) >= percent * both]  # smaller / larger at least percent / 100
    overlap = (n[pool] + n[u] - np.bitwise_count(bits[pool] ^ bits[u]).sum(axis=1, dtype=np.int64)) // 2
    return pool[(100 + percent) * overlap >= percent * (n[pool] + n[u])]


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _compare(percent: int, forest: bool, most: int | None):
    """Rows sorted by node in (nodes of SMALL classes at most); pairs that may be similar out, or a forest that spans them."""

    def node_pairs(cls, n, bits, root):
        out_a, out_b = [], []
        if not forest:
            for u in range(len(cls) - 1):
                pool = np.arange(u + 1, len(cls))
                near = named(_near(n, bits, u, pool[root[pool] != root[u]], percent), u, cls, root, most)
                out_a.append(np.full(len(near), cls[u]))
                out_b.append(cls[near])
            return out_a, out_b
        pool = np.arange(len(cls))
        while len(pool) > 1:
            open_, pool = [int(pool[0])], pool[1:]
            while open_ and len(pool):
                u = open_.pop()
                near = _near(n, bits, u, pool, percent)
                out_a.append(np.full(len(near), cls[u]))
                out_b.append(cls[near])
                pool = np.setdiff1d(pool, near, assume_unique=True)
                open_ += near.tolist()
        return out_a, out_b

    def run(batches):
        held = None
        for batch in _and_end(batches):
            table = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
            if table is None or not table.num_rows:
                continue
            node = table.column("node").to_numpy()
            # the last node may go on in the next batch
            until = table.num_rows if batch is None else int(np.searchsorted(node, node[-1]))
            held = table.slice(until)  # of a small node: SMALL rows at most
            if not until:
                continue
            done = table.slice(0, until)
            n, cls, root = (done.column(c).to_numpy().astype(np.int64) for c in ("n", "cls", "root"))
            bits = _bits(done.column("narrow"))
            edges = [0, *(np.flatnonzero(np.diff(node[:until])) + 1).tolist(), until]
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                order = s + np.argsort(cls[s:e])
                x, y = node_pairs(cls[order], n[order], bits[order], root[order])
                a += x
                b += y
            yield _pairs(a, b)

    return run


def _and_end(batches):
    yield from batches
    yield None


def _against_one(percent: int):
    """(cls, n, bits, cls_1, n_1, bits_1) in; pairs that may be similar out."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("n").to_numpy().astype(np.int64), batch.column("n_1").to_numpy().astype(np.int64)
            overlap = (x + y - np.bitwise_count(_bits(batch.column("bits")) ^ _bits(batch.column("bits_1"))).sum(axis=1, dtype=np.int64)) // 2
            ok = ((100 + percent) * np.minimum(x, y) >= percent * (x + y)) & ((100 + percent) * overlap >= percent * (x + y))
            yield _pairs([batch.column("cls").to_numpy()[ok]], [batch.column("cls_1").to_numpy()[ok]])

    return run


class Join:
    """State of one run: the classes, what was compared so far, and the links."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
        self.profiles = self.stored(profiles(self.docs, size), "profiles")
        filled = self.profiles.filter("n > 0")
        self.classes = self.stored(filled.groupBy("n", "cls").agg(F.min("doc_id").alias("first_id"), F.min("digest").alias("digest"), *(F.first(c).alias(c) for c in ("tokens", "narrow", "wide"))), "classes")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(self.spark, f"chosen-path-{name}")
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def rooted(self, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return self.classes.withColumn("root", F.col("cls"))
        return self.classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def leaves(self, trees: Trees, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(node, cls, many) of the nodes to compare, small ones and those that stay large."""
        members = self.rooted(roots).select("tokens", "cls", "root").mapInArrow(_roots_of(trees), MEMBER)
        small, large = None, None
        for level in range(trees.depth):
            members = self.stored(members, "members")  # read twice: counted, and joined with the counts
            sizes = members.groupBy("node").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
            sizes = sizes.filter("many > 1 and low <> high").select("node", "many")
            live = self.stored(members.join(sizes, "node"), "nodes")
            few = live.filter(F.col("many") <= SMALL)
            small = few if small is None else small.unionByName(few)
            large = live.filter(F.col("many") > SMALL)
            if level + 1 == trees.depth or large.isEmpty():
                break
            tokens = self.classes.select("cls", "tokens")
            members = large.select("node", "cls", "root").join(tokens, "cls").select("node", "cls", "root", "tokens").mapInArrow(_branch, MEMBER)
        columns = ["node", "cls", "many"]
        return self.stored(small.select(columns), "small"), self.stored(large.select(columns), "large")

    def candidates(self, small: DataFrame, large: DataFrame, roots: DataFrame | None, most: int | None) -> DataFrame:
        """Pairs (a, b) of the leaves that may be similar; with roots, only pairs that would join two of them."""
        sides = self.rooted(roots).select("cls", "root", "n", "narrow")
        placed = small.select("node", "cls").join(sides, "cls").repartition("node").sortWithinPartitions("node")
        pairs = placed.mapInArrow(_compare(self.percent, roots is None, most), "a long, b long")
        if not large.isEmpty():
            filled = large.join(sides, "cls")
            pairs = pairs.unionByName(self.stars(filled) if roots is None else blocks(filled, "node", ["narrow"], _near, self.percent, BLOCK, most))
        return pairs.distinct()

    def stars(self, large: DataFrame) -> DataFrame:
        """Everything in a large node against one class of it."""
        one = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("cls", "node").alias("draw"), F.col("cls").alias("cls_1"), F.col("n").alias("n_1"), F.col("narrow").alias("bits_1"))).alias("one"))
        met = large.join(one.select("node", "one.cls_1", "one.n_1", "one.bits_1"), "node").filter("cls <> cls_1")
        return met.select("cls", "n", F.col("narrow").alias("bits"), "cls_1", "n_1", "bits_1").mapInArrow(_against_one(self.percent), "a long, b long")

    def wide(self, pairs: DataFrame) -> DataFrame:
        """Those pairs that the wide bitmaps allow as well."""
        side = self.classes.select("cls", "n", F.col("wide").alias("bits"))
        both = pairs.join(side.withColumnsRenamed({"cls": "a"}), "a").join(side.withColumnsRenamed({"cls": "b", "n": "n_1", "bits": "bits_1"}), "b")
        return both.select(F.col("a").alias("cls"), "n", "bits", F.col("b").alias("cls_1"), "n_1", "bits_1").mapInArrow(_against_one(self.percent), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets are similar."""
        asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        keys = self.stored(self.classes.select("cls", "digest").join(asked, "cls"), "asked")
        sets = self.stored(exact_sets(self.docs, keys, self.size), "sets")
        return self.stored(similar(pairs, sets, self.percent), "links")

    def roots(self) -> DataFrame:
        """(node, root) of the classes that have a link."""
        tested = self.stored(self.candidates(*self.leaves(FOREST, None), None, None), "named")
        links = self.confirmed(self.stored(self.wide(tested), "allowed"))
        roots = self.stored(components(links), "roots")
        leaves = self.leaves(WHOLE, roots)
        # one class of a large node is like few of its others, so most roots there are still apart: pairs that span
        # the nodes join them, before any pass that may name several pairs of two roots
        for most in (SPAN, *PASSES):
            more = self.stored(self.candidates(*leaves, roots, most).join(tested, ["a", "b"], "left_anti"), "more")
            if not more.isEmpty():
                found = self.confirmed(self.stored(self.wide(more), "allowed"))
                tested = tested.unionByName(more)
                if not found.isEmpty():
                    # the roots so far connect what all links so far do, by a row a class
                    known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
                    roots = self.stored(components(known.unionByName(found)), "roots")
        return roots


def dedup(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): sets of ``size``-word shingles, linked from ``percent`` % similarity on."""
    run = Join(docs, size, percent)
    placed = run.rooted(run.roots()).select("cls", "root", "first_id")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("cls", "component_id")
    rows = run.profiles.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls")
    linked = rows.filter("n_shingles > 0").join(named, "cls").drop("cls")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
