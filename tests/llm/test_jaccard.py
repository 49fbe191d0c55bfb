"""The Jaccard join against brute force over word shingles."""

import random
import re

import pytest

from claimweave.llm import jaccard_join
from claimweave.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    home = list(range(len(rows)))

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                home[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def planted(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0

    def put(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    common = [rnd.choice(vocabulary) for _ in range(40)]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            put(words)
    for i in range(40):  # a passage that many documents share
        put([rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))] + common + [f"u{i}"])
    drift = [rnd.choice(vocabulary) for _ in range(60)]
    for i in range(25):  # a chain in which only neighbours are alike
        drift = [*drift[1:], f"x{i}"]
        put(drift)
    for _ in range(5):
        put(["one", "two"])
    return rows


@pytest.mark.parametrize("seed, k, percent", [(1, 3, 90), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = planted(seed)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, percent)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in jaccard_join.join(odd_docs).collect()), key=repr) == brute(rows, 3, 90)
    assert jaccard_join.join(no_docs).count() == 0
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 7, 8, None, None], key=repr)


def test_rest_pairs_find_links_behind_a_false_leader():
    import pyarrow as pa

    n, bits = [100, 100, 100], [0, 0, 0]
    table = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array(n, pa.int32()), pa.array([5, 6, 7]), *[pa.array(bits)] * 3, pa.array([5, 6, 6])], names=["tile", "n", "cls", "b0", "b1", "b2", "root"])
    got = [tuple(r.values()) for b in jaccard_join._star_pairs(jaccard_join._rest_pairs(90)(iter([table]))) for r in b.to_pylist()]
    assert sorted(set(got)) == [(5, 6), (5, 7)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("part, steps", [(1 << 16, 0), (100, None)])
def test_components_of_many_links(spark, monkeypatch, part, steps):
    """Links that fit one part take no star step at all; more links give the same roots."""
    from claimweave.llm import components as module

    taken, star = [], module._small_star
    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "_small_star", lambda links: taken.append(1) or star(links))
    rnd = random.Random(part)
    pairs = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(600)]
    want = {i: i for i in range(900)}
    for _ in range(900):
        before = dict(want)
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want[x] for x in linked}
    assert steps is None or len(taken) == steps


@pytest.mark.parametrize("edits", [3, 6, 9])
def test_one_tile_with_a_third_of_all_rows(spark, edits):
    """Near copies of one text, all different, share their prefix shingles: linked, in part, or not at all."""
    rnd = random.Random(edits)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(200), edits):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rnd.choice(base) for _ in range(30))) for i in range(300)]
    found = jaccard_join.members(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, part_rows=16)
    got = found.select("doc_id", "n", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 90)
