import random

from claimweave.operators import conflicts as C


def test_opponents_without_rejoining_the_values(spark):
    rnd = random.Random(4)
    rows = [(i, "p", rnd.choice("ab"), rnd.choice("xyz"), rnd.choice([None, "1", "2"])) for i in range(60)] + [(100, "p", "c", "x", None)]
    facts = spark.createDataFrame(rows, "claim_id long, project_id string, predicate string, value string, version_min string")
    out = C.value_conflicts(facts)
    against = lambda r, o: r[2] == o[2] and r[3] != o[3] and (not r[4] or not o[4] or r[4] == o[4])
    want = {}
    for r in rows:
        if found := [o[0] for o in rows if against(r, o)]:
            want[r[0]] = (len(found), min(found))
    assert {r.claim_id: (r.n_opponents, r.opponent) for r in out.collect()} == want
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slots_of_any_size_are_compared_alike(spark):
    rnd = random.Random(6)
    rows = [(i, "p", rnd.choice("aaaab"), rnd.choice("wxyz"), rnd.choice([None, "", "1", "2"])) for i in range(90)]
    rows += [(200, "p", "a", None, "1"), (201, None, "a", "x", None), (202, "p", "lone", "x", None)]
    facts = spark.createDataFrame(rows, "claim_id long, project_id string, predicate string, value string, version_min string")
    against = lambda r, o: None not in (r[1], r[3], o[1], o[3]) and r[2] == o[2] and r[3] != o[3] and (not r[4] or not o[4] or r[4] == o[4])
    want = {r[0]: (len(found), min(found)) for r in rows if (found := [o[0] for o in rows if against(r, o)])}
    for limit in (0, 30, 1000):  # all slots are large, one is, none is
        got = C.value_conflicts(facts, slot_rows=limit).collect()
        assert len(got) == len(want) and {r.claim_id: (r.n_opponents, r.opponent) for r in got} == want


def test_facts_move_once_to_their_slot(spark):
    facts = spark.range(200).selectExpr("id AS claim_id", "'p' AS project_id", "id % 5 AS predicate", "CAST(id % 7 AS STRING) AS value", "CAST(id % 2 AS STRING) AS version_min")
    out = C.value_conflicts(facts)
    assert out.count() == 200
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") <= 2  # slots are counted, facts are dealt
