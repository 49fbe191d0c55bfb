"""Language ID and toxicity: held-out accuracy and odd rows."""

from claimweave.llm import languages, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    got = queries.op2_languages(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_families():
    assert languages.family_of("en") == languages.family_of("de") != languages.family_of("fr") and languages.family_of("xx") == "xx"


def test_languages_odd_rows(spark, odd_docs, no_docs):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    model = languages.fit(known)
    got = languages.predict(odd_docs, model, odd_docs.columns, ("found", "sure")).toPandas()
    assert len(got) == 11 and set(got[got.doc_id.isin([3, 4, 5, 7])].found) == {"und"} and set(got[got.doc_id.isin([3, 4, 5, 7])].sure) == {0.0}
    assert "und" not in set(got[~got.doc_id.isin([3, 4, 5, 7])].found) and got[got.doc_id == 8].sure.nunique() == 1
    assert languages.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in languages.identify(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1).eqNullSafe("x").cast("string")).filter("false").unionByName(odd_docs)).collect()} <= {"en", "fr", "es", "de", "und"}


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    score, bonds = np.array([0.3, -1.2, 2.0, 0.1]), np.array([[0.2, -0.5], [0.4, 1.1]])
    chain = np.array([0, 0, 0, 1])
    weight = {}
    for y in itertools.product((0, 1), repeat=4):
        total = sum(s * k for s, k in zip(score, y)) + bonds[y[0], y[1]] + bonds[y[1], y[2]]
        weight[y] = np.exp(total)
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(4)]
    got, pairs = toxicity.marginals(score, chain, bonds)
    assert np.allclose(got, want)
    both = sum(w * (np.array([(y[0], y[1]) == (1, 1), (y[1], y[2]) == (1, 1)]).sum()) for y, w in weight.items()) / sum(weight.values())
    assert np.isclose(pairs[1, 1], both)


def test_blocks_do_not_change_marginals():
    import numpy as np

    rnd = np.random.default_rng(2)
    lengths = [1, 2, 3, 4, 5, 7, 8, 9, 40, 1, 23]
    chain = np.repeat(np.arange(len(lengths)), lengths)
    score, bonds = rnd.normal(size=len(chain)) * 2, rnd.normal(size=(2, 2))
    want, both = toxicity.marginals(score, chain, bonds, 1000)
    for block in (1, 2, 4, 7):
        got, pairs = toxicity.marginals(score, chain, bonds, block)
        assert np.allclose(got, want) and np.allclose(pairs, both)


def test_long_text_without_sentence_ends(spark):
    """5 MB, every token marked: linear time, offsets in code points."""
    import numpy as np

    weights = np.zeros(1 << toxicity.BITS)
    model = toxicity.Model(weights, 3.0, np.zeros((2, 2)), np.zeros(4))
    text = "wörter " * 700_000
    (row,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).selectExpr("size(spans) n", "spans[699999] s").collect()
    assert row["n"] == 700_000 and (row["s"]["start"], row["s"]["end"]) == (7 * 699_999, 7 * 699_999 + 6)


def test_toxicity_on_planted_words(spark):
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, f"plain words about topic{i % 7} here. " + ("you vilething are vilest of all. " if toxic else "nothing else follows. ") * 2, int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = toxicity.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.held_out.sum() > 40 and (got[got.held_out].predicted == got[got.held_out].toxic).all()
    model = toxicity.fit(docs, labels)
    text = "Früher: a VILEST thing."
    (spans,) = [r["spans"] for r in toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()]
    assert "VILEST" in [text[s["start"] : s["end"]] for s in spans]


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 1), (2, 0, 1), (6, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, toxic int, score int")
    got = toxicity.judge(odd_docs, labels).toPandas()
    assert len(got) == 11 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert toxicity.judge(no_docs, labels).count() == 0
    assert set(toxicity.judge(odd_docs, labels.filter("false")).toPandas().score) == {0.0}
