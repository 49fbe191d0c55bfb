"""Source mixing and URL filters beside their SQL, and the mix's promises."""


import duckdb


from claimweave.llm import mixing, queries, url_filters


def same(got, tables, sql):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    key = repr
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).select("doc_id", "size", "source_size", "target", "taken")
    same(got, {"documents": odd_docs}, queries.CHECKS["op5_mixing"])
    assert mixing.mix(no_docs).count() == 0 and mixing.copies(no_docs).count() == 0
    assert mixing.copies(odd_docs).schema == odd_docs.schema


def test_mix_meets_targets(spark):
    rows = [(i, "word " * (1 + i % 90), None if i % 31 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(3)).toPandas()
    assert (first.sort_values("doc_id").taken.values == again.sort_values("doc_id").taken.values).all()
    assert (first.taken <= 3 * first["size"]).all() and abs(first.groupby("source", dropna=False).target.first().sum() - first["size"].sum()) < 1e-6 * first["size"].sum()
    by = first.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert (abs(by.taken - by.target) / by.target < 0.01).all() and (by.target <= 3 * by.own).all()


def test_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "w " * 1000, "a"), (2, "w " * 10, "b"), (3, "w " * 10, "c"), (4, None, "d")], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(docs)).collect()}
    assert got == {"a": 960.0, "b": 30.0, "c": 30.0, "d": 0.0}


def test_suffixes_and_addresses(spark):
    hosts = ["a.b.com.sg", "x.co.il", "www.org.nz:80", "q.r.s.example.dev", "10.0.0.1:8080", "[::1]:80", "com", "", "a.kyoto.jp"]
    rows = spark.createDataFrame([(h, 1, 0) for h in hosts], "host string, n long, bad long")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_filters._levels(rows).collect()}
    assert got["a.b.com.sg"] == ("com.sg", "b.com.sg") and got["x.co.il"] == ("co.il", "x.co.il") and got["www.org.nz:80"] == ("org.nz", "www.org.nz")
    assert got["q.r.s.example.dev"] == ("dev", "example.dev") and got["10.0.0.1:8080"] == ("address", "10.0.0.1") and got["[::1]:80"] == ("address", "[::1]")
    table = spark.createDataFrame([("jp",), ("kyoto.jp",), ("example.dev",), ("com",), (None,)], "suffix string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_filters._levels(rows, table).collect()}
    assert got["a.kyoto.jp"] == ("kyoto.jp", "a.kyoto.jp") and got["q.r.s.example.dev"] == ("example.dev", "s.example.dev") and got["a.b.com.sg"] == ("sg", "com.sg")


def test_bad_hosts_are_blocked_at_any_overall_rate(spark):
    """Ten of forty hosts are several times as bad as the others."""
    for often in (10, 3):  # every so many-th page of a common host is bad
        rows = [(f"h{h}.site{h}.org", 1 if (h < 10 and i % 10 < 9) or (h >= 10 and i % often == 0) else 0) for h in range(40) for i in range(60)]
        found = url_filters.reputations(spark.createDataFrame(rows, "host string, bad long")).filter("bound >= bar").select("host")
        assert sorted(r["host"] for r in found.collect()) == sorted(f"h{h}.site{h}.org" for h in range(10))


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/fr/", "http://a.example.com/en/2#f", "http://example.com", "http://x.net/es/3", "https://x.net/fr/", "https://x.net?/fr/", "http://xnet/fr/9", "http://a.co.uk:80/de/4", "ftp://b.a.co.uk/de/5", "http://com/", "http://a.org/en/1", "http://a.org/en/1", "http://b.org/en/2\n://x", "http://ü.org/en/3"]
    urls += [f"http://bad.org/en/{i}" for i in range(40, 80)]
    urls += [f"http://good{i % 9}.net/en/{i}" for i in range(len(urls), 400)]
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)] + [(None, "http://a.org/en/1", None, None)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (3, None, None), (4, 1, None), (None, 0, 1)] + [(i, 0, 1) for i in range(40, 80)] + [(i, 1, 0) for i in range(80, 400)], "doc_id long, quality int, toxic int")
    got = url_filters.judge(pages, labels).drop("bound")
    same(got, {"pages": pages, "labels": labels}, queries.CHECKS["op9_url_filters"])
    said = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got.collect()}
    assert said["www.example.com", "/en/1"] == ("www.example.com/en/", "allow") and said["a.example.com", "/en/2"] == ("example.com/en/", "block")
    assert said["x.net", ""] == (None, "allow") and said["xnet", "/fr/9"][0] is None and said["bad.org", "/en/40"] == (None, "block")
    assert url_filters.judge(pages.filter("false"), labels).count() == 0
    assert url_filters.judge(pages, labels.filter("false")).count() == pages.count()
