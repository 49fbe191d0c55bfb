"""Fill-in-the-middle against plain slicing, and back to the same text."""

import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from claimweave.llm import fill_middle


def expected(doc_id, text):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not n or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(0, 10**9), st.text(st.sampled_from("aé日🤦<P>SM "), max_size=40))
@settings(max_examples=500, deadline=None)
def test_one_text(doc_id, text):
    n, form, prefix, middle, output = fill_middle.arrange(text.encode(), fill_middle.draws(doc_id))
    assert (doc_id, n, form, prefix, middle, output.decode()) == expected(doc_id, text)
    assert fill_middle.rebuild(output, form) == text.encode()


def test_rotation():
    x = np.arange(10)
    fill_middle.rotate(x, 2, 5, 9)
    assert x.tolist() == [0, 1, 5, 6, 7, 8, 2, 3, 4, 9]


def test_whole_table(spark, odd_docs, no_docs):
    rows = [(i, f"word{i} été 日本 " * (i % 40)) for i in range(400)] + [(1000, "x" * 3_000_000 + "é"), (1001, "has <P> in it"), (1002, None)]
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in made.collect()) == sorted(expected(d, t or "") for d, t in rows)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    back = fill_middle.restore(made).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back)) == sorted((d, t or "") for d, t in rows)
    odd = fill_middle.restore(fill_middle.transform(odd_docs)).collect()
    assert sorted(r["restored"] for r in odd) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert fill_middle.restore(fill_middle.transform(no_docs)).count() == 0
