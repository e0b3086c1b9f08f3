"""Fill-in-the-middle examples, against a plain definition."""

import hashlib
import random
import re

import duckdb
import pytest

from loam.llm import fill_middle, queries


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, x = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


def cases():
    r = random.Random(4)
    texts = [None, "", "\n", "\n\n", "one line", "a\nb", "a\n\nb\n", "with <P> marker\nx", "<S", "<M>", "<\nP>\n<", "\x01\x02\x02e\n\x01d\n\x02", "\r\n\x0b\x85 \n", "é😀\nñ\n" * 3, "$0 \\ $1\n" * 4]
    texts += ["".join(r.choice(["x", "\n", "<", "P>", "S>", "M", "\x01", "\x02", "e", "d", "é"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    return [(i * 37 - 5, t) for i, t in enumerate(texts)] + [(None, "null\nid\n"), (3, "same\nid\n"), (3, "same\nid\n"), (4, "long line " * 30_000 + "\n" + "x\n" * 30_000)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 50), (100, 0), (100, 100), (0, 50)])
def test_examples_equal_the_definition(spark, rate, spm):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as form", "1 as n", "'y' as marked", "2 as id")
    key = lambda t: repr(t)
    got = sorted(((x.doc_id, x.n, x.form, x.prefix, x.middle, x.output) for x in fill_middle.transform(df, rate=rate, spm=spm).collect()), key=key)
    assert got == sorted(((i, *brute(i, t, rate, spm)) for i, t in rows), key=key)


def test_digests_restore_every_text(spark):
    rows = cases()
    got = {(x.doc_id, x.output_sha256): x for x in fill_middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n, form, p, m, out = brute(i, t)
        x = got[i, hashlib.sha256(out.encode()).hexdigest()]
        assert (x.n, x.form, x.prefix_chars, x.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert x.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert fill_middle.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_equals_the_definition():
    import pandas as pd

    rows = [(i, t) for i, t in cases() if i is not None]
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841 - read by the query
    got = con.execute(queries.ORACLE_SQL["op13_fill_middle"]).fetchdf()
    have = sorted((int(a), int(b), c, d, e) for a, b, c, d, e in got[["doc_id", "n", "form", "output_sha256", "restored_sha256"]].itertuples(index=False))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert have == sorted((i, brute(i, t)[0], brute(i, t)[1], sha(brute(i, t)[4]), sha(t)) for i, t in rows)


def test_no_python_and_no_shuffle(spark):
    plan = fill_middle.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
