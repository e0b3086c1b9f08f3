"""The MinHash forest, against all pairs."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from loam.llm import minhash_forest, queries


def brute(rows, percent=80):
    sets = [minhash_forest.shingles((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in df.collect())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return words


VOCABULARY = [f"w{k}" for k in range(400)]


def corpus(seed, groups=25, base=30):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  words", "é É", "ü", "a a a a a", "a a"]
    for _ in range(groups):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(base, 5 * base))]
        texts += [" ".join(edited(r, words, r.randint(0, len(words) // 9))) for _ in range(r.randint(1, 12))]
    texts += r.sample(texts, 20)
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as id", "'x' as node", "2 as n", "3 as labels", "4 as t1", "5 as u1")
    assert got(minhash_forest.near_duplicates(df)) == brute(rows)


def test_a_group_of_near_copies_beyond_a_region_and_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest.across, "__defaults__", (False, None, 8, 16))
    r = random.Random(7)
    words = [r.choice(VOCABULARY) for _ in range(120)]
    # similarities between two of them are about the threshold; far ones join by chains or not at all
    rows = [(i, " ".join(edited(r, words, r.choice([2, 5, 8, 14])))) for i in range(150)] + corpus(11, 4)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert got(minhash_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repeated_null_ids_long_and_empty(spark):
    long = " ".join(VOCABULARY[k * k % 400] + str(k % 97) for k in range(60_000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A B C D E F"), (None, None), (8, long), (2, long + " end")]
    out = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in minhash_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[5, 5] == (5, True) and out[None, 5] == (5, False) and out[None, 0] == (None, True)
    assert {k[0]: v for k, v in out.items() if k[1] > 100} == {8: (2, False), 2: (2, True)}
    assert minhash_forest.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_estimate_is_close_and_the_floor_below_it():
    r = random.Random(3)
    off = []
    for _ in range(200):
        a = {b"%d" % r.getrandbits(60) for _ in range(300)}
        b = set(r.sample(sorted(a), 270)) | {b"%d" % r.getrandbits(60) for _ in range(30)}
        hashed = [np.array([minhash_forest.xxhash.xxh64_intdigest(x) for x in s], np.uint64) for s in (a, b)]
        same = (minhash_forest.signature(hashed[0]) == minhash_forest.signature(hashed[1])).mean()
        off.append(same - 270 / 330)
    assert abs(np.mean(off)) < 0.01 and 0.03 < np.std(off) < 0.05
    assert minhash_forest.least_equal(80) == 62


def test_parity_never_rules_out_a_link():
    r = random.Random(4)
    for _ in range(300):
        a = {r.getrandbits(60) for _ in range(r.choice([3, 30, 300, 3000]))}
        b = set(r.sample(sorted(a), max(1, int(len(a) * r.uniform(0.7, 1))))) | {r.getrandbits(60) for _ in range(r.randint(0, len(a) // 6))}
        hashed = [np.array([minhash_forest.xxhash.xxh64_intdigest(b"%d" % x) for x in s], np.uint64) for s in (a, b)]
        of = minhash_forest.Sketches([bytes(100)] * 2, [minhash_forest.parity(h) for h in hashed], np.array([len(a), len(b)]), [b"a", b"b"], 80)
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert of.may(np.array([0]), np.array([1]))[0]


def test_sql_equals_all_pairs():
    rows = corpus(5)
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841 - read by the query
    have = con.execute(queries.ORACLE_SQL["op11_minhash_forest"]).fetchall()
    assert sorted(have) == brute(rows)
