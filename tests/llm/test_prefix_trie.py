"""The prefix trie, against a plain trie of nested tuples."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from loam.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows, group=100, kinds=6, shared_heads=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not shared_heads:
        return own
    h = {c: zlib.crc32(str(c).encode()) % kinds for c in own}
    return {c: own.get(c - c % group, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(seqs):
    members, ends = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) > len(q) and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(x[c] for c in COLUMNS) for x in df.collect()), key=repr)


def talk(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), n):
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None, "😀 long text"])))
    r.shuffle(rows)
    seen = set()
    return [x for x in rows if not ((x[0], x[1]) in seen or seen.add((x[0], x[1])))]


@pytest.mark.parametrize(("seed", "ranges", "run_rows"), [(0, None, 50_000), (1, 1, 3), (2, 7, 5), (3, 60, 1), (4, 13, 50_000)])
def test_trie_equals_the_definition(spark, monkeypatch, seed, ranges, run_rows):
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run_rows)
    rows = talk(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as units", "2 as key", "'x' as node", "3 as depth")
    made = prefix_trie.rebuilt(prefix_trie.units(df))
    assert rows_of(prefix_trie.trie(prefix_trie.keyed(made), ranges)) == brute(sequences(rows))


def test_own_sequences_copies_and_turnless(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(c, t, "user", "x" * t) for c in range(300, 310) for t in range(c - 299)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = prefix_trie.trie(prefix_trie.keyed(prefix_trie.units(df)), 9)
    assert rows_of(made) == brute(sequences(rows, shared_heads=False))
    named = {x.node: x for x in made.collect()}
    assert all((x.parent is None) == (x.depth == 0) and (x.parent is None or named[x.parent].depth == x.depth - 1) for x in named.values())
    lone = [(7, None, None, None)]  # a conversation with fewer turns than it hands over, and without a leader
    assert rows_of(prefix_trie.trie(prefix_trie.keyed(prefix_trie.rebuilt(prefix_trie.units(spark.createDataFrame(lone, SCHEMA)))))) == brute(sequences(lone))


def test_empty_null_ids_and_long(spark):
    empty = prefix_trie.trie(prefix_trie.keyed(prefix_trie.units(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))))
    assert empty.count() == 0
    rows = [(c, t, "user", "same") for c in (5, 6) for t in range(3000)] + [(6, 3000, "user", "y" * 200_000)]
    got = prefix_trie.trie(prefix_trie.keyed(prefix_trie.units(spark.createDataFrame(rows, SCHEMA))), 4).orderBy("depth").collect()
    assert [x.depth for x in got] == list(range(3002)) and got[0].saved_tokens == 3000 * 4 and {x.n_leaves for x in got} == {1}


def test_merge_looks_at_few_turns_again():
    r = random.Random(2)
    base = [bytes([k]) * prefix_trie.UNIT for k in range(40)]
    keys = sorted({b"".join(base[: r.randint(20, 40)]) + bytes([r.randint(0, 255)]) * prefix_trie.UNIT for _ in range(400)})
    rows = [(k, 1, i, bytes(32)) for i, k in enumerate(keys)]
    runs = [rows[k::7] for k in range(7)]
    looked = []

    def compare(a, b, known):
        n = prefix_trie.shared(a, b, known)
        looked.append(n - known + 1)
        return n

    got = list(prefix_trie.merged([prefix_trie.decoded(*prefix_trie.encoded(x)) for x in runs], compare))
    assert [x[1] for x in got] == rows
    assert [c for c, _ in got[1:]] == [prefix_trie.shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    assert sum(looked) < 3 * len(rows) * 3  # comparing anew would look at some 30 turns for each of three matches a row
    assert list(prefix_trie.merged([])) == []


def test_sql_equals_the_definition():
    rows = talk(9)
    con = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841 - read by the query
    got = con.execute(queries.ORACLE_SQL["op12_prefix_trie"]).fetchall()
    names = [x[0] for x in con.description]
    assert sorted((tuple(dict(zip(names, x, strict=True))[c] for c in COLUMNS) for x in got), key=repr) == brute(sequences(rows))
