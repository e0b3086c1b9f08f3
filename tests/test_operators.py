"""Operators against golden cases, plain-Python definitions and properties."""

import random

import pytest

from loam.operators import apps, exact, greedy, minhash, ngrams, prefix, statistics, tree

ENTRY = "seq long, app_name string, text string"


def entries(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ENTRY)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def texts(df):
    return sorted(r.text for r in df.collect())


@pytest.mark.parametrize(("given", "kept"), [
    (["おはy", "おはよ", "おはよう"], ["おはよう"]),
    (["Hello", "Hello World", "Hello World from Swift"], ["Hello", "Hello World", "Hello World from Swift"]),
    (["123456789", "1234567890"], ["1234567890"]),
    (["abcdefghij", "abcdefgh", "abcdef"], ["abcdef", "abcdefghij"]),
    (["a", "ab", "abc"], ["a", "ab", "abc"]),
    (["same", "same"], ["same"]),
    (["", "x"], ["x"]),
])
def test_prefix_cases(spark, given, kept):
    assert texts(prefix.prefix_dedup(entries(spark, [("App", t) for t in given]))) == sorted(kept)


def test_prefix_across_apps(spark):
    assert prefix.prefix_dedup(entries(spark, [("App1", "おはよう"), ("App2", "おはよ"), ("App3", "おは")])).count() == 3


def greedy_prefix(rows):
    kept = []
    for seq, app, t in sorted(rows, key=lambda r: (-len(r[2]), r[0])):
        def covers(k, t=t, app=app):
            if k[1] != app or 10 * len(t) < 7 * len(k[2]):
                return False
            n = 0
            while n < len(t) and t[n] == k[2][n]:
                n += 1
            return k[2].startswith(t) or (len(t) >= 2 and len(k[2]) > len(t) and n >= 2 and 5 * n >= 3 * len(t))
        if t and not any(covers(k) for k in kept):
            kept.append((seq, app, t))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_against_definition(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["A", "B", None]), "".join(r.choice("ab") for _ in range(r.randint(0, 9)))) for _ in range(120)]
    df = entries(spark, rows)
    out = prefix.prefix_dedup(df)
    assert seqs(out) == greedy_prefix([(i, *x) for i, x in enumerate(rows)])
    assert seqs(prefix.prefix_dedup(out)) == seqs(out)


@pytest.mark.parametrize("span", [65_536, 7])
def test_adjacent_prefix_against_definition(spark, span):
    r = random.Random(3)
    rows = [(r.choice("AAB"), "".join(r.choice("ab") for _ in range(r.randint(1, 4)))) for _ in range(150)]
    kept = []
    for i, (app, t) in enumerate(rows):
        if kept and rows[kept[-1]][0] == app and (rows[kept[-1]][1].startswith(t) or t.startswith(rows[kept[-1]][1])):
            continue
        kept.append(i)
    assert seqs(prefix.adjacent_prefix(entries(spark, rows), span)) == kept


def test_longest_prefix(spark):
    words, known = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["abcd", "abx", "zz", ""], ["a", "abc", "b"]))
    assert {r.word: r.prefix for r in prefix.longest_prefix(words, known).collect()} == {"abcd": "abc", "abx": "a", "zz": None, "": None}


def test_exact_and_pairs(spark):
    df = entries(spark, [("A", "x1"), ("B", "x1"), ("A", "x1"), ("Finder", "y1"), ("A", "y1"), ("A", "z"), (None, "w1")])
    assert seqs(exact.exact_dedup(df, ["Finder"], 2)) == [0, 4, 6]
    assert seqs(exact.pair_dedup(df)) == [0, 1, 3, 4, 5, 6]
    row = exact.exact_dedup_stats(df, ["Finder"], 2).first()
    assert (row.processed, row.kept, row.removed, row.reduction_rate) == (5, 3, 2, 40.0)
    assert exact.exact_dedup_stats(df.limit(0)).first().processed == 0


@pytest.mark.parametrize("span", [65_536, 3])
def test_consecutive(spark, span):
    rows = [("A", "Abc"), ("B", "Abc"), ("A", "!!"), ("A", "Abc"), ("A", "Def"), ("A", "Abc")]
    assert seqs(exact.consecutive_dedup(exact.accepted(entries(spark, rows)), span=span)) == [0, 4, 5]
    r = random.Random(1)
    rows = [("A", r.choice("xy")) for _ in range(60)]
    want = [i for i in range(60) if not i or rows[i] != rows[i - 1]]
    assert seqs(exact.consecutive_dedup(entries(spark, rows), span=span)) == want


def test_greedy_rounds(spark):
    r = random.Random(2)
    pairs = {(b, a) for _ in range(150) for a, b in [sorted(r.sample(range(60), 2))]}
    kept = []
    for x in range(60):
        if not any((x, k) in pairs for k in kept):
            kept.append(x)
    df = spark.createDataFrame(sorted(pairs), "node long, before long")
    assert {x.node for x in greedy.dropped(df).collect()} == set(range(60)) - set(kept)
    assert greedy.dropped(df.limit(0)).count() == 0


def test_signatures(spark):
    df = entries(spark, [("A", "This is a test text."), ("B", "This  is a test text. "), ("A", "This is a different text."), ("A", "ab"), ("A", "")])
    got = {r.seq: r.signature for r in minhash.signatures(df).collect()}
    assert all(len(s) == 20 for s in got.values()) and got[0] == got[1] != got[2] and got[4] == [0] * 20


@pytest.mark.parametrize("portable", [True, False])
def test_similar_dedup_against_sequential(spark, portable):
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ") for _ in range(60)) for _ in range(12)]
    rows = [("A", b[:k] + r.choice("xyz") + b[k + 1 :]) for b in base for k in [r.randint(1, 58) for _ in range(6)]] + [("A", base[0]), ("A", base[0])]
    df = entries(spark, rows)
    sig = {x.seq: x.signature for x in minhash.signatures(df, portable=portable).collect()}
    kept = []
    for i, (_, t) in enumerate(rows):
        if not any(2 * abs(len(t) - len(rows[k][1])) <= max(len(t), len(rows[k][1])) and sum(a == b for a, b in zip(sig[i], sig[k], strict=True)) >= 14 for k in kept):
            kept.append(i)
    assert seqs(minhash.similar_dedup(df, portable=portable)) == kept
    assert len({tuple(sig[i]) for i in seqs(minhash.same_signature_dedup(df, portable=portable))}) == len({tuple(s) for s in sig.values()})
    with pytest.raises(ValueError):
        minhash.same_signature_dedup(df, 0.9)


def test_bands():
    assert [minhash.bands(t) for t in (0.7, 0.95, 0.98)] == [7, 2, 1]


def test_statistics(spark):
    saved = entries(spark, [("A", "あいう"), ("A", "あいう"), ("B", "ab1"), ("Finder", "zz"), ("C", "!?")])
    imported = entries(spark, [("A", "あいう"), ("I", "12")])
    t = statistics.totals(saved, ["Finder"]).first()
    assert (t.entries, t.chars, t.mean_chars, t.duplicates, t.ja, t.en, t.num, t.other) == (3, 8, 2, 1, 3, 2, 1, 2)
    assert (t.ja_percent, t.en_percent, t.num_percent, t.other_percent) == (37, 25, 12, 25)
    by = {r.scope: (r.entries, r.duplicates) for r in statistics.separated_statistics(saved, imported).collect()}
    assert by == {"saved": (4, 1), "import": (2, 0), "combined": (5, 2)}
    mix = [r.key for r in statistics.language_mix(saved, ["Finder"]).collect()]
    assert mix == ["JA", "EN", "Num", "Other"]
    counts = spark.createDataFrame([(f"k{i}", 10 - i) for i in range(7)], "key string, value long")
    assert {r.key: r.value for r in statistics.top_and_others(counts, "key", "value").collect()} == {"k0": 10, "k1": 9, "k2": 8, "k3": 7, "k4": 6, "Others": 9}
    few = statistics.top_and_others(counts.limit(2), "key", "value", always_others=False)
    assert {r.key for r in few.collect()} == {"k0", "k1"}
    assert "Mean characters: 2" in statistics.summary(statistics.totals(saved, ["Finder"])).first().summary
    empty = statistics.totals(saved.limit(0)).first()
    assert (empty.entries, empty.mean_chars, empty.ja_percent) == (0, 0, 0)


def test_ngrams(spark):
    df = spark.createDataFrame([("abab",), ("a",), ("",)], "text string")
    got = {(r.n, r.gram): r.times for r in ngrams.counts(df, 3).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 2, (2, "ab"): 2, (2, "ba"): 1, (3, "aba"): 1, (3, "bab"): 1}
    twice = ngrams.merged(ngrams.counts(df, 3), ngrams.counts(df, 3))
    assert {(r.n, r.gram): r.times for r in twice.collect()} == {k: 2 * v for k, v in got.items()}
    kinds = {(r.n, r.gram): (r.left_kinds, r.right_kinds) for r in ngrams.continuations(ngrams.counts(df, 3)).collect()}
    assert kinds[1, "a"] == (1, 1) and kinds[2, "ab"] == (1, 1) and kinds[2, "ba"] == (1, 1)
    saved, new = entries(spark, [("A", str(i)) for i in range(5)]), entries(spark, [("B", "n")])
    assert sorted(r.text for r in ngrams.corpus(saved, new, 3).collect()) == ["3", "4", "n"]


def test_tree(spark):
    node = lambda i, p, role, value=None, title=None, description=None, subrole=None: (1, i, p, role, subrole, title, value, description, None)
    rows = [
        node(0, None, "AXWebArea", title="Window"), node(1, 0, "AXToolbar"), node(2, 1, "AXStaticText", ["hidden"]), node(3, 0, "AXGroup", ["in group"], "a title"),
        node(4, 3, "AXMessage", ["message"], "third", "second"), node(5, 3, "AXLink", ["https://x.org"]), node(6, 0, "AXButton", title="Close"), node(7, 0, "AXText", ["one", "two", "..."]),
        node(8, 0, None, ["no role"]), node(9, 0, "AXStaticText", ["secret"], subrole="AXSecureTextField"),
    ]
    rows += [(2, i, i - 1 if i else None, "AXGroup", None, None, [f"level {i}"], None, None) for i in range(13)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, subrole string, title string, value array<string>, description string, selected_text string")
    got = sorted((r.tree_id, r.node_id, r.position, r.text) for r in tree.extract(df).collect())
    assert [g[3] for g in got if g[0] == 1] == ["in group", "a title", "message", "second", "third", "https://x.org", "one", "two"]
    assert [g[3] for g in got if g[0] == 2] == [f"level {i}" for i in range(10)]
    tops = {(r.tree_id, r.node_id): (r.root_id, r.title) for r in tree.root_titles(df).collect()}
    assert tops[1, 4] == (0, "Window") and tops[2, 12] == (0, None)


def test_apps(spark):
    df = spark.createDataFrame([("Mail", "regular"), ("Agent", "accessory"), (None, "regular"), ("Editor", "regular"), ("Mail", "regular")], "app_name string, policy string")
    names = apps.running(df)
    assert [r.app_name for r in names.collect()] == ["Editor", "Mail"]
    assert [r.app_name for r in apps.search(names, "MAI").collect()] == ["Mail"] and apps.search(names, "").count() == 2
    assert [(r.app_name, r.excluded) for r in apps.listed(names, ["Finder", "Mail"]).collect()] == [("Editor", False), ("Finder", True), ("Mail", True)]
    assert [r.app_name for r in apps.excluded_present(names, ["Finder", "Mail"]).collect()] == ["Mail"]


def test_ngram_tables(spark, tmp_path):
    df, at = spark.createDataFrame([("aab",)], "text string"), str(tmp_path / "lm")
    assert not ngrams.extend(df, at)
    ngrams.rebuild(df, at, 2)
    assert ngrams.extend(df, at, 2)
    base, now = ({(r.n, r.gram): r.times for r in spark.read.parquet(f"{at}/{t}").collect()} for t in ("original", "current"))
    assert now == {k: 2 * v for k, v in base.items()} and base[1, "a"] == 2


def test_ngrams_count_every_row(spark):
    import __spark_entry__

    rows = spark.range(100_000).selectExpr("id as seq", "'app' as app_name", "'n' as text")
    saved = spark.createDataFrame([(1, "app", "saved")], "seq long, app_name string, text string")
    assert ngrams.corpus(saved, rows).where("text = 'saved'").count() == 1
    assert ngrams.corpus(saved, rows).count() == 100_001
    got = __spark_entry__.queries()["ngram_counts"](spark, "/root/testdata/sf0.001")
    assert sorted(r.n for r in got.select("n").distinct().collect()) == [1, 2, 3, 4, 5]
