"""Hot prefixes, hot bands, long texts and cut-off writes: rows and state stay in proportion, and nothing is lost."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam import catalogue
from loam.operators import exact, greedy, minhash, prefix, sweep
from loam.sources import jsonl
from loam.sources.log import Conflict, Log

ENTRY = "seq long, app_name string, text string"


def entries(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ENTRY)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_common_prefix():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in "ab")
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert sweep.common(a, b) == n


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sweep_finds_every_open_mark(spark, parts):
    r = random.Random(parts)
    marks = sorted({(r.choice([None, "A", "B"]), "".join(r.choice("ab") for _ in range(r.randint(0, 6)))) for _ in range(60)}, key=repr)
    texts = sorted({(r.choice([None, "A", "B"]), "".join(r.choice("ab") for _ in range(r.randint(0, 9)))) for _ in range(200)}, key=repr)
    of = lambda rows: spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(rows)], "group string, text string, x long")

    def run(batches):
        import pyarrow as pa

        out = [(x, m) for (_, x), stack in sweep.opened(batches, "x") for _, m in stack]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["text", "mark"])

    got = sorted((x.text, x.mark) for x in sweep.placed(of(marks), of(texts), parts).mapInArrow(run, "text long, mark long").collect())
    assert got == sorted((i, j) for i, (g, t) in enumerate(texts) for j, (h, m) in enumerate(marks) if g == h and t.startswith(m))


def covered(rows):
    kept = []
    for seq, app, t in sorted(rows, key=lambda r: (-len(r[2]), r[0])):
        def covers(k, t=t, app=app):
            if k[1] != app or len(k[2]) <= len(t) or 10 * len(t) < 7 * len(k[2]) or len(t) < 2:
                return False
            need = max(2, -(-3 * len(t) // 5))
            return k[2][:need] == t[:need]
        if t and not any(covers(k) for k in kept) and not any(k[1] == app and k[2] == t for k in kept):
            kept.append((seq, app, t))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_prefix_dedup_by_rounds_and_in_one_task(spark, monkeypatch, seed, small):
    monkeypatch.setattr(greedy, "SMALL", small)
    r = random.Random(seed)
    base = "".join(r.choice("abc") for _ in range(40))
    rows = [(r.choice(["A", None]), base[: r.randint(1, 40)] + "".join(r.choice("ab") for _ in range(r.randint(0, 6)))) for _ in range(150)]
    assert seqs(prefix.prefix_dedup(entries(spark, rows))) == covered([(i, *x) for i, x in enumerate(rows)])


def test_hot_prefix_makes_rows_in_proportion(spark):
    r = random.Random(5)
    rows = [("A", "p" * 60 + "".join(r.choice("abcd") for _ in range(r.randint(5, 25)))) for _ in range(3000)]
    held = exact.pair_dedup(entries(spark, rows)).withColumn("node", F.monotonically_increasing_id()).persist()
    asks, offers = prefix.prefix_conflicts(held.select("node", "app_name", "text"))
    assert offers.count() <= 60 * len(rows)  # the pairs of texts that cover each other are 3.9 million
    assert seqs(prefix.prefix_dedup(entries(spark, rows))) == covered([(i, *x) for i, x in enumerate(rows)])
    held.unpersist()


def test_typed_chain_and_long_lines(spark):
    line = "".join(random.Random(2).choice("abcdefgh ") for _ in range(240_000))
    typed = [("A", line[:n]) for n in range(1, 400)]
    assert seqs(prefix.prefix_dedup(entries(spark, typed))) == covered([(i, *x) for i, x in enumerate(typed)])
    rows = [("A", line), ("A", line[:200_000]), ("A", line[:100_000] + "x"), ("B", line[:200_000])]
    df = entries(spark, rows)
    prefix.prefix_dedup(entries(spark, rows[2:])).count()
    began = time.time()
    assert seqs(prefix.prefix_dedup(df)) == [0, 2, 3]
    assert time.time() - began < 20


def folded(rows):
    kept = []
    for i, (app, t) in enumerate(rows):
        if kept and rows[kept[-1]][0] == app and (rows[kept[-1]][1].startswith(t) or t.startswith(rows[kept[-1]][1])):
            continue
        kept.append(i)
    return kept


@pytest.mark.parametrize("span", [2, 7, None])
@pytest.mark.parametrize("kind", ["mixed", "one text", "growing", "short then long", "related to some"])
def test_adjacent_prefix_whatever_is_carried(spark, span, kind):
    r = random.Random(len(kind))
    rows = {
        "mixed": [(r.choice(["A", "A", "B", None]), "".join(r.choice("ab") for _ in range(r.randint(0, 3)))) for _ in range(40)],
        "one text": [("A", "same")] * 20,
        "growing": [("A", "a" * k) for k in range(1, 25)],
        "short then long": [("A", "a")] + [("A", "a" + r.choice("bcd") * k) for k in range(1, 25)] + [("A", "b"), ("A", "ab")],
        "related to some": [("A", r.choice(["abc", "ab", "abcd", "abx", "a"])) for _ in range(40)],
    }[kind]
    assert seqs(prefix.adjacent_prefix(entries(spark, rows), span)) == folded(rows)


def test_adjacent_prefix_of_one_app_and_many_rows(spark):
    rows = spark.range(400_000).select(F.col("id").alias("seq"), F.lit("A").alias("app_name"), F.when(F.col("id") % 1000 == 999, "b").otherwise(F.concat(F.lit("a"), (F.col("id") % 7).cast("string"))).alias("text"))
    want = len(folded([("A", "b" if i % 1000 == 999 else f"a{i % 7}") for i in range(400_000)]))
    assert prefix.adjacent_prefix(rows).count() == want
    assert prefix.adjacent_prefix(rows.limit(0)).count() == 0


def test_longest_prefix_of_a_very_long_word(spark):
    r = random.Random(4)
    long = "".join(r.choice("ab") for _ in range(1 << 20))
    known = [long[:k] for k in (3, 1000, 700_000)] + ["b", ""] + ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(20)]
    words = [long, long[:999_999] + "c", None, "", "c"] + ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(200)]
    got = {x.word: x.prefix for x in prefix.longest_prefix(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    assert got == {w: None if w is None else max((k for k in known if k and w.startswith(k)), key=len, default=None) for w in words}


def test_one_template_makes_few_pairs(spark):
    r = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    rows = []
    for _ in range(1200):
        t = list(words)
        t[r.randrange(60)] = r.choice("xyz") + str(r.randrange(50))
        rows.append(("A", " ".join(t)))
    df = entries(spark, rows)
    first, _ = minhash.classes(exact.first_of(df, "text"))
    every = minhash.class_pairs(first).count()
    sizes = []
    of = minhash.class_pairs

    def counted(*a, **k):
        out = of(*a, **k)
        sizes.append(out.count())
        return out

    minhash.class_pairs = counted
    try:
        got = seqs(minhash.similar_dedup(df, least=64))
    finally:
        minhash.class_pairs = of
    assert got == seqs(minhash.similar_dedup(df)) and every > 5 * sum(sizes) and sum(sizes) < 64 * 32 + 2 * first.count()


@pytest.mark.parametrize("small", [0, 10**6])
def test_greedy_chain(spark, monkeypatch, small):
    monkeypatch.setattr(greedy, "SMALL", small)
    pairs = spark.createDataFrame([(k + 1, k) for k in range(12)], "node long, before long")
    assert {x.node for x in greedy.dropped(pairs).collect()} == set(range(1, 13, 2))


def wire(spark, *texts):
    return jsonl.wire(spark.createDataFrame([(0, "A", t) for t in texts], ENTRY).withColumn("ts", F.timestamp_seconds(F.lit(1e9))))


def texts(df):
    return sorted(x.text for x in df.collect())


class Cut(Exception):
    pass


@pytest.mark.parametrize("step", range(12))
def test_replacement_cut_off_at_any_step(spark, tmp_path, monkeypatch, step):
    """The writer ends before its n-th change of the folders; then it is run again."""
    table = str(tmp_path / "t")
    wire(spark, "one", "two").write.json(table)
    bad = spark.createDataFrame([("not json",)], "value string")
    calls = iter(range(1000))
    raw_moved, raw_delete = jsonl.moved, jsonl.delete

    def cut(of):
        def run(*args):
            if next(calls) >= step:
                raise Cut
            return of(*args)

        return run

    monkeypatch.setattr(jsonl, "moved", cut(raw_moved))
    monkeypatch.setattr(jsonl, "delete", cut(raw_delete))
    try:
        jsonl.replace(wire(spark, "new"), table, aside=bad)
        whole = True
    except Cut:
        whole = False
    monkeypatch.setattr(jsonl, "moved", raw_moved)
    monkeypatch.setattr(jsonl, "delete", raw_delete)
    seen = texts(jsonl.read_good(spark, table))
    assert seen in (["one", "two"], ["new"]) and (not whole or seen == ["new"])
    jsonl.recover(spark, table)
    assert texts(jsonl.read_good(spark, table)) == seen
    jsonl.append(spark.createDataFrame([(0, "A", "more")], ENTRY).withColumn("ts", F.timestamp_seconds(F.lit(1e9))), table)
    assert texts(jsonl.read_good(spark, table)) == sorted([*seen, "more"])
    aside = [x.value for x in spark.read.text(table + ".unreadable").collect()] if jsonl.exists(spark, table + ".unreadable") else []
    assert aside == (["not json"] if seen == ["new"] else [])
    assert not jsonl.exists(spark, table + ".old") and not jsonl.exists(spark, table + ".new")


def test_an_old_table_beside_its_place_is_not_lost(spark, tmp_path):
    table = str(tmp_path / "t")
    wire(spark, "one", "two").write.json(table + ".old")  # between the renames
    assert texts(jsonl.read_good(spark, table)) == ["one", "two"]
    jsonl.append(spark.createDataFrame([(0, "A", "three")], ENTRY).withColumn("ts", F.timestamp_seconds(F.lit(1e9))), table)
    assert jsonl.replace(jsonl.wire(jsonl.read_good(spark, table)), table)
    assert texts(jsonl.read_good(spark, table)) == ["one", "three", "two"]


@pytest.mark.parametrize("step", ["_write", "_put", "after"])
def test_log_writer_cut_off_and_run_again(spark, tmp_path, monkeypatch, step):
    log = Log(spark, str(tmp_path / "log"))
    assert log.append(wire(spark, "zero"), "w", 0)
    with monkeypatch.context() as m:
        if step == "after":
            whole = Log._put

            def put(self, *args):
                whole(self, *args)
                raise Cut

            m.setattr(Log, "_put", put)
        else:
            def stop(self, *args):
                raise Cut

            m.setattr(Log, step, stop)
        with pytest.raises(Cut):
            log.append(wire(spark, "one"), "w", 1)
    assert texts(log.read()) == (["one", "zero"] if step == "after" else ["zero"])
    assert log.append(wire(spark, "one"), "w", 1) is (step != "after")
    assert texts(log.read()) == ["one", "zero"] and not log.append(wire(spark, "again"), "w", 1)
    log.sweep()
    assert texts(log.read()) == ["one", "zero"]


def test_log_replacement_keeps_rows_added_since(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loam.sources.log.SNAPSHOT", 3)
    log = Log(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    for k in range(4):
        log.append(wire(spark, f"t{k}", "same"), "w", k)
    before = log.state()
    log.append(wire(spark, "late"))
    assert log.replace(log.read(before.version).dropDuplicates(["text"]), before, "purge", 0)
    assert texts(log.read()) == ["late", "same", "t0", "t1", "t2", "t3"]
    assert texts(log.read(before.version)).count("same") == 4  # as it was
    assert not log.replace(log.read(), before, "purge", 0)  # made already
    with pytest.raises(Conflict):
        log.replace(log.read(), before)
    assert not log.replace(log.read().limit(0), log.state()) and log.read().count() == 6
    assert not log.compact(10) and log.compact(2) and len(log.state().live) == 1
    assert log.sweep() >= 5 and log.read().count() == 6
    assert Log(spark, str(tmp_path / "log")).state().writers == {"w": 3, "purge": 0}


def test_log_two_writers_at_a_time(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "log"))
    log.append(wire(spark, "one"))
    put, once = Log._put, []

    def late(self, name, value):
        if not once:
            once.append(1)
            Log(spark, str(tmp_path / "log")).append(wire(spark, "other"))  # takes the number that this one was to have
        return put(self, name, value)

    monkeypatch.setattr(Log, "_put", late)
    assert log.append(wire(spark, "two"))
    assert texts(log.read()) == ["one", "other", "two"]


@pytest.mark.parametrize(("block", "cells"), [(4096, 1 << 17), (7, 16)])
@pytest.mark.parametrize("prune", [True, False])
def test_tiles_find_each_pair_once(spark, monkeypatch, block, cells, prune):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CELLS", cells)
    r = random.Random(9)
    kinds = [[r.randrange(minhash.PRIME) for _ in range(20)] for _ in range(3)]
    rows = [(k, r.choice([10, 12, 30, None]), [r.randrange(minhash.PRIME) if r.random() < 0.15 else x for x in kinds[k % 3]]) for k in range(150)]
    first = spark.createDataFrame(rows, "id long, n int, signature array<bigint>")

    def close(a, b):
        return not prune or None not in (a, b) and 2 * abs(a - b) <= max(a, b)

    want = {(a[0], b[0]): sum(map(int.__eq__, a[2], b[2])) / 20 for a in rows for b in rows if a[0] < b[0] and close(a[1], b[1])}
    want = {k: v for k, v in want.items() if v >= 0.7}
    found = minhash.class_pairs(first, length_prune=prune)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row of a pair that isn't similar
    got = found.collect()
    assert len(got) == len(want) > 500 and {(x.before, x.node): x.similarity for x in got} == want
    two = minhash.class_pairs(first.where("id >= 60"), length_prune=prune, earlier=first.where("id < 60")).collect()
    across = {k: v for k, v in want.items() if k[0] < 60 <= k[1]}
    assert len(two) == len(across) > 100 and {(x.before, x.node): x.similarity for x in two} == across


@pytest.mark.parametrize(("lot", "pairs"), [(1024, 1 << 17), (3, 5)])
def test_similar_pairs_are_expanded_where_lots_meet(spark, monkeypatch, lot, pairs):
    monkeypatch.setattr(minhash, "LOT", lot)
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    r = random.Random(4)
    kinds = ["".join(r.choice("abc") for _ in range(60)) for _ in range(3)]
    # repeats of a row of letters have the shingles of one, so their classes hold many rows if lengths are equal
    texts = [r.choice(["abcab" * 8, "babca" * 8, kinds[k % 3], kinds[k % 3][:50] + "zz", "abcab" * 20, "ab", "", None]) for k in range(120)]
    rows = [(k, "A", t) for k, t in enumerate(texts)] + [(None, "A", kinds[0]), (5, "A", kinds[1])]  # a row without a key, and a key of two rows
    signed = [(s, t, minhash.minima([t], 20, 3, {}, True).to_pylist()[0] or [0] * 20) for s, _, t in rows if s is not None and t is not None]
    near = lambda a, b: 2 * abs(len(a) - len(b)) <= max(len(a), len(b))
    want = [(a[0], b[0], sum(map(int.__eq__, a[2], b[2])) / 20) for a in signed for b in signed if a[0] < b[0] and near(a[1], b[1])]
    want = sorted(x for x in want if x[2] >= 0.7)
    found = minhash.similar_pairs(spark.createDataFrame(rows, "seq long, app_name string, text string"), portable=True)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]  # no pair is shuffled


def test_rows_of_tiles_grow_with_the_classes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCKS", 8)
    dealt = {}
    for rows in (400, 1600):  # of one template, so in one part of each band
        first = spark.range(rows).selectExpr("id", "10 as n", "array_repeat(7L, 20) as signature")
        dealt[rows] = minhash.tiled(first, [0, 10, 20]).count()
    assert dealt[400] <= 2 * 400 * 8 and dealt[1600] == 4 * dealt[400]
    monkeypatch.setattr(minhash, "LARGEST", 50)  # a block is bounded all the same
    assert minhash.tiled(first, [0, 10, 20]).count() == 2 * 1600 * 32


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_minima_of_pieces_equal_those_of_each_text(n):
    r = random.Random(3)
    texts = ["", None, "a", "ab", "ab\0", "abc", "a b", "\U0010ffff\U0010fffe", "aaaa"] + ["".join(r.choice("ab é漢\0") for _ in range(r.randrange(40))) for _ in range(200)]
    factors = [minhash.factors(k) for k in range(20)]

    def plain(t):
        grams = {t[i : i + n] for i in range(len(t) - n + 1)} or {t}
        return [min((a * minhash.base_hash(g, True) + b) % minhash.PRIME for g in grams) for a, b in factors]

    assert minhash.minima(texts, 20, n, {}, True).to_pylist() == [plain(t) if t else None for t in texts]
    assert minhash.minima([None, ""], 20, n, {}, True).to_pylist() == [None, None]


def test_signatures_leave_a_task_by_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "abcdefghij" * 20) for k in range(100)], "seq long, text string").coalesce(1)
    whole = minhash.signed(rows).collect()
    monkeypatch.setattr(minhash, "PIECE", 256)
    assert minhash.signed(rows, carried=["seq"]).collect() == [type(x)(seq=x.seq, signature=x.signature) for x in whole]


def test_shingle_counts_shuffle_no_row_of_a_shingle_and_a_text(spark):
    rows = [(1, "A", "abcab"), (1, "A", "abcx"), (2, "A", "abc"), (None, "A", "abc"), (None, "A", "abc"), (3, "A", "a"), (4, "A", " ")]
    got = catalogue.shingle_counts(spark.createDataFrame(rows, "seq long, app_name string, text string"))
    assert {x.gram: (x.times, x.texts) for x in got.collect()} == {"abc": (5, 2), "bca": (1, 1), "cab": (1, 1), "bcx": (1, 1), "a": (1, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("collect_list")  # shingles are made where a text's rows have met


def test_prefix_sweep_has_no_worker_beside_it(spark, monkeypatch):
    seen, whole = [], prefix.prefix_conflicts

    def watched(rows):
        asks, offers = whole(rows)
        seen.extend(x._jdf.queryExecution().executedPlan().toString() for x in (asks, offers))
        return asks, offers

    monkeypatch.setattr(prefix, "prefix_conflicts", watched)
    got = prefix.prefix_dedup(entries(spark, [("A", "café au lait chaud"), ("A", "café au lait ch"), ("A", "other text"), ("B", "café au lait ch"), ("A", "")]))
    assert seqs(got) == [0, 2, 3]
    assert len(seen) == 2 and not any("ArrowEvalPython" in x for x in seen) and seen[1].count("MapInArrow") > 0


def test_few_rows_are_objects_at_a_time():
    rows = pa.RecordBatch.from_pydict({"x": list(range(2 * sweep.ROWS + 1))})
    parts = list(sweep.few(iter([rows, rows.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [sweep.ROWS, sweep.ROWS, 1] and pa.Table.from_batches(parts).column("x").to_pylist() == list(range(2 * sweep.ROWS + 1))
