"""Buffered ingestion by state and timers, upkeep by metrics, byte ranges, polling, resumed dedup, the model tables, walks and equivalent texts."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loam import catalogue
from loam.config import Level, Settings
from loam.operators import exact, ngrams, prefix, tree
from loam.plans.upkeep import Upkeep, purge_log
from loam.sources import chunks, jsonl, views
from loam.sources.log import Log
from loam.streaming import buffered

SCHEMA = "seq long, app_name string, text string, ts timestamp"


def put(spark, folder, k, rows):
    """A file of rows that a stream takes as the k-th."""
    import os

    at = folder / f"f{k:03d}"
    spark.createDataFrame([(s, a, t, datetime(2025, 1, 1)) for s, a, t in rows], SCHEMA).coalesce(1).write.json(str(at))
    for f in at.glob("part-*"):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "f*"))


def test_flush_by_rows_and_what_waits(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    put(spark, folder, 0, [(0, "A", "first"), (1, "A", "first")])  # never saved: at once
    put(spark, folder, 1, [(k, "A", f"text {k}") for k in range(10, 14)])
    put(spark, folder, 2, [(k, "A", f"text {k}") for k in range(13, 19)] + [(30, "A", "!!!")])  # the first repeats the last accepted one
    settings = Settings(save_line_threshold=8, save_interval_s=10_000)
    buffered.start(stream(spark, folder), table, checkpoint, settings, once=True).awaitTermination()
    assert sorted(x.text for x in Log(spark, table).read().collect()) == sorted(["first", *(f"text {k}" for k in range(10, 18))])
    assert [x.text for x in buffered.waiting(spark, checkpoint).collect()] == ["text 18"]
    put(spark, folder, 3, [(40, "A", "text 18"), (41, "A", "last")])
    buffered.start(stream(spark, folder), table, checkpoint, settings, once=True).awaitTermination()
    assert buffered.drain(spark, table, checkpoint) and not buffered.drain(spark, table, checkpoint)
    assert sorted(x.text for x in Log(spark, table).read().collect()) == sorted(["first", *(f"text {k}" for k in range(10, 19)), "last"])


def test_a_timer_saves_what_waits_and_upkeep_purges_once(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    put(spark, folder, 0, [(0, "A", "first"), (1, "A", "second"), (2, "A", "first")])
    runs = []
    upkeep = Upkeep(lambda: runs.append(purge_log(spark, table)), level=Level.NORMAL, counter=1998)
    spark.streams.addListener(upkeep)
    query = buffered.start(stream(spark, folder), table, checkpoint, Settings(save_interval_s=4), every_s=0.5)
    try:
        until = time.time() + 90
        while time.time() < until and Log(spark, table).read().count() < 3 and not runs:
            time.sleep(1)
        # the first text was saved at once, the others by the timer: no text came after them
        until = time.time() + 30
        while time.time() < until and not upkeep.made:
            time.sleep(0.5)
    finally:
        query.stop()
        spark.streams.removeListener(upkeep)
    upkeep.join()
    assert upkeep.counter == 2001 and upkeep.made == ["purge"] and runs == [1]
    assert sorted(x.text for x in Log(spark, table).read().collect()) == ["first", "second"]


def test_upkeep_counts_multiples_and_time():
    now = [0.0]
    u = Upkeep(lambda: None, lambda: 1 / 0, Level.FULL, Settings(train_every=500), clock=lambda: now[0])
    for rows in (499, 1, 400, 0, 100, 3000):
        u.add(rows)
        u.join()
    assert [m.split()[0] for m in u.made].count("purge") == 2 and u.made.count("train failed: ZeroDivisionError") == 3
    now[0] = 3601.0
    u.onQueryIdle(None)
    u.join()
    assert [m.split()[0] for m in u.made].count("purge") == 3


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_ranges_cut_anywhere(spark, tmp_path, size):
    texts = ["日本語の行", "", "x", "é" * 9, "\r", "last without an end 😀"]
    raw = "\n".join(texts).encode()
    at = tmp_path / "a.jsonl"
    at.write_bytes(raw)
    got = sorted(x for k in range(0, len(raw), size) for x in chunks.lines(str(at), k, min(k + size, len(raw)), piece=5))
    assert [x[1].decode() for x in got if x[1]] == [t for t in texts if t]
    if size > 3:
        assert [x.line for x in chunks.scan(spark, str(tmp_path), size).orderBy("start").collect()] == [t for t in texts if t.strip()]


def test_polling_takes_whole_lines_and_backs_off(tmp_path):
    now = [0.0]
    at = tmp_path / "log.jsonl"
    at.write_bytes("á\nb".encode())
    p = chunks.Poll(str(tmp_path), 2, Settings(polling_interval_s=5), clock=lambda: now[0])
    one = p.latestOffset()
    assert list(one.values()) == [3]  # the line without an end isn't taken yet
    at.write_bytes("á\nbc\nd\n".encode())
    two = p.latestOffset()
    assert [x for r in p.partitions(one, two) for b in p.read(r) for x in b.column("line").to_pylist()] == ["bc", "d"]
    assert p.partitions(two, two) == []
    now[0] = 61.0
    assert p.latestOffset() == two
    at.write_bytes("á\nbc\nd\ne\n".encode())
    now[0] = 70.0
    assert p.latestOffset() == two  # idle for a minute: every third time only
    now[0] = 77.0
    assert list(p.latestOffset().values()) == [10]


def test_polling_stream_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda t: json.dumps({"appName": "A", "text": t, "timestamp": 1.5}, ensure_ascii=False)
    (folder / "a.jsonl").write_text(line("eins") + "\nbroken\n" + line("zwei") + "\n" + line("cut")[:9])

    def run():
        rows = chunks.entries(chunks.poll(spark, str(folder)))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(x.text for x in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["eins", "zwei"]
    (folder / "a.jsonl").write_text(line("eins") + "\nbroken\n" + line("zwei") + "\n" + line("cut") + "\n")
    (folder / "b.jsonl").write_text(line("drei") + "\n")
    assert run() == ["cut", "drei", "eins", "zwei"]


def test_batches_are_handed_to_a_callback(spark, tmp_path):
    out = tmp_path / "seen"
    out.mkdir()
    (tmp_path / "a.jsonl").write_text("".join(f"line {k}\n" for k in range(12)))
    at = str(out)

    def process(rows):
        import os
        import uuid

        with open(os.path.join(at, uuid.uuid4().hex), "w") as f:
            f.write(str(len(rows)))

    chunks.each_batch(chunks.scan(spark, str(tmp_path / "a.jsonl")), process, 5)
    assert sorted(int(f.read_text()) for f in out.iterdir()) == [2, 5, 5]


def test_model_tables_extend_as_rebuilt(spark, tmp_path):
    one, two = spark.createDataFrame([("abab",), ("xab",)], "text string"), spark.createDataFrame([("bax",), ("",)], "text string")
    for name, texts in (("grown", [one, two]), ("whole", [one.unionAll(two)])):
        ngrams.rebuild(texts[0], str(tmp_path / name), 4)
        for more in texts[1:]:
            assert ngrams.extend(more, str(tmp_path / name), 4)
    grown, whole = ({k: sorted(map(tuple, t.collect())) for k, t in ngrams.read_model(spark, str(tmp_path / n / "current")).items()} for n in ("grown", "whole"))
    assert grown == whole and (1, "b", 3) in whole["c_bc"] and (2, "ab", 3) in whole["c_abc"]
    assert dict((g, v) for n, g, v in whole["u_abx"] if n == 1) == {"a": 2, "b": 1, "x": 1}
    assert dict((g, v) for n, g, v in whole["u_xbc"] if n == 1) == {"a": 2, "b": 1, "x": 1}
    assert ngrams.read_model(spark, str(tmp_path / "none")) is None
    (tmp_path / "grown" / "current" / "_u_abx" / "_SUCCESS").unlink()
    assert not ngrams.extend(two, str(tmp_path / "grown"), 4)  # all five tables are needed


def test_probabilities_of_what_follows_sum_to_one(spark):
    tables = ngrams.model(ngrams.counts(spark.createDataFrame([("abracadabra",), ("barbara",)], "text string"), 3))
    letters = sorted(set("abracadabra"))
    asked = spark.createDataFrame([(c, x) for c in ("", "a", "ab", "zz", "xa") for x in letters], "context string, next string")
    got = {}
    for x in ngrams.scored(asked, tables).collect():
        got.setdefault(x.context, []).append(x.p)
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values()) and sorted(got["zz"]) == sorted(got[""])
    by = {(x.context, x.next): x.p for x in ngrams.scored(asked, tables).collect()}
    assert by["ab", "r"] > by["ab", "d"] > 0 and abs(by["xa", "b"] - by["a", "b"]) < 1e-12


def test_walk_in_order_and_a_link_once(spark):
    rows = [
        (1, 0, None, "AXWebArea", None, None, [], None, None), (1, 5, 0, "AXGroup", None, "later", [], None, None), (1, 2, 0, "AXGroup", None, "earlier", [], None, None),
        (1, 9, 2, "AXLink", None, "title", ["link text"], None, None), (1, 7, 2, "AXStaticText", None, None, ["before the link"], None, None), (1, 3, 5, "AXStaticText", None, None, ["last"], None, None),
    ]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, subrole string, title string, value array<string>, description string, selected_text string")
    walk = tree.walked(df)
    assert [x.text for x in walk.orderBy("seq").collect()] == ["earlier", "before the link", "link text", "link text", "title", "later", "last"]
    assert [x.text for x in exact.consecutive_dedup(walk).orderBy("seq").collect()] == ["earlier", "before the link", "link text", "title", "later", "last"]


def test_canonically_equivalent_texts_are_one(spark):
    whole, parts = "caf\u00e9", "cafe\u0301"
    df = spark.createDataFrame([(0, "A", parts), (1, "A", whole), (2, "B", whole), (3, "A", "\u212b"), (4, "A", "\u00c5"), (5, "A", "cafe")], "seq long, app_name string, text string")
    seqs = lambda x: sorted(r.seq for r in x.collect())
    assert seqs(exact.exact_dedup(df)) == [0, 3, 5] and seqs(exact.pair_dedup(df)) == [0, 2, 3, 5]
    assert exact.exact_dedup(df).where("seq = 0").first().text == parts  # the row keeps its own form
    assert exact.exact_dedup_stats(df).first().kept == 3
    assert seqs(exact.consecutive_dedup(df)) == [0, 3, 5] and seqs(prefix.adjacent_prefix(df)) == [0, 2, 3, 5]
    assert seqs(exact.new_entries(df, df.where("seq = 1"))) == [2, 3, 5]
    longer = spark.createDataFrame([(0, "A", "un " + whole + " noir"), (1, "A", "un " + parts + " noi")], "seq long, app_name string, text string")
    assert seqs(prefix.prefix_dedup(longer)) == [0]


def test_fragments_of_long_texts_keep_their_places(spark):
    from loam.plans import curation

    rows = spark.createDataFrame([(0, "A", "\n".join(f"w{k}" * 3 for k in range(1500))), (1, "A", "next text")], "seq long, app_name string, text string")
    out = curation.ingest(rows, Settings(max_text_length=100_000))
    assert out.select("seq").distinct().count() == 1501 and out.orderBy(F.desc("seq")).first().text == "next text"


def test_purge_of_a_log_while_rows_are_added(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    wire = lambda *texts: jsonl.wire(spark.createDataFrame([(0, "A", t, datetime(2025, 1, 1)) for t in texts], SCHEMA))
    log.append(wire("one text", "one text", "two text"))
    assert purge_log(spark, str(tmp_path / "t")) == 1 and purge_log(spark, str(tmp_path / "t")) == 0
    assert sorted(x.text for x in log.read().collect()) == ["one text", "two text"]


@pytest.mark.parametrize("stop", ["between", "rows written", "filters written"])
def test_sections_stopped_and_begun_again_equal_exact_dedup(spark, tmp_path, monkeypatch, stop):
    import random

    from loam.plans import progressive

    r = random.Random(3)
    rows = spark.createDataFrame([(k, r.choice("AB"), f"text {r.randrange(60)}") for k in range(300)], "seq long, app_name string, text string").persist()
    want = sorted(map(tuple, exact.exact_dedup(rows).collect()))
    at = str(tmp_path / "dedup")

    class Stop(Exception):
        pass

    def stopped(*a, **k):
        raise Stop

    for k in range(4):
        run = progressive.SectionedDedup(rows, at, 4)
        assert run.progress().done == k and run.progress().sections == 4
        if stop != "between":
            with monkeypatch.context() as m:
                m.setattr(progressive if stop == "rows written" else Log, "filters" if stop == "rows written" else "append", stopped)
                with pytest.raises(Stop):
                    run.run(1)
        assert run.run(1).done == k + 1
    assert not progressive.SectionedDedup(rows, at, 4).step()
    assert sorted(map(tuple, progressive.progressive_dedup(spark, rows, at).collect())) == want
    rows.unpersist()


def test_filters_know_all_that_they_were_given(spark):
    from loam.plans import progressive

    seen = progressive.hashed(spark.range(5000).selectExpr("id as seq", "'A' as app_name", "concat('t', id) as text"))
    other = progressive.hashed(spark.range(5000, 10_000).selectExpr("id as seq", "'A' as app_name", "concat('t', id) as text"))
    blooms = progressive.filters(seen)
    assert progressive.maybe_seen(seen, blooms).count() == 5000 and progressive.maybe_seen(other, blooms).count() < 250


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    files = {}
    for name, n in (("a", 100), ("b", 0), ("c", 37), ("d", 64)):
        (tmp_path / name).write_bytes("".join(f"{name}é{k}\n" for k in range(n)).encode())
        files[str(tmp_path / name)] = (tmp_path / name).stat().st_size
    want = sorted(f"{name}é{k}" for name, n in (("a", 100), ("c", 37), ("d", 64)) for k in range(n))
    found = chunks.scan(spark, str(tmp_path), 7)
    assert found.rdd.getNumPartitions() == 1 and sorted(x.line for x in found.collect()) == want
    for task in (1, 7, 20, 64):
        monkeypatch.setattr(chunks, "TASK", task)
        parts = chunks.together(((f, 3, n) for f, n in sorted(files.items())), 7)
        assert [(r.path, r.start, r.stop) for p in parts for r in p.each()] == [(f, k, min(k + 7, n)) for f, n in sorted(files.items()) for k in range(3, n, 7)]
        assert all(sum(r.stop - r.start for r in p.each()) < max(task, 7) + 7 for p in parts)


def test_files_of_a_stream_are_of_bounded_size(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    texts = views.documents(spark, at).agg(F.sum(F.octet_length("text"))).first()[0]
    few = spark.read.parquet(catalogue._in_files(spark, at))
    assert len(few.inputFiles()) == 4
    monkeypatch.setattr(catalogue, "FILE_BYTES", texts // 9)
    many = catalogue._in_files(spark, at)
    rows = spark.read.parquet(many)
    sizes = rows.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert 8 <= len(sizes) <= 10 and max(x.n for x in sizes) < 3 * texts // 9
    assert sorted(x.seq for x in rows.collect()) == sorted(x.seq for x in few.collect())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(many)
    buffered.start(stream, f"{many}-out/table", f"{many}-out/checkpoint", once=True).awaitTermination()
    buffered.drain(spark, f"{many}-out/table", f"{many}-out/checkpoint")
    got = Log(spark, f"{many}-out/table").read().select("appName", "text")
    want = catalogue.QUERIES["ingest"](spark, at).select("app_name", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("per_app", [False, True])
def test_buffer_equals_a_plain_one_with_a_state_for_each_core(spark, tmp_path, per_app):
    import os
    import random

    r = random.Random(5)
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    words = ["one", "two", "three", "four", "!!!", "no"]
    text = lambda: "\n".join(r.choice(words) for _ in range(r.randrange(1, 5)))
    batches = [[(100 * k + j, r.choice(["A", "B", None, "Finder"]), text()) for j in range(40)] for k in range(3)]
    batches[1] += [(160, "A", "one\ntwo\none")] * 2 + [(None, "A", "last one"), (170, "A", None), (171, "A", "")]  # equal rows, and one without a place
    keys, saved = {}, []
    for k, rows in enumerate(batches):
        put(spark, folder, k, rows)
        rows = [x for x in rows if x[2] and len(x[2]) >= 3 and x[1] != "Finder"]
        for seq in sorted({x[0] for x in rows if x[0] is not None}) + [None]:
            here = [x for x in rows if x[0] == seq]
            for i, (_, app, t) in enumerate(here):
                of = keys.setdefault((app or "") if per_app else "", {"last": None, "waiting": [], "never": True})
                for f in t.split("\n"):
                    if len(f) >= 3 and f != "!!!" and f != of["last"]:
                        of["waiting"].append((app, f))
                        of["last"] = f
                if i + 1 == len(here) and of["waiting"] and (of["never"] or len(of["waiting"]) >= 10):
                    saved += of["waiting"]
                    of["waiting"], of["never"] = [], False
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        settings = Settings(save_interval_s=10_000)
        buffered.start(stream(spark, folder), table, checkpoint, settings, per_app, once=True).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    by = lambda rows: sorted(rows, key=str)
    left = by(tuple(x) for x in buffered.waiting(spark, checkpoint).select("app_name", "text").collect())
    got = by(tuple(x) for x in Log(spark, table).read().select("appName", "text").collect())
    assert by(got + left) == by(saved + [x for of in keys.values() for x in of["waiting"]]) and len(saved) > 100
    assert got == by(saved) and left == by(x for of in keys.values() for x in of["waiting"])
    assert len([x for x in os.listdir(f"{checkpoint}/state/0") if x.isdigit()]) == 4  # of which each starts a worker for each batch


def test_texts_of_a_stream_are_spread_and_decisions_carry_none(spark, tmp_path):
    put(spark, tmp_path / "in", 0, [(k, "A", f"text {k // 2}") for k in range(200)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buffered.PROVIDER)
    seen = []
    each = lambda b, n: seen.extend(b.select("kind", "texts", F.spark_partition_id().alias("at")).collect())
    rows = buffered.decided(stream(spark, tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # what waits has a timer, and batches that look at it would never end
    try:
        rows.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    texts = [x for x in seen if x.kind == "text"]
    assert len(texts) == 200 and len({x.at for x in texts}) == 4
    others = [x for x in seen if x.kind != "text"]
    assert sorted(x.kind for x in others) == ["again"] * 100 + ["upto"] and {x.texts for x in others} == {None}
