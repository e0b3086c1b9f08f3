"""Files, streams, policies and the query catalogue."""

import json
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loam import catalogue
from loam.config import Level, Settings, Strategy, choose_level, choose_strategy, decode_apps, encode_apps, flush_due, next_daily_run, purge_due
from loam.operators import exact
from loam.plans import curation
from loam.sources import imports, jsonl
from loam.streaming import ingest

SF = "/root/testdata/sf0.001"


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def entry(app, text, at=763516800.5):
    return {"appName": app, "text": text, "timestamp": at}


def test_read_and_quarantine(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", entry("A", "x"), "not json", "", {"appName": "A"}, {"appName": "A", "text": "t", "timestamp": "today"}, entry("B", "日本"))
    good, bad = jsonl.read(spark, path)
    rows = good.orderBy("seq").collect()
    assert [(r.app_name, r.text) for r in rows] == [("A", "x"), ("B", "日本")] and rows[0].ts == datetime(2025, 3, 13, 0, 0, 0, 500000)
    assert bad.count() == 3
    jsonl.quarantine(bad, str(tmp_path / "bad"))
    assert spark.read.text(str(tmp_path / "bad")).count() == 3


def test_append_replace_and_purge(spark, tmp_path):
    table = str(tmp_path / "t")
    good, _ = jsonl.read(spark, write(tmp_path / "a.jsonl", entry("A", "one"), entry("B", "one"), entry("Finder", "two"), entry("A", "x")))
    jsonl.append(good, table, ["Finder"], 2)
    assert jsonl.read_good(spark, table).count() == 2
    assert curation.purge(spark, table) == {"strategy": "lightweight", "removed": 1}
    assert [r.text for r in jsonl.read_good(spark, table).collect()] == ["one"]
    assert curation.purge(spark, table)["removed"] == 0 and curation.purge(spark, table, seconds_since=5)["strategy"] == "skip"
    assert not jsonl.replace(spark.read.json(table).limit(0), table) and jsonl.read_good(spark, table).count() == 1
    (tmp_path / "t" / "empty").write_text("")
    assert jsonl.delete_empty(spark, table) >= 1


def test_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "sample.txt", "こんにちは世界です", "短い", "二番目の長い行です", "こんにちは世界です")
    write(folder / "test.MD", "# Heading line", "known line", "")
    write(folder / "no.xyz", "unsupported file")
    (folder / "bad.txt").write_bytes(b"\xff\xfe broken")
    (folder / "doc.pdf").write_bytes(b"%PDF")
    (folder / "empty.txt").write_text("")
    saved = spark.createDataFrame([(0, "test", "known line")], "seq long, app_name string, text string")
    at, status = str(tmp_path / "import"), str(tmp_path / "status")
    pages = lambda raw: ["first page line", "second page line"]
    assert imports.run(spark, str(folder), saved, at, status, 5, pages) == 3
    rows = sorted((r.app_name, r.text) for r in jsonl.read_good(spark, at).collect())
    assert rows == [("doc", "first page line"), ("doc", "second page line"), ("sample", "こんにちは世界です"), ("sample", "二番目の長い行です"), ("test", "# Heading line")]
    assert imports.run(spark, str(folder), saved, at, status, 5, pages) == 0
    known = imports.status(spark, status)
    assert {r.file_name for r in known.collect()} == {"sample.txt", "test.MD", "doc.pdf"}
    assert imports.updated(known.withColumn("last_modified", F.col("last_modified") + F.expr("interval 1 day")), known).count() == 3
    imports.reset(spark, at, status)
    assert imports.status(spark, status).count() == 0


def test_stream_ingest_and_resume(spark, tmp_path):
    source = tmp_path / "src"
    schema = "seq long, app_name string, text string, ts timestamp"
    rows = [(0, "A", "hello there", None), (1, "B", "hello there", None), (2, "A", "!!!", None), (3, "A", "other\nhello there", None), (4, "Finder", "ignored", None)]
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1e9))).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.text for r in got.collect()) == ["hello there", "hello there", "other"]
    for _ in range(2):
        q = ingest.resumable_dedup(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "uniq"), str(tmp_path / "cp2"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "uniq")).count() == 4


@pytest.mark.parametrize(("rows", "memory", "age", "want"), [
    (500, 8000, None, Strategy.LIGHTWEIGHT), (500, 8000, 59, Strategy.SKIP), (501, 8000, 120, Strategy.SECTIONED), (2000, 4000, 299, Strategy.SKIP),
    (2000, 4000, 300, Strategy.LIGHTWEIGHT), (10_000, 4000, 599, Strategy.SKIP), (10_000, 8000, 300, Strategy.SECTIONED), (10_001, 8000, 1799, Strategy.SKIP), (10_001, 8000, None, Strategy.PROGRESSIVE),
])
def test_strategy(rows, memory, age, want):
    assert choose_strategy(rows, memory, age) is want


def test_policies():
    assert [choose_level(n, 16_000) for n in (50, 200, 500, 501)] == [Level.NORMAL, Level.MINIMAL, Level.MINIMAL, Level.DISABLED]
    assert choose_level(500, 8192) is Level.DISABLED
    assert purge_due(0, Level.NORMAL) and not purge_due(0, Level.DISABLED)
    assert [[purge_due(n, x) for n in (1000, 2000, 5000)] for x in (Level.FULL, Level.NORMAL, Level.MINIMAL)] == [[True, True, True], [False, True, False], [False, False, True]]
    assert flush_due(10, 1, False) and flush_due(1, 31, False) and flush_due(1, None, False) and not flush_due(9, 30, False) and not flush_due(99, None, True)
    assert next_daily_run(datetime(2025, 1, 1, 2)) == datetime(2025, 1, 1, 3) and next_daily_run(datetime(2025, 1, 1, 3)) == datetime(2025, 1, 2, 3)
    s = Settings()
    assert s.toggled("X").excludes("X") and not s.toggled("X").toggled("X").excludes("X") and Settings.from_json(s.to_json()).is_default()
    assert decode_apps(encode_apps(["a", "日"])) == ["a", "日"] and decode_apps("{") == [] and decode_apps('{"a": 1}') == [] and Settings.from_json("[1") == s


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_is_by_path_and_place(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.jsonl", entry("A", "same"), "", entry("A", "second"))
    write(folder / "b.jsonl", *(entry("B", "same" if k == 0 else f"text {k} " + "x" * 40) for k in range(400)))
    write(folder / "c.jsonl", entry("C", "same"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for least in (size, "1k"):  # large files cut in blocks, too
            spark.conf.set("spark.sql.files.maxPartitionBytes", least)
            rows = jsonl.read_good(spark, str(folder)).orderBy("seq").collect()
            assert [r.app_name for r in rows] == ["A"] * 2 + ["B"] * 400 + ["C"] and [r.text for r in rows[:3]] == ["same", "second", "same"]
            assert [r.text for r in rows[3:402]] == [f"text {k} " + "x" * 40 for k in range(1, 400)] and rows[0].seq == 0 and rows[1].seq == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_purge_keeps_unreadable_lines(spark, tmp_path):
    table = tmp_path / "t"
    table.mkdir()
    write(table / "a.jsonl", entry("A", "twice"), "not json", entry("B", "twice"), '{"appName": "A"}')
    assert curation.purge(spark, str(table))["removed"] == 1
    assert [(r.app_name, r.text) for r in jsonl.read_good(spark, str(table)).collect()] == [("A", "twice")]
    assert sorted(r.value for r in spark.read.text(str(table) + ".unreadable").collect()) == ["not json", '{"appName": "A"}']


def test_stored_tables_are_forgotten(spark):
    from loam import storage

    since = len(storage.written(spark))
    one, two = storage.stored(spark.range(3), "one"), storage.stored(spark.range(4), "two")
    assert one.count() == 3
    storage.forget(spark, since, but_last=1)
    assert two.count() == 4 and len(storage.written(spark)) == since + 1
    storage.forget(spark, since)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        one.count()


def test_stream_carries_the_last_text_over_batches(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    schema = "seq long, app_name string, text string, ts timestamp"
    for k, texts in enumerate((["one", "two", "two"], ["two", "three"], ["one two", "three", "three"], ["three", "four"])):
        rows = [(k * 10 + i, "A", t, datetime(2025, 1, 1)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / f"f{k}"))
        for f in (folder / f"f{k}").glob("part-*"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    for files in (2, 4):  # what a stopped run had done isn't done again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / f"f[0-{files - 1}]"))
        ingest.start(stream, str(tmp_path / "out"), str(tmp_path / f"c{files}"), once=True).awaitTermination()
        got = [r.text for r in spark.read.json(str(tmp_path / "out")).orderBy("batch").collect()]
        assert sorted(got) == sorted(["one", "two", "three"] if files == 2 else ["one", "two", "three", "one two", "three", "four"])


def test_maintenance(spark, tmp_path):
    from loam.plans import maintenance as M

    at, now = M.Locations(str(tmp_path / "root") + "/"), datetime(2025, 1, 1, 4)
    assert at.entries == str(tmp_path / "root" / "p13n_v1/textEntry/savedTexts.jsonl")
    assert M.import_runs(spark, at) == (None, -1)
    folder = tmp_path / "in"
    for nothing in (None, "", str(folder)):
        assert M.import_folder(spark, nothing) is None and M.import_files(spark, at, nothing, now) == 0
    assert M.import_runs(spark, at) == (None, -1)
    folder.mkdir()
    assert M.import_folder(spark, write(folder / "a.txt", "a first line", "a second line")) is None
    assert M.import_files(spark, at, str(folder), now) == 1 and M.import_runs(spark, at) == (now, 1)
    later = datetime(2025, 1, 2, 4)
    assert M.import_files(spark, at, str(folder), later) == 0 and M.import_runs(spark, at) == (later, 1)

    assert M.train_due(500, 3) and M.train_due(0, 1) and not M.train_due(500, 0) and not M.train_due(499, 3)
    assert M.daily(spark, at, now, None) == datetime(2025, 1, 2, 3) == M.daily(spark, at, now, datetime(2025, 1, 2, 3))
    assert M.daily(spark, at, now, None, Settings(auto_learning=False)) is None
    new = spark.createDataFrame([(0, "A", "abc", now)], "seq long, app_name string, text string, ts timestamp")
    assert M.after_save(spark, at, 500, new, Level.DISABLED) == []  # no table to add to
    assert M.daily(spark, at, later, datetime(2025, 1, 2, 3)) == datetime(2025, 1, 3, 3)
    count = lambda: spark.read.parquet(f"{at.models}/current").where("gram = 'c'").agg(F.sum("times")).first()[0]
    before = count()
    assert M.after_save(spark, at, 500, new, Level.DISABLED) == ["train"] and count() == before + 1
    jsonl.append(new.unionByName(new), at.entries)
    assert M.after_save(spark, at, 0, new, Level.NORMAL) == ["train", "purge"] and jsonl.read_good(spark, at.entries).count() == 1
    assert M.purged_statistics(spark, at.entries, Settings(min_text_length=0)).first().entries == 1
    assert M.reunited(new, new.withColumn("seq", F.lit(-1).cast("long"))).orderBy("source_rank", "seq").first().seq == 0
    M.reset_imports(spark, at)
    assert M.import_runs(spark, at) == (None, -1) and not jsonl.exists(spark, at.imported)

    (tmp_path / "none").write_text("")
    assert M.valid_file(spark, write(tmp_path / "some", "x")) and not M.valid_file(spark, str(tmp_path / "none")) and not M.valid_file(spark, str(tmp_path / "absent"))
    tried = []
    assert M.attempts(lambda: tried.append(1) or (1 / (len(tried) - 2) if len(tried) < 3 else "done"), wait_s=0) == -1.0
    with pytest.raises(OSError):
        M.attempts(lambda: open(tmp_path / "absent"), wait_s=0)


def test_shut_down_writes_and_purges(spark, tmp_path):
    from loam.plans import maintenance as M

    schema = "seq long, app_name string, text string, ts timestamp"
    rows = [(0, "A", "hello there", datetime(2025, 1, 1)), (1, "A", "other text", datetime(2025, 1, 1)), (2, "A", "hello there", datetime(2025, 1, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "src"))
    query = ingest.start(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert M.shut_down(spark, query, str(tmp_path / "out"))["removed"] == 1 and not query.isActive
    assert sorted(r.text for r in jsonl.read_good(spark, str(tmp_path / "out")).collect()) == ["hello there", "other text"]


def test_reading_and_purging_shuffle_no_text_but_to_its_place(spark, tmp_path):
    table = str(tmp_path / "table")
    texts = [f"{k % 40} text" for k in range(100)] + ["\u00e9", "e\u0301"]
    lines = [json.dumps({"appName": "a", "text": t, "timestamp": k + 0.5}) for k, t in enumerate(texts)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries, bad = jsonl.read(spark, table)
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (entries, bad)]
        assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        first: dict = {}
        for r in sorted(entries.collect(), key=lambda r: r.seq):
            first.setdefault(unicodedata.normalize("NFC", r.text), (r.text, r.ts))
        places = exact.first_places(entries)
        kept = exact.at_places(entries, places)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("rangepartitioning") == 1 and "Join" not in plan.partition("rangepartitioning")[0]
        assert [(r.text, r.ts) for r in kept.collect()] == list(first.values()) and len(first) == 41
        assert curation.purge(spark, table, Settings(avoid_apps=(), min_text_length=0)) == {"strategy": "lightweight", "removed": 61}
        assert [(r.text, r.ts) for r in sorted(jsonl.read_good(spark, table).collect(), key=lambda r: r.seq)] == list(first.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
