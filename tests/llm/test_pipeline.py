"""The stages of the pipeline on edge cases, and on planted copies."""

import random

import pytest

import corpus_pipeline
from loam import storage

STAGES = dict(corpus_pipeline.STAGES)
VOCABULARY = "the of and to in is that for it was on with as be by are this at from or an house river stone light water garden letter winter summer table".split()


def prose(seed, n=120):
    r = random.Random(seed)
    words = [r.choice(VOCABULARY) if r.random() < 0.6 else "".join(r.choice("abcdefghiklmnorst") for _ in range(r.randint(4, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(0, prose(900, 30).replace("\n", " "))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_stages_on_nulls_repeated_ids_and_empty_tables(spark, folder):
    rows = [(k, prose(k), "en", "s", 1) for k in range(8)]
    rows += [(3, prose(3), None, None, None), (4, prose(50), "en", "s", 1), (None, prose(51), None, "s", 1), (None, None, None, None, None), (9, "", "en", "s", 1), (10, None, "en", "s", 1), (11, "\n \n", "en", "s", 0)]
    for name, stage in STAGES.items():
        for given in (rows, []):
            docs = table(spark, given)
            out = stage(spark, docs, folder)
            if name != "bpe_tokens":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            got = out.collect()
            assert len(got) <= len(given)
            kept = {r.doc_id for r in got}
            if given:
                assert set(range(8)) | {None} <= kept, name  # clean documents stay
    kept = {(r.doc_id, r.text) for r in STAGES["quality_rules"](spark, table(spark, rows), folder).collect()}
    assert kept == {(i, t) for i, t, *_ in rows if t and t.strip()}
    kept = [(r.doc_id, r.text) for r in STAGES["simhash_near_dedup"](spark, table(spark, rows), folder).collect()]
    assert len(kept) == len(set(kept)) and (4, prose(50)) in kept and (3, prose(3)) in kept


def test_stages_take_more_columns_with_the_names_that_they_use(spark, folder):
    rows = table(spark, [(k, prose(k), "en", "s", 1) for k in range(6)]).selectExpr("*", "'a' as id", "1 as print", "2 as fp", "true as kept", "3 as n_words", "'z' as hist", "4 as o", "5 as later", "6 as n_removed")
    docs = rows
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "bpe_tokens":
            assert docs.columns == rows.columns, name
    assert docs.count() == 6


def test_run_against_what_was_planted(spark, tmp_path):
    item = prose(901, 36).replace("\n", " ")
    clean = {k: prose(k, 150) for k in range(30)}
    rows = [(k, t, "en", "s", len(t)) for k, t in clean.items()]
    rows += [(100 + k, clean[k], "en", "s", 1) for k in range(10)]  # exact copies
    rows += [(200 + k, prose(200 + k, 60) + "\n" + item, "en", "s", 1) for k in range(5)]  # a benchmark item
    rows += [(300 + k, prose(300 + k, 100) + "\n" + "\n".join(clean[k].split("\n")[3:9]), "en", "s", 1) for k in range(5)]  # lines of an earlier document
    rows += [(400, "too short", "en", "s", 1), (401, "a b c " * 100, "en", "s", 1), (402, None, "en", "s", 1)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    since = len(storage.written(spark))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the item's line goes from all but the first that have it by line dedup, so only that one still restates it
    assert set(got) == {*range(30), *range(201, 205), *range(300, 305)}
    import hashlib

    assert all(got[k].decoded_sha256 == hashlib.sha256(clean[k].encode()).hexdigest() for k in range(30))
    left = prose(300, 100)
    assert got[300].decoded_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert len(storage.written(spark)) == since + 1  # the table that the last stage reads


def test_there_is_no_sql():
    assert corpus_pipeline.ORACLE_SQL is None
