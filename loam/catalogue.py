"""The queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import Settings
from loam.functions import quality
from loam.functions import text as X
from loam.operators import apps, exact, minhash, ngrams, prefix, statistics, tree
from loam.plans import curation, maintenance, progressive
from loam.schema import WIRE
from loam.sources import chunks, jsonl, views
from loam.sources.log import Log
from loam.storage import shared_dir, written
from loam.streaming import buffered, ingest

AVOID = ("src0", "src7")
ROLES = ("AXStaticText", "AXButton", "AXMessage", "AXLink", "AXTextField")


def curated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curated_counts(views.lines(spark, sf_dir), AVOID)


def _clean_lines(s: SparkSession, d: str) -> DataFrame:
    return views.lines(s, d).withColumn("text", X.one_line("text")).where(X.length_within("text", 3, 1000))


def _split_fragments(s: SparkSession, d: str) -> DataFrame:
    return views.documents(s, d).select("seq", "app_name", F.posexplode(X.fragments("text")).alias("pos", "fragment"))


def _filter_symbol_only(s: SparkSession, d: str) -> DataFrame:
    return views.lines(s, d).where(~X.is_symbol_or_number("text"))


def _quality_filter(s: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("seq") % len(ROLES) + 1).cast("int"))
    return views.lines(s, d).withColumn("role", role).where(quality.quality_content("text", "role")).select("seq", "role", "text")


def _exclude_apps(s: SparkSession, d: str) -> DataFrame:
    return exact.without_apps(views.documents(s, d), AVOID).groupBy("app_name").agg(F.count("*").alias("n"), F.sum(X.n_bytes("text")).cast("bigint").alias("bytes"))


def _pair_dedup(s: SparkSession, d: str) -> DataFrame:
    return exact.pair_dedup(views.lines(s, d))


def _consecutive_dedup(s: SparkSession, d: str) -> DataFrame:
    return exact.consecutive_dedup(exact.accepted(views.lines(s, d), 3, 1000, AVOID))


def _ingest(s: SparkSession, d: str) -> DataFrame:
    return curation.ingest(views.documents(s, d))


def _longest_prefix(s: SparkSession, d: str) -> DataFrame:
    words = views.documents(s, d).select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    known = words.where(F.length("word") <= 6)
    return prefix.longest_prefix(words.where(F.length("word") > 6), known)


def shingle_counts(rows: DataFrame) -> DataFrame:
    """Each shingle's ``times`` and the number of ``texts``, of distinct ``seq``, that have it.

    Rows of one ``seq`` meet before their shingles are made, so that no row of a shingle
    and a text is shuffled; what leaves a task is one row of each shingle. Rows without
    ``seq`` are of no text, and meet with those of the same text alone.
    """
    met = rows.groupBy("seq", F.when(F.col("seq").isNull(), F.xxhash64("text"))).agg(F.collect_list(X.collapsed("text")).alias("each"))
    grams = met.select("seq", F.flatten(F.transform("each", lambda x: X.char_ngrams(x, 3))).alias("grams"))
    one, none, text = (x.cast("bigint") for x in (F.lit(1), F.lit(0), F.col("seq").isNotNull()))
    count = lambda of, n, m: F.transform(of, lambda g: F.struct(g.alias("gram"), n.alias("n"), m.alias("m")))
    all_of = X.let(F.col("grams"), lambda g: F.concat(count(g, one, none), count(F.array_distinct(g), none, text)))
    return grams.select(F.explode(all_of).alias("x")).groupBy("x.gram").agg(F.sum("x.n").alias("times"), F.sum("x.m").alias("texts"))


def _shingles(s: SparkSession, d: str) -> DataFrame:
    return shingle_counts(views.lines(s, d).where("text <> ''"))


def _minhash_signature(s: SparkSession, d: str) -> DataFrame:
    return minhash.signatures(views.documents(s, d), portable=True).select("seq", *(F.col("signature")[k].alias(f"m{k}") for k in range(minhash.SIZE)))


def _similar_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = exact.exact_dedup(views.documents(s, d))
    return minhash.similar_pairs(rows, portable=True)


def _similar_98(s: SparkSession, d: str) -> DataFrame:
    return minhash.same_signature_dedup(views.documents(s, d), portable=True).select("seq", "app_name")


def _similar_70(s: SparkSession, d: str) -> DataFrame:
    return minhash.similar_dedup(views.documents(s, d), AVOID, 20, portable=True).select("seq", "app_name")


def _potential(s: SparkSession, d: str) -> DataFrame:
    return minhash.potential_duplicates(views.documents(s, d), portable=True)


def _find_duplicates(s: SparkSession, d: str) -> DataFrame:
    return minhash.find_duplicates(views.lines(s, d), AVOID, 3, portable=True)


def _separated(s: SparkSession, d: str) -> DataFrame:
    return statistics.separated_statistics(views.lines(s, d), views.conversations(s, d), AVOID)


def _top5(s: SparkSession, d: str) -> DataFrame:
    return statistics.top_and_others(statistics.app_statistics(views.lines(s, d), AVOID), "app_name", "entries")


def _import_new(s: SparkSession, d: str) -> DataFrame:
    talk = views.conversations(s, d)
    each = talk.select("seq", "app_name", F.posexplode(X.lines("text")).alias("pos", "line"))
    new = each.select((F.col("seq") * 1000 + F.col("pos")).alias("seq"), "app_name", X.trimmed("line").alias("text")).where((F.col("text") != "") & (X.clusters("text") >= 5))
    return exact.new_entries(new, views.lines(s, d).withColumn("app_name", F.lit("user")))


def _union(s: SparkSession, d: str) -> DataFrame:
    return exact.union_entries(views.documents(s, d), views.conversations(s, d)).groupBy("source_rank", "app_name").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def _tree_texts(s: SparkSession, d: str) -> DataFrame:
    return tree.extract(tree.html_nodes(s.read.parquet(f"{d}/pages.parquet"))).select("tree_id", "node_id", "role", "text")


def _html_nodes(s: SparkSession, d: str) -> DataFrame:
    return tree.html_nodes(s.read.parquet(f"{d}/pages.parquet")).groupBy("tree_id", "role").agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.length(F.array_join("value", ""))), F.lit(0)).cast("bigint").alias("chars"))


def _ngrams(s: SparkSession, d: str) -> DataFrame:
    return ngrams.counts(ngrams.corpus(views.documents(s, d), views.conversations(s, d)))


def _ngram_model(s: SparkSession, d: str) -> DataFrame:
    tables = ngrams.model(ngrams.counts(views.conversations(s, d), 4))
    return reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("kind"), "n", "gram", "value") for k, t in tables.items()))


def _ngram_scores(s: SparkSession, d: str) -> DataFrame:
    """What the model of the conversations makes of each three characters of the documents that follow another and are letters."""
    tables = ngrams.model(ngrams.counts(views.conversations(s, d), 3))
    grams = views.documents(s, d).select(F.explode(X.char_ngrams("text", 3)).alias("gram")).where(F.col("gram").rlike("^[a-z]{3}$")).distinct()
    return ngrams.scored(grams.select(F.left("gram", F.lit(2)).alias("context"), F.substring("gram", 3, 1).alias("next")), tables).select("context", "next", F.round("p", 9).alias("p"))


def _walked_texts(s: SparkSession, d: str) -> DataFrame:
    return tree.walked(views.shop_nodes(s, d)).select("tree_id", "node_id", "role", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "position", "text")


def _walked_once(s: SparkSession, d: str) -> DataFrame:
    return exact.consecutive_dedup(tree.walked(views.shop_nodes(s, d))).select("tree_id", "node_id", "role", "position", "text")


def _continuations(s: SparkSession, d: str) -> DataFrame:
    return ngrams.continuations(_ngrams(s, d))


def _wire_lines(s: SparkSession, d: str) -> str:
    """The path of a JSON-lines table of the documents in the shared folder, in which each seventh line is broken."""
    path = f"{shared_dir(s)}/loam/jsonl-{uuid.uuid4().hex}"
    written(s).append(path)
    entry = F.to_json(F.struct(F.col("app_name").alias("appName"), "text", (F.col("seq") + F.lit(0.5)).alias("timestamp")))
    views.documents(s, d).select(F.when(F.col("seq") % 7 == 0, F.concat(F.lit("not json {"), F.col("seq").cast("string"))).otherwise(entry).alias("value")).write.text(path)
    return path


def _jsonl_entries(s: SparkSession, d: str) -> DataFrame:
    return jsonl.read_good(s, _wire_lines(s, d)).select("app_name", "text", X.to_reference_seconds("ts").alias("seconds"))


def _jsonl_purged(s: SparkSession, d: str) -> DataFrame:
    path = _wire_lines(s, d)
    curation.purge(s, path, Settings(avoid_apps=(), min_text_length=0))
    unreadable = s.read.text(path + ".unreadable").select(F.lit("unreadable").alias("kind"), F.col("value").alias("text"))
    return jsonl.read_good(s, path).select(F.lit("kept").alias("kind"), "text").unionByName(unreadable)


def _log_purged(s: SparkSession, d: str) -> DataFrame:
    """Appends of a table with a commit log, one made twice, a write that was never committed, and a purge while more is appended."""
    path = f"{shared_dir(s)}/loam/log-{uuid.uuid4().hex}"
    written(s).append(path)
    log, rows = Log(s, path), views.documents(s, d).withColumn("ts", F.timestamp_seconds(F.lit(1e9)))
    for k in (0, 1, 1):
        log.append(jsonl.wire(rows.where(F.col("seq") % 3 == k)), "documents", k)
    jsonl.wire(rows).write.json(f"{path}/data/cut-off")
    before = log.state()
    log.append(jsonl.wire(rows.where(F.col("seq") % 3 == 2)), "documents", 2)
    log.replace(log.read(before.version).groupBy("text").agg(F.min("appName").alias("appName"), F.min("timestamp").alias("timestamp")).select("appName", "text", "timestamp"), before, "purge", 0)
    log.sweep()
    return log.read().groupBy("text").agg(F.count("*").alias("times"))


def _jsonl_chunks(s: SparkSession, d: str) -> DataFrame:
    """The broken table of ``_wire_lines`` by ranges of 64 KiB, cut within lines and characters."""
    found = chunks.scan(s, _wire_lines(s, d), 64 << 10)
    return chunks.entries(found).select("app_name", "text", X.to_reference_seconds("ts").alias("seconds"))


#: Bytes and number of the texts of one file, and so of one batch of the stream. A batch's texts are spread over all tasks; one row for each meets in one.
FILE_BYTES, FILE_TEXTS = 256 << 20, 500_000
#: Bytes of a row group of such a file; one task reads and cleans a group.
ROW_GROUP = 4 << 20


def _in_files(s: SparkSession, d: str, files: int = 4) -> str:
    """A folder with the documents in files by id, which a stream takes one after the other: so many, or more if one would hold over ``FILE_BYTES`` or ``FILE_TEXTS``."""
    path = f"{shared_dir(s)}/loam/files-{uuid.uuid4().hex}"
    written(s).append(path)
    rows = views.documents(s, d).withColumn("ts", F.timestamp_seconds(F.lit(1e9)))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    rows.repartitionByRange(max(files, -(-size // FILE_BYTES), -(-texts // FILE_TEXTS)), "seq").sortWithinPartitions("seq").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    fs, folder = jsonl.filesystem(s, path)
    names = sorted(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        fs.setTimes(jsonl.filesystem(s, name)[1], 1_700_000_000_000 + 1000 * k, -1)
    return path


def _stream_buffered(s: SparkSession, d: str) -> DataFrame:
    """Ingestion by state and timers over several batches; what waits at the end is saved."""
    source = _in_files(s, d)
    at = f"{source}-out"
    written(s).append(at)
    rows = s.readStream.schema(s.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    buffered.start(rows, f"{at}/table", f"{at}/checkpoint", once=True).awaitTermination()
    buffered.drain(s, f"{at}/table", f"{at}/checkpoint")
    return Log(s, f"{at}/table").read().select(F.col("appName").alias("app_name"), "text")


def _progressive_dedup(s: SparkSession, d: str) -> DataFrame:
    """Exact dedup of the lines by six sections, stopped and begun again in between."""
    path = f"{shared_dir(s)}/loam/sections-{uuid.uuid4().hex}"
    written(s).append(path)
    progressive.SectionedDedup(views.lines(s, d), path, 6).run(2)
    return progressive.progressive_dedup(s, views.lines(s, d), path)


def _purged_totals(s: SparkSession, d: str) -> DataFrame:
    return maintenance.purged_statistics(s, _wire_lines(s, d), Settings(avoid_apps=(), min_text_length=0))


def _stream_ingest(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/loam/stream-{uuid.uuid4().hex}"
    written(s).append(path)
    source = f"{d}/documents.parquet"
    rows = s.readStream.schema(s.read.parquet(source).schema).parquet(f"{d}/[d]ocuments.parquet")  # a pattern, as a stream takes no path of one file
    rows = rows.select(F.col("doc_id").alias("seq"), F.col("source").alias("app_name"), "text", F.current_timestamp().alias("ts"))
    ingest.start(rows, f"{path}/table", f"{path}/checkpoint", once=True).awaitTermination()
    return s.read.schema(WIRE).json(f"{path}/table").select(F.col("appName").alias("app_name"), "text")


def _root_titles(s: SparkSession, d: str) -> DataFrame:
    return tree.root_titles(views.shop_nodes(s, d)).groupBy("tree_id", "root_id", "title").agg(F.count("*").alias("nodes"))


def _app_lists(s: SparkSession, d: str) -> DataFrame:
    named = views.documents(s, d).select("app_name", F.when(F.length("app_name") == 4, "regular").otherwise("accessory").alias("policy"))
    return apps.search(apps.listed(apps.running(named), (*AVOID, "Finder")), "SRC")


def _ngram_merge(s: SparkSession, d: str) -> DataFrame:
    return ngrams.merged(ngrams.counts(views.documents(s, d), 3), ngrams.counts(views.conversations(s, d), 3))


def _line_traits(s: SparkSession, d: str) -> DataFrame:
    classes = [X.count_japanese("text").alias("ja"), X.count_english("text").alias("en"), X.count_numbers("text").alias("num")]
    return views.lines(s, d).select("seq", X.is_name("text").alias("is_name"), X.is_symbol_or_number("text").alias("is_symbol"), X.label("text").alias("label"), X.composite_key("app_name", "text").alias("key"), X.clusters("text").cast("bigint").alias("clusters"), *classes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "jsonl_entries": _jsonl_entries,
    "jsonl_quarantine": lambda s, d: jsonl.read(s, _wire_lines(s, d))[1],
    "jsonl_purged": _jsonl_purged,
    "purged_totals": _purged_totals,
    "stream_ingest": _stream_ingest,
    "deep_tree_texts": lambda s, d: tree.extract(views.shop_nodes(s, d)).select("tree_id", "node_id", "role", "text"),
    "tree_root_titles": _root_titles,
    "app_lists": _app_lists,
    "ngram_merge": _ngram_merge,
    "line_traits": _line_traits,
    "curated_sources": curated_sources,
    "clean_lines": _clean_lines,
    "split_fragments": _split_fragments,
    "filter_symbol_only": _filter_symbol_only,
    "quality_filter": _quality_filter,
    "exclude_apps": _exclude_apps,
    "exact_dedup": lambda s, d: exact.exact_dedup(views.documents(s, d), AVOID, 3),
    "exact_dedup_stats": lambda s, d: exact.exact_dedup_stats(views.documents(s, d), AVOID, 3),
    "pair_dedup": _pair_dedup,
    "consecutive_dedup": _consecutive_dedup,
    "ingest": _ingest,
    "prefix_dedup_lines": lambda s, d: prefix.prefix_dedup(views.lines(s, d)),
    "adjacent_prefix": lambda s, d: prefix.simple_purge(views.lines(s, d), AVOID, 3),
    "longest_prefix": _longest_prefix,
    "shingles": _shingles,
    "minhash_signature": _minhash_signature,
    "similar_pairs": _similar_pairs,
    "similar_dedup_98": _similar_98,
    "similar_dedup_70": _similar_70,
    "potential_duplicates": _potential,
    "find_duplicates": _find_duplicates,
    "app_counts": lambda s, d: statistics.app_counts(views.documents(s, d)),
    "app_statistics": lambda s, d: statistics.app_statistics(views.lines(s, d), AVOID),
    "totals": lambda s, d: statistics.totals(views.lines(s, d), AVOID),
    "language_mix": lambda s, d: statistics.language_mix(views.lines(s, d), AVOID),
    "separated_statistics": _separated,
    "summary": lambda s, d: statistics.summary(statistics.totals(views.lines(s, d), AVOID)),
    "top5_others": _top5,
    "last_n": lambda s, d: exact.last_rows(views.lines(s, d), 1000),
    "import_new_lines": _import_new,
    "combined_union": _union,
    "html_nodes": _html_nodes,
    "tree_texts": _tree_texts,
    "ngram_counts": _ngrams,
    "ngram_continuations": _continuations,
    "ngram_model": _ngram_model,
    "ngram_scores": _ngram_scores,
    "tree_texts_ordered": _walked_texts,
    "tree_texts_once": _walked_once,
    "log_purged": _log_purged,
    "progressive_dedup": _progressive_dedup,
    "jsonl_chunks": _jsonl_chunks,
    "stream_buffered": _stream_buffered,
}
#: Queries without SQL.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_BREAK = r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x0B\x{{85}}]+|[\s\p{{Z}}\x0B\x{{85}}]+$', '', 'g')"
_GLUE = r"regexp_replace({}, '[\s\p{{Z}}\x0B\x{{85}}]+', ' ', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x)


def _one_line(x: str) -> str:
    return _trim(_GLUE.format(f"replace({x}, chr(13), '')"))


def _collapsed(x: str) -> str:
    return _trim(_GLUE.format(x))


_DOCS = "docs as (select doc_id as seq, source as app_name, text from documents)"
_CONV = "conv as (select conv_id * 1000000 + turn as seq, role as app_name, text from conversations)"
_LINES = f"""lines as materialized (
    select doc_id * 1000000 + pos - 1 as seq, app_name, {_trim("line")} as text
    from (select doc_id, source as app_name, unnest(regexp_split_to_array(text, '{_BREAK}')) as line, generate_subscripts(regexp_split_to_array(text, '{_BREAK}'), 1) as pos from documents)
)"""
_SYMBOL = r"regexp_full_match(text, '[!-@\[-`{-~]*')"
_AVOID = f"(app_name is null or app_name not in ({_list(AVOID)}))"
_ACCEPTED = f"length_grapheme(text) between 3 and 1000 and not {_SYMBOL}"
_FRAGMENTS = f"list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r\\t]|  '), lambda x: {_trim('x')}), lambda x: x <> '')"
_ROLE = f"[{_list(ROLES)}][seq % {len(ROLES)} + 1]"
_GRAMS = "case when length({0}) = 0 then [] when length({0}) < {1} then [{0}] else list_transform(range(1, length({0}) - {1} + 2), lambda i: substring({0}, i, {1})) end"
_COUNTS = "length_grapheme(text) as chars, length(regexp_replace(text, '[^ぁ-ゖァ-ヺ一-龯]', '', 'g')) as ja, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as en, length(regexp_replace(text, '[^0-9]', '', 'g')) as num"


def _quality_sql() -> str:
    cjk = quality.CJK
    checks = [
        "t <> ''",
        "not (length_grapheme(t) > 2 and len(list_distinct(string_split(t, ''))) = 1)",
        f"not (role not in ('AXMessage', 'AXText', 'AXGroup') and t in ({_list(quality.UI_STRINGS)}))",
        "not (role <> 'AXLink' and (starts_with(t, 'http') or starts_with(t, 'www.') or contains(t, '://')))",
        r"not (starts_with(t, '/') or contains(t, '\') or ends_with(t, '.app') or ends_with(t, '.exe'))",
        r"""not regexp_full_match(t, '[\p{Nd}!@#$%^&*()_+\-=\[\]{}|;'':",./<>?]*')""",
        f"len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda w: length_grapheme(w) > 50 and not regexp_matches(w, '{cjk}'))) = 0",
        f"not (role in ('AXTextField', 'AXTextArea') and t in ({_list(quality.PLACEHOLDERS)}))",
        "not (role = 'AXButton' and length_grapheme(t) < 2)",
    ]
    return " and ".join(checks)


def _signature_sql(source: str) -> str:
    mins = ", ".join(f"min((h * {a} + {b}) % {minhash.PRIME}) as m{k}" for k, (a, b) in enumerate(map(minhash.factors, range(minhash.SIZE))))
    return f"""
grams as (select distinct seq, unnest({_GRAMS.format("t", 3)}) as gram from (select seq, {_collapsed("text")} as t from {source})),
hashes as (select gram, ('0x' || left(md5(gram), 7))::bigint as h from (select distinct gram from grams)),
found as (select seq, {mins} from grams join hashes using (gram) group by seq),
signed as materialized (
    select seq, app_name, text, {", ".join(f"coalesce(m{k}, 0)::bigint as m{k}" for k in range(minhash.SIZE))},
           [{", ".join(f"coalesce(m{k}, 0)::bigint" for k in range(minhash.SIZE))}] as sig
    from {source} left join found using (seq)
)"""


_SAME = f"({' + '.join(f'(a.m{k} = b.m{k})::int' for k in range(minhash.SIZE))}) / {minhash.SIZE}.0"
_NEAR = "abs(length(a.text) - length(b.text)) * 2 <= greatest(length(a.text), length(b.text))"
_FIRST_TEXT = "select seq, app_name, text from {0} qualify row_number() over (partition by nfc_normalize(text) order by seq) = 1"


def _totals_sql(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
pairs as (select {key}app_name, text, count(*) as copies from {source} group by {key}app_name, text),
counted as (select {key}copies, {_AVOID} as ok, {_COUNTS} from pairs),
summed as (
    select {key}coalesce(sum(ok::int), 0)::bigint as entries, {", ".join(f"coalesce(sum({c}) filter (ok), 0)::bigint as {c}" for c in ("chars", "ja", "en", "num"))},
           coalesce(sum(copies - 1), 0)::bigint as duplicates
    from counted {group}
),
mixed as (select *, chars - ja - en - num as other from summed),
totals as (
    select {key}entries, chars, (case when entries > 0 then chars // entries else 0 end)::bigint as mean_chars, duplicates, ja, en, num, other,
           {", ".join(f"(case when chars > 0 then floor({c} / chars * 100) else 0 end)::bigint as {c}_percent" for c in ("ja", "en", "num", "other"))}
    from mixed
)"""


def _fold_sql(source: str, key: str, order: str, covered: str) -> str:
    """Rows of ``source`` kept by a fold in each group: a row goes if ``covered`` holds for it, ``x``, and a kept row, ``k``."""
    return f"""
select app_name, seq, text from (
    select app_name, unnest(list_reduce(list([struct_pack(seq := seq, text := text, n := length(text))] order by {order}),
        lambda kept, more: case when len(list_filter(kept, lambda k: {covered.replace("x.", "more[1].")})) > 0 then kept else list_concat(kept, more) end), recursive := false) as r
    from {source} group by app_name, {key}
) t, lateral (select t.r.seq as seq, t.r.text as text)
"""


_COVERS = "k.n > x.n and x.n * 10 >= k.n * 7 and x.n >= 2 and left(k.text, greatest(2, (x.n * 3 + 4) // 5)::int) = left(x.text, greatest(2, (x.n * 3 + 4) // 5)::int)"
_PREFIX_IN = "select app_name, min(seq) as seq, text from {0} where text <> '' group by app_name, text"
_HTML = r"regexp_replace(html, '(?s)<(script|style|nav)\b.*?</(script|style|nav)>|<!--.*?-->', '', 'g')"
_TAGS = r"<(p|h1|td|title|span|b|a|button|li|div)(?: [^>]*)?>([^<]+)"
_NODES = f"""nodes as (
    select page_id as tree_id, i as node_id, case {" ".join(f"when tag = '{t}' then '{r}'" for t, r in tree.TAG_ROLES.items())} end as role, text
    from (select page_id, unnest(regexp_extract_all(h, '{_TAGS}', 1)) as tag, unnest(regexp_extract_all(h, '{_TAGS}', 2)) as text, generate_subscripts(regexp_extract_all(h, '{_TAGS}', 1), 1) as i
          from (select page_id, {_HTML} as h from pages))
)"""


def _grams(source: str, most: int) -> str:
    ahead = ["c", *(f"lead(c, {k}) over w" for k in range(1, most))]
    columns = ", ".join(f"{' || '.join(ahead[:n])} as g{n}" for n in range(1, most + 1))
    each = " union all ".join(f"select {n} as n, g{n} as gram from ahead" for n in range(1, most + 1))
    return f"""{_DOCS}, {_CONV},
corpus as (select row_number() over () as r, text from ({source}) where text <> ''),
places as (select r, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from corpus),
ahead as (select {columns} from places window w as (partition by r order by i)),
grams as (select n, gram, count(*) as times from ({each}) where gram is not null group by n, gram)"""


_BOTH = "select text from docs union all select text from conv"
_NGRAMS, _UNION_GRAMS = _grams(_BOTH, 5), _grams(_BOTH, 3)
_KINDS_SQL = """
kinds as (
    select 'c_abc' as kind, n, gram, times as value from grams
    union all select 'u_abx', n - 1, left(gram, length(gram) - 1), count(*) from grams where n > 1 group by all
    union all select 'u_xbc', n - 1, substring(gram, 2), count(*) from grams where n > 1 group by all
    union all select 'r_xbx', n - 2, substring(gram, 2, length(gram) - 2), count(*) from grams where n > 2 group by all
    union all select 'c_bc', n - 1, substring(gram, 2), sum(times) from grams where n > 1 group by all
)"""
_SHOP = """nodes as (
    select r_regionkey::bigint as tree_id, 0::bigint as node_id, 'AXWindow' as role, [r_name] as texts from region
    union all select n_regionkey, n_nationkey + 1, 'AXGroup', [n_name] from nation where n_nationkey % 6 > 1
    union all select n_regionkey, c_custkey + 1000, 'AXList', [c_name] from customer join nation on c_nationkey = n_nationkey where n_nationkey % 6 > 1 and c_custkey % 10 <> 0
    union all select n_regionkey, o_orderkey + 1000000000, ['AXStaticText', 'AXButton', 'AXLink'][o_orderkey % 3 + 1], case o_orderkey % 3 when 0 then [o_orderpriority || ' order ' || o_orderkey] else ['order', o_orderpriority || ' order ' || o_orderkey] end
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_nationkey % 6 > 1 and c_custkey % 10 <> 0
)"""

_WALK = f"""{_SHOP},
paths as (
    select n.*, case when node_id = 0 then [0::bigint] when node_id < 1000 then [0, node_id] when node_id < 1000000000 then [0, c.c_nationkey + 1, node_id] else [0, x.c_nationkey + 1, o_custkey + 1000, node_id] end as path
    from nodes n left join customer c on node_id = c.c_custkey + 1000 left join orders on node_id = o_orderkey + 1000000000 left join customer x on x.c_custkey = o_custkey
),
-- a link's value is met twice, first by itself
met as (select tree_id, node_id, role, path, case when role = 'AXLink' then list_concat([texts[2]], [texts[2], texts[1]]) else texts end as texts from paths),
walk as (
    select * from (select tree_id, node_id, role, path, (generate_subscripts(texts, 1) - 1)::int as position, unnest(texts) as text, {_trim("unnest(texts)")} as t from met) where {_quality_sql()}
)"""

ORACLE_SQL: dict[str, str] = {
    "jsonl_entries": "select source as app_name, text, doc_id + 0.5::double as seconds from documents where doc_id % 7 <> 0",
    "jsonl_quarantine": "select 'not json {' || doc_id as value from documents where doc_id % 7 = 0",
    "jsonl_purged": "select distinct 'kept' as kind, text from documents where doc_id % 7 <> 0 union all select 'unreadable', 'not json {' || doc_id from documents where doc_id % 7 = 0",
    "purged_totals": f"with purged as (select distinct 'any' as app_name, text from documents where doc_id % 7 <> 0), {_totals_sql('purged')} select * from totals",
    "deep_tree_texts": f"with {_SHOP} select tree_id, node_id, role, text from (select *, {_trim('text')} as t from (select tree_id, node_id, role, unnest(texts) as text from nodes)) where {_quality_sql()}",
    "tree_root_titles": "select r_regionkey::bigint as tree_id, 0::bigint as root_id, r_name as title, (1 + (select count(*) from nation where n_regionkey = r_regionkey) + (select count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey = r_regionkey) + (select count(*) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = r_regionkey))::bigint as nodes from region",
    "app_lists": f"select app_name, app_name in ({_list((*AVOID, 'Finder'))}) as excluded from (select source as app_name from documents where length(source) = 4 union select unnest([{_list((*AVOID, 'Finder'))}])) where contains(lower(app_name), 'src')",
    "ngram_merge": f"with {_UNION_GRAMS} select n, gram, times from grams",
    "line_traits": f"with {_LINES} select seq, regexp_full_match(text, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Zs}}\\t\\n\\r./-]*') as is_name, {_SYMBOL} as is_symbol, left(text, 10) as label, concat_ws('-', app_name, text) as key, length_grapheme(text) as clusters, length(regexp_replace(text, '[^ぁ-ゖァ-ヺ一-龯]', '', 'g'))::int as ja, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::int as en, length(regexp_replace(text, '[^0-9]', '', 'g'))::int as num from lines",
    "curated_sources": f"with {_LINES}, clean as (select distinct app_name, t as text from (select app_name, {_one_line('text')} as t from lines) where {_ACCEPTED.replace('text', 't')} and {_AVOID}) select app_name, count(*) as entries, sum(length_grapheme(text))::bigint as chars from clean group by app_name",
    "clean_lines": f"with {_LINES} select seq, app_name, t as text from (select seq, app_name, {_one_line('text')} as t from lines) where length_grapheme(t) between 3 and 1000",
    "split_fragments": f"with {_DOCS} select seq, app_name, (generate_subscripts({_FRAGMENTS}, 1) - 1)::int as pos, unnest({_FRAGMENTS}) as fragment from docs",
    "filter_symbol_only": f"with {_LINES} select * from lines where not {_SYMBOL}",
    "quality_filter": f"with {_LINES} select seq, role, text from (select seq, {_ROLE} as role, text, text as t from lines) where {_quality_sql()}",
    "exclude_apps": f"with {_DOCS} select app_name, count(*) as n, sum(strlen(text))::bigint as bytes from docs where {_AVOID} group by app_name",
    "exact_dedup": f"with {_DOCS}, ok as (select * from docs where {_AVOID} and length_grapheme(text) >= 3) {_FIRST_TEXT.format('ok')}",
    "exact_dedup_stats": f"with {_DOCS}, ok as (select * from docs where {_AVOID} and length_grapheme(text) >= 3), n as (select count(*) as processed, count(distinct nfc_normalize(text)) as kept from ok) select processed, kept, processed - kept as removed, case when processed > 0 then (processed - kept) / processed * 100 else 0.0 end as reduction_rate from n",
    "pair_dedup": f"with {_LINES} select seq, app_name, text from lines qualify row_number() over (partition by nfc_normalize(app_name), nfc_normalize(text) order by seq) = 1",
    "consecutive_dedup": f"with {_LINES} select seq, app_name, text from lines where {_ACCEPTED} and {_AVOID} qualify text is distinct from lag(text) over (order by seq)",
    "ingest": f"with {_DOCS}, parts as (select seq * 1000 + generate_subscripts({_FRAGMENTS}, 1) - 1 as seq, app_name, unnest({_FRAGMENTS}) as part from docs where length_grapheme(text) between 3 and 1000), clean as (select seq, app_name, {_one_line('part')} as text from parts) select * from clean where {_ACCEPTED} and app_name <> 'Finder' qualify text is distinct from lag(text) over (order by seq)",
    "prefix_dedup_lines": f"with {_LINES}, one as ({_PREFIX_IN.format('lines')}) {_fold_sql('one', 'left(text, 2)', '-length(text), seq', _COVERS)}",
    "adjacent_prefix": f"""with {_LINES}, ok as (select seq, app_name, text from lines where {_AVOID} and not {_SYMBOL} and strlen(text) >= 3 qualify row_number() over (partition by app_name, text order by seq) = 1),
marked as (select *, case when lag(app_name) over w is not distinct from app_name and left(lag(text) over w, 1) = left(text, 1) then 0 else 1 end as new from ok window w as (order by seq)),
runs as (select *, sum(new) over (order by seq) as run from marked)
{_fold_sql("runs", "run", "seq", "k.seq = kept[-1].seq and (starts_with(k.text, x.text) or starts_with(x.text, k.text))")}""",
    "longest_prefix": "with words as (select distinct w from (select unnest(regexp_split_to_array(text, '\\s+')) as w from documents) where w <> '') select a.w as word, max_by(b.w, length(b.w)) as prefix from words a left join words b on length(b.w) <= 6 and left(a.w, length(b.w)) = b.w where length(a.w) > 6 group by a.w",
    "shingles": f"with {_LINES}, g as (select seq, unnest({_GRAMS.format('t', 3)}) as gram from (select seq, {_collapsed('text')} as t from lines where text <> '')) select gram, count(*) as times, count(distinct seq) as texts from g group by gram",
    "minhash_signature": f"with {_DOCS}, {_signature_sql('docs')} select seq, {', '.join(f'm{k}' for k in range(minhash.SIZE))} from signed",
    "similar_pairs": f"with {_DOCS}, one as ({_FIRST_TEXT.format('docs')}), {_signature_sql('one')} select a.seq as before, b.seq as node, ({_SAME})::double as similarity from signed a join signed b on a.seq < b.seq where {_NEAR} and {_SAME} >= 0.7",
    "similar_dedup_98": f"with {_DOCS}, {_signature_sql('docs')} select seq, app_name from signed qualify row_number() over (partition by sig order by seq) = 1",
    "potential_duplicates": f"with {_DOCS}, {_signature_sql('docs')}, kept as (select * from signed qualify row_number() over (partition by sig order by seq) = 1) select a.seq as before, b.seq as node, ({_SAME})::double as similarity from kept a join kept b on a.seq < b.seq where {_SAME} >= 0.95",
    "app_counts": f"with {_DOCS} select app_name, count(*) as n from docs group by app_name",
    "app_statistics": f"with {_LINES} select app_name, count(*) as entries, sum(length_grapheme(text))::bigint as chars from (select distinct app_name, text from lines) where {_AVOID} group by app_name",
    "totals": f"with {_LINES}, {_totals_sql('lines')} select * from totals",
    "language_mix": f"with {_LINES}, {_totals_sql('lines')} select unnest(['JA', 'EN', 'Num', 'Other']) as key, unnest([ja, en, num, other]) as value from totals",
    "summary": f"with {_LINES}, {_totals_sql('lines')} select concat_ws(chr(10), 'Source: combined', 'Entries: ' || entries, 'Characters: ' || chars, 'Mean characters: ' || mean_chars, case when chars > 0 then concat_ws(chr(10), 'Japanese: ' || ja || ' (' || ja_percent || '%)', 'English: ' || en || ' (' || en_percent || '%)', 'Numbers: ' || num || ' (' || num_percent || '%)', 'Other: ' || other || ' (' || other_percent || '%)') end, 'Duplicates removed: ' || duplicates) as summary from totals",
    "top5_others": f"with {_LINES}, n as (select app_name as key, count(*) as value from (select distinct app_name, text from lines) where {_AVOID} group by app_name), r as (select *, row_number() over (order by value desc, key) as rank from n) select case when rank <= 5 then key else 'Others' end as key, sum(value)::bigint as value from r group by 1",
    "last_n": f"with {_LINES} select seq, app_name, text from lines order by seq desc limit 1000",
    "import_new_lines": f"""with {_LINES}, {_CONV},
parts as (select seq * 1000 + generate_subscripts(regexp_split_to_array(text, '{_BREAK}'), 1) - 1 as seq, app_name, {_trim(f"unnest(regexp_split_to_array(text, '{_BREAK}'))")} as text from conv)
select p.seq, p.app_name, p.text from parts p where p.text <> '' and length_grapheme(p.text) >= 5 and not (p.app_name = 'user' and p.text in (select text from lines)) qualify row_number() over (partition by p.app_name, p.text order by p.seq) = 1""",
    "combined_union": f"with {_DOCS}, {_CONV}, u as (select 0::int as source_rank, * from docs union all select 1, * from conv) select source_rank, app_name, count(*) as n, max(seq) as last_seq from u group by source_rank, app_name",
    "html_nodes": f"with {_NODES} select tree_id, role, count(*) as nodes, sum(length(text))::bigint as chars from nodes group by tree_id, role union all select page_id, 'AXWebArea', count(*), 0 from pages group by page_id",
    "tree_texts": f"with {_NODES} select tree_id, node_id, role, text from (select *, {_trim('text')} as t from nodes) where {_quality_sql()}",
    "ngram_counts": f"with {_NGRAMS} select n, gram, times from grams",
    "ngram_continuations": f"""with {_NGRAMS},
r as (select n - 1 as n, left(gram, length(gram) - 1) as gram, count(*) as right_kinds from grams where n > 1 group by all),
l as (select n - 1 as n, substring(gram, 2) as gram, count(*) as left_kinds from grams where n > 1 group by all)
select n, gram, coalesce(left_kinds, 0) as left_kinds, coalesce(right_kinds, 0) as right_kinds from l full join r using (n, gram)""",
}
ORACLE_SQL["jsonl_chunks"] = ORACLE_SQL["jsonl_entries"]
ORACLE_SQL["progressive_dedup"] = f"with {_LINES} {_FIRST_TEXT.format('lines')}"
ORACLE_SQL["log_purged"] = "select text, sum(times)::bigint as times from (select distinct text, 1 as times from documents where doc_id % 3 < 2 union all select text, 1 from documents where doc_id % 3 = 2) group by text"
ORACLE_SQL["tree_texts_ordered"] = f"with {_WALK} select tree_id, node_id, role, array_to_string(path, '/') as path, position, text from walk"
ORACLE_SQL["tree_texts_once"] = f"with {_WALK} select tree_id, node_id, role, position, text from walk qualify text is distinct from lag(text) over (order by tree_id, path, position)"
ORACLE_SQL["ngram_model"] = f"with {_grams('select text from conv', 4)}, {_KINDS_SQL} select kind, n, gram, value::bigint as value from kinds"
ORACLE_SQL["ngram_scores"] = f"""with {_grams("select text from conv", 3)}, {_KINDS_SQL},
asked as (select distinct left(gram, 2) as context, substring(gram, 3, 1) as next from (select unnest({_GRAMS.format("text", 3)}) as gram from docs) where regexp_full_match(gram, '[a-z]{{3}}')),
starts as (select left(gram, length(gram) - 1) as c, sum(times) as total, count(*) as kinds from grams where n > 1 group by 1),
low as (select gram as next, value / (select sum(value) from kinds where kind = 'u_xbc' and n = 1) as p from kinds where kind = 'u_xbc' and n = 1),
one as (select a.*, coalesce(p, 0) as p0, coalesce(g.times, 0) as t1, s.total as n1, s.kinds as k1 from asked a left join low l using (next) left join grams g on g.gram = substring(a.context, 2) || a.next left join starts s on s.c = substring(a.context, 2)),
two as (select a.*, case when n1 is null then p0 else greatest(t1 - 0.75, 0) / n1 + 0.75 * k1 / n1 * p0 end as p1, coalesce(g.times, 0) as t2, s.total as n2, s.kinds as k2 from one a left join grams g on g.gram = a.context || a.next left join starts s on s.c = a.context)
select context, next, round((case when n2 is null then p1 else greatest(t2 - 0.75, 0) / n2 + 0.75 * k2 / n2 * p1 end)::double, 9) as p from two"""
ORACLE_SQL["stream_ingest"] = ORACLE_SQL["stream_buffered"] = f"select app_name, text from ({ORACLE_SQL['ingest']})"
ORACLE_SQL["separated_statistics"] = (
    f"with {_LINES}, {_CONV}, tagged as (select 'saved' as scope, app_name, text from lines union all select 'import', app_name, text from conv), "
    f"every as (select * from tagged union all select 'combined', app_name, text from tagged), {_totals_sql('every', 'scope')} select * from totals"
)
ORACLE_SQL["similar_dedup_70"] = f"""with {_DOCS}, ok as (select * from docs where {_AVOID} and strlen(text) >= 20), one as ({_FIRST_TEXT.format("ok")}), {_signature_sql("one")},
kept as (
    select list_reduce(list([struct_pack(seq := seq, app_name := app_name, n := length(text), sig := sig)] order by seq),
        lambda kept, more: case when len(list_filter(kept, lambda k: abs(k.n - more[1].n) * 2 <= greatest(k.n, more[1].n)
            and len(list_filter(list_zip(k.sig, more[1].sig), lambda z: z[1] = z[2])) >= 14)) > 0 then kept else list_concat(kept, more) end) as rows
    from signed
)
select r.seq as seq, r.app_name as app_name from (select unnest(rows) as r from kept)"""
ORACLE_SQL["find_duplicates"] = f"""with {_LINES}, ok as (select * from lines where {_AVOID} and length_grapheme(text) >= 3), one as ({_FIRST_TEXT.format("ok")}),
kept as ({_fold_sql("(" + _PREFIX_IN.format("one") + ")", "left(text, 2)", "-length(text), seq", _COVERS)}), {_signature_sql("kept")}
select seq, app_name, text from signed qualify row_number() over (partition by sig order by seq) = 1"""
