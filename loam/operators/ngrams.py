"""Training corpus and character n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.exact import union_entries
from loam.sources import jsonl


def corpus(saved: DataFrame, imported: DataFrame, last: int | None = None) -> DataFrame:
    """Texts of both sources; with ``last``, of their last rows only, saved before imported."""
    both = union_entries(saved, imported)
    if last is None:
        return both.select("text")
    return both.orderBy(F.desc("source_rank"), F.desc("seq")).limit(last).select("text")


def counts(texts: DataFrame, most: int = 5) -> DataFrame:
    """``n, gram, times`` for n from 1 to ``most``; texts shorter than n add nothing to n."""
    # one row for each place: the text from there, of ``most`` characters or what is left; shorter grams are its starts
    ahead = F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{1,%d}))." % most), 1)
    places = texts.where(F.length("text") > 0).select(F.explode(ahead).alias("gram"))
    counted = places.groupBy("gram").agg(F.count("*").alias("times"))
    starts = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.struct(n.alias("n"), F.left("gram", n).alias("gram")))
    return counted.select(F.explode(starts).alias("x"), "times").groupBy("x.n", "x.gram").agg(F.sum("times").alias("times"))


def continuations(grams: DataFrame) -> DataFrame:
    """``n, gram, left_kinds, right_kinds``: distinct characters seen before and after each gram (for smoothing; an extension)."""
    longer = grams.where("n > 1")
    after = longer.select((F.col("n") - 1).alias("n"), F.expr("left(gram, length(gram) - 1)").alias("gram")).groupBy("n", "gram").agg(F.count("*").alias("right_kinds"))
    before = longer.select((F.col("n") - 1).alias("n"), F.expr("substring(gram, 2)").alias("gram")).groupBy("n", "gram").agg(F.count("*").alias("left_kinds"))
    return before.join(after, ["n", "gram"], "full").na.fill(0, ["left_kinds", "right_kinds"])


def merged(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts of an incremental run added to those held."""
    return old.unionByName(delta).groupBy("n", "gram").agg(F.sum("times").alias("times"))


#: The tables of a language model, by what they hold for each gram: its count, kinds of characters after it, before it,
#: on both sides of it, and its count as the end of a longer gram.
KINDS = ("c_abc", "u_abx", "u_xbc", "r_xbx", "c_bc")


def model(grams: DataFrame) -> dict[str, DataFrame]:
    """The five tables ``n, gram, value`` of counted grams ``n, gram, times``; zeros have no row."""
    longer, longest = grams.where("n > 1"), grams.where("n > 2")

    def summed(rows: DataFrame, gram: str, off: int, value) -> DataFrame:
        return rows.select((F.col("n") - off).alias("n"), F.expr(gram).alias("gram"), "times").groupBy("n", "gram").agg(value.cast("bigint").alias("value"))

    return {
        "c_abc": grams.select("n", "gram", F.col("times").alias("value")),
        "u_abx": summed(longer, "left(gram, length(gram) - 1)", 1, F.count("*")),
        "u_xbc": summed(longer, "substring(gram, 2)", 1, F.count("*")),
        "r_xbx": summed(longest, "substring(gram, 2, length(gram) - 2)", 2, F.count("*")),
        "c_bc": summed(longer, "substring(gram, 2)", 1, F.sum("times")),
    }


def place(path: str, kind: str) -> str:
    """Where a table of the model at ``path`` is: the counts there, the others in folders that readers of the counts pass over."""
    return path if kind == KINDS[0] else f"{path}/_{kind}"


def written_model(grams: DataFrame, path: str) -> None:
    """Put the tables of these counts in the place of those at ``path``, all five at once."""
    spark = grams.sparkSession
    jsonl.recover(spark, path)
    grams.select("n", "gram", "times").write.parquet(path + ".new")
    counted = spark.read.parquet(path + ".new")
    for kind, table in model(counted).items():
        if kind != KINDS[0]:
            table.write.parquet(place(path + ".new", kind))
    jsonl.swap(spark, path)


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The five tables, or None unless all are there."""
    jsonl.recover(spark, path)
    if not all(jsonl.exists(spark, place(path, k) + "/_SUCCESS") for k in KINDS):
        return None
    rest = {k: spark.read.parquet(place(path, k)) for k in KINDS[1:]}
    return {KINDS[0]: spark.read.parquet(path).select("n", "gram", F.col("times").alias("value")), **rest}


def rebuild(texts: DataFrame, path: str, most: int = 5) -> None:
    """Count anew: the base tables and, as their copy, those that incremental runs add to."""
    spark = texts.sparkSession
    written_model(counts(texts, most), f"{path}/original")
    written_model(spark.read.parquet(f"{path}/original"), f"{path}/current")


def extend(texts: DataFrame, path: str, most: int = 5) -> bool:
    """Add the counts of new texts to the current tables; False unless all five are there."""
    held = read_model(texts.sparkSession, f"{path}/current")
    if held is None:
        return False
    written_model(merged(held[KINDS[0]].withColumnRenamed("value", "times"), counts(texts, most)), f"{path}/current")
    return True


def scored(asked: DataFrame, tables: dict[str, DataFrame], discount: float = 0.75) -> DataFrame:
    """``context, next, p``: the probability of a character after a context, for distinct rows ``(context, next)``.

    Absolute discounting with back-off: of a context's count, ``discount`` for each kind
    of character seen after it is left to the context without its first character, down
    to the share of kinds of characters before ``next``. One lookup of each order, all
    by one equi-join to each table; contexts that were never seen leave all to shorter ones.
    """
    rows = asked.select("context", "next").distinct()
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("context"))).alias("k"))
    each = each.select("context", "next", F.expr("substring(context, k + 1)").alias("c"))
    look = lambda name: tables[name].select(F.col("gram").alias("__gram"), F.col("value").alias(f"__{name}"))
    begun = tables["c_abc"].where("n > 1").select(F.expr("left(gram, length(gram) - 1)").alias("__gram"), F.col("value")).groupBy("__gram").agg(F.sum("value").alias("__all"))
    got = each.join(look("c_abc"), F.concat("c", "next") == F.col("__gram"), "left").drop("__gram").join(begun, F.col("c") == F.col("__gram"), "left").drop("__gram").join(look("u_abx"), F.col("c") == F.col("__gram"), "left")
    every = tables["u_xbc"].where("n = 1").agg(F.sum("value").alias("__kinds"))
    low = rows.select("next").distinct().join(tables["u_xbc"].where("n = 1").select(F.col("gram").alias("next"), F.col("value").alias("__before")), "next", "left").crossJoin(every)  # one row
    orders = got.where("c <> ''").groupBy("context", "next").agg(F.sort_array(F.collect_list(F.struct(F.length("c").alias("n"), F.coalesce("__c_abc", F.lit(0)).alias("times"), F.coalesce("__all", F.lit(0)).alias("total"), F.coalesce("__u_abx", F.lit(0)).alias("kinds")))).alias("orders"))
    found = rows.join(low, "next", "left").join(orders, ["context", "next"], "left")
    start = F.coalesce(F.col("__before") / F.col("__kinds"), F.lit(0.0))
    step = lambda p, x: F.when(x["total"] == 0, p).otherwise(F.greatest(x["times"] - F.lit(discount), F.lit(0.0)) / x["total"] + F.lit(discount) * x["kinds"] / x["total"] * p)
    return found.select("context", "next", F.aggregate(F.coalesce("orders", F.array().cast("array<struct<n:int,times:bigint,total:bigint,kinds:bigint>>")), start, step).alias("p"))
