"""The driver's tables as entry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as X

#: Lines, or turns, that one document, or conversation, may have in ``seq``.
PLACES = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").alias("seq"), F.col("source").alias("app_name"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trimmed line of each document; empty lines keep their place."""
    each = documents(spark, sf_dir).select("seq", "app_name", F.posexplode(X.lines("text")).alias("pos", "line"))
    return each.select((F.col("seq") * PLACES + F.col("pos")).alias("seq"), "app_name", X.trimmed("line").alias("text"))


def shop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of four levels: regions, nations, customers, orders; some nations and customers are of kinds that are skipped."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = F.lit(None).cast("string")

    def nodes(rows: DataFrame, node, parent, role, subrole, title, value) -> DataFrame:
        values = F.array(value) if value is not None else F.array().cast("array<string>")
        return rows.select(F.col("tree").cast("bigint").alias("tree_id"), node.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"), role.alias("role"), subrole.alias("subrole"), title.alias("title"), values.alias("value"), none.alias("description"), none.alias("selected_text"))

    nation = read("nation").withColumn("tree", F.col("n_regionkey"))
    customer = read("customer").join(nation.select("n_nationkey", "tree"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read("orders").join(customer.select("c_custkey", "tree"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.col("n_nationkey") % 6
    order_role = F.element_at(F.array(*map(F.lit, ("AXStaticText", "AXButton", "AXLink"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    parts = [
        nodes(read("region").withColumn("tree", F.col("r_regionkey")), F.lit(0), F.lit(None), F.lit("AXWindow"), none, F.col("r_name"), None),
        nodes(nation, F.col("n_nationkey") + 1, F.lit(0), F.when(kind == 0, "AXToolbar").otherwise("AXGroup"), F.when(kind == 1, "AXNavigationBar"), F.col("n_name"), None),
        nodes(customer, F.col("c_custkey") + 1000, F.col("c_nationkey") + 1, F.lit("AXList"), none, F.when(F.col("c_custkey") % 10 == 0, "Close").otherwise(F.col("c_mktsegment")), F.col("c_name")),
        nodes(orders, F.col("o_orderkey") + 1_000_000_000, F.col("o_custkey") + 1000, order_role, none, F.lit("order"), F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.select((F.col("conv_id") * PLACES + F.col("turn")).alias("seq"), F.col("role").alias("app_name"), "text")
