"""Text from trees of on-screen elements, held as a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.quality import quality_content, skipped
from loam.storage import stored

# Which attributes carry text, by role, in order; and roles read by those alone.
ATTRIBUTES = {
    "AXTextField": ("value", "selected_text"),
    "AXTextArea": ("value", "selected_text"),
    "AXStaticText": ("value", "selected_text"),
    "AXLink": ("value", "title", "description"),
    "AXWebArea": ("value", "selected_text"),
    "AXScrollArea": ("value", "selected_text"),
    "AXButton": ("title", "value", "description"),
    "AXText": ("value", "selected_text"),
    "AXMessage": ("value", "description", "title"),
    "AXTabPanel": ("title", "value"),
    "AXList": ("value", "description"),
    "AXContentList": ("value", "description"),
    "AXGroup": ("value", "title", "description", "selected_text"),
}
OTHER_ROLES = ("value", "title", "description")
CONTAINERS = ("AXGroup", "AXMessage", "AXTabPanel", "AXList", "AXContentList")
MAX_DEPTH, MAX_HOPS = 10, 100


def attributes_of(role: Column, doubled: bool = False) -> Column:
    """Array of ``(position, text)`` of the texts of a node; values that are arrays give each element.

    ``doubled`` has a link's one value twice, as a walk over the screen meets it.
    """
    column = {"value": F.coalesce("value", F.array().cast("array<string>")), **{c: F.array(c) for c in ("title", "description", "selected_text")}}

    def listed(role_name: str | None) -> Column:
        names = ATTRIBUTES.get(role_name, OTHER_ROLES)
        if role_name not in CONTAINERS:
            names = tuple(dict.fromkeys((*names, "value", "selected_text")))
        return F.concat(*(column[c] for c in names))

    texts = listed(None)
    for name in ATTRIBUTES:
        texts = F.when(role == name, listed(name)).otherwise(texts)
    if doubled:
        texts = F.when((role == "AXLink") & (F.size(column["value"]) == 1), F.concat(column["value"], texts)).otherwise(texts)
    return F.filter(F.transform(texts, lambda x, i: F.struct(i.alias("position"), x.alias("text"))), lambda x: x["text"].isNotNull() & (x["text"] != ""))


def visible(nodes: DataFrame, max_depth: int = MAX_DEPTH, tree: str = "tree_id") -> DataFrame:
    """Nodes reached from the roots without passing a skipped one, above ``max_depth``, with ``level`` and ``path``; one join a level.

    ``path`` has the ids from the root down; in its order nodes stand as a walk meets
    them, each before its children and these by id.
    """
    kept = nodes.where(~skipped("role", "subrole", "title"))
    level = kept.where(F.col("parent_id").isNull()).withColumn("level", F.lit(0)).withColumn("path", F.array("node_id"))
    out = level
    for depth in range(1, max_depth):
        above = level.select(F.col(tree).alias("__tree"), F.col("node_id").alias("__above"), F.col("path").alias("__path"))
        below = kept.join(above, (F.col(tree) == F.col("__tree")) & (F.col("parent_id") == F.col("__above")))
        level = below.withColumn("level", F.lit(depth)).withColumn("path", F.concat("__path", F.array("node_id"))).drop("__tree", "__above", "__path")
        out = out.unionByName(level)
    return out


def extract(nodes: DataFrame, max_depth: int = MAX_DEPTH, tree: str = "tree_id") -> DataFrame:
    """``tree, node_id, role, position, text``: every text of the visible nodes that is content for its role."""
    seen = visible(nodes, max_depth, tree)
    return seen.select(tree, "node_id", "role", F.explode(attributes_of(F.col("role"))).alias("a")).select(tree, "node_id", "role", "a.*").where(quality_content("text", "role"))


def walked(nodes: DataFrame, max_depth: int = MAX_DEPTH, tree: str = "tree_id") -> DataFrame:
    """``seq, tree, node_id, role, path, position, text``: the texts as a walk through the trees gives them out, tree by tree.

    ``seq`` grows along the walk, so that texts in succession can be found; a link's
    value comes twice. The order is one sort by tree, path and position over all tasks.
    """
    seen = visible(nodes, max_depth, tree)
    texts = seen.select(tree, "node_id", "role", "path", F.explode(attributes_of(F.col("role"), doubled=True)).alias("a")).select(tree, "node_id", "role", "path", "a.*")
    ordered = texts.where(quality_content("text", "role")).orderBy(tree, "path", "position")
    # numbered by task and place once the order is fixed; written, as numbers of a plan that is run again could differ
    return stored(ordered.select(F.monotonically_increasing_id().alias("seq"), "*"), "walk")


def root_titles(nodes: DataFrame, tree: str = "tree_id", hops: int = MAX_HOPS) -> DataFrame:
    """``tree, node_id, root_id, title``: each node's topmost ancestor within ``hops``, by doubling pointers."""
    up = nodes.select(tree, "node_id", F.coalesce("parent_id", "node_id").alias("root_id"))
    for _ in range(max(1, (hops - 1).bit_length())):
        far = up.select(F.col(tree).alias("__tree"), F.col("node_id").alias("__at"), F.col("root_id").alias("__up"))
        up = up.join(far, (F.col(tree) == F.col("__tree")) & (F.col("root_id") == F.col("__at")), "left").select(tree, "node_id", F.coalesce("__up", "root_id").alias("root_id"))
    titles = nodes.select(F.col(tree).alias("__tree"), F.col("node_id").alias("__at"), "title")
    return up.join(titles, (F.col(tree) == F.col("__tree")) & (F.col("root_id") == F.col("__at")), "left").select(tree, "node_id", "root_id", "title")


# The roles that HTML elements stand for.
TAG_ROLES = {"p": "AXStaticText", "h1": "AXStaticText", "td": "AXStaticText", "title": "AXStaticText", "span": "AXText", "b": "AXText", "a": "AXLink", "button": "AXButton", "li": "AXList", "div": "AXGroup"}
DROPPED = r"(?s)<(script|style|nav)\b.*?</(script|style|nav)>|<!--.*?-->"
ELEMENT = r"<(p|h1|td|title|span|b|a|button|li|div)(?: [^>]*)?>([^<]+)"


def html_nodes(pages: DataFrame) -> DataFrame:
    """Node table of pages: a root for each and one node for each element with text of its own; navigation is left out."""
    bare = F.regexp_replace("html", DROPPED, "")
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(ELEMENT), 1).alias("tag"), F.regexp_extract_all(bare, F.lit(ELEMENT), 2).alias("text"))
    each = pages.select(F.col("page_id").alias("tree_id"), F.posexplode(found).alias("i", "x")).select("tree_id", (F.col("i") + 1).cast("bigint").alias("node_id"), F.col("x.tag").alias("tag"), F.col("x.text").alias("text"))
    role = F.lit("AXStaticText")
    for tag, r in TAG_ROLES.items():
        role = F.when(F.col("tag") == tag, F.lit(r)).otherwise(role)
    none = F.lit(None).cast("string")
    rest = [none.alias("subrole"), none.alias("title"), F.array("text").alias("value"), none.alias("description"), none.alias("selected_text")]
    roots = pages.select(F.col("page_id").alias("tree_id"), F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("AXWebArea").alias("role"), none.alias("subrole"), none.alias("title"), F.array().cast("array<string>").alias("value"), none.alias("description"), none.alias("selected_text"))
    return roots.unionByName(each.select("tree_id", "node_id", F.lit(0).cast("bigint").alias("parent_id"), role.alias("role"), *rest))
