"""URL filters with redirect equivalence. DataFrame functions only.

Rules name a host (and its subdomains) and a path prefix; the longest rule that
fits a URL decides. URLs are equivalent if they differ only in scheme, fragment,
a leading ``www.`` or ``m.``, a trailing slash or tracking parameters, or if one
redirects to the other (``<meta http-equiv=refresh>``) or names it as canonical
(``<link rel=canonical>``, among other words of ``rel`` too). Links may be relative to
the page or to its ``<base>``; those in comments, scripts and other text that is no
markup don't count. A port that is the default goes without saying, but for the
``host`` column and the rule of a page's own URL. Connected components over these edges carry decisions
to URLs without a rule: one explicit allow in a component allows, else one block
blocks, else the URL is allowed. A URL's own rule always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm._shared import components
from loam.storage import stored

#: Verdict and rule, host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"
#: What holds no tags: comments, and elements whose text is no markup, up to their end or that of the page.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\s*>|\z)" for x in ("script", "style", "textarea", "title", "xmp"))
#: The rest of a tag after its name: a quoted value may hold a ``>``.
REST = r"""\b(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+>"""
LINK, META, BASE = (rf"(?is)<{x}{REST}" for x in ("link", "meta", "base"))
DEFAULT_PORT = r":(80|443)?$"
SPACES = r"[ \t\n\f\r]+"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def bare_host_of(url: Column) -> Column:
    """The host without a port that goes without saying."""
    return F.regexp_replace(host_of(url), DEFAULT_PORT, "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, r in rules:
        out = F.when(rule == r, F.lit(verdict)).otherwise(out)
    return out


def key_of(url: Column) -> Column:
    """What structurally equivalent URLs have in common; the URL itself if it has no ``://``, null if it is null."""
    host = F.regexp_replace(bare_host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")), "&"), lambda p: ~p.rlike(TRACKING) & (p != "")))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, whole).otherwise(url)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without it."""
    of = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, of, k) for k in (1, 2, 3)))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken; ``..`` at the top stays there."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def resolved(url: Column, link: Column) -> Column:
    """The URL that a link on the page ``url`` leads to; null for an empty link, one within the page, and other schemes."""
    x = F.regexp_replace(F.trim(F.regexp_replace(link, SPACES, " ")), "&amp;", "&")
    root = F.concat(F.lit("http://"), host_of(url))
    rest, path = F.regexp_extract(x, r"^[^?#]*(.*)$", 1), F.regexp_extract(x, r"^([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(F.coalesce(x, F.lit("")).rlike(r"^(#|$)"), F.lit(None).cast("string"))
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x)
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x))
        .when(F.instr(url, "://") == 0, F.lit(None).cast("string"))
        .when(F.startswith(x, F.lit("?")), F.concat(root, path_of(url), x))
        .when(F.startswith(x, F.lit("/")), F.concat(root, without_dots(path), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


def targets_of(pages: DataFrame) -> DataFrame:
    """``url, key, targets`` of pages ``(url, html)``: the URLs that a page redirects to or names as canonical."""
    seen = F.regexp_replace("html", UNREAD, "")
    canonical = F.filter(F.regexp_extract_all(seen, F.lit(LINK), 0), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), SPACES), "canonical"))
    refresh = F.filter(F.regexp_extract_all(seen, F.lit(META), 0), lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    goes = F.transform(refresh, lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    links = F.concat(F.transform(canonical, lambda t: attribute(t, "href")), goes)
    # most pages have none, which a plain search tells
    some = F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh"))
    base = F.when(some & F.contains(F.lower("html"), F.lit("<base")), F.nullif(attribute(F.regexp_extract(seen, BASE, 0), "href"), F.lit("")))
    found = pages.select("url", key_of(F.col("url")).alias("key"), F.when(some, links).alias("links"), base.alias("base"))
    at = found.withColumn("base", F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))))
    targets = F.filter(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: resolved(F.col("base"), x)), lambda x: x.isNotNull())
    return at.select("url", "key", targets.alias("targets"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``.

    A null URL, or one without ``://``, has an empty host and path and no rule;
    it is equivalent only to its exact like (null to nothing), so it is allowed
    unless links say otherwise. Null html has no links. Repeated rows are judged
    each; other columns are ignored.
    """
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    linked = stored(targets_of(df.where("url is not null").select("url", "html")), "linked")
    edges = linked.select("key", F.explode("targets").alias("target")).select(F.col("key").alias("a"), key_of(F.col("target")).alias("b"))
    roots = components(edges)
    # every URL that is known, of a page or a target, may have a rule that decides for its component
    known = linked.select("url", "key").unionAll(linked.select(F.explode("targets").alias("url")).withColumn("key", key_of(F.col("url"))))
    decided = known.withColumn("said", verdict_of(rule_of(bare_host_of(F.col("url")), path_of(F.col("url")), rules), rules)).where("said is not null")
    decided = decided.groupBy("key").agg(F.min("said").alias("said"))  # allow before block
    named = decided.join(roots, decided.key == roots.node, "left").select(F.coalesce("root", "key").alias("root"), "said").groupBy("root").agg(F.min("said").alias("said"))
    alias = roots.join(named, "root").select(F.col("node").alias("alias_key"), F.col("said").alias("linked_said"))
    direct = decided.select(F.col("key").alias("own_key"), F.col("said").alias("key_said"))
    out = df.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key_of(F.col("url"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.join(alias, F.col("key") == F.col("alias_key"), "left").join(direct, F.col("key") == F.col("own_key"), "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), "linked_said", "key_said", F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
