"""URL filters by redirect equivalence, in DataFrame operations only.

Rules judge a page by host and path. Pages that are one address - joined by
canonical links and redirects in their HTML or in a given table, or the same but
for scheme, leading www., fragment, tracking parameters and a final slash - form
components, found by distributed connected components. A block decision reaches
every page of a component that has no rule of its own; an explicit allow always
precedes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import ascii_lower, let, stash, upto
from netquill.llm.components import components

#: Most rules that stand in the plan as a list.
MAX_LIST = 1_000
#: Attributes may come in either order.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. For at most MAX_LIST rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + tail))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) and r, as rule_of() gives it, for a table of rules (verdict, rule) of any size.

    A keyed join: each different address has a key for each suffix of its host and
    each length that rules' paths have.
    """
    cut = F.instr("rule", "/")
    own = rules.select("verdict", "rule", F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("of"), F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("front"))
    own = own.groupBy("of", "front").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("r"))
    lengths = sorted(r.n for r in own.select(F.length("front").alias("n")).distinct().collect())  # of paths, so few
    known = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(upto(F.size(labels)), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    keys = known.select("host", "path", F.explode(ends).alias("of")).select("*", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))).alias("n"))
    hit = keys.select("host", "path", "of", F.expr("substring(path, 1, n)").alias("front")).join(own, ["of", "front"]).groupBy("host", "path").agg(F.max("r").alias("r"))
    hit = hit.select(F.col("host").alias("h2"), F.col("path").alias("p2"), F.struct("r.rule", "r.verdict").alias("r"))
    return rows.join(hit, (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")), "left").drop("h2", "p2")


def address(url: Column) -> Column:
    """One string for all spellings of an address; null without a host."""
    host, path = host_and_path(url)
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    plain = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))
    return F.when(host != "", let(kept, lambda q: F.when(q == "", plain).otherwise(F.concat(plain, F.lit("?"), q))))


def _plain_path(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    walked = F.aggregate(parts, F.lit(""), lambda at, x: F.when(x == ".", at).when(x == "..", F.regexp_replace(at, "/[^/]*$", "")).otherwise(F.concat(at, F.lit("/"), x)))
    return F.when(~F.contains(path, F.lit("/.")), path).otherwise(F.concat(walked, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))))


def absolute(href: Column, url: Column) -> Column:
    """A link's address by RFC 3986, seen from url; null for fragments of the page itself and for other schemes."""
    link = F.regexp_replace(F.regexp_replace(href, "(?i)&(amp|#38|#x26);", "&"), "#.*$", "")
    host, path = host_and_path(url)
    cut = F.regexp_extract(link, r"^([^?]*)", 1)
    query = F.substring(link, F.length(cut) + 1, F.length(link))
    site = F.concat(F.lit("http://"), host)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))
    return (
        F.when((link == "") | (host == ""), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).when(cut == "", F.concat(site, path, query))
        .when(F.startswith(cut, F.lit("/")), F.concat(site, _plain_path(cut), query)).otherwise(F.concat(site, _plain_path(F.concat(folder, cut)), query))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, component) for each row of pages.

    rules: (verdict, "host/path prefix"), a list, or a table (verdict, rule) of any
    size; of equally long rules that fit (ties) the last by name holds. redirects:
    further edges (from_url, to_url). All canonical links and refreshes of a page
    count, relative ones too, seen from the page's url (a <base> element isn't
    read). Null urls and urls without :// have empty host and path, no component,
    and are allowed. Null and empty HTML has no links, long HTML is read whole;
    links to nothing, to the page itself and to pages outside the table are fine,
    and a rule that blocks a link's target counts. Repeated rows get equal
    results. Other columns are left out. Empty tables are allowed.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > MAX_LIST:
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")

    def ruled(df: DataFrame) -> DataFrame:
        return with_rules(df, rules) if isinstance(rules, DataFrame) else df.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))

    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host, path = host_and_path(url)
    hrefs = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)])
    links = F.array_distinct(F.transform(hrefs, lambda x: absolute(x, url)))
    rows = rows.select("id", host.alias("host"), path.alias("path"), address(url).alias("node"), F.filter(links, lambda x: x.isNotNull()).alias("links"))
    rows = stash(ruled(rows), "pages")
    links = rows.where("node is not null").select("node", F.explode("links").alias("to"))
    if redirects is not None:
        links = links.union(redirects.select(address(F.col("from_url")), F.col("to_url")).where(F.col("to_url").isNotNull()))
    to_host, to_path = host_and_path(F.col("to"))
    links = links.select("node", address(F.col("to")).alias("other"), to_host.alias("host"), to_path.alias("path")).where("node is not null and other is not null")
    links = stash(ruled(links).select("node", "other", F.coalesce(F.col("r.verdict") == "block", F.lit(False)).alias("bad")), "links")
    member = stash(components(links, "node", "other"), "members")
    marked = rows.where("node is not null").select("node", (F.coalesce(F.col("r.verdict"), F.lit("")) == "block").alias("bad")).union(links.select(F.col("other"), "bad"))
    nodes = marked.groupBy("node").agg(F.max("bad").alias("bad")).join(member, "node", "left").select("node", "bad", F.coalesce("component", "node").alias("component"))
    nodes = stash(nodes, "nodes")
    whole = nodes.groupBy("component").agg(F.max("bad").alias("bad"))
    blocked = stash(nodes.select("node", "component").join(whole, "component").select(F.col("node").alias("of"), "component", "bad"), "decisions")
    got = rows.join(blocked, F.col("node") == F.col("of"), "left")
    verdict = F.coalesce("r.verdict", F.when(F.coalesce(F.col("bad"), F.lit(False)), "block").otherwise("allow"))
    return got.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")
