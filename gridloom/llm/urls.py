"""URL filters whose decisions reach aliases: DataFrame operations only.

Rules of a host and a path prefix judge a URL directly.  URLs that redirect to one
another or name a canonical URL are aliases: connected components over those
links, by alternating hooks to the least neighbour, each round written to the
shared folder.  A component that holds a blocked URL blocks its members that no
rule judges, unless it also holds an explicitly allowed one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._store import written
from gridloom.llm.neardup import components

#: Rules up to this number are tested as one expression a row; more are joined by host.
FEW = 64


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) of the URLs of a host, or below it, whose path begins with path."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError("a verdict is allow or block")


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z in lower case; empty for null or no ://."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name(url: Column) -> Column:
    """The node of a URL: host, path (/ for none) and query, without scheme and fragment; null for no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    way = path(url)
    return F.when(host(url) != "", F.concat(host(url), F.when(way == "", F.lit("/")).otherwise(way), F.coalesce(query, F.lit(""))))


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (with _host, _path) and _rule, _verdict of the longest rule (host and path) that fits; of equal ones allow, then the least."""
    if len(rules) <= FEW:
        fits = [
            F.when(
                ((F.col("_host") == F.lit(r.host)) | F.endswith(F.col("_host"), F.lit("." + r.host))) & F.startswith(F.col("_path"), F.lit(r.path)),
                F.struct(F.lit(-len(r.host + r.path)).alias("order"), F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule")),
            )
            for r in rules
        ]
        best = F.array_min(F.array(*fits)) if fits else F.lit(None).cast("struct<order:int,verdict:string,rule:string>")
        return pages.withColumn("_best", best).withColumn("_rule", F.col("_best.rule")).withColumn("_verdict", F.col("_best.verdict")).drop("_best")
    # many rules: one row a host with its rules meets each distinct host that lies at or below it, so pages move once, by their host
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")
    per_host = table.groupBy("rule_host").agg(F.collect_list(F.struct(F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), "verdict")).alias("rules"))
    parts = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("_host").distinct().withColumn("rule_host", F.explode(ends))
    known = hosts.join(per_host, "rule_host").groupBy("_host").agg(F.flatten(F.collect_list("rules")).alias("_rules"))
    fit = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    best = F.array_min(F.transform(fit, lambda r: F.struct((-F.length(F.concat(r["host"], r["path"]))).alias("order"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    out = pages.join(known, "_host", "left").withColumn("_best", best)
    return out.withColumn("_rule", F.col("_best.rule")).withColumn("_verdict", F.col("_best.verdict")).drop("_best", "_rules")


def _attribute(tag: Column, attribute: str) -> Column:
    """An attribute's value, quoted or bare."""
    value = F.regexp_extract(tag, rf"""(?is)\s{attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _full(base: Column, link: Column) -> Column:
    """A link seen from a page: whole, of the same scheme, of the same host, or below the page's folder."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    top = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    whole = F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    return F.when(whole, link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(top, link)).otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), link))


def _resolved(full: Column) -> Column:
    """A whole URL without . and .. steps in its path, and without fragment."""
    none = F.array().cast("array<string>")
    up = F.aggregate(F.split(path(full), "/"), none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    query = F.regexp_extract(_rest(full), r"^[^?#]*(\?[^#]*)?", 1)
    return F.concat(F.regexp_extract(full, r"^([^:/?#]*://)", 1), host(full), F.array_join(up, "/"), F.coalesce(query, F.lit("")))


def page_links(pages: DataFrame) -> DataFrame:
    """url, link: the canonical link and the refresh redirect in the head of each page's html, comments and scripts left aside."""
    some = pages.filter(F.regexp_like("html", F.lit(r"(?i)canonical|http-equiv")) & F.col("url").isNotNull())
    head = F.regexp_replace(F.regexp_extract("html", r"(?is)^(.*?)(?:</head|<body|$)", 1), r"(?is)<!--.*?(-->|$)|<(script|style|noscript|template)\b.*?(</\2\s*>|$)", " ")
    tags = some.select("url", F.explode(F.regexp_extract_all(head, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    rel = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical") & F.startswith(F.lower("tag"), F.lit("<link"))
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    goes = F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*(.*)$", 1), r"""^["']|["']$""", "")
    link = F.trim(F.when(rel, _attribute(F.col("tag"), "href")).when(refresh, goes))
    # each step is stored: one expression of all of them would repeat its parts many times over
    raw = written(tags.select("url", F.regexp_replace(link, "(?i)&amp;", "&").alias("link")).filter("link != ''"))
    if raw.isEmpty():
        return raw
    full = written(raw.select("url", _full(F.col("url"), F.col("link")).alias("link")))
    return written(full.select("url", _resolved(F.col("link")).alias("link")))


def aliases(links: DataFrame) -> DataFrame:
    """node, component (the least node's name) of all nodes on links (url, link)."""
    pairs = written(links.select(name(F.col("url")).alias("a"), name(F.col("link")).alias("b"))).filter("a != b")
    found = written(components(pairs).select(F.col("doc_id").alias("node"), F.col("class_id").alias("component")))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())  # components() leaves the least node out


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, inherited of every row of pages.

    rules judge a URL by the longest fit; what they say of a URL itself stands.  A URL
    without a rule is blocked where an alias is blocked and none is explicitly
    allowed; else its verdict is `default`.  inherited tells a verdict that comes from
    aliases.  Aliases are linked by pages' canonical links and refresh redirects and by
    redirects (url, link), an optional table of observed ones; pages named by the same
    host, path and query are one node.  Null URLs, and those without ://, have empty
    host and path, no rule and no aliases.  Null html has no links.  Rows that repeat a
    page_id or a url are judged alike; an empty table gives no rows; html is read whole;
    columns beside page_id, url and html are not read.
    """
    cells = pages.select("page_id", F.col("url").alias("_url"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    direct = judged(cells, rules)
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "link").filter("url is not null and link is not null"))
    links = written(links.distinct())
    out = direct.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("own"), name(F.col("_url")).alias("node"))
    if links.isEmpty():
        return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"), F.lit(False).alias("inherited"))
    member = aliases(links)
    # a link's end counts with its own rules even where no page of that URL is in the table
    ends = links.select(F.explode(F.array("url", "link")).alias("url")).distinct()
    ends = written(ends.select(name(F.col("url")).alias("node"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path")))
    known = judged(ends, rules).filter("_verdict is not null")
    blocked = known.join(member, "node").groupBy("component").agg(F.max((F.col("_verdict") == "block").cast("int")).alias("block"), F.max((F.col("_verdict") == "allow").cast("int")).alias("allow"))
    blocked = member.join(blocked.filter("block = 1 and allow = 0").select("component"), "component", "left_semi").select("node", F.lit(True).alias("reached"))
    # only pages that a link may decide meet the nodes; the others are dealt out
    other = F.concat(F.lit(" "), F.pmod(F.xxhash64("page_id"), F.lit(4096)))  # no node's name: those hold a /
    out = out.withColumn("node", F.coalesce(F.when(F.col("own").isNull(), F.col("node")), other)).join(blocked, "node", "left")
    reached = F.col("own").isNull() & F.coalesce("reached", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(reached, F.lit("block")).otherwise(F.coalesce("own", F.lit(default))).alias("verdict"), reached.alias("inherited"))
