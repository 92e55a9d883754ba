"""URL filtering with rules that block or allow, and aliases that share a block.

Pages that redirect (meta refresh) or declare a canonical address are joined to their target; connected components of
these edges are groups of aliases. A page that a rule fits has that rule's verdict, so an explicit allow holds against
every alias; any other page is blocked if an alias is blocked by a rule, and allowed otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]


def rest_of(url: Column) -> Column:
    """What follows the first ://, else null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z folded; empty for null or no ://."""
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """host, path and query of a url: two urls that differ in scheme, case of host or fragment have one address."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path and address. The one-element explode keeps Spark from copying the expressions into every use."""
    url = F.col(url_col)
    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    return df.withColumn("__parts", F.explode(F.array(parts))).select(*(F.col(c) for c in df.columns), "__parts.host", "__parts.path", "__parts.address")


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The index of the longest rule that fits host (or a domain above it) and the path's start, else null.

    Of rules equally long, one that allows wins, then the first.
    """
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), rules[k][0] != "allow", k))
    out = F.lit(None).cast("int")
    for k in reversed(order):
        out = F.when(_fits(rules[k], host, path), F.lit(k)).otherwise(out)
    return out


def _ruled(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with the parts of its url, and k, the index of the rule that fits."""
    at = with_parts(df)
    return at.withColumn("k", F.explode(F.array(rule_of(F.col("host"), F.col("path"), rules))))


def _pick(index: Column, values: Sequence[str]) -> Column:
    return F.when(index.isNotNull(), F.get(F.array(*map(F.lit, values)), index)) if values else F.lit(None).cast("string")


def _value(tag: Column, name: str) -> Column:
    """An attribute's value, as written; empty if there is none."""
    quoted = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, quoted, k) for k in (1, 2, 3)))


#: Entities in which characters of addresses are written; the ampersand's come last.
ENTITIES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]


def _plain(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def alias_targets(html: Column) -> Column:
    """The targets of canonical links and meta refreshes outside comments, entities decoded."""
    html = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"""(?i)(<{name}\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""), 1)
    links = F.filter(tags("link"), lambda x: F.array_contains(F.split(F.lower(_value(x, "rel")), r"\s+"), "canonical"))
    hops = F.filter(tags("meta"), lambda x: F.lower(_value(x, "http-equiv")) == "refresh")
    href = F.transform(links, lambda x: _plain(_value(x, "href")))
    url = F.transform(hops, lambda x: F.regexp_extract(_plain(_value(x, "content")), r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.array_remove(F.concat(href, url), "")


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments taken out; .. at the top falls away."""
    parts = F.split(path, "/")

    def step(out: Column, x: Column) -> Column:
        up = F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
        return F.when(x == ".", out).when(x == "..", up).otherwise(F.concat(out, F.array(x)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    last = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, target: Column) -> Column:
    """An absolute url for a target on a page at base; relative paths are taken from the page's folder."""
    scheme = F.regexp_extract(base, r"^([^:]*:)//", 1)
    root = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 0)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(path == "", F.concat(root, path_of(base), rest))
        .when(F.startswith(path, F.lit("/")), F.concat(root, without_dots(path), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) addresses of canonical links and redirects. Pages without a host have none."""
    at = pages.select(F.col(url_col).alias("url"), F.explode(alias_targets(F.col(html_col))).alias("to"))
    at = with_parts(at.withColumn("to", F.explode(F.array(resolve(F.col("url"), F.col("to")))))).select("to", F.col("address").alias("source"))
    at = with_parts(at, "to").select("source", F.col("address").alias("target"))
    return at.where("source IS NOT NULL AND target IS NOT NULL AND source != target")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, alias_blocked) for each row of pages.

    rule is the host and path of the rule that fits, else null; verdict is allow or block. A url that is null or has no
    :// has an empty host and path, fits no rule and has no alias, so it is allowed. Rows that repeat an id or a url are
    judged alike and all returned. Null html has no links. Other columns are ignored. An empty table gives no rows.
    """
    at = _ruled(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules)
    edges = materialize(alias_edges(pages, url_col, html_col).distinct(), "aliases")
    if edges.isEmpty():
        at = at.withColumn("spread", F.lit(False))
    else:
        parts = materialize(connected_components(edges, "source", "target"), "alias-groups")
        # A blocked address counts whether or not its own page was crawled: its rule follows from the address alone.
        own = _ruled(parts.select("component", F.concat(F.lit("x://"), F.col("node")).alias("url")), rules)
        blocked = own.where(_pick(F.col("k"), [r[0] for r in rules]) == "block").select("component").distinct()
        spread = parts.join(blocked, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("hit"))
        at = at.join(spread, "address", "left").withColumn("spread", F.coalesce("hit", F.lit(False)))
    verdict = F.coalesce(_pick(F.col("k"), [r[0] for r in rules]), F.when(F.col("spread"), "block").otherwise("allow"))
    return at.select(F.col("id").alias(id_col), "host", "path", _pick(F.col("k"), [r[1] + r[2] for r in rules]).alias("rule"), verdict.alias("verdict"), F.col("spread").alias("alias_blocked"))
