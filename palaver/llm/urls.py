"""URL filter with redirect equivalence.

Rules name a host and a path prefix. Pages are joined by links that make two addresses one: canonical links and
redirects. Distributed connected components gather the aliases of an address; a block decision on one alias reaches
those that no rule decides, unless an alias is explicitly allowed, which takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .components import components

#: (verdict, host, path); fixed values of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _SMALL)


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def address(url: Column) -> Column:
    """The node that a URL stands for: host and everything after it but the fragment. The scheme, its own port and an empty
    path make no difference."""
    after = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.regexp_replace(F.concat(lower(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url)), "^(?:http(://[^:]*):(?:80)?|https(://[^:]*):(?:443)?)$", "$1$2")
    return F.concat(F.regexp_replace(host, "(?s)^.*?://", ""), F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after)))


#: Character references by name that addresses have.
_NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """Character references resolved: those by number and the common ones by name."""

    def one(piece: Column, i: Column) -> Column:
        digits = F.regexp_extract(piece, "(?s)^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
        code = F.when(lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 9), 16, 10)).otherwise(digits).try_cast("int")
        real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(i == 0, piece).when(real, F.concat(letter, F.regexp_replace(piece, "(?s)^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    by_number = F.array_join(F.transform(F.split(text, "&#"), one), "")
    for name, sign in _NAMED:
        by_number = F.replace(by_number, F.lit(name), F.lit(sign))
    return F.when(F.contains(text, F.lit("&")), by_number).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    return unescaped(F.regexp_replace(F.regexp_replace(found, r"(?is)^.\s*[a-z-]+\s*=\s*", ""), r"""(?s)^["']|["']$""", ""))


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments; it begins with a slash and goes on doing so."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when(p == "..", up(kept)).when(p == ".", kept).otherwise(F.array_append(kept, p)))
    return F.when(F.contains(path, F.lit("/.")), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The absolute address that a reference means on a page or under a base address; null if it has another kind of scheme."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(target, "(?s)^[^?#]*", 0)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own_query = F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.concat(F.regexp_extract(path_of(base), "(?s)^(.*)/", 1), F.lit("/"))
    full = F.when(path == "", path_of(base)).when(path.startswith("/"), _without_dots(path)).otherwise(_without_dots(F.concat(folder, path)))
    return (
        F.when(target.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(scheme, F.lit("://"), host, full, F.when((path == "") & (query == ""), own_query).otherwise(query)))
    )


def link_targets(url: Column, html: Column) -> Column:
    """Absolute addresses that a page declares to be itself: canonical links, and refresh redirects at once.

    `rel` is a list of words, character references are resolved, and relative references are taken from the page's first
    <base>, itself taken from the page's address, or else from that address.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", ""), F.lit(r"(?is)(<(?:link|meta|base)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))
    named = lambda name: F.filter(tags, lambda t: lower(F.substring(t, 2, len(name))) == name)
    canonical = F.filter(named("link"), lambda t: F.array_contains(F.split(lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(named("meta"), lambda t: lower(_attribute(t, "http-equiv")) == "refresh")
    content = lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*\d+\s*[;,]\s*url\s*=\s*(.*?)\s*$", 1)
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, lambda t: F.regexp_replace(content(t), "(?s)^'(.*)'$", "$1")))
    bases = F.filter(F.transform(named("base"), lambda t: F.trim(_attribute(t, "href"))), lambda h: h != "")
    base = F.coalesce(resolved(url, F.get(bases, F.lit(0))), url)
    return F.filter(F.transform(F.filter(F.transform(found, F.trim), lambda t: t != ""), lambda t: resolved(base, t)), lambda t: t.isNotNull())


def filter_urls(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """pages (url, html and others) with host, path, rule, verdict, alias (an id of its component; null without links).

    A page without rule is blocked if an alias of its address is blocked by a rule and no alias is allowed by one;
    else allowed. An alias that is only linked to, without a page of its own, counts as well. Null urls are allowed
    and linked with nothing; null html has no links, nor has what stands in a comment; repeated rows get equal verdicts. Columns named like the new ones
    are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "alias")]
    base = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("_node"))
    own = pages.filter("url is not null and html is not null and (contains(lower(html), 'canonical') or contains(lower(html), 'refresh'))")
    links = own.select(F.col("url"), address(F.col("url")).alias("a"), F.explode(link_targets(F.col("url"), F.col("html"))).alias("to"))
    links = stash(links.select("a", address(F.col("to")).alias("b"), F.col("url").alias("a_url"), F.col("to").alias("b_url")).filter("a <> b and a <> '' and b <> ''").distinct(), "url-links")
    alias = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "url-aliases")
    ends = links.select(F.col("a").alias("node"), F.col("a_url").alias("url")).union(links.select("b", "b_url")).distinct()
    said = ruled(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    decided = ends.join(alias, "node").groupBy("component").agg(F.coalesce(F.bool_or(said == "allow"), F.lit(False)).alias("_allow"), F.coalesce(F.bool_or(said == "block"), F.lit(False)).alias("_block"))
    known = alias.join(decided, "component").select(F.col("node").alias("_node"), F.col("component").alias("alias"), "_allow", "_block")
    out = base.join(known, "_node", "left").withColumn("_hit", ruled(F.col("host"), F.col("path"), rules))
    passed_on = F.when(F.col("_block") & ~F.col("_allow"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), passed_on).alias("verdict"), "alias")


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
