"""URL filtering with redirect equivalence.

A page's url is judged by the longest fitting rule. Pages without a rule take a block from their
aliases: urls are nodes, redirects (meta refresh) and canonical links are edges, and every connected component that
holds a url which a rule blocks is blocked, whether that url is a page of the table or only a target, save for pages that an
allow rule names. Nothing but such links makes aliases.

A node is a url as a server gets it: scheme and host in lower case, without fragment and default port, ``/`` for an empty
path. All links of a page count, resolved against its ``<base>`` or its own url, with ``&amp;`` decoded and dot segments removed.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and no alias; null
html has no links; targets without host (``mailto:``) are no links; repeated pages are judged alike; an empty table gives an empty table; input
columns named like an output column are replaced. A hub of links is split by partial minima and skew joins (components.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import Scratch, drop_clashes
from kontig.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comments and elements whose content is text: no tag stands in them.
_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b.*?(?:</\1\s*>|\z)"
#: A tag, whose quoted values may hold any character, and an attribute of it with its value in one of three groups.
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
#: What a refresh names: a time, a separator, and the target with or without ``url=`` and quotes.
_REFRESH = r"""(?is)^\s*[\d.]*\s*(?:[;,]|\s)\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))"""


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved."""
    step = lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used and wherever the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def node_of(url: Column) -> Column:
    """The node of a url; null without a host."""

    def node(u: Column) -> Column:
        scheme = F.translate(F.substring_index(u, "://", 1), _UPPER, _LOWER)
        port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
        host = _let(host_of(u), lambda h: F.when(h.endswith(port), F.substring_index(h, ":", 1)).otherwise(h))
        path = _let(path_of(u), lambda p: F.when(p == "", F.lit("/")).when(p.contains("/."), _without_dots(p)).otherwise(p))
        query = F.regexp_extract(_after_scheme(u), r"^[^?#]*(\?[^#]*)", 1)
        return F.when(host_of(u) != "", F.concat(scheme, F.lit("://"), host, path, query))

    return _let(F.coalesce(url, F.lit("")), node)


def _resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link's target; null if it has no host."""
    front = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    path = _let(path_of(base), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    none = F.lit(None).cast("string")
    return _let(
        target,
        lambda t: F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), none)
        .when(t.startswith("/"), F.concat(front, t))
        .when(t.startswith("?"), F.concat(front, path, t))
        .when(t.startswith("#") | (t == ""), none)
        .otherwise(F.concat(front, F.regexp_replace(path, "[^/]*$", ""), t)),
    )


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _by_rules(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def _decoded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)&(?:amp|#38|#x26);", "&"))


def _attributes(tag: Column) -> Column:
    """array<struct<name, value>> of a tag, names in lower case; the first is the tag's own name."""
    name, *values = [F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in range(1, 5)]
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
    return F.zip_with(name, joined(joined(values[0], values[1]), values[2]), lambda n, v: F.struct(F.translate(n, _UPPER, _LOWER).alias("name"), v.alias("value")))


def _value(attributes: Column, name: str) -> Column:
    """The value of the first attribute of this name; empty if there is none."""
    return F.coalesce(F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))


def _target(attributes: Column) -> Column:
    """Where a link or meta tag leads, if it is a canonical link or a redirect; else empty."""
    own = attributes[0]["name"]
    canonical = (own == "link") & F.array_contains(F.split(F.translate(_value(attributes, "rel"), _UPPER, _LOWER), r"\s+"), "canonical")
    refresh = (own == "meta") & (F.translate(F.trim(_value(attributes, "http-equiv")), _UPPER, _LOWER) == "refresh")
    content = _value(attributes, "content")
    named = F.concat(*[F.regexp_extract(content, _REFRESH, k) for k in (1, 2, 3)])
    return F.when(canonical, _value(attributes, "href")).when(refresh, named).otherwise("")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of redirects and canonical links in the html.

    Comments and scripts hold no tags, a quoted value may hold any character, ``rel`` is a list of words, and an attribute is found by its whole name.
    """
    html, url = F.col("html"), F.col("url")
    with_link = pages.where(html.rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace(html, _TEXT, " "), F.lit(_TAG), F.lit(0))
    parsed = with_link.select("url", F.transform(tags, _attributes).alias("_tags"))
    own_base = F.get(F.filter(F.transform("_tags", lambda t: F.when(t[0]["name"] == "base", _value(t, "href")).otherwise("")), lambda x: x != ""), F.lit(0))
    base = _let(_decoded(F.coalesce(own_base, F.lit(""))), lambda own: F.coalesce(F.when(own != "", _resolved(own, url)), url))
    targets = F.array_distinct(F.filter(F.transform("_tags", _target), lambda x: x != ""))
    nodes = _let(base, lambda b: F.transform(targets, lambda t: node_of(_resolved(_decoded(t), b))))
    edges = parsed.select(node_of(url).alias("src"), F.explode(nodes).alias("dst"))
    return edges.where("src is not null and dst is not null and src != dst").distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` (url, html, any others) without html, with host, path, rule, verdict and the node.

    ``rules`` are a list on the driver of at most some thousands; they become one expression.
    """
    scratch = Scratch(pages.sparkSession)
    pages = drop_clashes(pages, "host", "path", "rule", "verdict", "node", "component", "_own", "_alias")
    verdict = lambda host, path: _by_rules(rules, host, path, lambda r: r.verdict)
    judged = pages.drop("html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "node": node_of(F.col("url"))})
    judged = judged.withColumns({"rule": _by_rules(rules, F.col("host"), F.col("path"), lambda r: r.name), "_own": verdict(F.col("host"), F.col("path"))})
    # every linked url is a node, and only those can have aliases
    components = scratch.write(connected_components(link_edges(pages), scratch=scratch), "components")
    blocked = components.where(verdict(host_of(F.col("node")), path_of(F.col("node"))) == "block").select("component").distinct()
    inherited = components.join(blocked, "component", "left_semi").select("node").withColumn("_alias", F.lit("block"))
    out = judged.join(inherited, "node", "left")
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c != "html"], "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"), "node")
