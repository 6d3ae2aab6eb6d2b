"""URL rules that follow redirects and canonical links.

A rule decides for the urls it fits. A url without a rule takes the block of its
aliases: urls that redirect or canonical-link to each other, directly or through
others, are one component, and so are spellings of one address. A url's own rule,
an explicit allow above all, comes before what its aliases say; an allow isn't
passed on.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import packed, unpacked
from visitloom.llm.components import connected
from visitloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^[^#]*?\?([^#]*)"
# Parameters that track a visitor and don't name another page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"
LINK_TAG = r"(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>"
BASE_TAG = r"(?is)<base\b[^>]*>"
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
# What a refresh waits, then where it goes.
REFRESH = r"""(?is)^(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?+|url\s*=\s*)["']?([^"'\s]+)"""
# So many rules are compared one by one, in the plan; more are looked up by host.
MOST_COMPARED = 100
# Rules in a bucket of the table that is looked up, about.
BUCKET_RULES = 8


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def address(url: Column) -> Column:
    """One spelling of an address: without scheme, usual port, last slash, tracking or fragment.

    Null for a null url or one without ``://``.
    """
    usual = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"\.$", "")
    kept = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: ~p.rlike(TRACKING))
    query = F.array_join(kept, "&")
    text = F.concat(
        usual,
        F.regexp_replace(path(url), "/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url.contains("://"), text)


def matching_rule(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none; at equal length the longer host, then allow."""
    if len(rules) > MOST_COMPARED:
        return _looked_up(url_host, url_path, rules)
    first = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0]))
    out = F.lit(None).cast("string")
    for _, rule in reversed(first):
        own, rest = rule.split("/", 1)
        fits = ((url_host == own) | url_host.endswith(f".{own}")) & url_path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _buckets(values: dict[str, list[str]]) -> tuple[Column, int]:
    """A constant array of maps; an entry lies in the map that the checksum of its key names."""
    n = len(values) // BUCKET_RULES + 1
    table: list[dict[str, list[str]]] = [{} for _ in range(n)]
    for key, value in values.items():
        table[zlib.crc32(key.encode()) % n][key] = value
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,array<string>>>"), n


def _entry(buckets: tuple[Column, int], key: Column) -> Column:
    table, n = buckets
    place = (F.crc32(key.cast("binary")) % n).cast("int")
    return F.coalesce(F.element_at(F.get(table, place), key), F.array().cast("array<string>"))


def _looked_up(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """As ``matching_rule``, for any number of rules: those of the host and of each host above it are looked up."""
    of_host: dict[str, list[str]] = {}
    for rule in {r for _, r in rules}:
        own, rest = rule.split("/", 1)
        of_host.setdefault(own, []).append(rest)
    buckets, labels = _buckets(of_host), F.split(url_host, r"\.", -1)
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))

    def fitting(own: Column) -> Column:
        rests = F.filter(_entry(buckets, own), lambda rest: url_path.startswith(F.concat(F.lit("/"), rest)))
        return F.transform(rests, lambda rest: F.struct(
            F.length(F.concat(own, rest)).alias("size"), F.length(own).alias("of_host"), F.concat(own, F.lit("/"), rest).alias("rule")
        ))

    return F.array_max(F.flatten(F.transform(hosts, fitting)))["rule"]


def _action(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The action of a matched rule, null without one. An equal allow goes before a block."""
    allowed = [r for a, r in rules if a == "allow"]
    if len(rules) > MOST_COMPARED:
        is_allowed = F.size(_entry(_buckets({r: [""] for r in allowed}), rule)) > 0
    else:
        is_allowed = rule.isin(allowed)
    return F.when(rule.isNull(), None).when(is_allowed, "allow").otherwise("block")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, null without one."""
    all_ = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(all_, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(own, r"(?s)^[^=]*=\s*", "")
    return F.replace(F.regexp_replace(value, r"""^["']?\s*|\s*["']?$""", ""), F.lit("&amp;"), F.lit("&"))


def _target(tag: Column) -> Column:
    """What a canonical link or a refresh names, null for any other tag."""
    canonical = tag.rlike(r"(?i)^<link\b") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = tag.rlike(r"(?i)^<meta\b") & _attribute(tag, "http-equiv").rlike(r"(?i)^refresh$")
    return F.when(canonical, _attribute(tag, "href")).when(
        refresh, F.regexp_extract(_attribute(tag, "content"), REFRESH, 1)
    )


def _without_dots(url_path: Column) -> Column:
    """A path from ``/`` on whose ``.`` and ``..`` are resolved."""

    def step(kept, part):
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(F.regexp_replace(F.regexp_replace(url_path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    dotted = url_path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(url_path)


def resolved(base: Column, ref: Column) -> Column:
    """A reference as an absolute url, null if it has none."""
    of_base, own = path(base), F.regexp_replace(ref, r"(?s)[?#].*$", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(of_base, "[^/]*$", ""), "^/", ""))
    query = F.regexp_extract(base, QUERY, 1)
    kept = F.when((own == "") & ~ref.startswith("?") & (query != ""), F.concat(F.lit("?"), query)).otherwise("")
    full = F.when(own.startswith("/"), own).when(own == "", of_base).otherwise(F.concat(folder, own))
    whole = F.concat(
        F.lit("http://"), host(base), _without_dots(full), kept, F.regexp_extract(ref, r"(?s)[?#].*$", 0)
    )
    return (
        F.when(ref == "", F.lit(None))
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(ref.rlike("^[^:]*://"), ref))
        .when(base.contains("://"), whole)
    )


def linked_urls(html: Column, url: Column) -> Column:
    """Targets of canonical links and refresh redirects in a page.

    Relative references start from the page's ``<base href>``, else from its url.
    """
    tags = F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0))
    found = F.filter(F.transform(tags, _target), lambda u: u.isNotNull())
    first = F.transform(F.regexp_extract_all(html, F.lit(BASE_TAG), F.lit(0)), lambda t: _attribute(t, "href"))
    given = F.get(F.filter(first, lambda u: u.isNotNull()), F.lit(0))
    # bound once by each transform
    base = F.transform(F.array(given), lambda g: F.coalesce(resolved(url, g), url))
    whole = F.flatten(F.transform(base, lambda b: F.transform(found, lambda u: resolved(b, u))))
    return F.when(F.size(found) > 0, F.filter(whole, lambda u: u.isNotNull()))


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    links: DataFrame | None = None,
    default: str = "allow",
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with ``host``, ``path``, ``rule``, ``verdict`` and ``by``.

    ``rules`` are (``"allow"`` or ``"block"``, ``host/path``); a rule fits its host
    and all subdomains where the path starts with the rule's. ``links`` adds known
    redirects, as ``source`` and ``target`` urls. ``by`` says what decided:
    ``rule``, ``alias`` or ``default``.

    Defined cases: a null url or one without ``://`` has an empty host and path,
    no rule and no alias; a null page has no links. A link target decides like a
    page, also if it isn't one of ``pages``. Ids are not used, so null and
    repeated ids and rows stay as they are. An empty table gives an empty table.
    ``carry`` names the input columns to return, all if not given; added columns
    replace those of their name.
    """
    carry = pages.columns if carry is None else carry
    url = F.col(url_col)
    targets = linked_urls(F.col(html_col), url) if html_col else F.lit(None).cast("array<string>")
    rows = pages.select(
        packed(pages.select(*[f"`{c}`" for c in carry])).alias("row"),
        host(url).alias("host"),
        path(url).alias("path"),
        address(url).alias("address"),
        F.coalesce(targets, F.array().cast("array<string>")).alias("targets"),
    ).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = materialize(rows, "urls")

    edges = rows.where("address IS NOT NULL").select("address", F.explode("targets").alias("target"))
    if links is not None:
        edges = edges.union(links.select(address(F.col("source")), "target"))
    ends = edges.select("target")
    if links is not None:
        ends = ends.union(links.select("source"))
    end_rule = matching_rule(host(F.col("target")), path(F.col("target")), rules)
    tree = connected(edges.select(F.col("address").alias("a"), address(F.col("target")).alias("b")))

    blocked = (
        rows.select("address", "rule")
        .union(ends.select(address(F.col("target")), end_rule))
        .where((_action(F.col("rule"), rules) == "block") & F.col("address").isNotNull())
        .select("address")
        .distinct()
    )
    members = tree.union(tree.select("root", "root").distinct())
    roots = members.join(blocked, F.col("node") == F.col("address")).select(F.col("root").alias("bad")).distinct()
    aliases = members.join(roots, F.col("root") == F.col("bad")).select("node")
    aliases = aliases.union(blocked).distinct().withColumnRenamed("node", "alias")

    action = _action(F.col("rule"), rules)
    made = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("rule"),
        "verdict": F.coalesce(action, F.when(F.col("alias").isNotNull(), "block"), F.lit(default)),
        "by": F.when(action.isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default"),
    }
    return unpacked(rows.join(aliases, F.col("address") == F.col("alias"), "left"), carry, made)
