import random
import re

import numpy as np
from pyspark.sql import functions as F

from visitloom.llm import redirects
from visitloom.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(url, rules):
    host, path = parts(url)
    fits = []
    for action, rule in rules:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://WWW.Example.com/en/x", "http://example.com/en/", "http://a.example.com/en?x", "http://a.example.com/en/?x",
    "ftp://x.net/es/1", "x.net/es/1", "http://net/fr/#f", "http://notnet/fr/", "http://b.org", None, "", "http://",
    "http://www.example.com/EN/", "http://evil.com?u=http://x.net/es/", "a://b://c.net/es/", "http://x.net:80/es/\n",
    "http://ÀB.com/é", "http://sub.www.example.com/en/a", "http://com/",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in redirects.judged(df, URL_RULES, html_col=None).collect()}
    for i, url in enumerate(URLS):
        rule, action = rule_of(url, URL_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(url), rule), url
        if rule:
            assert got[i]["verdict"] == action and got[i]["by"] == "rule"


def page(target, tag='<link href="{}" rel="canonical">'):
    return f"<html><head>{tag.format(target)}</head><p>canonical</p></html>"


def test_blocks_follow_links_in_both_directions_and_through_others(spark):
    rows = [
        (1, "http://x.net/es/1", None),  # blocked by rule
        (2, "http://a.org/1", page("http://x.net/es/1?utm_source=q#top")),  # links to it
        (3, "http://b.org/1", page("http://a.org/1", '<META content="0; URL=\'{}\'" http-equiv=refresh>')),
        (4, "https://b.org/1/?utm_medium=m", "<p>"),  # another spelling of 3
        (5, "http://c.org/", page("http://d.org/")),  # links elsewhere
        (6, "http://www.example.com/en/1", page("http://b.org/1")),  # own allow
        (7, "http://e.org/1", page("http://far.net/fr/gone")),  # blocked target that is no page
        (8, "http://f.org/a", page("/b")),
        (9, "http://f.org/b", page("//g.net/fr/")),
        (10, "http://h.org/", page("relative.html")),
        (11, "http://b.org/1?page=2", None),  # another page
        (12, "http://i.org/", None),
        (13, None, page("http://x.net/es/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    links = spark.createDataFrame([("http://i.org", "http://j.net/es/")], "source string, target string")
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in redirects.judged(df, URL_RULES, links=links).collect()}
    block, fine = ("block", "alias"), ("allow", "default")
    assert got == {
        1: ("block", "rule"), 2: block, 3: block, 4: block, 5: fine, 6: ("allow", "rule"), 7: block, 8: block,
        9: block, 10: fine, 11: fine, 12: block, 13: fine,
    }
    strict = redirects.judged(df, URL_RULES, default="block").where("page_id = 10").first()
    assert strict["verdict"] == "block"


REFERENCES = [
    "page.html", "../b", "../../../b", "./", "..", "?p=2", "#top", "c/d?x=/../y", "/e/../f", "//g.org/h", "ftp://k.org/l",
    "a/./b/../c", "/", "x?u=http://y.org/",
]
BASES = ["http://h.org/d/e/f.html?q=1", "http://h.org", "http://h.org/d/"]


def test_relative_references(spark):
    from urllib.parse import urljoin

    rows = [(b, r) for b in BASES for r in REFERENCES]
    df = spark.createDataFrame(rows, "base string, ref string").select("*", redirects.resolved(F.col("base"), F.col("ref")).alias("got"))
    clean = lambda u: re.sub(r"^http:(//[^/?#]*)/?", r"\1/", u)
    for r in df.collect():
        assert clean(r["got"]) == clean(urljoin(r["base"], r["ref"])), r


def test_links_of_all_forms_and_no_others(spark):
    css = '<link rel=stylesheet href="/css/refresh.css"><link rel="alternate" title="canonical" href="/es/all">'
    rows = [
        (1, "http://x.net/es/a/1", css),  # blocked by rule
        (2, "http://a.org/b/1", css + page("http://x.net/es/a/1") + css),
        (3, "http://a.org/b/2", css),
        (4, "http://a.org/b/3", page("1")),
        (5, "http://a.org/b/c/4", page("0;url=../1", '<meta http-equiv="Refresh" content="{}">')),
        (6, "http://a.org/b/1?p=2", page("?", "<link rel='x canonical' href={}>")),
        (7, "http://b.org/7", '<base href="http://x.net/es/a/">' + page("1")),
        (8, "http://a.org/b/8", '<meta name="refresh" content="0;url=http://x.net/es/a/1">'),
        (9, "http://x.org/b/9", "<meta http-equiv=refresh content=5>"),
        (10, "http://a.org/z", '<base href="/b/">' + page("1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"] for r in redirects.judged(df, URL_RULES).where("verdict = 'block'").collect()}
    assert got == {1, 2, 4, 5, 6, 7, 10}


def test_a_hub_of_many_pages(spark):
    rows = [(i, f"http://s{i}.org/", page("http://hub.org/")) for i in range(300)] + [(300, "http://hub.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    count = lambda d: d.groupBy("verdict").count().collect()
    assert [tuple(r) for r in count(redirects.judged(df, URL_RULES))] == [("allow", 301)]
    blocked = [*URL_RULES, ("block", "s7.org/")]
    assert [tuple(r) for r in count(redirects.judged(df, blocked))] == [("block", 301)]


def test_rules_of_one_length(spark):
    df = spark.createDataFrame([(1, "http://x.b.com/abc")], "page_id long, url string")
    rules = [("block", "com/abc"), ("allow", "b.com/a"), ("block", "b.com/a")]
    got = redirects.judged(df, rules, html_col=None).first()
    assert (got["rule"], got["verdict"]) == ("b.com/a", "allow")


def test_any_number_of_rules(spark):
    """Looked up or compared, the rule is the same; 100,000 rules run."""
    rng = random.Random(5)
    labels, paths = ["a", "b", "com", "x.y", "", "é"], ["", "/", "/p", "/p/q", "/pq", "/p/q/r?", "/é"]
    rules = list({(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))) + (rng.choice(paths) or "/")) for _ in range(400)})
    rules = [r for r in rules if "/" in r[1]]
    urls = [(".".join(rng.choices(labels, k=rng.randint(1, 5))), rng.choice(paths) + rng.choice(["", "z", "/q"])) for _ in range(400)]
    many = rules + [("block", f"h{i}.org/p{i % 7}/") for i in range(100_000)]
    urls += [(f"www.h{i}.org", f"/p{i % 7}/x") for i in range(0, 100_000, 9973)]
    df = spark.createDataFrame(urls, "host string, path string").repartition(4)

    def plain(host, path):
        fits = [r for _, r in many if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=lambda r: (len(r), r.index("/")), default=None)

    rule = redirects.matching_rule(F.col("host"), F.col("path"), many)
    got = df.withColumn("rule", rule).withColumn("action", redirects._action(F.col("rule"), many)).collect()
    allowed = {r for a, r in many if a == "allow"}
    sample = rng.sample(got, 150) + [r for r in got if r["host"].startswith("www.h")]
    for r in sample:
        want = plain(r["host"], r["path"])
        assert r["rule"] == want and r["action"] == (None if want is None else "allow" if want in allowed else "block")
    few = df.withColumn("rule", redirects.matching_rule(F.col("host"), F.col("path"), rules[:100]))
    looked_up = few.withColumn("other", redirects._looked_up(F.col("host"), F.col("path"), rules[:100]))
    assert looked_up.where("NOT (rule <=> other)").isEmpty() and not looked_up.where("rule IS NOT NULL").isEmpty()


def test_odd_rows(spark, none):
    rows = [(None, None, None, "r", "h", "p"), (1, None, "", None, None, None), (1, "http://a.net/es/", None, "r", "h", "p")] * 2
    rows += [(2, "http://a.org/" + "x" * 100000, "<link " + "y" * 100000, "r", "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string, address string, verdict string")
    got = redirects.judged(df, URL_RULES)
    assert got.columns == ["page_id", "url", "html", "row", "address", "host", "path", "rule", "verdict", "by"]
    assert [r["verdict"] for r in got.orderBy("url").collect()] == ["allow"] * 4 + ["block"] * 2 + ["allow"]
    empty = redirects.judged(none.selectExpr("doc_id as page_id", "text as url", "text as html"), URL_RULES)
    assert empty.count() == 0


def blocked_by_search(rows, rules):
    """Ids of blocked pages by breadth-first search over the links, in both directions."""
    near = {}
    for _, url, target in rows:
        near.setdefault(url, set())
        if target:
            near[url].add(target)
            near.setdefault(target, set()).add(url)
    bad = {u for u in near if rule_of(u, rules)[1] == "block"}
    todo = list(bad)
    while todo:
        for other in near[todo.pop()] - bad:
            bad.add(other)
            todo.append(other)
    return {i for i, url, _ in rows if (rule_of(url, rules)[1] or ("block" if url in bad else "allow")) == "block"}


def test_random_links_and_rules(spark):
    by_link = 0
    for seed in range(3):
        rng = random.Random(seed)
        address = [f"http://{rng.choice('abc')}.h{i % 90}.{rng.choice(['org', 'net'])}/p{i % 7}/{i}" for i in range(260)]
        rows = [
            (i, rng.choice(address), rng.choice(address) if rng.random() < 0.4 + seed / 10 else None) for i in range(220)
        ]
        rules = []
        for _ in range(30):
            own, rest = rng.choice(address).split("://")[1].split("/", 1)
            own = rng.choice([own, own.split(".", 1)[1]])
            rules.append((rng.choice(["block", "allow"]), f"{own}/{rest[: rng.choice([0, 3, 99])]}"))
        rules = list({rule: (action, rule) for action, rule in rules}.values())
        tags = ['<link rel=canonical href="{}">', '<meta http-equiv="refresh" content="0;url={}">']
        pages = [(i, url, target and page(target, rng.choice(tags))) for i, url, target in rows]
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
        got = {r["page_id"] for r in redirects.judged(df, rules).where("verdict = 'block'").collect()}
        wanted = blocked_by_search(rows, rules)
        assert got == wanted and 0 < len(wanted) < len(rows)
        by_link += sum(rule_of(rows[i][1], rules)[1] is None for i in wanted)
    assert by_link > 20
