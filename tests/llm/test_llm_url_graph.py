import random
from collections import defaultdict

import numpy as np
import pytest

from stackloom.llm import url_graph as u

RULES = [u.Rule("net", "/", "block"), u.Rule("example.net", "/en/", "allow"), u.Rule("bad.com", "/", "block"), u.Rule("org", "/fr/", "allow")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, verdict string, host int")


def test_hosts_paths_and_longest_rule(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y#z", None),
        (2, "https://example.net/de/", None),
        (3, "x://net", None),
        (4, "no scheme", None),
        (5, None, None),
        (6, "http://notnet/", None),
        (7, "ftp://ü.ORG/fr/ä?q=http://b.org", ""),
        (8, "http://h?x://y/z", None),
        (9, "http://a.net\n/p\nq", None),
        (None, "http://sub.bad.com/", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge_urls(frame(spark, rows), RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][:3] == ("net", "", None)
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("notnet", "/", None, "allow") and got[7] == ("ü.org", "/fr/ä", "org/fr/", "allow")
    assert got[8][:2] == ("h", "") and got[9][:2] == ("a.net\n", "/p\nq")
    assert got[None] == ("sub.bad.com", "/", "bad.com/", "block")


def brute(rows, rules, steps=400):
    """host -> (trust, distrust, their shares), by matrices; rows are (host, path, linked urls as (host, path))."""

    def judged(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    said = defaultdict(list)
    for host, path, _ in rows:
        said[host].append(judged(host, path))
    linked = defaultdict(set)
    for host, _, links in rows:
        for h, p in links:
            if h != host and h not in said:
                linked[h].add(p)
    for h, paths in linked.items():
        said[h] = [judged(h, p) for p in paths]
    names = sorted(said)
    at = {h: i for i, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for host, _, links in rows:
        for h in {h for h, _ in links if h != host}:
            w[at[host], at[h]] += 1
    for host in names:
        labels = host.split(".")
        for k in range(1, len(labels)):
            if ".".join(labels[k:]) in at:
                w[at[host], at[".".join(labels[k:])]] += 1
                break
    out = []
    unjudged = np.array([said[h].count(None) / len(said[h]) for h in names])
    for verdict, m in (("allow", w), ("block", w.T)):
        step = 0.85 * m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300) * unjudged
        seed = np.array([[0.15 * said[h].count(verdict) / len(said[h]), 0.15] for h in names])
        rank = seed
        for _ in range(steps):
            rank = seed + step.T @ rank
        got = rank - seed
        out += [rank[:, 0], np.where(got[:, 1] > 1e-6, got[:, 0] / np.maximum(got[:, 1], 1e-300), 0)]
    return {h: tuple(x[i] for x in (out[0], out[2], out[1], out[3])) for i, h in enumerate(names)}


def html(links):
    return "".join(f'<a class="k" HREF = "https://{h.upper()}{p}?q">{h}</a><a href=//{h}{p}#z>y</a><a href="/rel">z</a>' for h, p in links)


def random_web(seed=3, pages=400):
    """Cycles, a hub that a third of all links go to, hosts without pages, and sections that rules judge."""
    rng = random.Random(seed)
    crawled = [f"h{i}.com" for i in range(40)] + ["a.h1.com", "b.a.h1.com", "good.org", "x.net", "y.net", "www.example.net", "example.com"]
    far = [f"far{i}.com" for i in range(30)] + ["s1.net", "s2.net", "news.org", "b.far1.com"]
    paths = ["/", "/en/1", "/de/2", "/fr/3", "/other"]
    rows = []
    for _ in range(pages):
        host = rng.choice(crawled)
        links = [("hub.com" if rng.random() < 0.3 else rng.choice(crawled + far + ["s1.net"] * 9), rng.choice(paths)) for _ in range(rng.randint(0, 15))]
        rows.append((host, rng.choice(paths), links))
    rows += [(f"farm{i}.com", "/", [("s1.net", "/"), ("s2.net", "/x"), (f"farm{(i + 1) % 25}.com", "/")][: 1 + i % 3]) for i in range(25)]
    return rows + [("hub.com", "/", [("h1.com", "/"), ("h2.com", "/")])]


def check(spark, pages, rules):
    want = brute(pages, rules)
    rows = [(i, f"http://{h}{p}", html(links)) for i, (h, p, links) in enumerate(pages)]
    out = u.judge_urls(frame(spark, rows), rules).collect()
    assert len(out) == len(pages)
    for r in out:
        trust, distrust, trust_share, distrust_share = want[r["host"]]
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust), pytest.approx(distrust))
        assert (r["trust_share"], r["distrust_share"]) == (pytest.approx(trust_share, abs=1e-7), pytest.approx(distrust_share, abs=1e-7))
        if r["rule"] is None:
            assert r["verdict"] == ("block" if distrust_share - trust_share >= 0.5 - 1e-7 else "allow"), (r, want[r["host"]])
    return out


def test_equals_brute_force(spark):
    pages = [
        ("good.org", "/fr/1", [("friend.com", "/"), ("friend.com", "/2"), ("a.friend.com", "/")]),
        ("good.org", "/de/1", [("nowhere.com", "/")]),
        ("friend.com", "/", [("other.com", "/")]),
        ("a.friend.com", "/", [("friend.com", "/")]),
        ("b.a.friend.com", "/", []),
        ("farm.com", "/", [("bad.com", "/"), ("good.org", "/")]),
        ("farm2.com", "/", [("bad.com", "/")]),
        ("farm2.com", "/2", [("x.bad.com", "/"), ("farm2.com", "/")]),
        ("bad.com", "/", [("farm.com", "/")]),
        ("x.bad.com", "/", [("bad.com", "/")]),
        ("other.com", "/", []),
    ]
    verdicts = {r["host"]: r["verdict"] for r in check(spark, pages, RULES)}
    assert verdicts["farm2.com"] == "block" and verdicts["friend.com"] == "allow"


def test_a_web_of_thousands_of_links(spark):
    from stackloom.llm.queries import URL_RULES

    verdicts = [r["verdict"] for r in check(spark, random_web(), URL_RULES) if r["rule"] is None]
    assert {"allow", "block"} == set(verdicts)


def test_the_sql_twin_on_a_web(spark, tmp_path):
    import duckdb

    from stackloom.llm import oracles, queries

    rows = [(i, f"http://{h}{p}", html(links)) for i, (h, p, links) in enumerate(random_web(5, 120))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = queries.op3_url_graph(spark, str(tmp_path))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        found = duck.execute(oracles.OP3)
        names = [c[0] for c in found.description]
        want = {r[names.index("page_id")]: r for r in found.fetchall()}
    assert sorted(names) == sorted(df.columns)
    got = {r["page_id"]: tuple(r) for r in df.select(names).collect()}
    assert len(got) == len(want) == len(rows)
    for page, row in got.items():
        assert [pytest.approx(v, abs=2e-8) if isinstance(v, float) else v for v in row] == list(want[page])


def test_empty_table(spark):
    assert u.judge_urls(frame(spark, []), RULES).count() == 0


def test_hosts_without_pages_take_part(spark):
    links = ["http://more.NET/x", "//bad.com", "http://news.org/fr/1?q", "http://news.org/de/2#a", "http://news.org/fr/1"]
    rows = [
        (1, "http://farm.com/", '<a href="http://Spam.NET/x"><a href="//spam.net/y">'),
        (2, "http://good.org/fr/", '<a href="http://friend.com/"><a href="http://far.com/a/b">'),
        (3, "http://friend.com/", None),
        (4, "http://mixed.com/", "".join(f'<a href="{x}">' for x in links)),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in u.judge_urls(table, RULES).collect()}
    assert got["farm.com"]["verdict"] == "block" and got["friend.com"]["verdict"] == "allow"
    # shared with a host that has no page
    assert got["friend.com"]["trust"] == pytest.approx(0.15 * 0.85 / 2)
    found = u.host_links(table.select(u.host_of(u.F.col("url")).alias("host"), "html"))
    hosts = table.select(u.host_of(u.F.col("url")).alias("host"))
    more = {r["host"]: (r["allowed"], r["blocked"]) for r in u.linked_hosts(found, hosts, RULES).collect()}
    assert more == {"spam.net": (0, 1), "more.net": (0, 1), "bad.com": (0, 1), "news.org": (0.5, 0), "far.com": (0, 0)}


def test_verdict_does_not_shrink_with_linkers(spark):
    """Many hosts that link to the same blocked host only, one for which it is a quarter of its links, and a far one."""
    to = lambda *hosts: "".join(f'<a href="http://{x}/">' for x in hosts)
    linkers = [(f"http://farm{i}.com/", to("bad.com")) for i in range(40)]
    chain = [(f"http://c{i}.com/", to(f"c{i + 1}.com" if i < 13 else "bad.com")) for i in range(14)]
    other = [("http://bad.com/", ""), ("http://blog.com/", to("bad.com", "c0.com", "far.com", "near.com")), ("http://good.org/fr/", to("friend.com")), ("http://friend.com/", to("bad.com"))]
    rows = [(i, *x) for i, x in enumerate(linkers + chain + other)]
    got = {r["host"]: r for r in u.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    # all that reaches them comes from a blocked host, however many share it
    assert {got[f"farm{i}.com"]["verdict"] for i in range(40)} == {"block"}
    assert got["farm3.com"]["distrust_share"] == pytest.approx(1) and got["farm3.com"]["distrust"] < 0.003
    assert got["blog.com"]["verdict"] == "allow" and got["blog.com"]["distrust_share"] < 0.2
    assert got["friend.com"]["verdict"] == "allow" and got["friend.com"]["trust_share"] == pytest.approx(1)
    # more than ten steps away
    assert 0 < got["c0.com"]["distrust_share"] < 0.1 and got["c0.com"]["verdict"] == "allow" and got["c13.com"]["verdict"] == "block"
