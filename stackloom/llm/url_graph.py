"""URL filters: rules over hosts and paths, and for all other urls propagation of trust and distrust over host links.

Trust starts from hosts whose pages rules allow and follows links (personalised PageRank); distrust starts from hosts whose
pages rules block and goes against the links, to those that link there.  A host restarts with the share of its pages
that the rules judge, so a blocked section does not stand for a whole host, and takes in by the share that they do not
judge: what a blocked host links to, or who links to an allowed one, changes nothing about it.

Both shrink with the number of links that share them, so verdicts compare each with what the host would get if every host
were a seed: ``trust_share`` is the part of the trust that reaches a host, its own restart left out, that comes from allowed
pages, ``distrust_share`` the part of the distrust that comes from blocked ones.  They lie between 0 and 1 whatever the number
of links.  A host is blocked if its share of distrust exceeds that of trust by ``LIMIT``.

Edges join hosts whose pages link to each other, and a host with the nearest known domain above it.  Hosts that are linked to
but have no page take part, and restart with the share of their linked urls that the rules judge.  All of it is DataFrame
operations; ranks are written after each step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.steps import release, written

DAMPING, LIMIT = 0.85, 0.5
#: Steps end when no host changes by more; what is left then is below the nine digits that queries show.
TOLERANCE = 1e-10
#: More than any table needs, as each step leaves at most ``DAMPING`` of the change before it.
STEPS = 300
MEASURES = ("trust", "distrust", "trust_share", "distrust_share")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+(?:/[^?#"'\s<>]*)?)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _first_fit(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits; of equally long ones a block goes first, then the smaller name."""
    out = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out.append(F.when(fits, F.lit(value(r))))
    return F.coalesce(*out, F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, path, w): the urls of other hosts that pages of src link to; w sums up to the pages of src that link to dst.

    No path is the path ``/``, as http has it.
    """
    places = F.transform(
        F.regexp_extract_all("html", F.lit(_LINKS), F.lit(1)),
        lambda x: F.struct(F.translate(F.substring_index(x, "/", 1), _UPPER, _LOWER).alias("dst"), F.coalesce(F.nullif(F.regexp_extract(x, "/.*$", 0), F.lit("")), F.lit("/")).alias("path")),
    )
    rows = pages.select(F.col("host").alias("src"), F.array_sort(F.array_distinct(places)).alias("places"))
    # the first place of each host in the sorted ones counts the page
    first = F.transform("places", lambda x, i: F.when((i > 0) & (F.get("places", i - 1)["dst"] == x["dst"]), 0).otherwise(1))
    rows = rows.select("src", F.explode(F.arrays_zip("places", first.alias("first"))).alias("x"))
    rows = rows.select("src", "x.places.dst", "x.places.path", F.col("x.first").cast("long").alias("w")).filter("src != dst")
    return rows.groupBy("src", "dst", "path").agg(F.sum("w").alias("w"))


def linked_hosts(links: DataFrame, hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, allowed, blocked) of the hosts that are linked to and have no page: shares of their distinct linked urls."""
    urls = links.select(F.col("dst").alias("host"), "path").distinct().join(hosts, "host", "left_anti")
    return urls.groupBy("host").agg(*_shares(_first_fit(rules, F.col("host"), F.col("path"), lambda r: r.verdict)))


def _shares(verdict: Column) -> list[Column]:
    return [F.avg(F.when(verdict == v, 1.0).otherwise(0.0)).alias(name) for v, name in (("allow", "allowed"), ("block", "blocked"))]


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): pages of src that link to dst, both in ``hosts``; and 1 for the nearest of them that is a domain above a host."""
    known = hosts.select(F.col("host").alias("dst"))
    links = links.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(known, "dst", "left_semi")
    labels = F.split("host", r"\.")
    above = hosts.select(F.col("host").alias("src"), F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("place", "dst"))
    above = above.filter("dst != '' AND src != dst").join(known, "dst", "left_semi")
    above = above.groupBy("src").agg(F.min_by("dst", "place").alias("dst")).withColumn("w", F.lit(1).cast("long"))
    return links.select("src", "dst", "w").unionByName(above.select("src", "dst", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share); ``hosts`` has (host, allowed, blocked) shares.

    Each row of a rank carries two: ``r`` from the seeds, and ``q`` with every host as a seed.
    """
    total = edges.join(edges.groupBy("src").agg(F.sum("w").alias("out")), "src").join(edges.groupBy("dst").agg(F.sum("w").alias("into")), "dst")
    open_share = hosts.select("host", (1 - F.col("allowed") - F.col("blocked")).alias("open"))
    total = total.join(open_share.select(F.col("host").alias("src"), F.col("open").alias("src_open")), "src")
    total = total.join(open_share.select(F.col("host").alias("dst"), F.col("open").alias("dst_open")), "dst")
    out, into = F.col("w") / F.col("out") * F.col("dst_open"), F.col("w") / F.col("into") * F.col("src_open")
    ways = (("trust", "src", "dst", out), ("distrust", "dst", "src", into))
    ways = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), p.alias("p")) for kind, a, b, p in ways))
    moves = written(total.select(F.explode(ways).alias("x")).select("x.*").filter("p > 0"))
    starts = F.array(*(F.struct(F.lit(kind).alias("kind"), (F.col(share) * (1 - damping)).alias("r0")) for kind, share in (("trust", "allowed"), ("distrust", "blocked"))))
    seeds = written(hosts.select("host", F.explode(starts).alias("x")).select("x.kind", "host", "x.r0", F.lit(1 - damping).alias("q0")))
    nothing = F.lit(0.0)
    ranks = seeds.select("kind", "host", F.col("r0").alias("r"), F.col("q0").alias("q"), "r0", "q0")
    for step in range(steps):
        moved = ranks.select("kind", "host", "r", "q").join(moves, ["kind", "host"])
        moved = moved.select("kind", F.col("to").alias("host"), *((F.col(c) * F.col("p") * damping).alias(c) for c in ("r", "q")), *(nothing.alias(c) for c in ("r0", "q0", "r1", "q1")))
        kept = ranks.select("kind", "host", F.col("r0").alias("r"), F.col("q0").alias("q"), "r0", "q0", F.col("r").alias("r1"), F.col("q").alias("q1"))
        ranks = written(moved.unionByName(kept).groupBy("kind", "host").agg(*(F.sum(c).alias(c) for c in ("r", "q", "r0", "q0", "r1", "q1"))))
        change = ranks.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"{c}1")) / F.greatest(c, F.lit(1.0)) for c in ("r", "q"))))).first()[0]
        if change is None or change <= TOLERANCE:
            break
        if step % 8 == 7:
            release(hosts.sparkSession)
    else:
        raise RuntimeError("ranks did not settle")
    # what reached a host; next to nothing is nothing
    reached = F.col("q") - F.col("q0")
    share = F.when(reached > 1e-6, (F.col("r") - F.col("r0")) / reached).otherwise(nothing)
    of = ranks.select("kind", "host", "r", share.alias("share"))
    return of.groupBy("host").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")),
        *(F.sum(F.when(F.col("kind") == k, F.col("share")).otherwise(0.0)).alias(f"{k}_share") for k in ("trust", "distrust")),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    steps: int = STEPS,
    limit: float = LIMIT,
) -> DataFrame:
    """``page_id``, host, path, rule, verdict, and trust, distrust and their shares of the host, for every row of ``pages``.

    Defined results: a null url, or one without ``://``, has empty host and path; the empty host is no part of the graph,
    has no trust and is allowed; null html has no links; rows without an id and repeated rows are judged each; other
    columns are ignored.
    """
    base = pages.select("page_id", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"))
    verdict = _first_fit(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    own = base.filter("host != ''")
    hosts = written(own.groupBy("host").agg(*_shares(verdict)))
    links = written(host_links(own))
    hosts = written(hosts.unionByName(linked_hosts(links, hosts, rules)))
    ranks = propagate(hosts, written(host_edges(links, hosts)), damping, steps)
    names = _first_fit(rules, F.col("host"), F.col("path"), lambda r: r.name)
    shown = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in MEASURES}
    # sums of shares carry rounding
    by_graph = F.when(shown["distrust_share"] - shown["trust_share"] >= limit - 1e-7, "block").otherwise("allow")
    return base.drop("html").join(ranks, "host", "left").select(
        "page_id", "host", "path", names.alias("rule"), F.coalesce(verdict, by_graph).alias("verdict"), *(value.alias(c) for c, value in shown.items())
    )
