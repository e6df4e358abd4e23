"""URL filter: path rules, and link-graph propagation of trust and distrust for the hosts that no rule decides.

A rule names a host and a path prefix and fits the host, its subdomains and the paths below; the longest wins. For urls
without a rule the host decides. Hosts are the nodes of a graph whose edges are the links in the pages' html (host of the
page to host of the link) and, unless ``parents`` is false, both ways the step from a host to its parent domain. Hosts with
over half of their pages allowed by a rule are trusted seeds, those with over half blocked are blocked seeds. Trust is a
personalised PageRank from the trusted seeds along the edges; distrust is one from the blocked seeds against them. A host is
blocked if its distrust is over ``ratio`` times its trust, and allowed else, also where nothing is known.

Rounds end when no verdict can change any more: no host was reached for the first time, and of every host that both reach the
distrust is farther from ``ratio`` times its trust than all that is still to move (a round moves at most ``damping`` times what the one before did, so
after one that moved m it is m * damping / (1 - damping) at most). Hosts too close to call for that go on until less than
``tolerance`` is still to move. ``most_rounds`` only guards against a tolerance that rounding cannot reach.

DataFrame functions alone: links are cut out by regular expressions in one pass over the html, ranks are joins and sums of
decimals (so that no order of adding changes a verdict), one plan a round, written to the shared folder. A hub's
messages are summed before the shuffle, and its own edges are a join that can be split.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed; null html has no
links; equal rules count once, and of rules of equal length the block rule wins; repeated rows each keep their row; columns
with the names of the new ones are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import drop_one, staged, with_columns_free

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#\"'\s>]+)"
#: The host of a base element, and a link without a host of its own, which then leads to it.
BASE = r"(?i)<base\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
RELATIVE = r"(?i)<(?:a|area|img|form|iframe|script|link)\s[^>]*?(?:href|src|action)\s*=\s*[\"']?\s*(?![a-z][a-z0-9+.-]*:|//|#|[\"'>\s])"


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host, path, rules=RULES):
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a parameter, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): pages of one host that link to another, by any element (canonical and language links too); a relative link
    leads to the host of the page's base element, if it has one. pages: columns host and html."""
    based = F.col("html").rlike(r"(?i)<base\s")
    rest = F.when(based, F.regexp_replace("html", r"(?i)<base\s[^>]*>", " ")).otherwise(F.col("html"))  # a base element is no link itself
    absolute = F.transform(F.regexp_extract_all(rest, F.lit(LINK), 1), lambda x: F.translate(F.regexp_extract(x, "//(.*)", 1), UPPER, LOWER))
    base = F.translate(F.regexp_extract("html", BASE, 1), UPPER, LOWER)
    own = F.when((base != "") & F.col("html").rlike(RELATIVE), F.array(base)).otherwise(F.array().cast("array<string>"))
    links = pages.filter("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.concat(absolute, own))).alias("dst"))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def with_parents(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """The links, and the steps between a host and its parent domain. hosts: column host."""
    known = links.select(F.col("src").alias("h")).union(links.select("dst")).union(hosts.select("host")).distinct().filter("h like '%.%'")
    up = known.select(F.col("h").alias("src"), F.regexp_replace("h", r"^[^.]*\.", "").alias("dst"), F.lit(1.0).alias("w")).filter("dst like '%.%'")
    return links.union(up).union(up.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


#: Ranks are added up as decimals.
EXACT = "decimal(38,24)"


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, ratio: float = 1.0, tolerance: float = 1e-9, most_rounds: int = 1000) -> DataFrame:
    """(host, trust, distrust). seeds: columns host, good, bad, each of which adds up to 1 (or is 0 throughout)."""
    out = edges.groupBy(F.col("src").alias("h")).agg(F.sum("w").alias("out_w"))
    into = edges.groupBy(F.col("dst").alias("h")).agg(F.sum("w").alias("in_w"))
    forth = edges.join(out.withColumnRenamed("h", "src"), "src").select("src", "dst", (F.col("w") / F.col("out_w")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into.withColumnRenamed("h", "dst"), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), (F.col("w") / F.col("in_w")).alias("d"))
    sends = staged(forth.union(back).groupBy("src", "dst").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "hostedges")
    hosts = sends.select(F.col("src").alias("host")).union(sends.select("dst")).union(seeds.select("host")).distinct()
    nodes = hosts.join(seeds, "host", "left").fillna(0.0, ["good", "bad"])
    ranks = staged(nodes.select("host", "good", "bad", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "ranks")
    gap = F.abs(F.col("distrust") - F.lit(ratio) * F.col("trust"))
    both = (F.col("trust") > 0) & (F.col("distrust") > 0)  # once no host is reached anew, all others are decided
    for _ in range(most_rounds):
        got = sends.join(ranks.select(F.col("host").alias("src"), "trust", "distrust"), "src").groupBy(F.col("dst").alias("host"))
        got = got.agg(*[F.sum((F.col(w) * F.col(r)).cast(EXACT)).cast("double").alias(w) for w, r in (("t", "trust"), ("d", "distrust"))])
        new = lambda seed, got: F.lit(1 - damping) * F.col(seed) + F.lit(damping) * F.coalesce(F.col(got), F.lit(0.0))
        old = ranks
        was = old.select("host", "good", "bad", F.col("trust").alias("trust0"), F.col("distrust").alias("distrust0"))
        ranks = staged(was.join(got, "host", "left").select("host", "good", "bad", new("good", "t").alias("trust"), new("bad", "d").alias("distrust"), "trust0", "distrust0"), "ranks")
        drop_one(old)
        fresh = ((F.col("trust") > 0) & (F.col("trust0") == 0)) | ((F.col("distrust") > 0) & (F.col("distrust0") == 0))
        r = ranks.agg(F.sum(F.abs(F.col("trust") - F.col("trust0"))).alias("t"), F.sum(F.abs(F.col("distrust") - F.col("distrust0"))).alias("d"), F.count_if(fresh).alias("fresh"), F.min(F.when(both, gap)).alias("gap")).first()
        rest = ((r.d or 0.0) + ratio * (r.t or 0.0)) * damping / (1 - damping)
        if rest < tolerance or (not r.fresh and (r.gap is None or r.gap > rest)):
            break
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, ratio: float = 1.0, parents: bool = True, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """pages with host, path, rule and verdict."""
    pages = with_columns_free(pages, "host", "path", "rule", "verdict", "_rule", "_blocked")
    url = F.col(url_col).cast("string")
    named = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    counts = named.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("_rule.verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("b"))
    seeds = staged(counts.select("host", F.when(2 * F.col("a") > F.col("n"), F.col("a")).otherwise(0).cast("double").alias("good"), F.when(2 * F.col("b") > F.col("n"), F.col("b")).otherwise(0).cast("double").alias("bad")), "seeds")
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = seeds.select("host", *[(F.col(c) / F.lit(total[c] or 1.0)).alias(c) for c in ("good", "bad")])
    links = staged(host_links(named.select("host", F.col(html_col).cast("string").alias("html"))), "links")
    edges = staged(with_parents(links, seeds), "edges") if parents else links
    ranks = propagate(edges, seeds, damping, ratio, tolerance)
    bad = ranks.filter(F.col("distrust") > F.lit(ratio) * F.col("trust")).select("host", F.lit(True).alias("_blocked"))
    out = named.join(bad, "host", "left").withColumn("verdict", F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block").otherwise("allow"))).withColumn("rule", F.col("_rule.rule"))
    return out.select(*pages.columns, "host", "path", "rule", "verdict")


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
