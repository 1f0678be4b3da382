"""URL filters by link-graph propagation (operator 4).

Host edges come from the pages' absolute links and from mentions of crawled hosts. Two ranks run over them together:
personalised PageRank from trusted seeds along the edges, and distrust from blocked seeds against them. Seeds are hosts
by the number of their pages that a rule allows or blocks. A host whose distrust exceeds its trust by more than
`margin` of the mean seed mass is blocked. A page with a rule takes the rule's verdict, any other its host's.

Rounds go on until the mass still to come is at most `tolerance` over all hosts together, a hundredth of the margin, and
raise if a limit is reached first. Ranks are held as shared tables after each round; hub hosts are split by salt, parallel edges are counted before the
shuffle. Mass of hosts without out-links returns to the seeds, and ranks are rounded, so the order of sums does not matter.
Hosts that are linked to but not crawled take part.

Defined results. Null url or one without ://: host and path empty, no rule; the empty host has no edges and is allowed.
Null html: no links. No pages: no rows. No seeds or no edges: hosts without distrust are allowed. Repeated rows: judged
alike, each with its links. Rules of equal length: the one listed first. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def judged(pages: DataFrame, rules) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null)."""
    host, path = host_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    fitting = []
    for place, (verdict, text) in enumerate(rules):
        own, _, start = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(f"/{start}")
        fitting.append(F.when(fits, F.struct(F.lit(len(text)).alias("size"), F.lit(-place).alias("place"), F.lit(text).alias("rule"), F.lit(verdict).alias("ruled"))))
    best = F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<rule:string,ruled:string>")
    return rows.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "ruled": F.col("_best.ruled")}).drop("_best")


def edges(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, n: links to other hosts, and mentions of other crawled hosts."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = r"((?:[a-z0-9-]+\.)+[a-z]{2,})"
    links = F.regexp_extract_all(html, F.lit(rf"""(?i)href\s*=\s*["']?(?:https?:)?//{name}(?=[/?#:"'\s<>]|$)"""), F.lit(1))
    mentions = F.regexp_extract_all(html, F.lit(rf"""(?i)[\s>]{name}(?=[/?#"'\s<:]|$)"""), F.lit(1))
    found = rows.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.concat(F.transform(links, lambda x: F.struct(x.alias("dst"), F.lit(True).alias("link"))), F.transform(mentions, lambda x: F.struct(x.alias("dst"), F.lit(False).alias("link"))))).alias("e"))
    found = found.select("src", F.translate("e.dst", _UPPER, _LOWER).alias("dst"), "e.link").filter("src <> dst")
    counted = found.groupBy("src", "dst", "link").agg(F.count("*").alias("n"))
    crawled = hosts.select(F.col("host").alias("dst"), F.lit(True).alias("crawled"))
    return counted.join(crawled, "dst", "left").filter("link OR crawled").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(graph: DataFrame, seeds: DataFrame, tolerance: float, keep: float, salts: int = 8, limit: int = 1000) -> DataFrame:
    """kind, host, mass. graph: kind, src, dst, part (of src's mass); seeds: kind, host, seed.

    A round adds the mass that arrives after one more link. With `moving` the sum of what it added, at most
    moving * keep / (1 - keep) is still to come to all hosts together; the rounds end when that is at most (1 - keep) of
    `tolerance`. The mass of hosts without out-edges returns to the seeds in proportion to their own: what comes of it is
    again the same ranks, so all of it together is the ranks without it, scaled to the sum of the seeds.
    """
    graph = common.cut(graph.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")))
    own = F.round(F.col("seed") * (1 - keep), 9)
    state = common.cut(seeds.select("kind", "host", own.alias("mass"), own.alias("moving")))
    for _ in range(limit):
        if (state.agg(F.sum("moving")).first()[0] or 0.0) * keep / (1 - keep) <= tolerance * (1 - keep):
            whole = seeds.groupBy("kind").agg(F.sum("seed").alias("whole")).join(state.groupBy("kind").agg(F.sum("mass").alias("found")), "kind")  # a row a kind
            scaled = F.round(F.col("mass") * F.col("whole") / F.col("found"), 9)
            return state.join(F.broadcast(whole), "kind").select("kind", "host", scaled.alias("mass"))
        spread = state.filter("moving > 0").select("kind", F.col("host").alias("src"), "moving", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
        sent = graph.join(spread, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("moving") * F.col("part") * keep).alias("moving"))
        both = state.select("kind", "host", "mass", F.lit(0.0).alias("moving")).unionByName(sent.select("kind", "host", F.col("moving").alias("mass"), "moving"))
        last, state = state, common.cut(both.groupBy("kind", "host").agg(F.round(F.sum("mass"), 9).alias("mass"), F.round(F.sum("moving"), 9).alias("moving")))
        common.forget(last)
    raise RuntimeError(f"ranks have not settled in {limit} rounds")


def verdicts(pages: DataFrame, rules=RULES, keep: float = 0.85, margin: float = 0.05, tolerance: float = 0.0005) -> DataFrame:
    rows = judged(pages, rules)
    hosts = common.cut(rows.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")).filter("host <> ''"))
    total = hosts.agg(F.sum("good"), F.sum("bad"), F.count("*")).first()
    good, bad, n = (float(x or 0) for x in total)
    # the mean host has mass 1, so that a host's ranks do not shrink as hosts are added
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", (F.col("good") * (n / max(good, 1.0))).alias("seed")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", (F.col("bad") * (n / max(bad, 1.0))).alias("seed"))).filter("seed > 0")
    links = common.cut(edges(rows, hosts))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    back = links.groupBy("dst").agg(F.sum("n").alias("all"))
    along = common.salted_join(links, out, ["src"], "dst").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("part"))
    against = common.salted_join(links, back, ["dst"], "src").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("part"))
    mass = propagate(along.unionByName(against), seeds, tolerance, keep)
    score = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    blocked = score.filter(F.col("distrust") - F.col("trust") > margin).select("host", F.lit(True).alias("blocked"))
    light = rows.drop("html")
    found = light.join(F.broadcast(blocked), "host", "left") if common.small(blocked, 200_000) else common.salted_join(light, blocked, ["host"], "page_id", 16, "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return verdicts(common.read(spark, sf_dir, "pages"))
