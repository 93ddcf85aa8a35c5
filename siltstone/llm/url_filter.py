"""URL filtering by rules and by trust that spreads over the host graph.

Rules (host, path, verdict) fit a url whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path; the longest rule wins. Where no rule fits, the
host's verdict decides: personalised PageRank spreads trust from hosts with allowed urls
along host edges, and distrust from hosts with blocked urls against them; a host is blocked
if its distrust exceeds `threshold` times its trust.

Host edges are the absolute hyperlinks of the pages, weighted by their number, and a weak
edge each way between a host and the domain it lies in. Self links do not count. Mass of
hosts without a way out returns to the seeds, which is the same as scaling, so ranks are
sums of what walks of each length bring, scaled to 1 at the end.

Walks go on until what is still on its way is below `tolerance` of all; a bound of rounds
that is hit raises an error. CHAIN steps run as one plan, whose edges are shuffled once, and
are then written to the shared folder; nothing is collected but the mass on its way. Url rows
are joined with hosts by equi-joins,
whose hot hosts AQE splits; the rule table is expanded as expressions while it has at most
`inline_rules` rules and joined by domain suffix beyond.

Defined results: a null url or one without `://` has empty host and path, no rule (rules
name hosts) and the method's verdict `allow`; a null page counts as without links; ties of
rules are impossible but for duplicates, of which block wins; repeated rows keep their
rows; an empty table gives an empty result. Only the three named columns are looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import materialize

Rule = tuple[str, str, str]
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
CHAIN = 8
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """host, path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and the domains it lies in."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def apply_rules(urls: DataFrame, rules: list[Rule], inline_rules: int = 200) -> DataFrame:
    """urls with host, path -> also rule, rule_verdict (null where none fits)."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(rules) <= inline_rules:
        hit = None
        for host, path, verdict in order:
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
            hit = F.when(fits, value) if hit is None else hit.when(fits, value)
        return urls.withColumn("hit", hit).withColumns({"rule": F.col("hit.rule"), "rule_verdict": F.col("hit.verdict")}).drop("hit")
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, v, -len(h + p), v != "block") for h, p, v in rules], "rule_host string, rule_path string, verdict string, short int, late boolean")
    hosts = urls.select("host").distinct().withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
    own = hosts.join(table, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("short", "late", "rule_host", "rule_path", "verdict"))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    out = urls.join(own, "host", "left").withColumn("hit", first)
    return out.withColumns({"rule": F.concat(F.col("hit.rule_host"), F.col("hit.rule_path")), "rule_verdict": F.col("hit.verdict")}).drop("hit", "rules")


def host_edges(pages: DataFrame, html: str, hierarchy: float) -> DataFrame:
    """pages with host -> src, dst, w (w sums to 1 for each src)."""
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lambda u: split_url(u)[0])
    pairs = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst")).filter("dst <> '' and src <> dst")
    linked = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    nodes = pages.select("host").filter("host <> ''").union(linked.select("dst")).distinct()
    up = nodes.withColumn("up", F.regexp_extract("host", r"^[^.]*\.(.+\..+)$", 1)).filter("up <> ''")
    up = nodes.select("host").join(up.select(F.col("host").alias("low"), F.col("up").alias("host")), "host")
    tree = up.select(F.col("low").alias("src"), F.col("host").alias("dst")).union(up.select("host", "low")).withColumn("w", F.lit(hierarchy))
    every = linked.union(tree).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return every


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 400, tolerance: float = 1e-6) -> DataFrame:
    """seeds: host, trust, distrust (each sums to 1 or is 0) -> the same of every host reached."""
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("all"))
    ahead = edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), (F.col("w") / F.col("all")).alias("d"))
    moves = ahead.union(back).groupBy("src", "dst").agg((damping * F.sum("t")).alias("t"), (damping * F.sum("d")).alias("d")).withColumn("stay", F.lit(0.0))
    # a way from each host to itself, on which what has arrived stays
    hosts = edges.select("src").union(edges.select("dst")).union(seeds.select("host")).distinct()
    stays = hosts.select(F.col("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), F.lit(0.0).alias("d"), F.lit(1.0).alias("stay"))
    ways = materialize(moves.union(stays), "host-ways")
    now = materialize(seeds.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"), F.col("trust").alias("t1"), F.col("distrust").alias("d1")), "host-ranks")
    for _ in range(0, rounds, CHAIN):
        left = now.agg(F.coalesce(F.sum(F.col("t0") + F.col("d0")), F.lit(0.0))).first()[0]
        if left < tolerance:
            break
        for _ in range(CHAIN):
            step, kept = (lambda x: F.sum(F.col(x + "0") * F.col(x))), (lambda x: F.sum(F.col(x + "0") * F.col(x) + F.col(x + "1") * F.col("stay")))
            now = now.join(ways, now["host"] == ways["src"]).groupBy("dst").agg(step("t").alias("t0"), step("d").alias("d0"), kept("t").alias("t1"), kept("d").alias("d1")).withColumnRenamed("dst", "host")
        now = materialize(now, "host-ranks")
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    total = now.agg(F.sum("t1").alias("all_t"), F.sum("d1").alias("all_d"))
    share = lambda x, s: F.when(F.col(s) > 0, F.col(x) / F.col(s)).otherwise(F.lit(0.0))
    return now.crossJoin(F.broadcast(total)).select("host", share("t1", "all_t").alias("trust"), share("d1", "all_d").alias("distrust"))  # total is one row


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[Rule] | None = None, damping: float = 0.85, hierarchy: float = 0.1, rounds: int = 400, tolerance: float = 1e-6, threshold: float = 1.0) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust for every row."""
    host, path = split_url(F.col(url_col))
    own = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = apply_rules(own.drop("html"), RULES if rules is None else rules)
    mass = ruled.filter("host <> '' and rule is not null").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    total = mass.agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
    share = lambda x, s: F.when(F.col(s) > 0, F.col(x) / F.col(s)).otherwise(F.lit(0.0))
    seeds = mass.crossJoin(F.broadcast(total)).select("host", share("a", "sum_a").alias("trust"), share("b", "sum_b").alias("distrust"))  # total is one row
    ranks = spread(host_edges(own.select("host", "html"), "html", hierarchy), seeds, damping, rounds, tolerance)
    out = ruled.join(ranks, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("rule_verdict", F.when(distrust > threshold * trust, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
