"""URL filters (operator 2): rules by host and path, then link-graph propagation, in DataFrame operations alone.

A rule allows or blocks a host with all its subdomains below a path prefix; the longest fitting rule wins.
A few rules are one expression; many are looked up by the parent domains of each distinct host. Other urls are judged by their host. Host edges are counted from absolute links in the pages. Seeds are the
hosts of pages that rules decide, by their number of pages: allowed ones for trust, blocked ones for distrust. Trust
spreads along links by personalised PageRank, distrust along reversed links. A host is blocked if distrust is
at least `share` of what reached it; a host that nothing reached is allowed.

Only the aggregated host graph is iterated; a host with very many links has one row per linked host.

Defined results: a null url or one without "://" has empty host and path and, without a rule, is allowed; null
html has no links; repeated pages are judged alike; an empty table gives an empty result. Other columns are
ignored unless named in `keep`; one named like an output is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

OUTPUTS = ("host", "path", "rule", "verdict", "trust", "distrust")
BROADCAST_HOSTS, CHAIN = 100_000, 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\b(?:href|src)\s*=\s*[\x22\x27]?\s*(?:https?:)?//([^/?#\x22\x27\s>]+)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a url without them."""
    part = lambda i: F.coalesce(F.regexp_extract(url.cast("string"), _URL, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matched(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null without one. rules: (action, host/path)."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def by_host(found: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """found (host, path, ...) with rule and action, for any number of rules: those of each distinct host are looked up by its parent domains."""
    spark = found.sparkSession
    table = spark.createDataFrame([(text.partition("/")[0], len(text), text, "/" + text.partition("/")[2], what) for what, text in rules], "own string, long int, text string, start string, what string")
    labels = F.split("host", r"\.")
    hosts = found.select("host").distinct().withColumn("own", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fitting = hosts.join(table, "own").groupBy(F.col("host").alias("h")).agg(F.sort_array(F.collect_list(F.struct("long", "text", "start", "what")), asc=False).alias("fitting"))
    first = F.try_element_at(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(1))
    out = found.join(fitting, F.col("host") == F.col("h"), "left").withColumn("__first", first)
    return out.withColumns({"rule": F.col("__first.text"), "verdict": F.col("__first.what")}).drop("h", "fitting", "__first")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """(host, trust, distrust). seeds (kind, host, mass); edges (kind, src, dst, part): parts of a source sum to 1.

    What a round doesn't hand on, as hosts without links hold it or by damping, returns to the seeds of its kind, so a kind's mass stays that of its seeds.
    Rounds end when no host is new and the change of mass is at most the tolerance; if it is not after `rounds`, that is an error.
    """
    edges, seeds = settle(edges), settle(seeds)
    mass, whole = seeds, {r["kind"]: r["mass"] for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    for _ in range(rounds):
        moved = mass.alias("m").join(edges.alias("e"), (F.col("m.host") == F.col("e.src")) & (F.col("m.kind") == F.col("e.kind"))).groupBy("e.kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("mass") * F.col("part"))).alias("mass"))
        moved = settle(moved)
        handed = {r["kind"]: r["mass"] for r in moved.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
        back = F.lit(0.0)
        for kind, total in whole.items():
            back = F.when(F.col("kind") == kind, F.lit(1 - handed.get(kind, 0.0) / total)).otherwise(back)
        before, mass = mass, settle(moved.unionByName(seeds.withColumn("mass", back * F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
        both = mass.withColumn("was", F.lit(0.0)).unionByName(before.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("was"))).groupBy("kind", "host").agg(F.sum("mass").alias("now"), F.sum("was").alias("was"))
        change, new = both.agg(F.coalesce(F.sum(F.abs(F.col("now") - F.col("was"))), F.lit(0.0)), F.count(F.when(F.col("was") == 0, 1))).first()
        if change <= tolerance and not new:
            break
    else:
        raise RuntimeError(f"trust did not settle in {rounds} rounds")
    return mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("mass")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], keep: list[str], url: str = "url", html: str = "html", share: float = 0.6) -> DataFrame:
    """pages' columns `keep`, host, path, rule, verdict and the host's trust and distrust."""
    keep = [c for c in keep if c not in OUTPUTS]
    host, path = parts(F.col(url))
    found = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("__none")).alias("kept"), host.alias("host"), path.alias("path"))
    if len(rules) <= CHAIN:
        rule, action = matched(rules, F.col("host"), F.col("path"))
        found = found.withColumn("rule", rule).withColumn("verdict", action)
    else:
        found = by_host(found, rules)
    links = pages.select(parts(F.col(url))[0].alias("src"), F.explode(F.regexp_extract_all(F.col(html).cast("string"), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    links = settle(links)
    forward = links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.lit("allow").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("part"))
    back = links.join(links.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("part"))
    seeds = found.where("verdict is not null and host <> ''").groupBy(F.col("verdict").alias("kind"), "host").agg(F.count("*").cast("double").alias("n"))
    seeds = settle(seeds)
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    # Both kinds are scaled by the same number of pages, so that a host's own allowed and blocked pages weigh alike.
    scale = total.agg(F.max("all")).first()[0] or 1.0
    reached = propagate(seeds.select("kind", "host", (F.col("n") / scale).alias("mass")), forward.unionByName(back))
    reached = reached.select(F.col("host").alias("h"), F.round("trust", 15).alias("trust"), F.round("distrust", 15).alias("distrust"))
    bad = (F.coalesce("distrust", F.lit(0.0)) > 0) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust")))
    reached = settle(reached)
    # Scores of few hosts travel to the pages; beyond that both sides are shuffled by host, and Spark splits a hot one.
    few = reached.count() <= BROADCAST_HOSTS
    out = found.join(F.broadcast(reached) if few else reached, found["host"] == reached["h"], "left")
    verdict = F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    return out.select("kept.*", "host", "path", "rule", verdict, "trust", "distrust").drop("__none")
