"""URL filter by link-graph propagation (DataFrame functions only).

Rules judge the urls they fit.  Every other url gets its host's verdict:
trust is a personalised PageRank that flows along host links from hosts with
allowed pages, distrust one that flows against the links from hosts with
blocked pages, so a host that links to blocked hosts is distrusted.  A host is
blocked if its distrust is more than ``ratio`` times its trust.

Defined results.  A null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed.  A host that neither flow reaches is
allowed.  Flows end where they no longer move a score by TOLERANCE, about 130
links from a seed of one page.  Null html has no links; very long html is read
whole.  Repeated rows each count as a page.  Of
several fitting rules the longest wins, of equally long ones a block.  Other
columns of the pages are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, durable

# Absolute and protocol-relative targets of href and src attributes.  Possessive
# parts take each blank once, so the time is linear in the text.
LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?+\s*+((?:[a-z][a-z0-9+.\-]*+:)?+//[^"'\s<>]++)"""
DAMPING = 0.85
TOLERANCE = 1e-10     # flows end where no score moves by more
UNROLLED = 8          # rounds between two written states
MARGIN = 1e-6         # share by which distrust has to exceed trust
MOST_ROUNDS = 4_000   # damping lets any flow settle in far fewer


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    tail = url.substr(at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(tail, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    tail = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits.
    ``rules``: (allow or block, host/path), a short list."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule = verdict = None
    for v, text in ordered:
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, with their number.
    Relative links stay on their own host and so carry nothing."""
    found = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1))
    target = F.when(F.col("t").startswith("//"), F.concat(F.lit("x:"), "t")).otherwise(F.col("t"))
    return (pages.select(host_of(F.col("url")).alias("src"), found.alias("t"))
            .select("src", host_of(target).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
           most: int = MOST_ROUNDS) -> DataFrame:
    """Personalised PageRank (node, score) of ``seeds`` (node, seed) over
    weighted ``links`` (src, dst, w): each round a node keeps (1 - damping) of
    its seed and passes damping of its score on, in proportion to the weights.
    Rounds go on until no score moves by more than ``tolerance``; what still
    moves after ``most`` rounds raises an error."""
    out = links.groupBy("src").agg(F.sum("w").alias("_out"))
    share = durable(links.join(out.withColumnRenamed("src", "_s"), F.col("src") == F.col("_s"))
                    .select("src", "dst", (F.col("w") / F.col("_out")).alias("share")), "links")
    base = durable(seeds.where("seed > 0").select("node", (F.col("seed") * (1 - damping)).alias("score")), "seeds")
    # A score is the sum of what arrives over paths of each length: ``score`` so
    # far, ``last`` over the longest paths.  A link to itself hands on the score.
    nodes = share.select(F.col("src").alias("node")).union(share.select("dst")).union(base.select("node")).distinct()
    same = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("share"))
    steps = durable(share.unionByName(same), "steps")
    now = base.select("node", "score", F.col("score").alias("last"))
    for _ in range(0, most, UNROLLED):
        for _ in range(UNROLLED):
            kept, passed = F.when(F.col("share").isNull(), F.col("score")), F.col("last") * F.col("share") * damping
            now = (now.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"))
                   .agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("score"), F.coalesce(F.sum(passed), F.lit(0.0)).alias("last")))
            now = now.select("node", (F.col("score") + F.col("last")).alias("score"), "last")
        now = durable(now, "ranks")
        if (now.agg(F.max("last")).first()[0] or 0.0) <= tolerance:
            return now.select("node", "score")
    raise RuntimeError(f"scores did not settle in {most} rounds")


def host_verdicts(judged: DataFrame, links: DataFrame, ratio: float = 1.0, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, verdict) of each host reached by a flow.
    ``judged``: (host, ruled), ruled being allow, block or null per page."""
    seeds = (judged.where("host <> '' and ruled is not null").groupBy("host")
             .agg(F.sum((F.col("ruled") == "allow").cast("double")).alias("allow"),
                  F.sum((F.col("ruled") == "block").cast("double")).alias("block")))
    seeds, links = durable(seeds, "host-seeds"), durable(links, "host-links")
    trust = spread(seeds.select(F.col("host").alias("node"), F.col("allow").alias("seed")), links, damping)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = spread(seeds.select(F.col("host").alias("node"), F.col("block").alias("seed")), back, damping)
    both = (trust.select(F.col("node").alias("host"), F.col("score").alias("trust"))
            .join(distrust.select(F.col("node").alias("host"), F.col("score").alias("distrust")), "host", "full")
            .na.fill(0.0, ["trust", "distrust"]))
    # The margin is for the order of the sums.
    blocked = F.col("distrust") > ratio * F.col("trust") * (1 + MARGIN)
    return both.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], ratio: float = 1.0,
                damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), ruled.alias("ruled"))
    hosts = durable(host_verdicts(p.select("host", "ruled"), host_links(pages.select("url", "html")),
                                  ratio, damping), "host-verdicts")
    hosts = hosts.select(F.col("host").alias("_host"), "trust", "distrust", F.col("verdict").alias("_verdict"))
    return (p.join(hosts, F.col("host") == F.col("_host"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", "_verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"),
                    F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
