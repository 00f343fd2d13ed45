"""URL filter by path-template trees.

Rules come first: (host, path, verdict), of which the longest that fits decides. The other URLs
are judged by templates. Per host, path segments form a tree that is walked level by level as
aggregates over the table:

* a segment that is variable by its shape (number, hash, date, a name that ends in a number, ...)
  becomes a wildcard for that shape;
* where a node has many children for its size, that is, a share of ``VARIABLE_SHARE`` or more of
  its URLs (and ``VARIABLE_MIN``) have segments of their own, its segments become one wildcard;
* sibling branches with labels of their own whose labelled purity and share of labelled URLs don't
  differ significantly (two-proportion tests against the node's own rates) are merged into a wildcard too.

A template's purity is its share of blocked among its labelled URLs, smoothed at each level towards what
the level above lets expect: that level's purity, as far as its URLs are labelled, and ``NEUTRAL`` for the
rest, from the host's domain down to the template. So labels on one branch say little about an unlabelled branch
beside it. A URL is rejected if its template's smoothed purity is over ``REJECT`` and its host has at
least ``SUPPORT`` labels.

Labels are either a column of the table or what the rules say. Each level is one pre-aggregated
shuffle on (host, template so far); a hot host only makes a few more counts in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Levels of the tree; what lies deeper is judged as one segment.
DEPTH = 6
VARIABLE_SHARE = 0.5
VARIABLE_MIN = 8
#: Significance at which a branch stays apart from its siblings (two-sided normal quantile, 1 %).
APART_Z = 2.576
#: Weight, in URLs, of the parent's purity in a template's.
SMOOTHING = 4.0
REJECT = 0.5
#: Purity that is expected where nothing is labelled.
NEUTRAL = 0.2
#: Labels that a host must have before a template of it rejects.
SUPPORT = 3
#: Labels that a branch must have before it merges with its siblings.
MERGE_LABELS = 2

# Shapes of variable segments, first that matches.
SHAPES = [
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"), (r"^[0-9]+$", "{num}"), (r"^[0-9]+\.[A-Za-z]{1,5}$", "{num}.*"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F-]{22}$", "{uuid}"), (r"^[0-9a-fA-F]{16,}$", "{hash}"), (r"^.*[0-9]{2,}.*$", "{mixed}"),
]

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; null or no ``://``: empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null fields if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules equally long the
    first in the order of their text decides.
    """
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def shaped(path: Column) -> Column:
    """A path's segments, variable ones as the name of their shape; a literal that looks like such a name, or a wildcard, is escaped."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.coalesce(_shape(s), F.when(s.rlike(r"^[{*\\]"), F.concat(F.lit("\\"), s)).otherwise(s)))


def templates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``counts`` (host, segments as ``shaped``, n, labelled, blocked) with ``template``, an array that grows by levels."""
    rows = counts.withColumn("template", F.array().cast("array<string>"))
    for level in range(depth):
        deeper = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        rows = rows.withColumn("segment", F.when(F.size("segments") > level, deeper) if level == depth - 1 else F.get("segments", F.lit(level)))
        node = ["host", "template"]
        children = rows.where("segment is not null").groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        nodes = children.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("n").alias("node_n"), F.sum("labelled").alias("node_labelled"), F.sum("blocked").alias("node_blocked"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
        rate = (F.col("node_labelled") / F.col("node_n")).alias("rate")
        joined = children.join(nodes.withColumn("rate", rate).withColumn("purity", F.coalesce(F.try_divide("node_blocked", "node_labelled"), F.lit(0.0))), node)
        variable = (F.col("kids") >= VARIABLE_MIN) & (F.col("kids") >= F.col("node_n") * VARIABLE_SHARE)

        def same(successes: str, trials: str, expected: str) -> Column:
            spread = F.sqrt(F.greatest(F.col(expected) * (1 - F.col(expected)) * F.col(trials), F.lit(0.0)))
            return F.abs(F.col(successes) - F.col(expected) * F.col(trials)) <= APART_Z * spread + 1e-9

        alike = same("labelled", "n", "rate") & same("blocked", "labelled", "purity") & (F.col("kids") > 1) & (F.col("labelled") >= MERGE_LABELS)
        part = F.when(F.col("segment").startswith("{"), F.col("segment")).when(variable | alike, F.lit("*")).otherwise(F.col("segment"))
        named = joined.select(*node, "segment", part.alias("part"))
        rows = rows.join(named, [*node, "segment"], "left").withColumn("template", F.when(F.col("part").isNotNull(), F.concat("template", F.array("part"))).otherwise(F.col("template"))).drop("segment", "part")
        if level % 2:
            rows = materialize(rows)
    return rows


def _smoothed(blocked: Column, labelled: Column, expected: Column) -> Column:
    return (blocked + SMOOTHING * expected) / (labelled + SMOOTHING)


def _expected(purity: Column, labelled: Column, n: Column) -> Column:
    """What a level lets the one below it expect: its purity for the labelled share of its URLs, NEUTRAL for the rest."""
    return NEUTRAL + (purity - NEUTRAL) * labelled / n


def purities(rows: DataFrame) -> DataFrame:
    """(host, template, purity, support) of each template in ``rows``, smoothed from the domain down to the template.

    support: the host's labels.
    """
    domain = F.substring_index("host", ".", -2)
    sums = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum("n").alias("n")]
    leaf = rows.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("labelled", "blocked", "n")])
    by_host = leaf.groupBy("host").agg(*sums).withColumn("domain", domain)
    by_domain = by_host.groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("l", "b", "n")])
    expected = by_domain.select("domain", _expected(_smoothed(F.col("b"), F.col("l"), F.lit(NEUTRAL)), F.col("l"), F.col("n")).alias("expected"))
    hosts = by_host.join(expected, "domain").withColumn("purity", _smoothed(F.col("b"), F.col("l"), F.col("expected")))
    hosts = hosts.select("host", F.col("l").alias("support"), _expected(F.col("purity"), F.col("l"), F.col("n")).alias("expected"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("template"), F.lit(1))), lambda k: F.slice("template", 1, k))
    counted = leaf.select("host", F.explode(prefixes).alias("prefix"), "labelled", "blocked", "n").groupBy("host", "prefix").agg(*sums)
    chain = leaf.select("host", "template", F.posexplode(prefixes).alias("k", "prefix")).join(counted, ["host", "prefix"])
    steps = chain.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("k", "l", "b", "n"))).alias("steps"))  # at most one a level

    def step(acc: Column, s: Column) -> Column:
        purity = _smoothed(s["b"], s["l"], acc["expected"])
        return F.struct(purity.alias("purity"), _expected(purity, s["l"], s["n"]).alias("expected"))

    walked = F.aggregate("steps", F.struct(F.lit(0.0).alias("purity"), F.col("expected").alias("expected")), step, lambda acc: acc["purity"])
    return steps.join(hosts, "host").select("host", "template", walked.alias("purity"), "support")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict (allow or block), template, purity.

    ``label``: a boolean column (true: to block; null: unlabelled); by default what the rules say. A null
    URL, or one without ``://``, has an empty host and path and goes by the template of no segments.
    Repeated rows stay; an empty table gives no rows; no other column is read.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), (label if label is not None else F.lit(None).cast("boolean")).alias("given"))
    split = base.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "given")
    split = split.withColumn("r", by_rules(F.col("host"), F.col("path"), rules))
    marked = split.withColumn("bad", F.col("given") if label is not None else F.col("r.verdict") == "block")
    # Shapes are taken before counting, so that the counts have a row a shape and not one a URL.
    marked = marked.withColumn("segments", shaped(F.col("path")))
    counts = materialize(marked.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("blocked")))
    placed = materialize(templates(counts, depth))
    known = placed.select("host", "segments", "template").join(purities(placed), ["host", "template"])
    out = marked.join(known, ["host", "segments"], "left")
    own = F.when((F.col("purity") > REJECT) & (F.col("support") >= SUPPORT), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 9).alias("purity"))
