"""Operator 2, URL filters: host and path rules, and a tree of path templates for what no rule decides.

Rules. A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins.

Templates, per host, level by level until no path is deeper. The shape of the tree turns on distinct paths, however often each is seen:
1. A segment that varies becomes a wildcard: one that holds a digit, or one of a parent with at least MANY distinct segments
   with MOST_OFTEN paths or fewer each on average.
2. Branches of a parent that stay and are alike merge into one, written `(least+)` by its least segment. A branch's profile is what comes next below it: the
   shares of its paths by kind of the next segment and by label (the pages of a path share its weight of 1). Branches of SEEN paths or more fall into buckets by
   their profile, rounded to GRID parts; in a bucket of two or more, those whose Jensen-Shannon divergence from the bucket's pooled profile is ALIKE or
   less merge. So branches are compared with those that are like them, and the work is linear in the branches.
3. Labels are the rules' own verdicts, or any (page_id, bad) table. A template's purity is (bad + STRENGTH * prior) / (labelled + STRENGTH); the prior is its
   host's smoothed share, whose own prior is that of all urls. A template with labelled urls, whose purity is REJECT or more, rejects.

All counts are plain two-step aggregates over (host, path parts), so a host with a third of all urls is never one group. What a parent decides is
joined to its distinct segments, in SALTS parts; steps join back by (host, template, segment) to distinct paths, not to urls of a host.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; an empty path is the template ``; page_id may
be null or repeat; html and extra columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, load, prepare


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str  # host and path, such as `example.com/en/7`

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (UrlRule("block", "com/en/"), UrlRule("allow", "example.com/en/7"), UrlRule("allow", "net/de/"), UrlRule("block", "example.net/de/8"), UrlRule("block", "org/es/"))
MANY, MOST_OFTEN, GRID, ALIKE, SEEN, STRENGTH, REJECT, SALTS = 20, 2.0, 4, 0.05, 8, 4.0, 0.8, 16
KINDS, LABELS = ("end", "slash", "digits", "word"), ("bad", "good", "none")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    # (?s): a url may hold line ends.
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, or null. The list is the caller's, a few rules, not data."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.rule, F.lit(r.verdict)).otherwise(out)
    return out


def _kind(segment: Column) -> Column:
    return F.when(segment.isNull(), "end").when(segment == "", "slash").when(segment.rlike("[0-9]"), "digits").otherwise("word")


def _divergence(p: str, q: str) -> Column:
    """Jensen-Shannon divergence, in bits, of two arrays of weights, each scaled to 1."""
    one = lambda x: f"transform({x}, v -> v / aggregate({x}, 0d, (s, w) -> s + w))"
    both = "if(a = 0, 0d, a * log2(2 * a / (a + b))) + if(b = 0, 0d, b * log2(2 * b / (a + b)))"
    return F.expr(f"0.5 * aggregate(zip_with({one(p)}, {one(q)}, (a, b) -> {both}), 0d, (s, v) -> s + v)")


def _steps(at: DataFrame) -> DataFrame:
    """(host, template, segment, step) of the words among the segments of one level, of (host, template, segment, next, n, labelled, bad)."""
    weight = {"bad": F.col("bad") / F.col("n"), "good": (F.col("labelled") - F.col("bad")) / F.col("n"), "none": (F.col("n") - F.col("labelled")) / F.col("n")}
    cells = F.array(*(F.round(F.sum(F.when(F.col("next") == k, weight[x]).otherwise(0.0)), 9) for k in KINDS for x in LABELS))
    seen = at.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("paths"), cells.alias("profile"))
    parents = seen.groupBy("host", "template").agg(((F.count(F.lit(1)) >= MANY) & (F.sum("paths") <= F.count(F.lit(1)) * MOST_OFTEN)).alias("varies"))
    parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(parents, ["host", "template", "salt"]).drop("salt")
    bucket = F.when(~F.col("varies") & (F.col("paths") >= SEEN), F.expr(f"array_join(transform(profile, v -> cast(floor(round(v / paths, 9) * {GRID} + 0.5) as int)), ',')"))
    seen = seen.withColumn("bucket", bucket)
    size = len(KINDS) * len(LABELS)
    pooled = seen.where("bucket is not null").groupBy("host", "template", "bucket").agg(F.array(*(F.round(F.sum(F.get("profile", F.lit(i))), 6) for i in range(size))).alias("pooled"))
    alike = seen.join(pooled, ["host", "template", "bucket"]).where(_divergence("profile", "pooled") <= ALIKE).select("host", "template", "bucket", "segment")
    least = alike.groupBy("host", "template", "bucket").agg(F.min("segment").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    merged = alike.join(least, ["host", "template", "bucket"]).select("host", "template", "segment", F.concat(F.lit("("), "least", F.lit("+)")).alias("merged"))
    step = F.when(F.col("varies"), "*").otherwise(F.coalesce("merged", "segment"))
    return seen.join(merged, ["host", "template", "segment"], "left").select("host", "template", "segment", step.alias("step"))


def templates(urls: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (host, path, bad), bad null where there is no label: (host, path, template) of distinct paths, and the templates with their figures."""
    paths = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    paths = paths.withColumn("parts", F.expr("if(path = '', array(), split(substr(path, 2), '/'))"))
    paths = scratch.table(paths.withColumn("template", F.lit("")), "paths-0")
    for level in itertools.count():
        here, below = F.get("parts", F.lit(level)), F.get("parts", F.lit(level + 1))
        at = paths.withColumn("kind", F.when(F.size("parts") > level, _kind(here)))
        word = at.where("kind = 'word'").withColumn("segment", here)
        steps = scratch.table(_steps(word.withColumn("next", _kind(below))), f"steps-{level}")
        longer = lambda step: F.concat("template", F.lit("/"), step)
        # Only words ask the table of steps; paths that have ended stay as they are.
        columns = [F.col(c) for c in paths.columns if c != "template"]
        named = word.join(steps, ["host", "template", "segment"]).select(*columns, longer(F.col("step")).alias("template"))
        other = at.where("kind is null or kind <> 'word'").select(*columns, F.when(F.col("kind") == "slash", longer(F.lit(""))).when(F.col("kind") == "digits", longer(F.lit("*"))).otherwise(F.col("template")).alias("template"))
        paths = scratch.table(named.unionByName(other), f"paths-{level + 1}")
        scratch.drop(f"paths-{level}", f"steps-{level}")
        if paths.where(F.size("parts") > level + 1).isEmpty():
            break
    counts = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    counts = scratch.table(counts, "template-counts")
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    labelled, bad = counts.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (F.col("host_bad") + STRENGTH * (bad + 1) / (labelled + 2)) / (F.col("host_labelled") + STRENGTH)
    figures = counts.join(hosts, "host").withColumn("purity", (F.col("bad") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)).withColumn("rejected", (F.col("labelled") > 0) & (F.col("purity") >= REJECT)).drop("host_labelled", "host_bad")
    return paths.select("host", "path", "template"), scratch.table(figures, "templates")


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page (page_id, url). labels: (page_id, bad boolean) instead of the rules' verdicts."""
    spark = prepare(pages.sparkSession)
    scratch = Scratch(spark)
    host, path = host_and_path()
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = verdict_of(F.col("rule"), rules)
    if labels is None:
        pages = pages.withColumn("bad", ruled == "block")
    else:
        pages = pages.join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    pages = scratch.table(pages, "pages")
    shapes, figures = templates(pages.where("host <> ''"), scratch)
    found = scratch.table(shapes.join(figures.select("host", "template", "purity", "rejected"), ["host", "template"]), "shapes")
    out = pages.join(found, ["host", "path"], "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("rejected"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"))
