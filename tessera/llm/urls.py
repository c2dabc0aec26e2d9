"""URL filter: explicit rules, then a tree of path templates (DataFrame functions only).

Rules name a host and a path; one fits its host and all subdomains where the
url's path starts with the rule's, and the longest rule wins.

What no rule decides is judged by its template.  Per host, the paths form a
tree, in which digits are ``<n>`` and long hexadecimal marks ``<x>``.  Level by level:

* Segments that vary are the wildcard ``*``: values with fewer than MIN_LABELS
  labels, and all whose rate of bad labels does not differ from their node's.  A
  difference counts beyond z = ``merge_z`` + sqrt(2 ln values), with a continuity
  correction: the more different values a node has, the more differ by chance.
* Of the others, those that are alike are one branch, ``*1``, ``*2`` and so on:
  they are dealt into BINS classes by their rate, and neighbouring classes whose
  rates do not differ (two-proportion z up to ``merge_z``) are merged.  What
  remains alone keeps its name.

A template's purity is its share of good labels, smoothed towards that of the
host and this towards that of the corpus; templates of a purity below
``min_purity`` are rejected.

The tree is built on counts by host and shape of path, so its size follows the
distinct shapes; hot hosts are summed map-side before any shuffle, and siblings
are compared by class, at most BINS to a node.

Defined results: a null url, or one without ``://``, has an empty host and path,
which no rule fits and whose template is the empty one; segments beyond
``depth`` form one; urls that repeat count as often as they occur; an empty
table gives an empty result; labels of no url are ignored; columns of the input
named like those made here are replaced, others are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns, quoted

DEPTH = 5
MERGE_Z = 2.0
MIN_LABELS = 5
BINS = 64
MIN_PURITY = 0.5
SMOOTHING = 4.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {self.verdict!r}")

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls.

    The rules are written into the expression, so they are meant to be a list
    that people keep: hundreds, not millions.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        host_fits = (host == rule.host) | host.endswith("." + rule.host)
        fits = host_fits & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def templates(labelled: DataFrame, scratch: Scratch, *, depth: int = DEPTH, merge_z: float = MERGE_Z, smoothing: float = SMOOTHING) -> DataFrame:
    """Template and purity of each (host, shape) of ``labelled``, which has host, shape, good and bad.

    ``shape`` is the path with numbers generalised; see :func:`shape_of`.
    """
    segments = F.split(F.col("shape"), "/")
    # One segment per level; what lies deeper stays together in the last.
    level = lambda d: F.when(F.size(segments) > d, F.array_join(F.slice(segments, d + 1, 1 if d < depth else 1_000_000), "/"))
    tree = scratch.table(labelled.withColumn("prefix", F.lit("")))
    deepest = tree.agg(F.max(F.size(segments))).first()[0] or 0
    for d in range(1, min(depth, deepest - 1) + 1):
        tree = tree.withColumn("seg", level(d))
        child = tree.where("seg IS NOT NULL").groupBy("host", "prefix", "seg").agg(F.sum("good").alias("cg"), F.sum("bad").alias("cb"))
        node = child.groupBy("host", "prefix").agg(F.sum("cg").alias("pg"), F.sum("cb").alias("pb"), F.count("*").alias("values"))
        own, rate = F.col("cg") + F.col("cb"), F.col("pb") / F.nullif(F.col("pg") + F.col("pb"), F.lit(0))
        beyond = (merge_z + F.sqrt(2 * F.ln("values"))) * F.sqrt(rate * (1 - rate) / own)
        apart = (own >= MIN_LABELS) & (F.abs(F.col("cb") / own - rate) - 0.5 / own > beyond)
        literal = scratch.table(child.join(node, ["host", "prefix"]).where(apart).select("host", "prefix", "seg", "cg", "cb", F.least(F.floor(F.col("cb") / own * BINS), F.lit(BINS - 1)).alias("bin")))
        classes = literal.groupBy("host", "prefix", "bin").agg(F.sum("cb").alias("b"), F.sum(own).alias("n"), F.count("*").alias("segs"))
        siblings = Window.partitionBy("host", "prefix").orderBy("bin")
        before, of = F.lag("b").over(siblings), F.lag("n").over(siblings)
        both = (F.col("b") + before) / (F.col("n") + of)
        unlike = F.abs(F.col("b") / F.col("n") - before / of) > merge_z * F.sqrt(both * (1 - both) * (1 / F.col("n") + 1 / of))
        branch = F.sum(F.when(unlike, 1).otherwise(0)).over(siblings) + 1
        members = F.sum("segs").over(Window.partitionBy("host", "prefix", "branch"))
        classes = classes.withColumn("branch", branch).withColumn("members", members).select("host", "prefix", "bin", "branch", "members")
        name = F.when(F.col("members") == 1, F.col("seg")).otherwise(F.concat(F.lit("*"), F.col("branch").cast("string")))
        kept = literal.join(classes, ["host", "prefix", "bin"]).select(F.col("host").alias("k_host"), F.col("prefix").alias("k_prefix"), F.col("seg").alias("k_seg"), name.alias("k_name"))
        tree = tree.join(kept, (F.col("host") == F.col("k_host")) & (F.col("prefix") == F.col("k_prefix")) & (F.col("seg") == F.col("k_seg")), "left")
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("k_name", F.lit("*"))))
        # A written level keeps the plan of the next from holding this one twice.
        tree = scratch.table(tree.withColumn("prefix", F.concat("prefix", step)).drop("seg", "k_host", "k_prefix", "k_seg", "k_name"))
    tree = tree.withColumnRenamed("prefix", "template")
    leaf = tree.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"))
    hosts = leaf.groupBy("host").agg(F.sum("tg").alias("hg"), F.sum("tb").alias("hb"))
    overall = leaf.agg(F.sum("tg").alias("og"), F.sum("tb").alias("ob"))
    prior = (F.coalesce(F.col("og"), F.lit(0)) + 1) / (F.coalesce(F.col("og") + F.col("ob"), F.lit(0)) + 2)
    host_rate = (F.col("hg") + smoothing * prior) / (F.col("hg") + F.col("hb") + smoothing)
    purity = (F.col("tg") + smoothing * host_rate) / (F.col("tg") + F.col("tb") + smoothing)
    judged = leaf.join(hosts, "host").join(F.broadcast(overall)).select(F.col("host").alias("j_host"), F.col("template").alias("j_template"), purity.alias("purity"))  # overall: one row
    return tree.join(judged, (F.col("host") == F.col("j_host")) & (F.col("template") == F.col("j_template"))).drop("j_host", "j_template")


def shape_of(path: Column) -> Column:
    """The path with long hexadecimal marks and other digits generalised; a star is written as in a url's code."""
    marks = "(?<![0-9A-Za-z])(?=[0-9-]*[a-fA-F])(?=[a-fA-F-]*[0-9])[0-9a-fA-F]{8}[0-9a-fA-F-]*(?![0-9A-Za-z])"
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("*"), F.lit("%2A")), marks, "<x>"), "[0-9]+", "<n>")


def judge(urls: DataFrame, rules: list[Rule], *, bad: Column | None = None, url_col: str = "url", min_purity: float = MIN_PURITY, depth: int = DEPTH, merge_z: float = MERGE_Z, smoothing: float = SMOOTHING) -> DataFrame:
    """``urls`` with host, path, template, purity, rule and verdict.

    ``bad`` is true or false where a url is labelled, else null; without it no
    template is rejected.
    """
    ensure_columns(urls, url_col)
    made = ["host", "path", "template", "purity", "rule", "verdict"]
    url = F.col(quoted(url_col)).cast("string")
    bad = F.lit(None).cast("boolean") if bad is None else bad
    rows = urls.withColumns({"_url_bad": bad, "_url_host": host_of(url), "_url_path": path_of(url)}).withColumn("_url_shape", shape_of(F.col("_url_path")))
    counts = rows.groupBy(F.col("_url_host").alias("host"), F.col("_url_shape").alias("shape")).agg(
        F.count(F.when(~F.col("_url_bad"), 1)).alias("good"), F.count(F.when(F.col("_url_bad"), 1)).alias("bad")
    )
    with Scratch(urls.sparkSession, "urls") as scratch:
        tree = templates(counts, scratch, depth=depth, merge_z=merge_z, smoothing=smoothing)
        tree = scratch.keep(tree.select(F.col("host").alias("_t_host"), F.col("shape").alias("_t_shape"), F.col("template").alias("_t_template"), F.col("purity").alias("_t_purity")))
    rule, verdict = rule_for(F.col("_url_host"), F.col("_url_path"), rules)
    by_template = F.when(F.col("_t_purity") < min_purity, "block").otherwise("allow")
    own = [F.col(quoted(c)) for c in urls.columns if c not in made]
    return rows.join(tree, (F.col("_url_host") == F.col("_t_host")) & (F.col("_url_shape") == F.col("_t_shape")), "left").select(
        *own,
        F.col("_url_host").alias("host"),
        F.col("_url_path").alias("path"),
        F.col("_t_template").alias("template"),
        F.col("_t_purity").alias("purity"),
        rule.alias("rule"),
        F.coalesce(verdict, by_template).alias("verdict"),
    )
