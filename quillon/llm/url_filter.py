"""URL filter by a tree of path templates.

Every url falls under a template of its host: digits of a path become ``{n}``, segments that vary too much to be names
become ``*``, and sibling branches whose labelled pages look alike are merged.  A template whose labelled pages are nearly all
bad is rejected with all its unlabelled pages.  Its purity is smoothed by that of its parent branch on the host, that by
the same template's on all hosts, and that by a prior; so a template without labels of its own is judged by those that it
falls back on, and allowed where they are too few.  Explicit rules come first; the pages that they decide are the labels.

The tree is built from one row per (host, digit-free path) with counts, so its size follows the templates, not the pages;
each aggregation starts with a partial one, so a host with a third of all pages costs no single task its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import UPPER, checkpointed


@dataclass(frozen=True)
class Rule:
    action: str
    text: str  # host, then the start of a path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        head, slash, tail = self.text.partition("/")
        return slash + tail


@dataclass(frozen=True)
class TreeSettings:
    variable_values: int = 16  # a position with fewer distinct names holds names
    variable_share: float = 0.5  # distinct names per page from which on a position is variable
    merge_depth: int = 4  # positions, counted from the root, at which siblings may be merged
    similar: float = 3.84  # chi-square that the bad shares of two branches may differ by
    min_labelled: int = 3  # labelled pages that a branch needs to be compared, and that a rejection needs, fallbacks included
    min_hosts: int = 2  # hosts with labels of a template that tell something about it on others
    prior_bad: float = 0.5
    prior_weight: float = 4.0
    reject_at: float = 0.8


MAX_RULES = 2000


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path.  A url that is null or lacks ``://`` has both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(F.col("#rest"), r"^[^/?#]*", 0)
    return (
        pages.withColumn("#rest", rest)
        .withColumn("#raw", raw)
        .withColumn("host", F.translate("#raw", UPPER, UPPER.lower()))
        .withColumn("path", F.regexp_extract(F.expr("substring(`#rest`, length(`#raw`) + 1)"), r"^[^?#]*", 0))
        .drop("#rest", "#raw")
    )


def rule_column(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, action) of the longest fitting rule, else null.  Rules of one length: the one given first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join them as a table instead")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings(), url: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict, template.

    Any row gets a verdict: repeated rows the same one, null or malformed urls that of the empty host's empty path.
    Columns of pages named like an added one are replaced.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template")]
    parsed = with_host_and_path(pages.select(*own), url)
    judged = parsed.withColumn("#rule", rule_column(rules, F.col("host"), F.col("path"))).withColumn("#shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    verdicts = template_verdicts(judged.select("host", F.col("#shape").alias("_shape"), F.col("#rule.action").alias("action")), settings)
    found = verdicts.select(F.col("host").alias("#host"), F.col("_shape").alias("#of"), F.col("template").alias("#template"), F.col("rejected").alias("#rejected"))
    verdict = F.coalesce(F.col("#rule.action"), F.when(F.col("#rejected"), "block").otherwise("allow"))
    joined = judged.join(found, (F.col("host") == F.col("#host")) & (F.col("#shape") == F.col("#of")), "left")
    return joined.select(*own, "host", "path", F.col("#rule.rule").alias("rule"), verdict.alias("verdict"), F.col("#template").alias("template"))


def template_verdicts(judged: DataFrame, s: TreeSettings) -> DataFrame:
    """One row per (host, _shape): its template in the final tree and whether that is rejected."""
    shapes = judged.groupBy("host", "_shape").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("action") == "block").alias("bad"),
        F.count_if(F.col("action").isNotNull()).alias("labelled"),
    )
    parts = checkpointed(shapes).withColumn("segs", F.split("_shape", "/"))
    steps = parts.select("host", "n", F.posexplode("segs").alias("depth", "seg"))
    variable = (
        steps.groupBy("host", "depth", "seg").agg(F.sum("n").alias("n"))
        .groupBy("host", "depth").agg(F.count("*").alias("names"), F.sum("n").alias("n"))
        .filter((F.col("names") >= s.variable_values) & (F.col("names") >= s.variable_share * F.col("n")))
        .groupBy("host").agg(F.collect_set("depth").alias("vary"))
    )
    tree = parts.join(variable, "host", "left").withColumn(
        "template", F.transform("segs", lambda g, i: F.when(F.coalesce(F.array_contains("vary", i), F.lit(False)), F.lit("*")).otherwise(g))
    )
    tree = checkpointed(tree.select("host", "_shape", F.col("template").alias("plain"), "template", "bad", "labelled"))
    for depth in range(s.merge_depth, 0, -1):
        tree = checkpointed(merge_similar(tree, depth, s))  # read more than once below
    sums = lambda *by: tree.groupBy(*by).agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k"))
    parent = F.slice("template", 1, F.size("template") - 1)
    own = checkpointed(sums("host", "template").withColumn("parent", parent))
    branches = own.groupBy("host", "parent").agg(F.sum("b").alias("pb"), F.sum("k").alias("pk"))
    # by the template before merges, whose names other hosts share; a template that many hosts have is summed in part first
    alike = sums("plain", "host").groupBy("plain").agg(F.sum("b").alias("gb"), F.sum("k").alias("gk"), F.count_if(F.col("k") > 0).alias("told"))
    known = tree.select("host", "_shape", "plain", "template").join(own.join(branches, ["host", "parent"]), ["host", "template"]).join(alike, "plain")
    w = F.lit(float(s.prior_weight))
    anywhere = (F.col("gb") + w * s.prior_bad) / (F.col("gk") + w)
    near = (F.col("pb") + w * anywhere) / (F.col("pk") + w)
    purity = (F.col("b") + w * near) / (F.col("k") + w)
    enough = (F.greatest("k", "pk") >= s.min_labelled) | (F.col("gk") >= s.min_labelled) & (F.col("told") >= s.min_hosts)
    return known.select("host", "_shape", F.array_join("template", "/").alias("template"), (enough & (purity >= s.reject_at)).alias("rejected"))


def merge_similar(tree: DataFrame, depth: int, s: TreeSettings) -> DataFrame:
    """Merges siblings at one position: each branch with enough labels whose bad share is like the family's, and, apart
    from them, the branches without any label (nothing tells those from one another)."""
    deep = F.size("template") > depth
    family = F.transform("template", lambda g, i: F.when(i == depth, F.lit("*")).otherwise(g))
    nodes = tree.filter(deep).groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k")).withColumn("family", family)
    sums = nodes.groupBy("host", "family").agg(F.sum("b").alias("fb"), F.sum("k").alias("fk"), F.count_if(F.col("k") >= s.min_labelled).alias("seen"), F.count_if(F.col("k") == 0).alias("blank"))
    rest_b, rest_k = F.col("fb") - F.col("b"), F.col("fk") - F.col("k")
    share = F.col("fb") / F.greatest(F.col("fk"), F.lit(1))
    gap = F.col("b") / F.greatest(F.col("k"), F.lit(1)) - rest_b / F.greatest(rest_k, F.lit(1))
    noise = share * (1 - share) * (1 / F.greatest(F.col("k"), F.lit(1)) + 1 / F.greatest(rest_k, F.lit(1)))
    like = (F.col("k") >= s.min_labelled) & (rest_k >= s.min_labelled) & (F.col("seen") > 1) & (gap * gap <= s.similar * noise)
    merged = nodes.join(sums, ["host", "family"]).withColumn(
        "becomes",
        F.when(like, F.col("family")).when((F.col("k") == 0) & (F.col("blank") > 1), F.transform("family", lambda g, i: F.when(i == depth, F.lit("*?")).otherwise(g))).otherwise(F.col("template")),
    )
    return (
        tree.join(merged.select("host", "template", "becomes"), ["host", "template"], "left")
        .select("host", "_shape", "plain", F.coalesce("becomes", "template").alias("template"), "bad", "labelled")
    )
