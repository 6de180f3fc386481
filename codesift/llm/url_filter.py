"""URL filter: rules first, then a tree of path templates per host, judged by the purity of its labelled urls.

A url's path becomes a sequence of segments. Lexical classes (numbers, hexadecimal ids, with their endings) are wildcards
from the start. Going down level by level, a node with many children turns its rare children into a wildcard, and children
that are statistically alike (the same kinds of children below, labelled rates that do not differ significantly from their
pool's) are merged into one branch. Children without labels join a pool of the same kinds that several labelled ones
vouch for, and are judged with it. A template is a whole path of such tokens in a host's tree. It is rejected if its
own labelled urls are bad beyond doubt: the smoothed share of bad ones reaches the threshold. The prior is the overall
share, but never more than even, and a template without labelled urls has no purity: what is bad elsewhere rejects nothing.

Everything is counting by node with partial aggregation, over distinct (host, lexical path) rows; a host's tree is spread
over the tasks by node, so that a host with a third of all urls is no single group. Branching levels are handled one after
another until no path is longer: tokens that all paths of a node share are passed in one step, and a path that is alone in
its node is not followed further, as nothing below can change it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import LOWER, UPPER, stored
from codesift.session import new_table_path


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains, on urls whose path starts with ``path``; the longest rule wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Trees:
    """How trees are grown and judged."""

    many: int = 24  # children of a node from which rare ones become a wildcard
    rare: float = 0.05  # share of a node's urls up to which a child is rare
    vouchers: int = 5  # labelled branches of a pool from which branches without labels join it
    alike: float = 2.0  # standard errors up to which a child's labelled rate is that of its pool
    prior: float = 4.0  # urls that the overall share, at most one half, counts as
    reject: float = 0.8  # smoothed share of bad urls from which a template is rejected


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash, A to Z lowered; else empty."""
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """A struct (rule, verdict) of the longest matching rule, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda rule: (len(rule.name), rule.name)):
        own = (host == rule.host) | host.endswith(f".{rule.host}")
        made = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(own & path.startswith(rule.path), made).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Segments after the first slash, with numbers and ids generalised: ``<n>``, ``<h>``, ``<n>.html``."""

    def lexical(part: Column) -> Column:
        stem, ending = F.regexp_extract(part, r"^([^.]*)", 1), F.regexp_extract(part, r"^[^.]*(.*)$", 1)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), "<n>")
            .when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "<h>")
            .otherwise(stem)
        )
        return F.concat(kind, ending)

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lexical)


def templates(counts: DataFrame, how: Trees) -> DataFrame:
    """``counts`` (host, parts, n, good, bad; distinct host and parts) with the template of each row."""
    spark = counts.sparkSession
    target = new_table_path(spark, "url-levels")
    rows = counts.withColumn("node", F.lit("")).withColumn("left", F.col("parts"))
    level = 0
    while True:
        rows = _down_chains(rows)
        token = F.get("left", F.lit(0))
        rows = rows.withColumn("token", token).withColumn("below", _kind(F.get("left", F.lit(1))))
        children = rows.groupBy("host", "node", "token").agg(
            F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"),
            F.array_sort(F.collect_set("below")).alias("kinds"),  # a handful of kinds
            F.count(F.lit(1)).alias("paths"),
        )
        nodes = children.groupBy("host", "node").agg(
            F.sum("n").alias("all"), F.count(F.lit(1)).alias("children"), F.sum("paths").alias("paths")
        )
        children = children.drop("paths").join(nodes, ["host", "node"]).withColumn(
            "branch",
            F.when((F.col("children") >= how.many) & (F.col("n") <= how.rare * F.col("all")), "*").otherwise(F.col("token")),
        )
        branches = children.groupBy("host", "node", "branch").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("kinds").alias("kinds"),
        )
        pools = branches.filter("good + bad > 0").groupBy("host", "node", "kinds").agg(
            (F.sum("bad") / F.sum(F.col("good") + F.col("bad"))).alias("rate"), F.count(F.lit(1)).alias("members"),
        )
        seen = F.col("good") + F.col("bad")
        error = F.sqrt(seen * F.col("rate") * (1 - F.col("rate")))
        # A branch without labels differs from no rate; it needs more branches that vouch for it.
        vouched = F.col("members") >= F.when(seen > 0, 2).otherwise(how.vouchers)
        alike = vouched & (F.abs(F.col("bad") - seen * F.col("rate")) <= how.alike * error)
        merged = branches.join(pools, ["host", "node", "kinds"]).filter(alike).select(
            "host", "node", "branch", F.concat(F.lit("+"), F.array_join("kinds", "|")).alias("pool")
        )
        named = children.select("host", "node", "token", "branch", "paths").join(merged, ["host", "node", "branch"], "left").select(
            "host", "node", "token", F.coalesce("pool", "branch").alias("name"), "paths"
        )
        alone = F.col("paths") == 1
        rest = F.array_join(F.slice("left", F.lit(2), F.size("left")), "/")
        longer = F.size("left") > 1
        rows.join(named, ["host", "node", "token"]).withColumn(
            "node", F.concat("node", F.lit("/"), "name", F.when(alone & longer, F.concat(F.lit("/"), rest)).otherwise(""))
        ).withColumn("done", alone | ~longer).withColumn("left", F.slice("left", F.lit(2), F.size("left"))).drop(
            "token", "below", "name", "paths"
        ).write.parquet(f"{target}/{level}")
        rows = spark.read.parquet(f"{target}/{level}").filter("NOT done").drop("done")
        level += 1
        if rows.isEmpty():
            break
    placed = spark.read.parquet(*(f"{target}/{number}" for number in range(level)))
    return placed.filter("done").drop("done", "left").withColumnRenamed("node", "template")


def _down_chains(rows: DataFrame) -> DataFrame:
    """Rows moved down past the tokens that all paths of their node share, but for the last of the shortest.

    A node with one child neither makes a wildcard nor merges anything, so a chain of such nodes is one step, however
    long. The first and the last path in order share what all share.
    """
    ends = rows.groupBy("host", "node").agg(
        F.min("left").alias("first"), F.max("left").alias("last"), F.min(F.size("left")).alias("shortest")
    )
    same = F.zip_with("first", "last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    until = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1
    chains = ends.select(
        "host", "node", F.least(until, F.col("shortest") - 1).cast("int").alias("skipped")
    ).filter("skipped > 0")
    passed = F.array_join(F.slice("left", F.lit(1), F.col("skipped")), "/")
    found = F.col("skipped").isNotNull()
    return rows.join(chains, ["host", "node"], "left").select(
        "host", "parts", "n", "good", "bad",
        F.when(found, F.concat("node", F.lit("/"), passed)).otherwise(F.col("node")).alias("node"),
        F.when(found, F.slice("left", F.col("skipped") + 1, F.size("left"))).otherwise(F.col("left")).alias("left"),
    )


def _kind(token: Column) -> Column:
    """Kind of a segment: a leaf's end, a wildcard as it is, or a word."""
    return F.when(token.isNull(), "end").when(token == "", "slash").when(token.startswith("<"), token).otherwise("word")


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url",
    labelled: DataFrame | None = None, how: Trees | None = None,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template and purity.

    The longest rule decides where one fits; elsewhere the url's template does: ``block`` if it has labelled urls and their
    smoothed purity reaches the limit, else ``allow``. Purity is null for a template without labelled urls. ``labelled``
    has columns url and bad (0 or 1); without it, the urls that rules decide are the labels. A null url, or one without
    ``://``, has an empty host and path, fits no rule and is allowed unless its own (empty) template is rejected. Ids may
    be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    how, rules = how or Trees(), list(rules)
    url = F.col(url_col)
    judged = (
        pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
        .select("_id", "host", "path", "found.*").withColumn("parts", segments(F.col("path")))
    )
    nothing = F.lit(0).cast("long")
    if labelled is None:
        rated = judged.select(
            "host", "parts", F.lit(1).cast("long").alias("n"),
            F.coalesce((F.col("verdict") == "allow").cast("long"), nothing).alias("good"),
            F.coalesce((F.col("verdict") == "block").cast("long"), nothing).alias("bad"),
        )
    else:
        place = labelled.select(host_of(F.col("url")).alias("host"), segments(path_of(F.col("url"))).alias("parts"), "bad")
        rated = judged.select("host", "parts", F.lit(1).cast("long").alias("n"), nothing.alias("good"), nothing.alias("bad"))
        rated = rated.unionByName(place.select(
            "host", "parts", nothing.alias("n"), F.coalesce((F.col("bad") == 0).cast("long"), nothing).alias("good"),
            F.coalesce((F.col("bad") > 0).cast("long"), nothing).alias("bad"),
        ))
    counts = stored(
        rated.groupBy("host", "parts").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")),
        "url-counts",
    )
    totals = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seen = (totals["good"] or 0) + (totals["bad"] or 0)
    share = (totals["bad"] or 0) / seen if seen else 0.0
    placed = templates(counts, how)
    labels, prior = F.sum(F.col("good") + F.col("bad")), how.prior * min(share, 0.5)
    purity = placed.groupBy("host", "template").agg(
        F.when(labels > 0, (F.sum("bad") + prior) / (labels + how.prior)).alias("purity")
    )
    verdicts = placed.select("host", "parts", "template").join(purity, ["host", "template"])
    ruled = judged.filter("rule IS NOT NULL").drop("parts").select(
        "*", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")
    )
    free = judged.filter("rule IS NULL").join(verdicts, ["host", "parts"], "left").select(
        "_id", "host", "path", "rule",
        F.when(F.col("purity") >= how.reject, "block").otherwise("allow").alias("verdict"), "template", "purity",
    )
    return ruled.unionByName(free).withColumnRenamed("_id", id_col)
