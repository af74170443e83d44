"""URL filter: per host, a tree of path templates judged by smoothed labelled purity.

DataFrame operations only. Level by level, a node's children become one wildcard if they vary
too much, and else siblings whose labelled purity can't be told apart are merged into one
branch. Rules label the urls they fit; a template is blocked if the smoothed share of blocked
labels below it reaches a cut. Levels work on counts per distinct path, never on single urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.words import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the first by code point."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, slash, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + below)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule, verdict


def smoothed(bad: Column, seen: Column, prior: Column, mass: float) -> Column:
    return (bad + mass * prior) / (seen + mass)


def templates(paths: DataFrame, levels: int = 8, most_children: int = 16, mass: float = 2.0, z: float = 1.0) -> DataFrame:
    """(host, path, template) of the distinct paths (host, path, n, seen, bad).

    A node varies if it has more than `most_children` different children, or at least four whose
    visits are on average below two; a segment of digits (with or without an ending) is variable
    by its form. Siblings are ordered by smoothed purity; a gap of more than z standard errors
    starts a new branch. What lies more than `levels` deep is one last segment.
    """
    prior = paths.agg(((F.sum("bad") + 1) / (F.sum("seen") + 2)).alias("p")).head()[0]
    prior = F.lit(0.5 if prior is None else float(prior))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", levels)
    form = F.transform(parts, lambda s: F.when(s.rlike("^[0-9]+([.][A-Za-z0-9]+)?$"), F.lit("*")).otherwise(s))
    rows = settle(paths.select("host", "path", "n", "seen", "bad", form.alias("parts"), F.lit("").alias("at")))
    depth = rows.agg(F.max(F.size("parts"))).head()[0] or 0
    for level in range(depth):
        rows = rows.withColumn("part", F.get("parts", F.lit(level)))
        child = rows.where("part is not null").groupBy("host", "at", "part").agg(*[F.sum(c).alias(c) for c in ("n", "seen", "bad")])
        child = settle(child)
        node = child.groupBy("host", "at").agg(F.count("*").alias("k"), F.sum("n").alias("visits")).select(
            "host", "at", ((F.col("k") > most_children) | ((F.col("k") >= 4) & (F.col("visits") < 2 * F.col("k")))).alias("varies"))
        child = child.join(node, ["host", "at"]).where("not varies").withColumn("p", smoothed(F.col("bad"), F.col("seen"), prior, mass))
        child = child.withColumn("v", F.col("p") * (1 - F.col("p")) / (F.col("seen") + mass)).withColumn("wild", F.col("part") == "*")
        # At most `most_children` rows in a window.
        order = Window.partitionBy("host", "at").orderBy("wild", "p", "part")
        gap = (F.col("p") - F.lag("p").over(order) > z * F.sqrt(F.col("v") + F.lag("v").over(order))) | (F.col("wild") != F.lag("wild").over(order))
        child = child.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("branch", F.sum("gap").over(order))
        names = Window.partitionBy("host", "at", "branch")
        named = child.select("host", "at", "part", F.array_join(F.array_sort(F.collect_set("part").over(names)), "|").alias("name"))
        rows = rows.join(node, ["host", "at"], "left").join(named, ["host", "at", "part"], "left")
        step = F.when(F.col("part").isNull(), F.col("at")).otherwise(F.concat(
            "at", F.lit("/"), F.when(F.col("varies"), F.lit("*")).otherwise(F.col("name"))))
        rows = settle(rows.select("host", "path", "n", "seen", "bad", "parts", step.alias("at")))
    return rows.select("host", "path", "n", "seen", "bad", F.col("at").alias("template"))


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]], cut: float = 0.5, mass: float = 2.0, levels: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its smoothed blocked share for every page.

    A null url, or one without ://, has an empty host and path; these form a host of their own.
    Repeated rows and null ids are judged like others; templates count every row. An empty table
    gives no rows. Other columns are not read.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = settle(urls.withColumn("rule", rule).withColumn("says", says))
    paths = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("says").alias("seen"), F.count_if(F.col("says") == "block").alias("bad"))
    tree = settle(templates(paths, levels=levels, mass=mass))
    host = tree.groupBy("host").agg(F.sum("seen").alias("host_seen"), F.sum("bad").alias("host_bad"))
    whole = F.lit(tree.agg(F.coalesce((F.sum("bad") + 1) / (F.sum("seen") + 2), F.lit(0.5))).head()[0])
    judged = tree.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).join(host, "host").select(
        "host", "template", smoothed(F.col("bad"), F.col("seen"), smoothed(F.col("host_bad"), F.col("host_seen"), whole, mass), mass).alias("blocked_share"))
    by_path = tree.join(judged, ["host", "template"]).select("host", "path", "template", "blocked_share")
    return urls.join(by_path, ["host", "path"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("blocked_share") >= cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "blocked_share")
