"""URL filters by a tree of path templates, in SQL functions only.

A url's path is a list of segments. Level by level, per host and template so far, a
segment stays literal only if it has enough rows, is not a number, and its
share of bad labels differs from that of all siblings together; every other segment
becomes a wildcard, so variable parts and statistically similar branches merge. A
template is rejected when its smoothed share of bad labels is too high: shares are
pulled towards the host's, and the host's towards that of all urls.

Fixed rules come first: the longest that fits decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from latticework.llm.tables import stored

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = (  # (verdict, host and path prefix)
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


@dataclass(frozen=True)
class Settings:
    """`support`: least rows of a literal segment. `z`: standard errors from which branches
    differ. `strength`: pseudo-labels of the smoothing. `reject`: share of bad labels.
    `levels`, `share`: bounds of the oracle text only, equal to none on paths of at most six
    segments and at most fifty siblings of like size; the operator has neither."""

    levels: int = 6
    support: int = 5
    share: float = 0.02
    z: float = 2.5
    strength: float = 20.0
    reject: float = 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), A_TO_Z, A_TO_Z.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the host or a domain above it and the path; else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _segments(path: Column) -> Column:
    """Segments after the first slash."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def with_templates(urls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`urls` (host, path, bad: 0, 1 or null) with `template`, a path with * for variable segments."""
    now = urls.withColumn("_parts", _segments(F.col("path"))).withColumn("template", F.lit(""))
    now = stored(now, "paths")
    # deeper than this no host has enough rows for a literal segment, so all others there are wildcards
    sizes = now.groupBy("host", F.size("_parts").alias("size")).agg(F.count("*").alias("n"))
    deeper = sizes.select("size", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size"))).alias("n"))
    depth = deeper.filter(F.col("n") >= settings.support).agg(F.max("size")).first()[0] or 0
    for level in range(depth):
        has = F.size("_parts") > level
        now = now.withColumn("_part", F.when(has, F.col("_parts")[level]))
        counted = now.filter(has).groupBy("host", "template", "_part").agg(
            F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad")
        )
        every = counted.groupBy("host", "template").agg(
            F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
        )
        rate = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        apart = F.abs(F.col("bad") - rate * F.col("labelled")) >= settings.z * F.sqrt(rate * (1 - rate) * F.col("labelled"))
        literal = (
            counted.filter((F.col("n") >= settings.support) & (F.col("labelled") > 0) & ~F.rlike("_part", F.lit("^[0-9]+(\\.[a-z]+)?$")))
            .join(every, ["host", "template"]).filter(apart)
            .select("host", "template", "_part", F.lit(True).alias("_literal"))
        )
        step = F.when(F.col("_literal"), F.col("_part")).otherwise(F.lit("*"))
        now = now.join(literal, ["host", "template", "_part"], "left").withColumn(
            "template", F.when(has, F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))
        ).drop("_literal")
        now = stored(now, "paths")  # the next level reads it several times
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("_parts") - depth, F.lit(0)))
    return now.withColumn("template", F.concat("template", rest)).drop("_parts", "_part")


def judged(urls: DataFrame, settings: Settings = Settings(), rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`urls` (url, bad: 1 for unwanted, 0 for wanted, null for unlabelled; other columns stay) with
    host, path, template, bad_share, rule and verdict.

    A null url or one without `://` has an empty host and path and is judged among those.
    Columns of these names in the input are replaced.
    """
    added = ("host", "path", "template", "bad_share", "rule", "verdict")
    urls = urls.drop(*added).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    placed = with_templates(urls, settings)
    sums = placed.groupBy("host", "template").agg(F.count("bad").alias("_n"), F.sum(F.coalesce("bad", F.lit(0))).alias("_k"))
    hosts = sums.groupBy("host").agg(F.sum("_n").alias("_host_n"), F.sum("_k").alias("_host_k"))
    total = hosts.agg((F.sum("_host_k") + 1) / (F.sum("_host_n") + 2)).first()[0]
    s = F.lit(settings.strength)
    of_host = (F.col("_host_k") + s * F.lit(0.5 if total is None else total)) / (F.col("_host_n") + s)
    shares = sums.join(hosts, "host").select("host", "template", ((F.col("_k") + s * of_host) / (F.col("_n") + s)).alias("bad_share"))
    text, says = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= settings.reject, F.lit("block")).otherwise(F.lit("allow"))
    return placed.join(shares, ["host", "template"]).withColumn("rule", text).withColumn("verdict", F.coalesce(says, own))


def document_of(path: Column) -> Column:
    """Number of the document that a page shows: the last number of its path; null without one."""
    return F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")
