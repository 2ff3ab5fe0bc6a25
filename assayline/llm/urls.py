"""URL filters: given rules first, then a tree of path templates with labelled purity.

Every url has a host and a path. Segments that hold a digit, and segments at a place where a
host has very many different ones, become wildcards, so that a host's paths form a small
tree of templates. The rules' verdicts are the labels. Templates of one host and one shape
whose share of blocked labels does not differ significantly are merged into one branch. The
share of a branch is smoothed towards that of the same templates on all hosts, which is
smoothed towards the share of all labels; branches at or above a limit are blocked.

DataFrame functions only. Defined results: a NULL url, or one without ``://``, has an empty
host and path and is judged like any other; equal rows get equal results, once per row;
without any label nothing is blocked; paths of any length are judged by their first segments; an empty table gives an
empty one. Extra columns pass through, whatever their names; an added column takes the place of one of its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import given_back, number_of, numbered
from assayline.session import write_through

# Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

DEPTH = 6  # segments that stand for themselves in a template; the others become one
MANY = 10  # different segments at one place from which on it may be a variable one
WEIGHT = 10  # labels that the smoothing counts as
LIMIT = 0.8  # share of blocked labels at which a branch is blocked
Z = 1.96  # standard errors from which on a template is a branch of its own

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; NULL where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


ADDED = ("host", "path", "rule", "verdict", "template", "purity")


def segments(path: Column) -> Column:
    """Segments of a path with wildcards for those that hold a digit; at most ``DEPTH`` and a rest."""
    def general(s: Column) -> Column:
        return F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, "[.][A-Za-z]{1,5}$", 0))).otherwise(s)

    found = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)
    return F.when(F.size(found) > DEPTH, F.concat(F.slice(found, 1, DEPTH), F.array(F.lit("**")))).otherwise(found)


def classify(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict, template and purity (share of blocked labels of the branch)."""
    own = F.coalesce(F.col(number_of(pages, url)), F.lit(""))
    rows = numbered(pages).withColumns({"host": host_of(own), "path": path_of(own)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict, "shape": F.array_join(segments(F.col("path")), "/")})
    judged = branches(rows.select("host", "shape", "given"))
    judged = write_through(judged, "judged")
    found = rows.join(judged.withColumnsRenamed({"host": "h", "shape": "s"}), (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    method = F.when(F.col("purity") >= LIMIT, "block").otherwise("allow")
    found = found.withColumn("verdict", F.coalesce("given", method))
    return given_back(found, pages.columns, ADDED)


def branches(rows: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, given): one row per host and shape.

    Rows are counted per host and shape before anything is joined, so a host that holds a
    large part of all pages is a few rows from there on.
    """
    counted = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("given").alias("labels"), F.count_if(F.col("given") == "block").alias("blocked")
    )
    # Places of a host's tree at which nearly every path differs are variable.
    parts = counted.select("host", "shape", "n", F.split("shape", "/").alias("parts"))
    placed = parts.select("host", "shape", "n", "parts", F.posexplode("parts").alias("at", "part"))
    placed = placed.withColumn("before", F.array_join(F.slice("parts", 1, F.col("at")), "/"))
    children = placed.groupBy("host", "before", "at", "part").agg(F.sum("n").alias("n"))
    variable = children.groupBy("host", "before", "at").agg(F.count("*").alias("different"), F.sum("n").alias("all"))
    variable = variable.where((F.col("different") >= MANY) & (F.col("different") * 2 > F.col("all"))).select("host", "before", "at", F.lit(True).alias("is_variable"))
    # A plain table on this side lets Spark split the join at a host that holds very many paths.
    variable = write_through(variable, "variable")
    general = placed.join(variable, ["host", "before", "at"], "left").withColumn("part", F.when(F.col("is_variable") & ~F.col("part").startswith("*"), "*").otherwise(F.col("part")))
    shaped = general.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    shaped = shaped.select("host", "shape", F.transform("p", lambda x: x["part"]).alias("p"))
    shaped = shaped.select("host", "shape", F.array_join("p", "/").alias("template"), F.array_join(F.transform("p", lambda x: F.when(x.startswith("*"), x).otherwise("?")), "/").alias("form"))
    nodes = counted.join(shaped, ["host", "shape"]).groupBy("host", "template", "form").agg(*[F.sum(c).alias(c) for c in ("n", "labels", "blocked")])
    labels, blocked = nodes.agg(F.sum("labels"), F.sum("blocked")).first()
    share = blocked / labels if labels else 0.0
    anywhere = nodes.groupBy("template").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
    anywhere = anywhere.select("template", ((F.col("b") + WEIGHT * share) / (F.col("l") + WEIGHT)).alias("prior"))
    nodes = nodes.join(anywhere, "template").withColumns({"l": F.col("labels") + WEIGHT, "b": F.col("blocked") + WEIGHT * F.col("prior")})
    pooled = nodes.groupBy("host", "form").agg(F.round(F.sum("b") / F.sum("l"), 9).alias("p"))
    tested = nodes.join(pooled, ["host", "form"])
    differs = F.abs(F.col("b") / F.col("l") - F.col("p")) > Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("l"))
    tested = tested.withColumn("branch", F.when(differs, F.col("template")).otherwise(F.concat(F.col("form"), F.lit("~"))))
    purity = tested.groupBy("host", "form", "branch").agg(F.round(F.sum("b") / F.sum("l"), 6).alias("purity"))
    named = tested.select("host", "template", "form", "branch").join(purity, ["host", "form", "branch"]).select("host", "template", "purity")
    return shaped.select("host", "shape", "template").join(named, ["host", "template"]).select("host", "shape", "template", "purity")
