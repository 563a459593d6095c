"""URL filter: rules first, then a tree of path templates per host, learnt from the urls that the rules decide.

Variable segments become wildcards: runs of digits by their form, all names of a node with too many of them at once.
Sibling branches whose pages do not differ statistically are merged. A template is rejected if its smoothed share of
pages that a rule blocks is high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import stage

# (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its own. The list becomes one
# expression, so it is a short one.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# A node with more names than this has one wildcard instead.
WIDE = 16
# Segments beyond this depth are one last wildcard of a template.
DEPTH = 8
# Standard normal bound of the test of likeness: branches that differ by less are merged.
ALIKE = 1.645
# A host's share of blocked pages weighs as much as so many pages of a template, and all hosts' share as much in a host's.
SMOOTHING = 4.0
REJECT = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Kinds of pages below a branch: blocked, allowed or undecided by a rule, times ending at the branch or going deeper.
_KINDS = [f"{verdict} and {place}" for verdict in ("verdict = 'block'", "verdict = 'allow'", "verdict = ''") for place in ("not deeper", "deeper")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and path; both empty for null or a url without ://."""
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long rules the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments of a path with every run of digits as #; the empty path has none."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "#"), "^/", ""), "/", -1))


def unlikeness(a: list[int], b: list[int]) -> float:
    """How far two rows of counts are from one distribution: G statistic as a standard normal (Wilson-Hilferty)."""
    used = [(x, y) for x, y in zip(a, b) if x + y]
    n, na, nb = sum(a) + sum(b), sum(a), sum(b)
    if len(used) < 2 or not na or not nb:
        return -math.inf
    g = 2 * sum(x * math.log(x * n / ((x + y) * own)) for pair in used for x, y, own in ((*pair, na), (pair[1], pair[0], nb)) if x)
    df = len(used) - 1
    return ((max(g, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def merge_alike(branches: dict[str, list[int]], bound: float = ALIKE) -> dict[str, str]:
    """Name of the branch each name belongs to after merging the most alike two, again and again; ties by name."""
    groups = {(name,): list(counts) for name, counts in sorted(branches.items())}
    while len(groups) > 1:
        keys = list(groups)
        far, a, b = min((unlikeness(groups[x], groups[y]), x, y) for k, x in enumerate(keys) for y in keys[k + 1:])
        if far >= bound:
            break
        counts = [x + y for x, y in zip(groups.pop(a), groups.pop(b))]
        groups[tuple(sorted(a + b))] = counts
        groups = dict(sorted(groups.items()))
    return {name: names[0] if len(names) == 1 else "{" + "|".join(names) + "}" for names in groups for name in names}


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, node, kids in zip(batch["host"], batch["node"], batch["kids"]):
            into = merge_alike({kid["segment"]: list(kid["counts"]) for kid in kids})
            out += [(host, node, segment, name) for segment, name in into.items()]
        yield pd.DataFrame(out, columns=["host", "node", "segment", "name"])


def path_templates(pages: DataFrame, wide: int = WIDE, depth: int = DEPTH) -> DataFrame:
    """(host, shape, template, pages, blocked) for every distinct shape of a host's paths. pages: host, path, verdict.

    verdict is null where no rule decides. Pages are counted by shape first, so what goes through the levels of the tree is
    one row per distinct shape. A level is three small shuffles: names of a node are counted, a node of few names is
    merged (at most `wide` names in a row), and shapes take their new names by a join, which adaptive execution splits
    where one node holds most of them.
    """
    counted = pages.select("host", shape(F.col("path")).alias("shape"), F.coalesce("verdict", F.lit("")).alias("verdict")).groupBy(
        "host", "shape", "verdict").agg(F.count("*").alias("n"))
    rows, _ = stage(counted.withColumn("node", F.array().cast("array<string>")), "shapes")
    levels = rows.agg(F.max(F.size("shape")).alias("m")).first()["m"] or 0
    for level in range(min(levels, depth)):
        here = rows.withColumn("segment", F.get("shape", F.lit(level))).withColumn("deeper", F.size("shape") > level + 1)
        open_ = here.where("segment is not null")
        kids = open_.groupBy("host", "node", "segment").agg(F.array(*[F.coalesce(F.expr(f"sum(n) filter (where {k})"), F.lit(0)) for k in _KINDS]).alias("counts"))
        few = kids.groupBy("host", "node").agg(F.count("*").alias("names")).where(F.col("names") <= wide).select("host", "node")
        listed = kids.join(few, ["host", "node"], "left_semi").groupBy("host", "node").agg(F.collect_list(F.struct("segment", "counts")).alias("kids"))
        named = listed.mapInPandas(_merged, "host string, node array<string>, segment string, name string")
        joined = here.join(named, ["host", "node", "segment"], "left")
        deeper = F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", F.array(F.coalesce("name", F.lit("*")))))
        rows, _ = stage(joined.select("host", "shape", "verdict", "n", deeper.alias("node")), "level")
    rest = F.when(F.size("shape") > depth, F.concat("node", F.array(F.lit("**")))).otherwise(F.col("node"))
    return rows.groupBy("host", "shape", rest.alias("template")).agg(
        F.sum("n").alias("pages"), F.coalesce(F.expr("sum(n) filter (where verdict = 'block')"), F.lit(0)).alias("blocked"))


def template_purity(templates: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, pages, blocked, purity) of every template, pages of all templates below it included.

    Purity is the share of pages that a rule blocks. A page without a rule counts as not blocked, so that one branch's
    label does not condemn its siblings. Small templates lean on their host's share, small hosts on all hosts' share.
    """
    nodes = templates.select("host", F.explode(F.expr("transform(sequence(0, size(template)), k -> slice(template, 1, k))")).alias("template"), "pages", "blocked")
    sums = nodes.groupBy("host", "template").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("blocked"))
    hosts = sums.where(F.size("template") == 0)
    overall = hosts.agg((F.sum("blocked") / F.sum("pages")).alias("share")).first()["share"] or 0.0
    shares = hosts.select("host", ((F.col("blocked") + smoothing * overall) / (F.col("pages") + smoothing)).alias("share"))
    return sums.join(shares, "host").select(
        "host", "template", "pages", "blocked", ((F.col("blocked") + smoothing * F.col("share")) / (F.col("pages") + smoothing)).alias("purity"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, wide: int = WIDE, depth: int = DEPTH,
                smoothing: float = SMOOTHING, reject: float = REJECT) -> DataFrame:
    """Verdict on every url: that of the longest rule that fits, else block if its path's template is rejected, else allow.

    pages: page_id, url; other columns are left behind. Returns page_id, host, path, rule, verdict, template (of rejected
    urls without a rule, else null) and purity. A null url and one without :// have an empty host and path; no rule fits
    them, and they form a host of their own. Repeated rows count as pages each and each get a verdict; an empty table gives
    an empty result. Without rules nothing is blocked.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "verdict": verdict})
    templates, _ = stage(path_templates(judged, wide, depth), "templates")
    bad = template_purity(templates, smoothing).where(F.col("purity") >= reject).select("host", "template", "purity")
    # Few shapes are rejected; the pages meet only these.
    rejected, _ = stage(templates.select("host", "shape", "template").join(bad, ["host", "template"]).select(
        F.col("host").alias("bad_host"), F.col("shape").alias("bad_shape"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"), "rejected")
    open_, closed = judged.where("verdict is null"), judged.where("verdict is not null")
    found = open_.withColumn("own", shape(F.col("path"))).join(
        rejected, (F.col("host") == F.col("bad_host")) & (F.col("own") == F.col("bad_shape")), "left")
    return found.select("page_id", "host", "path", "rule", F.when(F.col("purity").isNotNull(), "block").otherwise("allow").alias("verdict"), "template", "purity").unionByName(
        closed.select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")))
