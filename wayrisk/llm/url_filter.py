"""URL filtering by rules and a path-template tree, in DataFrame operations only.

Explicit rules come first. URLs that a rule settles are also the labelled data of the tree:

1. Pages are aggregated by host and path segments, in which a segment with a digit is already a wildcard
   ``{n}``, so the tree works on distinct paths with their counts, not on pages.
2. Level by level, siblings are merged where labels don't tell them apart: those whose Wilson intervals of
   the share of blocked pages lie wholly above one half, wholly below it, or across it.
3. Siblings without labels become a wildcard ``{*}``, among themselves only, where their segment is variable:
   where pages that are alone with their segment are over half of the node's (Wilson interval at ``SURE``; by
   Good and Turing that is the chance that one more page brings a new segment). Else they stay.
4. A template's purity is its share of blocked pages, smoothed with ``PRIOR`` pages at what its surroundings say:
   the mean of its parent's purity on the host (smoothed toward the host's own, and that toward one half) and of
   the purity that its path's shape, the segments with ``{n}``, has over all hosts (smoothed toward one half).
   So labelled siblings and the same shape elsewhere count where a template has no labels of its own, and neither of
   the two is enough alone. Paths over ``REJECT`` are rejected, and with them the pages that no rule settles.

Aggregates combine map-side, so a host with a third of all pages meets no single task. Pages are joined
back to their path on host and segments by a plain sort-merge join, in which adaptive execution splits the rows of a popular path.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; repeated
rows repeat their result; an empty table gives an empty result; other columns are not read. The tree goes
down as far as paths share a template; below that, a path is settled in one step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint

#: Of ``oracle`` only: its tree has so many levels.
DEPTH = 6
Z = 1.96
#: For variable segments: every node is tested, and at 1.96 four pages with different segments are enough.
SURE = 3.29
PRIOR = 4.0
REJECT = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; empty for a null url or one without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of ``rules`` (verdict, host/path) that fits; else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit("{n}")).otherwise(s))
    return F.array_join(parts, "/")


def _above_half(part: Column, whole: Column, z: float = Z) -> Column:
    """Whether the Wilson interval of ``part`` / ``whole``, whole > 0, lies wholly above one half."""
    p, n = part / whole, whole
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return middle - spread > 0.5 * (1 + z * z / n)


def _templates(paths: DataFrame) -> DataFrame:
    """(host, segments, template, labelled, blocked) of the distinct paths (host, segments, labelled, blocked, pages)."""
    l, b = F.col("l"), F.col("b")
    side = F.when(_above_half(b, l), "{blocked}").when(_above_half(l - b, l), "{allowed}").otherwise("{mixed}")
    columns = ["host", "segments", "template", "labelled", "blocked", "pages"]
    parts = F.when(F.col("segments") == "", F.array().cast("array<string>")).otherwise(F.split("segments", "/"))
    tree = checkpoint(paths.withColumn("template", F.lit("")).select(*columns, (F.size(parts) == 0).alias("ended")))
    settled, level = [tree.where("ended")], 0
    live = tree.where("not ended")
    while not live.isEmpty():
        here = live.withColumn("s", F.get(parts, F.lit(level)))
        nodes = here.groupBy("host", "template", "s").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum("pages").alias("n"), F.count(F.lit(1)).alias("k"))
        branch = F.col("s") != "{n}"
        once, seen = F.sum(F.when(branch & (F.col("n") == 1), 1).otherwise(0)), F.sum(F.when(branch, F.col("n")))
        wide = nodes.groupBy("host", "template").agg(F.when(seen > 0, _above_half(once, seen, SURE)).otherwise(False).alias("wide"), (F.sum("k") == 1).alias("alone"))
        name = F.when(l > 0, side).when(F.col("wide") & branch, F.lit("{*}")).otherwise(F.col("s"))
        named = nodes.join(wide, ["host", "template"]).select("host", "template", "s", "alone", F.when(l > 0, side).alias("side"), F.concat(F.lit("/"), name).alias("step"))
        # a path that is alone at its node is alone below it too, so its steps repeat or are its segments
        below = F.array_join(F.transform(F.slice(parts, level + 2, F.greatest(F.size(parts), F.lit(1))), lambda s: F.concat(F.lit("/"), F.coalesce("side", s))), "")
        template = F.concat("template", "step", F.when(F.col("alone"), below).otherwise(F.lit("")))
        tree = here.join(named, ["host", "template", "s"]).withColumn("template", template).withColumn("ended", F.col("alone") | (F.size(parts) == level + 1))
        tree = checkpoint(tree.select(*columns, "ended"))
        settled.append(tree.where("ended"))
        live, level = tree.where("not ended"), level + 1
    return reduce(DataFrame.unionByName, settled).drop("pages", "ended")


def _smoothed(blocked: Column, labelled: Column, toward: Column) -> Column:
    return (blocked + PRIOR * toward) / (labelled + PRIOR)


def _purities(tree: DataFrame) -> DataFrame:
    """(host, segments, template, purity) of the paths of ``tree`` (host, segments, template, labelled, blocked)."""
    tree = tree.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    for name, keys in (("h", ["host"]), ("p", ["host", "parent"]), ("t", ["host", "template"]), ("s", ["segments"])):
        sums = tree.groupBy(*keys).agg(F.sum("blocked").alias(name + "b"), F.sum("labelled").alias(name + "l"))
        tree = tree.join(sums, keys)
    half = F.lit(0.5)
    parent = _smoothed(F.col("pb"), F.col("pl"), _smoothed(F.col("hb"), F.col("hl"), half))
    around = (parent + _smoothed(F.col("sb"), F.col("sl"), half)) / 2
    return tree.select("host", "segments", "template", F.round(_smoothed(F.col("tb"), F.col("tl"), around), 6).alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity."""
    host, path = host_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"), _segments(F.col("path")).alias("segments"))
    paths = parsed.groupBy("host", "segments").agg(F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"), F.count(F.lit(1)).alias("pages"))
    judged = checkpoint(_purities(_templates(paths)))
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return parsed.join(judged, ["host", "segments"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")


def oracle(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL for ``judge`` over ``pages``, where no path is deeper than ``DEPTH``."""
    rule = verdict = "NULL"
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = name.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    bound = lambda x, n, z: f"({x} / {n} + {z} * {z} / (2 * {n}) - {z} * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n})"
    out = f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, path FROM u),
r AS (SELECT *, {rule} AS rule, {verdict} AS ruled,
  array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '{{n}}' ELSE s END), '/') AS segments FROM q),
t0 AS (SELECT host, segments, count(ruled) AS labelled, count(CASE WHEN ruled = 'block' THEN 1 END) AS blocked, count(*) AS pages, '' AS template FROM r GROUP BY host, segments)"""
    for level in range(DEPTH):
        out += f""",
h{level} AS (SELECT *, coalesce(string_split(segments, '/')[{level + 1}], '') AS s FROM t{level}),
n{level} AS (SELECT host, template, s, CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(blocked) AS DOUBLE) AS b, CAST(sum(pages) AS DOUBLE) AS n FROM h{level} GROUP BY host, template, s),
c{level} AS (SELECT host, template, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS one, sum(n) AS seen FROM n{level} WHERE s NOT IN ('', '{{n}}') GROUP BY host, template),
m{level} AS (SELECT n.host, n.template, n.s, CASE WHEN n.s = '' THEN '' WHEN l > 0 THEN CASE WHEN {bound("b", "l", Z)} > 0.5 THEN '/{{blocked}}' WHEN {bound("(l - b)", "l", Z)} > 0.5 THEN '/{{allowed}}' ELSE '/{{mixed}}' END
  WHEN n.s <> '{{n}}' AND {bound("c.one", "c.seen", SURE)} > 0.5 THEN '/{{*}}' ELSE '/' || n.s END AS step FROM n{level} n LEFT JOIN c{level} c ON n.host = c.host AND n.template = c.template),
t{level + 1} AS (SELECT h.host, h.segments, h.labelled, h.blocked, h.pages, h.template || m.step AS template FROM h{level} h JOIN m{level} m ON h.host = m.host AND h.template = m.template AND h.s = m.s)"""
    own = lambda keys: f"(sum(blocked) OVER (PARTITION BY {keys}) + {PRIOR} * {{}}) / (sum(labelled) OVER (PARTITION BY {keys}) + {PRIOR})"
    return out + f""",
a AS (SELECT *, regexp_replace(template, '/[^/]*$', '') AS parent FROM t{DEPTH}),
e AS (SELECT *, {own("host").format(0.5)} AS hp, {own("segments").format(0.5)} AS sp FROM a),
f AS (SELECT *, {own("host, parent").format("hp")} AS pp FROM e),
p AS (SELECT host, segments, template, round({own("host, template").format("(pp + sp) / 2")}, 6) AS purity FROM f)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN p.purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, p.template, p.purity
FROM r JOIN p ON r.host = p.host AND r.segments = p.segments"""
