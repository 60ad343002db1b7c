"""Incidents: reports of one event, clustered greedily and exactly, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions.geo import haversine_km
from wayrisk.functions.python_text import headline_similarity
from wayrisk.functions.text import token_cosine
from wayrisk.operators.cut import cut
from wayrisk.operators.joins import _cells

KM, HOURS, ALIKE, WEAK = 100.0, 24, 0.45, 0.25
_HOUR, _DAY = 3_600_000_000, 86_400_000_000
#: Tasks that kinds without place or time are dealt to, where they must meet all others.
SALTS = 64
#: Days that a kind is sought in at once; each is a bit of a mask.
SPAN = 4
#: Reports, for each task, of the first stretch of the order that heads are found in; each later one is as long as all before it.
STRETCH = 50_000


def _marked(docs: DataFrame) -> DataFrame:
    """Reports that can have links, with what their kinds have in common. A blank text is like none, and a place that is no number is near none."""
    there = F.coalesce(haversine_km(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon")) <= KM, F.lit(True))
    text = F.trim("raw_text")
    return docs.where((text != "") & there).select("ord", "raw_text", "lat", "lon", F.xxhash64(F.lower(text)).alias("h"), F.nullif("label", F.lit("")).alias("label"), F.unix_micros("published_at").alias("t"))


def kinds_of(docs: DataFrame) -> DataFrame:
    """(kind, lat, lon, h, label, text, n): the kinds of reports, which have place, text and label in common.

    Reports of a kind have the same links but for their times.
    """
    texts = _marked(docs).groupBy("lat", "lon", "h", "label", "raw_text").count()
    kinds = texts.groupBy("lat", "lon", "h", "label").agg(F.min("raw_text").alias("text"), F.sum("count").alias("n"))
    return cut(kinds.withColumn("kind", F.monotonically_increasing_id()))


def reports_of(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ord, kind, t, day): the reports that have a kind."""
    d = _marked(docs)
    d = d.select("ord", "t", *(F.col(c).alias("d_" + c) for c in ("lat", "lon", "h", "label")))
    same = F.col("d_h") == F.col("h")
    for c in ("lat", "lon", "label"):
        same = same & F.col("d_" + c).eqNullSafe(F.col(c))
    return d.join(kinds, same).select("ord", "kind", "t", F.floor(F.col("t") / _DAY).cast("int").alias("day"))


def candidates(kinds: DataFrame, days: DataFrame) -> DataFrame:
    """Pairs (a before b) of kinds within 100 km that have reports (``days``: kind, day) on the same day or the next: a, b, their texts' hashes, and whether their labels agree.

    Kinds meet by equality of what they have: cell and span of days, the span alone where they have no coordinates, the cell alone
    where there is no time. What a report lacks can't part it from others, so one with neither meets all others, and
    one without coordinates all without a time; those few are dealt over ``SALTS``. Reports of an ingestion cycle have both.
    """
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    side = days.groupBy("kind", F.floor(F.col("day") / SPAN).cast("int").alias("span")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(day, {SPAN}) as int))")).alias("mask"))
    around_place = F.when(placed, _cells(F.col("lat"), F.col("lon"), KM)).alias("cells")
    side = side.join(kinds.select("kind", "h", "label", "lat", "lon", around_place), "kind")
    side = side.withColumn("cell", F.when(placed, (F.floor("lat") * 360 + F.pmod(F.floor("lon"), F.lit(360))).cast("int")))
    side = side.withColumn("salt", F.pmod(F.xxhash64("kind", "span"), F.lit(SALTS)).cast("int"))
    # a small table becomes several times as many rows, so it is dealt to all tasks before
    side = cut(side.repartition(days.sparkSession.sparkContext.defaultParallelism, "kind", "span"))
    lack = side.agg(*(F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in ("cell", "span"))).first()
    left, right = (side.select(*(F.col(c).alias(p + c) for c in side.columns)) for p in ("l_", "r_"))
    cells = F.explode("l_cells").alias("cell")
    # the days around a kind's own, as masks of their spans
    around = (("l_span - 1", f"(l_mask & 1) * {1 << SPAN - 1}"), ("l_span", f"(l_mask | l_mask * 2 | shiftright(l_mask, 1)) & {(1 << SPAN) - 1}"), ("l_span + 1", f"shiftright(l_mask, {SPAN - 1})"))
    soon = lambda df: df.select("*", F.inline(F.array(*(F.struct(F.expr(s).alias("span"), F.expr(m).alias("near")) for s, m in around)))).where("near <> 0")

    # of two cells, the first one's kinds look for the other's
    full = soon(left.where("l_cell is not null and l_span is not null")).select("*", cells).where("cell >= l_cell")
    full = full.join(right, F.expr("cell = r_cell and span = r_span and (near & r_mask) <> 0 and (cell > l_cell or l_kind < r_kind)"))
    no_place = soon(left.where("l_cell is null and l_span is not null")).join(right, F.expr("span = r_span and (near & r_mask) <> 0 and (r_cell is not null or l_kind < r_kind)"))
    no_time = left.where("l_cell is not null and l_span is null").select("*", cells).join(right, F.expr("cell = r_cell and l_kind <> r_kind"))
    dealt = left.where("l_cell is null").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    neither = dealt.where("l_span is null").join(right, F.expr("salt = r_salt and l_kind <> r_kind"))
    crossed = dealt.where("l_span is not null").join(right.where("r_span is null and r_cell is not null"), F.expr("salt = r_salt"))

    near = F.col("l_cell").isNull() | F.col("r_cell").isNull() | (haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= KM)
    same = F.coalesce(F.col("l_label") == F.col("r_label"), F.lit(True))
    first = F.col("l_kind") < F.col("r_kind")
    pick = lambda c, x, y: F.when(first, F.col(x + c)).otherwise(F.col(y + c))
    out = None
    for part in (full, *[no_place] * lack.cell, *[no_time, neither, crossed] * lack.span):
        part = part.where(near).select(pick("kind", "l_", "r_").alias("a"), pick("kind", "r_", "l_").alias("b"), pick("h", "l_", "r_").alias("ha"), pick("h", "r_", "l_").alias("hb"), same.alias("same"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def links(kinds: DataFrame, days: DataFrame) -> DataFrame:
    """(kind, to): the later kinds whose reports are of one incident with an earlier one's if their times are near (J6); each to itself, too.

    The sequence ratio depends on which text comes first, so links are one-way. Each pair of different texts is scored once each way, however many reports have them; where the token cosine already
    accepts, or lengths already reject, the sequence ratio isn't asked for.
    """
    pairs = cut(candidates(kinds, days))
    pairs = pairs.union(pairs.select("b", "a", "hb", "ha", "same"))
    texts = kinds.groupBy("h").agg(F.min("text").alias("text"))
    of = lambda p: texts.select(F.col("h").alias("h" + p), F.col("text").alias("t" + p))
    scored = pairs.select("ha", "hb").distinct().join(of("a"), "ha").join(of("b"), "hb").withColumn("cosine", token_cosine(F.col("ta"), F.col("tb")))
    length = lambda c: F.least(F.length(F.trim(c)), F.lit(200))
    most = 2 * F.least(length("ta"), length("tb")) / F.greatest(length("ta") + length("tb"), F.lit(1))
    settled = (F.col("cosine") >= ALIKE) | (most < WEAK)
    scored = scored.select("ha", "hb", "cosine", F.when(~settled, F.col("ta")).alias("ta"), F.when(~settled, F.col("tb")).alias("tb"))
    scored = cut(scored.select("ha", "hb", "cosine", headline_similarity("ta", "tb").alias("ratio")))
    scored = scored.select("ha", "hb", F.greatest("cosine", "ratio").alias("sim")).where(F.col("sim") >= WEAK)
    linked = pairs.join(scored, ["ha", "hb"]).where((F.col("sim") >= ALIKE) | F.col("same"))
    return cut(linked.select("a", "b").union(kinds.select("kind", "kind")).toDF("kind", "to"))


def _reach(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, day, head, at): each of the rows (ord, kind, t, day) at all kinds that it is linked to, and at the days around its own if ``keys`` have the day."""
    r = rows.join(edges, "kind").select(F.col("to").alias("kind"), F.col("ord").alias("head"), F.col("t").alias("at"), "day")
    return r.withColumn("day", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1))) if "day" in keys else r.drop("day")


def _without(rows: DataFrame, reach: DataFrame, keys: list[str], when) -> DataFrame:
    r = reach.select(*(F.col(c).alias("r_" + c) for c in reach.columns))
    for k in keys:
        when = when & (F.col(k) == F.col("r_" + k))
    return rows.join(r, when, "left_anti")


def clusters(docs: DataFrame, stretch: int | None = None) -> DataFrame:
    """``docs`` with ``cluster``, the ``ord`` of the first report of its incident.

    Taken in order, a report joins the first cluster whose head it is linked to, else it is a head. Reports are never paired with
    each other, only with heads: links are those of kinds, and heads of linked kinds are more than a day apart. The order is gone through in
    stretches, each without the reports that earlier heads have. In a stretch, rounds find heads at all places at once: of
    each kind and day the first live report, if no linked kind has an earlier one on a day around. What new heads are linked to goes.
    The first stretch has ``stretch`` reports, by default as many as all tasks together take.
    """
    stretch = stretch or STRETCH * docs.sparkSession.sparkContext.defaultParallelism
    kinds = kinds_of(docs)
    reports = reports_of(docs, kinds)
    size = kinds.agg(F.sum("n")).first()[0] or 0
    n = max(1, min(4096, size // stretch))
    if n == 1:
        reports = cut(reports.withColumn("stretch", F.lit(0)))
    else:
        part = F.spark_partition_id()
        reports = cut(reports.repartitionByRange(n, "ord").withColumn("stretch", F.when(part == 0, 0).otherwise(F.length(F.bin(part)))))
    days = cut(reports.select("kind", "day").distinct())
    edges = links(kinds, days)
    # a report without a time is near all days
    keys = ["kind"] if not days.where("day is null").isEmpty() else ["kind", "day"]
    soon = F.coalesce(F.abs(F.col("t") - F.col("r_at")) <= HOURS * _HOUR, F.lit(True))
    reach = None
    for k in range((n - 1).bit_length() + 1):
        live = reports.where(F.col("stretch") == k).drop("stretch")
        live = cut(_without(live, reach, keys, soon) if reach is not None else live)
        here = edges
        if n > 1:
            of = live.select("kind").distinct()
            here = cut(edges.join(of, "kind", "left_semi").join(of.withColumnRenamed("kind", "to"), "to", "left_semi").select("kind", "to"))
        heads = None
        while not live.isEmpty():
            first = live.groupBy("kind", "day").agg(F.min_by("t", "ord").alias("t"), F.min("ord").alias("ord")).select("ord", "kind", "t", "day")
            new = cut(_without(first, _reach(first, here, keys), keys, F.col("r_head") < F.col("ord")))
            heads = new if heads is None else heads.union(new)
            live = cut(_without(live, _reach(new, here, keys), keys, soon & (F.col("r_head") <= F.col("ord"))))
        if heads is not None:
            reached = cut(_reach(heads, edges, keys))
            reach = reached if reach is None else reach.union(reached)
    if reach is None:
        return docs.withColumn("cluster", F.col("ord"))
    r = reach.select(*(F.col(c).alias("r_" + c) for c in reach.columns))
    met = reports.join(r, soon & F.expr(" and ".join(f"{k} = r_{k}" for k in keys)))
    of = cut(met.groupBy("ord").agg(F.min("r_head").alias("cluster")))
    return docs.join(of, "ord", "left").withColumn("cluster", F.coalesce("cluster", "ord"))


def _firsts(clustered: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """(cluster, lists): for each list the distinct values of its text column, in the order of the first report that has each; empty ones are none.

    A value's first report is found before values are collected, so that a list is as long as a cluster's distinct values, not its reports.
    """
    values = F.array(*(F.struct(F.lit(out).alias("list"), value.cast("string").alias("v")) for out, value in lists.items()))
    first = clustered.select("cluster", "ord", F.inline(values)).where(F.coalesce("v", F.lit("")) != "").groupBy("cluster", "list", "v").agg(F.min("ord").alias("first"))
    return first.groupBy("cluster").agg(*(F.sort_array(F.collect_list(F.when(F.col("list") == out, F.struct("first", "v"))))["v"].alias(out) for out in lists))


def merge(clustered: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """One row per cluster (A8, A9): the longest report with the cluster's publishers, urls, time, intensity and corroboration.

    ``carried`` names further columns that the longest report's values are taken of.
    """
    base = carried if carried is not None else [c for c in ("label_confidence",) if c in clustered.columns]
    longest = F.min_by(F.struct(*base, "raw_text", "lat", "lon", "label", "image_url", "source"), F.struct(-F.length("raw_text"), "ord")).alias("base")
    g = clustered.groupBy("cluster").agg(
        longest,
        F.count(F.lit(1)).alias("cluster_size"),
        F.max("published_at").alias("latest_source_at"),
        F.avg(F.when(F.col("intensity_score") > 0, F.col("intensity_score"))).alias("intensity"),
        F.avg(F.when(F.col("credibility_score") > 0, F.col("credibility_score"))).alias("credibility"),
    )
    none = F.array().cast("array<string>")
    # beginnings of texts stand for urls where no report of a cluster has one
    head = F.when(F.coalesce("source_url", F.lit("")) == "", F.lower(F.substring("raw_text", 1, 120)))
    lists = {"publishers": F.col("publisher"), "source_urls": F.col("source_url"), "images": F.col("image_url"), "heads": head}
    g = g.join(_firsts(clustered, lists), "cluster", "left").withColumns({out: F.coalesce(out, none) for out in lists})
    urls = F.when(F.size("source_urls") > 0, F.sort_array("source_urls")).otherwise(F.sort_array("heads"))
    count = F.greatest(F.lit(1), F.when(F.size("publishers") > 0, F.size("publishers")).when(F.size("source_urls") > 0, F.size("source_urls")).otherwise(F.col("cluster_size")))
    credibility = F.coalesce("credibility", F.lit(0.0))
    image = F.coalesce(F.nullif("base.image_url", F.lit("")), F.get("images", F.lit(0)))
    g = g.withColumn("canonical_event_id", F.concat(F.lit("incident-"), F.substring(F.sha1(F.array_join(urls, "|")), 1, 16))).withColumn("corroboration_count", count)
    return g.select(
        "cluster", "canonical_event_id", F.substring("base.raw_text", 1, 180).alias("representative_headline"), "base.raw_text", "base.lat", "base.lon", "base.label", *(f"base.{c}" for c in base), "base.source",
        image.alias("image_url"), "publishers", "source_urls", "corroboration_count", "cluster_size", "latest_source_at",
        F.round(F.coalesce("intensity", F.lit(0.0)), 4).alias("intensity_score"), F.round(credibility, 4).alias("combined_credibility"),
        F.round(F.least(F.lit(1.0), F.col("corroboration_count") / 4 * F.greatest(credibility, F.lit(0.25))), 4).alias("corroboration_score"),
    )


def cluster_incidents(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Incidents of reports (ord, raw_text, label, lat, lon, published_at, publisher, source_url, image_url, source, intensity_score, credibility_score)."""
    return merge(clusters(docs), carried)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
