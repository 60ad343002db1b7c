"""Column expressions over texts, urls and publishers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayrisk.sources.dimensions import ACCEPT, GEO_TAGS, PUBLISHERS, REJECT, STOPWORDS, TIER_SCORE, TIERS, keyword_rows

#: Case-insensitive, as Unicode; a dot is all but a line feed.
_I = "(?iuUd)"
#: What no word's character is before.
_BEGINS = r"(?<![\p{L}\p{N}_])"


def _longest(words: list[str]) -> str:
    """A pattern of the longest of ``words`` at a place, that reads each character once."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    branches = "|".join(re.escape(c) + _longest(rest) for c, rest in tails.items())
    return f"(?:{branches}){'?' if '' in words else ''}" if branches else ""


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def classify(text: Column) -> Column:
    """struct<label, confidence, scores map>: the label whose keywords weigh most (F1).

    A keyword counts where it begins a word. Score: 0.30 + 0.65 times the mean of count and weight, each over three and
    at most 1, and at most 0.95. Ties go to the label that comes first; without a keyword the label is safe at 0.5.
    """
    rows = keyword_rows()
    labels = list(dict.fromkeys(label for _, label, _, _ in rows))
    words = sorted({w for _, _, w, _ in rows})
    # the longest keyword at a word's beginning stands for all keywords that it begins with, so a text is read once;
    # rules are constants, which keeps the expression small
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    rules = constant([{"o": o, "x": x} for o, _, _, x in rows], "array<struct<o:int,x:double>>")
    of = constant({longest: [i for i, r in enumerate(rows) if longest.startswith(r[2])] for longest in words}, "map<string,array<int>>")
    begun = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{_BEGINS}(?=({_longest(words)}))"), F.lit(1))
    hit = F.sort_array(F.array_distinct(F.flatten(F.transform(F.array_distinct(begun), lambda w: of[w]))))
    found = F.transform(hit, lambda i: F.get(rules, i))

    def scored(hits: Column) -> Column:
        def score(label: Column, i: Column) -> Column:
            mine = F.filter(hits, lambda h: h["o"] == i)
            half = lambda v: F.least(v / 3.0, F.lit(1.0))
            weight = F.aggregate(mine, F.lit(0.0), lambda a, h: a + h["x"])
            value = F.when(F.size(mine) > 0, F.round(F.least(0.30 + 0.65 * (half(F.size(mine)) + half(weight)) / 2, F.lit(0.95)), 4)).otherwise(0.0)
            return F.struct(value.alias("s"), (-i).alias("o"), label.alias("l"))

        return F.transform(F.array(*map(F.lit, labels)), score)

    def chosen(ranked: Column) -> Column:
        top = F.array_max(ranked)
        safe = F.array(F.struct(F.lit("safe").alias("key"), F.when(top["s"] > 0, 0.0).otherwise(0.5).alias("value")))
        return F.struct(
            F.when(top["s"] > 0, top["l"]).otherwise("safe").alias("label"),
            F.when(top["s"] > 0, top["s"]).otherwise(0.5).alias("confidence"),
            F.map_from_entries(F.concat(F.transform(ranked, lambda r: F.struct(r["l"].alias("key"), r["s"].alias("value"))), safe)).alias("scores"),
        )

    return _let(_let(found, scored), chosen)


def relevant(text: Column) -> Column:
    """Whether a text may matter: long enough, and accepted or not rejected."""
    accept, reject = (_I + "|".join(rf"\b({p})\b" for p in patterns) for patterns in (ACCEPT, REJECT))
    return F.coalesce(F.when(F.length(text) < 20, False).when(text.rlike(accept), True).when(text.rlike(reject), False).otherwise(True), F.lit(False))


def still_relevant(label: Column, confidence: Column) -> Column:
    """Not safe with confidence."""
    return ~((label == "safe") & (confidence >= 0.70))


def valid_event(text: Column, url: Column, published: Column, now: Column, hours: int = 72) -> Column:
    """Long enough text, a web url or none, and not stale."""
    web = (F.coalesce(url, F.lit("")) == "") | url.rlike("^https?://")
    stale = F.unix_micros(now) - F.unix_micros(published) > hours * 3_600_000_000
    # most reports of a feed's whole past are stale, so their texts and urls aren't looked at
    return ~F.coalesce(stale, F.lit(False)) & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 20) & web


def domain(url: Column) -> Column:
    """Network location, or the first part of the path, lower-cased and without www.."""
    u = F.coalesce(url, F.lit(""))
    host = F.coalesce(F.nullif(F.regexp_extract(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")), F.regexp_extract(u, "^([^/?#]*)", 1))
    return F.when(u == "", "unknown").otherwise(F.regexp_replace(F.lower(host), r"^www\.", ""))


def domain_score(d: Column) -> Column:
    """struct<score, tier> of a domain."""
    of = lambda score, tier: F.struct(F.lit(score).cast("double").alias("score"), F.lit(tier).alias("tier"))
    known = lambda names: F.coalesce(d.isin(names), F.lit(False))
    below = lambda names: d.rlike(r"\.(" + "|".join(map(re.escape, names)) + ")$")
    out = F.when(d.isNull() | d.isin("", "unknown"), of(0.30, "unknown"))
    for tier, names in TIERS.items():
        out = out.when(known(names), of(TIER_SCORE[tier], tier))
    for tier in ("tier1", "tier2"):
        out = out.when(below(TIERS[tier]), of(TIER_SCORE[tier] * 0.95, tier))
    out = out.when(d.rlike(r"\.gov(\.uk)?$"), of(0.75, "tier2")).when(d.rlike(r"\.(edu|ac\.uk)$"), of(0.70, "tier2"))
    out = out.when(d.rlike(r"\.(org|int)$"), of(0.50, "tier3")).when(d.endswith(".news") | d.contains("news"), of(0.45, "tier3"))
    return out.otherwise(of(0.30, "unknown"))


def publisher_score(score: Column, publisher: Column) -> Column:
    """At least the score of the first known publisher in the name."""
    low, out = F.lower(publisher), None
    for name, least in PUBLISHERS.items():
        out = F.when(low.contains(name), F.greatest(score, F.lit(least))) if out is None else out.when(low.contains(name), F.greatest(score, F.lit(least)))
    return out.otherwise(score)


def verified(d: Column, base: Column, publisher: Column) -> Column:
    """struct<domain, credibility_score, credibility_tier, publisher> of a source with a domain and its ``domain_score``."""
    score = publisher_score(base["score"], publisher)
    tier = F.when(score == base["score"], base["tier"]).when(score >= 0.90, "tier1").when(score >= 0.75, "tier2").when(score >= 0.60, "tier3").otherwise(base["tier"])
    return F.struct(d.alias("domain"), F.round(score, 4).alias("credibility_score"), tier.alias("credibility_tier"), F.coalesce(F.nullif(publisher, F.lit("")), d).alias("publisher"))


def verify(url: Column, publisher: Column) -> Column:
    """struct<domain, credibility_score, credibility_tier, publisher> of a source."""
    return _let(domain(url), lambda d: _let(domain_score(d), lambda base: verified(d, base, publisher)))


def geo_tag(text: Column) -> Column:
    """struct<lat, lon, zone> of the first place pattern that a text has; null without."""
    out = None
    for pattern, lat, lon, zone in GEO_TAGS:
        value = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(zone).alias("zone"))
        hit = text.rlike(_I + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def geo_tags(text: Column) -> Column:
    """Distinct zones of all place patterns that a text has, in their order."""
    found = F.array(*(F.when(text.rlike(_I + p), F.lit(z)) for p, _, _, z in GEO_TAGS))
    return F.array_distinct(F.filter(found, lambda z: z.isNotNull()))


def located(lat: Column, lon: Column, tag: Column, place_lat: Column, place_lon: Column) -> Column:
    """struct<lat, lon>: the feed's coordinates if valid, else those of the text's ``geo_tag``, else the gazetteer's."""
    feed = F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
    tagged = F.when(tag.isNotNull(), F.struct(tag["lat"].alias("lat"), tag["lon"].alias("lon")))
    known = F.when(place_lat.isNotNull(), F.struct(place_lat.alias("lat"), place_lon.alias("lon")))
    return F.coalesce(feed, tagged, known)


def resolve(lat: Column, lon: Column, text: Column, place_lat: Column, place_lon: Column) -> Column:
    """struct<lat, lon>: the feed's coordinates if valid, else the text's place, else the gazetteer's."""
    return _let(geo_tag(text), lambda tag: located(lat, lon, tag, place_lat, place_lon))


def tokens(text: Column) -> Column:
    """Words of a headline that say something."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two texts."""
    ta, tb = tokens(a), tokens(b)
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    norm = lambda words: F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + F.pow(count(words, w), 2)))
    dot = F.aggregate(F.array_intersect(ta, tb), F.lit(0.0), lambda s, w: s + count(ta, w) * count(tb, w))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(dot / F.greatest(norm(ta) * norm(tb), F.lit(1e-9)))


def headline(text: Column, n: int = 150) -> Column:
    """The first ``n`` characters, trimmed, with an ellipsis if there were more (F16)."""
    return F.concat(F.trim(F.substring(text, 1, n)), F.when(F.length(text) > n, "…").otherwise(""))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def clean_location(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def masked_uri(uri: Column) -> Column:
    """A uri without its user and password."""
    return F.regexp_replace(uri, "://[^@/]*@", "://***:***@")


def masked_secret(secret: Column) -> Column:
    """First and last four characters; short secrets vanish."""
    return F.when(F.coalesce(F.length(secret), F.lit(0)) <= 8, "***").otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4)))
