"""Location strings as arrays of structs, and the choice of a primary place.

A string holds entries parted by ; and an entry nine fields parted by #: type,
name, country, two administrative codes, latitude, longitude, feature id and
character offset. Everything is a higher-order expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import blank_to_null, integer, number, trimmed

IDENTITY = ["kind", "name", "country", "adm1", "adm2", "lat", "lon", "feature"]
NO_OFFSET = 10**12


def parse_locations(raw: Column | str) -> Column:
    """array<struct<kind, name, country, adm1, adm2, lat, lon, feature, at, valid>>, empty for null."""

    def entry(e: Column) -> Column:
        f = F.split(e, "#")
        field = lambda k: F.coalesce(F.get(f, F.lit(k)), F.lit(""))
        lat, lon = number(field(5)), number(field(6))
        return F.struct(
            integer(field(0)).alias("kind"), blank_to_null(field(1)).alias("name"),
            *(F.upper(blank_to_null(field(k))).alias(n) for k, n in ((2, "country"), (3, "adm1"), (4, "adm2"))),
            lat.alias("lat"), lon.alias("lon"), blank_to_null(field(7)).alias("feature"), integer(field(8)).alias("at"),
            F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)).alias("valid"),
        )

    entries = F.filter(F.split(F.coalesce(raw, F.lit("")), ";"), lambda e: trimmed(e) != "")
    return F.transform(entries, entry)


def region_of(place: Column) -> Column:
    """country:adm1, the country alone, or null."""
    return F.when(place["country"].isNotNull() & place["adm1"].isNotNull(), F.concat(place["country"], F.lit(":"), place["adm1"])).otherwise(place["country"])


def _identity(place: Column) -> Column:
    return F.struct(*(place[x].alias(x) for x in IDENTITY))


def distinct_places(places: Column) -> Column:
    return F.size(F.array_distinct(F.transform(places, _identity)))


def ranked_regions(places: Column) -> Column:
    """array<struct<fewer, region>>: regions by falling number of mentions, then by name; fewer is the negated number."""
    regions = F.filter(F.transform(places, region_of), lambda r: r.isNotNull())
    counted = F.transform(F.array_distinct(regions), lambda r: F.struct((-F.size(F.filter(regions, lambda q: q == r))).alias("fewer"), r.alias("region")))
    return F.array_sort(counted)


def selection_status(places: Column, ranked: Column) -> Column:
    first, second = F.get(ranked, F.lit(0))["fewer"], F.get(ranked, F.lit(1))["fewer"]
    return (
        F.when(F.size(places) == 0, "missing").when(F.size(ranked) == 0, "unresolved_region").when(F.size(ranked) == 1, "single_region")
        .when(first <= 2 * second, "dominant_region").otherwise("ambiguous_region")
    )


def primary_place(places: Column, status: Column, ranked: Column) -> Column:
    """The best place, of the preferred region where there is one.

    Order: valid coordinates, specificity of the kind, mentions, a name, the
    earliest offset, and on ties the place first mentioned.
    """
    top = F.get(ranked, F.lit(0))["region"]
    fixed = status.isin("single_region", "dominant_region")
    indexed = F.transform(places, lambda p, i: F.struct(_identity(p).alias("id"), p["at"].alias("at"), i.alias("i"), p.alias("p")))

    def score(x: Column) -> Column:
        same = F.filter(indexed, lambda y: y["id"] == x["id"])
        p = x["p"]
        special = F.when(p["kind"].isin(3, 4), 4).when(p["kind"].isin(2, 5), 3).when(p["kind"] == 1, 2).otherwise(1)
        return F.struct(
            p["valid"].alias("valid"), special.alias("special"), F.size(same).alias("mentions"), p["name"].isNotNull().alias("named"),
            (-F.coalesce(F.array_min(F.transform(same, lambda y: y["at"])), F.lit(NO_OFFSET))).alias("early"),
            (-F.array_min(F.transform(same, lambda y: y["i"]))).alias("first"), p.alias("place"),
        )

    wanted = F.filter(indexed, lambda x: F.coalesce(~fixed | (region_of(x["p"]) == top), F.lit(False)))
    return F.array_max(F.transform(wanted, score))["place"]
