"""Road tags, clocks, names and identifiers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drivable highway tags and their road classes.
ROAD_CLASSES = {
    "motorway": "motorway",
    "motorway_link": "motorway",
    "trunk": "trunk",
    "trunk_link": "trunk",
    "primary": "primary",
    "primary_link": "primary",
    "secondary": "secondary",
    "secondary_link": "secondary",
    "tertiary": "tertiary",
    "tertiary_link": "tertiary",
    "residential": "residential",
    "living_street": "residential",
    "unclassified": "unclassified",
    "service": "service",
    "road": "unclassified",
}
MPS_OF_MPH, MPS_OF_KMH = 0.44704, 1 / 3.6


def parse_wallclock(text: Column) -> Column:
    """Struct ``sec_of_day, yyyymmdd`` of ``YYYY-MM-DD HH:MM:SS:mmm`` (or with ``T`` and ``.``); null if it isn't one."""
    pattern = r"^\s*(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})[:.](\d{1,3})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    seconds = part(4) * 3600 + part(5) * 60 + part(6) + part(7) / 1000.0
    return F.when(text.rlike(pattern), F.struct(seconds.cast("double").alias("sec_of_day"), (part(1) * 10000 + part(2) * 100 + part(3)).alias("yyyymmdd")))


def parse_max_speed(text: Column) -> Column:
    """Metres per second of ``60``, ``60 km/h`` or ``30 mph``; null for anything else, never a default."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(mph|km/h|kmh)?\s*$"
    value = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(text.rlike(pattern), value * F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "mph", MPS_OF_MPH).otherwise(MPS_OF_KMH))


def road_class(tags: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ROAD_CLASSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.try_element_at(tags, F.lit("highway"))), F.lit("unclassified"))


def _tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def is_one_way(tags: Column) -> Column:
    """Tagged so in either direction, or a motorway without a tag."""
    value = _tag(tags, "oneway")
    return F.coalesce(value.isin("yes", "true", "1", "-1"), F.lit(False)) | (value.isNull() & F.coalesce(_tag(tags, "highway").isin("motorway", "motorway_link"), F.lit(False)))


def is_reversed(tags: Column) -> Column:
    return F.coalesce(_tag(tags, "oneway") == "-1", F.lit(False))


def access_list(tags: Column) -> Column:
    """Vehicle kinds that may use the way."""
    allowed = lambda kind: ~F.coalesce(F.coalesce(_tag(tags, kind), _tag(tags, "motor_vehicle")).isin("no", "private"), F.lit(False))
    return F.array_compact(F.array(F.when(allowed("motorcar"), "cars"), F.when(allowed("motorcycle"), "twoWheelers")))


def is_drivable(tags: Column, refs: Column) -> Column:
    known = F.coalesce(_tag(tags, "highway").isin(*ROAD_CLASSES), F.lit(False))
    return known & ~F.coalesce(_tag(tags, "access").isin("no", "private"), F.lit(False)) & (F.coalesce(F.size(refs), F.lit(0)) >= 2)


def road_segment_from_way(way_id: Column, tags: Column, coords: Column, allowed: tuple[str, ...] = tuple(ROAD_CLASSES)) -> Column:
    """Import form of a way: ``id, name, highway_type, speed_limit_kmh, coordinates``; null if it isn't imported."""
    highway = _tag(tags, "highway")
    digits = F.regexp_replace(F.coalesce(_tag(tags, "maxspeed"), F.lit("50")), "[^0-9]", "")
    name = F.coalesce(F.nullif(_tag(tags, "name"), F.lit("")), F.nullif(_tag(tags, "ref"), F.lit("")), F.concat(F.lit("OSM Way "), way_id.cast("string")))
    made = F.struct(way_id.cast("string").alias("id"), name.alias("name"), highway.alias("highway_type"), F.coalesce(digits.try_cast("int"), F.lit(50)).alias("speed_limit_kmh"), coords.alias("coordinates"))
    return F.when(highway.isin(*allowed) & (F.size(coords) >= 2), made)


def linestring_wkt(coords: Column) -> Column:
    """``MULTILINESTRING((lon lat, ...))`` of [[lat, lon], ...]; null under two points."""
    points = F.transform(coords, lambda p: F.concat_ws(" ", p[1].cast("string"), p[0].cast("string")))
    return F.when(F.size(coords) >= 2, F.concat(F.lit("MULTILINESTRING(("), F.array_join(points, ", "), F.lit("))")))


def match_tier(name: Column, query: Column) -> Column:
    """0 equal, 1 prefix, 2 a word starts so, 3 inside; null: no match. Case is ignored."""
    n, q = F.lower(name), F.lower(query)
    words = F.split(n, r"[\s,./-]+")
    return F.when(n == q, 0).when(F.startswith(n, q), 1).when(F.exists(words, lambda w: F.startswith(w, q)), 2).when(F.contains(n, q), 3)


def carrier_band(hz: Column) -> Column:
    mhz = hz / 1e6
    named = F.when(F.abs(mhz - 1176.45) < 15, "L5").when(F.abs(mhz - 1575.42) < 15, "L1").when(F.abs(mhz - 2492.028) < 25, "S")
    return F.when(hz.isNotNull() & ~F.isnan(hz) & (F.abs(hz) < float("inf")), named.otherwise(F.format_string("%.1f MHz", mhz)))


def pseudonymise_id(raw: Column, key: str) -> Column:
    """HMAC-SHA-256 of an id under a secret key, in hex; null stays null."""
    import hashlib

    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, raw.cast("binary")), 256))), 256)
