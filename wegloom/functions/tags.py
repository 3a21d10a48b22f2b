"""Rules over tag maps as column expressions: road policies, access, directions, speeds, gates, kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wegloom.functions import constants as C

Policy = Callable[[Column], Column]


def tag(tags: Column, key: str, default: str | None = None) -> Column:
    value = F.try_element_at(tags, F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


def has(tags: Column, *keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    return out


def any_key(tags: Column, part: str) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.contains(part)), F.lit(False))


def first_tag(tags: Column, *keys: str) -> Column:
    return F.coalesce(*[tag(tags, k) for k in keys])


def metres(text: Column) -> Column:
    """The number of a plain width in metres, else null."""
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(m)?\s*$", 1).try_cast("double")


def access_ok(tags: Column) -> Column:
    """Whether the most specific access tag, if there is one, allows motor cars."""
    return F.coalesce(first_tag(tags, *C.ACCESS_KEYS).isin(*C.ALLOWED_ACCESS), F.lit(True))


def oneway_value(tags: Column) -> Column:
    return F.coalesce(first_tag(tags, "oneway:motorcar", "oneway:motor_vehicle", "oneway"), F.lit(""))


def width_reason(tags: Column) -> Column:
    """First of the width tags that can't be read or is under 3 m."""
    found = F.lit(None).cast("string")
    for k in reversed(C.WIDTH_KEYS):
        w = metres(tag(tags, k))
        found = F.when(has(tags, k) & w.isNull(), "width_unparsed_review").when(w < 3, "width_below_3m").otherwise(found)
    return found


def road_policy(tags: Column) -> Column:
    """'allowed', or the first reason why a way is no part of the road graph."""
    highway = tag(tags, "highway", "")
    local = highway.isin(*C.LOCAL_CLASSES)
    width = width_reason(tags)
    return (
        F.when(~highway.isin(*C.SPEED_KMH) | (tag(tags, "area", "") == "yes"), "excluded_class")
        .when(any_key(tags, "conditional") | has(tags, *C.DIRECTIONAL_ACCESS), "conditional_or_directional_access_review")
        .when(~access_ok(tags), "restricted_access")
        .when((tag(tags, "construction", "no") != "no") | (tag(tags, "proposed", "no") != "no"), "construction")
        .when(width.isNotNull(), width)
        .when(has(tags, *C.DIMENSION_KEYS), "vehicle_dimensions_review")
        .when(tag(tags, "surface", "").isin(*C.POOR_SURFACES) | tag(tags, "smoothness", "").isin(*C.POOR_SMOOTHNESS), "surface_review")
        .when(highway == "service", "service_requires_access_audit")
        .when(local & metres(tag(tags, "width")).isNull(), "local_width_missing")
        .when(~oneway_value(tags).isin("", "yes", "true", "1", "no", "false", "0", "-1"), "oneway_ambiguous")
        .otherwise("allowed")
    )


def access_policy(tags: Column) -> Column:
    """The more permissive rule for first access: service roads and unknown widths may pass, alleys don't."""
    highway = tag(tags, "highway")
    highway = F.when(highway == "service", "residential").otherwise(highway)
    wide = F.when(highway.isin("residential", "unclassified") & ~has(tags, "width"), F.create_map(F.lit("width"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    with_class = F.when(highway.isNull(), tags).otherwise(F.map_concat(F.map_filter(tags, lambda k, _: k != "highway"), F.create_map(F.lit("highway"), F.coalesce(highway, F.lit("")))))
    # the changed map is made once a row
    again = F.element_at(F.transform(F.array(F.map_concat(with_class, wide)), road_policy), 1)
    return (
        F.when(tag(tags, "name", "").rlike(r"(?i)^(gang\b|gg\.?\s)"), "named_alley")
        .when(tag(tags, "service", "").isin(*C.SERVICE_EXCLUDED), "service_subtype_review")
        .otherwise(again)
    )


def directions(tags: Column) -> Column:
    """Array of 1 (as drawn) and -1 (against it)."""
    value = oneway_value(tags)
    both, along = F.array(F.lit(1), F.lit(-1)), F.array(F.lit(1))
    return (
        F.when(value == "-1", F.array(F.lit(-1)))
        .when(value.isin("yes", "true", "1"), along)
        .when(value.isin("no", "false", "0"), both)
        .when((tag(tags, "junction", "") == "roundabout") | (tag(tags, "highway", "") == "motorway"), along)
        .otherwise(both)
    )


def class_speed(highway: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in C.SPEED_KMH.items() for x in (kv[0], float(kv[1]))]), highway)


def speed_tag(tags: Column, direction: Column) -> Column:
    own = F.when(direction == 1, tag(tags, "maxspeed:forward")).otherwise(tag(tags, "maxspeed:backward"))
    return F.coalesce(own, tag(tags, "maxspeed"))


def edge_speed(tags: Column, direction: Column) -> Column:
    """km/h of one direction; null if its tag can't be read."""
    text = speed_tag(tags, direction)
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*(km/h|mph)?$", 1).try_cast("double")
    number = number * F.when(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*(km/h|mph)?$", 2) == "mph", 1.609344).otherwise(1.0)
    plain = class_speed(tag(tags, "highway"))
    return F.when(text.isNull() | (text == ""), plain).when(number.isNull(), F.lit(None)).otherwise(F.least(plain, number))


def node_blocked(tags: Column) -> Column:
    """The strict rule for nodes: no access, a closed barrier, or a conditional tag."""
    return ~access_ok(tags) | ~tag(tags, "barrier", "no").isin(*C.OPEN_BARRIERS) | any_key(tags, "conditional")


def node_allowed(tags: Column) -> Column:
    """The rule for first access: a gate passes with explicit permission, unlocked, at all hours."""
    wide = F.lit(True)
    for k in C.WIDTH_KEYS:
        w = metres(tag(tags, k))
        wide = wide & (~has(tags, k) | F.coalesce(w >= 3, F.lit(False)))
    barrier = tag(tags, "barrier", "no")
    gate = barrier.isin(*C.GATES) & (tag(tags, "locked", "no") == "no") & (tag(tags, "opening_hours", "24/7") == "24/7") & F.coalesce(first_tag(tags, *C.ACCESS_KEYS).isin(*C.ALLOWED_ACCESS), F.lit(False))
    return access_ok(tags) & ~any_key(tags, "conditional") & ~has(tags, *C.DIMENSION_KEYS) & wide & (barrier.isin(*C.OPEN_BARRIERS) | gate)


def signal(node_tags: Column) -> Column:
    return tag(node_tags, "highway", "") == "traffic_signals"


def level_crossing(node_tags: Column, way_tags: Column) -> Column:
    return (tag(node_tags, "railway", "") == "level_crossing") & (tag(way_tags, "bridge", "no") == "no") & (tag(way_tags, "tunnel", "no") == "no")


def grade_separated(tags: Column) -> Column:
    off = ("no", "false", "0")
    return ~tag(tags, "bridge", "no").isin(*off) | ~tag(tags, "tunnel", "no").isin(*off)


def is_hospital(tags: Column) -> Column:
    return (tag(tags, "amenity", "") == "hospital") | (tag(tags, "healthcare", "") == "hospital")


def poi_kind(tags: Column) -> Column:
    return F.when(tag(tags, "amenity") == "school", "school").when(tag(tags, "amenity") == "marketplace", "market").when(tag(tags, "shop") == "mall", "mall")


def slim(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin("highway", "name"))
