"""The vocabulary of feature categories, and what follows from it.

The tables are fixed values: results depend on their spelling and order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.geometry import C, _c

# Values of the highway tag for each class of road.
ROADS = {
    "motorway": ("motorway", "motorway_link"),
    "trunk": ("trunk", "trunk_link"),
    "primary": ("primary", "primary_link"),
    "secondary": ("secondary", "secondary_link"),
    "residential": ("residential",),
    "service": ("service",),
    "footpath": ("footway", "path", "bridleway", "steps"),
    "cycleway": ("cycleway",),
    "track": ("track",),
}
# The road classes that are paths, and carriageways outside of all classes.
PATH_CLASSES = ("footpath", "cycleway", "track")
OTHER_CARRIAGEWAYS = ("tertiary", "tertiary_link", "unclassified", "living_street")
# The categories that can be selected, in their order.
CATEGORIES = ("buildings", *ROADS, "water", "vegetation_and_landuse", "rail", "boundaries", "points_of_interest")
# Fixed values: (key, pattern of the whole value or None for any) of the other categories.
TAGS = {
    "buildings": (("building", None),),
    "water": (("natural", "water"), ("waterway", None)),
    "vegetation_and_landuse": (("landuse", None), ("natural", "wood|scrub|heath|grassland|wetland"), ("leisure", "park|garden|nature_reserve|golf_course")),
    "rail": (("railway", None),),
    "boundaries": (("boundary", None),),
    "points_of_interest": (("amenity", None), ("shop", None), ("tourism", None)),
}
# Themed types that hold a category's features, and the order of types.
THEMED_TYPES = {
    "buildings": ("building",),
    "water": ("water",),
    "vegetation_and_landuse": ("land_use", "land_cover"),
    "points_of_interest": ("place", "infrastructure"),
}
ROAD_TYPES = ("segment", "connector")
TYPE_ORDER = ("building", "place", "segment", "connector", "infrastructure", "land_use", "land_cover", "water")
# What a land-use class counts as when parcels are classified.
LANDUSE = {
    "residential": "garden",
    "farmland": "field",
    "farmyard": "field",
    "meadow": "field",
    "pitch": "recreation",
    "park": "recreation",
    "playground": "recreation",
    "recreation_ground": "recreation",
    "recreation": "recreation",
    "retail": "retail",
    "industrial": "industrial",
    "quarry": "industrial",
    "school": "education",
    "education": "education",
    "religious": "religious",
    "cemetery": "religious",
    "allotments": "allotments",
    "grass": "greenspace_landuse",
}
# Buckets of evidence, the earlier of two equal ones winning.
BUCKETS = ("garden", "field", "recreation", "retail", "industrial", "education", "religious", "allotments", "greenspace_landuse", "water", "greenspace_os", "woodland")


def check(categories: Iterable[str] | None) -> list[str] | None:
    """None for everything, else the selection in the fixed order; empty and unknown ones are errors."""
    if categories is None:
        return None
    chosen = set(categories)
    if not chosen:
        raise ValueError("no category is selected")
    if unknown := sorted(chosen - set(CATEGORIES)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return [c for c in CATEGORIES if c in chosen]


def themed_types(category: C) -> Column:
    """Types to read for a column of one category: none for those without a type."""
    kinds = {**THEMED_TYPES, **dict.fromkeys(ROADS, ROAD_TYPES)}
    pairs = [x for c in CATEGORIES for x in (F.lit(c), F.array(*[F.lit(t) for t in kinds[c]]) if c in kinds else F.array().cast("array<string>"))]
    return F.element_at(F.create_map(*pairs), _c(category))


def in_type_order(types: C) -> Column:
    """An array of types, each once, in the fixed order."""
    return F.filter(F.array(*[F.lit(t) for t in TYPE_ORDER]), lambda t: F.array_contains(_c(types), t))


def matches(tags: C, categories: Iterable[str] | None) -> Column:
    """Whether a map of tags belongs to a selection; everything does without one."""
    chosen = check(categories)
    if chosen is None:
        return F.lit(True)
    t, found = _c(tags), F.lit(False)
    for c in chosen:
        for key, pattern in ((("highway", "|".join(ROADS[c])),) if c in ROADS else TAGS[c]):
            value = F.element_at(t, F.lit(key))
            found = found | (value.isNotNull() if pattern is None else F.coalesce(value.rlike(f"^({pattern})$"), F.lit(False)))
    return found


def road_family(highway: C) -> Column:
    """carriageway, path, or null for what is neither."""
    h = _c(highway)
    paths = [v for c in PATH_CLASSES for v in ROADS[c]]
    ways = [v for c in ROADS if c not in PATH_CLASSES for v in ROADS[c]] + list(OTHER_CARRIAGEWAYS)
    return F.when(h.isin(*ways), "carriageway").when(h.isin(*paths), "path")


def bucket_of(class_: C) -> Column:
    """Evidence bucket of a land-use class; null for one that counts for nothing."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANDUSE.items() for x in kv]), _c(class_))


def bucket_rank(bucket: C) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), _c(bucket))


def final_category(bucket: C, building: C) -> Column:
    """Name of a parcel's winning bucket; gardens with a building are housing, no evidence is unclassified."""
    b = _c(bucket)
    return F.when(b.isNull(), "unclassified").when((b == "garden") & _c(building), "housing").when(b.startswith("greenspace"), "greenspace").otherwise(b)
