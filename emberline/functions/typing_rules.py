"""Controlled vocabularies: facility type from tags, land-cover class from properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical facility types.
FACILITY_TYPES = ["refinery", "power_plant", "factory", "industrial_area", "oil_gas", "chemical", "steel", "cement",
                  "warehouse", "other"]
# industrial=* value -> type; order matters for substring matches.
INDUSTRIAL_VALUES = {
    "refinery": "refinery", "oil": "oil_gas", "gas": "oil_gas", "petroleum": "oil_gas", "chemical": "chemical",
    "steel": "steel", "cement": "cement", "factory": "factory", "warehouse": "warehouse",
    "industrial": "industrial_area", "industrial_area": "industrial_area", "plant": "power_plant",
    "power_plant": "power_plant", "works": "factory", "manufacturing": "factory",
}
# Generator sources that burn or fission something.
THERMAL_SOURCES = ["coal", "gas", "oil", "diesel", "biomass", "waste", "combustion", "nuclear", "cogeneration"]
# Tank contents that make an oil and gas site.
TANK_CONTENTS = ["oil", "gas", "chemical", "petroleum", "fuel"]
# man_made=* value -> type.
MAN_MADE_VALUES = {"works": "factory", "factory": "factory", "industrial": "industrial_area"}
# Land-cover word -> class; order matters for substring matches.
LANDCOVER_WORDS = {
    "forest": "forest", "wood": "forest", "woods": "forest", "tree": "forest", "trees": "forest",
    "forestry": "forest", "jungle": "forest",
    "agriculture": "agriculture", "agricultural": "agriculture", "farmland": "agriculture", "farm": "agriculture",
    "cropland": "agriculture", "field": "agriculture", "meadow": "agriculture", "orchard": "agriculture",
    "plantation": "agriculture",
    "industrial": "industrial", "built-up": "industrial", "builtup": "industrial", "urban": "industrial",
    "residential": "industrial", "commercial": "industrial", "built_up": "industrial",
    "water": "water", "lake": "water", "river": "water", "sea": "water", "ocean": "water", "wetland": "water",
    "bare": "bare", "barren": "bare", "desert": "bare", "bare_land": "bare", "sand": "bare",
    "grass": "other", "grassland": "other", "shrub": "other",
}
LANDCOVER_CLASSES = ["forest", "agriculture", "industrial", "water", "bare", "other", "unknown"]
LANDCOVER_KEYS = ["class", "landcover", "land_cover", "type", "landuse", "category", "natural", "cover"]


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _chain(pairs: list[tuple[Column, Column | str]]) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, F.lit(value) if isinstance(value, str) else value)
    return out


def _exact_then_contains(value: Column, words: dict[str, str]) -> Column:
    """Lookup of the whole value, else of the first listed word it contains."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    listed = F.array(*[F.lit(w) for w in words])
    inside = F.get(F.filter(listed, lambda w: F.contains(value, w)), F.lit(0))
    return F.coalesce(F.try_element_at(table, value), F.try_element_at(table, inside))


def facility_type(tags: Column) -> Column:
    """struct(facility_type, original_type) from a tag map, by fixed tag priority."""
    def tag(key: str) -> Column:
        return _present(F.try_element_at(tags, F.lit(key)))

    def low(key: str) -> Column:
        return F.lower(F.trim(tag(key)))

    explicit = None
    for key in ("facility_type", "type", "canonical_type"):
        hit = F.when(F.lower(tag(key)).isin(FACILITY_TYPES), tag(key))
        explicit = hit if explicit is None else F.coalesce(explicit, hit)
    industrial, power, landuse, man_made = low("industrial"), low("power"), low("landuse"), low("man_made")
    by_industrial = _exact_then_contains(industrial, INDUSTRIAL_VALUES)
    thermal = F.coalesce(low("generator:source").isin(THERMAL_SOURCES), F.lit(False))
    content = F.coalesce(low("content"), F.lit(""))
    building = F.lower(tag("building"))
    loose = [k for k in ("industrial", "landuse", "man_made", "building")]
    steps: list[tuple[Column, Column | str, Column]] = [
        (explicit.isNotNull(), F.lower(explicit), explicit),
        (by_industrial.isNotNull(), by_industrial, industrial),
        (power == "generator", F.when(thermal, "power_plant").otherwise("other"), power),
        (power.isin("plant", "power_plant"), "power_plant", power),
        (landuse == "industrial", "industrial_area", landuse),
        (man_made == "storage_tank", F.when(content.isin(TANK_CONTENTS), "oil_gas").otherwise("other"), man_made),
        *[(man_made == k, v, man_made) for k, v in MAN_MADE_VALUES.items()],
        (man_made.contains("works"), "factory", man_made),
        (building == "warehouse", "warehouse", tag("building")),
        (building == "industrial", "factory", tag("building")),
        *[(F.lower(tag(k)).contains("industrial"), "industrial_area", F.lower(tag(k))) for k in loose],
    ]
    kind = _chain([(c, v) for c, v, _ in steps]).otherwise("other")
    original = _chain([(c, o) for c, _, o in steps]).otherwise(
        F.coalesce(tag("industrial"), tag("landuse"), tag("man_made")))
    return F.struct(kind.alias("facility_type"), original.alias("original_type"))


def is_relevant(tags: Column) -> Column:
    """Industrial or thermal objects only; every generator is dropped (plants stand for them)."""
    def tag(key: str) -> Column:
        return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))

    wanted = (F.coalesce(F.map_contains_key(tags, "industrial"), F.lit(False))
              | (tag("landuse") == "industrial") | (tag("building") == "industrial")
              | tag("man_made").isin("works", "petroleum_well", "storage_tank")
              | tag("power").isin("plant", "substation"))
    return wanted & (tag("power") != "generator")


def landcover_class(props: Column) -> Column:
    """Canonical class from a property map; keys are tried in order, unknown without any key."""
    keys = F.array(*[F.lit(k) for k in LANDCOVER_KEYS])
    values = F.array_compact(F.transform(keys, lambda k: F.lower(F.trim(_present(F.try_element_at(props, k))))))

    def resolve(word: Column) -> Column:
        return F.coalesce(_exact_then_contains(word, LANDCOVER_WORDS), F.when(word.isin(LANDCOVER_CLASSES), word))

    found = F.get(F.filter(F.transform(values, resolve), lambda c: c.isNotNull()), F.lit(0))
    return F.when(F.size(values) == 0, "unknown").otherwise(F.coalesce(found, F.lit("other")))
