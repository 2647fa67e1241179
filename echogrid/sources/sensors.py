"""Sensor metadata from documents of tagged records (XML), normalised by a table of fields.

Documents are parsed by Spark's own XML reader behind a few rules on the text;
what a field means is a row of FIELDS or PLACES, and one higher-order expression
rates all of them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The records that are read. Fixed values.
RECORDS = ("ACFTB", "EXPLTB", "MENSRB")
#: Bounds of a document: bytes and elements.
MOST_BYTES, MOST_NODES = 1 << 20, 4096
#: Feet in metres; how far directions may be from length one and right angles, and the cosine of the grazing angle from it.
FOOT = 0.3048
OFF_UNIT, OFF_SQUARE, OFF_GRAZE = 0.005, 0.005, 0.002


class Field(NamedTuple):
    """A number: its record and name, bounds, what makes the result's unit of it, or the field that names its unit; `least` bounds the result."""

    record: str
    field: str
    result: str
    low: float
    high: float
    factor: float = 1.0
    unit: str = ""
    least: float = float("-inf")


#: The extensions' fields with their bounds, units and results; pixels count from 1.
FIELDS = [
    Field("ACFTB", "ROW_SPACING", "row_spacing_m", -1e5, 1e6, unit="ROW_SPACING_UNITS", least=0),
    Field("ACFTB", "COL_SPACING", "column_spacing_m", -1e5, 1e6, unit="COL_SPACING_UNITS", least=0),
    Field("ACFTB", "ENTELV", "entry_elevation_m", -1e5, 1e6, unit="ELV_UNIT"),
    Field("ACFTB", "EXITELV", "exit_elevation_m", -1e5, 1e6, unit="ELV_UNIT"),
    Field("MENSRB", "ACFT_ALT", "aircraft_altitude_msl_m", 0, 999_999, FOOT),
    Field("MENSRB", "RP_ELV", "reference_elevation_msl_m", -1000, 30_000, FOOT),
    Field("EXPLTB", "ANGLE_TO_NORTH", "angle_to_north_deg", 0, 359.999),
    Field("EXPLTB", "SQUINT_ANGLE", "squint_deg", -60, 85),
    Field("EXPLTB", "GRAZE_ANG", "graze_deg", 0, 90),
    Field("EXPLTB", "SLOPE_ANG", "slope_deg", 0, 90),
    Field("MENSRB", "RP_ROW", "reference_row", 1, 99_999),
    Field("MENSRB", "RP_COL", "reference_column", 1, 99_999),
    Field("MENSRB", "COSGRZ", "cosine_graze", 0, 1),
    *[Field("MENSRB", f"{axis}_{part}", f"{axis}_{part}", -1, 1) for axis in ("C_R", "C_AZ", "C_AL") for part in ("NC", "EC", "DC")],
]
#: Places, all in the form +dd.d+ddd.d of latitude and longitude.
PLACES = [("ACFTB", "ENTLOC", "entry_lonlat"), ("ACFTB", "EXITLOC", "exit_lonlat"), ("MENSRB", "ACFT_LOC", "aircraft_lonlat"), ("MENSRB", "RP_LOC", "reference_lonlat")]
PLACE_FORM = r"^([+-]\d{2}\.\d+)([+-]\d{3}\.\d+)$"
#: Directions north, east, down.
AXES = {"range_ned": "C_R", "azimuth_ned": "C_AZ", "altitude_ned": "C_AL"}
#: Reference pixels and the image sizes that they must not exceed.
_PIXELS = ("reference_row", "reference_column")

_DOCUMENT = "tre array<struct<_name string, _location string, field array<struct<_name string, _value string>>>>"


def tagged_fields(xml: Column | str) -> Column:
    """map<record, map<field, value>> of the known image records of a document; empty for no document.

    A document that is too large, declares entities, is not well formed, has
    another root, or repeats a record or a field is an error. Other records are not looked at.
    """
    text = F.col(xml) if isinstance(xml, str) else xml
    tree = F.from_xml(text, _DOCUMENT, {"mode": "FAILFAST"})["tre"]
    known = F.filter(F.coalesce(tree, F.array().cast("array<struct<_name string, _location string, field array<struct<_name string, _value string>>>>")), lambda t: t["_name"].isin(*RECORDS) & (F.coalesce(t["_location"], F.lit("image")) == "image"))
    names = F.transform(known, lambda t: t["_name"])
    fields = F.transform(known, lambda t: F.coalesce(t["field"], F.array().cast("array<struct<_name string, _value string>>")))
    rules = [
        (F.octet_length(text) > MOST_BYTES, "the document is too large"),
        (text.rlike(r"(?i)<!\s*(doctype|entity)"), "the document declares entities"),
        (~text.rlike(r"^\s*(<\?xml[^>]*\?>)?\s*<tres[\s/>]") | (F.regexp_count(text, F.lit("<[A-Za-z]")) > MOST_NODES), "a bounded document of tagged records is expected"),
    ]
    after = [
        (F.size(F.array_distinct(names)) < F.size(names), "a record is repeated"),
        (F.exists(fields, lambda f: F.size(F.array_distinct(F.transform(f, lambda x: x["_name"]))) < F.size(f)), "a field is repeated"),
        (F.exists(fields, lambda f: F.exists(f, lambda x: x["_name"].isNull() | x["_value"].isNull() | (x["_name"] == ""))), "a field has no name or value"),
    ]
    kind = "map<string,map<string,string>>"
    read = F.map_from_arrays(names, F.transform(fields, lambda f: F.map_from_entries(f)))
    raised = lambda cases, value: reduce(lambda out, case: F.when(case[0], F.raise_error(F.lit(case[1])).cast(kind)).otherwise(out), reversed(cases), value)
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.create_map().cast(kind)).otherwise(raised(rules, raised(after, read)))


def _rated(tags: Column) -> Column:
    """array<struct(result, value, issue)> of all numbers: one expression over the table of fields."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(Field._fields, (*f[:3], *map(float, f[3:6]), f.unit, float(f.least)), strict=True)]) for f in FIELDS])

    def rate(d: Column) -> Column:
        record = F.try_element_at(tags, d["record"])
        text = F.nullif(F.trim(F.try_element_at(record, d["field"])), F.lit(""))
        value = text.try_cast("double")
        code = F.lower(F.trim(F.try_element_at(record, d["unit"])))
        factor = F.when(d["unit"] == "", d["factor"]).when(code == "m", 1.0).when(code == "f", FOOT)
        inside = value.between(d["low"], d["high"]) & ~F.isnan(value)
        issue = F.when(text.isNull(), None).when(value.isNull(), "not a number").when(~inside, "out of bounds").when(factor.isNull(), "unknown unit").when(value * factor <= d["least"], "not positive")
        return F.struct(d["result"].alias("result"), F.when(issue.isNull(), value * factor).alias("value"), F.concat(d["record"], F.lit("."), d["field"], F.lit(": "), issue).alias("issue"))

    return F.transform(table, rate)


def _placed(tags: Column) -> Column:
    """array<struct(result, value, issue)> of all places, as (longitude, latitude)."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("record", "field", "result"), p, strict=True)]) for p in PLACES])

    def rate(d: Column) -> Column:
        text = F.nullif(F.trim(F.try_element_at(F.try_element_at(tags, d["record"]), d["field"])), F.lit(""))
        lat, lon = (F.regexp_extract(text, PLACE_FORM, k).try_cast("double") for k in (1, 2))
        issue = F.when(text.isNull(), None).when(~text.rlike(PLACE_FORM), "unknown form").when(~(lat.between(-90, 90) & lon.between(-180, 180)), "out of bounds")
        return F.struct(d["result"].alias("result"), F.when(issue.isNull() & text.isNotNull(), F.array(lon, lat)).alias("value"), F.concat(d["record"], F.lit("."), d["field"], F.lit(": "), issue).alias("issue"))

    return F.transform(table, rate)


def _directions(values: Column) -> Column:
    """array<struct(name, vector, issue)> of the three directions."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(axis).alias("axis")) for name, axis in AXES.items()])

    def rate(d: Column) -> Column:
        parts = F.transform(F.lit(["_NC", "_EC", "_DC"]), lambda p: F.try_element_at(values, F.concat(d["axis"], p)))
        given = F.size(F.array_compact(parts))
        length = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * p))
        issue = F.when(given == 0, None).when(given < 3, "incomplete").when(F.abs(length - 1) > OFF_UNIT, "not of length one")
        return F.struct(d["name"].alias("name"), F.when(issue.isNull() & (given == 3), parts).alias("vector"), F.concat(F.lit("MENSRB."), d["axis"], F.lit(": "), issue).alias("issue"))

    return F.transform(table, rate)


def _skewed(directions: Column) -> Column:
    """Issues of pairs of directions that do not stand at right angles."""
    places = F.lit([[i, j] for i in range(len(AXES)) for j in range(i + 1, len(AXES))])

    def rate(p: Column) -> Column:
        a, b = F.get(directions, p[0]), F.get(directions, p[1])
        dot = F.aggregate(F.zip_with(a["vector"], b["vector"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.abs(dot) > OFF_SQUARE, F.concat(F.lit("MENSRB: "), a["name"], F.lit(" and "), b["name"], F.lit(" are not at right angles")))

    return F.transform(places, rate)


def sensor_metadata(documents: DataFrame, xml: str = "xml", rows: str | None = None, cols: str | None = None) -> DataFrame:
    """documents with the normalised values of their sensor records and `issues`, an array of what could not be used.

    Lengths become metres, places degrees (longitude, latitude), reference
    pixels count from 0 and must lie in images of `rows` and `cols`. A value
    outside its bounds, with an unknown unit or form is null and named among the
    issues; directions must have length one and stand at right angles, and the
    cosine of the grazing angle must agree with the angle. Built-in expressions
    alone; nothing here is a calibration.
    """
    own = documents.columns
    found = documents.withColumn("_tags", tagged_fields(xml)).withColumn("_rated", _rated(F.col("_tags"))).withColumn("_placed", _placed(F.col("_tags")))
    for made, rated in (("_values", "_rated"), ("_places", "_placed")):
        found = found.withColumn(made, F.map_from_arrays(F.transform(rated, lambda x: x["result"]), F.transform(rated, lambda x: x["value"])))
    found = found.withColumn("_directions", _directions(F.col("_values")))
    value = lambda name: F.col("_values")[name]
    fits = {n: (value(n) == F.floor(value(n))) & (value(n) <= F.col(limit) if limit else F.lit(True)) for n, limit in zip(_PIXELS, (rows, cols), strict=True)}
    pixels = {n: F.when(fit, (value(n) - 1).cast("int")) for n, fit in fits.items()}
    outside = [F.when(~fits[f.result], F.lit(f"{f.record}.{f.field}: outside the image")) for f in FIELDS if f.result in _PIXELS]
    graze = F.when(F.abs(F.cos(F.radians(value("graze_deg"))) - value("cosine_graze")) > OFF_GRAZE, "MENSRB.COSGRZ and EXPLTB.GRAZE_ANG disagree")
    issues = F.array_compact(F.concat(*[F.transform(c, lambda x: x["issue"]) for c in ("_rated", "_placed", "_directions")], F.array(*outside), _skewed(F.col("_directions")), F.array(graze)))
    plain = [value(f.result).alias(f.result) for f in FIELDS if f.result not in _PIXELS and f.result != f.field]
    vectors = [F.get("_directions", F.lit(k))["vector"].alias(n) for k, n in enumerate(AXES)]
    found = found.select(*own, *plain, *[c.alias(n) for n, c in pixels.items()], *[F.col("_places")[n].alias(n) for _, _, n in PLACES], *vectors, issues.alias("issues"), (F.size("_tags") > 0).alias("_known"))
    return found.withColumn("status", F.when(F.size("issues") > 0, "issues_found").when(F.col("_known"), "checked").otherwise("unavailable")).drop("_known")
