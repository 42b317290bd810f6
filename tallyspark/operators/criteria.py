"""Evaluation criteria as JSON with keys that aren't known beforehand: walked level by level within a row.

Rows are (id, text), each row a structure of its own; a level's values stay JSON texts until the next level opens them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are opened; what lies deeper is an error, not left out.
DEPTH = 6

# The fields of a criterion, the labels of what holds criteria, and the outline's head.
WEIGHT, DESCRIPTION = "weight", "description"
LABELS = ("Scope", "Category")
HEAD = "EVALUATION CRITERIA (preserve information relevant to these areas)"

REST = 2**31 - 1  # a length: all that follows


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marked(text: Column) -> Column:
    """A JSON text whose strings and keys each begin with an `s` more, so that they are told from other values when their
    quotes are gone."""
    literals = "|".join(rf"({q})((?:[^{q}\\]++|\\.)*+{q})" for q in "\"'")
    return F.regexp_replace(text, f"(?s){literals}", "$1$3s$2$4")


def unmarked(value: Column) -> Column:
    """A marked value as its JSON text, a string without quotes."""
    bare = F.regexp_replace(value, r'(?s)"s?((?:[^"\\]++|\\.)*+")', '"$1')
    return F.when(value.startswith("s"), F.substring(value, 2, REST)).when(value.startswith("{") | value.startswith("["), bare).otherwise(value)


def opened(text: Column) -> Column:
    """The fields of a `marked` JSON object in their order, as a map of marked keys and values; null for anything else."""
    return F.from_json(text, "map<string,string>")


def said(fields: Column) -> dict[str, Column]:
    """What an object's `opened` fields say of it: whether it has a weight or a description, what they are (a description
    is a string), and whether it has objects beside them."""
    held = lambda name: F.map_contains_key(fields, f"s{name}")
    value = lambda name: F.try_element_at(fields, F.lit(f"s{name}"))
    beside = F.exists(F.map_entries(fields), lambda e: e["value"].startswith("{") & ~e["key"].isin(f"s{WEIGHT}", f"s{DESCRIPTION}"))
    told = F.when(value(DESCRIPTION).startswith("s"), unmarked(value(DESCRIPTION)))
    return {"weighted": held(WEIGHT), "described": held(DESCRIPTION), "nests": F.coalesce(beside, F.lit(False)), "weight": unmarked(value(WEIGHT)), "description": told}


def walked(text: Column, stops: Callable[[dict], Column], made: Callable[[dict, dict | None, bool], Column | None], depth: int = DEPTH) -> Column:
    """Array of what `made` makes of every field of a text, each before those within it, down to the objects for which
    `stops` of what is `said` of them holds. `made` gets a field's depth, key and marked value, for an object what is said
    of it, and whether the walk stops there; of what it makes nothing of (None) only the fields within are in the array.
    Fields below `depth` levels raise an error; a text that isn't an object has none. An object is opened once."""

    def below(fields: Column, level: int, path: tuple[Column, ...]) -> Column:
        def field(e: Column) -> Column:
            key, value = F.substring(e["key"], 2, REST), e["value"]
            to, own = (*path, key), {"depth": level, "key": key, "value": value}
            plain = F.array(made(own, None, True))
            if level == depth:  # only a field that is there raises it
                return F.when(F.raise_error(F.concat(F.lit(f"more than {depth} levels: "), F.concat_ws("/", *to))).cast("boolean"), plain)

            def within(inner: Column) -> Column:
                here = lambda stopped: [F.array(x) for x in [made(own, said(inner), stopped)] if x is not None]
                on = [*here(False), below(inner, level + 1, to)]
                return F.when(stops(said(inner)), here(True)[0]).otherwise(F.concat(*on) if len(on) > 1 else on[0])

            return F.when(value.startswith("{"), once(opened(value), within)).otherwise(plain)

        return F.flatten(F.transform(F.map_entries(fields), field))

    return below(opened(marked(text)), 0, ())


def listed(value: Column) -> Column:
    """Whether a marked value that is no object is a criterion: a number, a text or a truth value, no list and no null."""
    return value.isNotNull() & ~value.startswith("[")


def outline(rows: DataFrame) -> DataFrame:
    """id, outline: criteria as a list indented by depth. A criterion is a number or a text, or an object with a weight and
    no objects beside; its description follows. Other objects are a scope at the top, a category below; lists and nulls are left out,
    a truth value is a criterion. Without a line there is no outline."""

    def line(f: dict, inner: dict | None, leaf: bool) -> Column:
        pad = "  " * f["depth"]
        if not leaf:
            return F.concat(F.lit(f"{pad}{LABELS[f['depth'] > 0]}: "), f["key"])
        bullet = F.concat(F.lit(f"{pad}- "), f["key"])
        if inner is None:
            return F.when(listed(f["value"]), bullet)
        return once(F.trim(F.coalesce(inner["description"], F.lit(""))), lambda told: F.when(told != "", F.concat(bullet, F.lit(f"\n{pad}  "), told)).otherwise(bullet))

    lines = F.array_join(walked(F.col("text"), lambda inner: inner["weighted"] & ~inner["nests"], line), "\n")
    # a filter of rows would be pushed below and walk each text a second time
    return rows.select("id", F.explode(F.filter(F.array(lines), lambda x: x != "")).alias("_lines")).select("id", F.concat(F.lit(HEAD + "\n"), "_lines").alias("outline"))


def criteria(rows: DataFrame, weight: Column) -> DataFrame:
    """id, name (in lower case), shown, weight, description: the criteria of a structure, of equal names the last one's
    weight and spelling, and the last description that isn't blank. An object with a weight or a description is a
    criterion, whatever else it holds; one whose weight isn't a number is left out. `weight` coerces the column `raw`."""

    def given(f: dict, inner: dict | None, leaf: bool) -> Column | None:
        if inner is None:
            return F.when(listed(f["value"]), F.struct(f["key"].alias("key"), unmarked(f["value"]).alias("raw"), F.lit(None).cast("string").alias("told")))
        return F.struct(f["key"].alias("key"), inner["weight"].alias("raw"), F.trim(inner["description"]).alias("told")) if leaf else None

    fields = rows.select("id", F.posexplode(walked(F.col("text"), lambda inner: inner["weighted"] | inner["described"], given)).alias("place", "f")).filter("f IS NOT NULL").select("id", "place", "f.*")
    found = fields.withColumn("weight", weight).filter("weight IS NOT NULL")
    named = found.withColumns({"name": F.lower(F.trim("key")), "_told": F.when(F.col("told") != "", F.col("told"))})
    return named.groupBy("id", "name").agg(F.max_by("key", "place").alias("shown"), F.max_by("weight", "place").alias("weight"), F.max_by("_told", F.when(F.col("_told").isNotNull(), F.col("place"))).alias("description"))
