"""Weighted scoring of proposals, on rows (contractor, scope, criterion, weight, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.tables import exact_sum

# The grades from level 1 to 10, and the two of binary criteria.
GRADES = ("Major Concerns", "Serious Concerns", "High Concerns", "Minor-Moderate Concerns", "Moderate Confidence", "Sound Confidence", "Good Confidence", "Very Good Confidence", "Excellent Confidence", "Outstanding")
BINARY_GRADES = {"Non-Compliant": 0, "Compliant": 100}


def grade_level(grade: Column) -> Column:
    """The level from 1 to 10 of a grade by number (7), by number and text ("7 - text"), or by label; else null. Binary
    labels have no level."""
    text = F.trim(grade)
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d{1,2})$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^(\d{1,2})\s*[-–—:]\s*.+$", 1), F.lit(""))).cast("int")
    names = F.create_map(*(F.lit(x) for n, g in enumerate(GRADES, 1) for x in (g.lower(), n)))
    named = F.coalesce(F.element_at(names, label(grade)), F.element_at(names, bare(label(grade))))
    return F.when(number.between(1, 10), number).when(~F.coalesce(text.rlike(r"^\d{1,2}$"), F.lit(False)), named)


def label(grade: Column) -> Column:
    """A label in lower case with plain dashes, single spaces, and spaces around slashes."""
    dashes = F.translate(F.lower(F.trim(grade)), "–—‑", "---")
    return F.regexp_replace(F.regexp_replace(dashes, r"\s*/\s*", " / "), r"\s+", " ")


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s/+-]", "")


def grade_score(grade: Column) -> Column:
    """Points from 0 to 100 of a graded level or a binary label; else null."""
    points = F.create_map(*(F.lit(x) for g, n in BINARY_GRADES.items() for x in (g.lower(), n)))
    binary = F.coalesce(F.element_at(points, label(grade)), F.element_at(points, bare(label(grade))))
    return F.coalesce(grade_level(grade) * 10, binary)


def next_grade(grade: Column) -> Column:
    """The label of the next better level; null at the top and for what is no level."""
    return F.get(F.array(*map(F.lit, GRADES)), grade_level(grade))


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def coerce_weight(text: Column) -> Column:
    """A weight written as text: a whole number as it is; else what is left of digits and points, with commas read as
    points, so a sign goes; else null."""
    plain = F.trim(text)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double")).otherwise(F.regexp_replace(F.replace(plain, F.lit(","), F.lit(".")), r"[^0-9.]", "").try_cast("double"))


def report_weight(text: Column) -> Column:
    """A weight for a report: commas read as points, signs kept, 0 for what is no number."""
    return F.coalesce(F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def parsed_weight(text: Column) -> Column:
    """value and percent: Arabic digits are read, signs kept, and a percent sign is remembered; null for no number."""
    western = F.translate(F.trim(text), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    value = F.regexp_replace(F.replace(western, F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.contains(western, F.lit("%")).alias("percent")))


def to_percent(value: Column, percent: Column) -> Column:
    """A weight in percent: with a percent sign as it is, up to 1 a fraction, whole hundreds scaled twice."""
    hundreds = (value > 100) & (F.abs(value / 100 - F.rint(value / 100)) < 1e-9) & (value / 100 <= 100)
    return F.when(percent, value).when(value <= 1, value * 100).when(hundreds, value / 100).otherwise(value)


def scale_weights(rows: DataFrame, *keys: str) -> DataFrame:
    """Weights of all criteria of a rubric (`keys`) as percent, to six places: their sum tells whether they are percent,
    fractions or scaled twice; else each is read by itself."""
    total = rows.groupBy(*keys).agg(exact_sum(F.col("weight"), 8).alias("_sum"))
    by = F.when(F.col("_sum").between(80, 120), 1.0).when(F.col("_sum").between(0.8, 1.2), 100.0).when(F.col("_sum").between(8000, 12000), 0.01)
    joined = rows.join(total, list(keys)) if keys else rows.crossJoin(total)
    return joined.withColumn("percent", F.round(F.coalesce(F.col("weight") * by, to_percent(F.col("weight"), F.lit(False))), 6)).drop("_sum")


def scope_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contractor", "scope").agg(exact_sum(F.coalesce("score", F.lit(0.0)) * F.col("weight") / 100).alias("total"))


def contractor_ranks(rows: DataFrame) -> DataFrame:
    """Contractors by total, best first; only one row per contractor meets in the window."""
    sums = scope_totals(rows).groupBy("contractor").agg(exact_sum(F.col("total")).alias("total"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "contractor")))


def weighted_means(rows: DataFrame) -> DataFrame:
    """Per contractor and scope over scored criteria only; null without weight."""
    scored = rows.filter("score IS NOT NULL")
    return scored.groupBy("contractor", "scope").agg((exact_sum(F.col("score") * F.col("weight")) / F.nullif(exact_sum(F.col("weight")), F.lit(0.0))).alias("mean"))


def zero_flags(rows: DataFrame) -> DataFrame:
    share = F.count_if(F.col("score") == 0) / F.count("*")
    return rows.groupBy("contractor").agg(share.alias("zero_share"), (share > 0.5).alias("flagged"))


#: Criteria of one evaluation; more are an error.
MOST_CRITERIA = 10_000


def answer_grid(rows: DataFrame, *criterion: str) -> DataFrame:
    """Each contractor with each criterion that anybody answers. The criteria are counted before they go to every task;
    ValueError where they are too many for one evaluation."""
    criteria = rows.select(*criterion).distinct()
    if criteria.limit(MOST_CRITERIA + 1).count() > MOST_CRITERIA:
        raise ValueError(f"more than {MOST_CRITERIA} criteria")
    return rows.select("contractor").distinct().crossJoin(F.broadcast(criteria))


def approvals(rows: DataFrame, least: float) -> DataFrame:
    """Share of the whole contractor x criterion grid that reaches a score, rounded half up to whole percent."""
    joined = answer_grid(rows, "scope", "criterion").join(rows, ["contractor", "scope", "criterion"], "left")
    return joined.groupBy("contractor").agg(F.floor(F.count_if(F.col("score") >= least) / F.count("*") * 100 + 0.5).cast("long").alias("approved_pct"))


def missing_scores(rows: DataFrame) -> DataFrame:
    return answer_grid(rows, "scope", "criterion").join(rows, ["contractor", "scope", "criterion"], "left_anti")


def normalize_weights(weights: Column, step: float = 0.5, least: float = 1.0) -> Column:
    """One rubric's weights (array) scaled to 100 in whole steps, halves up, at least `least`; what is over or missing
    is dealt a step at a time in order, passing over weights at the least. Null where the weights are empty or the least
    ones alone exceed 100."""
    whole, floor = round(100 / step), round(least / step)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # a value that is computed once
    rounded = lambda total: F.transform(weights, lambda w: F.greatest(F.lit(floor), F.when(total > 0, F.floor(w / total * whole + 0.5)).otherwise(F.rint(F.lit(float(whole)) / F.size(weights))).cast("int")))
    steps = once(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), rounded)

    def deal(given: Column) -> Column:
        return once(F.lit(whole) - F.aggregate(given, F.lit(0), lambda a, s: a + s), lambda off: dealt(given, off))

    def dealt(given: Column, off: Column) -> Column:
        n = F.size(given)
        # rounds of one step for each weight that can move; each deals a step at least, so no more than steps are off
        rounds = F.slice(F.sequence(F.lit(1), F.lit(whole)), F.lit(1), F.least(F.abs(off), F.lit(whole)))

        def one_round(state: Column, _: Column) -> Column:
            now, left = state["steps"], state["left"]
            free = F.transform(now, lambda s: ((left > 0) | (s > floor)).cast("int"))
            before = F.transform(free, lambda f, i: F.aggregate(F.slice(free, 1, i), F.lit(0), lambda a, x: a + x))
            moved = F.transform(now, lambda s, i: s + F.when((F.get(free, i) == 1) & (F.get(before, i) < F.abs(left)), F.signum(left).cast("int")).otherwise(0))
            used = F.aggregate(free, F.lit(0), lambda a, f: a + f)
            return F.when(left == 0, state).otherwise(F.struct(moved.alias("steps"), (left - F.signum(left).cast("int") * F.least(used, F.abs(left))).alias("left")))

        return F.when(n > 0, F.aggregate(rounds, F.struct(given.alias("steps"), off.alias("left")), one_round)["steps"])

    return F.when((F.size(weights) > 0) & (F.size(weights) * least <= 100), F.transform(once(steps, deal), lambda s: s * F.lit(step)))


def normalized_rubrics(rows: DataFrame) -> DataFrame:
    """rubric, weights (array) -> normalized; a rubric has at most 100 criteria."""
    return rows.withColumn("normalized", normalize_weights(F.col("weights")))


def weighted_totals(rows: DataFrame) -> DataFrame:
    """Each contractor's sum of score x weight / 100 over all criteria; a missing score counts 0."""
    scored = answer_grid(rows, "scope", "criterion", "weight").join(rows.select("contractor", "scope", "criterion", "score"), ["contractor", "scope", "criterion"], "left")
    return scored.groupBy("contractor").agg(exact_sum(F.coalesce("score", F.lit(0.0)) * F.col("weight") / 100).alias("total"))


def scope_weights(rows: DataFrame) -> DataFrame:
    """What the weights, written as text, of each scope add up to."""
    return rows.groupBy("scope").agg(exact_sum(report_weight(F.col("weight"))).alias("weight"))


def flatten_criteria(scopes: DataFrame) -> DataFrame:
    """scope, criteria (array of name and weight) -> scope, criterion, weight, ord."""
    return scopes.select("scope", F.posexplode("criteria").alias("ord", "c")).select("scope", F.col("c.name").alias("criterion"), F.col("c.weight").alias("weight"), "ord")


def progress(rows: DataFrame) -> DataFrame:
    """Scored criteria of each contractor against all."""
    return rows.groupBy("contractor").agg(F.count("score").alias("done"), F.count("*").alias("total"), (F.count("score") / F.count("*")).alias("ratio"))


def rubric_errors(rows: DataFrame) -> DataFrame:
    """What is wrong with each rubric (scope): no criteria, unnamed ones, weights that aren't positive or don't come to
    100, names twice."""
    per = rows.groupBy("scope").agg(
        F.count("criterion").alias("n"), F.count_distinct(F.lower("criterion")).alias("names"), F.count_if(F.coalesce(F.trim(F.col("criterion").cast("string")) == "", F.lit(True))).alias("unnamed"), F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False))).alias("bad"), exact_sum(F.coalesce("weight", F.lit(0.0))).alias("sum")
    )
    error = F.when(F.col("unnamed") > 0, "unnamed criterion").when(F.col("bad") > 0, "weight not positive").when(F.col("n") != F.col("names"), "criterion twice").when(F.abs(F.col("sum") - 100) > 0.01, "weights not 100")
    return per.select("scope", error.alias("error"), error.isNull().alias("valid"))


def answer_errors(rows: DataFrame) -> DataFrame:
    """What is wrong with a graded answer (grade, score, reasoning: array of text and source)."""
    error = F.when(grade_score(F.col("grade")).isNull(), "grade").when(~F.coalesce(F.col("score").between(0, 100), F.lit(False)), "score").when(~F.coalesce(F.size("reasoning") > 0, F.lit(False)), "reasoning")
    error = error.when(~F.forall("reasoning", lambda r: F.coalesce((F.trim(r["text"]) != "") & (F.trim(r["source"]) != ""), F.lit(False))), "source")
    return rows.withColumn("error", error)


def by_scope(rows: DataFrame) -> DataFrame:
    """Criteria tables row by row (at, scope): a blank scope is the last one named before, at the start Unscoped."""
    named = F.last(F.nullif(F.trim("scope"), F.lit("")), True).over(Window.partitionBy("table").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("scope", F.coalesce(named, F.lit("Unscoped")))


def last_wins(results: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Results merged by key: the last one counts."""
    return results.groupBy(key).agg(F.max_by(value, order).alias(value))


def document_errors(items: DataFrame) -> DataFrame:
    """item, errors (array of contractor and error) -> one row for each item with its errors as one text."""
    text = F.array_join(F.transform("errors", lambda e: F.concat(e["contractor"], F.lit(": "), e["error"])), "; ")
    return items.select("item", F.coalesce(text, F.lit("")).alias("message"))


def first_by_name(rows: DataFrame) -> DataFrame:
    """The first contractor of each name, whatever its case and spaces."""
    return rows.withColumn("key", F.regexp_replace(F.lower(F.trim("name")), r"\s+", " ")).groupBy("key").agg(F.min_by("contractor", "at").alias("contractor"))
