"""Comparison of bids: matching, totals, variances, warnings and normalisation, on long relations.

Bids are rows (vendor, vendor_ord, division, grouping, sub_group, item, idx, qty, rate, amount, raw). An item's place is
division, grouping, sub-group, id and position, as ids repeat. Ties follow two rules: the flags of an item go to the last
vendor in order, those of a total to the first. A price counts where it is above 0; a vendor prices an item where its
rate or amount isn't null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numbers import round_half_even
from tallyspark.sources.tables import exact_sum

CAP, LEAST_LOW = 500.0, 0.01
PLACE = ("division", "grouping", "sub_group", "item", "idx")
#: Vendors of one tender; a table with more isn't one.
MOST_VENDORS = 10_000


def amount_of() -> Column:
    return F.coalesce("amount", F.col("qty") * F.col("rate"))


def vendors_of(bids: DataFrame) -> Column:
    """The vendors of the bids as an array; ValueError where they are too many for one tender."""
    names = [r[0] for r in bids.select("vendor").distinct().orderBy("vendor").limit(MOST_VENDORS + 1).collect()]
    if len(names) > MOST_VENDORS:
        raise ValueError(f"more than {MOST_VENDORS} vendors")
    return F.array(*map(F.lit, names)).cast("array<string>")


def placed(bids: DataFrame) -> DataFrame:
    """Bids whose place is known in full; others are in no template's place."""
    return bids.dropna(subset=list(PLACE))


def places(template: DataFrame, sums: DataFrame, how: str = "left") -> DataFrame:
    """The template's places with the bids' figures by place. Neither side is broadcast: Spark's estimate of a template is
    that of the compressed parts it comes from."""
    return template.select(*PLACE).hint("merge").join(sums, list(PLACE), how)


def folded(rows: DataFrame) -> DataFrame:
    """Add the names of a place as they are compared: in upper case, null as an empty one."""
    return rows.withColumns({f"_{k}": F.upper(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in PLACE[:4]})


def match_cascade(template: DataFrame, bids: DataFrame, by_sub_group: bool = True) -> DataFrame:
    """Each template place and vendor with the vendor's rate and amount and the tier that found them (null: none): the
    same place; else the same id in division, grouping and sub-group (where `by_sub_group`); else in division and
    grouping; else in the division.

    A line's place keeps the position of its first and the figures of its last occurrence; later tiers take the first
    position. All tiers imply equal division and id, so one equi-join finds the candidates of them all; both sides are
    dealt by these once, each place of the template is there once, and the vendors without any candidate come last.
    """
    keys, by = [f"_{k}" for k in PLACE[:4]], ["_division", "_item"]
    lines = folded(bids).filter("vendor IS NOT NULL").repartition(*by).groupBy("vendor", *keys, "idx").agg(F.max_by(F.struct("rate", "amount"), "ord").alias("hit"), F.min("ord").alias("ord"))
    lines = lines.select("vendor", *by, F.col("_grouping").alias("_g"), F.col("_sub_group").alias("_s"), F.col("idx").alias("_i"), "hit", "ord")
    joined = folded(template.select(*PLACE)).repartition(*by).distinct().hint("merge").join(lines, by, "left")
    grouping, sub_group = F.col("_g") == F.col("_grouping"), F.col("_s") == F.col("_sub_group")
    tier = F.when(grouping & sub_group & (F.col("_i") == F.col("idx")), 1)
    if by_sub_group:
        tier = tier.when(grouping & sub_group, 2).when(grouping, 3).when(F.col("_g").isNotNull(), 4)
    else:
        tier = tier.when(grouping, 2).when(F.col("_g").isNotNull(), 3)
    found = joined.withColumn("tier", tier).groupBy(*by, *PLACE, "vendor").agg(F.min_by(F.struct("hit", "tier"), F.struct("tier", "ord")).alias("b"))
    found = found.groupBy(*by, *PLACE).agg(F.collect_list(F.when(F.col("vendor").isNotNull(), F.struct("vendor", "b"))).alias("_own"))
    others = F.transform(F.array_except(vendors_of(bids), F.transform("_own", lambda o: o["vendor"])), lambda v: F.struct(v.alias("vendor"), F.lit(None).alias("b")))
    found = found.select(*PLACE, F.inline(F.concat("_own", others)))
    return found.select(*PLACE, "vendor", F.col("b.hit.rate").alias("rate"), F.col("b.hit.amount").alias("amount"), F.col("b.tier").alias("match_tier"))


def item_flags(bids: DataFrame, rate: str = "rate") -> DataFrame:
    """Per place: lowest and highest positive rate, who bid them (the last vendor of a tie), their difference, and the
    capped variance."""
    value = F.col(rate)
    out = bids.filter(value > 0).groupBy(*PLACE).agg(
        F.min(value).alias("low_rate"), F.max(value).alias("high_rate"), F.max_by("vendor", F.struct(-value, "vendor_ord")).alias("low_bidder"), F.max_by("vendor", F.struct(value, "vendor_ord")).alias("high_bidder"), F.count("*").alias("n_valid")
    )
    spread = F.col("high_rate") - F.col("low_rate")
    return out.withColumns({"spread": spread, "variance_pct": F.when(F.col("low_rate") > LEAST_LOW, F.least(spread / F.col("low_rate") * 100.0, F.lit(CAP)))})


def rates_pivot(bids: DataFrame, vendors: list[str]) -> DataFrame:
    return bids.groupBy(*PLACE).pivot("vendor", vendors).agg(F.max("rate"))


def rates_unpivot(pivoted: DataFrame, vendors: list[str]) -> DataFrame:
    """A row for each vendor's column with a price."""
    return pivoted.unpivot(list(PLACE), vendors, "vendor", "rate").filter("rate IS NOT NULL")


def totals(bids: DataFrame, *keys: str) -> DataFrame:
    """keys, vendor, vendor_ord, total; summed before the shuffle."""
    return bids.groupBy(*keys, "vendor", "vendor_ord").agg(exact_sum(F.coalesce(amount_of(), F.lit(0.0))).alias("total"))


def with_bidders(sums: DataFrame, *keys: str) -> DataFrame:
    """Add low_bidder and high_bidder over totals above 0; the first vendor of a tie."""
    best = sums.filter("total > 0").groupBy(*keys).agg(F.min_by("vendor", F.struct("total", "vendor_ord")).alias("low_bidder"), F.max_by("vendor", F.struct(F.col("total"), -F.col("vendor_ord"))).alias("high_bidder"))
    return sums.join(best, list(keys), "left").select(*keys, "vendor", "total", "low_bidder", "high_bidder")


def fast_totals(bids: DataFrame, left_out: tuple[str, ...] = ("TEMPLATE", "PTE")) -> DataFrame:
    """division, vendor, total of the divisions in which any vendor's total isn't 0, with the low and the high bidder over
    the vendors' totals of the whole project, 0 included and the names `left_out` not; the first vendor of a tie."""
    sums = totals(bids, "division")
    shown = sums.groupBy("division").agg(F.bool_or(F.col("total") != 0).alias("shown")).filter("shown").drop("shown")
    counts = ~F.col("vendor").isin(*left_out)
    every = Window.partitionBy()  # a row for each vendor
    best = lambda pick, *key: pick("vendor", F.when(counts, F.struct(*key))).over(every)
    project = totals(bids).select("vendor", best(F.min_by, "total", "vendor_ord").alias("low_bidder"), best(F.max_by, F.col("total"), -F.col("vendor_ord")).alias("high_bidder"))
    return sums.join(shown, "division").join(project, "vendor").select("division", "vendor", "total", "low_bidder", "high_bidder")


def sub_group_view(bids: DataFrame) -> DataFrame:
    """Totals by sub-group, without groupings whose only sub-group is GENERAL. The low side needs a total above 0, the
    high side doesn't; the first vendor of a tie."""
    keys = ["division", "grouping", "sub_group"]
    named = bids.withColumn("sub_group", F.coalesce("sub_group", F.lit("GENERAL")))
    sums = totals(named, *keys)
    shown = named.groupBy("division", "grouping").agg(F.bool_or(F.col("sub_group") != "GENERAL").alias("shown")).filter("shown").drop("shown")
    best = sums.groupBy(*keys).agg(
        F.min_by(F.when(F.col("total") > 0, F.col("vendor")), F.when(F.col("total") > 0, F.struct("total", "vendor_ord"))).alias("low_bidder"), F.max_by("vendor", F.struct(F.col("total"), -F.col("vendor_ord"))).alias("high_bidder")
    )
    return sums.join(best, keys).join(shown, ["division", "grouping"], "left_semi").select(*keys, "vendor", "total", "low_bidder", "high_bidder")


def division_totals(bids: DataFrame) -> DataFrame:
    """What each vendor's divisions add up to, what the bid states, and which counts; items, and how many of them have
    a text in place of figures."""
    sums = bids.groupBy("division", "vendor", "vendor_ord").agg(
        exact_sum(F.coalesce(amount_of(), F.lit(0.0))).alias("calculated"), exact_sum(F.col("extracted")).alias("extracted"), F.count("*").alias("items"), F.count_if(amount_of().isNull() & (F.coalesce("raw", F.lit("")) != "")).alias("raw_only")
    )
    return sums.withColumn("total", F.when(F.col("extracted") > 0, F.col("extracted")).otherwise(F.col("calculated")))


def project_totals(divisions: DataFrame, stated: DataFrame) -> DataFrame:
    """Each vendor's project total: the stated one (vendor, stated) where above 0, else what the divisions' totals add
    up to where above 0, else what was calculated; with the bidders of the lowest and highest."""
    sums = divisions.groupBy("vendor", "vendor_ord").agg(exact_sum(F.col("total")).alias("divisions"), exact_sum(F.col("calculated")).alias("calculated"))
    total = F.when(F.col("stated") > 0, F.col("stated")).when(F.col("divisions") > 0, F.col("divisions")).otherwise(F.col("calculated"))
    named = sums.join(stated, "vendor", "left").withColumn("total", total).withColumn("project", F.lit(1))
    return with_bidders(named, "project").drop("project").join(named.select("vendor", "calculated"), "vendor")


def benchmark_totals(items: DataFrame, *levels: str) -> DataFrame:
    """The benchmark's amounts by level; null where they don't exceed 0."""
    total = exact_sum(F.coalesce(amount_of(), F.lit(0.0)))
    return items.groupBy(*levels).agg(F.when(total > 0, total).alias("benchmark_total"))


def stated_or_sum(stated: DataFrame, divisions: DataFrame, *keys: str) -> DataFrame:
    """A project's stated total, else the sum of its divisions', null where that is 0."""
    sums = divisions.groupBy(*keys).agg(F.nullif(exact_sum(F.coalesce("total", F.lit(0.0))), F.lit(0.0)).alias("sum"))
    return sums.join(stated, list(keys), "full").select(*keys, F.coalesce("stated", "sum").alias("project_total"))


def ranked_totals(bids: DataFrame) -> DataFrame:
    """Vendors by total, with the index to the lowest, and the width of a bar against the highest, the benchmark's
    included. One row per vendor meets in the window."""
    sums = totals(bids).filter("total > 0").crossJoin(F.broadcast(bids.agg(exact_sum(F.coalesce(F.col("qty") * F.col("benchmark_rate"), F.lit(0.0))).alias("benchmark"))))
    every = Window.orderBy("total", "vendor_ord")
    lowest = F.col("total") / F.min("total").over(Window.partitionBy()) * 100.0
    highest = F.greatest(F.max("total").over(Window.partitionBy()), "benchmark", F.lit(1.0))
    return sums.select("vendor", "total", F.row_number().over(every).alias("rank"), lowest.alias("price_index"), (lowest - 100.0).alias("over_lowest"), F.least(F.col("total") / highest * 100.0, F.lit(100.0)).alias("bar_width"))


def lowest_per_division(bids: DataFrame) -> DataFrame:
    """The lowest total of each division and who bid it; the first of a tie, totals of 0 included."""
    return totals(bids, "division").groupBy("division").agg(F.min_by(F.struct("vendor", "total"), F.struct("total", "vendor_ord")).alias("b")).select("division", "b.vendor", "b.total")


def variance_summary(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("items"), F.count_if(F.col("variance_pct") > 0).alias("with_variance"), F.median(F.when(F.col("variance_pct") > 0, F.col("variance_pct"))).alias("median_variance"))


def legacy_variance(bids: DataFrame) -> DataFrame:
    """The older view: a price by unit where there is a quantity, the mean of uncapped variances above 0."""
    unit = F.when(F.col("qty") > 0, F.col("amount") / F.col("qty")).otherwise(F.col("amount"))
    flags = bids.withColumn("unit", unit).filter("unit > 0").groupBy(*PLACE).agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    variance = (F.col("high") - F.col("low")) / F.col("low") * 100.0
    return flags.agg(F.count("*").alias("items"), (exact_sum(F.when(variance > 0, variance), 6) / F.count_if(variance > 0)).alias("mean_variance"))


def warn_total_mismatch(sums: DataFrame, percent: float = 10.0) -> DataFrame:
    gap = F.abs(F.col("extracted") - F.col("calculated")) / F.col("extracted") * 100.0
    return sums.filter((F.col("extracted") > 0) & (F.col("calculated") > 0)).withColumn("gap_pct", gap).filter(F.col("gap_pct") > percent).select("division", "vendor", "extracted", "calculated", "gap_pct")


def priced() -> Column:
    """The vendors of a place with a rate or amount."""
    return F.collect_set(F.when(F.col("rate").isNotNull() | F.col("amount").isNotNull(), F.col("vendor")))


def unpriced(bids: DataFrame, template: DataFrame) -> DataFrame:
    """Places and vendors without a rate or amount."""
    found = places(template, placed(bids).groupBy(*PLACE).agg(priced().alias("_priced")))
    lacking = F.array_except(vendors_of(bids), F.coalesce("_priced", F.array().cast("array<string>")))
    return found.select(*PLACE, F.explode(lacking).alias("vendor"))


def warn_missing(bids: DataFrame, template: DataFrame) -> DataFrame:
    """Places that at least two vendors price, and the vendors that don't."""
    valid = placed(bids).groupBy(*PLACE).agg(F.count_if(F.col("rate") > 0).alias("n_valid"), priced().alias("_priced")).filter("n_valid >= 2")
    return places(template, valid, "inner").select(*PLACE, F.explode(F.array_except(vendors_of(bids), "_priced")).alias("vendor"), "n_valid")


def warn_outliers(bids: DataFrame) -> DataFrame:
    """Rates far from the upper median of a place with three or more: beyond 5 times a warning, 10 times an error."""
    middle = bids.filter("rate > 0").groupBy(*PLACE).agg(F.sort_array(F.collect_list("rate")).alias("rates")).filter(F.size("rates") >= 3)  # a rate per vendor
    middle = middle.select(*PLACE, F.element_at("rates", (F.floor(F.size("rates") / 2) + 1).cast("int")).alias("median_rate"))
    rows = bids.filter("rate > 0").join(middle, list(PLACE)).withColumn("ratio", F.col("rate") / F.col("median_rate")).filter("ratio > 5 OR ratio < 0.2")
    return rows.select(*PLACE, "vendor", "rate", "median_rate", F.when((F.col("ratio") > 10) | (F.col("ratio") < 0.1), "error").otherwise("warning").alias("severity"))


def deviations(bids: DataFrame, template: DataFrame, least: float = 200.0) -> DataFrame:
    """Clarifications (vendor, item, category, side): warnings about missing prices and outliers, then the highest and
    lowest bidders of places whose variance is large, unless the vendor's item has one already; one row for each vendor
    and item, the first place's, warnings first."""
    missing = warn_missing(bids, template).select(*PLACE, "vendor", F.lit("exclusions").alias("category"), F.lit("missing").alias("side"), F.lit(0).alias("step"))
    far = warn_outliers(bids).select(*PLACE, "vendor", F.lit("pricing_anomalies").alias("category"), F.lit("outlier").alias("side"), F.lit(1).alias("step"))
    flags = item_flags(bids).filter(F.col("variance_pct") >= least)
    sides = F.array(F.struct(F.col("high_bidder").alias("vendor"), F.lit("high").alias("side"), F.lit(2).alias("step")), F.struct(F.col("low_bidder").alias("vendor"), F.lit("low").alias("side"), F.lit(3).alias("step")))
    wide = flags.select(*PLACE, F.inline(sides)).select(*PLACE, "vendor", F.lit("deviations").alias("category"), "side", "step")
    every = missing.unionByName(far).unionByName(wide)
    return every.groupBy("vendor", "item").agg(F.min_by(F.struct("category", "side"), F.struct("step", "division", "grouping", "sub_group", "idx")).alias("b")).select("vendor", "item", "b.category", "b.side")


def discrepancy(sums: DataFrame) -> DataFrame:
    gap = F.col("calculated") - F.col("extracted")
    percent = F.when(F.abs(gap) >= 0.5, gap / F.when(F.col("extracted") != 0, F.col("extracted")).otherwise(F.col("calculated")) * 100.0)
    return sums.select("division", "vendor", percent.alias("discrepancy_pct"))


def fill_rates(bids: DataFrame, template: DataFrame, how: str) -> DataFrame:
    """Every place and vendor with its rate, or that of `how` (mean, median, lowest) over the positive ones; null where
    nobody prices the place."""
    rate = F.when(F.col("rate") > 0, F.col("rate"))
    value = {"mean": exact_sum(rate, 8) / F.count(rate), "median": F.median(rate), "lowest": F.min(rate)}[how]
    own = F.collect_list(F.when(F.col("vendor").isNotNull(), F.struct("vendor", "rate")))
    found = places(template, placed(bids).groupBy(*PLACE).agg(value.alias("fill"), own.alias("_own")))
    held = F.coalesce("_own", F.array().cast("array<struct<vendor:string,rate:double>>"))
    others = F.array_except(vendors_of(bids), F.transform(held, lambda o: o["vendor"]))
    rows = found.select(*PLACE, "fill", F.inline(F.concat(held, F.transform(others, lambda v: F.struct(v.alias("vendor"), F.lit(None).cast("double").alias("rate"))))))
    return rows.select(*PLACE, "vendor", F.coalesce("rate", "fill").alias("rate"), F.col("rate").isNull().alias("filled"))


def normalized_flags(filled: DataFrame) -> DataFrame:
    """Flags of filled rates: variance isn't capped and needs a low above 0; the first vendor by name of a tie."""
    best = filled.filter("rate > 0").groupBy(*PLACE).agg(F.min_by(F.struct("vendor", "rate"), F.struct("rate", "vendor")).alias("low"), F.max("rate").alias("high_rate"), F.count_if("filled").alias("n_filled"))
    return best.select(*PLACE, F.col("low.vendor").alias("low_bidder"), ((F.col("high_rate") - F.col("low.rate")) / F.col("low.rate") * 100.0).alias("variance_pct"), "n_filled")


def normalized_bids(bids: DataFrame, how: str = "median") -> DataFrame:
    """Contractors' prices made comparable: an override counts first, an included item has none, an unpriced one and one
    with an arithmetic error take the median or lowest of the place's valid prices, others stay; totals round to cents.
    Valid are all prices but of included items and wrong ones, 0 too; a place without any is filled with 0. `place` ranks
    the totals, ties in the vendors' order. Rows also have `vendor_ord`, `override`, `included` and `wrong`."""
    value = {"median": F.median("amount"), "lowest": F.min("amount")}[how]
    fill = bids.filter("amount IS NOT NULL AND NOT included AND NOT wrong").groupBy(*PLACE).agg(value.alias("fill"))
    filled = F.coalesce("fill", F.lit(0.0))
    priced = F.when(F.col("override").isNotNull(), F.col("override")).when(F.col("included"), F.lit(None)).when(F.col("amount").isNull() | F.col("wrong"), filled).otherwise(F.col("amount"))
    rows = bids.join(fill, list(PLACE), "left").withColumn("price", priced)
    total = F.round(F.sum(F.coalesce("price", F.lit(0.0)).cast("decimal(18,4)")), 2).cast("double")
    sums = rows.groupBy("vendor", "vendor_ord").agg(total.alias("total"), F.count("price").alias("priced"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy("total", "vendor_ord"))).drop("vendor_ord")


def correct_items(items: DataFrame) -> DataFrame:
    """Row arithmetic: negative rates and amounts lose their sign, a missing or zero amount is filled in from
    qty x rate, and one less than 2 % off snaps to it. Rows with a text in place of a figure stay."""
    rate, amount = F.abs(F.col("rate")), F.abs(F.col("amount"))
    product = F.col("qty") * rate
    near = (product != 0) & (F.coalesce(amount, F.lit(0.0)).eqNullSafe(F.lit(0.0)) | (F.abs(product - amount) / F.abs(product) < 0.02))
    fixed = F.when(F.coalesce(near, F.lit(False)), round_half_even(product)).otherwise(amount)
    plain = F.coalesce(F.col("raw"), F.lit("")) == ""
    return items.withColumns({"rate": F.when(plain, rate).otherwise(F.col("rate")), "amount": F.when(plain, fixed).otherwise(F.col("amount"))})


def correct_doubled(items: DataFrame, *keys: str) -> DataFrame:
    """Halve computed amounts of divisions that come to about twice what they state: the sum is 1.85 to 2.15 times the
    stated total, and at least half of the amounts are within 2 % of qty x rate."""
    product = F.col("qty") * F.col("rate")
    computed = F.coalesce((product > 0) & (F.abs(F.col("amount") - product) / product < 0.02), F.lit(False)) & F.col("amount").isNotNull()
    marked = items.withColumn("computed", computed)
    sums = marked.groupBy(*keys).agg(exact_sum(F.coalesce(amount_of(), F.lit(0.0))).alias("sum"), F.max("stated").alias("whole"), F.count("amount").alias("amounts"), F.count_if("computed").alias("hits"))
    ratio = F.when(F.col("whole") > 0, F.col("sum") / F.col("whole"))
    twice = sums.select(*keys, F.coalesce(ratio.between(1.85, 2.15) & (F.col("amounts") > 0) & (F.col("hits") >= 0.5 * F.col("amounts")), F.lit(False)).alias("halved"))
    joined = marked.join(twice, list(keys)).withColumn("halved", F.col("halved") & F.col("computed"))
    return joined.withColumn("amount", F.when(F.col("halved"), round_half_even(F.col("amount") / 2)).otherwise(F.col("amount"))).drop("computed")


def reconcile(sums: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Whether a division's items add up to its stated total. Divisions of which more than half the items have a text in
    place of figures pass, as do those without a stated total; a stated total without priced items is 100 % off."""
    raw = F.col("raw_only") > F.col("items") * 0.5
    off = F.when(raw | ~F.coalesce(F.col("extracted") > 0, F.lit(False)), F.lit(None)).when(F.col("calculated") > 0, F.abs(F.col("extracted") - F.col("calculated")) / F.col("extracted") * 100.0).when(F.col("calculated") == 0, F.lit(100.0))
    return sums.withColumn("variance_pct", off).select("division", "vendor", "variance_pct", F.coalesce(F.col("variance_pct") <= threshold, F.lit(True)).alias("passed"))


def reconcile_summary(checks: DataFrame) -> DataFrame:
    """Passed and failed divisions of each vendor, and the names of those that failed."""
    return checks.groupBy("vendor").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("division")))), ",").alias("failing"))


def structural_validation(template: DataFrame, extracted: DataFrame) -> DataFrame:
    """Divisions of template and document side by side, by upper-cased name: matched, missing or extra, how many items
    were found against expected, and whether that is more than 30 % off."""
    want = template.groupBy(F.upper("division").alias("division")).agg(F.count("*").alias("expected"))
    have = extracted.groupBy(F.upper(F.coalesce("division", F.lit(""))).alias("division")).agg(F.count("*").alias("found"))
    percent = F.col("found") / F.col("expected") * 100.0
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("matched")
    return want.join(have, "division", "full").select("division", kind.alias("kind"), "expected", "found", percent.alias("item_pct"), F.coalesce(F.abs(percent - 100.0) > 30.0, F.lit(False)).alias("flagged"))


def merge_chunks(parts: DataFrame, fields: list[str]) -> DataFrame:
    """Chunks of one division (division, chunk, stated, amount, ...): the name without its continuation mark, each
    chunk's stated total counted once, repeated rows once; without stated totals that of the items."""
    named = parts.withColumn("division", F.trim(F.regexp_replace("division", r"(?i)\s*\(CONT'?D?\).*$", "")))
    stated = named.groupBy("division", "chunk").agg(F.max("stated").alias("stated")).groupBy("division").agg(exact_sum(F.col("stated")).alias("stated"))
    items = named.dropDuplicates(["division", *fields]).groupBy("division").agg(exact_sum(F.col("amount")).alias("sum"), F.count("*").alias("items"))
    return items.join(stated, "division").select("division", F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.col("sum")).alias("total"), "items")


def division_sums(items: DataFrame, *keys: str) -> DataFrame:
    """qty x rate where both are there, as text with two places."""
    return items.groupBy(*keys).agg(F.format_string("%.2f", F.coalesce(F.sum((F.col("qty") * F.col("rate")).cast("decimal(28,2)")).cast("double"), F.lit(0.0))).alias("total"))


def explode_boq(documents: DataFrame) -> DataFrame:
    """Nested documents as rows with their positions; groupings without sub-groups have one named GENERAL."""
    levels = documents.select("doc", F.posexplode_outer("divisions").alias("div_ord", "d")).select("doc", "div_ord", F.col("d.division_name").alias("division"), F.posexplode_outer("d.grouping").alias("grp_ord", "g"))
    subs = F.coalesce("g.sub_groupings", F.array(F.struct(F.lit("GENERAL").alias("sub_grouping_name"), F.col("g.line_items").alias("line_items"))))
    levels = levels.select("doc", "div_ord", "division", "grp_ord", F.col("g.grouping_name").alias("grouping"), F.posexplode_outer(subs).alias("sub_ord", "s"))
    return levels.select("doc", "div_ord", "division", "grp_ord", "grouping", "sub_ord", F.col("s.sub_grouping_name").alias("sub_group"), F.posexplode_outer("s.line_items").alias("idx", "i")).select("*", "i.*").drop("i")


def nest_report(bids: DataFrame) -> DataFrame:
    """The report as one nested row for each division: groupings, their items, and each item's rates by vendor. A row is
    as long as its division, as it is in the report."""
    rates = F.map_from_entries(F.array_sort(F.collect_list(F.struct("vendor", "rate"))))
    items = bids.groupBy(*PLACE).agg(rates.alias("rates"))
    groups = items.groupBy("division", "grouping").agg(F.array_sort(F.collect_list(F.struct("item", "idx", F.map_entries("rates").alias("rates")))).alias("line_items"))
    return groups.groupBy("division").agg(F.array_sort(F.collect_list(F.struct("grouping", "line_items"))).alias("groupings"))


def reference_items(items: DataFrame, fields: list[str]) -> DataFrame:
    """The columns of a template that an extraction is held against, of divisions with any items."""
    return items.filter("item IS NOT NULL").select("division", *fields)


def report_filter(items: DataFrame, division: str | None = None, grouping: str | None = None, search: str = "") -> DataFrame:
    """Items of a division and grouping whose description, id or grouping contains a text, whatever its case."""
    for column, wanted in (("division", division), ("grouping", grouping)):
        if wanted is not None:
            items = items.filter(F.col(column) == wanted)
    found = [F.contains(F.lower(F.col(c).cast("string")), F.lit(search.strip().lower())) for c in ("description", "item", "grouping")]
    return items.filter(F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False)) | F.coalesce(found[2], F.lit(False))) if search.strip() else items


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column with the place where each was first seen."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_at"))


def match_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Each name with the first known one (name, ord) that equals it, whatever the case, else the first that contains
    it or that it contains; null without one. Equal names join by value; only the rest meet all known names, which are
    few: a ValueError says where they aren't."""
    held = known.filter("name <> ''").select(F.col("name").alias("found"), "ord", F.upper("name").alias("_k")).limit(MOST_VENDORS + 1).collect()
    if len(held) > MOST_VENDORS:
        raise ValueError(f"more than {MOST_VENDORS} known names")
    values = F.array(*(F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["found"]).alias("found"), F.lit(r["_k"]).alias("key")) for r in sorted(held, key=lambda r: (r["ord"], r["found"]))))
    upper = F.upper("name")
    equal = F.filter(values, lambda k: k["key"] == upper)
    inside = F.filter(values, lambda k: F.contains(upper, k["key"]) | F.contains(k["key"], upper))
    pick = F.coalesce(F.get(equal, F.lit(0))["found"], F.when(F.col("name") != "", F.get(inside, F.lit(0))["found"]))
    return names.withColumn("matched", pick if held else F.lit(None).cast("string"))
