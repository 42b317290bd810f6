"""The comparison of bids over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import bids
from tallyspark.sources import tables
from tallyspark.sources.tables import exact_sum, load

from .register import query

PLACE = 'division, "grouping", sub_group, item, idx'
BIDS = """WITH lines AS (SELECT *, (l_suppkey % 5 * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS vendor_ord FROM lineitem),
placed AS (SELECT *, (row_number() OVER (PARTITION BY vendor_ord, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) - 1)::INT AS idx, NOT (l_linenumber = 7 OR (vendor_ord IN (3, 4) AND p_brand LIKE '%1')) AS priced FROM lines JOIN part ON l_partkey = p_partkey),
bids AS (SELECT 'V' || lpad(vendor_ord::VARCHAR, 2, '0') AS vendor, vendor_ord, p_brand AS division, p_type AS "grouping", 'S' || (p_size % 3) AS sub_group, p_partkey AS item, idx, p_name AS description, l_quantity AS qty,
  CASE WHEN priced THEN l_extendedprice / l_quantity END AS rate, p_retailprice * (0.75::DOUBLE + 5.0::DOUBLE * l_discount) AS market_rate, CASE WHEN priced AND l_linenumber <> 5 THEN l_extendedprice END AS amount,
  l_extendedprice * (1.0::DOUBLE + l_tax) AS extracted, p_retailprice AS benchmark_rate, CASE WHEN NOT priced AND vendor_ord <> 4 THEN 'Included' END AS raw, l_orderkey, l_linenumber, l_discount, l_tax FROM placed),
vendors AS (SELECT DISTINCT vendor FROM bids),
template AS (SELECT p_brand AS division, p_type AS "grouping", 'S' || (p_size % 3) AS sub_group, p_partkey AS item, idx::INT AS idx FROM part, range(2) t(idx)),
flags AS (SELECT division, "grouping", sub_group, item, idx, min(rate) AS low_rate, max(rate) AS high_rate, first(vendor ORDER BY rate, vendor_ord DESC) AS low_bidder, first(vendor ORDER BY rate DESC, vendor_ord DESC) AS high_bidder, count(*) AS n_valid,
  max(rate) - min(rate) AS spread, CASE WHEN min(rate) > 0.01 THEN least((max(rate) - min(rate)) / min(rate) * 100.0::DOUBLE, 500.0::DOUBLE) END AS variance_pct FROM bids WHERE rate > 0 GROUP BY ALL),
divisions AS (SELECT division, vendor, vendor_ord, sum(coalesce(amount, qty * rate, 0)::DECIMAL(18,4))::DOUBLE AS calculated, sum(extracted::DECIMAL(18,4))::DOUBLE AS extracted, count(*) AS items, count(*) FILTER (amount IS NULL AND rate IS NULL AND raw <> '') AS raw_only FROM bids GROUP BY ALL),
divided AS (SELECT *, CASE WHEN extracted > 0 THEN extracted ELSE calculated END AS total FROM divisions),
medians AS (SELECT division, "grouping", sub_group, item, idx, list_sort(list(rate))[(count(*) // 2)::INT + 1] AS median_rate FROM bids WHERE rate > 0 GROUP BY ALL HAVING count(*) >= 3),
outliers AS (SELECT division, "grouping", sub_group, item, idx, vendor, rate, median_rate, CASE WHEN rate / median_rate > 10 OR rate / median_rate < 0.1::DOUBLE THEN 'error' ELSE 'warning' END AS severity FROM bids JOIN medians USING (division, "grouping", sub_group, item, idx)
  WHERE rate > 0 AND (rate / median_rate > 5 OR rate / median_rate < 0.2::DOUBLE)),
gaps AS (SELECT * FROM template CROSS JOIN vendors ANTI JOIN (SELECT * FROM bids WHERE rate IS NOT NULL OR amount IS NOT NULL) USING (division, "grouping", sub_group, item, idx, vendor)),
valid AS (SELECT division, "grouping", sub_group, item, idx, count(*) AS n_valid FROM bids WHERE rate > 0 GROUP BY ALL HAVING count(*) >= 2),
missing AS (SELECT * FROM gaps JOIN valid USING (division, "grouping", sub_group, item, idx))
"""
SHIFTED = BIDS + """, shifted AS (SELECT vendor, rate, amount, CASE WHEN item % 10 <> 0 THEN item END AS item, CASE (item * 7 + vendor_ord) % 7 WHEN 4 THEN 'other' WHEN 5 THEN lower(division) ELSE division END AS division,
  CASE WHEN (item * 7 + vendor_ord) % 7 = 3 THEN 'other' ELSE "grouping" END AS "grouping", CASE WHEN (item * 7 + vendor_ord) % 7 = 2 THEN 'other' ELSE sub_group END AS sub_group, CASE WHEN (item * 7 + vendor_ord) % 7 = 1 THEN 9 ELSE idx // 2 END AS idx,
  bids.item * 1000 + bids.idx AS ord FROM bids),
hits AS (SELECT vendor, upper(coalesce(item::VARCHAR, '')) AS i, upper(division) AS d, upper("grouping") AS g, upper(sub_group) AS s, idx, first(rate ORDER BY ord DESC) AS rate, first(amount ORDER BY ord DESC) AS amount, min(ord) AS ord FROM shifted GROUP BY ALL),
wanted AS (SELECT DISTINCT division, "grouping", sub_group, CASE WHEN item % 10 <> 0 THEN item END AS item, idx, vendor FROM template, vendors)
"""


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.bid_lines(spark, sf_dir), tables.template_items(spark, sf_dir)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bid_lines(spark, sf_dir)


@query(f"SELECT {PLACE}, low_rate, high_rate, low_bidder, high_bidder, n_valid, spread, variance_pct FROM flags", BIDS)
def bid_item_flags(spark, sf_dir):
    return bids.item_flags(offers(spark, sf_dir))


VENDORS = [f"V{i:02}" for i in range(15)]


@query(f"SELECT {PLACE}, " + ", ".join(f"max(rate) FILTER (vendor = '{v}') AS {v}" for v in VENDORS) + " FROM bids GROUP BY ALL", BIDS)
def bid_item_rates_pivot(spark, sf_dir):
    return bids.rates_pivot(offers(spark, sf_dir), VENDORS)


@query(f"SELECT {PLACE}, vendor, rate FROM bids WHERE rate IS NOT NULL", BIDS)
def bid_rates_unpivot(spark, sf_dir):
    return bids.rates_unpivot(bids.rates_pivot(offers(spark, sf_dir), VENDORS), VENDORS)


@query(f"SELECT {PLACE}, variance_pct FROM flags WHERE variance_pct > 0", BIDS)
def bid_rate_variance(spark, sf_dir):
    return bids.item_flags(offers(spark, sf_dir)).filter("variance_pct > 0").select(*bids.PLACE, "variance_pct")


def cascade_sql(tiers: str) -> str:
    tier = f'CASE WHEN h.i IS NULL THEN NULL WHEN h.g = upper(w."grouping") AND h.s = upper(w.sub_group) AND h.idx = w.idx THEN 1 {tiers} END'
    return f"""SELECT w.division, w."grouping", w.sub_group, w.item, w.idx, w.vendor, h.rate, h.amount, {tier} AS match_tier FROM wanted w LEFT JOIN hits h ON h.vendor = w.vendor AND h.d = upper(w.division) AND h.i = upper(coalesce(w.item::VARCHAR, ''))
 QUALIFY row_number() OVER (PARTITION BY w.division, w."grouping", w.sub_group, w.item, w.idx, w.vendor ORDER BY {tier}, h.ord) = 1"""


@query(cascade_sql('WHEN h.g = upper(w."grouping") AND h.s = upper(w.sub_group) THEN 2 WHEN h.g = upper(w."grouping") THEN 3 ELSE 4'), SHIFTED)
def bid_match_cascade(spark, sf_dir):
    own, template = both(spark, sf_dir)
    return bids.match_cascade(tables.shifted_template(template), tables.shifted_bids(own))


@query(cascade_sql('WHEN h.g = upper(w."grouping") THEN 2 ELSE 3'), SHIFTED)
def bid_match_pte(spark, sf_dir):
    own, template = both(spark, sf_dir)
    return bids.match_cascade(tables.shifted_template(template), tables.shifted_bids(own), by_sub_group=False)


TOTALS = """SELECT {keys}, s.vendor, s.total, b.low_bidder, b.high_bidder FROM sums s LEFT JOIN (SELECT {keys}, first(vendor ORDER BY total, vendor_ord) {low} AS low_bidder, first(vendor ORDER BY total DESC, vendor_ord) AS high_bidder FROM sums {positive} GROUP BY ALL) b USING ({keys})"""
SUMS = """, sums AS (SELECT {keys}, vendor, vendor_ord, sum(coalesce(amount, qty * rate, 0)::DECIMAL(18,4))::DOUBLE AS total FROM bids GROUP BY ALL) """


def totals_sql(keys: str) -> str:
    return SUMS.format(keys=keys) + TOTALS.format(keys=keys, low="", positive="WHERE total > 0")


@query(totals_sql('division, "grouping"'), BIDS)
def bid_grouping_totals(spark, sf_dir):
    keys = ("division", "grouping")
    return bids.with_bidders(bids.totals(offers(spark, sf_dir), *keys), *keys)


@query(SUMS.format(keys='division, "grouping", sub_group') + TOTALS.format(keys='division, "grouping", sub_group', low="FILTER (total > 0)", positive="") + " WHERE (division, \"grouping\") IN (SELECT (division, \"grouping\") FROM bids WHERE sub_group <> 'GENERAL')", BIDS.replace("'S' || (p_size % 3)", "CASE WHEN p_brand LIKE '%2' THEN 'GENERAL' ELSE 'S' || (p_size % 3) END"))
def bid_subgroup_view(spark, sf_dir):
    own = offers(spark, sf_dir)
    return bids.sub_group_view(own.withColumn("sub_group", F.when(~F.col("division").endswith("2"), F.col("sub_group"))))


@query(""", named AS (SELECT CASE vendor_ord WHEN 0 THEN 'TEMPLATE' WHEN 1 THEN 'PTE' ELSE vendor END AS vendor, vendor_ord, division, CASE WHEN vendor_ord = 2 OR division LIKE '%2' THEN 0 ELSE coalesce(amount, qty * rate, 0) END::DECIMAL(18,4) AS amount FROM bids),
 sums AS (SELECT division, vendor, sum(amount)::DOUBLE AS total FROM named GROUP BY ALL), project AS (SELECT vendor, vendor_ord, sum(amount)::DOUBLE AS total FROM named WHERE vendor_ord > 1 GROUP BY ALL)
 SELECT division, vendor, total, (SELECT first(vendor ORDER BY total, vendor_ord) FROM project) AS low_bidder, (SELECT first(vendor ORDER BY total DESC, vendor_ord) FROM project) AS high_bidder FROM sums WHERE division IN (SELECT division FROM sums WHERE total <> 0)""", BIDS)  # fmt: skip
def bid_fast_totals(spark, sf_dir):
    """The first two vendors as template and benchmark; the third and a fifth of the divisions have no amounts."""
    order, free = F.col("vendor_ord"), (F.col("vendor_ord") == 2) | F.col("division").endswith("2")
    own = offers(spark, sf_dir).withColumns({"vendor": F.when(order == 0, "TEMPLATE").when(order == 1, "PTE").otherwise(F.col("vendor")), "amount": F.when(free, 0.0).otherwise(F.col("amount"))})
    return bids.fast_totals(own)


@query("SELECT * FROM divided", BIDS)
def bid_division_totals_extracted(spark, sf_dir):
    return bids.division_totals(offers(spark, sf_dir))


@query(""", sums AS (SELECT vendor, vendor_ord, sum(total::DECIMAL(18,4))::DOUBLE AS d, sum(calculated::DECIMAL(18,4))::DOUBLE AS calculated FROM divided GROUP BY ALL),
 named AS (SELECT *, CASE WHEN vendor_ord % 4 = 1 THEN calculated * 1.5::DOUBLE WHEN d > 0 THEN d ELSE calculated END AS total FROM sums)
 SELECT vendor, total, calculated, (SELECT first(vendor ORDER BY total, vendor_ord) FROM named WHERE total > 0) AS low_bidder, (SELECT first(vendor ORDER BY total DESC, vendor_ord) FROM named WHERE total > 0) AS high_bidder FROM named""", BIDS)  # fmt: skip
def bid_project_totals(spark, sf_dir):
    divisions = bids.division_totals(offers(spark, sf_dir))
    stated = divisions.groupBy("vendor", "vendor_ord").agg(exact_sum(F.col("calculated")).alias("sum"))
    # stated by some vendors, as 0 by others
    stated = stated.filter("vendor_ord % 4 IN (1, 2)").select("vendor", F.when(F.col("vendor_ord") % 4 == 1, F.col("sum") * 1.5).otherwise(0.0).alias("stated"))
    return bids.project_totals(divisions, stated)


@query(', t AS (SELECT division, "grouping", sum((qty * benchmark_rate)::DECIMAL(18,4))::DOUBLE AS s FROM bids WHERE vendor_ord = 0 GROUP BY GROUPING SETS ((division, "grouping"), (division), ())) SELECT division, "grouping", CASE WHEN s > 0 THEN s END AS benchmark_total FROM t', BIDS)
def bid_benchmark_totals(spark, sf_dir):
    items = offers(spark, sf_dir).filter("vendor_ord = 0").select("division", "grouping", "qty", F.col("benchmark_rate").alias("rate"), F.lit(None).cast("double").alias("amount"))
    levels = [bids.benchmark_totals(items, *keys) for keys in (("division", "grouping"), ("division",), ())]
    return levels[0].unionByName(levels[1], True).unionByName(levels[2], True)


@query(""", sums AS (SELECT vendor, sum(total::DECIMAL(18,4))::DOUBLE AS s, max(vendor_ord) AS o FROM divided GROUP BY ALL) SELECT vendor, CASE WHEN o % 3 = 0 THEN o::DOUBLE ELSE nullif(s, 0) END AS project_total FROM sums""", BIDS)
def bid_project_total_fallback(spark, sf_dir):
    divisions = bids.division_totals(offers(spark, sf_dir))
    stated = divisions.filter("vendor_ord % 3 = 0").groupBy("vendor").agg(F.max("vendor_ord").cast("double").alias("stated"))
    return bids.stated_or_sum(stated, divisions, "vendor")


@query(""", sums AS (SELECT vendor, vendor_ord, sum(coalesce(amount, qty * rate, 0)::DECIMAL(18,4))::DOUBLE AS total FROM bids GROUP BY ALL), b AS (SELECT sum((qty * benchmark_rate)::DECIMAL(18,4))::DOUBLE AS benchmark FROM bids)
 SELECT vendor, total, row_number() OVER (ORDER BY total, vendor_ord) AS rank, total / min(total) OVER () * 100.0::DOUBLE AS price_index, total / min(total) OVER () * 100.0::DOUBLE - 100.0::DOUBLE AS over_lowest,
 least(total / greatest(max(total) OVER (), benchmark, 1.0::DOUBLE) * 100.0::DOUBLE, 100.0::DOUBLE) AS bar_width FROM sums, b WHERE total > 0""", BIDS)  # fmt: skip
def bid_rank_index(spark, sf_dir):
    return bids.ranked_totals(offers(spark, sf_dir))


@query(SUMS.format(keys="division") + "SELECT division, first(vendor ORDER BY total, vendor_ord) AS vendor, min(total) AS total FROM sums GROUP BY division", BIDS)
def bid_lowest_per_asset(spark, sf_dir):
    return bids.lowest_per_division(offers(spark, sf_dir))


@query("SELECT count(*) AS items, count(*) FILTER (variance_pct > 0) AS with_variance, median(variance_pct) FILTER (variance_pct > 0) AS median_variance FROM flags", BIDS)
def bid_summary_median_variance(spark, sf_dir):
    return bids.variance_summary(bids.item_flags(offers(spark, sf_dir)))


@query(f", u AS (SELECT {PLACE}, CASE WHEN qty > 0 THEN amount / qty ELSE amount END AS unit FROM bids), f AS (SELECT {PLACE}, (max(unit) - min(unit)) / min(unit) * 100.0::DOUBLE AS v FROM u WHERE unit > 0 GROUP BY ALL) SELECT count(*) AS items, sum(CASE WHEN v > 0 THEN v END::DECIMAL(18,6))::DOUBLE / count(*) FILTER (v > 0) AS mean_variance FROM f", BIDS)
def bid_legacy_mean_variance(spark, sf_dir):
    return bids.legacy_variance(offers(spark, sf_dir))


@query("SELECT division, vendor, extracted, calculated, abs(extracted - calculated) / extracted * 100.0::DOUBLE AS gap_pct FROM divisions WHERE extracted > 0 AND calculated > 0 AND abs(extracted - calculated) / extracted * 100.0::DOUBLE > 10", BIDS)
def bid_warn_total_mismatch(spark, sf_dir):
    return bids.warn_total_mismatch(bids.division_totals(offers(spark, sf_dir)))


@query(f"SELECT {PLACE}, vendor, n_valid FROM missing", BIDS)
def bid_warn_missing_item(spark, sf_dir):
    return bids.warn_missing(*both(spark, sf_dir))


@query(f"SELECT {PLACE}, vendor, rate, median_rate, severity FROM outliers", BIDS)
def bid_warn_outlier_rate(spark, sf_dir):
    return bids.warn_outliers(offers(spark, sf_dir))


@query(f""", sides AS (SELECT {PLACE}, vendor, 'exclusions' AS category, 'missing' AS side, 0 AS step FROM missing UNION ALL SELECT {PLACE}, vendor, 'pricing_anomalies', 'outlier', 1 FROM outliers
 UNION ALL SELECT {PLACE}, high_bidder, 'deviations', 'high', 2 FROM flags WHERE variance_pct >= 200 UNION ALL SELECT {PLACE}, low_bidder, 'deviations', 'low', 3 FROM flags WHERE variance_pct >= 200)
 SELECT vendor, item, category, side FROM sides QUALIFY row_number() OVER (PARTITION BY vendor, item ORDER BY step, division, "grouping", sub_group, idx) = 1""", BIDS)  # fmt: skip
def bid_ptc_from_warnings(spark, sf_dir):
    return bids.deviations(*both(spark, sf_dir))


@query(f"SELECT {PLACE}, vendor FROM gaps", BIDS)
def bid_ptc_unpriced(spark, sf_dir):
    return bids.unpriced(*both(spark, sf_dir))


def fill_sql(value: str) -> str:
    return f', fills AS (SELECT {PLACE}, {value} AS fill FROM bids WHERE rate > 0 GROUP BY ALL), filled AS (SELECT {PLACE}, v.vendor, coalesce(b.rate, f.fill) AS rate, b.rate IS NULL AS filled FROM template t CROSS JOIN vendors v LEFT JOIN fills f USING ({PLACE}) LEFT JOIN bids b USING ({PLACE}, vendor)) '


@query(fill_sql("sum(rate::DECIMAL(18,8))::DOUBLE / count(*)") + "SELECT * FROM filled", BIDS)
def bid_normalize_mean_fill(spark, sf_dir):
    return bids.fill_rates(*both(spark, sf_dir), "mean")


@query(fill_sql("median(rate)") + "SELECT * FROM filled", BIDS)
def bid_normalize_median_fill(spark, sf_dir):
    return bids.fill_rates(*both(spark, sf_dir), "median")


@query(fill_sql("min(rate)") + "SELECT * FROM filled", BIDS)
def bid_normalize_lowest_fill(spark, sf_dir):
    return bids.fill_rates(*both(spark, sf_dir), "lowest")


@query(fill_sql("sum(rate::DECIMAL(18,8))::DOUBLE / count(*)") + f"SELECT {PLACE}, first(vendor ORDER BY rate, vendor) AS low_bidder, (max(rate) - min(rate)) / min(rate) * 100.0::DOUBLE AS variance_pct, count(*) FILTER (filled) AS n_filled FROM filled WHERE rate > 0 GROUP BY ALL", BIDS)
def bid_normalize_report(spark, sf_dir):
    return bids.normalized_flags(bids.fill_rates(*both(spark, sf_dir), "mean"))


NORMALIZED = """, marked AS (SELECT *, CASE WHEN l_linenumber = 6 AND l_tax > 0.05 THEN 100.0::DOUBLE END AS override, l_linenumber = 4 AND l_discount > 0.05 AS included, l_linenumber = 3 AND l_discount < 0.03 AS wrong FROM bids),
 fills AS (SELECT division, "grouping", sub_group, item, idx, {value} AS fill FROM marked WHERE amount IS NOT NULL AND NOT included AND NOT wrong GROUP BY ALL),
 priced AS (SELECT vendor, vendor_ord, CASE WHEN override IS NOT NULL THEN override WHEN included THEN NULL WHEN amount IS NULL OR wrong THEN coalesce(fill, 0) ELSE amount END AS price FROM marked LEFT JOIN fills USING (division, "grouping", sub_group, item, idx))
 SELECT vendor, round(sum(coalesce(price, 0)::DECIMAL(18,4)), 2)::DOUBLE AS total, count(price) AS priced, row_number() OVER (ORDER BY round(sum(coalesce(price, 0)::DECIMAL(18,4)), 2), any_value(vendor_ord))::INT AS place FROM priced GROUP BY vendor"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return offers(spark, sf_dir).withColumns({"override": F.when((line == 6) & (F.col("l_tax") > 0.05), 100.0), "included": (line == 4) & (F.col("l_discount") > 0.05), "wrong": (line == 3) & (F.col("l_discount") < 0.03)})


@query(NORMALIZED.format(value="median(amount)"), BIDS)
def bid_normalize_contractors_median(spark, sf_dir):
    return bids.normalized_bids(marked(spark, sf_dir), "median")


@query(NORMALIZED.format(value="min(amount)"), BIDS)
def bid_normalize_contractors_lowest(spark, sf_dir):
    return bids.normalized_bids(marked(spark, sf_dir), "lowest")


@query("SELECT division, vendor, CASE WHEN abs(calculated - extracted) >= 0.5 THEN (calculated - extracted) / CASE WHEN extracted <> 0 THEN extracted ELSE calculated END * 100.0::DOUBLE END AS discrepancy_pct FROM divisions", BIDS)
def bid_discrepancy(spark, sf_dir):
    return bids.discrepancy(bids.division_totals(offers(spark, sf_dir)))


CHECKS = ", checks AS (SELECT division, vendor, CASE WHEN raw_only > items * 0.5 OR extracted <= 0 THEN NULL WHEN calculated > 0 THEN abs(extracted - calculated) / extracted * 100.0::DOUBLE ELSE 100.0::DOUBLE END AS variance_pct, coalesce(variance_pct <= 12, true) AS passed FROM divisions) "


@query(CHECKS + "SELECT * FROM checks", BIDS)
def boq_reconcile(spark, sf_dir):
    return bids.reconcile(bids.division_totals(offers(spark, sf_dir)), 12.0)


@query(CHECKS + "SELECT vendor, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, coalesce(string_agg(division, ',' ORDER BY division) FILTER (NOT passed), '') AS failing FROM checks GROUP BY vendor", BIDS)
def boq_reconcile_summary(spark, sf_dir):
    return bids.reconcile_summary(bids.reconcile(bids.division_totals(offers(spark, sf_dir)), 12.0))


def half_even_sql(x: str) -> str:
    """x to two places by its exact binary value."""
    high = f"(({x}) * 134217729::DOUBLE - (({x}) * 134217729::DOUBLE - ({x})))"
    product = f"(({x}) * 100::DOUBLE)"
    error = f"(({high} * 100::DOUBLE - {product}) + (({x}) - {high}) * 100::DOUBLE)"
    part = f"({product} - floor({product}))"
    return f"((floor({product}) + CASE WHEN {part} > 0.5 OR ({part} = 0.5 AND ({error} > 0 OR ({error} = 0 AND floor({product}) % 2 = 1))) THEN 1 ELSE 0 END) / 100::DOUBLE)"


PRODUCT = "(l_quantity * abs(l_extendedprice / 50))"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_extendedprice / 50) AS rate, CASE WHEN l_linenumber = 1 OR abs({PRODUCT} - l_extendedprice) / abs({PRODUCT}) < 0.02::DOUBLE THEN {half_even_sql(PRODUCT)} ELSE l_extendedprice END AS amount FROM lineitem")
def boq_correct_items(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("qty"), (-F.col("l_extendedprice") / 50).alias("rate"), F.when(F.col("l_linenumber") > 1, -F.col("l_extendedprice")).alias("amount"), F.lit("").alias("raw"))
    return bids.correct_items(rows).drop("qty", "raw")


DOUBLED = """, given AS (SELECT division, vendor, item, idx, l_orderkey, l_linenumber, qty, rate, amount * CASE WHEN vendor_ord % 3 = 0 THEN 1.0::DOUBLE WHEN l_linenumber = 2 THEN 1.01::DOUBLE ELSE 1.5::DOUBLE END AS amount, max(0) OVER () AS z FROM bids),
 sums AS (SELECT division, vendor, sum(coalesce(amount, qty * rate, 0)::DECIMAL(18,4))::DOUBLE AS s, count(amount) AS amounts, count(*) FILTER (amount IS NOT NULL AND qty * rate > 0 AND abs(amount - qty * rate) / (qty * rate) < 0.02::DOUBLE) AS hits FROM given GROUP BY ALL),
 twice AS (SELECT division, vendor, s, coalesce(s / (s / CASE WHEN division LIKE '%3' THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END) BETWEEN 1.85::DOUBLE AND 2.15::DOUBLE AND amounts > 0 AND hits >= 0.5 * amounts AND s > 0, false) AS h FROM sums)
"""


@query(DOUBLED + f"SELECT division, vendor, item, idx, coalesce(h AND amount IS NOT NULL AND qty * rate > 0 AND abs(amount - qty * rate) / (qty * rate) < 0.02::DOUBLE, false) AS halved, CASE WHEN halved THEN {half_even_sql('(amount / 2::DOUBLE)')} ELSE amount END AS amount FROM given JOIN twice USING (division, vendor)", BIDS)
def boq_correct_doubled(spark, sf_dir):
    rows = offers(spark, sf_dir)
    factor = F.when(F.col("vendor_ord") % 3 == 0, 1.0).when(F.col("l_linenumber") == 2, 1.01).otherwise(1.5)
    rows = rows.withColumn("amount", F.col("amount") * factor)
    sums = rows.groupBy("division", "vendor").agg(exact_sum(F.coalesce(bids.amount_of(), F.lit(0.0))).alias("s"))
    stated = sums.select("division", "vendor", (F.col("s") / F.when(F.col("division").endswith("3"), 1.5).otherwise(2.0)).alias("stated"))
    return bids.correct_doubled(rows.join(stated, ["division", "vendor"]), "division", "vendor").select("division", "vendor", "item", "idx", "halved", "amount")


@query(""", want AS (SELECT upper(division) AS division, count(*) AS expected FROM template GROUP BY 1), have AS (SELECT upper(CASE WHEN division LIKE '%5' THEN 'x' || division ELSE division END) AS division, count(*) AS found FROM bids WHERE vendor_ord = 1 AND (division NOT LIKE '%2' OR idx = 0) GROUP BY 1)
 SELECT division, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'matched' END AS kind, expected, found, found / expected * 100.0::DOUBLE AS item_pct, coalesce(abs(found / expected * 100.0::DOUBLE - 100) > 30, false) AS flagged FROM want FULL JOIN have USING (division)""", BIDS)  # fmt: skip
def boq_structural_validation(spark, sf_dir):
    own, template = both(spark, sf_dir)
    own = own.filter("vendor_ord = 1 AND (division NOT LIKE '%2' OR idx = 0)")
    return bids.structural_validation(template, own.withColumn("division", F.when(F.col("division").endswith("5"), F.concat(F.lit("x"), "division")).otherwise(F.col("division"))))


@query(""", stated AS (SELECT division, 0 AS chunk, sum(extracted::DECIMAL(18,4))::DOUBLE AS s FROM bids WHERE idx = 0 GROUP BY 1 UNION ALL SELECT division, 1, sum(extracted::DECIMAL(18,4))::DOUBLE FROM bids GROUP BY 1),
 whole AS (SELECT division, sum(s::DECIMAL(18,4))::DOUBLE AS s FROM stated WHERE division NOT LIKE '%4' GROUP BY 1), items AS (SELECT division, sum(amount::DECIMAL(18,4))::DOUBLE AS a, count(*) AS items FROM bids GROUP BY 1)
 SELECT division, CASE WHEN s > 0 THEN s ELSE a END AS total, items FROM items LEFT JOIN whole USING (division)""", BIDS)  # fmt: skip
def boq_merge_chunks(spark, sf_dir):
    own = offers(spark, sf_dir)
    chunks = own.filter("idx = 0").withColumn("chunk", F.lit(0)).unionByName(own.withColumn("chunk", F.lit(1)))
    stated = chunks.groupBy("division", "chunk").agg(exact_sum(F.col("extracted")).alias("stated"))
    stated = stated.withColumn("stated", F.when(~F.col("division").endswith("4"), F.col("stated")))
    parts = chunks.join(stated, ["division", "chunk"]).withColumn("division", F.when(F.col("chunk") == 1, F.concat("division", F.lit(" (CONT'D) page 2"))).otherwise(F.col("division")))
    return bids.merge_chunks(parts, ["item", "vendor", "idx"])


@query(", s AS (SELECT division, \"grouping\", sum((qty * rate)::DECIMAL(28,2)) AS t FROM bids GROUP BY ALL) SELECT division, \"grouping\", printf('%.2f', coalesce(t, 0)::DOUBLE) AS total FROM s", BIDS)
def boq_division_sums(spark, sf_dir):
    return bids.division_sums(offers(spark, sf_dir), "division", "grouping")


@query('SELECT division AS doc, "grouping", sub_group, item AS item_id, row_number() OVER (PARTITION BY division, "grouping", sub_group ORDER BY item) - 1 AS idx FROM template WHERE idx = 0', BIDS)
def boq_explode_nested(spark, sf_dir):
    items = tables.template_items(spark, sf_dir).filter("idx = 0")
    subs = items.groupBy("division", "grouping", "sub_group").agg(F.sort_array(F.collect_list(F.struct(F.col("item").alias("item_id")))).alias("line_items"))
    groups = subs.groupBy("division", "grouping").agg(F.collect_list(F.struct(F.col("sub_group").alias("sub_grouping_name"), "line_items")).alias("sub_groupings"))
    groups = groups.withColumn("line_items", F.array().cast("array<struct<item_id:bigint>>"))
    docs = groups.groupBy("division").agg(F.collect_list(F.struct(F.col("grouping").alias("grouping_name"), "sub_groupings", "line_items")).alias("grouping"))
    docs = docs.select(F.col("division").alias("doc"), F.array(F.struct(F.col("division").alias("division_name"), "grouping")).alias("divisions"))
    return bids.explode_boq(docs).select("doc", "grouping", "sub_group", "item_id", F.col("idx").cast("long").alias("idx"))


@query("SELECT division, count(DISTINCT \"grouping\") AS groupings, count(DISTINCT (\"grouping\", sub_group, item, idx)) AS items, count(*) AS prices FROM bids GROUP BY division", BIDS)
def bid_report_tree(spark, sf_dir):
    items = F.flatten(F.transform("groupings", lambda g: g["line_items"]))
    report = bids.nest_report(offers(spark, sf_dir)).withColumn("items", items)
    prices = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.size(i["rates"]))
    return report.select("division", F.size("groupings").cast("long").alias("groupings"), F.size("items").cast("long").alias("items"), prices.alias("prices"))


@query('SELECT division, item, description, "grouping", sub_group, idx FROM bids WHERE vendor_ord = 0', BIDS)
def boq_reference_items(spark, sf_dir):
    return bids.reference_items(offers(spark, sf_dir).filter("vendor_ord = 0"), ["item", "description", "grouping", "sub_group", "idx"])


@query("SELECT division, \"grouping\", item, idx, vendor FROM bids WHERE \"grouping\" = (SELECT min(\"grouping\") FROM bids) AND (contains(lower(description), '7') OR contains(item::VARCHAR, '7') OR contains(lower(\"grouping\"), '7'))", BIDS)
def bid_report_filter(spark, sf_dir):
    own = offers(spark, sf_dir)
    first = own.agg(F.min("grouping")).first()[0]
    return bids.report_filter(own, grouping=first, search=" 7 ").select("division", "grouping", "item", "idx", "vendor")


@query('SELECT "grouping", min(item * 100 + idx) AS first_at FROM bids GROUP BY 1', BIDS)
def bid_grouping_options(spark, sf_dir):
    return bids.first_seen(offers(spark, sf_dir).withColumn("at", F.col("item") * 100 + F.col("idx")), "grouping", "at")


@query(""", known AS (SELECT DISTINCT division AS name, division AS o FROM template), names AS (SELECT DISTINCT CASE item % 4 WHEN 0 THEN lower(division) WHEN 1 THEN division || ' works' WHEN 2 THEN division[7:] ELSE 'none ' || item END AS name FROM template)
 SELECT name, coalesce((SELECT first(k.name ORDER BY o) FROM known k WHERE upper(k.name) = upper(n.name)), (SELECT first(k.name ORDER BY o) FROM known k WHERE contains(upper(n.name), upper(k.name)) OR contains(upper(k.name), upper(n.name)))) AS matched FROM names n""", BIDS)  # fmt: skip
def boq_match_names(spark, sf_dir):
    template = tables.template_items(spark, sf_dir)
    part = F.col("item") % 4
    name = F.when(part == 0, F.lower("division")).when(part == 1, F.concat("division", F.lit(" works"))).when(part == 2, F.substring("division", 7, 99)).otherwise(F.concat(F.lit("none "), F.col("item").cast("string")))
    known = template.select(F.col("division").alias("name")).distinct().withColumn("ord", F.col("name"))
    return bids.match_names(template.select(name.alias("name")).distinct(), known)
