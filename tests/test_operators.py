import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fuzzy, numbers, text
from tallyspark.operators import bids, documents, scoring, summaries
from tallyspark.streaming import logs


OFFER = "division string, grouping string, sub_group string, item long, idx int, vendor string, vendor_ord int, qty double, rate double, amount double, raw string, extracted double, ord long"


def offers(spark, rates):
    return spark.createDataFrame([("D", "G", "S", 1, 0, f"V{i}", i, 1.0, None if r is None else float(r), None, None, 1.0, i) for i, r in enumerate(rates)], OFFER)


@pytest.mark.parametrize("rates,bidder,variance", [((10, 10, 20), "V1", 100.0), ((0.005, 5), "V0", None), ((1, 100), "V0", 500.0)])
def test_item_flags(spark, rates, bidder, variance):
    row = bids.item_flags(offers(spark, rates)).first()
    assert (row.low_bidder, row.variance_pct) == (bidder, variance)


@pytest.mark.parametrize("rates,severity", [((1, 1, 6), ["warning"]), ((1, 1, 11), ["error"]), ((1, 6), [])])
def test_outliers(spark, rates, severity):
    assert [r.severity for r in bids.warn_outliers(offers(spark, rates)).collect()] == severity


def test_repeated_ids_are_compared_in_their_own_place(spark):
    far = offers(spark, (100, 100, 100)).withColumn("division", F.lit("E"))
    assert bids.warn_outliers(offers(spark, (1, 1, 1)).unionByName(far)).count() == 0
    assert [r.variance_pct for r in bids.item_flags(offers(spark, (1, 1)).unionByName(far)).collect()] == [0.0, 0.0]


def test_a_line_without_price_is_missing(spark):
    own = offers(spark, (1, 2, None))
    assert [r.vendor for r in bids.warn_missing(own, own.select(*bids.PLACE).distinct()).collect()] == ["V2"]


def test_unpriced_places_stay(spark):
    own = offers(spark, (3, None))
    template = own.select(*bids.PLACE).distinct().unionByName(own.select(*bids.PLACE).distinct().withColumn("item", F.lit(9).cast("long")))
    assert sorted((r.item, r.vendor, r.rate) for r in bids.fill_rates(own, template, "median").fillna(-1, ["rate"]).collect()) == [(1, "V0", 3.0), (1, "V1", 3.0), (9, "V0", -1.0), (9, "V1", -1.0)]


def test_match_folds_case_and_null_ids_and_keeps_the_last_of_equal_places(spark):
    rows = [("d", "g", "s", None, 0, "V", 0, 1.0, 5.0, 1.0, None, 1.0, 1), ("D", "G", "S", None, 0, "V", 0, 1.0, 7.0, 2.0, None, 1.0, 2), ("D", "H", "S", None, 0, "V", 0, 1.0, 9.0, 3.0, None, 1.0, 0)]
    given = spark.createDataFrame(rows, OFFER)
    template = spark.createDataFrame([("D", "G", "s", None, 0), ("d", "G", "s", None, 4), ("D", "G", "x", None, 0), ("D", "x", "x", None, 0), ("x", "G", "S", None, 0)], "division string, grouping string, sub_group string, item long, idx int")
    got = {(r.division, r.grouping, r.sub_group, r.idx): (r.rate, r.amount, r.match_tier) for r in bids.match_cascade(template, given).collect()}
    assert got == {("D", "G", "s", 0): (7.0, 2.0, 1), ("d", "G", "s", 4): (7.0, 2.0, 2), ("D", "G", "x", 0): (7.0, 2.0, 3), ("D", "x", "x", 0): (9.0, 3.0, 4), ("x", "G", "S", 0): (None, None, None)}


def test_reconcile(spark):
    rows = [("a", "V", 100.0, 0.0, 10, 6), ("b", "V", 100.0, 0.0, 10, 5), ("c", "V", None, 5.0, 1, 0), ("d", "V", 100.0, 97.0, 1, 0), ("e", "V", 100.0, 96.0, 1, 0)]
    sums = spark.createDataFrame(rows, "division string, vendor string, extracted double, calculated double, items long, raw_only long")
    assert {r.division: (r.variance_pct, r.passed) for r in bids.reconcile(sums).collect()} == {"a": (None, True), "b": (100.0, False), "c": (None, True), "d": (3.0, True), "e": (4.0, False)}


def test_merged_chunks(spark):
    rows = [("A", 0, 10.0, 4.0, 1), ("A (CONT'D) 2", 1, 20.0, 4.0, 1), ("A (CONT'D) 2", 1, 20.0, 5.0, 2), ("B", 0, None, 6.0, 1)]
    got = bids.merge_chunks(spark.createDataFrame(rows, "division string, chunk int, stated double, amount double, item int"), ["item", "amount"])
    assert {r.division: (r.total, r["items"]) for r in got.collect()} == {"A": (30.0, 2), "B": (6.0, 1)}


def test_first_vendor_of_equal_totals(spark):
    rows = bids.with_bidders(bids.totals(offers(spark, (3, 3, 5, 5)), "division"), "division").first()
    assert (rows.low_bidder, rows.high_bidder) == ("V0", "V2")


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(4)
    given = [0.125, 0.375, 2.675, 1.005, 0.0, 1e9 + 0.005] + [rng.randint(0, 10**7) / 1000 for _ in range(3000)] + [rng.randint(0, 10**6) * rng.random() for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in given + [-x for x in given]], "x double").select(numbers.round_half_even(F.col("x"))).collect()
    assert [r[0] for r in got] == [round(x, 2) for x in given + [-x for x in given]]


def test_correct_items(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0, 10.1, ""), (2, 2.0, 5.0, 12.0, ""), (3, None, None, -10.0, ""), (4, 2.0, 5.0, None, ""), (5, 2.0, 5.0, 10.1, "Included")], "k int, qty double, rate double, amount double, raw string")
    assert {r.k: r.amount for r in bids.correct_items(rows).collect()} == {1: 10.0, 2: 12.0, 3: 10.0, 4: 10.0, 5: 10.1}


def plain_weights(weights, step=0.5, least=1.0):
    total, floor = sum(weights), round(least / step)
    steps = [max(floor, int(w / total * 100 / step + 0.5)) for w in weights]
    off, at = round(100 / step) - sum(steps), 0
    while off:
        move = 1 if off > 0 else -1
        if steps[at] + move >= floor:
            steps[at] += move
            off -= move
        at = (at + 1) % len(steps)
    return [x * step for x in steps]


def test_weights(spark):
    rng = random.Random(1)
    given = [[1.0, 1.0, 1.0]] + [[rng.random() ** 4 + 1e-9 for _ in range(rng.randint(1, 100))] for _ in range(40)]
    got = scoring.normalized_rubrics(spark.createDataFrame([(str(i), w) for i, w in enumerate(given)] + [("none", []), ("many", [1.0] * 101)], "rubric string, weights array<double>")).collect()
    rows = {r.rubric: r.normalized for r in got}
    assert rows["0"] == [33.0, 33.5, 33.5] and rows["none"] is None and rows["many"] is None
    for i, w in enumerate(given):
        assert rows[str(i)] == plain_weights(w) and sum(rows[str(i)]) == 100


def test_scalars(spark):
    given = spark.createDataFrame([("1,200.50",), ("Included",), ("  ",), (None,), ("5d",)], "x string")
    assert [r[0] for r in given.select(text.safe_float(F.col("x"))).collect()] == [1200.5, None, None, None, None]
    grades = spark.createDataFrame([("7",), ("10 - Fine",), ("good confidence",), ("Non–Compliant",), ("x",), ("11",)], "x string")
    assert [r[0] for r in grades.select(scoring.grade_score(F.col("x"))).collect()] == [70, 100, 70, 0, None, None]
    weights = spark.createDataFrame([("15%",), ("0,15",), ("٢٠%",), (None,)], "x string")
    assert [r[0] for r in weights.select(scoring.parsed_weight(F.col("x"))["value"]).collect()] == [15.0, 0.15, 20.0, None]
    signed = spark.createDataFrame([("-5",), ("1e3",), ("- 5 %",)], "x string")
    assert [r[0] for r in signed.select(scoring.coerce_weight(F.col("x"))).collect()] == [-5.0, 1000.0, 5.0]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 90))) for _ in range(2))
        assert fuzzy.common_length(a, b) == brute_common(a, b)
    assert fuzzy.partial_ratio("technical specification document", "This is a technical specification document for project Alpha.") == 100.0
    assert fuzzy.ratio("tehcnical", "technical") > 70


def test_stream_counts_as_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=17 * i), "api" if i % 3 else "db", f"line {i} error" if i % 2 else "ok") for i in range(200)]
    table = spark.createDataFrame(rows, "ts timestamp, service string, line string")
    table.write.parquet(str(tmp_path / "logs"))
    batch = logs.count_over_time(logs.select_lines(table, pattern="(?i)ERROR"), "5 minutes", "1 minute", ("service",))
    stream = logs.count_over_time(logs.select_lines(spark.readStream.schema(table.schema).parquet(str(tmp_path / "logs")), pattern="(?i)ERROR"), "5 minutes", "1 minute", ("service",))
    running = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    running.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def plain_chunks(text, most):
    if len(text) <= most:
        return [(0, len(text))]
    runs, start, used, held = [], 0, 0, False
    for p in text.split("\n\n"):
        more = len(p) + 2 * held
        if used + more <= most:
            used += more
        else:
            runs.append((start, start + used))
            start, used = start + used + 2, len(p)
        held = True
    runs.append((start, start + used))
    return [(s, min(s + most, e)) for a, e in runs for s, e in ([(x, e) for x in range(a, e, most)] if e - a > most else [(a, e)])]


def test_paragraph_chunks(spark):
    rng = random.Random(3)
    texts = ["", "short", "x" * 50, "y" * 20 + "\n\n" + "z" * 3] + ["\n\n".join("w" * rng.randint(0, 30) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    got = {}
    for r in documents.paragraph_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop))
    assert got == {i: plain_chunks(t, 20) for i, t in enumerate(texts)}


def test_packed_batches(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 15) for _ in range(200)]
    batch, used, want = 0, 0, []
    for n in sizes:
        if used and used + n > 20:
            batch, used = batch + 1, 0
        used += n
        want.append(batch)
    got = documents.packed(spark.createDataFrame([("c", i, i, n) for i, n in enumerate(sizes)], "ctx string, ord int, doc int, tokens long"), 20)
    assert [r.batch for r in got.orderBy("doc").collect()] == want


def test_nested_documents(spark):
    texts = ["a", "</End of File: x>", "<Start of File: x>", "b", "<Start of File: y>", "c", "</End of File: y>", "</End of File: x>", "d", "<Start of File: z>", "e"]
    parts = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "ctx string, ord int, text string")
    assert [r.doc_at for r in documents.parse_documents(parts).orderBy("ord").collect()] == [None, None, 2, 2, 2, 2, 2, 2, None, 9, 9]


def test_shortened_texts(spark):
    rows = spark.createDataFrame([("a\x00b  c",), ("one two three",), ("onetwothree four",), (None,)], "x string")
    assert [r[0] for r in rows.select(text.shorten(F.col("x"), 8)).collect()] == ["a b c", "one two", "onetwoth", ""]


def test_html_entities(spark):
    page = "<p>Fish &amp; chips&nbsp;&#8364;5 &#x4e2d; &amp;lt; x&lt;y</p><script>no</script><!-- no -->"
    assert spark.createDataFrame([(page,)], "x string").select(text.html_text(F.col("x"))).first()[0] == "Fish & chips €5 中 &lt; x<y"


def test_json_repair(spark):
    rows = [('{"a": 1}',), ('x {"a": 1} y',), ('{"a": [1, {"b": "c',), ("none",), (None,), ('{"a": "}"',)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(text.tolerant_json(F.col("x"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', None, None, None, None]
    cut = {'{"a":{"x":1},"b":': '{"a":{"x":1}}', '{"divs":[{"n":"x"},{"n":': '{"divs":[{"n":"x"}]}', '{"a": [1, {"b": 2}, "cut': '{"a": [1, {"b": 2}]}', '{"a": 1}]': '{"a": 1}', '{"a": 1}}': None, '{"a": 1} and': '{"a": 1}', '1, 2': None, '1, "b": 2': None, '{"a": [1]]': None, ' [1] ': "[1]"}
    rows = spark.createDataFrame([(k,) for k in cut], "x string").select("x", text.tolerant_json(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cut


def test_subtotals(spark):
    sure = ["TOTAL  CARRIED 5", "Total-Brought 10", "total - carried  AED: 3,000.00", "C/F", "cfwd 7", "B/Fwd: 12.50", "SUB   TOTAL", "amount carried to the summary", "Carried to bill 3", " to collection aed ", "Total carried"]
    other = ["Total for section 2", "Totalcarried 5", "Page total of 7", "CARRIED TO", "", None, "total carried forwards 5", "total - carried AED: 3", "Excavation"]
    rows = spark.createDataFrame([(x,) for x in sure + other], "x string").select("x", text.is_subtotal(F.col("x")).alias("y")).collect()
    assert {r.x for r in rows if r.y} == set(sure)


def test_normalized_bids(spark):
    kinds = "division string, grouping string, sub_group string, item int, idx int, vendor string, vendor_ord int, amount double, override double, included boolean, wrong boolean"
    place = lambda item, *more: ("d", "g", "s", item, 0, *more)
    rows = [place(1, "A", 0, 10.0, None, True, False), place(1, "B", 1, 30.0, None, False, False), place(1, "C", 2, None, None, False, False), place(2, "A", 0, 5.0, None, False, True), place(2, "B", 1, None, None, False, False), place(2, "C", 2, None, 7.0, False, False), place(3, "A", 0, 0.0, None, False, False), place(3, "C", 2, 9.0, None, False, True)]
    got = {r.vendor: (r.total, r.priced, r.place) for r in bids.normalized_bids(spark.createDataFrame(rows, kinds)).collect()}
    # item 1 fills with 30, item 2 with 0 as it has no valid price, item 3 with 0, its lowest and median
    assert got == {"A": (0.0, 2, 1), "B": (30.0, 2, 2), "C": (37.0, 3, 3)}


def test_summary_sheets(spark):
    lines = ["# columns: item | total", "| Section A: Site | | 1,000.50 |", "Section A: Site | 0", "Bill 3 - Roof | 20", "B | Paint | none", "b | PAINT | 0", "Masonry | 7 | 0.00", "GRAND TOTAL | 5,000", "Sub total | 9", "12 | 13", None]
    sheet = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)] + [("e", 0, "finishes and masonry"), ("e", 1, "equipment | 4"), ("f", 0, None)], "doc string, line_no int, line string")
    got = {(r.doc, r.division): r.total for r in summaries.division_totals(sheet).collect()}
    assert got == {("d", "Section A: Site"): "1000.50", ("d", "Roof"): "20", ("d", "Paint"): "0", ("d", "MASONRY"): "7", ("e", "MASONRY"): "0", ("e", "EQUIPMENT"): "4"}
    assert {tuple(r) for r in summaries.project_totals(sheet).collect()} == {("d", "5000"), ("e", "4.00")}
    assert {tuple(r) for r in summaries.division_names(sheet).collect()} == {("d", "Section A: Site"), ("d", "Roof"), ("e", "FINISHES"), ("e", "MASONRY"), ("e", "EQUIPMENT")}


def test_evidence_sources(spark):
    docs = spark.createDataFrame([(1, "Tech Offer.pdf", 0, "rfp", None, "r"), (1, "tech offer.docx", 1, "tender", "a", "ta"), (1, "Tech Offer", 2, "tender", "b", "tb"), (2, "Other.pdf", 0, "rfp", None, "o"), (2, "Bare.pdf", 1, "rfp", None, None)], "package int, display string, ord int, context string, contractor string, url string")
    rows = [(1, "a", "TECH OFFER.PDF"), (1, "b", "tech offer"), (1, "c", "Tech Ofer.pdf"), (2, "a", " other "), (2, "a", "bare.pdf"), (2, "a", "zzzz"), (2, None, None), (2, "a", ""), (2, "a", "zzzz")]
    given = spark.createDataFrame(rows, "package int, contractor string, source string")
    got = sorted((tuple(r) for r in summaries.evidence_sources(given, docs).collect()), key=str)
    want = ["ta", "tb", "ta", "o", "bare.pdf", "zzzz", None, "", "zzzz"]
    assert got == sorted((r + (w,) for r, w in zip(rows, want)), key=str)


def nodes(df):
    """The names of a plan's operators, as first planned."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_grids_of_a_compressed_template_are_not_broadcast(spark, tmp_path):
    """A template that is small as a file, but not as rows: neither it nor its grid with the vendors goes to the driver."""
    spark.range(3000).selectExpr("'D' AS division", "'G' AS grouping", "'s' AS sub_group", "id AS item", "0 AS idx").write.parquet(str(tmp_path / "t"))
    template = spark.read.parquet(str(tmp_path / "t")).withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1))))
    given = spark.range(6000).selectExpr("'D' AS division", "'G' AS grouping", "'s' AS sub_group", "id AS item", "0 AS idx", "concat('V', id % 3) AS vendor", "cast(id AS int) AS vendor_ord", "1.0D AS qty", "2.0D AS rate", "null AS amount", "id AS ord")
    given = given.withColumn("amount", F.col("amount").cast("double"))
    for df in (bids.warn_missing(given, template), bids.unpriced(given, template), bids.fill_rates(given, template, "mean"), bids.match_cascade(template, given)):
        assert "Broadcast" not in nodes(df)


def test_grids_keep_repeated_and_unnamed_rows(spark):
    """Repeated places of a template, repeated bids, a bid without a vendor and one without an id."""
    kinds = "division string, grouping string, sub_group string, item long, idx int, vendor string, rate double, amount double, ord long"
    row = lambda item, vendor, rate, ord: ("D", "G", "s", item, 0, vendor, rate, None, ord)
    given = spark.createDataFrame([row(1, "a", 2.0, 0), row(1, "a", 4.0, 1), row(1, None, 9.0, 2), row(None, "b", 5.0, 3)], kinds)
    template = spark.createDataFrame([("D", "G", "s", 1, 0), ("D", "G", "s", 1, 0), ("D", "G", "s", None, 0)], kinds.split(", vendor")[0])
    assert Counter(tuple(r)[3:] for r in bids.fill_rates(given, template, "lowest").collect()) == Counter({(1, 0, "a", 2.0, False): 2, (1, 0, "a", 4.0, False): 2, (1, 0, "b", 2.0, True): 2, (1, 0, None, 2.0, True): 2, (None, 0, None, None, True): 1, (None, 0, "a", None, True): 1, (None, 0, "b", None, True): 1})
    assert Counter(tuple(r)[3:] for r in bids.unpriced(given, template).collect()) == Counter({(1, 0, "b"): 2, (1, 0, None): 2, (None, 0, "a"): 1, (None, 0, "b"): 1, (None, 0, None): 1})
    assert {tuple(r)[3:] for r in bids.match_cascade(template, given).collect()} == {(1, 0, "a", 4.0, None, 1), (1, 0, "b", None, None, None), (1, 0, None, None, None, None), (None, 0, "a", None, None, None), (None, 0, "b", 5.0, None, 1), (None, 0, None, None, None, None)}


def test_summaries_are_read_once(spark):
    """Lines are parsed once, dealt by document once, and meet no second reading of themselves."""
    lines = spark.createDataFrame([(1, 1, "Section A : Roof | 5"), (1, 2, "section a : roof | "), (1, 3, "Sub-Total | 7"), (2, 1, "all finishes | 3"), (2, 2, "finishes, masonry | 1")], "doc long, line_no long, line string")
    for make in (summaries.division_totals, summaries.project_totals, summaries.project_names, summaries.division_names):
        plan = make(lines)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan, plan
    assert Counter(map(tuple, summaries.division_totals(lines).collect())) == Counter([(1, "Section A : Roof", "5"), (2, "FINISHES", "3"), (2, "MASONRY", "1")])
    assert sorted(map(tuple, summaries.project_totals(lines).collect())) == [(1, "7"), (2, "4.00")]
    assert sorted(map(tuple, summaries.division_names(lines).collect())) == [(1, "Section A : Roof"), (2, "FINISHES"), (2, "MASONRY")]


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_line_states_in_one_order(spark):
    """Names in force need one order of the lines: a header's own line counts, and so does a name in a line with a header above it."""
    from tallyspark.operators import documents

    rng = random.Random(3)
    rows = [(d, i, *(f"{m}{i}" if rng.random() < 0.3 else None for m in "dgs")) for d in range(20) for i in range(12)]
    table = spark.createDataFrame(rows, "doc int, line_no int, a string, b string, c string")
    out = documents.line_states(table, F.col("a"), F.col("b"), F.col("c"))
    want, state, last = {}, [None] * 3, None
    for doc, i, *own in rows:
        if doc != last:
            state, last = [None] * 3, doc
        for k in range(3):
            if own[k]:
                state = [*state[:k], own[k], *[None] * (2 - k)]
        want[doc, i] = (*state, any(own))
    assert {(r.doc, r.line_no): (r.division, r.grouping, r.sub_group, r.header) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_layered_pages_are_not_sorted(spark):
    from tallyspark.operators import documents

    rows = [(1, 1, 10.0), (1, 1, 8.0), (1, 2, 10.0), (1, 2, 7.9), (1, 3, 0.0), (1, 3, 0.0), (1, 4, None), (1, 4, 3.0), (1, 5, 3.0), (1, 5, None), (1, 5, 3.0), (2, 1, -1.0), (2, 1, -1.0)]
    out = documents.layered(spark.createDataFrame(rows, "doc int, page int, area double"))
    assert sorted((r.doc, r.page) for r in out.collect()) == [(1, 1), (1, 5)]
    assert "Window" not in plan_of(out)


def test_weights_are_dealt_in_as_many_rounds_as_are_off(spark):
    from tallyspark.operators import scoring

    rows = [(1, [1.0, 1.0, 1.0]), (2, [50.0, 50.0]), (3, [0.0] * 7), (4, [1000.0] + [0.1] * 60), (5, [])]
    out = scoring.normalized_rubrics(spark.createDataFrame(rows, "rubric int, weights array<double>"))
    got = {r.rubric: r.normalized for r in out.collect()}
    assert got[1] == [33.0, 33.5, 33.5] and got[2] == [50.0, 50.0] and got[5] is None
    assert all(sum(got[k]) == 100.0 and min(got[k]) >= 1.0 for k in (1, 2, 3, 4))
    assert "least(abs(" in plan_of(out)  # the rounds, by what is off
