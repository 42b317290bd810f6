import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cutting
from tallyspark.operators import budgets, documents, sections

LETTERS = ["a", "é", "中", "\U0001f600", ". ", "! ", "?  ", "\n", "\r\n", " ", "word ", "longerword", "\x85", " "]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["", "a", "\U0001f600" * 50, ". . . ", "\n\n\n"] + ["".join(rng.choices(LETTERS, k=rng.randint(0, 200))) for _ in range(n)]


def plain_pieces(text, most_bytes, most_tokens, per_token):
    fits = lambda t: len(t.encode()) <= most_bytes and max(1, int(len(t) / per_token)) <= most_tokens
    runs = [[]]  # units that may share a piece
    for line in text.splitlines(keepends=True):
        if fits(line):
            runs[-1].append(line)
            continue
        runs.append([])
        for sentence in (x for x in re.split(r"(.*?[.!?]\s+)", line, flags=re.S) if x):
            if fits(sentence):
                runs[-1].append(sentence)
                continue
            while sentence:
                n = max(n for n in range(1, len(sentence) + 1) if fits(sentence[:n]))
                runs += [[sentence[:n]], []]
                sentence = sentence[n:]
        runs.append([])
    out = []
    for run in runs:
        held = ""
        for unit in run:
            if held and not fits(held + unit):
                out.append(held)
                held = ""
            held += unit
        out += [held] if held else []
    return out


@pytest.mark.parametrize("most_bytes,most_tokens,per_token", [(4, 1, 1.0), (17, 3, 2.5), (64, 1000, 4.0), (10_000, 5, 4.0), (10_000, 10_000, 4.0)])
def test_budget_cuts(most_bytes, most_tokens, per_token):
    for text in texts(150):
        cuts = cutting.budget_cuts(text, most_bytes, most_tokens, per_token)
        pieces = [text[a:b] for a, b in cuts]
        assert "".join(pieces) == text and all(pieces)
        assert all(len(p.encode()) <= most_bytes and max(1, int(len(p) / per_token)) <= most_tokens for p in pieces)
        assert pieces == plain_pieces(text, most_bytes, most_tokens, per_token)


def test_cuts_by_a_true_count():
    count = lambda t: sum(3 if ord(c) > 127 else 1 for c in t)
    for text in texts(60, 8):
        pieces = [text[a:b] for a, b in cutting.counted_cuts(text, 40, 12, count, 20)]
        assert "".join(pieces) == text
        assert all(len(p.encode()) <= 40 and (count(p) <= 12 or len(p) == 1) for p in pieces)


def test_budget_chunks(spark):
    rows = [(i, t) for i, t in enumerate([*texts(40), None, "long " * 60_000])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, text string, chunk int")
    got = sorted(tuple(r) for r in budgets.budget_chunks(docs, 64, 10).collect())
    want = [(i, k, a, b, t[a:b]) for i, t in rows if t for k, (a, b) in enumerate(cutting.budget_cuts(t, 64, 10, 4.0))]
    assert got == want
    words = budgets.budget_chunks(docs, 64, 5, count=lambda t: len(t.split())).collect()
    assert all(len(r.text.split()) <= 5 for r in words)
    assert budgets.budget_chunks(docs.limit(0), 64, 10).collect() == []
    with pytest.raises(ValueError):
        budgets.budget_chunks(docs, 3, 10)


def linear(texts, most, count):
    out, start = [], 0
    while start < len(texts):
        stop = start + 1
        while stop < len(texts) and count(texts[start : stop + 1]) <= most:
            stop += 1
        out.append((start, stop))
        start = stop
    return out


def test_count_chunks_equal_a_linear_scan(spark):
    rng = random.Random(1)
    rows = [(c, o, rng.choice([None, "", "x" * rng.randint(0, 4000)])) for c in range(30) for o in range(rng.randint(1, 40))]
    counts = {"estimate": budgets.estimated_tokens, "distinct": lambda ts: len(set("".join(t or "" for t in ts))) + len(ts) // 3}
    for name, most in (("estimate", 1500), ("distinct", 4)):
        count = counts[name]
        got = {(r.ctx, r.ord): r.chunk for r in budgets.count_chunks(spark.createDataFrame(rows, "ctx int, ord int, text string").repartition(4), most, count).collect()}
        want = {(c, o): k for c in range(30) for k, (a, b) in enumerate(linear([t for x, _, t in rows if x == c], most, count)) for o in range(a, b)}
        assert got == want
    calls = []
    cutting.prefix_chunks(10_000, 6_000, lambda a, b: calls.append(1) or b - a)
    assert len(calls) < 80  # not one for each part


def test_count_chunks_where_counts_add_up_pack_greedily(spark):
    rng = random.Random(2)
    rows = [(c, o, "x" * 4 * rng.randint(1, 30)) for c in range(10) for o in range(25)]
    df = spark.createDataFrame(rows, "ctx int, ord int, text string")
    chunks = {(r.ctx, r.ord): r.chunk for r in budgets.count_chunks(df, 60).collect()}
    packs = {(r.ctx, r.doc): r.batch for r in documents.packed(df.select("ctx", "ord", F.col("ord").alias("doc"), (F.length("text") / 4).cast("int").alias("tokens")), 60).collect()}
    assert chunks == packs


def plain_plan(docs, target, least, ceiling, batch):
    excess = sum(max(1, c) if c is not None else t for _, _, t, c in docs) - target
    if excess <= 0:
        return set()
    out, saved, small = set(), 0, []
    fresh = sorted((d for d in docs if d[3] is None), key=lambda d: (-d[2], d[0]))
    for o, name, tokens, _ in fresh:
        if ceiling and tokens > ceiling:
            out.add((name, "forced", None))
    for o, name, tokens, _ in fresh:
        if saved >= excess:
            break
        if (name, "forced", None) in out or tokens >= least:
            out.discard((name, "forced", None))
            out.add((name, "single", None))
            saved += int(tokens * 0.8)
        else:
            small.append((name, tokens))
    batches, held = [], []
    for name, tokens in small:
        if saved >= excess:
            break
        if held and sum(t for _, t in held) + tokens > batch:
            batches.append(held)
            saved += int(sum(t for _, t in held) * 0.7)
            held = []
        held.append((name, tokens))
    if held and saved < excess:
        batches.append(held)
    return out | {(name, "batch", k) for k, b in enumerate(batches) for name, _ in b}


def test_summary_plan_against_a_plain_loop(spark):
    rng = random.Random(6)
    docs = [(c, o, f"d{o}", rng.choice([1, 5, 20, 20, 60, 150, 400]), rng.choice([None, None, None, 0, 9])) for c in range(80) for o in range(rng.randint(1, 14))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "ctx int, ord int, doc string, tokens int, cached int, kind string")
    for target, least, ceiling, batch in ((100, 100, 0, 50), (300, 50, 120, 40), (40, 500, 300, 60), (10_000, 10, 10, 10)):
        got = {(r.ctx, r.doc, r.kind, r.batch) for r in budgets.summary_plan(df, target, least, ceiling, batch).collect()}
        want = {(c, *x) for c in range(80) for x in plain_plan([d[1:] for d in docs if d[0] == c], target, least, ceiling, batch)}
        assert got == want
    assert budgets.summary_plan(df.limit(0), 1, 1).collect() == []


def plain_squeeze(docs, target, hard, chunk, summary, ceiling, batch, passes, stall, placeholder, shrink):
    """docs: [(ord, name, tokens)]."""
    total = lambda ds: sum(t for _, _, t in ds)

    def tighten(now, step, over):
        f = max(0.05, 1.0 / max(1.0, over) * 0.7 ** (step - 1))
        return max(30_000, int(chunk * f)), max(3_000, int(summary * f)), max(10_000, int(now[2] * f)) if now[2] > 0 else now[2]

    def compress(ds, goal, now):
        plan = {name: kind for name, kind, _ in plain_plan([(*d, None) for d in ds], goal, max(1000, now[0] // 100), now[2], batch)}
        return [(o, n, shrink(t, plan[n], now[1]) if n in plan else t) for o, n, t in ds]

    if total(docs) <= target:
        return docs, 0, "fits"
    now, best, last = (chunk, summary, ceiling), docs, docs
    if total(docs) / target > 5:
        now = tighten(now, 1, total(docs) / target)
    for step in range(1, passes + 1):
        before = total(last)
        if step > 1:
            now = tighten(now, step, before / target)
        last = compress(last, hard if step == passes else target, now)
        if total(last) < total(best):
            best = last
        if total(last) <= target:
            return last, step, "fits"
        if step >= 3 and 1 - total(last) / max(1, before) < stall:
            break
    if total(best) <= hard:
        return best, step, "hard"
    urgent = compress(best, hard, (30_000, 3_000, max(10_000, ceiling)))
    if total(urgent) < total(best):
        best = urgent
    if total(best) <= hard:
        return best, step, "emergency"
    left = total(best)
    out = {n: t for _, n, t in best}
    for o, n, t in sorted(best, key=lambda d: (-max(0, d[2] - placeholder), -d[2], -d[0])):
        if left <= hard or t <= placeholder:
            break
        out[n], left = placeholder, left - (t - placeholder)
    return [(o, n, out[n]) for o, n, _ in best], step, "capped"


@pytest.mark.parametrize("setting", [dict(target=40_000, hard=60_000, ceiling=30_000), dict(target=9_000, hard=12_000, ceiling=0, passes=3), dict(target=30_000, hard=31_000, ceiling=20_000, passes=5, stall=0.2)])
def test_squeeze_against_a_plain_loop(spark, setting):
    rng = random.Random(setting["target"])
    setting = dict(chunk=500_000, summary=8_000, batch=20_000, passes=10, stall=0.03, placeholder=12) | setting
    docs = [(c, o, f"d{o}", rng.choice([40, 700, 3_000, 9_999, 15_000, 28_000, 50_000]) + rng.randint(0, 50)) for c in range(40) for o in range(rng.randint(1, 9))]

    def shrink(tokens, kind, summary):
        if tokens > 12_000:
            return int(tokens * 0.99)
        return min(tokens, max(1, int(tokens * 0.3) if kind == "batch" else min(int(tokens * 0.2), summary)))

    def column(tokens, kind, summary):
        return F.when(tokens > 12_000, F.floor(tokens * 0.99).cast("long")).otherwise(budgets.summarised(tokens, kind, summary))

    got = {}
    for r in budgets.squeezed(spark.createDataFrame(docs, "ctx int, ord int, doc string, tokens int"), shrink=column, **setting).collect():
        got.setdefault(r.ctx, (set(), r.passes, r.outcome))[0].add((r.ord, r.doc, r.tokens))
    want = {}
    for c in range(40):
        rows, step, outcome = plain_squeeze([d[1:] for d in docs if d[0] == c], shrink=shrink, **setting)
        want[c] = (set(rows), step, outcome)
    assert got == want
    assert {"fits", "capped"} <= {o for _, _, o in want.values()}
    assert setting["target"] != 40_000 or "hard" in {o for _, _, o in want.values()}


def test_a_squeeze_takes_one_shuffle_and_no_sort_of_its_own(spark, capsys):
    """However many passes there are, a task holds the gathered contexts alone."""
    df = spark.range(400).selectExpr("id % 50 AS ctx", "CAST(id AS int) AS ord", "id AS doc", "CAST(id * 99 AS int) AS tokens")
    for passes in (1, 10):
        budgets.squeezed(df, 9_000, 12_000, passes=passes).explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan and "Checkpoint" not in plan


A, B, END = *budgets.BEGIN_MARKS, budgets.END_MARK


def regions(spark, parts):
    df = spark.createDataFrame([("c", i, "text" if t is not None else "uri", t) for i, t in enumerate(parts)], "ctx string, ord int, kind string, text string")
    return budgets.split_regions(df)


@pytest.mark.parametrize("parts,want", [
    (["p", None, A, "x", None, f"y {END}", "s", A], "pp cccc ss"),
    ([B + END, "x", END], " ccc "),
    ([A, "x"], " cc "),
    (["p", "q", None], "p cc "),
    ([None, "q"], " cc "),
    (["p", A, "no end"], "p cc "),
])
def test_regions(spark, parts, want):
    got = "".join(r.region[0] for r in regions(spark, parts).orderBy("ord", "piece").collect())
    assert got == want.replace(" ", "")


def test_a_single_part_is_cut(spark):
    got = [(r.region, r.text) for r in regions(spark, [f"ask {B} and {A} tail"]).orderBy("piece").collect()]
    assert got == [("prefix", f"ask {B} and "), ("context", f"{A} tail")]
    assert [(r.region, r.text) for r in regions(spark, [f" \n{A}x"]).collect()] == [("context", f" \n{A}x")]
    assert [(r.region, r.text) for r in regions(spark, [f"é\U0001f600 {A}x"]).orderBy("piece").collect()] == [("prefix", "é\U0001f600 "), ("context", f"{A}x")]


def test_reassembly(spark):
    one, done = "<Start of File: a.pdf>", "</End of File: a.pdf>"
    parts = ["ask", A, one, "t1", None, done, "loose", "<Start of File: b.pdf>", "u", "</End of File: b.pdf>", END, "after"]
    split = regions(spark, parts)
    plain = [r.text for r in budgets.reassembled(split).orderBy("at").collect()]
    assert plain == ["ask", A, "loose", END, one, "t1", None, done, "<Start of File: b.pdf>", "u", "</End of File: b.pdf>", "after"]
    summaries = spark.createDataFrame([("c", "a.pdf", "short"), ("x", "b.pdf", "no")], "ctx string, name string, summary string")
    assert [r.text for r in budgets.reassembled(split, summaries).orderBy("at").collect()] == ["ask", A, "loose", END, one, "short", done, *plain[8:]]
    # documents after what lies between them, and nothing else: the parts' hash comes back
    df = spark.createDataFrame([("c", i, "text", t) for i, t in enumerate(["ask", A, one, "t1", done, END])], "ctx string, ord int, kind string, text string")
    restored = budgets.split_regions(df).select("ctx", "ord", "kind", "text")
    assert documents.content_hash(restored).collect() == documents.content_hash(df).collect()


def plain_segments(lines, names):
    up = [x.upper() for x in lines]
    bare = [x.strip().strip("|").strip() for x in up]
    place, keys = [], set()
    for name in names:
        whole = name.upper().strip()
        key = whole.split(":")[-1].strip()
        if not key:
            continue
        for tier in (1, 2, 3):
            at = None
            for i, x in enumerate(bare):
                if any(c in x for c in sections.CONTINUED):
                    continue
                section, bill = re.match(sections.SECTION, x), re.match(sections.BILL, x)
                told = x[section.end() :].strip() if tier == 1 and section else bill[1].strip() if tier == 2 and bill else x if tier == 3 and len(x) < max(len(whole), len(key)) + 25 else ""
                if told and (whole in told or key in told):
                    at = i
                    break
            if at is not None:
                if key not in keys:
                    keys.add(key)
                    place.append((at, name, tier))
                break
    if len(place) < 2:
        return []
    place.sort(key=lambda x: x[0])
    stops = [p[0] for p in place[1:]] + [len(lines)]
    return [(n, t, "\n".join(lines[a:b]).strip()) for (a, n, t), b in zip(place, stops) if "\n".join(lines[a:b]).strip()]


def test_segments_against_a_plain_loop(spark):
    rng = random.Random(12)
    pool = ["Site Work", "Roof", "Section B: Roof", "Doors", "Doors and Windows", "X:", "", "finishes", "Masonry", " é work "]
    heads = ["| Section {} : {} |", "section {}:{}", "Bill No. 3 – {1}", "BILL 4: {1} more", "{1}", "| {1} | 5", "{1} (CONT'D)", "Section {}: {} (continued)", "{1} with a tail that is far too long to be a header", "nothing", "", " | "]
    docs = {d: ([rng.choice(heads).format("A", rng.choice(pool)) for _ in range(rng.randint(0, 14))], rng.sample(pool, rng.randint(0, 8))) for d in range(120)}
    lines = spark.createDataFrame([(d, i, x, "z") for d, (ls, _) in docs.items() for i, x in enumerate(ls)], "doc int, line_no int, line string, name string").repartition(5)
    names = spark.createDataFrame([(d, i, n) for d, (_, ns) in docs.items() for i, n in enumerate(ns)], "doc int, ord int, name string")
    got = {}
    for r in sections.division_segments(lines, names).orderBy("doc", "start").collect():
        got.setdefault(r.doc, []).append((r.name, r.tier, r.text))
    want = {d: s for d, (ls, ns) in docs.items() if (s := plain_segments(ls, ns))}
    assert got == want and {t for s in want.values() for _, t, _ in s} == {1, 2, 3}


def test_segments_go_by_document(spark, capsys):
    """Lines and names that are dealt by document aren't shuffled again, and a header's marks are no work for each name."""
    lines = spark.createDataFrame([(1, 0, "Roof"), (1, 1, "\u3000| Section A : doors |\x85"), (1, 2, "x")], "doc int, line_no int, line string").repartition(3, "doc")
    names = spark.createDataFrame([(1, 0, "Part: Doors"), (1, 1, "roof\u2003")], "doc int, ord int, name string").repartition(3, "doc")
    out = sections.division_segments(lines, names)
    assert sorted((r.name, r.tier, r.text) for r in out.collect()) == [("Part: Doors", 1, "| Section A : doors |\x85\nx"), ("roof\u2003", 3, "Roof")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sections.division_segments(lines, names).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert capsys.readouterr().out.count("Exchange") == 3  # the lines, twice, and the names


def plain_resolved(sheet, text, given, names):
    def summary(name):
        for k in names:
            if name and k and (name.upper().strip() in k.upper() or k.upper() in name.upper().strip()):
                return k
        return name

    text, given = text or "", (given or "").strip()
    if given and not re.match(sections.CODE, given):
        return summary(given), 1
    held = [k for k in names if k and k.upper() in text.upper()]
    if len(held) == 1:
        return held[0], 2
    head = text[:2000].upper()
    for known in sections.KNOWN:
        if known in head:
            return summary(known), 3
    if m := re.search(sections.BILL_NAME, head):
        return summary(m[1].strip()), 4
    if m := re.search(sections.BARE_NAME, head):
        return summary(m[1].strip()), 5
    return summary(sheet or ""), 6


def test_resolved_divisions_against_a_plain_chain(spark):
    rng = random.Random(8)
    parts = ["Alpha works", "beta", "Masonry", "site work", "Bill 4: roofs & more", "GROUND FLOOR", "12 | 5", "Lifts", "x", "\n", "\n", "  "]
    sheets = [(i, rng.choice(["S1", "beta", "", None]), rng.choice([None, "", "x" * 2000 + "masonry"]) if rng.random() < 0.2 else "".join(rng.choices(parts, k=rng.randint(0, 5))), rng.choice([None, None, "", " beta ", "Bill 7", "#1-x", "1 - a", "Roofs"])) for i in range(250)]
    names = {i: rng.sample(["Alpha", "BETA", "beta two", "Roofs & more", "ground floor", "", "Masonry works"], rng.randint(0, 4)) for i in range(250)}
    df = spark.createDataFrame([(*s, 1) for s in sheets], "doc int, sheet_name string, text string, given string, tier int")
    listed = spark.createDataFrame([(i, k, n) for i, ns in names.items() for k, n in enumerate(ns)], "doc int, ord int, name string")
    got = {r.doc: (r.division, r.tier) for r in sections.resolved_divisions(df.drop("tier"), listed).collect()}
    want = {i: plain_resolved(s, t, g, names[i]) for i, s, t, g in sheets}
    assert got == want and {t for _, t in want.values()} == {1, 2, 3, 4, 5, 6}
    assert sections.resolved_divisions(df.limit(0).drop("tier"), listed).collect() == []


def test_long_lists_and_nulls(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, "Roof"), (1, 1, None), (1, 2, "Doors")], "doc int, line_no int, line string")
    names = spark.createDataFrame([(1, 0, "roof"), (1, 1, None), (1, 2, "doors")], "doc int, ord int, name string")
    assert sorted((r.name, r.text) for r in sections.division_segments(lines, names).collect()) == [("doors", "Doors"), ("roof", "Roof")]
    assert sections.division_segments(lines, names.limit(0)).collect() == []
    monkeypatch.setattr(sections, "MOST_NAMES", 1)
    with pytest.raises(Exception, match="more than 1 names"):
        sections.division_segments(lines, names).collect()


def test_digest_of_joined_pieces():
    text = "".join(texts(30))
    assert hashlib.sha256("".join(text[a:b] for a, b in cutting.budget_cuts(text, 100, 20, 4.0)).encode()).digest() == hashlib.sha256(text.encode()).digest()


def test_workers_hold_few_texts_at_once(spark):
    from tallyspark.operators import budgets

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('a word. ', 40) AS text")
    out = budgets.budget_chunks(docs, 100, 20).select("doc_id", "text").collect()
    assert int(spark.conf.get(key)) == budgets.BATCH_ROWS <= 256
    spark.conf.set(key, before)
    held = {}
    for r in sorted(out, key=lambda r: r.doc_id):
        held[r.doc_id] = held.get(r.doc_id, 0) + len(r.text)
    assert set(held.values()) == {320} and len(held) == 1000


def test_rows_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    """A task's rows don't grow with the table, and the result is the same."""
    from tallyspark.plans import chunking, relational
    from tallyspark.sources import tables

    whole = tables.load(spark, "/root/testdata/sf0.001", "lineitem")
    assert tables.dealt(whole, "l_orderkey", 400).rdd.getNumPartitions() == -(-whole.count() // 400)
    assert tables.dealt(whole, "l_orderkey").rdd.getNumPartitions() == whole.rdd.getNumPartitions()
    for query in (relational.clause_consolidate, chunking.boq_division_segments, chunking.ctx_squeezed):
        want = sorted(query(spark, "/root/testdata/sf0.001").collect(), key=str)
        monkeypatch.setattr(tables, "TASK_ROWS", 400)
        dealt = query(spark, "/root/testdata/sf0.001")
        monkeypatch.undo()
        assert "RepartitionByExpression" in dealt._jdf.queryExecution().toString() and sorted(dealt.collect(), key=str) == want
