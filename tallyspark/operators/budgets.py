"""Texts, parts and documents of a context brought within budgets of bytes and tokens.

Parts are rows (ctx, ord, kind, text) of a context, documents rows (ctx, ord, doc, tokens, cached); a context is what one
model reads, so its rows are few and one task holds them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyspark.functions.cutting import budget_cuts, counted_cuts, prefix_chunks
from tallyspark.operators.documents import close_tag, open_tag, packed, parse_documents

MEDIA_TOKENS = 512

# Marks that open and close the documents among a context's parts.
BEGIN_MARKS = ("### BEGIN RFP-REFERENCE", "### BEGIN CONTRACTOR-SUBMISSION")
END_MARK = "### END CONTRACTOR-SUBMISSION"


#: Texts that a Python worker holds at once.
BATCH_ROWS = 256


def small_batches(session: SparkSession) -> None:
    """Bound what a Python worker holds of long texts, whatever the table's size."""
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cuts(text: Column, most_bytes: int, most_tokens: int, per_token: float = 4.0, count: Callable[[str], int] | None = None) -> Column:
    """Array of (start, stop), in characters, of the pieces of a text under both budgets, which join to it; by an estimate
    of characters a token, or by `count`. A null or empty text has none. A code point is never cut, so fewer than 4 bytes
    are an error."""
    if most_bytes < 4 or most_tokens < 1 or per_token < 1:
        raise ValueError("a budget of 4 bytes, 1 token and 1 character a token at least")

    def one(t: str) -> list[tuple[int, int]]:
        return counted_cuts(t, most_bytes, most_tokens, count) if count else budget_cuts(t, most_bytes, most_tokens, per_token)

    @pandas_udf("array<struct<start:int,stop:int>>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in one(t)] for t in texts])

    return made(F.coalesce(text, F.lit("")))


def piece(text: Column, cut: Column) -> Column:
    return F.substring(text, cut["start"] + 1, cut["stop"] - cut["start"])


def budget_chunks(docs: DataFrame, most_bytes: int, most_tokens: int, per_token: float = 4.0, count: Callable[[str], int] | None = None) -> DataFrame:
    """doc_id, chunk, start, stop, text: see `cuts`."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.posexplode(cuts(F.col("text"), most_bytes, most_tokens, per_token, count)).alias("chunk", "cut"))
    return rows.select("doc_id", "chunk", "cut.start", "cut.stop", piece(F.col("text"), F.col("cut")).alias("text"))


def estimated_tokens(texts: list[str | None]) -> int:
    """Tokens of parts together; a part without text is a picture. Not the sum of the parts' own, as it rounds once."""
    return sum(len(t) for t in texts if t is not None) // 4 + MEDIA_TOKENS * sum(t is None for t in texts)


def count_chunks(parts: DataFrame, most: int, count: Callable[[list[str | None]], int] = estimated_tokens) -> DataFrame:
    """ctx, ord, chunk: a context's parts in order, in the longest runs that count `most` tokens at most; a part that
    counts more is alone. `count` is any count of a run of texts that doesn't fall when the run grows."""
    kind = dict((f.name, f.dataType.simpleString()) for f in parts.schema)

    def chunked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        texts = [None if pd.isna(t) else t for t in rows["text"]]
        runs = prefix_chunks(len(texts), most, lambda a, b: count(texts[a:b]))
        rows["chunk"] = [i for i, (a, b) in enumerate(runs) for _ in range(a, b)]
        return rows[["ctx", "ord", "chunk"]]

    return parts.select("ctx", "ord", "text").groupBy("ctx").applyInPandas(chunked, f"ctx {kind['ctx']}, ord {kind['ord']}, chunk int")


def summary_plan(docs: DataFrame, target: int | Column, least: int | Column, ceiling: int | Column = 0, batch: int = 50_000, alone: float = 0.8, together: float = 0.7) -> DataFrame:
    """ctx, doc, tokens, kind, batch: what to summarise so that a context's tokens come down to the target. Documents with
    a summary (`cached`, its tokens) count by that and stay.

    Kinds: `single`, the largest first, each saving the share `alone`, from `least` tokens on, or above the ceiling;
    where all of these don't do, `batch`: the smaller ones, largest first, in batches of `batch` tokens that save the share
    `together`, until enough is saved; `forced`, above the ceiling though enough is saved without."""
    context = Window.partitionBy("ctx")
    largest = Window.partitionBy("ctx").orderBy(F.desc("tokens"), "ord")
    before = largest.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    counted = F.when(F.col("cached").isNotNull(), F.greatest("cached", F.lit(1))).otherwise(F.col("tokens"))
    target, least, ceiling = (x if isinstance(x, Column) else F.lit(x) for x in (target, least, ceiling))
    forced = (ceiling > 0) & (F.col("tokens") > ceiling)
    rows = docs.withColumn("_excess", F.sum(counted).over(context) - target)
    rows = rows.filter((F.col("_excess") > 0) & F.col("cached").isNull()).withColumns({"_forced": forced, "_large": forced | (F.col("tokens") >= least)})
    saves = F.when(F.col("_large"), F.floor(F.col("tokens") * alone)).otherwise(0)
    rows = rows.withColumns({"_before": F.coalesce(F.sum(saves).over(before), none), "_all": F.sum(saves).over(context), "_place": F.row_number().over(largest)})
    single = F.col("_large") & (F.col("_before") < F.col("_excess"))
    chosen = rows.select("ctx", "doc", "tokens", F.when(single, "single").when(F.col("_forced"), "forced").alias("kind"), F.lit(None).cast("int").alias("batch")).filter("kind IS NOT NULL")
    small = rows.filter(~F.col("_large") & (F.col("_all") < F.col("_excess")))
    dealt = small.join(packed(small.select("ctx", F.col("_place").alias("ord"), "doc", "tokens"), batch), ["ctx", "doc"])
    sums = dealt.groupBy("ctx", "batch").agg(F.sum("tokens").alias("_tokens"), F.first(F.col("_excess") - F.col("_all")).alias("_lacking"))
    saved = F.sum(F.floor(F.col("_tokens") * together)).over(Window.partitionBy("ctx").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    kept = sums.withColumn("_saved", F.coalesce(saved, none)).filter("_saved < _lacking").select("ctx", "batch")
    return chosen.unionByName(dealt.join(kept, ["ctx", "batch"]).select("ctx", "doc", "tokens", F.lit("batch").alias("kind"), "batch"))


# The settings below which passes don't go, and those of the emergency.
LEAST_CHUNK, LEAST_SUMMARY, LEAST_CEILING, LEAST_SINGLE = 30_000, 3_000, 10_000, 1_000


def summarised(tokens: Column, kind: Column, summary: Column) -> Column:
    """What a document is expected to take once it is summarised: a fifth alone, at most the summary's size, 3 tenths in a
    batch."""
    alone = F.least(F.floor(tokens * 0.2).cast("long"), summary)
    return F.least(tokens, F.greatest(F.lit(1), F.when(kind == "batch", F.floor(tokens * 0.3).cast("long")).otherwise(alone)))


def shrunk(docs: Column, excess: Column, bound: Column, over: Column, batch: int, shrink: Callable[[Column, str], Column], alone: float = 0.8, together: float = 0.7) -> Column:
    """A context's documents after they are summarised as `summary_plan` plans it, and the sum of their tokens. They are an
    array of (least, ord, doc), `least` their tokens below zero, so that it sorts them largest first. From `bound` tokens
    on they are planned alone, above `over` by force; these are the larger ones, so what they save is known before the
    first one for a batch is met."""

    def step(s: Column, d: Column) -> Column:
        tokens = -d["least"]
        large, small = tokens >= bound, tokens < bound
        opens = small & (s["used"] > 0) & (s["used"] + tokens > batch)
        saved = s["saved"] + F.when(opens, F.floor(s["used"] * together)).otherwise(F.lit(0).cast("long"))
        one = F.when(s["before"] < excess, shrink(tokens, "single")).when(tokens > over, shrink(tokens, "forced")).otherwise(tokens)
        new = F.when(large, one).when(small & (saved < excess - s["before"]), shrink(tokens, "batch")).otherwise(tokens)
        before = F.when(large, s["before"] + F.floor(tokens * alone)).otherwise(s["before"])
        used = F.when(opens, tokens).when(small, s["used"] + tokens).otherwise(s["used"])
        out = F.array_append(s["out"], F.struct((-new).alias("least"), d["ord"].alias("ord"), d["doc"].alias("doc")))
        return F.struct(out.alias("out"), before.alias("before"), used.alias("used"), saved.alias("saved"))

    start = F.struct(F.slice(docs, 1, 0).alias("out"), *(F.lit(0).cast("long").alias(c) for c in ("before", "used", "saved")))
    return F.aggregate(F.array_sort(docs), start, step, lambda s: s["out"])


def tokens_of(docs: Column | str) -> Column:
    """The tokens of such an array."""
    return -F.aggregate(docs, F.lit(0).cast("long"), lambda sum, d: sum + F.coalesce(d["least"], F.lit(0).cast("long")))


def placeholders(docs: Column, limit: int, placeholder: int) -> Column:
    """Such an array, its largest savings given way to placeholders until it fits; see `hard_cap`."""
    saving = lambda d: F.greatest(-d["least"] - placeholder, F.lit(0).cast("long"))
    ranked = F.reverse(F.array_sort(F.transform(docs, lambda d: F.struct(saving(d).alias("saving"), (-d["least"]).alias("tokens"), d["ord"].alias("ord"), d["doc"].alias("doc")))))

    def step(s: Column, d: Column) -> Column:
        gives = (s["left"] > limit) & (d["saving"] > 0)
        least = -F.when(gives, F.lit(placeholder).cast("long")).otherwise(d["tokens"])
        out = F.array_append(s["out"], F.struct(least.alias("least"), d["ord"].alias("ord"), d["doc"].alias("doc")))
        return F.struct(out.alias("out"), F.when(gives, s["left"] - d["saving"]).otherwise(s["left"]).alias("left"))

    return F.aggregate(ranked, F.struct(F.slice(docs, 1, 0).alias("out"), tokens_of(docs).alias("left")), step, lambda s: s["out"])


def squeezed(
    docs: DataFrame, target: int, hard: int, chunk: int = 500_000, summary: int = 8_000, ceiling: int = 0, batch: int = 50_000, passes: int = 10, stall: float = 0.03, placeholder: int = 12, shrink: Callable[[Column, Column, Column], Column] = summarised
) -> DataFrame:
    """ctx, ord, doc, tokens, passes, outcome: the documents of each context brought to the target in passes that plan,
    summarise and count again, with settings that tighten by how far the context is over. Outcomes: `fits` the target;
    `hard`, under the hard limit when a pass from the third on saves less than `stall`, or when the passes are used up, of
    which the last aims at the hard limit; `emergency`, after one more pass with the least settings; `capped`, where the
    largest savings give way to placeholders of `placeholder` tokens. `shrink` estimates a document's tokens after a pass
    from its tokens, its kind in the plan and the summary's size; a context keeps its best pass.

    A context's documents are gathered in a row once, as numbers and ids; all passes work on that row, so there is one
    shuffle and no sort but that of the gathering, however many passes are needed."""
    none = F.lit(None).cast("long")
    own = F.struct((-F.col("tokens").cast("long")).alias("least"), "ord", "doc")
    rows = docs.groupBy("ctx").agg(F.collect_list(own).alias("docs")).withColumn("_after", tokens_of("docs"))
    settings = {"chunk": F.lit(chunk).cast("long"), "summary": F.lit(summary).cast("long"), "ceiling": F.lit(ceiling).cast("long"), "passes": F.lit(0)}
    rows = rows.withColumns(settings | {"best": F.col("docs"), "_best": F.col("_after"), "outcome": F.when(F.col("_after") <= target, "fits")})

    def compressed(rows: DataFrame, going: Column, goal: int) -> DataFrame:
        """The rows with `_new`, the documents after a pass, and `_after`, what they take; but where `going` `_new` is null.
        `_total` is what they take before."""
        least = F.greatest(F.lit(LEAST_SINGLE), F.floor(F.col("chunk") / 100)).cast("long")
        forced = F.when(F.col("ceiling") > 0, F.col("ceiling"))
        rows = rows.withColumns({"_bound": F.when(going, F.least(least, forced + 1)), "_over": F.when(going, F.coalesce(forced, F.lit(2**63 - 1)))})
        fresh = lambda tokens, kind: shrink(tokens, F.lit(kind), F.col("summary")).cast("long")
        new = shrunk(F.col("docs"), F.col("_total") - goal, F.col("_bound"), F.col("_over"), batch, fresh)
        rows = rows.withColumn("_new", F.when(going, F.when(F.col("_total") > goal, new).otherwise(F.col("docs"))))
        return rows.withColumn("_after", F.when(going, tokens_of("_new")))

    going = F.col("outcome").isNull()
    for step in range(1, passes + 1):
        rows = rows.withColumn("_total", F.when(going, F.col("_after")).otherwise(none))
        over = F.col("_total") / F.lit(max(1, target))
        factor = F.greatest(F.lit(0.05), 1.0 / F.greatest(F.lit(1.0), over) * F.lit(0.7 ** (step - 1)))
        tightens = going if step > 1 else going & (F.col("_total") > 5.0 * max(1, target))
        scaled = lambda of, least: F.greatest(F.lit(least), F.floor(of * factor)).cast("long")  # noqa: B023, E731
        tight = {"chunk": scaled(F.lit(chunk), LEAST_CHUNK), "summary": scaled(F.lit(summary), LEAST_SUMMARY), "ceiling": F.when(F.col("ceiling") > 0, scaled(F.col("ceiling"), LEAST_CEILING)).otherwise(F.col("ceiling"))}
        rows = compressed(rows.withColumns({c: F.when(tightens, value).otherwise(F.col(c)) for c, value in tight.items()}), going, hard if step == passes else target)
        better = going & (F.col("_after") < F.col("_best"))
        stalls = F.lit(step >= 3) & (1 - F.col("_after") / F.greatest(F.col("_total"), F.lit(1)) < stall)
        ends = F.when(F.col("_after") <= target, "fits").when(stalls | F.lit(step == passes), F.when(F.least("_after", "_best") <= hard, "hard").otherwise("over"))
        moved = {"docs": F.coalesce("_new", "docs"), "best": F.when(better, F.col("_new")).otherwise(F.col("best")), "_best": F.when(better, F.col("_after")).otherwise(F.col("_best"))}
        rows = rows.withColumns(moved | {"passes": F.when(going, F.lit(step)).otherwise(F.col("passes")), "outcome": F.when(going, ends).otherwise(F.col("outcome"))})
    # where the target is met the pass counts as it is, else the best one
    rows = rows.withColumn("docs", F.when(F.col("outcome") == "fits", F.col("docs")).otherwise(F.col("best")))
    urgent = F.col("outcome") == "over"
    rows = rows.withColumns({"_total": F.when(urgent, F.col("_best")), "chunk": F.lit(LEAST_CHUNK).cast("long"), "summary": F.lit(LEAST_SUMMARY).cast("long"), "ceiling": F.lit(max(LEAST_CEILING, ceiling)).cast("long")})
    rows = compressed(rows, urgent, hard)
    gains = urgent & (F.col("_after") < F.col("_total"))
    rows = rows.withColumn("docs", F.when(gains, F.col("_new")).otherwise(F.col("docs")))
    rows = rows.withColumn("outcome", F.when(~urgent, F.col("outcome")).when(F.least("_after", "_total") <= hard, "emergency").otherwise("capped"))
    out = F.when(F.col("outcome") == "capped", placeholders(F.col("docs"), hard, placeholder)).otherwise(F.col("docs"))
    return rows.select("ctx", F.inline(out), "passes", "outcome").select("ctx", "ord", "doc", (-F.col("least")).alias("tokens"), "passes", "outcome")


def split_regions(parts: DataFrame, begin: tuple[str, ...] = BEGIN_MARKS, end: str = END_MARK) -> DataFrame:
    """Parts with `region` (prefix, context, suffix) and `piece`. The context begins with the first part that holds a mark
    of its beginning and ends with the first one after it that holds the mark of its end, or else with the parts; parts
    without text go with those around them. Without marks the first part is the prefix if it is text, the rest context.

    A single part that holds a mark is cut there, its first piece the prefix unless it is blank."""
    order, context = Window.partitionBy("ctx").orderBy("ord"), Window.partitionBy("ctx")
    holds = lambda mark: F.contains(F.coalesce("text", F.lit("")), F.lit(mark))
    opens = F.lit(False)
    for mark in begin:
        opens = opens | holds(mark)
    rows = parts.withColumns({"_n": F.count(F.lit(1)).over(context), "_open": F.min(F.when(opens, F.col("ord"))).over(context), "_first": F.row_number().over(order) == 1})
    rows = rows.withColumn("_end", F.min(F.when((F.col("ord") > F.col("_open")) & holds(end), F.col("ord"))).over(context))
    marked = F.when(F.col("ord") < F.col("_open"), "prefix").when(F.col("_end").isNull() | (F.col("ord") <= F.col("_end")), "context").otherwise("suffix")
    bare = F.when(F.col("_first") & F.col("text").isNotNull(), "prefix").otherwise("context")
    # where the first listed mark that the text holds stands in it
    at = F.coalesce(*(F.when(holds(mark), F.instr("text", mark)) for mark in begin)) - 1
    head = F.substring(F.col("text"), F.lit(1), at)
    cut = (F.col("_n") == 1) & F.col("_open").isNotNull() & (F.regexp_replace(head, r"(?U)\s+", "") != "")
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.when(F.col("_open").isNull(), bare).otherwise(marked).alias("region"), F.col("text").alias("_text")))
    both = F.array(F.struct(F.lit(0).alias("piece"), F.lit("prefix").alias("region"), head.alias("_text")), F.struct(F.lit(1).alias("piece"), F.lit("context").alias("region"), F.substring(F.col("text"), at + 1, F.length("text")).alias("_text")))
    out = rows.select(*parts.columns, F.inline(F.when(F.coalesce(cut, F.lit(False)), both).otherwise(whole)))
    return out.withColumn("text", F.col("_text")).drop("_text")


def reassembled(parts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """ctx, at, kind, text: split parts back in the order to send: the prefix, the context's parts outside of documents,
    its documents in order, each within its marks, the suffix. A document whose name has a summary (ctx, name, summary)
    holds that in place of its parts."""
    # documents are parsed in the context alone, by one running place for parts and pieces
    place = F.row_number().over(Window.partitionBy("ctx").orderBy("ord", "piece"))
    numbered = parts.withColumn("ord", place)
    parsed = parse_documents(numbered.filter("region = 'context'")).select("ctx", "ord", "doc_at", "depth")
    rows = numbered.join(parsed, ["ctx", "ord"], "left")
    in_doc = Window.partitionBy("ctx", "doc_at").orderBy("ord")
    closing = close_tag(F.col("text")).isNotNull() & (F.col("depth") == 0)
    edge = (F.col("ord") == F.col("doc_at")) | closing
    rows = rows.withColumns({"_name": F.when(F.col("doc_at").isNotNull(), F.first(open_tag(F.col("text"))).over(in_doc)), "_edge": F.coalesce(edge, F.lit(False)), "_summary": F.lit(None).cast("string")})
    if summaries is not None:
        named = summaries.groupBy("ctx", F.col("name").alias("_name")).agg(F.max("summary").alias("_given"))
        rows = rows.join(named, ["ctx", "_name"], "left").withColumn("_summary", F.when(F.col("doc_at").isNotNull(), F.col("_given")))
    # of a summarised document stay its marks and, in the place after the first, the summary
    second = (F.col("ord") == F.col("doc_at")) & F.col("_summary").isNotNull()
    kept = rows.filter(F.col("_edge") | F.col("_summary").isNull())
    own = F.struct(F.lit(0).alias("_k"), F.col("kind"), F.col("text"))
    added = F.struct(F.lit(1).alias("_k"), F.lit("text").alias("kind"), F.col("_summary").alias("text"))
    region = F.when(F.col("region") == "prefix", 0).when(F.col("region") == "suffix", 3).when(F.col("doc_at").isNull(), 1).otherwise(2)
    shown = kept.select("ctx", "ord", region.alias("_region"), F.inline(F.when(second, F.array(own, added)).otherwise(F.array(own))))
    at = F.row_number().over(Window.partitionBy("ctx").orderBy("_region", "ord", "_k"))
    return shown.select("ctx", at.alias("at"), "kind", "text")
