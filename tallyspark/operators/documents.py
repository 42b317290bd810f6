"""Parts of documents for a model's context: parsing, chunking, packing and budgets.

Parts are rows (ctx, ord, kind, text, bytes) of a context; whole documents are rows (ctx, ord, doc, tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A text part that opens or closes a document.
OPEN, CLOSE = r"^\s*<Start of File:\s*(.+?)>\s*$", r"^\s*</End of File:\s*(.+?)>\s*$"


def open_tag(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), OPEN, 1), F.lit(""))


def close_tag(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), CLOSE, 1), F.lit(""))


def parse_documents(parts: DataFrame) -> DataFrame:
    """Add depth, and doc_at, the place of the outermost document that a part belongs to (null outside): nested
    documents stay within the outer one, and one that isn't closed reaches to the end of its context."""
    order = Window.partitionBy("ctx").orderBy("ord")
    step = F.when(open_tag(F.col("text")).isNotNull(), 1).when(close_tag(F.col("text")).isNotNull(), -1).otherwise(0)
    level = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # closing marks without a document to close don't count: the level is taken from its lowest point so far
    least = F.least(F.min("_level").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    marked = parts.withColumn("_step", step).withColumn("_level", level).withColumn("depth", F.col("_level") - least)
    opens = (F.col("_step") == 1) & (F.col("depth") == 1)
    marked = marked.withColumn("_start", F.last(F.when(opens, F.col("ord")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    closes = (F.col("_step") == -1) & (F.lag("depth").over(order) > 0)
    inside = (F.col("depth") > 0) | F.coalesce(closes, F.lit(False))
    return marked.withColumn("doc_at", F.when(inside, F.col("_start"))).drop("_step", "_level", "_start")


def document_count(parts: DataFrame) -> DataFrame:
    return parts.groupBy("ctx").agg(F.greatest(F.count_if(open_tag(F.col("text")).isNotNull()), F.lit(1)).alias("documents"))


def part_counts(parts: DataFrame) -> DataFrame:
    """Parts of each kind in a context, bytes of inline ones, what all take as text and in base64."""
    inline = F.col("kind") == "inline"
    size = F.coalesce(F.when(inline, F.floor((F.col("bytes") + 2) / 3) * 4).otherwise(F.octet_length("text")), F.lit(0))
    return parts.groupBy("ctx").agg(
        F.count("*").alias("total"), F.count_if(F.col("kind") == "text").alias("text"), F.count_if(F.col("kind") == "uri").alias("uri"), F.count_if(inline).alias("inline"), F.coalesce(F.sum(F.when(inline, F.col("bytes"))), F.lit(0)).alias("inline_bytes"), F.sum(size).cast("long").alias("payload")
    )


def offenders(parts: DataFrame, most: int) -> DataFrame:
    """Inline parts above a request's limit."""
    return parts.filter((F.col("kind") == "inline") & (F.col("bytes") > most)).select("ctx", "ord", "bytes")


def drop_sections(parts: DataFrame, begin: str, end: str) -> DataFrame:
    """Text parts with words outside of marked sections; the marks go too."""
    order = Window.partitionBy("ctx").orderBy("ord")
    text = F.trim(F.coalesce("text", F.lit("")))
    mark = F.when(text.startswith(begin), 1).when(text.startswith(end), 0)
    inside = F.coalesce(F.last(mark, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    # an end mark outside of a section is text like any other
    before = F.coalesce(F.last(mark, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("_in", inside).withColumn("_before", before).withColumn("_mark", mark)
    return kept.filter((F.col("_in") == 0) & ~((F.col("_before") == 1) & (F.coalesce("_mark", F.lit(-1)) == 0)) & (text != "") & (F.col("kind") == "text")).drop("_in", "_before", "_mark")


def segments(lines: DataFrame, header: Column) -> DataFrame:
    """Runs of lines (doc, line_no, line) from one header to the next."""
    heads = lines.filter(header).withColumn("next", F.lead("line_no").over(Window.partitionBy("doc").orderBy("line_no")))
    last = lines.groupBy("doc").agg((F.max("line_no") + 1).alias("end"))
    return heads.join(last, "doc").select("doc", F.col("line").alias("header"), F.col("line_no").alias("start"), F.coalesce("next", "end").alias("stop"))


def line_states(lines: DataFrame, division: Column, grouping: Column, sub_group: Column) -> DataFrame:
    """Lines (doc, line_no) with the names in force at each: a new division ends the grouping, a new grouping the
    sub-group. The columns give a line's own name where it is a header, else null."""
    named = lines.withColumns({"_d": division, "_g": grouping, "_s": sub_group})
    # one window for all three: a name counts where no header above it has come since
    up_to = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name, *since: F.last(F.when(F.col(name).isNotNull(), F.struct(name, *since)), True).over(up_to)
    named = named.withColumns({"division": F.last("_d", True).over(up_to), "_dn": F.count("_d").over(up_to), "_gn": F.count("_g").over(up_to)})
    named = named.withColumns({"_lg": last("_g", "_dn"), "_ls": last("_s", "_dn", "_gn")})
    in_division, in_grouping = F.col("_lg._dn") == F.col("_dn"), (F.col("_ls._dn") == F.col("_dn")) & (F.col("_ls._gn") == F.col("_gn"))
    named = named.withColumns({"grouping": F.when(in_division, F.col("_lg._g")), "sub_group": F.when(in_grouping, F.col("_ls._s"))})
    return named.withColumn("header", F.coalesce("_d", "_g", "_s").isNotNull()).drop("_d", "_g", "_s", "_dn", "_gn", "_lg", "_ls")


def item_ids(items: DataFrame) -> DataFrame:
    """Ids for items that have none: ITM-0001 and so on, in each document's order."""
    lacking = F.col("item_id").isNull() | (F.trim(F.col("item_id").cast("string")) == "")
    number = F.sum(lacking.cast("int")).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("item_id", F.when(lacking, F.format_string("ITM-%04d", number)).otherwise(F.col("item_id")))


def carried_totals(lines: DataFrame) -> DataFrame:
    """The figure of each document's last line that is carried to a summary: the last number between bars, or after a
    colon."""
    lowered = F.lower("line")
    marked = lines.filter(F.contains(lowered, F.lit("carried to bill summary")) | F.contains(lowered, F.lit("carried to general summary")))

    def last(mark: str) -> Column:
        cells = F.transform(F.split("line", mark), lambda c: F.replace(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit(" "), F.lit("")))
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(cells, lambda c: c.rlike(r"^-?\d+\.?\d*$"))), -1)

    figures = marked.withColumn("total", F.coalesce(last(r"\|"), last(":"))).filter("total IS NOT NULL")
    return figures.groupBy("doc").agg(F.max_by("total", "line_no").alias("total"))


def plan_large(docs: DataFrame, target: int, least: int, saved: float = 0.8) -> DataFrame:
    """Documents to summarise: the largest first, each saving a share of its tokens, until a context's excess over the
    target is met; smaller ones than `least` aren't worth it."""
    total = F.sum("tokens").over(Window.partitionBy("ctx"))
    saving = F.floor(F.col("tokens") * saved).cast("long")
    rows = docs.withColumn("excess", total - target).withColumn("saving", saving).filter(F.col("tokens") >= least)
    before = F.coalesce(F.sum("saving").over(Window.partitionBy("ctx").orderBy(F.desc("tokens"), "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter((F.col("excess") > 0) & (F.col("before") < F.col("excess"))).select("ctx", "doc", "tokens", "saving")


def hard_cap(docs: DataFrame, limit: int, placeholder: int) -> DataFrame:
    """Documents that give way to a placeholder: the largest savings first, until a context fits."""
    total = F.sum("tokens").over(Window.partitionBy("ctx"))
    rows = docs.withColumn("total", total).withColumn("saving", F.greatest(F.col("tokens") - placeholder, F.lit(0)))
    before = F.coalesce(F.sum("saving").over(Window.partitionBy("ctx").orderBy(F.desc("saving"), F.desc("tokens"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("left", F.col("total") - before).filter((F.col("left") > limit) & (F.col("saving") > 0)).select("ctx", "doc", "saving")


def fill_budget(docs: DataFrame, budget: int) -> DataFrame:
    """The documents of a context, in order, that fit a budget of tokens together; the first that doesn't ends it."""
    used = F.sum("tokens").over(Window.partitionBy("ctx").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("used", used).filter(F.col("used") <= budget)


def until_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Pages (doc, page, bytes) up to the one that exceeds a budget of bytes, that one included."""
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("before", before).filter(F.col("before") <= budget).drop("before")


def layered(images: DataFrame, share: float = 0.8) -> DataFrame:
    """Pages with at least two images (doc, page, area) nearly as large as the largest. A page's areas are gathered, so its
    images aren't sorted."""
    near = F.filter("_areas", lambda a: (a > 0) & (a >= F.array_max("_areas") * share))
    return images.groupBy("doc", "page").agg(F.collect_list("area").alias("_areas")).filter(F.size(near) >= 2).select("doc", "page")


def scanned(pages: DataFrame, chars: int = 200) -> DataFrame:
    """Pages (doc, page, text, images) that are pictures: little text, and an image."""
    return pages.filter((F.length(F.trim(F.coalesce("text", F.lit("")))) < chars) & (F.col("images") >= 1)).select("doc", "page")


def first_digests(images: DataFrame) -> DataFrame:
    """The first image of each digest in a document."""
    return images.groupBy("doc", "digest").agg(F.min("at").alias("at"))


def within_window(events: DataFrame, seconds: int) -> DataFrame:
    """What each user's events of the last seconds add up to at each event."""
    window = Window.partitionBy("user").orderBy(F.col("second")).rangeBetween(-seconds, 0)
    return events.withColumn("used", F.sum("size").over(window))


def dynamic_budget(rows: DataFrame, safe: int) -> DataFrame:
    """Budgets of contexts by their numbers of documents."""
    share = F.greatest(F.lit(0.15), F.lit(0.4) / F.greatest(F.lit(1.0), F.col("documents") / 10))
    return rows.withColumns({"target": F.lit(safe - 30_000), "per_document": F.greatest(F.lit(50_000), F.floor(F.lit(safe - 30_000) * share).cast("long"))})


def tightened(rows: DataFrame) -> DataFrame:
    """Settings (chunk, summary, ceiling, step, overshoot) after another pass: scaled down, to a least size each."""
    factor = F.greatest(F.lit(0.05), F.lit(1.0) / F.greatest(F.lit(1.0), F.col("overshoot")) * F.pow(F.lit(0.7), F.col("step") - 1))
    smaller = lambda c, least: F.greatest(F.lit(least), F.floor(F.col(c) * factor).cast("long"))
    return rows.withColumns({"chunk": smaller("chunk", 30_000), "summary": smaller("summary", 3_000), "ceiling": F.when(F.col("ceiling") > 0, smaller("ceiling", 10_000)).otherwise(F.col("ceiling"))})


def packed(docs: DataFrame, most: int) -> DataFrame:
    """Documents of a context in order, filled into batches of at most `most` tokens; one that doesn't fit begins the
    next, and a longer one is alone. The sums start again with each batch, so a context's sizes are folded in order, as
    numbers only: a context is what one model reads."""
    sizes = docs.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("ord", "doc", "tokens"))).alias("docs"))

    def step(state: Column, d: Column) -> Column:
        opens = (state["used"] > 0) & (state["used"] + d["tokens"] > most)
        batch = state["batch"] + opens.cast("int")
        return F.struct(F.array_append(state["out"], F.struct(d["doc"].alias("doc"), batch.alias("batch"))).alias("out"), batch.alias("batch"), F.when(opens, d["tokens"]).otherwise(state["used"] + d["tokens"]).alias("used"))

    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema)
    start = F.struct(F.array().cast(f"array<struct<doc:{kind['doc']},batch:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast(kind["tokens"]).alias("used"))
    return sizes.select("ctx", F.explode(F.aggregate("docs", start, step)["out"]).alias("d")).select("ctx", "d.doc", "d.batch")


def paragraph_chunks(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, chunk, start, stop: a text in runs of whole paragraphs of at most `most` characters; a longer paragraph is
    cut. A first paragraph that is longer than that leaves an empty chunk before it."""
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda p: F.length(p)).alias("sizes"))
    run = "struct<start:int,stop:int>"

    def step(state: Column, size: Column) -> Column:
        added = size + F.when(state["open"], 2).otherwise(0)
        fits = state["used"] + added <= most
        ended = F.array_append(state["runs"], F.struct(state["start"].alias("start"), (state["start"] + state["used"]).alias("stop")))
        return F.struct(
            F.when(fits, state["runs"]).otherwise(ended).alias("runs"), F.when(fits, state["start"]).otherwise(state["start"] + state["used"] + 2).alias("start"), F.when(fits, state["used"] + added).otherwise(size).alias("used"), F.lit(True).alias("open")
        )

    first = F.struct(F.array().cast(f"array<{run}>").alias("runs"), F.lit(0).alias("start"), F.lit(0).alias("used"), F.lit(False).alias("open"))
    close = lambda s: F.array_append(s["runs"], F.struct(s["start"].alias("start"), (s["start"] + s["used"]).alias("stop")))
    runs = F.when(F.col("chars") <= most, F.array(F.struct(F.lit(0).alias("start"), F.col("chars").alias("stop")))).otherwise(F.aggregate("sizes", first, step, close))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r["stop"] - r["start"] <= most, F.array(r)).otherwise(F.transform(F.sequence(r["start"], r["stop"] - 1, F.lit(most)), lambda s: F.struct(s.alias("start"), F.least(s + most, r["stop"]).alias("stop"))))))
    return rows.select("doc_id", F.posexplode(cut).alias("chunk", "r")).select("doc_id", "chunk", "r.start", "r.stop")


def summaries(docs: DataFrame, fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Each document's text: its new summary, else the one kept under its key, else its own."""
    joined = docs.join(fresh.select("doc", F.col("summary").alias("_new")), "doc", "left").join(cached.select("key", F.col("summary").alias("_old")), "key", "left")
    return joined.withColumn("text", F.coalesce("_new", "_old", "text")).drop("_new", "_old")


def by_alias(docs: DataFrame, pointers: DataFrame, contents: DataFrame) -> DataFrame:
    """The summary that a source's pointer leads to; null where either is missing."""
    return docs.join(pointers, "source_key", "left").join(contents, "content_key", "left")


def append_parts(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Parts whose key a document has already aren't added again."""
    return manifest.unionByName(new.dropDuplicates(["doc", "part"]).join(manifest.select("doc", "part"), ["doc", "part"], "left_anti"))


def joined_texts(parts: DataFrame, mark: str = "\n\n") -> DataFrame:
    """Each document's texts in order; documents are what one reader takes."""
    return parts.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), mark).alias("text"))


def content_hash(parts: DataFrame) -> DataFrame:
    """One hash of a context's parts in order: texts by themselves, others by their kind and their bytes' hash."""
    tagged = F.when(F.col("kind") == "text", F.concat(F.lit("T|"), "text")).when(F.col("kind") == "uri", F.concat(F.lit("U|"), "text")).when(F.col("kind") == "inline", F.concat(F.lit("I|"), F.sha1("text"))).otherwise(F.lit("M|"))
    return parts.groupBy("ctx").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", tagged.alias("t")))), lambda p: p["t"]), "").cast("binary"), 256).alias("hash"))


def source_fingerprint(sources: DataFrame) -> DataFrame:
    """One hash of a context's sources and their versions, whatever their order."""
    pairs = F.array_sort(F.collect_list(F.concat(F.col("source_key"), F.lit("="), F.col("version"), F.lit(";"))))
    return sources.groupBy("ctx").agg(F.sha2(F.array_join(pairs, "").cast("binary"), 256).alias("fingerprint"))


def pick_template(files: DataFrame) -> DataFrame:
    """Each folder's template: a name with template, else one with boq, else the first by name."""
    lowered = F.lower("name")
    rank = F.when(F.contains(lowered, F.lit("template")), 0).when(F.contains(lowered, F.lit("boq")), 1).otherwise(2)
    return files.groupBy("folder").agg(F.min_by("name", F.struct(rank, "name")).alias("template"), F.min_by(F.when(F.contains(lowered, F.lit("pte")), F.col("name")), F.when(F.contains(lowered, F.lit("pte")), F.col("ord"))).alias("benchmark"), F.min("name").alias("first"))


def best_tables(rows: DataFrame, sheets: int = 30, lines: int = 1000) -> DataFrame:
    """Rows (doc, sheet, line) of the first sheets and lines: a limit of what is shown of a workbook."""
    kept = rows.withColumn("_s", F.dense_rank().over(Window.partitionBy("doc").orderBy("sheet"))).filter(F.col("_s") <= sheets)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "sheet").orderBy("line"))).filter(F.col("_n") <= lines).drop("_s", "_n")
