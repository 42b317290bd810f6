"""The registered queries of bids, scores, jobs, logs and texts over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import jobs, scoring
from tallyspark.sources import tables
from tallyspark.sources.tables import load
from tallyspark.streaming import logs
from .register import ORACLE_SQL, QUERIES, query


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value, 2) END AS value FROM events")
def boq_safe_float(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.round("value", 2).alias("value"))
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("value").cast("string"), F.lit("d"))).otherwise(F.lit("Included"))
    return rows.select("event_id", text.safe_float(shown).alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'skip' ELSE 'content' END AS kind FROM part")
def boq_sheet_classify(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Bill Summary", "Cover page", "Bill 2", "Doors"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", text.sheet_kind(name).alias("kind"))


SCORES = """WITH scores AS (SELECT source AS contractor, lang AS scope, doc_id % 7 AS criterion, ((doc_id % 7 + 1) * 2.5)::DOUBLE AS weight, first((quality * 10 * (doc_id % 11))::DOUBLE ORDER BY doc_id) AS score FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
scopes AS (SELECT contractor, scope, sum((coalesce(score, 0) * weight / 100)::DECIMAL(18,4))::DOUBLE AS total FROM scores GROUP BY ALL)
"""


@query("SELECT * FROM scopes", SCORES)
def score_scope_totals(spark, sf_dir):
    return scoring.scope_totals(tables.score_rows(spark, sf_dir))


@query(", sums AS (SELECT contractor, sum(total::DECIMAL(18,4))::DOUBLE AS total FROM scopes GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY total DESC, contractor) AS rank FROM sums", SCORES)
def score_rank(spark, sf_dir):
    return scoring.contractor_ranks(tables.score_rows(spark, sf_dir))


@query("SELECT contractor, scope, sum((score * weight)::DECIMAL(18,4))::DOUBLE / nullif(sum(weight::DECIMAL(18,4))::DOUBLE, 0) AS mean FROM scores WHERE score IS NOT NULL GROUP BY ALL", SCORES)
def score_weighted_mean(spark, sf_dir):
    return scoring.weighted_means(tables.score_rows(spark, sf_dir))


@query("SELECT contractor, count(*) FILTER (score = 0) / count(*) AS zero_share, count(*) FILTER (score = 0) / count(*) > 0.5 AS flagged FROM scores GROUP BY ALL", SCORES)
def score_zero_flag(spark, sf_dir):
    return scoring.zero_flags(tables.score_rows(spark, sf_dir))


GRID = ", grid AS (SELECT * FROM (SELECT DISTINCT contractor FROM scores) CROSS JOIN (SELECT DISTINCT scope, criterion FROM scores)) "


@query(GRID + "SELECT contractor, floor(count(*) FILTER (score >= 50) / count(*) * 100 + 0.5)::BIGINT AS approved_pct FROM grid LEFT JOIN scores USING (contractor, scope, criterion) GROUP BY ALL", SCORES)
def score_approval_pct(spark, sf_dir):
    return scoring.approvals(tables.score_rows(spark, sf_dir), 50.0)


@query(GRID + "SELECT * FROM grid ANTI JOIN scores USING (contractor, scope, criterion)", SCORES)
def score_missing_mappings(spark, sf_dir):
    return scoring.missing_scores(tables.score_rows(spark, sf_dir))


JOBS = """WITH jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS type, o_custkey AS user_id, o_orderdate AS created_at FROM orders),
runs AS (SELECT l_orderkey AS job_id, l_linenumber AS attempt_no, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'in_progress' END AS status, l_shipdate AS created_at, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS artifact FROM lineitem),
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_no DESC, created_at DESC, part, supp) = 1),
listed AS (SELECT j.job_id, j.type, j.created_at, coalesce(r.status, 'pending') AS status, coalesce(r.attempt_no, 0) AS attempts FROM jobs j LEFT JOIN latest r USING (job_id))
"""


@query("SELECT job_id, attempt_no, status FROM latest", JOBS)
def job_latest_run(spark, sf_dir):
    return jobs.latest_runs(tables.job_tables(spark, sf_dir)[1]).select("job_id", "attempt_no", "status")


@query("SELECT job_id, type, status, attempts FROM listed", JOBS)
def job_list(spark, sf_dir):
    return jobs.job_list(*tables.job_tables(spark, sf_dir)).drop("created_at")


@query("SELECT job_id, type, status, attempts FROM listed WHERE status IN ('pending', 'failed') ORDER BY created_at, job_id LIMIT 50", JOBS)
def job_pending_fifo(spark, sf_dir):
    return jobs.pending(*tables.job_tables(spark, sf_dir), 50).drop("created_at")


@query("SELECT job_id, status IN ('pending', 'failed') AS claimable, CASE WHEN status IN ('pending', 'failed') THEN attempts + 1 END AS next_attempt FROM listed", JOBS)
def job_claimable(spark, sf_dir):
    return jobs.claims(*tables.job_tables(spark, sf_dir))


@query("SELECT job_id, attempt_no, artifact FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_no DESC, created_at DESC, part, supp) = 1", JOBS)
def job_latest_artifact_app(spark, sf_dir):
    return jobs.latest_completed(tables.job_tables(spark, sf_dir)[1])


@query("SELECT job_id, attempt_no, artifact FROM latest WHERE status = 'completed'", JOBS)
def job_latest_artifact_engine(spark, sf_dir):
    return jobs.completed_latest(tables.job_tables(spark, sf_dir)[1])


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def job_by_json_field(spark, sf_dir):
    return jobs.by_json_field(load(spark, sf_dir, "events"), "$.k", "69").select("event_id", "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def doc_upsert(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return jobs.upsert(rows, rows.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


@query("SELECT c_nationkey AS project, count(*) AS packages, count(*) FILTER (c_acctbal > 0) AS awarded FROM customer GROUP BY ALL")
def proj_counts(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("project")).agg(F.count("*").alias("packages"), F.count_if(F.col("c_acctbal") > 0).alias("awarded"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def semi_has_eval(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unseen(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT n_name, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY ALL")
def member_left_join(spark, sf_dir):
    own = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "supplier"), (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_acctbal") > 0), "left")
    return own.groupBy("n_name").agg(F.count("s_suppkey").alias("members"))


@query("SELECT c_nationkey AS org FROM customer UNION SELECT s_nationkey FROM supplier")
def org_union_distinct(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


MEMBERS = """WITH members AS (SELECT l_suppkey % 50 AS project, l_partkey % 40 AS "user", CASE l_linenumber % 4 WHEN 0 THEN 'technical_team' WHEN 1 THEN 'commercial_team' WHEN 2 THEN 'package_lead' ELSE NULL END AS role, l_quantity > 49 AS owner FROM lineitem),
best AS (SELECT project, "user", first(role ORDER BY CASE role WHEN 'package_lead' THEN 2 WHEN 'commercial_team' THEN 3 WHEN 'technical_team' THEN 4 END) FILTER (role IS NOT NULL) AS role, bool_or(owner) AS owner FROM members GROUP BY ALL)
"""


@query("""SELECT *, CASE WHEN owner THEN 'full' WHEN role = 'package_lead' THEN 'package' WHEN role = 'commercial_team' THEN 'commercial' WHEN role = 'technical_team' THEN 'technical' ELSE 'none' END AS access FROM best""", MEMBERS)
def proj_access(spark, sf_dir):
    role = F.when(F.col("l_linenumber") % 4 == 0, "technical_team").when(F.col("l_linenumber") % 4 == 1, "commercial_team").when(F.col("l_linenumber") % 4 == 2, "package_lead")
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("project"), (F.col("l_partkey") % 40).alias("user"), role.alias("role"), (F.col("l_quantity") > 49).alias("owner"))
    return jobs.access(rows)


LOGS = "WITH logs AS (SELECT ts, event_type AS service, event_type || ' ' || props AS line FROM events) "


def at_text(counts: DataFrame) -> DataFrame:
    return counts.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute, '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM logs GROUP BY ALL", LOGS)
def log_count_1m(spark, sf_dir):
    return at_text(logs.count_over_time(tables.log_rows(spark, sf_dir), "1 minute"))


@query("SELECT strftime(time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute * (1 + i), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM logs, range(5) t(i) WHERE regexp_matches(line, '(?i)click|7') GROUP BY ALL", LOGS)
def log_count_5m_sliding_filtered(spark, sf_dir):
    return at_text(logs.count_over_time(logs.select_lines(tables.log_rows(spark, sf_dir), pattern="(?i)click|7"), "5 minutes", "1 minute"))


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS at, service, count(*) AS n FROM logs GROUP BY ALL", LOGS)
def log_count_by_service(spark, sf_dir):
    return at_text(logs.count_over_time(tables.log_rows(spark, sf_dir), "1 hour", by=("service",)))


@query("SELECT service, count(*) AS n FROM logs GROUP BY ALL", LOGS)
def log_count_range(spark, sf_dir):
    return logs.count_range(tables.log_rows(spark, sf_dir), ("service",))


@query("SELECT service, line, count(*) AS n FROM logs WHERE regexp_matches(line, '\"k\": 6') GROUP BY ALL", LOGS)
def log_search(spark, sf_dir):
    return logs.count_range(logs.select_lines(tables.log_rows(spark, sf_dir), pattern='"k": 6'), ("service", "line"))


@query("SELECT service, count(*) AS n FROM logs WHERE regexp_full_match(service, 'c.*|v.*') GROUP BY ALL", LOGS)
def log_label_regex(spark, sf_dir):
    return logs.count_range(logs.select_lines(tables.log_rows(spark, sf_dir), service="c.*|v.*"), ("service",))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')))) AS digest FROM documents")
def txt_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.normalize_text(F.col("text")).cast("binary"), 256).alias("digest"))


@query("SELECT source, sum(greatest(length(text) // 4, 1))::BIGINT AS tokens FROM documents GROUP BY ALL")
def txt_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.sum(text.token_estimate(F.length("text"))).alias("tokens"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, length(text) AS chars FROM documents),
s AS (SELECT doc_id, lines, unnest(CASE WHEN len(lines) <= 150 AND chars <= 8000 THEN [0] ELSE list_filter(range(0, len(lines), 130), lambda x: x = 0 OR x + 20 < len(lines)) END) AS start FROM l)
SELECT doc_id, start, least(150, len(lines) - start) AS n, sha256(array_to_string(lines[start + 1 : start + 150], chr(10))) AS digest FROM s""")
def txt_line_chunks(spark, sf_dir):
    return text.line_chunks(docs(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), F.size("lines").cast("long").alias("n"), F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("digest"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT doc_id, sha256(array_to_string(list_filter(lines, lambda x, i: trim(x) = '' OR i = 1 OR x <> lines[i - 1]), chr(10))) AS digest FROM l")
def txt_dup_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.drop_repeated_lines(F.col("text")).cast("binary"), 256).alias("digest"))


@query("WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN '[FALLBACK-EXTRACT] (empty content)' WHEN length(t) > 400 THEN '[FALLBACK-EXTRACT]' || chr(10) || substring(t, 1, 200) || chr(10) || '...' || chr(10) || right(t, 200) ELSE '[FALLBACK-EXTRACT]' || chr(10) || t END AS text FROM d")
def txt_head_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.head_tail(F.col("text"), 400).alias("text"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def txt_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS role FROM conversations) SELECT conv_id, turn, last_value(nullif(role, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS role FROM c")
def txt_ffill(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise("").alias("role"))
    return text.forward_fill(rows, "conv_id", "turn", "role")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def txt_incremental_diff(spark, sf_dir):
    now = docs(spark, sf_dir).select(F.col("doc_id").alias("source_key"), F.sha2(F.col("text").cast("binary"), 256).alias("etag"), F.col("n_chars").alias("size"), F.lit(1).alias("modified"))
    before = now.filter("source_key % 5 <> 0").withColumn("size", F.when(F.col("source_key") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return text.incremental_diff(now, before).select(F.col("source_key").alias("doc_id"))


@query("SELECT source, sum(quality * n_chars)::DOUBLE / nullif(sum(n_chars), 0) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def txt_weighted_mean(spark, sf_dir):
    rows = docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg((F.sum(F.col("quality") * F.col("n_chars")).cast("double") / F.nullif(F.sum("n_chars"), F.lit(0))).alias("mean"))


@query()
def txt_html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))
