"""Job queue, access and project queries on jobs (job_id, type, user_id, created_at) and runs (job_id, attempt_no,
status, created_at, part, supp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark limits each key before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_runs(runs: DataFrame) -> DataFrame:
    return newest(runs, "job_id", F.desc("attempt_no"), F.desc("created_at"), F.col("part"), F.col("supp"))


def job_list(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    latest = latest_runs(runs).select("job_id", "attempt_no", "status")
    return jobs.join(latest, "job_id", "left").select("job_id", "type", "created_at", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempt_no", F.lit(0)).alias("attempts"))


def pending(jobs: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """The oldest jobs without a run, or whose latest run failed."""
    waiting = job_list(jobs, runs).filter("status IN ('pending', 'failed')")
    return waiting.orderBy("created_at", "job_id").limit(most)


def claims(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether a job may be claimed, and as which attempt."""
    state = job_list(jobs, runs)
    free = F.col("status").isin("pending", "failed")
    return state.select("job_id", free.alias("claimable"), F.when(free, F.col("attempts") + 1).alias("next_attempt"))


def latest_completed(runs: DataFrame) -> DataFrame:
    """The newest completed attempt of each job, whatever came after."""
    return latest_runs(runs.filter("status = 'completed'")).select("job_id", "attempt_no", "artifact")


def completed_latest(runs: DataFrame) -> DataFrame:
    """Jobs whose latest run is completed."""
    return latest_runs(runs).filter("status = 'completed'").select("job_id", "attempt_no", "artifact")


def by_json_field(events: DataFrame, path: str, value: str) -> DataFrame:
    return events.filter(F.get_json_object("props", path) == value)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def access(members: DataFrame) -> DataFrame:
    """One role per user: owners, creators and leads have full access, others that of their closest role."""
    # Roles, the strongest first.
    priority = F.array_position(F.array(*(F.lit(r) for r in ("project_lead", "package_lead", "commercial_team", "technical_team"))), F.col("role"))
    best = members.groupBy("project", "user").agg(F.min_by("role", priority).alias("role"), F.bool_or("owner").alias("owner"))
    level = F.when(F.col("owner") | (F.col("role") == "project_lead"), "full").when(F.col("role") == "package_lead", "package").when(F.col("role") == "commercial_team", "commercial").when(F.col("role") == "technical_team", "technical").otherwise("none")
    return best.withColumn("access", level)


def select_jobs(jobs: DataFrame, most: int | None = None, **wanted) -> DataFrame:
    """Jobs by whatever is asked for (None: anything), newest first."""
    for column, value in wanted.items():
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    newest_first = jobs.orderBy(F.desc("created_at"), F.desc("job_id"))
    return newest_first.limit(most) if most is not None else newest_first


def runs_of(runs: DataFrame, job_id: int) -> DataFrame:
    return runs.filter(F.col("job_id") == job_id).orderBy(F.desc("attempt_no"), F.desc("created_at"))


def next_numbers(rows: DataFrame, parents: DataFrame, key: str, number: str) -> DataFrame:
    """The number that follows each parent's latest, from 1."""
    return parents.select(key).join(rows.groupBy(key).agg(F.max(number).alias("latest")), key, "left").select(key, (F.coalesce("latest", F.lit(0)) + 1).alias("next_number"))


def transition(runs: DataFrame, status: str) -> DataFrame:
    """Runs moved to a status, with the time that it marks: the start of work, or its end."""
    started = F.when(F.lit(status) == "in_progress", F.coalesce("started_at", F.col("now"))).otherwise(F.col("started_at"))
    ended = F.when(F.lit(status).isin("completed", "failed"), F.col("now")).otherwise(F.col("completed_at"))
    return runs.withColumns({"started_at": started, "completed_at": ended, "status": F.lit(status)})


def responses(listed: DataFrame) -> DataFrame:
    """What a caller is told of each job: its state, whether to ask again, and a progress in percent."""
    state = F.when(F.col("status") == "completed", "completed").when(F.col("status") == "failed", "error").when(F.col("status") == "in_progress", "in progress").otherwise("pending")
    return listed.select("job_id", state.alias("state"), state.isin("pending", "in progress").alias("poll"), F.when(F.col("status") == "completed", 100).when(F.col("status") == "in_progress", 50).otherwise(0).alias("progress"))


def result_for_asset(jobs: DataFrame, runs: DataFrame, asset: int, package: int, most: int = 200) -> DataFrame:
    """The newest completed artifact among the newest jobs of an asset; older jobs without an asset count by their
    package. Jobs have asset and package."""
    own = jobs.filter((F.col("asset") == asset) | (F.col("asset").isNull() & (F.col("package") == package)))
    held = own.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)
    return held.join(latest_completed(runs), "job_id").orderBy(F.desc("created_at"), F.desc("job_id")).limit(1)


def first_of(rows: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """A value by key from the first table, else from the second."""
    return rows.select(key, F.col(value).alias("_a")).join(other.select(key, F.col(value).alias("_b")), key, "full").select(key, F.coalesce("_a", "_b").alias(value))


def set_where_null(rows: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """UPDATE: a value for rows that meet a condition and have none."""
    return rows.withColumn(column, F.when(F.col(column).isNull() & where, value).otherwise(F.col(column)))


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key isn't there yet, the first of each, are added."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def delete_cascade(gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Each child table without the rows of deleted parents."""
    return [child.join(gone.select(key), key, "left_anti") for child in children]


def package_access(rows: DataFrame) -> DataFrame:
    """One level for each user and package: owners, creators and package leads have full access, then a package's role
    counts before a project's."""
    package, project = F.col("package_role"), F.col("project_role")
    full = (F.col("org_role") == "owner") | F.col("creator") | (package == "package_lead")
    level = F.when(F.coalesce(full, F.lit(False)), "full").when(package == "commercial_team", "commercial").when(package == "technical_team", "technical").when(project == "project_lead", "full").when(project == "commercial_lead", "commercial").when(project == "technical_lead", "technical").otherwise("none")
    return rows.withColumn("access", level)


def visible_projects(projects: DataFrame, memberships: DataFrame, user: int, owner: bool = False) -> DataFrame:
    """Projects that a user made or is a member of, once each; an organisation's owner sees all."""
    own = memberships.filter(F.col("user") == user).select("project")
    return projects.filter(F.lit(owner) | (F.col("creator") == user)).unionByName(projects.join(own, "project", "left_semi")).dropDuplicates(["project"])


def masked(rows: DataFrame, access: str, *columns: str) -> DataFrame:
    """Columns that need commercial access, null without it."""
    return rows.withColumns({c: F.when(F.col(access).isin("full", "commercial"), F.col(c)) for c in columns})


def may_leave(members: DataFrame) -> DataFrame:
    """Whether a member may be removed: the last owner of an organisation may not."""
    owners = members.groupBy("org").agg(F.count_if(F.col("role") == "owner").alias("owners"))
    return members.join(owners, "org").withColumn("may_leave", (F.col("role") != "owner") | (F.col("owners") > 1))


def invitations(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with their user's name; those without a user are pending invitations."""
    return members.join(users, "user", "left").withColumn("pending", F.col("name").isNull())


def latest_nested(parents: DataFrame, children: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Parents with their children (parent, child) as a list, each with its latest evaluation (child, round, state)."""
    latest = evaluations.groupBy("child").agg(F.max_by(F.struct("round", "state"), "round").alias("latest"))
    nested = children.join(latest, "child", "left").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("child", "latest"))).alias("children"))
    return parents.join(nested, "parent", "left")


def award_eligibility(packages: DataFrame) -> DataFrame:
    """Whether a package may be awarded, and why not: access, then the review, then eligible contractors."""
    reason = F.when(F.col("access") != "full", "no access").when(~F.col("reviewed"), "review incomplete").when(F.col("eligible") <= 0, "no eligible contractor")
    return packages.withColumn("reason", reason).withColumn("may_award", F.col("reason").isNull())
