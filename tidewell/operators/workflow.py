"""Workflow tables: approvals, notifications, job registry, corrections, templates, recovery (M, T, W, X)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.merge import upsert
from .latest import first_per_key


def new_requests(asked: DataFrame, pending: DataFrame, key: str, order: str) -> DataFrame:
    """Requests that may be made: one pending a key, so the first asked of each key that has none."""
    return first_per_key(asked.join(pending.select(key), key, "left_anti"), [key], [F.asc(order)])


def decide(requests: DataFrame, decisions: DataFrame, key: str, pending: str = "pending") -> DataFrame:
    """Only pending requests are decided, by the first decision; a grant opens a download window of a day."""
    first = decisions.groupBy(key).agg(F.min(F.struct("decided_at", "verdict")).alias("d"))
    joined = requests.join(first, key, "left")
    taken = (F.col("status") == pending) & F.col("d").isNotNull()
    until = F.when(taken & (F.col("d.verdict") == "granted"), F.col("d.decided_at") + F.make_interval(days=F.lit(1)))
    return joined.select(key, F.when(taken, F.col("d.verdict")).otherwise(F.col("status")).alias("status"), until.alias("open_until"))


def mark_read(notes: DataFrame, user: str, note: str, read: DataFrame | None = None) -> DataFrame:
    """Notifications with ``read`` set for the given ones (user, note), or for all of the users given."""
    if read is None:
        return notes.withColumn("read", F.lit(True))
    keys = [user, note] if note in read.columns else [user]
    marked = read.select(*keys).distinct().withColumn("__marked", F.lit(True))
    return notes.join(marked, keys, "left").withColumn("read", F.col("read") | F.coalesce("__marked", F.lit(False))).drop("__marked")


def registry_state(log: DataFrame, job: str, at: str, event: str) -> DataFrame:
    """Per job its state from the log of events: queued, running, done or failed, and whether it is claimed.

    The last event decides; a claim holds from ``claim`` or ``beat`` until the job ends or is queued again.
    """
    last = log.groupBy(job).agg(F.max_by(event, F.struct(at, event)).alias("last"), F.max(at).alias("at"), F.count_if(F.col(event) == "claim").alias("claims"))
    state = F.when(F.col("last").isin("claim", "beat"), "running").when(F.col("last") == "finish", "done").when(F.col("last") == "fail", "failed").otherwise("queued")
    return last.select(job, state.alias("state"), "claims", F.col("at").alias("last_at"))


def fenced(writes: DataFrame, claims: DataFrame, job: str, at: str, seconds: int) -> DataFrame:
    """Terminal writes and whether each holds: its writer made the job's last claim and the claim had not run out.

    ``writes``: job, writer, at; ``claims``: job, writer, at. A claim lasts ``seconds``.
    """
    # one history a job, claims before writes of the same moment: the last claim is carried along
    of = lambda rows, kind: rows.select(job, "writer", at, F.lit(kind).alias("__kind"))
    claim = F.when(F.col("__kind") == 0, F.struct(F.col(at).alias("at"), F.col("writer").alias("owner")))
    history = Window.partitionBy(job).orderBy(at, "__kind", "writer").rowsBetween(Window.unboundedPreceding, 0)
    last = of(claims, 0).unionByName(of(writes.distinct(), 1)).withColumn("c", F.last(claim, ignorenulls=True).over(history)).where("__kind = 1")
    age = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col("c.at").cast("timestamp"))
    return last.select(job, "writer", at, F.coalesce((F.col("c.owner") == F.col("writer")) & (age <= seconds), F.lit(False)).alias("holds"))


def not_cancelled(units: DataFrame, flags: DataFrame, job: str, at: str) -> DataFrame:
    """Units of work begun before their job's cancel flag was set; later ones are not done."""
    first = flags.groupBy(job).agg(F.min(at).alias("__flag"))
    return units.join(first, job, "left").where(F.col("__flag").isNull() | (F.col(at) < F.col("__flag"))).drop("__flag")


def upload_state(chunks: DataFrame, session: str, number: str, size: Column, expected: DataFrame) -> DataFrame:
    """Per upload session the distinct chunks there are, bytes, the first missing number and whether it is complete.

    ``expected``: session, chunks. The first gap is found by comparing numbers with ranks.
    """
    once = chunks.groupBy(session, number).agg(F.max(size).alias("__size"))
    ranked = once.withColumn("__rank", F.row_number().over(Window.partitionBy(session).orderBy(number)) - 1)
    state = ranked.groupBy(session).agg(F.count("*").alias("present"), F.sum("__size").alias("bytes"), F.min(F.when(F.col(number) != F.col("__rank"), F.col("__rank"))).alias("__gap"))
    whole = expected.join(state, session, "left")
    there = F.coalesce("present", F.lit(0))
    return whole.select(session, there.cast("long").alias("present"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.when(there < F.col("chunks"), F.coalesce("__gap", there)).cast("long").alias("missing"), (there >= F.col("chunks")).alias("complete"))


def corrected(records: DataFrame, corrections: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Records after corrections made on their current revision, and the history of all with their outcome.

    ``records``: key, field, revision; ``corrections``: key, value, expected (revision). One correction
    a record and round: the first by value. A stale revision changes nothing.
    """
    one = corrections.groupBy(key, "expected").agg(F.min("value").alias("value"))
    both = records.join(one, key, "left")
    fits = F.col("expected") == F.col("revision")
    done = both.where(F.coalesce(fits, F.lit(False))).select(key, F.col("value").alias("__value"))
    after = records.join(done, key, "left")
    changed = F.col("__value").isNotNull()
    after = after.withColumns({field: F.coalesce("__value", field), "revision": F.col("revision") + F.when(changed, 1).otherwise(0)}).drop("__value")
    history = both.where(F.col("expected").isNotNull()).select(key, "value", F.when(fits, "applied").otherwise("stale").alias("outcome"))
    return after, history


def propagate(records: DataFrame, corrections: DataFrame, key: str, rules: Mapping[str, tuple[str, float, float, float]]) -> DataFrame:
    """Numeric corrections into canonical columns: field -> (column, factor to its unit, low, high).

    Values outside the bounds and fields without a column change nothing.
    """
    parts = []
    for name, (column, factor, low, high) in rules.items():
        value = F.col("value").try_cast("double") * factor
        parts.append(F.max(F.when((F.col("field") == name) & value.between(low, high), value)).alias(f"__{column}"))
    found = corrections.groupBy(key).agg(*parts)
    out = records.join(found, key, "left")
    for column, *_ in rules.values():
        out = out.withColumn(column, F.coalesce(f"__{column}", F.col(column).cast("double"))).drop(f"__{column}")
    return out


def publish(templates: DataFrame, drafts: DataFrame, code: str) -> DataFrame:
    """Templates with each draft as the next version of its code; the newest of a code is active."""
    last = templates.groupBy(code).agg(F.max("version").alias("__last"))
    fresh = drafts.join(last, code, "left").select(code, (F.coalesce("__last", F.lit(0)) + 1).alias("version"), "body")
    every = templates.select(code, "version", "body").unionByName(fresh)
    newest = every.groupBy(code).agg(F.max("version").alias("__newest"))
    return every.join(newest, code).select(code, "version", "body", (F.col("version") == F.col("__newest")).alias("active"))


def recovery_sheet(lines: DataFrame, key: str, text: Column) -> DataFrame:
    """A sheet from text lines ``NAME = value unit``: name, number, unit and raw value of each line that is one."""
    pattern = r"^\s*([A-Za-z][A-Za-z ]*?)\s*=\s*([0-9]+(?:[.,][0-9]+)?)?\s*(m2|m²|mm|cm|m|kg)?\s*(.*?)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    number = F.replace(part(2), F.lit(","), F.lit(".")).try_cast("double")
    return lines.where(text.rlike(pattern)).select(key, F.lower(part(1)).alias("name"), number.alias("number"), part(3).alias("unit"), part(4).alias("rest"))


def preservation(jobs: DataFrame, key: str, captured: Column, verified: Column, failed: Column) -> DataFrame:
    """What happens to a job's local copy: quarantined on failure, purged only when captured and verified, else kept."""
    action = F.when(failed, "quarantine").when(captured & verified, "purge").otherwise("keep")
    return jobs.select(key, action.alias("action"))


def schema_health(spark, tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """table_name, column_name, filled, rows of the columns that tables should have: how many values there are; null where the column or table is missing.

    One aggregate a table, over the expected columns it has.
    """
    told = []
    for name, columns in expected.items():
        there = [c for c in columns if name in tables and c in tables[name].columns]
        entries = [F.struct(F.lit(c).alias("column_name"), (F.count(c) if c in there else F.lit(None).cast("long")).alias("filled")) for c in columns]
        source = tables[name] if name in tables else spark.range(1).limit(1)
        rows = F.count("*") if name in tables else F.max(F.lit(None).cast("long"))
        told.append(source.agg(F.array(*entries).alias("e"), rows.alias("rows")).select(F.lit(name).alias("table_name"), F.inline("e"), "rows"))
    return reduce(DataFrame.unionByName, told)


def relinked(records: DataFrame, choices: DataFrame, key: str, category: Column) -> DataFrame:
    """Human links win over automatic ones, and the category is projected again from what is linked."""
    merged = upsert(records, choices, [key], keep_old=True)
    return merged.withColumn("category", category)


def retention_plan(rows: DataFrame, key: str, kind: str, at: str, now: Column, days: Mapping[str, int], protected: DataFrame) -> DataFrame:
    """Rows past the days of their kind and not protected; kinds without a limit stay."""
    limit = F.lit(None).cast("int")
    for name, n in days.items():
        limit = F.when(F.col(kind) == name, F.lit(n)).otherwise(limit)
    old = F.coalesce(F.date_diff(now, F.col(at)) > limit, F.lit(False))
    return rows.where(old).join(protected, key, "left_anti").select(key, kind)
