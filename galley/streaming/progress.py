"""Import progress as a stream, and the same over a finished table of events.

Events are (event_id, id, ts, step, status, value). The streaming forms keep keyed state with a watermark;
each has a batch twin that gives the same final rows, which SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.units import rounded, sql_rounded
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()
#: As they are defined: seconds without news after which an import counts as stalled, and after which a finished one is forgotten.
STALL_S, FORGET_S = 900, 300


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _order() -> Column:
    return F.struct("ts", "event_id")


def snapshot(events: DataFrame) -> DataFrame:
    """The last known state of each import; works on a stream (update mode) and on a table alike."""
    return events.groupBy("id").agg(
        F.max_by("status", _order()).alias("status"), F.max_by("step", _order()).alias("step"), F.count("*").alias("events"),
        F.min("ts").alias("started"), F.max("ts").alias("updated"),
    )


def overall(events: DataFrame) -> DataFrame:
    """Error where any step failed, completed where the last did, else in progress."""
    last = F.max_by("status", _order())
    return events.groupBy("id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").when(last == "completed", "completed").otherwise("in_progress").alias("status"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by status and hour, for a stream: later than the watermark is left out, and closed hours leave the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def changes(events: DataFrame) -> DataFrame:
    """Events whose step or status differs from the one before of the same import."""
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    now = F.concat_ws("|", F.col("step").cast("string"), "status")
    return events.withColumn("before", F.lag(now).over(w)).where(F.col("before").isNull() | (F.col("before") != now)).drop("before")


def stalls(events: DataFrame, seconds: int = STALL_S) -> DataFrame:
    """Gaps of an import that are longer than ``seconds``."""
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    micros = _micros("ts")
    return events.withColumn("gap", micros - F.lag(micros).over(w)).where(F.col("gap") > seconds * 1_000_000).select("id", "event_id", "gap")


_P = "progress"
add("STM-2_progress_state", lambda s, d: overall(view(s, d, _P)),
    "SELECT id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN arg_max(status, {'t': ts, 'e': event_id}) = 'completed' THEN 'completed' ELSE 'in_progress' END AS status FROM progress GROUP BY id")
add("STM-5_snapshot", lambda s, d: snapshot(view(s, d, _P)).select("id", "status", "step", "events"),
    "SELECT id, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(step, {'t': ts, 'e': event_id}) AS step, count(*) AS events FROM progress GROUP BY id")
add("STM-6_eviction", lambda s, d: snapshot(view(s, d, _P)).crossJoin(view(s, d, _P).agg(F.max("ts").alias("now"))).where(F.col("status").isin("completed", "error") & (_micros("now") - _micros("updated") > FORGET_S * 1_000_000)).select("id"),
    "SELECT id FROM (SELECT id, arg_max(status, {'t': ts, 'e': event_id}) AS status, max(ts) AS updated FROM progress GROUP BY id), (SELECT max(ts) AS now FROM progress) WHERE status IN ('completed', 'error') AND epoch_us(now) - epoch_us(updated) > 300000000")
add("STM-11_stalls", lambda s, d: stalls(view(s, d, _P)), "SELECT id, event_id, gap FROM (SELECT id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY ts, event_id) AS gap FROM progress) WHERE gap > 900000000")
add("STM-12_changes", lambda s, d: changes(view(s, d, _P)).select("event_id", "id", "step", "status"),
    "SELECT event_id, id, step, status FROM (SELECT *, lag(step || '|' || status) OVER (PARTITION BY id ORDER BY ts, event_id) AS before FROM progress) WHERE before IS NULL OR before <> step || '|' || status")
add("STM-13_status_handling", lambda s, d: view(s, d, _P).groupBy(F.when(F.col("status") == "completed", "success").when(F.col("status") == "error", "failed").otherwise("running").alias("outcome")).agg(F.count("*").alias("n")), "SELECT CASE status WHEN 'completed' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS outcome, count(*) AS n FROM progress GROUP BY 1")
add("STM-16_queue_drain", lambda s, d: view(s, d, _P).select("event_id", F.when(F.col("status") == "completed", 100).otherwise(F.col("step") * 25).alias("pct")), "SELECT event_id, CASE WHEN status = 'completed' THEN 100 ELSE step * 25 END AS pct FROM progress")
add("STM-10_last_lines", lambda s, d: view(s, d, _P).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("n <= 50").select("id", "event_id"), "SELECT id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS n FROM progress) WHERE n <= 50")
add("STM-1_register", lambda s, d: view(s, d, _P).where("status = 'pending'").groupBy("id").agg(F.min_by("event_id", _order()).alias("first")), "SELECT id, arg_min(event_id, {'t': ts, 'e': event_id}) AS first FROM progress WHERE status = 'pending' GROUP BY id")
add("STM-23_error_record", lambda s, d: view(s, d, _P).where("status = 'error'").select("id", "event_id"), "SELECT id, event_id FROM progress WHERE status = 'error'")
add("STM-9_hourly", lambda s, d: view(s, d, _P).groupBy(F.window("ts", "1 hour").start.cast("string").alias("hour"), "status").agg(F.count("*").alias("n")), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, status, count(*) AS n FROM progress GROUP BY ALL")
add("AGG-55_mean_progress", lambda s, d: view(s, d, _P).groupBy("id").agg(rounded(F.sum(F.col("step") * 25) / F.count("*"), 3).alias("pct")), f"SELECT id, {sql_rounded('sum(step * 25) / count(*)', 3)} AS pct FROM progress GROUP BY id")
add("AGG-56_error_classes", lambda s, d: view(s, d, _P).where("status = 'error'").groupBy(F.when(F.col("value") < 3, "timeout").when(F.col("value") < 6, "network").when(F.col("value") < 20, "parse").otherwise("other").alias("class")).agg(F.count("*").alias("n")), "SELECT CASE WHEN value < 3 THEN 'timeout' WHEN value < 6 THEN 'network' WHEN value < 20 THEN 'parse' ELSE 'other' END AS class, count(*) AS n FROM progress WHERE status = 'error' GROUP BY 1")
add("AGG-67_error_grouping", lambda s, d: view(s, d, _P).where("status = 'error'").withColumn("n", F.row_number().over(Window.partitionBy("step").orderBy(F.col("ts").desc(), "event_id"))).where("n <= 5").select("step", "event_id"), "SELECT step, event_id FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ts DESC, event_id) AS n FROM progress WHERE status = 'error') WHERE n <= 5")
add("AGG-68_import_stats", lambda s, d: view(s, d, _P).groupBy("step").pivot("status", ["pending", "in_progress", "completed", "error"]).agg(F.count("event_id")).select("step", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "in_progress", "completed", "error")]), "SELECT step, " + ", ".join(f"count(*) FILTER (WHERE status = '{c}') AS {c}" for c in ("pending", "in_progress", "completed", "error")) + " FROM progress GROUP BY step")

QUERIES, SQL = catalog.queries, catalog.sql
