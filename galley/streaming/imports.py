"""Imports as keyed state: commands move an import through its steps, time evicts and finds it stalled, snapshots fan out.

Commands: (event_id, id, tick, command, kind, step, status, progress, message, queue, slug); ``tick`` are whole
seconds of event time, and commands of an import count in the order of (tick, event_id).

* register begins an import of a kind (url, text, image) with the kind's steps, all pending; what comes before is lost.
* step sets a step's status and progress. A step that begins completes the one before it. The import is in error
  after a step in error, completed when all steps are, else in progress. Names that the kind does not have set nothing.
* complete and error end an import; error's ``message`` replaces any, a step's error only stands where none is.
* subscribe and unsubscribe open and close a named queue.

A completed or failed import that nobody follows is evicted FORGET_S seconds after its last change; later commands
find nothing until it is registered again. An unfinished one whose step and message stay the same for more than
STALL_S seconds is stalled, once for each such stretch.

``live`` runs this on a stream, in keyed state with event-time timers: commands wait in state until the watermark
has passed them, so that files in any order within the watermark's delay give the same rows. ``history`` gives the
same rows of a finished table by windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog
from galley.streaming.progress import FORGET_S, STALL_S

catalog = Catalog()
# The steps of each kind of import.
STEPS = {
    "url": ["check_existence", "scrape_content", "structure_recipe", "save_recipe"],
    "text": ["check_existence", "generate_recipe", "structure_recipe", "save_recipe"],
    "image": ["ocr_extract", "structure_recipe", "save_recipe"],
}
ENDED = ("completed", "error")
COMMAND = "event_id bigint, id bigint, tick bigint, command string, kind string, step string, status string, progress int, message string, queue string, slug string"
NEWS = "id bigint, tick bigint, event_id bigint, what string, status string, current string, error string, slug string, steps string"


# --- one command after the other ---


def _new(kind: str, tick: int) -> dict:
    return {"steps": [[s, "pending", 0] for s in STEPS.get(kind, [])], "status": "pending", "current": None, "message": "", "error": None, "slug": None, "updated": tick, "changed": tick, "stalled": False}


def advance(entry: dict | None, c) -> dict | None:
    """The import after a command; None while it is not registered."""
    if c.command == "register":
        return _new(c.kind, c.tick)
    if entry is None or c.command not in ("step", "complete", "error"):
        return entry
    if c.command != "step":
        entry |= {"status": "completed", "slug": c.slug or entry["slug"]} if c.command == "complete" else {"status": "error", "error": c.message}
        return entry | {"updated": c.tick}
    steps, mark = {s[0]: s for s in entry["steps"]}, (entry["current"], entry["message"])
    before = steps.get(entry["current"])
    if c.status == "in_progress" and before is not None and before[0] != c.step and before[1] != "completed":
        before[1:] = ["completed", 100]
    if (own := steps.get(c.step)) is None:
        return entry
    own[1:] = [c.status, c.progress]
    if c.message:
        entry["message"] = c.message
    if c.status == "in_progress":
        entry["current"] = c.step
    if c.status == "error":
        entry["status"], entry["error"] = "error", entry["error"] or c.message or None
    else:
        entry["status"] = "completed" if all(s[1] == "completed" for s in entry["steps"]) else "in_progress"
    entry["updated"] = c.tick
    if (entry["current"], entry["message"]) != mark:
        entry |= {"changed": c.tick, "stalled": False}
    return entry


def _news(key: int, tick: int, event_id: int | None, what: str, e: dict) -> Row:
    steps = ", ".join(f"{s[0]} {s[1]} {s[2]}" for s in e["steps"])
    return Row(id=key, tick=tick, event_id=event_id, what=what, status=e["status"], current=e["current"], error=e["error"], slug=e["slug"], steps=steps)


class Import(StatefulProcessor):
    """Keyed state: the import, who follows it, and commands that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "body string")
        self.waiting = handle.getListState("waiting", COMMAND)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [Row(**{c.split()[0]: r[c.split()[0]] for c in COMMAND.split(", ")}) for r in rows]
        self.waiting.appendList([tuple(r) for r in rows])
        for tick in {r.tick for r in rows}:
            self.handle.registerTimer(tick * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        # an expiry may be at the watermark itself
        passed = max(passed, expiredTimerInfo.getExpiryTimeInMs() // 1000)
        names = [c.split()[0] for c in COMMAND.split(", ")]
        waiting = [Row(*names)(*r) for r in self.waiting.get()]
        due = sorted((r for r in waiting if r.tick <= passed), key=lambda r: (r.tick, r.event_id))
        if due:
            self.waiting.put([tuple(r) for r in waiting if r.tick > passed]) if len(due) < len(waiting) else self.waiting.clear()
        held = json.loads(self.held.get()[0]) if self.held.exists() else {"entry": None, "queues": [], "left": -1, "last": -1}
        id_ = key[0]
        for c in due:
            yield from self._time(id_, held, c.tick)
            live = held["entry"] is not None
            held["entry"] = advance(held["entry"], c)
            if c.command == "subscribe" and c.queue not in held["queues"]:
                held["queues"].append(c.queue)
            if c.command == "unsubscribe" and c.queue in held["queues"]:
                held["queues"].remove(c.queue)
                held["left"] = c.tick
            held["last"] = c.tick
            if live and c.command in ("step", "complete", "error"):
                yield _news(id_, c.tick, c.event_id, "snapshot", held["entry"])
        yield from self._time(id_, held, passed)
        if held["entry"] is not None:
            for tick in (self._evicts(held), held["entry"]["changed"] + STALL_S):
                if tick is not None and tick >= passed:
                    self.handle.registerTimer((tick + 1) * 1000)
        self.held.update((json.dumps(held),))

    @staticmethod
    def _evicts(held: dict) -> int | None:
        e = held["entry"]
        return max(e["updated"] + FORGET_S, held["left"]) if e["status"] in ENDED and not held["queues"] else None

    def _time(self, id_: int, held: dict, now: int) -> Iterator[Row]:
        """What the time between the last command and ``now`` brings."""
        e = held["entry"]
        if e is None:
            return
        if (tick := self._evicts(held)) is not None and tick < now:
            held["entry"] = None
            yield _news(id_, tick, None, "evicted", e)
        elif e["status"] not in ENDED and not e["stalled"] and held["last"] <= e["changed"] + STALL_S < now:
            e["stalled"] = True
            yield _news(id_, e["changed"] + STALL_S, None, "stalled", e)


def live(commands: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """News of a stream of commands: snapshots, evictions and stalls, as the watermark passes them."""
    timed = commands.withColumn("ts", F.timestamp_seconds("tick")).withWatermark("ts", delay)
    return timed.groupBy("id").transformWithState(Import(), NEWS, "append", "eventTime")


def deliver(queues: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each snapshot to every queue that is open at its time; a batch that is repeated replaces itself."""

    def send(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, queues).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return send


# --- the same of a finished table ---


def open_queues(commands: DataFrame) -> DataFrame:
    """(id, queue, opened, opened_by, closed, closed_by): when each queue of an import was open, by (tick, event_id); null while it is."""
    w = Window.partitionBy("id", "queue").orderBy("tick", "event_id")
    rows = commands.where(F.col("command").isin("subscribe", "unsubscribe")).withColumn("before", F.lag("command").over(w))
    rows = rows.where(F.coalesce("before", F.lit("unsubscribe")) != F.col("command"))  # what changes something
    rows = rows.withColumn("closed", F.lead("tick").over(w)).withColumn("closed_by", F.lead("event_id").over(w))
    return rows.where("command = 'subscribe'").select("id", "queue", F.col("tick").alias("opened"), F.col("event_id").alias("opened_by"), "closed", "closed_by")


def fan_out(news: DataFrame, queues: DataFrame) -> DataFrame:
    """(id, event_id, queue, status, current, error): each snapshot for every queue open at its command."""
    tick, n, q = F.struct(F.col("n.tick"), F.col("n.event_id")), news.where("what = 'snapshot'").alias("n"), queues.alias("q")
    open_ = (F.col("n.id") == F.col("q.id")) & (F.struct(F.col("q.opened").alias("tick"), F.col("q.opened_by").alias("event_id")) < tick) & (F.col("q.closed").isNull() | (tick < F.struct(F.col("q.closed").alias("tick"), F.col("q.closed_by").alias("event_id"))))
    return n.join(q, open_).select("n.id", "n.event_id", "q.queue", "n.status", "n.current", "n.error")


def history(commands: DataFrame, now: Column) -> DataFrame:
    """The news of a finished table of commands, until ``now``."""
    by_id = Window.partitionBy("id").orderBy("tick", "event_id")
    by = Window.partitionBy("id", "session").orderBy("tick", "event_id")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w=so_far: F.last(c, ignorenulls=True).over(w)
    is_ = lambda *names: F.col("command").isin(*names)
    rows = commands.where("id is not null and tick is not null").withColumn("now", now)
    # who follows: a queue's command counts where it changes the queue
    queue = Window.partitionBy("id", "queue", is_("subscribe", "unsubscribe")).orderBy("tick", "event_id")
    rows = rows.withColumn("was", F.coalesce(F.lag("command").over(queue), F.lit("unsubscribe")))
    step = F.when(is_("subscribe", "unsubscribe") & (F.col("was") != F.col("command")), F.when(is_("subscribe"), 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("change", step).withColumn("followers", F.sum("change").over(by_id)).withColumn("left", F.last(F.when(F.col("change") == -1, F.col("tick")), ignorenulls=True).over(by_id))
    rows = rows.withColumn("next_at", F.coalesce(F.lead("tick").over(by_id), "now")).withColumn("session", F.sum(is_("register").cast("int")).over(by_id)).where("session > 0")
    # the steps of the kind, and which is on
    rows = rows.withColumn("own", F.first("kind").over(by))
    listed = F.coalesce(*[F.when(F.col("own") == k, F.array(*map(F.lit, v))) for k, v in STEPS.items()], F.array().cast("array<string>"))
    rows = rows.withColumn("listed", listed).withColumn("known", is_("step") & F.array_contains("listed", F.col("step")))
    begins = is_("step") & (F.col("status") == "in_progress")
    rows = rows.withColumn("begun", F.when(begins & F.col("known"), F.col("step"))).withColumn("prior", last("begun", before)).withColumn("current", last("begun"))
    longest = max(map(len, STEPS.values()))
    for j in range(longest):
        name = F.get("listed", F.lit(j))
        told, passed = F.col("known") & (F.col("step") == name), begins & (F.col("prior") == name) & (F.col("step") != name)
        rows = rows.withColumn(f"s{j}", F.coalesce(last(F.when(told, F.col("status")).when(passed, F.lit("completed"))), F.lit("pending")))
        rows = rows.withColumn(f"p{j}", F.coalesce(last(F.when(told, F.col("progress")).when(passed & (F.lag(f"s{j}").over(by) != "completed"), F.lit(100))), F.lit(0)))
    done = F.forall(F.arrays_zip("listed", F.slice(F.array(*[f"s{j}" for j in range(longest)]), 1, F.size("listed")).alias("s")), lambda x: x["s"] == "completed")
    moves = F.when(is_("register"), "pending").when(is_("complete"), "completed").when(is_("error"), "error").when(F.col("known"), F.when(F.col("status") == "error", "error").when(done, "completed").otherwise("in_progress"))
    rows = rows.withColumn("moves", moves).withColumn("state", last("moves")).withColumn("updated", last(F.when(F.col("moves").isNotNull(), F.col("tick"))))
    said = F.when(F.col("known") & (F.col("message") != ""), F.col("message"))
    rows = rows.withColumn("note", F.coalesce(last(said), F.lit("")))
    rows = rows.withColumn("error", F.coalesce(last(F.when(is_("error"), F.col("message"))), F.first(F.when(F.col("known") & (F.col("status") == "error"), said), ignorenulls=True).over(so_far)))
    rows = rows.withColumn("slug", last(F.when(is_("complete"), F.col("slug"))))
    # time
    mark = F.concat_ws("|", F.coalesce("current", F.lit("")), "note")
    rows = rows.withColumn("mark", mark).withColumn("changed", last(F.when(is_("register") | (F.lag("mark").over(by) != F.col("mark")), F.col("tick"))))
    ended = F.col("state").isin(*ENDED)
    rows = rows.withColumn("evicts", F.when(ended & (F.col("followers") == 0), F.greatest(F.col("updated") + FORGET_S, "left")))
    rows = rows.withColumn("gone", F.coalesce(F.max(F.coalesce(F.col("evicts") < F.col("next_at"), F.lit(False))).over(before), F.lit(False))).where(~F.col("gone"))
    stalls = F.col("changed") + STALL_S
    events = F.filter(
        F.array(
            F.when(is_("step", "complete", "error"), F.struct(F.lit("snapshot").alias("what"), F.col("tick").alias("t"), F.col("event_id").alias("e"))),
            F.when(F.col("evicts") < F.col("next_at"), F.struct(F.lit("evicted").alias("what"), F.col("evicts").alias("t"), F.lit(None).cast("bigint").alias("e"))),
            F.when(~ended & (F.col("tick") <= stalls) & (stalls < F.col("next_at")), F.struct(F.lit("stalled").alias("what"), stalls.alias("t"), F.lit(None).cast("bigint").alias("e"))),
        ),
        lambda x: x.isNotNull(),
    )
    zipped = F.transform("listed", lambda n, j: F.concat_ws(" ", n, F.get(F.array(*[f"s{k}" for k in range(longest)]), j), F.get(F.array(*[f"p{k}" for k in range(longest)]), j).cast("string")))
    rows = rows.select("id", F.explode(events).alias("x"), "command", F.col("state").alias("status"), "current", "error", "slug", F.concat_ws(", ", zipped).alias("steps"))
    return rows.select("id", F.col("x.t").alias("tick"), F.col("x.e").alias("event_id"), F.col("x.what").alias("what"), "status", "current", "error", "slug", "steps", "command")


def _history(s, d) -> DataFrame:
    rows = view(s, d, "commands")
    end = rows.agg(F.max("tick").alias("end"))
    return history(rows.crossJoin(F.broadcast(end)), F.col("end"))  # one row


_LISTED = "CASE own " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in STEPS.items()) + " END"
_SO_FAR = "(PARTITION BY id, session ORDER BY tick, event_id)"
_STEP = lambda j: f"known AND step = listed[{j}]"
_PASSED = lambda j: f"command = 'step' AND status = 'in_progress' AND prior = listed[{j}] AND step <> listed[{j}]"
_HISTORY = f"""queues AS (
    SELECT id, queue, tick, event_id, command FROM (SELECT *, lag(command) OVER (PARTITION BY id, queue ORDER BY tick, event_id) AS was FROM commands WHERE command IN ('subscribe', 'unsubscribe')) WHERE coalesce(was, 'unsubscribe') <> command),
  h0 AS (SELECT c.*, max(c.tick) OVER () AS now, lead(c.tick) OVER (PARTITION BY c.id ORDER BY c.tick, c.event_id) AS following, count(*) FILTER (WHERE c.command = 'register') OVER (PARTITION BY c.id ORDER BY c.tick, c.event_id) AS session,
      sum(CASE q.command WHEN 'subscribe' THEN 1 WHEN 'unsubscribe' THEN -1 ELSE 0 END) OVER (PARTITION BY c.id ORDER BY c.tick, c.event_id) AS followers,
      max(CASE WHEN q.command = 'unsubscribe' THEN c.tick END) OVER (PARTITION BY c.id ORDER BY c.tick, c.event_id) AS closed
    FROM commands c LEFT JOIN queues q USING (id, event_id)),
  h1 AS (SELECT *, first_value(kind) OVER {_SO_FAR} AS own FROM h0 WHERE session > 0),
  h2 AS (SELECT *, {_LISTED} AS listed, command = 'step' AND list_contains({_LISTED}, step) AS known FROM h1),
  h3 AS (SELECT *, last_value(CASE WHEN known AND status = 'in_progress' THEN step END IGNORE NULLS) OVER {_SO_FAR} AS current,
      last_value(CASE WHEN known AND status = 'in_progress' THEN step END IGNORE NULLS) OVER (PARTITION BY id, session ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h2),
  h4 AS (SELECT *, {", ".join(f"coalesce(last_value(CASE WHEN {_STEP(j)} THEN status WHEN {_PASSED(j)} THEN 'completed' END IGNORE NULLS) OVER {_SO_FAR}, 'pending') AS s{j}" for j in (1, 2, 3, 4))} FROM h3),
  h5 AS (SELECT *, {", ".join(f"lag(s{j}) OVER {_SO_FAR} AS b{j}" for j in (1, 2, 3, 4))} FROM h4),
  h6 AS (SELECT *, {", ".join(f"coalesce(last_value(CASE WHEN {_STEP(j)} THEN progress WHEN {_PASSED(j)} AND b{j} <> 'completed' THEN 100 END IGNORE NULLS) OVER {_SO_FAR}, 0) AS p{j}" for j in (1, 2, 3, 4))},
      CASE WHEN command = 'register' THEN 'pending' WHEN command = 'complete' THEN 'completed' WHEN command = 'error' THEN 'error'
        WHEN known THEN CASE WHEN status = 'error' THEN 'error' WHEN s1 = 'completed' AND s2 = 'completed' AND s3 = 'completed' AND (len(listed) = 3 OR s4 = 'completed') THEN 'completed' ELSE 'in_progress' END END AS moves FROM h5),
  h7 AS (SELECT *, last_value(moves IGNORE NULLS) OVER {_SO_FAR} AS state, max(CASE WHEN moves IS NOT NULL THEN tick END) OVER {_SO_FAR} AS updated,
      coalesce(last_value(CASE WHEN known AND message <> '' THEN message END IGNORE NULLS) OVER {_SO_FAR}, '') AS note, last_value(CASE WHEN command = 'complete' THEN slug END IGNORE NULLS) OVER {_SO_FAR} AS won,
      coalesce(last_value(CASE WHEN command = 'error' THEN message END IGNORE NULLS) OVER {_SO_FAR}, first_value(CASE WHEN known AND status = 'error' AND message <> '' THEN message END IGNORE NULLS) OVER {_SO_FAR}) AS error FROM h6),
  h8 AS (SELECT *, coalesce(current, '') || '|' || note AS mark, lag(coalesce(current, '') || '|' || note) OVER {_SO_FAR} AS mark0, coalesce(following, now) AS next_at,
      CASE WHEN state IN ('completed', 'error') AND followers = 0 THEN greatest(updated + {FORGET_S}, closed) END AS evicts FROM h7),
  h9 AS (SELECT *, max(CASE WHEN mark0 IS NULL OR mark <> mark0 THEN tick END) OVER {_SO_FAR} + {STALL_S} AS stalls,
      coalesce(bool_or(evicts < next_at) OVER (PARTITION BY id, session ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone,
      concat(listed[1], ' ', s1, ' ', p1, ', ', listed[2], ' ', s2, ' ', p2, ', ', listed[3], ' ', s3, ' ', p3, CASE WHEN len(listed) = 4 THEN concat(', ', listed[4], ' ', s4, ' ', p4) ELSE '' END) AS steps FROM h8),
  news AS (SELECT id, tick, event_id, 'snapshot' AS what, state AS status, current, error, won AS slug, steps, command FROM h9 WHERE NOT gone AND command IN ('step', 'complete', 'error')
    UNION ALL SELECT id, evicts, NULL, 'evicted', state, current, error, won, steps, command FROM h9 WHERE NOT gone AND evicts < next_at
    UNION ALL SELECT id, stalls, NULL, 'stalled', state, current, error, won, steps, command FROM h9 WHERE NOT gone AND state NOT IN ('completed', 'error') AND tick <= stalls AND stalls < next_at)"""
_COLUMNS = ["id", "tick", "event_id", "status", "current", "error", "slug", "steps"]


def _news_query(name: str, where: str) -> None:
    catalog.add(name, lambda s, d: _history(s, d).where(where).select(*_COLUMNS), with_views(f"WITH {_HISTORY} SELECT {', '.join(_COLUMNS)} FROM news WHERE {where}"))


_news_query("STM-2_update_step", "what = 'snapshot' AND command = 'step'")
_news_query("STM-3_complete", "what = 'snapshot' AND command = 'complete'")
_news_query("STM-4_set_error", "what = 'snapshot' AND command = 'error'")
_news_query("STM-6_evicted", "what = 'evicted'")
_news_query("STM-11_stalled", "what = 'stalled'")
catalog.add("STM-7_fan_out", lambda s, d: fan_out(_history(s, d), open_queues(view(s, d, "commands"))), with_views(f"""WITH {_HISTORY}, opened AS (
    SELECT id, queue, command, tick, event_id, lead(tick) OVER w AS closed, lead(event_id) OVER w AS closed_by FROM queues WINDOW w AS (PARTITION BY id, queue ORDER BY tick, event_id))
  SELECT n.id, n.event_id, o.queue, n.status, n.current, n.error FROM news n JOIN opened o ON o.id = n.id AND o.command = 'subscribe' AND n.what = 'snapshot'
    AND (o.tick < n.tick OR (o.tick = n.tick AND o.event_id < n.event_id)) AND (o.closed IS NULL OR n.tick < o.closed OR (n.tick = o.closed AND n.event_id < o.closed_by))"""))  # fmt: skip
catalog.add("STM-8_open_queues", lambda s, d: open_queues(view(s, d, "commands")), with_views(f"""WITH {_HISTORY} SELECT id, queue, opened, opened_by, closed, closed_by FROM (
    SELECT id, queue, command, tick AS opened, event_id AS opened_by, lead(tick) OVER w AS closed, lead(event_id) OVER w AS closed_by FROM queues WINDOW w AS (PARTITION BY id, queue ORDER BY tick, event_id)) WHERE command = 'subscribe'"""))  # fmt: skip

QUERIES, SQL = catalog.queries, catalog.sql
