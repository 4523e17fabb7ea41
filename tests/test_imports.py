"""Imports: the rules one by one, the stream against the table, and deliveries that are repeated."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from galley.streaming import imports as m

FIELDS = [c.split()[0] for c in m.COMMAND.split(", ")]


def command(event_id, tick, name, id_=1, kind=None, step=None, status=None, progress=0, message="", queue=None, slug=None):
    return (event_id, id_, tick, name, kind, step, status, progress, message, queue, slug)


def after(*commands):
    entry = None
    for c in commands:
        entry = m.advance(entry, SimpleNamespace(**dict(zip(FIELDS, c, strict=True))))
    return entry


def test_register_begins_with_the_steps_of_its_kind():
    for kind, names in m.STEPS.items():
        e = after(command(1, 0, "register", kind=kind))
        assert [s[0] for s in e["steps"]] == names and e["status"] == "pending" and {s[1] for s in e["steps"]} == {"pending"}
    assert after(command(1, 0, "complete", slug="x")) is None  # unknown imports stay unknown


def test_a_step_that_begins_completes_the_one_before():
    e = after(command(1, 0, "register", kind="url"), command(2, 1, "step", step="check_existence", status="in_progress", progress=40), command(3, 2, "step", step="scrape_content", status="in_progress"))
    assert e["steps"][0] == ["check_existence", "completed", 100] and e["current"] == "scrape_content" and e["status"] == "in_progress"


def test_all_steps_complete_the_import():
    e = after(command(1, 0, "register", kind="image"), *[command(i, i, "step", step=s, status="completed", progress=100) for i, s in enumerate(m.STEPS["image"], 2)])
    assert e["status"] == "completed"


def test_errors():
    e = after(command(1, 0, "register", kind="url"), command(2, 1, "step", step="scrape_content", status="error", message="no page"), command(3, 2, "step", step="scrape_content", status="error", message="again"))
    assert (e["status"], e["error"]) == ("error", "no page")
    assert after(command(1, 0, "register", kind="url"), command(2, 1, "error", message="gone"))["error"] == "gone"
    e = after(command(1, 0, "register", kind="url"), command(2, 1, "step", step="nowhere", status="error", message="x"))
    assert (e["status"], e["error"], e["updated"]) == ("pending", None, 0)


def made_up(seed):
    r = random.Random(seed)
    out, names = [], sorted({s for v in m.STEPS.values() for s in v}) + ["nowhere"]
    for id_ in range(12):
        tick = r.randrange(500)
        for k in range(r.randrange(3, 40)):
            tick += r.choice([0, 1, 20, 150, 299, 300, 301, 500, 901, 1500])
            name = r.choices(["register", "step", "complete", "error", "subscribe", "unsubscribe"], [2, 12, 1, 1, 1, 1])[0] if k else "register"
            out.append(command(len(out) + 1, tick, name, id_, r.choice(list(m.STEPS)), r.choice(names), r.choice(["in_progress", "completed", "completed", "error"]), r.randrange(101), r.choice(["", "a", "b"]), f"q{r.randrange(2)}", f"slug{k}"))
    return out


def rows(df):
    names = [c.split()[0] for c in m.NEWS.split(", ")]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_history(spark, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(seed)
    commands = made_up(seed)
    # files hold commands up to nine minutes out of order; then one that is hours late, and a beat that ends the day
    arrived = sorted(commands, key=lambda c: c[2] + r.randrange(540))
    end = max(c[2] for c in commands) + 5000
    late = command(9000, 1, "error", id_=0, message="too late")
    parts = [arrived[i : i + 40] for i in range(0, len(arrived), 40)]
    for k, part in enumerate([*parts, [late], [command(9001, end + 600, "beat", id_=99)]]):
        spark.createDataFrame(part, m.COMMAND).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    if max(c[2] for c in arrived[:-1]) < 2000:
        raise AssertionError("the late command would not be late")
    stream = spark.readStream.schema(m.COMMAND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    run = m.live(stream).writeStream.outputMode("append").format("memory").queryName(f"news{seed}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(600)
    assert run.exception() is None
    want = rows(m.history(spark.createDataFrame(commands, m.COMMAND), F.lit(end)))
    got = rows(spark.table(f"news{seed}"))
    assert got == want
    assert {r_[3] for r_ in want} == {"snapshot", "evicted", "stalled"}


def test_a_repeated_batch_delivers_once(spark, tmp_path):
    commands = spark.createDataFrame(
        [command(1, 0, "register", kind="url"), command(2, 1, "subscribe", queue="a"), command(3, 2, "subscribe", queue="b"), command(4, 3, "step", step="scrape_content", status="in_progress"), command(5, 4, "unsubscribe", queue="a"), command(6, 5, "complete", slug="s")],
        m.COMMAND,
    )
    news, send = m.history(commands, F.lit(100)), m.deliver(m.open_queues(commands), f"{tmp_path}/out")
    for _ in range(2):  # as after a lost driver
        send(news.where("tick < 5"), 0)
    send(news.where("tick >= 5"), 1)
    got = sorted((r.event_id, r.queue, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(4, "a", "in_progress"), (4, "b", "in_progress"), (6, "b", "completed")]
