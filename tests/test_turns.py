"""Turn assembly: the registered query against a plain loop, and the stream against the batch."""

import hashlib
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorewell.plans import capture_queries, catalog
from lorewell.streaming import turns

SF = "/root/testdata/sf0.001"
FIELDS = ("task", "n", "kind", "turn", "message", "text")
SCHEMA = "task string, n long, kind string, turn string, message string, text string, at timestamp"


def plain(rows, legacy):
    """(turns, drops) by walking each log once, with what is open in one list of (form, id, text)."""
    out, drops = [], Counter()
    logs = defaultdict(list)
    for r in rows:
        if r["task"] is not None:
            logs[r["task"]].append(r)
    null_first = lambda x: (x is not None, x or "")
    for task, log in logs.items():
        waiting, current, bad, of = [], None, set(), None
        drop = lambda why, n=1: drops.update({(task, why): n} if n else {})  # noqa: E731, B023
        new = lambda: [w for w in waiting if w[0] == "new"]  # noqa: E731, B023
        keep = lambda form: [w for w in waiting if w[0] == form]  # noqa: E731, B023
        for r in sorted(log, key=lambda r: (r["n"], *(null_first(r[c]) for c in ("kind", "message", "text")))):
            kind, turn, text, message = r["kind"], r["turn"], r["text"] if r["text"] and r["text"].strip() else None, r["message"]
            if kind == "legacy" and message is None and r["at"] is not None:
                message = "event-" + hashlib.sha256(f"{task}\n{r['at_text']}".encode()).hexdigest()
            if kind in ("started", "completed", "aborted"):
                why = {"started": "superseded_by_new_turn", "completed": "task_complete_without_final", "aborted": "aborted_messages"}[kind]
                if kind == "aborted":
                    drop("aborted_legacy_prompts", len(keep("old")))
                    waiting = keep("new")
                if kind == "aborted" or (kind == "started") != (turn == of):
                    drop(why, len(new()))
                    waiting, of = keep("old"), None
                current = turn if kind == "started" else current
            elif kind == "user" and turn and message and text:
                if current is not None and current != turn:
                    drop("user_turn_mismatch")
                    continue
                if of != turn:
                    waiting, of = keep("old"), turn
                if ("new", message) in {w[:2] for w in waiting}:
                    drop("duplicate_user_message")
                else:
                    waiting.append(("new", message, text))
            elif kind in ("user", "user_other", "context"):
                drop("unsupported_or_unauthored_user")
                if kind == "user_other" and turn:
                    bad.add(turn)
            elif kind == "legacy":
                if not legacy:
                    drop("legacy_disabled")
                elif not message or not text:
                    drop("legacy_missing_identity" if not message else "legacy_empty_prompt")
                else:
                    waiting.append(("old", message, text))
            elif kind == "final":
                matches = turn is not None and turn == of
                asked = new() if matches and of not in bad else []
                if asked:
                    drop("legacy_mirror_ignored", len(keep("old")))
                asked = asked or keep("old")
                if not asked:
                    drop("final_turn_mismatch" if not matches else "final_depends_on_unsupported_input" if of in bad else "incomplete_turn")
                elif not text:
                    drop("incomplete_turn")
                else:
                    out.append((task, asked[0][1], "\n".join(w[2] for w in asked), r["text"]))
                    waiting, of = [], None
            else:
                drop({"message": "non_conversation_message", "broken": "non_object_record"}.get(kind, "non_conversation_record"))
    return Counter(out), drops


def told(df):
    rows = df.collect()
    drops = Counter()
    for r in rows:
        if r.reason is not None:
            drops[r.task, r.reason] += r.n
    return Counter((r.task, r.turn_id, r.prompt, r.answer) for r in rows if r.reason is None), drops


def as_dicts(df):
    return [r.asDict() for r in df.withColumn("at_text", F.col("at").cast("string")).collect()]


def test_query_like_a_plain_loop(spark):
    log = capture_queries._log(spark, SF)
    rows = as_dicts(log)
    want = plain(rows, True)
    assert told(catalog.queries()["assembled_turns"](spark, SF)) == want and len(want[0]) > 20 and len({w for _, w in want[1]}) >= 14
    assert told(turns.assembled(log)) == plain(rows, False)


def odd(spark):
    a = lambda task, *events: [(task, n, *(list(e) + [None] * 4)[:4], None) for n, e in enumerate(events)]
    rows = a("cut", ("legacy", None, "u1", "cancelled"), ("aborted", "t1"), ("final", None, None, "later"))
    rows += a("two", ("started", "t"), ("user", "t", "m1", "a"), ("user", "t", "m2", "b"), ("legacy", None, "u", "b"), ("final", "t", "x", "done"), ("final", "t", "y", "again"))
    rows += a("blind", ("started", "t"), ("user", "t", "m1", "a"), ("user_other", "t"), ("final", "t", "x", "done"), ("completed", "t"))
    rows += a("empty", ("user", "t", "m", "  "), ("user", None, "m", "x"), ("legacy", None, None, "x"), (None,), ("new kind",), ("final", "t", None, ""))
    rows += [(None, 0, "user", "t", "m", "x", None), ("same", 1, "user", "t", "m", "x", None), ("same", 1, "user", "t", "m", "x", None), ("same", 2, "final", "t", "f", "y", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_logs(spark):
    df = odd(spark)
    assert told(turns.assembled(df, True)) == plain(as_dicts(df), True)
    found, drops = told(turns.assembled(df, True))
    assert found == Counter({("two", "m1", "a\nb", "done"): 1, ("same", "m", "x", "y"): 1}) and drops["cut", "aborted_legacy_prompts"] == drops["two", "legacy_mirror_ignored"] == 1
    assert drops["blind", "final_depends_on_unsupported_input"] == drops["blind", "task_complete_without_final"] == drops["same", "duplicate_user_message"] == 1
    assert told(turns.assembled(df.limit(0))) == (Counter(), Counter())


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(parts, make):
        path = str(tmp_path / uuid.uuid4().hex)
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(path)
        name = "t" + uuid.uuid4().hex
        rows = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = make(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path + "-c").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert not q.exception()
        return spark.table(name)

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_like_a_batch(spark, stream):
    log = capture_queries._log(spark, SF).withColumn("at", F.col("at").cast("timestamp")).unionByName(odd(spark))
    parts = [log.where(F.col("n").between(low, high)) for low, high in ((0, 330), (331, 640), (641, 10**9))]
    assert told(stream(parts, lambda s: turns.streamed(s, True))) == told(turns.assembled(log, True))


def test_idle_tasks_let_go(spark, stream):
    rows = [("a", 0, "user", "t", "m", "x", 20), ("b", 0, "user", "t", "m", "x", 20), ("b", 1, "user", "t", "k", "y", 50), ("c", 0, "user", "t", "m", "x", 5000), ("c", 1, "message", None, None, None, 5001), ("a", 1, "final", "t", "f", "late", 6000), ("b", 2, "final", "t", "f", "late", 9000)]
    df = spark.createDataFrame(rows, SCHEMA.replace("at timestamp", "s long")).withColumn("at", F.timestamp_seconds("s")).drop("s")
    parts = [df.where(F.unix_seconds("at").isin(*x)) for x in ((20, 50), (5000,), (5001,), (6000,), (9000,))]
    out = stream(parts, lambda s: turns.streamed(s.withWatermark("at", "1 second"), idle="100"))
    found, drops = told(out)
    assert not found, found
    assert drops["a", "idle"] == 1 and drops["b", "idle"] == 2 and drops["a", "final_turn_mismatch"] == 1
