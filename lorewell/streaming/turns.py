"""Turns of agent tasks from their event logs: what was asked, what was answered at last, and why the rest was dropped.

Events are rows (task, n, kind, turn, message, text): `n` orders a task's log, `turn` is the log's own id of a turn, `message`
that of a message. Kinds: started, completed and aborted say what becomes of a turn; user is text that a user wrote,
user_other something else that a user gave, context what was put into a user's mouth; legacy is a prompt in the old form;
final is an answer that ends a turn; message and other are anything else, broken what could not be read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SCHEMA = "task string, turn_id string, prompt string, answer string, reason string, n long"
#: The reasons for which something is dropped.
ABORTED_OLD, ABORTED, SUPERSEDED, UNANSWERED = "aborted_legacy_prompts", "aborted_messages", "superseded_by_new_turn", "task_complete_without_final"
OTHER_TURN, REPEATED, MIRRORED, STRAY, BLIND, HALF = "user_turn_mismatch", "duplicate_user_message", "legacy_mirror_ignored", "final_turn_mismatch", "final_depends_on_unsupported_input", "incomplete_turn"
OLD_OFF, OLD_NAMELESS, OLD_EMPTY, IDLE = "legacy_disabled", "legacy_missing_identity", "legacy_empty_prompt", "idle"
#: Kinds that leave the state as it is, and what they are counted as.
COUNTED = {"context": "unsupported_or_unauthored_user", "message": "non_conversation_message", "other": "non_conversation_record", "broken": "non_object_record"}
KINDS = ("started", "completed", "aborted", "user", "user_other", "legacy", "final")


@dataclass
class Log:
    """What a task's log has left open: the turn that runs, the turn of the open messages, these, open prompts of the old form,
    and turns that hold something which cannot be read as text."""

    running: str | None = None
    owner: str | None = None
    said: list[tuple[str, str]] = field(default_factory=list)
    old: list[tuple[str, str]] = field(default_factory=list)
    blind: set[str] = field(default_factory=set)

    def let_go(self) -> int:
        count, self.said, self.owner = len(self.said), [], None
        return count

    def step(self, kind: str, turn: str | None, message: str | None, text: str | None, drops: Counter) -> tuple[str, str, str] | None:
        """Takes one event; gives (turn_id, prompt, answer) if it ends a turn, and counts what is dropped."""
        filled = text is not None and text.strip() != ""
        if kind == "started":
            if turn != self.owner:
                drops[SUPERSEDED] += self.let_go()
            self.running = turn
        elif kind == "completed":
            if turn == self.owner:
                drops[UNANSWERED] += self.let_go()
        elif kind == "aborted":
            drops[ABORTED_OLD] += len(self.old)
            drops[ABORTED] += self.let_go()
            self.old = []
        elif kind == "user_other" or (kind == "user" and not (filled and turn and message)):
            drops[COUNTED["context"]] += 1
            if turn and kind == "user_other":
                self.blind.add(turn)
        elif kind == "user":
            if self.running not in (None, turn):
                drops[OTHER_TURN] += 1
                return None
            if self.owner != turn:
                self.said, self.owner = [], turn
            if any(known == message for known, _ in self.said):
                drops[REPEATED] += 1
            else:
                self.said.append((message, text))
        elif kind == "legacy":
            why = OLD_NAMELESS if not message else None if filled else OLD_EMPTY
            if why:
                drops[why] += 1
            else:
                self.old.append((message, text))
        elif kind == "final":
            return self.answered(turn, text if filled else None, drops)
        return None

    def answered(self, turn: str | None, text: str | None, drops: Counter) -> tuple[str, str, str] | None:
        """A final answer: it goes with its turn's own messages, else with prompts of the old form, else with nothing."""
        ours, readable = turn is not None and turn == self.owner, self.owner not in self.blind
        if self.said and ours and readable:
            asked = self.said
            drops[MIRRORED] += len(self.old)
        elif self.old:
            asked = self.old
        else:
            drops[STRAY if not ours else BLIND if not readable else HALF] += 1
            return None
        if text is None:
            drops[HALF] += 1
            return None
        self.let_go()
        self.old = []
        return asked[0][0], "\n".join(t for _, t in asked), text


def _frame(task: str, turns: list, drops: Counter) -> pd.DataFrame:
    rows = [(task, *t, None, None) for t in turns] + [(task, None, None, None, reason, n) for reason, n in sorted(drops.items()) if n]
    return pd.DataFrame(rows, columns=["task", "turn_id", "prompt", "answer", "reason", "n"]).astype({"n": "Int64"})


def prepared(events: DataFrame, legacy: bool) -> DataFrame:
    """The events with a name for prompts of the old form that have none but a time, and these as a plain count if they are
    not wanted."""
    nameless = (F.col("kind") == "legacy") & F.col("message").isNull()
    by_time = F.concat(F.lit("event-"), F.sha2(F.concat_ws("\n", "task", F.col("at").cast("string")), 256))
    named = F.when(nameless & F.col("at").isNotNull(), by_time).otherwise(F.col("message")) if "at" in events.columns else F.col("message")
    rows = events.where("task IS NOT NULL").withColumn("message", named)
    return rows if legacy else rows.withColumn("kind", F.when(F.col("kind") == "legacy", OLD_OFF).otherwise(F.col("kind")))


def reason_of(kind: Column) -> Column:
    """What a kind that changes nothing is counted as; an unknown kind is a record of no conversation."""
    known = F.create_map(*[F.lit(x) for kv in ({OLD_OFF: OLD_OFF} | COUNTED).items() for x in kv])
    return F.coalesce(known[kind], F.lit(COUNTED["other"]))


def assembled(events: DataFrame, legacy: bool = False) -> DataFrame:
    """task, turn_id, prompt, answer of every turn, and task, reason, n of what was dropped (the other columns null).

    A task's log is a sequence, so it is folded in order by one task, as a stream: what is kept is what is open. Events
    that change nothing are counted beforehand and don't go there. Events of equal n go by kind, message and text; rows
    without a task are left out; an empty table gives no rows. What is still open at the end is not dropped yet.
    """
    rows = prepared(events, legacy)
    moving = rows.where(F.col("kind").isin(*KINDS)).select("task", "n", "kind", "turn", "message", "text")
    counted = rows.where(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).groupBy("task", reason_of(F.col("kind")).alias("reason")).agg(F.count("*").alias("n"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, log, drops = None, Log(), Counter()
        for batch in batches:
            for own, part in batch.groupby("task", sort=False):
                if own != task:
                    yield _frame(task, [], drops)
                    task, log, drops = own, Log(), Counter()
                yield _frame(task, _fed(log, part, drops), Counter())
        yield _frame(task, [], drops)

    order = ["task", "n", "kind", "message", "text"]
    turns = moving.repartition("task").sortWithinPartitions(*order).mapInPandas(fold, SCHEMA)
    return turns.unionByName(counted, allowMissingColumns=True).select("task", "turn_id", "prompt", "answer", "reason", "n")


def _fed(log: Log, rows: pd.DataFrame, drops: Counter) -> list[tuple[str, str, str]]:
    plain = rows[["kind", "turn", "message", "text"]].astype(object).where(lambda x: x.notna(), None)
    found = (log.step(*r, drops) for r in plain.itertuples(index=False, name=None))
    return [t for t in found if t is not None]


class Turns(StatefulProcessor):
    """The same over a stream: what is open is kept for each task in states of its own, and let go when the task is idle."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "running string, owner string")
        self.said = handle.getListState("said", "message string, text string")
        self.old = handle.getListState("old", "message string, text string")
        self.blind = handle.getMapState("blind", "turn string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["n", "kind", "message", "text"], na_position="first")
        running, owner = self.at.get() if self.at.exists() else (None, None)
        log = Log(running, owner, [tuple(x) for x in self.said.get()], [tuple(x) for x in self.old.get()], {k[0] for k in self.blind.keys()})
        known, drops = set(log.blind), Counter()
        moving = batch["kind"].isin(KINDS)
        drops.update(batch.loc[~moving, "reason"])
        turns = _fed(log, batch[moving], drops)
        self._keep(log, known)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch["at_ms"].max()) + self.idle_ms)
        yield _frame(key[0], turns, drops)

    def _keep(self, log: Log, known: set[str]) -> None:
        self.at.update((log.running, log.owner))
        for state, rows in ((self.said, log.said), (self.old, log.old)):
            state.put(rows) if rows else state.clear()
        for turn in log.blind - known:
            self.blind.updateValue((turn,), (True,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = len(list(self.said.get())) + len(list(self.old.get()))
        for state in (self.at, self.said, self.old, self.blind):
            state.clear()
        yield _frame(key[0], [], Counter({IDLE: left}))

    def close(self) -> None:
        pass


def streamed(events: DataFrame, legacy: bool = False, idle: str | None = None) -> DataFrame:
    """The rows of assembled() as they come; `n` counts what a batch dropped.

    With `idle` (seconds) the events need a timestamp `at` with a watermark: a task that was silent for so long lets go of what
    is open, which is counted; an event that comes in the same batch in which this is found out comes first. Events of a task must come in the order of their batches. The session needs the RocksDB
    state store, as every query with several states.
    """
    at_ms = F.unix_millis(F.col("at").cast("timestamp")) if idle is not None else F.lit(0).cast("long")
    rows = prepared(events, legacy).withColumns({"reason": reason_of(F.col("kind")), "at_ms": at_ms})
    slim = rows.select("task", "n", "kind", "turn", "message", "text", "reason", "at_ms", *(["at"] if idle is not None else []))
    processor = Turns(None if idle is None else int(float(idle) * 1000))
    return slim.groupBy("task").transformWithStateInPandas(processor, SCHEMA, "append", "none" if idle is None else "eventtime")
