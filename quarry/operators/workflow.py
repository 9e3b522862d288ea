"""Workflows: a record's run over a chain of nodes, folded from its actions in order.

A run is draft, running, finished or canceled. Submitting pins the definition that is current
at that moment. Approval nodes wait for their assignees (one of them, or all); notify nodes
are passed through. Rejecting and withdrawing lead back to a named node or to the start, where
the originator submits again. Timers are in event time: one that is due before an action
fires first. An action that does not apply is refused and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hooks import Hooks
from .state import seconds

START_NODE = ""
Hook = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Node:
    """``kind``: approve or notify; ``mode``: any or all of the assignees; ``timeout``: such as ``2d``."""

    id: str
    assignees: tuple[str, ...] = ()
    kind: str = "approve"
    mode: str = "any"
    on_reject: str | None = None
    on_withdraw: str | None = None
    timeout: str | None = None
    on_timeout: str = "approve"


@dataclass(frozen=True)
class Version:
    """A definition in force from a time on (epoch seconds), under its content's hash."""

    nodes: tuple[Node, ...]
    hash: str = ""
    since: float = float("-inf")


@dataclass(frozen=True)
class Run:
    """Where a record stands."""

    state: str = "draft"
    node: str | None = None
    waiting: tuple[str, ...] = ()
    told: tuple[str, ...] = ()  # who was notified, in order
    originator: str | None = None
    approval: str | None = None
    version: int = -1
    due: float | None = None


@dataclass(frozen=True)
class Action:
    """``arg``: whom to forward to, or the node to go to; ``actor`` None is the system."""

    name: str
    actor: str | None
    at: float
    arg: str | None = None
    admin: bool = False


@dataclass
class Flow:
    versions: tuple[Version, ...]

    def _nodes(self, run: Run) -> tuple[Node, ...]:
        return self.versions[run.version].nodes

    def _place(self, run: Run, node: str | None) -> int | None:
        return next((i for i, n in enumerate(self._nodes(run)) if n.id == node), None)

    def enter(self, run: Run, i: int, at: float) -> Run | None:
        """At node ``i`` or the first after it that waits; None if nobody could act there."""
        nodes = self._nodes(run)
        while i < len(nodes) and nodes[i].kind == "notify":
            run = replace(run, told=run.told + nodes[i].assignees)
            i += 1
        if i >= len(nodes):
            return replace(run, state="finished", node=None, waiting=(), approval="approved", due=None)
        n = nodes[i]
        if not n.assignees:
            return None
        return replace(run, state="running", node=n.id, waiting=tuple(dict.fromkeys(n.assignees)), approval=None, due=at + seconds(n.timeout) if n.timeout else None)

    def back(self, run: Run, target: str | None, at: float) -> Run | None:
        i = self._place(run, target) if target else None
        if i is None:
            return replace(run, state="running", node=START_NODE, waiting=(), due=None)
        return self.enter(run, i, at)

    def fired(self, run: Run, now: float) -> Run:
        """The run after its timers that are due by ``now``; each node entered arms its own."""
        while run.state == "running" and run.due is not None and run.due <= now:
            i = self._place(run, run.node)
            n = self._nodes(run)[i]
            run = (self.back(run, n.on_reject, run.due) if n.on_timeout == "reject" else self.enter(run, i + 1, run.due)) or replace(run, due=None)
        return run

    def act(self, run: Run, a: Action) -> Run | None:
        """The run after an action, or None if it is refused."""
        if a.name == "submit":
            current = max((i for i, v in enumerate(self.versions) if v.since <= a.at), default=-1)
            if current < 0 or not self.versions[current].nodes or run.state == "running" and run.node != START_NODE:
                return None
            return self.enter(replace(run, version=current, originator=run.originator or a.actor, approval=None), 0, a.at)
        if a.name in ("jump", "terminate", "reactivate"):
            if not a.admin or run.version < 0 or a.name == "reactivate" and run.state == "running":
                return None
            if a.name == "terminate":
                ended = {"finished": "approved", "canceled": "rejected"}.get(a.arg)
                return ended and replace(run, state=a.arg, node=None, waiting=(), approval=ended, due=None)
            i = self._place(run, a.arg)
            return None if i is None else self.enter(run, i, a.at)
        if run.state != "running":
            return None
        mine = a.actor in run.waiting
        i = self._place(run, run.node)
        if a.name in ("approve", "reject", "forward"):
            if i is None or a.actor is not None and not mine:
                return None
            n = self._nodes(run)[i]
            if a.name == "forward":
                return replace(run, waiting=tuple(dict.fromkeys(x for w in run.waiting for x in ([a.arg] if w == a.actor else [w])))) if a.arg and mine else None
            if a.name == "reject":
                return self.back(run, n.on_reject, a.at)
            left = tuple(w for w in run.waiting if w != a.actor)
            return replace(run, waiting=left) if n.mode == "all" and left else self.enter(run, i + 1, a.at)
        if a.name in ("withdraw", "cancel"):
            if a.actor is not None and a.actor != run.originator and not mine:
                return None
            if a.name == "cancel":
                return replace(run, state="canceled", node=None, waiting=(), approval="rejected", due=None)
            return self.back(run, self._nodes(run)[i].on_withdraw if i is not None else None, a.at)
        return None


RUNS = "state string, node string, waiting string, told string, originator string, approval string, definition string, due_at double, accepted long, refused long"
STEPS = "id long, action string, actor string, accepted boolean, from_node string, to_node string, state string"


def _ordered(log: DataFrame) -> DataFrame:
    """A log's actions, each key's in order of (ts, id) within one task."""
    timed = log.select("key", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "id", "action", "actor", "arg", F.coalesce("admin", F.lit(False)).alias("admin"))
    return timed.repartition("key").sortWithinPartitions("key", "t", "id")


def _names(fields: str) -> list[str]:
    return ["key", *(f.split()[0] for f in fields.split(", "))]


def _played(flow: Flow, batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Batch by batch, each action as (key, row, run before timers, run before it, run after it, accepted)."""
    key, run = None, None
    for rows in batches:
        out = []
        for row in rows.itertuples(index=False):
            if run is None or row.key != key:
                key, run = row.key, Run()
            before = run
            fired = flow.fired(run, row.t)
            after = flow.act(fired, Action(row.action, row.actor, row.t, row.arg, bool(row.admin)))
            run = fired if after is None else after
            out.append((key, row, before, fired, run, after is not None))
        yield out


def runs(log: DataFrame, versions: tuple[Version, ...], until: float | None = None) -> DataFrame:
    """(key, state, node, ...) of each key's actions (key, ts, id, action, actor, arg, admin) in order of (ts, id).

    Keys run in parallel; a key's actions stream through a task in sorted batches, with its run as the
    only state. ``until``: timers due by then still fire after the last action.
    """
    flow = Flow(versions)

    def row(key, run: Run, ok: int, no: int) -> tuple:
        if until is not None:
            run = flow.fired(run, until)
        return (key, run.state, run.node, ",".join(run.waiting), ",".join(run.told), run.originator, run.approval, flow.versions[run.version].hash if run.version >= 0 else None, run.due, ok, no)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # key, run, accepted, refused
        for played in _played(flow, batches):
            done = []
            for key, _, _, _, run, accepted in played:
                if last and last[0] != key:
                    done.append(row(*last))
                    last = None
                ok, no = last[2:] if last else (0, 0)
                last = (key, run, ok + accepted, no + (not accepted))
            yield pd.DataFrame(done, columns=_names(RUNS))
        if last:
            yield pd.DataFrame([row(*last)], columns=_names(RUNS))

    return _ordered(log).mapInPandas(fold, f"key {dict(log.dtypes)['key']}, {RUNS}")


def steps(log: DataFrame, versions: tuple[Version, ...]) -> DataFrame:
    """(key, id, action, actor, accepted, from_node, to_node, state): every action and, without id and actor, every timer that fired before one."""
    flow = Flow(versions)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for played in _played(flow, batches):
            done = []
            for key, row, before, fired, run, accepted in played:
                if fired is not before:
                    done.append((key, None, "timeout", None, True, before.node, fired.node, fired.state))
                done.append((key, row.id, row.action, row.actor, accepted, fired.node, run.node, run.state))
            yield pd.DataFrame(done, columns=_names(STEPS)).astype({"id": "Int64"})

    return _ordered(log).mapInPandas(fold, f"key {dict(log.dtypes)['key']}, {STEPS}")


def after_steps(found: DataFrame, on_exit: Hook | None = None, on_enter: Hook | None = None, after: Hook | None = None, on_timeout: Hook | None = None) -> list[str]:
    """Hands the accepted :func:`steps` to the hooks that follow a transition: those that left a node, that came to one, all, and timers. Failures become warnings."""
    done, moved = found.where("accepted"), ~F.col("from_node").eqNullSafe(F.col("to_node"))
    sets = [(on_exit, done.where(moved & F.col("from_node").isNotNull())), (on_enter, done.where(moved & F.col("to_node").isNotNull())), (after, done), (on_timeout, done.where("action = 'timeout'"))]
    warnings = []
    for hook, rows in sets:
        if hook is not None:
            warnings += Hooks(after=[hook]).write(rows, lambda _: None)
    return warnings


def armed(found: DataFrame) -> DataFrame:
    """(key, node, due_at) of the timers that wait, of :func:`runs`; those of a node that was left are gone."""
    return found.where("state = 'running' and due_at is not null").select("key", "node", F.timestamp_micros((F.col("due_at") * 1_000_000).cast("long")).alias("due_at"))
