"""User code around reads and writes, and policies that decide on a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ModelError


def on_load(df: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``df`` as the hook rewrites it, batch by batch; it returns as many rows as it gets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = hook(rows)
            if len(out) != len(rows):
                raise ValueError(f"script.onload.length: {len(rows)} rows became {len(out)}")
            yield out

    return df.mapInPandas(run, df.schema)


@dataclass
class Hooks:
    """``before``: may refuse by raising, or return other changes. ``after``: failures become warnings."""

    before: list[Callable[[DataFrame], DataFrame | None]] = field(default_factory=list)
    after: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def write(self, changes: DataFrame, commit: Callable[[DataFrame], None]) -> list[str]:
        """Runs a write; returns the warnings."""
        for hook in self.before:
            changes = hook(changes) or changes
        commit(changes)
        warnings = []
        for hook in self.after:
            try:
                hook(changes)
            except Exception as e:  # noqa: BLE001  user code
                warnings.append(f"{type(e).__name__}: {e}")
        return warnings


@dataclass(frozen=True)
class Decision:
    """allow, deny or requireApproval, and constants that mask result fields."""

    kind: str = "allow"
    reason: str = ""
    masks: dict = field(default_factory=dict, hash=False)


def decide(policies: list[Callable[[dict], Decision | None]], context: dict) -> Decision:
    """The first deny or requireApproval in order; a policy that fails denies; masks of the others merge, later ones winning."""
    masks: dict = {}
    for policy in policies:
        try:
            d = policy(context) or Decision()
        except Exception as e:  # noqa: BLE001  user code
            return Decision("deny", str(e))
        if d.kind != "allow":
            return d
        masks |= d.masks
    return Decision(masks=masks)


def masked(df: DataFrame, decision: Decision) -> DataFrame:
    if decision.kind != "allow":
        raise ModelError(f"policy.{decision.kind}", decision.reason)
    return df.withColumns({k: F.lit(v) for k, v in decision.masks.items() if k in df.columns})


def next_status(request: dict | None, now: float) -> str:
    """What a call that needs approval may do: run (an approved request, used once), wait, or be denied; None asks anew."""
    if request is None:
        return "enqueue"
    if request["expires_at"] <= now or request["status"] in ("rejected", "consumed", "expired"):
        return "deny"
    return {"approved": "consume", "pending": "wait"}[request["status"]]
