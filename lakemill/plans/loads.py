"""Load types: what a load reads of its source, and one load from reading to its control row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.cleaning import dedup_latest
from lakemill.plans.dag import LoadType
from lakemill.sources.lake import INSERT, UPDATE, LakeTable
from lakemill.sources.tables import Progress, VersionControl


class UnknownLoad(ValueError):
    """The load type isn't known, or a targeted load names no keys: the run must stop."""


class NothingNew(RuntimeError):
    """The source has no version that the target hasn't seen: the run ends well, with nothing done."""


@dataclass(frozen=True)
class Plan:
    """What to read (``rows``), the source version that the target will have seen, and whether the target begins anew."""

    load_type: LoadType
    rows: DataFrame
    version: int
    since: int
    replaces: bool

    @property
    def whole(self) -> bool:
        return self.since < 0 and self.load_type is not LoadType.TARGETED


def plan_load(load_type: LoadType | str, source: LakeTable, seen: int, keys: list[str], targets: DataFrame | None = None) -> Plan:
    """The input of a load.

    full and reload read the whole table (full begins the target anew), incremental the changes behind version ``seen`` (each
    key's last inserted or updated row; the whole table if nothing was seen), targeted the rows whose leading key is among
    ``targets``, by a semi join. An unknown type raises UnknownLoad, a source without news NothingNew.
    """
    try:
        kind = LoadType(load_type)
    except ValueError as e:
        raise UnknownLoad(f"load type {load_type!r}") from e
    now = source.version()
    if kind is LoadType.TARGETED:
        if targets is None or targets.isEmpty():
            raise UnknownLoad("a targeted load needs keys")
        rows = source.read(now).join(targets.select(keys[0]).distinct(), keys[0], "left_semi")
        return Plan(kind, rows, now, -1, False)
    if kind is LoadType.INCREMENTAL and seen >= 0:
        if seen >= now:
            raise NothingNew(f"{source.path}: version {now} was seen")
        news = source.changes(seen + 1, now).filter(F.col("_change_type").isin(INSERT, UPDATE))
        rows = dedup_latest(news, keys, [F.desc("_commit_version")]).drop("_change_type", "_commit_version", "_commit_timestamp")
        return Plan(kind, rows, now, seen, False)
    return Plan(kind, source.read(now), now, -1, kind is LoadType.FULL)


def run_load(load_type: LoadType | str, source: LakeTable, target: LakeTable, keys: list[str], hash_column: str, transform: Callable[[DataFrame], DataFrame], progress: Progress, control: VersionControl, run_id: str, targets: DataFrame | None = None) -> dict[str, int]:
    """Plans, transforms and upserts one load; its counts. A load that changed the target leaves a control row.

    The version that was seen is marked only after the commit, so a load that fails is planned again from where it was.
    A targeted load marks nothing, as it reads no more than its keys.
    """
    plan = plan_load(load_type, source, progress.seen(target.path), keys, targets)
    if plan.replaces and target.version() >= 0:
        target.truncate()
    before = target.version()
    done = target.upsert(transform(plan.rows), keys, hash_column)
    if target.version() != before:
        control.insert(target, run_id, plan.version, {"load_type": plan.load_type.value, "since": plan.since, "planned": time.time()})
    if plan.load_type is not LoadType.TARGETED:
        progress.mark(target.path, plan.version, run_id)
    return done


def describe(plan: Plan) -> str:
    """A line for logs: what is read and why."""
    what = "the whole table" if plan.whole else "listed keys" if plan.load_type is LoadType.TARGETED else f"changes behind version {plan.since}"
    return json.dumps({"load_type": plan.load_type.value, "reads": what, "to_version": plan.version, "replaces": plan.replaces})
