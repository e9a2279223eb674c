"""Versioned rules and repairs, the review queue and the promotion log.

Four append-only tables; what is current is always derived. The functions at the top work on
any DataFrame of the right shape, the ``Registry`` class binds them to tables under one folder.
A version is a header row (``ord`` -1) followed by one row per rule or repair, so an empty
version exists too. There is no lock service: a writer that finds its version taken by another one
after writing refuses to go on (``version_clashes``), and a clashed version counts for nobody.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecare.operators.gates import GateResult
from tablecare.sources.sinks import empty_where_missing
from tablecare.spec import Fix, Rule, dedupe_rules

VERSION_SCHEMA = (
    "version bigint, ord int, item_id string, kind string, column string, params string, "
    "description string, recorded_at timestamp, actor string"
)
EVENT_SCHEMA = (
    "candidate_id string, run_id string, artifact string, iteration int, source_rule_id string, item_id string, "
    "kind string, column string, params string, description string, passed boolean, note string, "
    "status string, actor string, at timestamp, seq bigint"
)
LOG_SCHEMA = (
    "at timestamp, run_id string, candidate_id string, artifact string, action string, "
    "before_version bigint, after_version bigint, actor string, note string"
)
HEADER = -1
DECIDED = ("approved", "auto_promoted", "rejected")


class RegistryError(ValueError):
    """The registry refuses the change."""


# -- derived views -------------------------------------------------------------------------


def latest_version(versions: DataFrame) -> int:
    """Highest version recorded; 0 where nothing is."""
    return versions.agg(F.max("version")).first()[0] or 0


def version_rows(versions: DataFrame, version: int) -> DataFrame:
    """Items of one version. The constant filter reaches the files."""
    return versions.filter((F.col("version") == version) & (F.col("ord") > HEADER))


def active(versions: DataFrame) -> DataFrame:
    return version_rows(versions, latest_version(versions))


def as_of(versions: DataFrame, version: int | None = None, at: Any = None) -> DataFrame:
    """The suite in force at a version, or at a point in time."""
    known = versions
    if version is not None:
        known = known.filter(F.col("version") <= version)
    if at is not None:
        known = known.filter(F.col("recorded_at") <= F.lit(at))
    return active(known)


def rollback_rows(versions: DataFrame, to_version: int) -> DataFrame:
    """Rows of an earlier version, restated as the next one."""
    following = latest_version(versions) + 1
    return versions.filter(F.col("version") == to_version).withColumn("version", F.lit(following).cast("bigint"))


def suite_diff(versions: DataFrame, older: int, newer: int) -> DataFrame:
    """Items added and removed between two versions.

    One pass: an item meets itself in one count over both versions, combined before the shuffle,
    so a task holds each of its items once.
    """
    both = versions.filter(F.col("version").isin(older, newer) & (F.col("ord") > HEADER))
    items = both.groupBy("item_id", "kind", "column", "params").agg(
        F.max(F.col("version") == older).alias("before"), F.max(F.col("version") == newer).alias("after")
    )
    change = F.when(F.col("after"), F.lit("added")).otherwise(F.lit("removed"))
    return items.filter(F.col("before") != F.col("after")).withColumn("change", change).drop("before", "after")


def latest_status(events: DataFrame, status: str | None = None) -> DataFrame:
    """Last event per candidate.

    The rank filter works per task before the shuffle too, so a candidate with very many events
    sends one of them per task.
    """
    newest = Window.partitionBy("candidate_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    last = events.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= 1).drop("__rank")
    return last if status is None else last.filter(F.col("status") == status)


def undecided(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates without a decision in the log."""
    decided = log.select("candidate_id").distinct()
    return candidates.join(decided, "candidate_id", "left_anti")


def candidates_by_failure(candidates: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Candidates of a run beside the diagnosis of the rule they answer."""
    renamed = diagnoses.withColumnRenamed("rule_id", "source_rule_id")
    return candidates.join(renamed, ["run_id", "source_rule_id"])


def version_clashes(versions: DataFrame) -> DataFrame:
    """Versions that more than one writer recorded, with the header that counts: the earliest, then by actor."""
    headers = versions.filter(F.col("ord") == HEADER).groupBy("version")
    return headers.agg(
        F.count(F.lit(1)).alias("writers"),
        F.min(F.struct("recorded_at", "actor")).alias("first"),
    ).filter(F.col("writers") > 1).select("version", "writers", "first.recorded_at", "first.actor")


def version_sizes(versions: DataFrame) -> DataFrame:
    """Items per version, empty versions included."""
    return versions.groupBy("version").agg(F.count_if(F.col("ord") > HEADER).alias("items"))


def candidate_states(events: DataFrame) -> DataFrame:
    """Candidates per artifact and last status."""
    return latest_status(events).groupBy("artifact", "status").agg(F.count(F.lit(1)).alias("candidates"))


def log_summary(log: DataFrame) -> DataFrame:
    """Decisions per artifact and action, with the first and the last of them."""
    return log.groupBy("artifact", "action").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_distinct("candidate_id").alias("candidates"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


# -- tables --------------------------------------------------------------------------------


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            return empty_where_missing(self.spark, error, schema)

    def _append(self, name: str, schema: str, rows: Sequence[tuple]) -> None:
        if rows:
            frame = self.spark.createDataFrame(list(rows), schema)
            frame.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def versions(self, artifact: str) -> DataFrame:
        if artifact not in ("rule", "fix"):
            raise RegistryError(f"artifact must be 'rule' or 'fix', not '{artifact}'")
        return self._read(f"{artifact}_versions", VERSION_SCHEMA)

    def events(self) -> DataFrame:
        return self._read("candidate_events", EVENT_SCHEMA)

    def log(self) -> DataFrame:
        return self._read("promotion_log", LOG_SCHEMA)

    def version(self, artifact: str) -> int:
        return latest_version(self.versions(artifact))

    def _append_versions(self, artifact: str, rows: Sequence[tuple]) -> None:
        """Write new versions, then look whether another writer has recorded one of them as well."""
        self._append(f"{artifact}_versions", VERSION_SCHEMA, rows)
        mine = sorted({row[0] for row in rows})
        if mine:
            clashes = version_clashes(self.versions(artifact).filter(F.col("version").isin(mine))).collect()
            if clashes:
                raise RegistryError(f"another writer recorded {artifact} versions {sorted(r['version'] for r in clashes)}")

    def active_rules(self) -> list[Rule]:
        rows = active(self.versions("rule")).orderBy("ord").collect()
        return [Rule.load(r["kind"], r["column"], r["params"]) for r in rows]

    def active_fixes(self) -> list[Fix]:
        rows = active(self.versions("fix")).orderBy("ord").collect()
        return [Fix.load(r["kind"], r["column"], r["params"], r["description"]) for r in rows]

    def _version_rows(self, version: int, items: Sequence[Rule] | Sequence[Fix], actor: str) -> list[tuple]:
        at = _now()
        rows = [(version, HEADER, None, None, None, None, None, at, actor)]
        for i, item in enumerate(items):
            if isinstance(item, Rule):
                rows.append((version, i, item.rule_id, item.kind, item.column, item.params_json, None, at, actor))
            else:
                rows.append(
                    (version, i, item.fix_id, item.action, item.column or "", item.params_json,
                     item.description, at, actor)
                )
        return rows

    def seed(self, rules: Sequence[Rule], actor: str = "system:calibration") -> int:
        """First version of the suite. Refused once there is one."""
        if self.version("rule") != 0:
            raise RegistryError("the suite is calibrated already")
        self._append_versions("rule", self._version_rows(1, dedupe_rules(rules), actor))
        return 1

    # -- review queue ----------------------------------------------------------------------

    def add_candidates(
        self,
        run_id: str,
        iteration: int,
        items: Sequence[tuple[Rule | Fix, str, bool, str]],
    ) -> list[str]:
        """Record (item, source rule id, gates passed, note) as pending; returns their ids."""
        rows, ids = [], []
        for item, source_rule_id, passed, note in items:
            candidate_id = str(uuid.uuid4())
            ids.append(candidate_id)
            is_rule = isinstance(item, Rule)
            rows.append(
                (
                    candidate_id,
                    run_id,
                    "rule" if is_rule else "fix",
                    iteration,
                    source_rule_id,
                    item.rule_id if is_rule else item.fix_id,
                    item.kind if is_rule else item.action,
                    item.column or "",
                    item.params_json,
                    None if is_rule else item.description,
                    passed,
                    note,
                    "pending",
                    "system",
                    _now(),
                    time.time_ns(),
                )
            )
        self._append("candidate_events", EVENT_SCHEMA, rows)
        return ids

    def add_gate_results(self, run_id: str, iteration: int, results: Sequence[GateResult]) -> list[str]:
        return self.add_candidates(run_id, iteration, [(r.fix, r.rule.rule_id, r.passed, r.note) for r in results])

    def candidates(self, status: str | None = "pending") -> DataFrame:
        return latest_status(self.events(), status)

    def _candidates(self, ids: Sequence[str]) -> list[dict]:
        rows = latest_status(self.events().filter(F.col("candidate_id").isin(list(ids)))).collect()
        by_id = {r["candidate_id"]: r.asDict() for r in rows}
        missing = [i for i in ids if i not in by_id]
        if missing:
            raise RegistryError(f"no candidates {missing}")
        return [by_id[i] for i in ids]

    def promote(self, ids: str | Sequence[str], actor: str, force: bool = False) -> list[str]:
        """Accept candidates: new version per item, event and log entry. Repeating it changes nothing."""
        ids = [ids] if isinstance(ids, str) else list(dict.fromkeys(ids))
        status = "auto_promoted" if actor.startswith("system:") else "approved"
        versions: dict[str, int] = {}
        items: dict[str, list] = {}
        new_rows: dict[str, list[tuple]] = {"rule": [], "fix": []}
        events, log, statuses = [], [], []
        for candidate in self._candidates(ids):
            if candidate["status"] in ("approved", "auto_promoted"):
                statuses.append(candidate["status"])
                continue
            if candidate["status"] == "rejected":
                raise RegistryError(f"candidate {candidate['candidate_id']} was rejected")
            if not candidate["passed"] and not force:
                raise RegistryError(f"candidate {candidate['candidate_id']} did not pass its gates")
            artifact = candidate["artifact"]
            if artifact not in items:
                versions[artifact] = self.version(artifact)
                items[artifact] = list(self.active_rules() if artifact == "rule" else self.active_fixes())
            if artifact == "rule":
                item = Rule.load(candidate["kind"], candidate["column"], candidate["params"])
            else:
                item = Fix.load(candidate["kind"], candidate["column"], candidate["params"], candidate["description"])
            before = versions[artifact]
            # An item that is in force already is not listed twice.
            if item not in items[artifact]:
                items[artifact].append(item)
                versions[artifact] += 1
                new_rows[artifact] += self._version_rows(versions[artifact], items[artifact], actor)
            at = _now()
            events.append(self._event(candidate, status, actor, at))
            log.append(
                (at, candidate["run_id"], candidate["candidate_id"], artifact, status, before,
                 versions[artifact], actor, candidate["note"])
            )
            statuses.append(status)
        for artifact, rows in new_rows.items():
            self._append_versions(artifact, rows)
        self._append("candidate_events", EVENT_SCHEMA, events)
        self._append("promotion_log", LOG_SCHEMA, log)
        return statuses

    @staticmethod
    def _event(candidate: dict, status: str, actor: str, at: datetime) -> tuple:
        changed = {**candidate, "status": status, "actor": actor, "at": at, "seq": time.time_ns()}
        return tuple(changed[part.split()[0]] for part in EVENT_SCHEMA.split(", "))

    def reject(self, candidate_id: str, actor: str, reason: str | None = None) -> str:
        """Turn a candidate down. Repeating it changes nothing; an accepted one cannot be rejected."""
        candidate = self._candidates([candidate_id])[0]
        if candidate["status"] == "rejected":
            return "rejected"
        if candidate["status"] in DECIDED:
            raise RegistryError(f"candidate {candidate_id} is {candidate['status']} already")
        at, artifact = _now(), candidate["artifact"]
        version = self.version(artifact)
        self._append("candidate_events", EVENT_SCHEMA, [self._event(candidate, "rejected", actor, at)])
        self._append(
            "promotion_log",
            LOG_SCHEMA,
            [(at, candidate["run_id"], candidate_id, artifact, "rejected", version, version, actor,
              reason or "no reason given")],
        )
        return "rejected"

    def rollback(self, artifact: str, to_version: int, actor: str) -> int:
        """Put an earlier version in force again, as a new version."""
        versions = self.versions(artifact)
        current = latest_version(versions)
        if not 0 <= to_version < current:
            raise RegistryError(f"no version {to_version} before the current {current}")
        if to_version == 0:
            rows = self._version_rows(current + 1, [], actor)
        else:
            at = _now()
            names = [part.split()[0] for part in VERSION_SCHEMA.split(", ")]
            restored = rollback_rows(versions, to_version).orderBy("ord").collect()
            rows = [tuple({**r.asDict(), "recorded_at": at, "actor": actor}[n] for n in names) for r in restored]
            if not rows:
                raise RegistryError(f"version {to_version} is not recorded")
        self._append_versions(artifact, rows)
        self._append(
            "promotion_log",
            LOG_SCHEMA,
            [(_now(), "manual-rollback", "n/a", artifact, "rolled_back", current, current + 1, actor,
              f"version {to_version} restored")],
        )
        return current + 1
