"""Chains of stages: order, waiting, resuming and settings (ORC1-ORC9).

A stage is a function from the tables it needs to a table; its result is written to
the shared folder under a name that holds the digest of its settings and of what it
was made from, so a chain that starts again skips what is done and nothing stale is
used.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


from hedgerow.operators.contracts import ContractError
from hedgerow.operators.training import exists


@dataclass
class Stage:
    name: str
    make: Callable[..., DataFrame]
    needs: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    version: int = 1


def ordered(stages: list[Stage], given: set[str]) -> list[Stage]:
    """Stages so that each comes after what it needs; listed order where there is a choice (ORC3)."""
    known, left, out = set(given), list(stages), []
    while left:
        ready = next((s for s in left if set(s.needs) <= known), None)
        if ready is None:
            raise ContractError(f"stages need each other or something unknown: {[s.name for s in left]}")
        left.remove(ready)
        known.add(ready.name)
        out.append(ready)
    return out


def run(spark: SparkSession, stages: list[Stage], inputs: dict[str, DataFrame], folder: str, digests: dict[str, str], start_at: str | None = None, until: str | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Run a chain: (tables by name, names of the stages that were made now) (ORC1, ORC2, ORC4, ORC5, ORC7).

    ``digests`` says what each input is. A stage whose settings, version and sources
    are those of a written result is read instead. ``start_at`` demands that all
    earlier stages are there already.
    """
    line = ordered(stages, set(inputs))
    names = [s.name for s in line]
    for wanted in (start_at, until):
        if wanted is not None and wanted not in names:
            raise ValueError(f"no stage {wanted}")
    tables, marks, made = dict(inputs), dict(digests), []
    for s in line:
        marks[s.name] = hashlib.sha256(json.dumps([s.name, s.version, s.settings, [marks[n] for n in s.needs]], sort_keys=True).encode()).hexdigest()[:16]
        path = f"{folder}/{s.name}-{marks[s.name]}"
        if not exists(spark, f"{path}/_SUCCESS"):
            if start_at is not None and names.index(s.name) < names.index(start_at):
                raise ContractError(f"the chain starts at {start_at}, but {s.name} is not there")
            s.make(*[tables[n] for n in s.needs], **s.settings).write.mode("overwrite").parquet(path)
            made.append(s.name)
        tables[s.name] = spark.read.parquet(path)
        if s.name == until:
            break
    return tables, made


def wait_for(status: Callable[[], DataFrame], timeout: float, every: float = 5.0) -> None:
    """Wait until all rows of a status table are complete (ORC1); a failed row or the end of time is an error."""
    end = time.monotonic() + timeout
    while True:
        left = {r["status"] for r in status().select("status").distinct().collect()} - {"complete"}
        if "failed" in left:
            raise ContractError("a shard has failed")
        if not left:
            return
        if time.monotonic() > end:
            raise TimeoutError(f"still {sorted(left)}")
        time.sleep(every)


def setting(*candidates: object, default: object = None) -> object:
    """The first that is given: command line, configuration, default (ORC6)."""
    return next((c for c in candidates if c is not None), default)


def shard_plan(stages: list[str], cli: dict[str, int], config: dict[str, int], default: int = 1) -> list[tuple[str, int, int]]:
    """(stage, shard, shards) of all lanes (ORC6)."""
    return [(s, i, n) for s in stages for n in [setting(cli.get(s), config.get(s), default=default)] for i in range(n)]


@dataclass(frozen=True)
class Cohort:
    """Where a cohort's tables are, and whose heads score it (ORC8)."""

    backend: str
    language: str
    kind: str

    @property
    def name(self) -> str:
        return f"{self.backend}_{self.language}_{self.kind}"


def cohort_registry(backends: list[str], external: dict[str, list[str]], controlled: str = "de") -> dict[str, Cohort]:
    """Every backend's controlled cohort, and the external ones by language and kind (ORC8)."""
    found = [Cohort(b, controlled, "controlled") for b in backends] + [Cohort(b, lang, kind) for b in backends for lang, kinds in external.items() for kind in kinds]
    return {c.name: c for c in found}


def optional_scores(spark: SparkSession, enabled: bool, path: str, schema: str) -> DataFrame:
    """Scores of an optional estimator: no rows where it is off, an error where its file is missing (ORC9)."""
    if not enabled:
        return spark.createDataFrame([], schema)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path)


