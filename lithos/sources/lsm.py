"""Log-structured storage: immutable sorted runs of archetypes, a manifest of
levels, and compaction in which the newest run wins for each entity."""

from __future__ import annotations

import functools
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.sources import storage
from lithos.world import ID, World

#: Runs of a level and archetype that make a compaction due; levels.
FANOUT, LEVELS = 4, 4


@dataclass(frozen=True)
class Run:
    folder: str
    archetype: str
    level: int
    seq_lo: int
    seq_hi: int


@dataclass(frozen=True)
class CompactionReport:
    input_run_count: int
    output_path: str
    output_bytes: int


def newest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order``: one partially aggregated
    pass, whatever the number of versions."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.select(*keys, *[F.col("_l")[c].alias(c) for c in rest])


class LsmStore:
    """Runs under one folder; the manifest is a list of JSON lines that is
    replaced by a rename, so a commit shows whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = f"{path}/manifest.jsonl"
        text = storage.read_text(spark, at) if storage.settled(spark, at) else ""
        self.runs: list[Run] = []
        for line in text.splitlines():
            try:
                self.runs.append(Run(**json.loads(line)))
            except (ValueError, TypeError):
                break  # a torn tail

    def _commit(self, runs: list[Run]) -> None:
        storage.write_text(self.spark, f"{self.path}/manifest.tmp", "".join(json.dumps(asdict(r)) + "\n" for r in runs))
        storage.replace(self.spark, f"{self.path}/manifest.tmp", f"{self.path}/manifest.jsonl")
        self.runs = runs

    def flush(self, world: World, since: int) -> list[Run]:
        """A run for each archetype written after ``since``; none if clean."""
        new = []
        for a in world.archetypes.values():
            if a.ticks and max(a.ticks.values()) > since:
                new.append(self.add_run(a.name, a.frame, since + 1, world.tick))
        return new

    def add_run(self, archetype: str, frame: DataFrame, seq_lo: int, seq_hi: int, level: int = 0) -> Run:
        number = 1 + max((int(r.folder.rsplit("-", 1)[1].removesuffix(".run")) for r in self.runs), default=0)
        folder = f"{seq_lo}-{seq_hi}-{number}.run"
        self._write(frame, folder)
        run = Run(folder, archetype, level, seq_lo, seq_hi)
        self._commit([*self.runs, run])
        return run

    def _write(self, frame: DataFrame, folder: str) -> None:
        tmp = f"{self.path}/{folder}.tmp"
        sorted_ = frame.repartitionByRange(ID).sortWithinPartitions(ID)
        sorted_.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{ID}", "true").parquet(tmp)
        storage.replace(self.spark, tmp, f"{self.path}/{folder}")

    def read(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{run.folder}")

    def scan(self, archetype: str) -> DataFrame:
        """Current rows of an archetype, over all its runs."""
        return self._merged([r for r in self.runs if r.archetype == archetype])

    def get(self, archetype: str, entity: int) -> DataFrame:
        """One entity: row groups are skipped by statistics and bloom filters."""
        runs = [r for r in self.runs if r.archetype == archetype]
        return self._merged(runs, F.col(ID) == entity)

    def _merged(self, runs: list[Run], where=None) -> DataFrame:
        parts = [(self.read(r) if where is None else self.read(r).where(where)).withColumns({"_hi": F.lit(r.seq_hi), "_lo": F.lit(r.seq_lo), "_level": F.lit(-r.level)}) for r in runs]
        rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return newest_wins(rows, [ID], ["_hi", "_level", "_lo"]).drop("_hi", "_lo", "_level")

    def find_candidate(self) -> tuple[int, str] | None:
        """First level and archetype with enough runs; the last level rests."""
        for level in range(LEVELS - 1):
            for name in sorted({r.archetype for r in self.runs if r.level == level}):
                if sum(r.level == level and r.archetype == name for r in self.runs) >= FANOUT:
                    return level, name
        return None

    def compact_one(self) -> CompactionReport | None:
        found = self.find_candidate()
        if found is None:
            return None
        level, name = found
        old = [r for r in self.runs if r.level == level and r.archetype == name]
        number = 1 + max(int(r.folder.rsplit("-", 1)[1].removesuffix(".run")) for r in self.runs)
        lo, hi = min(r.seq_lo for r in old), max(r.seq_hi for r in old)
        folder = f"{lo}-{hi}-{number}.run"
        self._write(self._merged(old), folder)
        self._commit([r for r in self.runs if r not in old] + [Run(folder, name, level + 1, lo, hi)])
        return CompactionReport(len(old), f"{self.path}/{folder}", storage.size(self.spark, f"{self.path}/{folder}"))

    def cleanup_orphans(self) -> list[str]:
        """Delete runs that the manifest doesn't list, and all unfinished ones."""
        known = {r.folder for r in self.runs}
        gone = [n for n in storage.listing(self.spark, self.path) if n.endswith(".run.tmp") or (n.endswith(".run") and n not in known)]
        for n in gone:
            storage.delete(self.spark, f"{self.path}/{n}")
        return gone
