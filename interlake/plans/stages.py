"""The message pipeline as stages over stored tables: what a stage makes is written once and read by all that come after it.

A run goes through the stages in order, stops at the first that fails, and can start from any of them, or leave kinds of them out; what was left out is read
from an earlier run. Counts are taken by Observation in the pass that writes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from interlake.operators import features as f
from interlake.operators import mail as m
from interlake.operators import priority as p
from interlake.operators import rules as r
from interlake.plans.mailbox import messages, shared_vectors
from interlake.storage import exists, file_system, new_folder

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Stage:
    """make(table, spark, sf_dir) gives the stage's rows; table(name) reads what an earlier stage stored. counts: figures taken while it is written, as SQL aggregates."""

    name: str
    make: Callable[[Tables, SparkSession, str], DataFrame]
    counts: dict[str, str] = field(default_factory=dict)
    kind: str = "local"  # "embedding" and "model" stages can be left out


@dataclass
class StageResult:
    """How a stage went."""

    success: bool
    records_processed: int
    duration_seconds: float
    message: str
    metadata: dict | None = None

    def __str__(self) -> str:
        return f"{'SUCCESS' if self.success else 'FAILED'}: {self.message} ({self.records_processed:,} records in {self.duration_seconds:.1f}s)"


@dataclass
class Run:
    """How a run went: the names of stages completed, skipped and failed, and each one's result."""

    success: bool = True
    completed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    results: dict[str, StageResult] = field(default_factory=dict)
    error: str | None = None


def _services(table: Tables, spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.with_service(table("mail").filter("NOT is_sent")).select("id", "is_service", "service_confidence", "service_type", "service_importance")


def _embeddings(table: Tables, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec_id, cluster): which vector a message has. The vectors, which messages share, stay in the table that holds them."""
    uses, held = shared_vectors(spark, sf_dir)
    return uses.join(held.select("vec_id", "cluster"), "vec_id")


def _scores(table: Tables, spark: SparkSession, sf_dir: str) -> DataFrame:
    held = shared_vectors(spark, sf_dir)[1]
    return p.priority_scores(table("mail"), table("relationships").join(table("services"), "id"), table("actions"), held, table("embeddings"))


#: In order; each reads the tables of those before it.
STAGES = [
    Stage("mail", lambda table, spark, sf_dir: messages(spark, sf_dir, whole=True, facts=True), {"sent": "count_if(is_sent)", "with_body": "count_if(body_length > 0)"}),
    Stage("threads", lambda table, spark, sf_dir: m.thread_stats(table("mail")), {"messages": "sum(email_count)"}),
    Stage("actions", lambda table, spark, sf_dir: m.action_label(table("mail")), {a.lower(): f"count_if(action = '{a}')" for a in ("REPLIED", "ARCHIVED", "IGNORED", "PENDING")}),
    Stage("relationships", lambda table, spark, sf_dir: m.relationship_features(table("mail")), {"close": "count_if(relationship_strength > 0.5)"}),
    Stage("services", _services, {"services": "count_if(is_service)"}),
    Stage("contacts", lambda table, spark, sf_dir: m.contact_profile(table("mail")), {"important": "count_if(is_important)"}),
    Stage("handleability", lambda table, spark, sf_dir: r.handleability(table("mail"), table("relationships")), {"needs_llm": "count_if(handleability = 'needs_llm')"}),
    Stage("embeddings", _embeddings, {"noise": "count_if(cluster = -1)"}, kind="embedding"),
    Stage("scores", _scores, {"high": "count_if(llm_reason = 'high_priority')"}),
    Stage("ranks", lambda table, spark, sf_dir: p.ranked(table("scores")).select("id", "priority_score", "priority_rank"), {"last": "max(priority_rank)"}),
    Stage("features", lambda table, spark, sf_dir: f.email_features(table("mail")), {"attached": "count_if(has_attachments)"}),
]


class Pipeline:
    """Stages over a folder that all executors see."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, stages: list[Stage] | None = None):
        self.spark, self.sf_dir, self.folder, self.stages = spark, sf_dir, folder.rstrip("/"), STAGES if stages is None else stages

    def table(self, name: str) -> DataFrame:
        """What a stage has stored."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run_stage(self, stage: Stage) -> StageResult:
        """Write a stage's table, in place of what it stored before; an error gives a result, not an exception."""
        began = time.perf_counter()
        try:
            seen = Observation()
            rows = stage.make(self.table, self.spark, self.sf_dir)
            rows = rows.observe(seen, F.count(F.lit(1)).alias("records"), *[F.expr(sql).alias(name) for name, sql in stage.counts.items()])
            rows.write.mode("overwrite").parquet(f"{self.folder}/{stage.name}")
            counts = dict(seen.get)
            return StageResult(True, counts.pop("records"), time.perf_counter() - began, f"stored {stage.name}", counts)
        except Exception as error:  # noqa: BLE001  a stage may fail in any way
            return StageResult(False, 0, time.perf_counter() - began, str(error))

    def run(self, *, start_from: str | None = None, only: set[str] | None = None, leave_out: set[str] = frozenset(), tell: Callable[[str, str, StageResult | None], None] | None = None) -> Run:
        """Go through the stages, from `start_from` on if given, those named in `only` if given, without kinds in `leave_out`; stop at the first that fails.

        A skipped stage keeps the table that it stored before. tell(stage, event, result) hears of starts, ends, skips and failures.
        """
        names = [s.name for s in self.stages]
        if start_from is not None and start_from not in names:
            raise ValueError(f"no stage {start_from}")
        run, tell = Run(), tell or (lambda *_: None)
        for n, stage in enumerate(self.stages):
            if (start_from and n < names.index(start_from)) or stage.kind in leave_out or (only is not None and stage.name not in only):
                run.skipped.append(stage.name)
                tell(stage.name, "skip", None)
                continue
            tell(stage.name, "start", None)
            result = run.results[stage.name] = self.run_stage(stage)
            if not result.success:
                run.success, run.error = False, f"stage {stage.name} failed: {result.message}"
                run.failed.append(stage.name)
                tell(stage.name, "fail", result)
                break
            run.completed.append(stage.name)
            tell(stage.name, "complete", result)
        self._write_report(run)
        return run

    def _write_report(self, run: Run) -> None:
        fs, place = file_system(self.spark, f"{self.folder}/_run.json")
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(asdict(run)).encode()))
        out.close()

    def missing(self) -> list[str]:
        """Stages without a stored table: what a run that starts later would lack."""
        return [s.name for s in self.stages if not exists(self.spark, f"{self.folder}/{s.name}/_SUCCESS")]


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, name, value): all figures that a whole run takes while it writes, records first."""
    run = Pipeline(spark, sf_dir, new_folder(spark, "stages")).run()
    if not run.success:
        raise RuntimeError(run.error)
    rows = [(stage, name, int(value or 0)) for stage, result in run.results.items() for name, value in {"records": result.records_processed, **(result.metadata or {})}.items()]
    return spark.createDataFrame(rows, "stage string, name string, value long")


#: What the ranks need of the stages.
RANKED = {"mail", "actions", "relationships", "services", "embeddings", "scores", "ranks"}


def priority_rank_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks by a run of the stages that they need, and a second run that starts from the stored scores."""
    pipeline = Pipeline(spark, sf_dir, new_folder(spark, "stages"))
    for options in ({"only": RANKED}, {"only": RANKED, "start_from": "ranks"}):
        run = pipeline.run(**options)
        if not run.success:
            raise RuntimeError(run.error)
    return pipeline.table("ranks")
