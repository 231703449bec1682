"""The engine over one store: sources, scans, parsing, audit, views and backup.

Each command works on a pinned version and publishes its result as the next
one. A scan publishes at each step whose effects are meant to outlast what
follows: that it runs, the ingested entries, the verdict, and the deletions.
Another writer's version in between is a conflict, and the later one stops.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import errors, identity
from .functions.text import extension
from .operators import audit, derive, normalize, scan, views
from .plans.manifest import Snapshot, Store
from .schemas import TABLES
from .sources import blobs as blob_files
from .sources import folder, office

LEASE_SECONDS = 120
WORKER = "office-parser"
#: How often a commit starts again from newer tables before it gives up.
COMMITS = 5


def _as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a stored table; columns it lacks are null."""
    fields = [f.split(" ", 1) for f in TABLES[name].split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


class Engine:
    """``clock`` gives the time in milliseconds and ``new_id`` fresh scan ids; both can be put in place by tests."""

    def __init__(self, spark: SparkSession, root: str, *, clock: Callable[[], int] | None = None, new_id: Callable[[], str] | None = None):
        self.spark, self.root = spark, root
        self.store = Store(spark, root)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.new_id = new_id or (lambda: str(uuid.uuid4()))
        self.work = f"{root}/work"
        self.worker = f"{WORKER}:{uuid.uuid4().hex}"
        self.blob_root = self.store.address("blobs")
        if self.store.latest() == 0:
            self.store.publish(self.store.pin(), {n: spark.createDataFrame([], ddl) for n, ddl in TABLES.items()}, {"scans": [], "roots": {}})

    # --- helpers -----------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        return self.store.pin()

    def _scans(self, s: Snapshot) -> scan.Scans:
        return tuple(scan.Scan(**x) for x in s.control["scans"])

    def _control(self, s: Snapshot, scans: scan.Scans) -> dict:
        return {**s.control, "scans": [asdict(x) for x in scans]}

    def _keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.work}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    @contextmanager
    def _working(self) -> Iterator[None]:
        """A command's own folder for what it keeps on the way, gone when it ends."""
        self.work = f"{self.root}/work/{uuid.uuid4().hex}"
        try:
            yield
        finally:
            self.store.discard(self.work)

    def tables(self, s: Snapshot | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the scans among them."""
        s = s or self.snapshot()
        out = {n: s[n] for n in s}
        rows = [tuple(asdict(x).values()) for x in self._scans(s)]
        names = ", ".join(f"{k} {'string' if k in ('scan_id', 'source_id', 'status', 'previous_completed_scan_id', 'approved_note', 'abort_reason', 'deletion_state') else 'bigint'}" for k in scan.Scan.__dataclass_fields__)
        out["scan_run"] = self.spark.createDataFrame(rows, names)
        return out

    # --- commands ----------------------------------------------------------------------

    def register(self, root: str, name: str | None = None) -> str:
        s = self.snapshot()
        source_id, sources = folder.register_source(s["source"], root, name, self.root)
        if source_id not in s.control["roots"]:
            self.store.publish(s, {"source": sources}, {**s.control, "roots": {**s.control["roots"], source_id: os.path.realpath(root)}})
        return source_id

    def scan(self, source_id: str, *, items: DataFrame | None = None, review=None, interrupted: str | None = None, repair: bool = False, **thresholds) -> scan.Report:
        """Scans a source: its folder, or ``items`` that are given with outcomes. ``repair`` puts torn blobs right, which else stop the scan."""
        s = self.snapshot()
        root = s.control["roots"].get(source_id)
        if items is None:
            if root is None:
                raise errors.NotFoundError(f"no folder of source {source_id}")
            items = folder.with_outcomes(folder.enumerate_folder(self.spark, root, source_id), root, self.blob_root, repair=repair)
        for column, kind in (("mime_type", "string"),):
            if column not in items.columns:
                items = items.withColumn(column, F.lit(None).cast(kind))
        names = ("source", "document", "document_version", "observation", "rename_candidate")
        current, last = s, {n: s[n] for n in names}
        state = scan.State(**last, scans=self._scans(s))

        def step() -> None:
            nonlocal current
            added = {n: reduce(DataFrame.unionByName, rows) for n, rows in state.added.items()}
            changed = {n: getattr(state, n) for n in names if getattr(state, n) is not last[n] and n not in added}
            current = self.store.publish(current, changed, self._control(current, state.scans), added)
            state.added.clear()
            for n in (*changed, *added):
                last[n] = current[n]
                setattr(state, n, last[n])

        with self._working():
            return scan.run_scan(state, source_id, items, scan_id=self.new_id(), now_ms=self.clock(), keep=self._keep, review=review, interrupted=interrupted, step=step, **thresholds)

    def fail_scan(self, scan_id: str, reason: str) -> None:
        s = self.snapshot()
        self.store.publish(s, {}, self._control(s, scan.fail_scan(self._scans(s), scan_id, reason, self.clock())))

    def _derive(self, candidates: DataFrame, compute: Callable[[DataFrame], DataFrame], kind: str, gate: Callable[..., None] | None = None) -> dict[str, int]:
        """Claims what can be claimed of ``candidates`` and publishes that, computes it, and commits what its leases still cover.

        ``candidates``: the derivation's columns and what ``compute`` needs;
        ``compute`` adds content and error; ``gate`` may refuse the outputs. A
        derivation that comes out otherwise than stored is noted as failed, the
        rest is committed, and the error is raised in the end.
        """
        s = self.snapshot()
        new, runs = derive.claim(candidates, s["processing_run"], s["document_version"], worker_id=self.worker, lease_seconds=LEASE_SECONDS, now_ms=self.clock())
        if new.select("run_id").isEmpty():
            return {"claimed": 0, "succeeded": 0}
        self.store.publish(s, {"processing_run": _as_table(runs, "processing_run")}, s.control)
        with self._working():
            done = self._keep(compute(new))
            for left in reversed(range(COMMITS)):
                try:
                    n, divergent = self._commit(done, kind, gate)
                    break
                except errors.ManifestConflictError:
                    if not left:
                        raise
            derive.assert_no_divergence(divergent)
        return n

    def _commit(self, done: DataFrame, kind: str, gate: Callable[..., None] | None) -> tuple[dict[str, int], DataFrame]:
        s, now = self.snapshot(), self.clock()
        claims = done.select("run_id", F.lit(self.worker).alias("claimed_by"), F.col("derivation_key").alias("claimed_key"))
        checked = self._keep(derive.check_leases(claims, s["processing_run"], now))
        held = done.join(checked.where("mismatch IS NULL").select("run_id"), "run_id", "left_semi")
        good = held.where("content IS NOT NULL")
        at = F.lit(now).cast("bigint").alias("created_at")
        drafts = good.select(
            "derivation_key", "document_id", "root_version_id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(kind).alias("type"), F.col("content").alias("inline_content"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("blob_key", "string"), ("content_hash", "string"), ("size_bytes", "bigint"))], at,
        )
        heads = good.select("derivation_key", "processor_name", "processor_version", "config_hash", "input_ids", "root_version_id", "document_id", at)
        if gate is not None:
            gate(heads.withColumn("artifact_count", F.lit(1).cast("bigint")), derive.draft_artifacts(drafts), s)
        derivations, artifacts, divergent = derive.commit_rows(heads, drafts, s["derivation"])
        divergent = self._keep(divergent)
        other = divergent.select("derivation_key", F.lit(errors.DerivationDivergenceError.code).alias("other"))
        ended = self._keep(held.select("run_id", "derivation_key", "document_id", "attempt", "permanent", "error", F.col("content").isNotNull().alias("fine")).join(other, "derivation_key", "left"))
        ended = ended.withColumns({"fine": F.col("fine") & F.col("other").isNull(), "error": F.coalesce("other", "error")})
        change = ended.select("run_id", F.when(F.col("fine"), "succeeded").otherwise("failed").alias("ended"), F.when(~F.col("fine"), F.coalesce("error", F.lit("unknown"))).alias("why"))
        runs = s["processing_run"].join(change, "run_id", "left").withColumns({
            "status": F.coalesce("ended", "status"), "error_kind": F.coalesce("why", "error_kind"),
            "finished_at": F.when(F.col("ended").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("finished_at")),
        })
        added = {"derivation": self._keep(derivations), "artifact": self._keep(artifacts)}
        told = derive.run_failures(ended.where("NOT fine")).withColumn("slot", F.lit(2))
        told = told.unionByName(derive.divergence_observations(divergent, s["derivation"], ended).withColumn("slot", F.lit(1)))
        told = told.unionByName(derive.stale_worker_observations(checked, "commit").withColumn("slot", F.lit(0)), allowMissingColumns=True)
        told = self._keep(told.withColumn("version_id", F.lit(None).cast("string")))
        n_told = told.count()
        if n_told:
            order = scan.in_hex_order(told.select("run_id").distinct(), "run_id", n_told)
            last = s["observation"].agg(F.coalesce(F.max("observation_seq"), F.lit(0))).first()[0]
            rows = scan.number_observations(told.join(order, "run_id"), last, None, now)
            added["observation"] = rows
        self.store.publish(s, {"processing_run": _as_table(runs, "processing_run")}, s.control, added)
        n = done.agg(F.count(F.lit(1))).first()[0]
        return {"claimed": n, "succeeded": ended.where("fine").count()}, divergent

    def _parsing(self, t: Snapshot, versions: DataFrame) -> DataFrame:
        """``versions`` (document_id, root_version_id, stable_key) with their parse's form and key; both are null if no parser takes them."""
        rows = versions.withColumn("form", extension("stable_key"))
        rows = rows.withColumn("form", F.when(F.col("form").isin("docx", "xlsx"), F.col("form"))).drop("stable_key")
        config = F.when(F.col("form") == "docx", office.parser_config_hash("docx")).otherwise(office.parser_config_hash("xlsx"))
        rows = rows.withColumns({
            "processor_name": F.lit(office.PARSER_NAME), "processor_version": F.lit(office.PARSER_VERSION), "config_hash": config, "input_ids": F.to_json(F.array("root_version_id")),
        })
        key = identity.derivation_key("processor_name", "processor_version", "config_hash", F.array("root_version_id"))
        return rows.withColumn("derivation_key", F.when(F.col("form").isNotNull(), key))

    def _active(self, t: Snapshot) -> DataFrame:
        return t["document"].where("state = 'active' AND active_version_id IS NOT NULL").select("document_id", F.col("active_version_id").alias("root_version_id"), "stable_key")

    def parse_status(self) -> DataFrame:
        """(document_id, version_id, form, status) of every active version: ready, waiting, failed, not_parsed, or unsupported."""
        t = self.snapshot()
        rows = self._parsing(t, self._active(t)).select("document_id", F.col("root_version_id").alias("version_id"), "form", "derivation_key")
        return derive.derivation_status(rows, t["derivation"], t["processing_run"]).drop("derivation_key")

    def parse(self, *, isolated: bool = False) -> dict[str, int]:
        """Parses every active Word and Excel version that isn't parsed yet. Failures can be tried again."""
        t = self.snapshot()
        rows = self._parsing(t, self._active(t)).where("form IS NOT NULL")

        def compute(new: DataFrame) -> DataFrame:
            hashes = t["document_version"].select(F.col("version_id").alias("root_version_id"), "blob_key", "content_hash")
            # blobs are read by key where their rows are, so the store's other blobs cost nothing
            data = blob_files.blob_column(self.blob_root, F.col("blob_key"), F.col("content_hash"))
            r = new.join(hashes, "root_version_id").withColumn("r", office.parsed_column(data, F.col("form"), isolated=isolated))
            return r.withColumns({"content": F.col("r.content"), "error": F.col("r.error")}).drop("r", "blob_key", "content_hash")

        return self._derive(rows, compute, "parsed_document")

    def normalize(self) -> dict[str, int]:
        """Normalises every parsed document that isn't normalised yet."""
        t = self.snapshot()
        parsed = t["artifact"].where("type = 'parsed_document'").select(F.col("artifact_id").alias("parent"), "document_id", "root_version_id", F.col("inline_content").alias("parsed"))
        rows = parsed.withColumns({
            "processor_name": F.lit(normalize.NORMALIZER_NAME), "processor_version": F.lit(normalize.NORMALIZER_VERSION), "config_hash": F.lit(normalize.config_hash()), "input_ids": F.to_json(F.array("parent")),
        })
        rows = rows.withColumn("derivation_key", identity.derivation_key("processor_name", "processor_version", "config_hash", F.array("parent")))

        def compute(new: DataFrame) -> DataFrame:
            r = new.withColumn("r", normalize.normalized_column(F.col("parsed")))
            return r.withColumns({"content": F.col("r.content"), "error": F.col("r.error")}).drop("r", "parsed", "parent")

        return self._derive(rows, compute, "normalized_document", gate=normalize.check_commit)

    def audit(self, **context) -> list[audit.Result]:
        return audit.check_invariants(self.tables(), **context)

    def backup(self, to: str) -> None:
        files = blob_files.stored_blobs(self.spark, self.blob_root) if self.store.has(self.blob_root) else None
        self.store.backup(to, files)

    # --- views -------------------------------------------------------------------------

    def content(self, version_id: str, kind: str = "parsed_document", artifact_id: str | None = None) -> list[str]:
        """The stored results of a version, the latest first, or the one that is named; refused if their evidence doesn't add up."""
        s = self.snapshot()
        mine = (F.col("root_version_id") == version_id) & (F.col("type") == kind)
        mine = mine if artifact_id is None else mine & (F.col("artifact_id") == artifact_id)
        keys = s["artifact"].where(mine).select("derivation_key").distinct()
        near = {n: s[n].join(keys, "derivation_key", "left_semi") for n in ("artifact", "derivation", "processing_run")}
        near["document_version"] = s["document_version"].where(F.col("version_id") == version_id)
        most = office.LIMITS["outputBytes"] if kind == "parsed_document" else normalize.MOST_BYTES
        found = derive.artifact_evidence(near, kind, most)
        checked = F.when(F.col("problem").isNull(), F.col("inline_content")).otherwise(F.raise_error(F.concat(F.lit("the stored result's evidence doesn't add up: "), "problem")))
        return [r[0] for r in found.orderBy(F.desc("created_at"), "artifact_id").limit(views.CANDIDATES).select(checked).collect()]

    def original(self, version_id: str) -> tuple[bytes, str]:
        """(bytes, file name) of a version as it was read, checked against its hash and size."""
        s = self.snapshot()
        v = s["document_version"].where(F.col("version_id") == version_id).join(s["document"].select("document_id", "stable_key"), "document_id").first()
        if v is None:
            raise errors.NotFoundError(f"no version {version_id}")
        if v["size_bytes"] > office.LIMITS["inputBytes"]:
            raise ValueError("the file is beyond the limit of what is shown")
        data = blob_files.BlobStore(self.blob_root).get(v["blob_key"], v["content_hash"])
        if len(data) != v["size_bytes"]:
            raise errors.SizeMismatchError(declared=v["size_bytes"], actual=len(data))
        return data, v["stable_key"].split("/")[-1]

    def diagnostics(self) -> dict:
        """The state as one small object: counts, sources, recent scans and what needs attention."""
        t = self.tables()
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return {"version": self.store.latest(), "counts": rows(views.state_counts(t))[0], "attention": rows(views.attention_count(t))[0], "sources": rows(views.source_overview(t)), "scans": rows(views.recent_scans(t))}

    def search(self, query: str, **page) -> DataFrame:
        return views.search_documents(self.snapshot(), query, **page)

    def state(self) -> DataFrame:
        return views.state_counts(self.tables())

    def skip_scan_rows(self, scan_id: str) -> DataFrame:
        return views.skipped_summary(self.snapshot(), scan_id)


