"""A scan of a set of files by any of the engines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.functions.languages import language_of
from lynceus.functions.severity import RANK, parse_level
from lynceus.functions.text import extension
from lynceus.operators.advisories import affected, sca_findings
from lynceus.operators.findings import append_engines, to_findings
from lynceus.operators.manifests import extract_dependencies
from lynceus.operators.matching import match, with_entropy, without_tests
from lynceus.operators.rule_tables import match_table
from lynceus.operators.vulnerabilities import enrich_titles
from lynceus.rules.catalog import DEFAULT
from lynceus.rules.model import AI_CODE, ENGINES, SAST, SCA, SECRETS, Catalog, parse_engines


def as_files(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any (path, code[, language]) rows in the ``FILES`` schema, with further columns to keep."""
    declared = F.col("language") if "language" in rows.columns else F.lit(None).cast("string")
    ext = extension(F.col("path"))
    return rows.select(*keep, "path", "code", language_of(declared, ext).alias("language"), ext.alias("ext"))


def scan(
    files: DataFrame,
    engines: Sequence[str] = ENGINES,
    min_severity: str = "low",
    catalog: Catalog = DEFAULT,
    advisories: DataFrame | None = None,
    vulnerabilities: DataFrame | None = None,
    entropy: bool = False,
    skip_tests: bool = False,
    by_content: bool = True,
    detected_at: datetime | None = None,
    keep: tuple[str, ...] = (),
    rules: DataFrame | None = None,
    context: bool = False,
) -> DataFrame:
    """Findings of the requested engines at or above a level.

    All line engines share one pass over the files. The dependency engine reads
    the manifests among them and needs ``advisories``; without a feed it finds
    nothing. ``keep`` names columns of the files that their findings carry, such as the
    scan's id. ``rules`` is a table of further line rules, of any size; among them, an engine that
    reports the first match takes the first of the table. ``context`` gives findings of built-in and
    catalog rules, as a column after ``keep``, what :func:`lynceus.operators.findings.with_context` adds, without a join; others have none. Sort with :func:`lynceus.functions.severity.rank_order` when the
    order matters.
    """
    engines = parse_engines(engines)
    level = parse_level(min_severity)
    if entropy:
        catalog = with_entropy(catalog)
    if skip_tests:
        files = without_tests(files)
    lines = [e for e in engines if e in (SAST, SECRETS, AI_CODE)]
    parts = []
    if lines:
        raw = match(files, catalog.of(*lines), level, keep, context).drop("_language")
        parts.append(raw.withColumn("cve_id", F.lit(None).cast("string")))
        if rules is not None:
            own = match_table(files, rules.where(F.col("engine").isin(lines)), level, keep).drop("_language")
            parts.append(own.withColumn("cve_id", F.lit(None).cast("string")))
    if SCA in engines and advisories is not None:
        hits = affected(extract_dependencies(files, by_content=by_content, keep=keep), advisories)
        parts.append(sca_findings(hits, keep).where(F.col("sev_rank") >= RANK[level]))
    if not parts:
        empty = files.sparkSession.createDataFrame([], schemas.FINDINGS)
        near = [F.lit(None).cast("bigint").alias("context")] if context else []
        return empty.select(*[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in keep], *near, "*")
    if context:
        parts = [p if "context" in p.columns else p.withColumn("context", F.lit(None).cast("bigint")) for p in parts]
    findings = to_findings(append_engines(parts), detected_at, (*keep, "context") if context else keep)
    if vulnerabilities is not None:
        findings = enrich_titles(findings, vulnerabilities)
    return findings


def scan_workspaces(
    requests: DataFrame,
    min_severity: str = "info",
    catalog: Catalog = DEFAULT,
    advisories: DataFrame | None = None,
    detected_at: datetime | None = None,
) -> DataFrame:
    """Findings of workspace requests, each by the engines it asks for.

    A request is a row (scan_id, files, engines) as
    :func:`lynceus.sources.workspace.read_requests` gives it; one that names no
    engines asks for all. The requests share one pass; a finding is kept when its scan
    asked for the engine. Dependencies need ``advisories``.
    """
    asked = F.coalesce("engines", F.array(*[F.lit(e) for e in ENGINES]))
    files = requests.select("scan_id", asked.alias("engines"), F.inline("files"))
    keep = ("scan_id", "engines")
    found = scan(
        as_files(files, keep), ENGINES, min_severity, catalog, advisories, detected_at=detected_at, keep=keep
    )
    return found.where(F.array_contains("engines", F.col("engine"))).drop("engines")
