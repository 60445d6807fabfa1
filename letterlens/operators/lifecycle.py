"""The life of a case: events by stage outcome, forced reruns, versions and provenance.

Events are made within a case's row; versions are left joins of results that have one row per case each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterlens.operators.audit import ascii_escaped, fingerprint

# Stages in order, and the versions that results carry.
STAGES = ("PARSER", "RULES", "ML", "IOC", "GEO", "CORRELATION")
VERSION = "1.0.0"
STATUS = {"CASE_CREATED": "uploaded", "JOB_QUEUED": "queued", "PROCESSING_STARTED": "processing", "CASE_ANALYSIS_COMPLETED": "complete", "CASE_ANALYSIS_FAILED": "failed"}
QUEUE_FAILED = "queue_failed"


def lifecycle_events(outcomes: DataFrame, rerun: Column | None = None) -> DataFrame:
    """case_id, event_sequence (from 1), event_type.

    outcomes: case_id, a boolean per stage (parser, rules, ...; null counts as failed), and intact, whether the raw
    evidence is as registered. A failed parser ends the analysis; other failed stages do not. rerun: cases that are
    analysed again by force, which comes first as ANALYSIS_RERUN. Four more booleans add the events around the analysis,
    where outcomes has them: queued (false: the job could not be queued, and nothing follows), started (false: the job
    waits), and, for a complete case, viewed and reported.
    """
    def done(stage: str) -> Column:
        return F.coalesce(F.col(stage.lower()), F.lit(False))

    def given(name: str, otherwise: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in outcomes.columns else F.lit(otherwise)

    def stage_events(stage: str) -> list[Column]:
        return [F.lit(f"{stage}_STARTED"), F.when(done(stage), f"{stage}_COMPLETED").otherwise(f"{stage}_FAILED")]
    again = rerun if rerun is not None else F.lit(False)
    queued = given("queued", True)
    starts, parsed = queued & given("started", True), done(STAGES[0])
    intake = [F.lit("CASE_CREATED"), F.lit("EVIDENCE_STORED"), F.when(queued, "JOB_QUEUED")] if "queued" in outcomes.columns else []
    head = [F.when(again, "ANALYSIS_RERUN"), F.lit("PROCESSING_STARTED"), *stage_events(STAGES[0])]
    rest = [F.when(parsed, e) for s in STAGES[1:] for e in stage_events(s)]
    end = [F.when(parsed, "CASE_ANALYSIS_COMPLETED").otherwise("CASE_ANALYSIS_FAILED"),
           F.when(parsed, F.when(F.coalesce("intact", F.lit(False)), "EVIDENCE_INTEGRITY_VERIFIED").otherwise("EVIDENCE_INTEGRITY_FAILURE")),
           F.when(parsed & given("viewed", False), "ANALYST_VIEWED"), F.when(parsed & given("reported", False), "REPORT_GENERATED")]
    events = F.array_compact(F.array(*intake, *[F.when(starts, e) for e in (*head, *rest, *end)]))
    return outcomes.select("case_id", F.posexplode(events).alias("at", "event_type")).select("case_id", (F.col("at") + 1).alias("event_sequence"), "event_type")


def case_status(events: DataFrame, not_queued: DataFrame | None = None) -> DataFrame:
    """The state of each case after its last event that decides one; uploaded if none does.

    not_queued: case_id of cases whose job could not be queued, for which no event is recorded; a later event overrides it.
    """
    state = F.lit(None).cast("string")
    for kind, name in STATUS.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    last = F.max_by("state", F.when(F.col("state").isNotNull(), F.col("event_sequence")))
    states = events.withColumn("state", state).groupBy("case_id").agg(last.alias("status"))
    if not_queued is not None:
        states = states.join(not_queued.select("case_id", F.lit(QUEUE_FAILED).alias("failed")).distinct().hint("merge"), "case_id", "left").withColumn(
            "status", F.when(F.coalesce("status", F.lit("uploaded")) == "uploaded", F.coalesce("failed", "status")).otherwise(F.col("status")))
    return states.select("case_id", F.coalesce("status", F.lit("uploaded")).alias("status"))


def attachment_set(parsed: DataFrame) -> DataFrame:
    """One digest of a case's attachments in order of their names; null without attachments."""
    items = F.array_sort(F.transform("attachments", lambda a: F.struct(a.filename.alias("filename"), a.sha256.alias("sha256"), a["size"].alias("size"))))
    text = ascii_escaped(F.to_json(items, {"ignoreNullFields": "false"}))
    return parsed.select("case_id", F.when(F.size("attachments") > 0, fingerprint(text)).alias("attachment_manifest_sha256"))


def provenance(cases: DataFrame, parsed: DataFrame, rules: DataFrame, ml: DataFrame, matches: DataFrame, origins: DataFrame, assessed: DataFrame) -> DataFrame:
    """The versions behind a case's results, null where a result is missing.

    cases: case_id, raw_evidence_sha256. matches: the feed of a case's first indicator counts. origins may carry
    geo_database_version and network_feed_version.
    """
    def version(df: DataFrame, name: str) -> DataFrame:
        return df.select("case_id", F.lit(VERSION).alias(name))
    feed = matches.groupBy("case_id").agg(F.min_by("feed_version", F.when(F.col("feed_version").isNotNull(), F.struct("ioc_id", "source"))).alias("ioc_feed_version")).withColumn("ioc_engine_version", F.lit(VERSION))
    known = [c for c in ("geo_database_version", "network_feed_version") if c in origins.columns]
    geo = origins.select("case_id", F.lit(VERSION).alias("geo_analysis_version"), *known)
    out = cases.select("case_id", "raw_evidence_sha256")
    for part in (version(parsed, "parser_version"), version(rules, "rules_engine_version"),
                 ml.select("case_id", F.lit(VERSION).alias("ml_model_version"), F.lit(VERSION).alias("ml_preprocessing_version")), feed, geo,
                 assessed.select("case_id", F.lit(VERSION).alias("correlation_engine_version"), F.lit(VERSION).alias("correlation_policy_version")), attachment_set(parsed)):
        out = out.join(part.hint("merge"), "case_id", "left")
    return out
