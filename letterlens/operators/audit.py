"""Tamper-evident records: canonical JSON, fingerprints, hash chains, runs, manifests.

A chain is sequential within its case and parallel over cases; verification needs only neighbouring rows' stored hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from letterlens.functions.urls import bound


#: Kinds of characters up to which a text is escaped kind by kind.
KINDS = 48


def ascii_escaped(json: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX, beyond the basic plane as a surrogate pair."""
    def one(ch):
        b = F.encode(ch, "UTF-16BE")
        h = F.lower(F.hex(b))
        return F.when(ch.rlike(r"^[\x00-\x7f]$"), ch).when(F.length(b) == 2, F.concat(F.lit("\\u"), h)).otherwise(
            F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"), F.substring(h, 5, 4)))

    def replaced(kinds):
        """Of few kinds of characters each is replaced throughout the text; of many, every character is looked at."""
        return F.when(F.size(kinds) <= KINDS, F.aggregate(kinds, json, lambda t, ch: F.replace(t, ch, one(ch)))).otherwise(F.array_join(F.transform(F.split(json, ""), one), ""))
    return F.when(json.rlike(r"[^\x00-\x7f]"), bound(F.array_distinct(F.regexp_extract_all(json, F.lit(r"[^\x00-\x7f]"), 0)), replaced)).otherwise(json)


def canonical(*fields: tuple[str, Column]) -> Column:
    """A1: JSON of the fields in order of their names, without blanks, nulls kept."""
    row = F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])])
    return ascii_escaped(F.to_json(row, {"ignoreNullFields": "false"}))


def fingerprint(json: Column) -> Column:
    return F.sha2(json, 256)


def iso_time(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def event_json(metadata: Column, previous: Column) -> Column:
    """What an event's hash is made of, from columns of the event; metadata is canonical JSON text already."""
    head = canonical(("actor_id", F.nullif("actor_id", F.lit(""))), ("actor_type", F.col("actor_type")), ("case_id", F.col("case_id")), ("event_sequence", F.col("event_sequence")),
                     ("event_timestamp", iso_time(F.col("event_timestamp"))), ("event_type", F.col("event_type")), ("message", F.col("message")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"metadata":'), F.coalesce(ascii_escaped(metadata), F.lit("{}")), F.lit(',"previous_event_hash":'),
                    F.coalesce(F.concat(F.lit('"'), previous, F.lit('"')), F.lit("null")), F.lit("}"))


EVENT = ("case_id", "event_sequence", "event_type", "event_timestamp", "actor_type", "actor_id", "message", "metadata")


def build_chain(events: DataFrame) -> DataFrame:
    """A3, A4: events (as EVENT, without a sequence, with `place` for order) numbered and linked within each case.

    All text of an event but the link is put together in parallel; the digests are folded in order over the rows of a
    case as they stream by, so of a case only its last digest is held, however long it is.
    """
    rows = events.repartition("case_id").withColumn("event_sequence", F.row_number().over(Window.partitionBy("case_id").orderBy("place")))
    rows = rows.withColumn("head", F.regexp_replace(event_json(F.col("metadata"), F.lit(None).cast("string")), r"null\}$", "")).drop("place")
    rows = rows.sortWithinPartitions("case_id", "event_sequence")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, last = None, None
        for batch in batches:
            before, digests = [], []
            for c, head in zip(batch.column("case_id").to_pylist(), batch.column("head").to_pylist(), strict=True):
                last = last if c == case else None
                before.append(last)
                case, last = c, hashlib.sha256((head + (f'"{last}"' if last else "null") + "}").encode()).hexdigest()
                digests.append(last)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "head"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(before, pa.string()), pa.array(digests, pa.string())],
                                             [*[batch.schema.names[i] for i in kept], "previous_event_hash", "event_hash"])

    schema = StructType([*rows.drop("head").schema.fields, StructField("previous_event_hash", StringType()), StructField("event_hash", StringType())])
    return rows.mapInArrow(linked, schema)


def _checked(chain: DataFrame) -> DataFrame:
    """The rows of a stored chain with `found`, the errors of each."""
    by = Window.partitionBy("case_id").orderBy("event_sequence", "event_hash")
    rows = chain.withColumn("expected", F.row_number().over(by)).withColumn("before", F.lag("event_hash").over(by))
    again = fingerprint(event_json(F.col("metadata"), F.col("previous_event_hash")))
    found = F.array_compact(F.array(F.when(F.col("event_sequence") != F.col("expected"), "sequence_anomaly"),
                                    F.when(~F.col("previous_event_hash").eqNullSafe(F.col("before")), "previous_hash_mismatch"),
                                    F.when(again != F.col("event_hash"), "event_hash_mismatch")))
    return rows.select("case_id", "event_sequence", "event_hash", found.alias("found"))


def verify_rows(chain: DataFrame) -> DataFrame:
    """A row per error of a stored chain: sequence_anomaly, previous_hash_mismatch, event_hash_mismatch."""
    return _checked(chain).select("case_id", "event_sequence", F.explode("found").alias("error_type"))


def verify_cases(cases: DataFrame, chain: DataFrame) -> DataFrame:
    """Per case whether its chain is valid, its length and ends; a case without events is valid."""
    ends = _checked(chain).groupBy("case_id").agg(F.count("*").alias("event_count"), F.sum(F.size("found")).alias("errors"), F.min_by("event_hash", F.struct("event_sequence", "event_hash")).alias("first_event_hash"),
                                        F.max_by("event_hash", F.struct("event_sequence", "event_hash")).alias("last_event_hash"))
    out = cases.select("case_id").join(ends.hint("merge"), "case_id", "left")
    return out.select("case_id", (F.coalesce("errors", F.lit(0)) == 0).alias("valid"), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("errors", F.lit(0)).alias("errors"), "first_event_hash", "last_event_hash")


def number_runs(runs: DataFrame) -> DataFrame:
    """Run ids RUN-<case>-<engine>-<n> in order of start, and durations in milliseconds; other columns go along."""
    by = Window.partitionBy("case_id", "engine").orderBy("started_at", "finished_at")
    n = runs.withColumn("n", F.row_number().over(by))
    more = [c for c in runs.columns if c not in ("case_id", "engine", "started_at", "finished_at")]
    return n.select("case_id", "engine", F.format_string("RUN-%s-%s-%d", "case_id", "engine", "n").alias("run_id"), "n", "started_at", "finished_at",
                    F.expr("timestampdiff(MILLISECOND, started_at, finished_at)").alias("duration_ms"), *more)


def analysis_runs(events: DataFrame, outputs: DataFrame) -> DataFrame:
    """A record per execution of an engine: run_id, status, duration, output_fingerprint, error_message.

    events: case_id, event_sequence, event_type, event_timestamp, message. An engine's start and the event after it make
    a run, which is running if that event is not there yet. outputs: case_id, engine, sha256 of what the engine gave,
    which a completed run has as its output's fingerprint; a failed run has the message of its failure.
    """
    by = Window.partitionBy("case_id").orderBy("event_sequence")
    rows = events.withColumn("next", F.lead(F.struct("event_type", "event_timestamp", "message")).over(by)).withColumn("stage", F.regexp_extract("event_type", "^(PARSER|RULES|ML|IOC|GEO|CORRELATION)_STARTED$", 1)).where("stage <> ''")
    ended = lambda how: F.col("next.event_type") == F.concat("stage", F.lit(how))
    status = F.when(ended("_COMPLETED"), "completed").when(ended("_FAILED"), "failed").otherwise("running")
    runs = rows.select("case_id", F.lower("stage").alias("engine"), F.col("event_timestamp").alias("started_at"), status.alias("status"),
                       F.when(status != "running", F.col("next.event_timestamp")).alias("finished_at"), F.when(status == "failed", F.col("next.message")).alias("error_message"))
    known = outputs.select("case_id", "engine", F.col("sha256").alias("output_fingerprint"))
    runs = runs.join(known.hint("merge"), ["case_id", "engine"], "left").withColumn("output_fingerprint", F.when(F.col("status") == "completed", F.col("output_fingerprint")))
    return number_runs(runs)


def evidence_manifest(parsed: DataFrame, scores: DataFrame, ml: DataFrame, assessed: DataFrame, cases: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A10: a row per artifact of a case: the raw mail, attachments, parsed data, rule, text and correlation results.

    Evidence (raw mail and attachments) is immutable; results have the fingerprints of their canonical JSON. cases
    (case_id, original_filename, file_size, sha256) gives the raw mail. files: the attachments as rows (case_id, n from 1,
    filename, size, sha256), else they are those of parsed; n names a file without a name.
    """
    def artifact(df, kind, name, size, digest, source):
        return df.select("case_id", F.lit(kind).alias("artifact_type"), name.alias("artifact_name"), size.cast("long").alias("size_bytes"), digest.alias("sha256"), F.lit(source).alias("source"))
    if files is None:
        files = parsed.select("case_id", F.posexplode("attachments").alias("n", "a")).select("case_id", (F.col("n") + 1).alias("n"), "a.filename", "a.size", "a.sha256")
    name = F.when(F.coalesce("filename", F.lit("")) != "", F.col("filename")).otherwise(F.format_string("attachment_%d", F.col("n")))
    rule_json = canonical(("total_score", F.col("total_score")), ("verdict", F.col("rules_verdict")))
    ml_json = canonical(("pred", F.col("prediction")), ("prob", F.col("probability")))
    corr_json = canonical(("assessment", F.col("final_assessment")), ("score", F.col("final_score")))
    head = canonical(("subject", F.col("subject")), ("urls", F.concat_ws(" ", "urls")))
    out = (artifact(files, "attachment", name, F.col("size"), F.col("sha256"), "parser")
            .unionByName(artifact(parsed, "parsed_result", F.lit("parsed_data.json"), F.length(head), fingerprint(head), "parser"))
            .unionByName(artifact(scores, "rule_result", F.lit("rules_results.json"), F.length(rule_json), fingerprint(rule_json), "rules"))
            .unionByName(artifact(ml, "ml_result", F.lit("ml_results.json"), F.length(ml_json), fingerprint(ml_json), "ml"))
            .unionByName(artifact(assessed, "correlation_result", F.lit("correlation.json"), F.length(corr_json), fingerprint(corr_json), "correlation")))
    if cases is not None:
        out = out.unionByName(artifact(cases, "raw_email", F.col("original_filename"), F.col("file_size"), F.col("sha256"), "quarantine"))
    return out.withColumn("immutable", F.col("artifact_type").isin("raw_email", "attachment"))


def composite_hash(manifest: DataFrame) -> DataFrame:
    """One digest per case over its artifacts, in whatever order they come."""
    items = F.array_sort(F.collect_list(F.struct("artifact_type", "artifact_name", "sha256", "size_bytes")))
    return manifest.groupBy("case_id").agg(F.count("*").alias("artifacts"), fingerprint(ascii_escaped(F.to_json(items))).alias("composite_sha256"))


def integrity(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Registered digests against a fresh scan: VERIFIED, COMPROMISED or FILE_MISSING, and the change in bytes."""
    now = files.select("stored_path", F.col("sha256").alias("found_sha256"), F.col("file_size").alias("found_size"))
    return cases.join(now, "stored_path", "left").select(
        "case_id", F.when(F.col("found_sha256").isNull(), "FILE_MISSING").when(F.col("found_sha256") == F.col("sha256"), "VERIFIED").otherwise("COMPROMISED").alias("integrity"),
        (F.col("found_size") - F.col("file_size")).alias("byte_delta"))


def pending(cases: DataFrame, results: list[DataFrame], force: bool = False) -> DataFrame:
    """Cases that lack a row in some result table; all of them if forced."""
    done = results[0].select("case_id").distinct()
    for r in results[1:]:
        done = done.join(r.select("case_id"), "case_id", "left_semi")
    return cases if force else cases.join(done, "case_id", "left_anti")


def status(events: DataFrame) -> DataFrame:
    """The last status of each case."""
    return events.groupBy("case_id").agg(F.max_by("event_type", F.struct("event_timestamp", "place")).alias("status"), F.max("event_timestamp").alias("since"))
