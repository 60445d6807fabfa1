"""Reports from one union, run records, events around an analysis, plugged-in sources, networks, bucketed results."""

import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from letterlens.operators import audit as A
from letterlens.operators import indicators as I
from letterlens.operators import lifecycle as L
from letterlens.operators import networks as N
from letterlens.operators import origin as G
from letterlens.operators import report as RP
from letterlens.operators import rule_texts as RT
from letterlens.operators import rules as R
from letterlens.plans.stored import Stored
from letterlens.sources import indicator_sources as SO
from letterlens.sources import result_tables as RS
from letterlens.sources import results as RW

SF = "/root/testdata/sf0.001"
SECTIONS = ("executive_summary", "case_info", "evidence_integrity", "email_overview", "header_analysis", "rules_findings", "ml_findings", "ioc_findings", "attachment_findings", "geo_findings", "correlation",
            "audit_timeline", "analysis_runs", "provenance", "evidence_manifest")


@pytest.fixture(scope="module")
def store(spark):
    return Stored(spark, SF)


@pytest.fixture(scope="module")
def tables(store):
    return dict(cases=store.flat.join(store.status, "case_id"), parsed=store.parsed, hits=RT.with_texts(R.evaluate_rules(store.parsed)), scores=store.scores, ml=store.ml_results, matches=store.matches, origins=store.origins,
                assessed=store.assessed, evidence=store.evidence, graph=store.graph, chain=store.chain, errors=A.verify_rows(store.chain), runs=store.runs, provenance=store.provenance, manifest=store.manifest)


def test_report_has_its_sections_and_their_rows(store, tables):
    few = {k: df.where("case_id <= 'CASE-0000000059'") for k, df in tables.items()}
    got = {r.case_id: json.loads(r.j) for r in RP.report(**few).select("case_id", RP.report_json(F.col("report")).alias("j")).collect()}
    assert len(got) == 60 and all(set(SECTIONS) < set(j) for j in got.values())
    scores = {r.case_id: r for r in few["scores"].collect()}
    chain = {}
    for r in few["chain"].orderBy("event_sequence").collect():
        chain.setdefault(r.case_id, []).append(r.event_hash)
    for case, j in got.items():
        assert [e["event_hash"] for e in j["audit_timeline"]["events"]] == chain[case] and j["audit_timeline"]["audit_chain_valid"]
        assert j["rules_findings"]["total_score"] == scores[case].total_score and len(j["rules_findings"]["matched_rules"]) == scores[case].matched_rules_count
        assert all(m["description"] and m["points"] for m in j["rules_findings"]["matched_rules"])
        assert j["evidence_manifest"]["total_artifacts"] == len(j["evidence_manifest"]["artifacts"]) == j["attachment_findings"]["total_attachments"] + 5
        k = int(case[5:])
        assert j["evidence_integrity"]["integrity_status"] == ("FILE_MISSING" if k % 31 == 0 else "COMPROMISED" if k % 29 == 0 else "VERIFIED")
        assert j["case_info"]["case_status"] == j["case_info"]["case_status"].lower() and (k % 37 or j["case_info"]["case_status"] == "queue_failed")


def test_report_digest_is_that_of_its_canonical_json(spark, tables):
    few = {k: df.where("case_id = 'CASE-0000000002'") for k, df in tables.items()}
    row = RP.report(**few).select("report_sha256", RP.report_json(F.col("report")).alias("j")).first()
    assert row.report_sha256 == hashlib.sha256(row.j.encode()).hexdigest() and row.j.isascii()
    assert row.j == json.dumps(json.loads(row.j), sort_keys=True, separators=(",", ":"))
    again = RP.report(**{k: df.repartition(3) for k, df in few.items()}).first()
    assert again.report_sha256 == row.report_sha256


def test_report_of_a_case_with_no_results(spark, tables):
    none = {k: df.limit(0) for k, df in tables.items() if k != "cases"}
    row = json.loads(RP.report(cases=tables["cases"].where("case_id = 'CASE-0000000002'"), **none).select(RP.report_json(F.col("report"))).first()[0])
    assert row["executive_summary"]["final_assessment"] == "INCONCLUSIVE" and row["rules_findings"] is None and row["email_overview"] is None and row["audit_timeline"] is None
    assert row["attachment_findings"] == {"attachments": [], "total_attachments": 0} and row["evidence_integrity"]["integrity_status"] == "VERIFIED"


def test_report_is_one_exchange_over_its_tables(spark, tables):
    """The union meets in one shuffle on case_id; written inputs need none of their own but where they are made."""
    plain = {k: spark.createDataFrame([], df.schema) for k, df in tables.items()}
    plan = RP.report(**plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") <= 1 and "Join" not in plan


def test_report_is_written_as_json_once(tables):
    few = RP.report(**{k: df.where("case_id < 'CASE-0000000009'") for k, df in tables.items()})
    rows = few.select("report_json", RP.report_json(F.col("report")).alias("again"), "report_sha256").collect()
    assert rows and all(r.report_json == r.again and hashlib.sha256(r.again.encode()).hexdigest() == r.report_sha256 for r in rows)


def test_runs_have_status_output_and_error(spark):
    at = lambda n: f"2024-01-01 00:00:{n:02d}"
    rows = [("a", 1, "PROCESSING_STARTED", at(1), "m"), ("a", 2, "PARSER_STARTED", at(2), "m"), ("a", 3, "PARSER_COMPLETED", at(4), "m"), ("a", 4, "ML_STARTED", at(5), "m"), ("a", 5, "ML_FAILED", at(8), "no model"),
            ("a", 6, "PARSER_STARTED", at(10), "m"), ("a", 7, "PARSER_COMPLETED", at(11), "m"), ("b", 1, "RULES_STARTED", at(1), "m")]
    events = spark.createDataFrame(rows, "case_id string, event_sequence int, event_type string, t string, message string").withColumn("event_timestamp", F.col("t").cast("timestamp"))
    outputs = spark.createDataFrame([("a", "parser", "f1"), ("a", "ml", "f2")], "case_id string, engine string, sha256 string")
    got = sorted((r.run_id, r.status, r.duration_ms, r.output_fingerprint, r.error_message) for r in A.analysis_runs(events, outputs).collect())
    assert got == [("RUN-a-ml-1", "failed", 3000, None, "no model"), ("RUN-a-parser-1", "completed", 2000, "f1", None), ("RUN-a-parser-2", "completed", 1000, "f1", None), ("RUN-b-rules-1", "running", None, None, None)]


def test_events_and_states_around_the_analysis(spark):
    rows = [("ok", True, True, True, True), ("waits", True, False, True, True), ("lost", False, True, True, True), ("plain", True, True, False, None)]
    df = spark.createDataFrame(rows, "case_id string, queued boolean, started boolean, viewed boolean, reported boolean").select("*", *[F.lit(True).alias(s.lower()) for s in L.STAGES], F.lit(True).alias("intact"))
    events = L.lifecycle_events(df)
    by = {}
    for r in events.orderBy("event_sequence").collect():
        by.setdefault(r.case_id, []).append(r.event_type)
    assert by["ok"][:4] == ["CASE_CREATED", "EVIDENCE_STORED", "JOB_QUEUED", "PROCESSING_STARTED"] and by["ok"][-2:] == ["ANALYST_VIEWED", "REPORT_GENERATED"]
    assert by["waits"] == ["CASE_CREATED", "EVIDENCE_STORED", "JOB_QUEUED"] and by["lost"] == ["CASE_CREATED", "EVIDENCE_STORED"] and by["plain"][-1] == "EVIDENCE_INTEGRITY_VERIFIED"
    states = {r.case_id: r.status for r in L.case_status(events, df.where("not queued")).collect()}
    assert states == {"ok": "complete", "waits": "queued", "lost": "queue_failed", "plain": "complete"}
    assert L.case_status(events).where("case_id = 'lost'").first().status == "uploaded"


def test_manifest_has_the_raw_mail(store):
    rows = store.manifest.where("case_id = 'CASE-0000000002'").collect()
    raw = [r for r in rows if r.artifact_type == "raw_email"]
    assert len(raw) == 1 and raw[0].immutable and raw[0].sha256 == store.flat.where("case_id = 'CASE-0000000002'").first().sha256
    assert {r.artifact_type for r in rows if r.immutable} == {"raw_email", "attachment"}


def test_every_rule_has_texts(spark):
    assert set(RT.TEXTS) == {r.rule_id for r in R.CATALOGUE} and all(len(v) == 4 and all(v) for v in RT.TEXTS.values())


def test_indicators_are_deduplicated_in_order(spark):
    row = spark.createDataFrame([("a", ["http://b.test/", "http://a.test/", "http://b.test/", "http://B.test"] * 300)], "case_id string, urls array<string>").selectExpr(
        "case_id", "urls", "cast(null as array<struct<sha256:string>>) attachments", "cast(null as struct<domain:string>) sender", "map() headers")
    row = row.withColumn("headers", F.lit(None).cast("map<string,array<string>>"))
    got = [(r.ioc_id, r.ioc_type, r.normalized_value) for r in I.extract_indicators(row).orderBy("ioc_id").collect()]
    assert got == [("IOC-001", "URL", "http://b.test/"), ("IOC-002", "DOMAIN", "b.test"), ("IOC-003", "URL", "http://a.test/"), ("IOC-004", "DOMAIN", "a.test")]


# Sources

class Raises:
    name = "raises"

    def indicators(self):
        yield {"type": "IP", "value": "8.8.8.8", "status": "suspicious", "confidence": 10, "reason": "before the fault", "feed_version": "1"}
        raise OSError("feed host is gone")


def _record(**more):
    return {"type": "DOMAIN", "value": "bad.test", "status": "known_malicious", "confidence": 90, "reason": "kit", "feed_version": "7"} | more


def test_a_failing_source_leaves_the_others_intact(spark, tmp_path):
    feed = json.dumps({"feed_version": "9", "indicators": [_record(value="8.8.8.8", type="IP")]})
    (tmp_path / "feed.json").write_text(feed)
    good, file = SO.Records("good", (_record(), _record(value="odd.test", status="suspicious", confidence=40))), SO.JsonFeed("file", f"file://{tmp_path}/feed.json")
    broken, empty = SO.Records("broken", (_record(), _record(confidence=101))), SO.Records("empty", ())
    ind = spark.createDataFrame([("a", "IOC-001", "DOMAIN", "bad.test"), ("a", "IOC-002", "IP", "8.8.8.8")], "case_id string, ioc_id string, ioc_type string, normalized_value string")
    alone = {(r.ioc_id, r.source): (r.status, r.confidence, r.reason, r.feed_version, r.feed_sha256) for r in SO.match_sources(ind, [good, file]).collect()}
    got = {(r.ioc_id, r.source): (r.status, r.confidence, r.reason, r.feed_version, r.feed_sha256) for r in SO.match_sources(ind, [good, Raises(), file, broken, empty, SO.JsonFeed("gone", "file:///nowhere.json")]).collect()}
    assert {k: v for k, v in got.items() if k[1] in ("good", "file")} == alone
    assert alone["IOC-001", "good"] == ("known_malicious", 90, "kit", "7", None) and alone["IOC-002", "file"] == ("known_malicious", 90, "kit", "9", hashlib.sha256(feed.encode()).hexdigest())
    assert alone["IOC-002", "good"][:2] == ("not_found", 0)
    assert all(got[i, s][0] == "error" for i in ("IOC-001", "IOC-002") for s in ("raises", "broken", "empty", "gone")) and len(got) == 12
    assert "feed host is gone" in got["IOC-001", "raises"][2] and "confidence" in got["IOC-001", "broken"][2] and "no records" in got["IOC-001", "empty"][2]
    assert SO.read_sources(spark, [good, Raises(), file]).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        SO.match_sources(ind, [good, good])


# Networks

@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_longest_networks_against_brute_force(spark, limit):
    rng = random.Random(5)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32), n), strict=False)) for n in range(8, 33) for _ in range(12)} | {"10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "0.0.0.0/0"}
    nets |= {str(ipaddress.ip_network((rng.getrandbits(128), n), strict=False)) for n in (16, 32, 48, 64, 128) for _ in range(6)} | {"2001:db8::/32", "2001:db8:1::/48"}
    parsed = [ipaddress.ip_network(n) for n in sorted(nets)]
    ips = ["10.1.2.3", "10.1.2.4", "10.1.9.9", "10.9.9.9", "2001:db8:1::5", "2001:db8:2::5", "::1", "no address", None, None, "1.2.3"]
    ips += [str(n[rng.randrange(min(n.num_addresses, 1 << 30))]) for n in parsed] + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)]
    feed = N.networks(spark.createDataFrame([(n, f"f{i}") for i, n in enumerate(sorted(nets))] + [("bad", "x"), ("1.2.3.4/40", "y"), (None, "z")], "ip string, field string"))
    assert feed.count() == len(nets)
    rows = spark.createDataFrame(list(enumerate(ips)), "id int, ip string")
    got = {r.id: (r.field, r.matched_prefix) for r in N.longest_match(rows, "ip", feed, ["field"], limit).collect()}
    assert len(got) == len(ips)
    for i, ip in enumerate(ips):
        try:
            own = ipaddress.ip_address(ip)
            best = max((n for n in parsed if n.version == own.version and own in n), key=lambda n: n.prefixlen, default=None)
        except ValueError:
            best = None
        assert got[i] == ((f"f{sorted(nets).index(str(best))}", best.prefixlen) if best else (None, None)), ip


def test_versions_and_radius_reach_the_result(spark):
    origins = spark.createDataFrame([("a", "45.83.1.7"), ("b", "9.9.9.9"), ("c", None)], "case_id string, selected_origin_ip string")
    geo = spark.createDataFrame([("45.83.0.0/16", "DE", 1, None, "g1", "aa"), ("45.83.1.0/24", "NL", 2, None, "g1", "aa"), ("9.9.0.0/16", "US", 3, 7, "g1", "aa")],
                                "ip string, country_code string, asn int, accuracy_radius_km int, version string, feed_sha256 string")
    intel = spark.createDataFrame([("45.83.1.7", True, "n1", "bb")], "ip string, is_vpn boolean, version string, feed_sha256 string")
    got = {r.case_id: r for r in G.enrich(origins, geo, intel).collect()}
    assert (got["a"].country_code, got["a"].accuracy_radius_km, got["a"].is_vpn, got["a"].intel_source) == ("NL", 50, True, "feed")
    assert (got["b"].country_code, got["b"].accuracy_radius_km, got["b"].is_vpn, got["b"].intel_source) == ("US", 7, None, "unmatched") and got["c"].accuracy_radius_km is None
    assert all((r.geo_database_version, r.geo_database_sha256, r.network_feed_version, r.network_feed_sha256) == ("g1", "aa", "n1", "bb") for r in got.values())


# Bucketed results

def test_pending_of_bucketed_tables_moves_no_rows(spark):
    names = {k: f"t_pending_{k}" for k in ("cases", *RS.ENGINES)}
    ids = lambda xs: spark.createDataFrame([(f"c{i:03d}",) for i in xs], "case_id string")
    RS.save_bucketed(ids(range(100)), names["cases"], 4)
    for n, k in enumerate(RS.ENGINES, 2):
        RS.save_bucketed(ids([i for i in range(100) if i % (n + 5)]), names[k], 4)
    results = [names[k] for k in RS.ENGINES]
    pending = RS.pending_of_tables(spark, names["cases"], results)
    assert {r.case_id for r in pending.collect()} == {f"c{i:03d}" for i in range(100) if any(i % (n + 5) == 0 for n in range(2, 8))}
    missing = RS.completeness(spark, names["cases"], dict(zip(RS.ENGINES, results, strict=True)))
    assert {r.case_id: r.missing for r in missing.collect()}["c056"] == "parsed,rules"
    for df in (pending, missing):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert RS.pending_of_tables(spark, names["cases"], results, force=True).count() == 100
    RS.drop_tables(spark, *names.values())


# Results with a log

def _rows(spark, pairs):
    return spark.createDataFrame(pairs, "case_id string, v int")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert RW.write_results(_rows(spark, [("a", 1), ("b", 1)]), path, 4, batch_id=0)
    assert RW.write_results(_rows(spark, [("a", 2), ("a", 3)]), path, 4, batch_id=1)
    assert not RW.write_results(_rows(spark, [("a", 99)]), path, 4, batch_id=1) and not RW.write_results(_rows(spark, [("b", 98)]), path, 4, batch_id=0)
    assert sorted(map(tuple, RW.latest(spark, path).collect())) == [("a", 2), ("a", 3), ("b", 1)]
    RW.write_results(_rows(spark, []), path, 4, cases=_rows(spark, [("b", 0)]), batch_id=2)
    assert sorted(map(tuple, RW.latest(spark, path).collect())) == [("a", 2), ("a", 3)]


def test_a_run_that_died_before_its_commit_is_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    RW.write_results(_rows(spark, [("a", 1)]), path, 4, batch_id=0)
    RW._write(_rows(spark, [("a", 7), ("x", 7)]), _rows(spark, [("a", 7)]), path, f"batch-{1:020d}", 4)
    assert [tuple(r) for r in RW.latest(spark, path).collect()] == [("a", 1)]
    RW.write_results(_rows(spark, [("a", 8)]), path, 4, batch_id=1)
    assert [tuple(r) for r in RW.latest(spark, path).collect()] == [("a", 8)]


def test_reruns_leave_a_bounded_number_of_files(spark, tmp_path):
    path, want, counts = f"file://{tmp_path}/r", {}, []
    rng = random.Random(2)
    for n in range(14):
        own = {f"c{rng.randrange(8)}": n for _ in range(3)}
        want |= own
        RW.write_results(_rows(spark, list(own.items())), path, 2, batch_id=n, compact_every=3)
        counts.append(sum(1 for _ in tmp_path.rglob("*.parquet")))
        assert dict(map(tuple, RW.latest(spark, path).collect())) == want
    assert max(counts[7:]) <= max(counts[:7]) and len(RW.read_log(spark, path).runs) <= 4
    assert not RW.write_results(_rows(spark, [("c0", 99)]), path, 2, batch_id=5)  # known after compaction, too


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/r"
    for n in range(3):
        _rows(spark, [(f"c{n}", n), ("all", n)]).coalesce(1).write.parquet(str(src / f"f{n}"))
    stream = spark.readStream.schema("case_id string, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    run = lambda: stream.writeStream.foreachBatch(lambda df, i: RW.write_results(df, path, 2, batch_id=i) and None).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    first = sorted(map(tuple, RW.latest(spark, path).collect()))
    assert {c for c, _ in first} == {"c0", "c1", "c2", "all"} and len(first) == 4
    run()
    assert sorted(map(tuple, RW.latest(spark, path).collect())) == first
