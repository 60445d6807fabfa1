import hashlib
import json
import time
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from letterlens.functions import text as T
from letterlens.functions import urls as U
from letterlens.operators import audit as A
from letterlens.operators import classifier as M
from letterlens.operators import correlation as C
from letterlens.operators import corpus as K
from letterlens.operators import indicators as I
from letterlens.operators import origin as G
from letterlens.operators import rules as R
from letterlens.operators import views as W
from letterlens.sources import feeds as FE
from letterlens.sources import mail as S
from letterlens.operators import lifecycle as L
from letterlens.streaming import append_chain, read_mail_stream, run_intake

PARSED = S.RAW + ", urls array<string>"


def address(raw, name="", domain=""):
    return {"raw": raw, "display_name": name, "address": raw, "domain": domain}


def message(case_id="c", **changes):
    row = {"case_id": case_id, "headers": {"message-id": ["<1@a.test>"]}, "received_headers": [], "sender": address("a@corp.example", "Ann", "corp.example"),
           "recipients": {"to": [address("me@x.example")], "cc": [], "bcc": [], "reply_to": []}, "subject": "Hi", "body_text": "Hello", "body_html": None, "attachments": [],
           "parser_status": "success", "error_message": None, "urls": []}
    return row | changes


def files(*names):
    return [{"filename": n, "content_type": "x/y", "size": 1, "sha256": hashlib.sha256(n.encode()).hexdigest(), "content_disposition": "attachment"} for n in names]


CASES = {
    "RULE-HDR-001": {"received_headers": ["a", "b", "c"]},
    "RULE-HDR-002": {"headers": {"Message-ID": ["  "]}},
    "RULE-HDR-003": {"headers": {"message-id": ["x"], "Return-Path": ["<b@other.test>\r\n"]}},
    "RULE-SENDER-001": {"recipients": {"to": [address("me@x.example")], "cc": [], "bcc": [], "reply_to": [address("r@z.test", "", "z.test")]}},
    "RULE-SENDER-002": {"sender": address("x@y.test", "Wells Fargo Desk", "y.test")},
    "RULE-SENDER-003": {"sender": address("x", "Ann", "")},
    "RULE-RECIPIENT-001": {"recipients": {"to": [], "cc": [], "bcc": [], "reply_to": []}},
    "RULE-CONTENT-001": {"subject": "Act NOW"},
    "RULE-CONTENT-002": {"body_text": "send your One-Time Password"},
    "RULE-CONTENT-003": {"body_html": "we take legal ACTION"},
    "RULE-CONTENT-004": {"body_html": "<p>"},
    "RULE-URL-001": {"urls": ["https://a.example/"]},
    "RULE-URL-002": {"urls": ["HTTP://a.example/"]},
    "RULE-URL-003": {"urls": ["https://[2001:db8::1]:8443/x"]},
    "RULE-URL-004": {"urls": ["https://u@a.example/"]},
    "RULE-URL-005": {"urls": ["https://a.example/x?next=Login"]},
    "RULE-ATTACH-001": {"attachments": files("a.pdf")},
    "RULE-ATTACH-002": {"attachments": files("a.JS")},
    "RULE-ATTACH-003": {"attachments": files("a.pdf.exe")},
    "RULE-ATTACH-004": {"attachments": files("my-PO_12.xls")},
}


def test_each_rule_fires_on_its_case_and_only_with_kin(spark):
    rows = [message(k, **v) for k, v in CASES.items()] + [message("none"), message("nulls", **{k: None for k in message() if k != "case_id"})]
    hits = R.evaluate_rules(spark.createDataFrame(rows, PARSED))
    fired = {}
    for h in hits.where("matched").collect():
        fired.setdefault(h.case_id, set()).add(h.rule_id)
    assert all(k in fired[k] for k in CASES) and "none" not in fired
    assert fired["nulls"] == {"RULE-HDR-002", "RULE-SENDER-003", "RULE-RECIPIENT-001"}
    assert hits.count() == 20 * len(rows)
    assert fired["RULE-SENDER-002"] == {"RULE-SENDER-002"} and fired["RULE-ATTACH-003"] == {"RULE-ATTACH-001", "RULE-ATTACH-002", "RULE-ATTACH-003"}


@pytest.mark.parametrize("name,fires", [("x.tar.gz", set()), (".exe", set()), ("x.exe", {2}), ("wire.txt", {4}), ("wired.txt", set()), ("po12", {4}), ("a.b.scr", {2, 3})])
def test_attachment_names(spark, name, fires):
    hits = R.evaluate_rules(spark.createDataFrame([message(attachments=files(name))], PARSED)).where("matched and category = 'attachment'").collect()
    assert {int(h.rule_id[-1]) for h in hits} - {1} == fires


def test_caps_verdicts_and_catalogue(spark):
    urls = ["http://u@phish.net/login", "http://a/%41%41%41%41"]
    df = spark.createDataFrame([message("url", urls=urls), message("bad", urls=urls, subject="urgent", body_text="password legal action", attachments=files("a.pdf.exe"))], PARSED)
    a, b = R.score_rules(df).orderBy("case_id").collect()
    assert (b.url_score, b.total_score, b.rules_verdict) == (40, 40, "SUSPICIOUS")
    assert a.content_score == 35 and a.attachment_score == 45 and a.total_score == 100 and a.rules_verdict == "HIGH_RISK"
    stored = R.score_hits(R.evaluate_rules(df)).select(R.score_rules(df).columns).orderBy("case_id").collect()
    assert stored == [a, b]
    own = R.catalogue(disabled=["RULE-URL-004"], terms={"RULE-CONTENT-001": ("hello",)}, scores={"RULE-URL-001": 9})
    hits = {(r.case_id, r.rule_id): r.score for r in R.evaluate_rules(df, own).where("matched").collect()}
    assert ("url", "RULE-URL-004") not in hits and hits[("url", "RULE-CONTENT-001")] == 10 and hits[("url", "RULE-URL-001")] == 9


@pytest.mark.parametrize("url,host,normal", [
    ("HTTP://Ex.Com:80", "ex.com", "http://ex.com/"), ("https://u:p@h_x.test:443/A b?Q#", "h_x.test", "https://u:p@h_x.test/A b?Q"), ("https://[2001:DB8::1]:9/x", "2001:db8::1", "https://[2001:db8::1]:9/x"),
    ("http://a/%zz", "a", "http://a/%zz"), ("nohost", "", None)])
def test_url_parts(spark, url, host, normal):
    r = spark.createDataFrame([(url,)], "u string").select(U.host(F.col("u")).alias("h"), U.normal_url(F.col("u")).alias("n")).first()
    assert (r.h, r.n) == (host, normal)


def test_indicators_lookup_and_summary(spark):
    df = spark.createDataFrame([message("a", urls=["http://Bad-1.test/x", "http://bad-1.test:80/x", "http://198.51.100.12/", "http://localhost/"], attachments=files("f"),
                                        headers={"Reply-To": ["Z <z@Reply-5.test>"]}), message("b", sender=address("q@docs.example.org", "", "docs.example.org"))], PARSED)
    ind = I.extract_indicators(df)
    rows = [(r.ioc_id, r.ioc_type, r.normalized_value, r.source_context) for r in ind.where("case_id = 'a'").orderBy("ioc_id").collect()]
    assert [r[1:3] for r in rows] == [("URL", "http://bad-1.test/x"), ("DOMAIN", "bad-1.test"), ("URL", "http://198.51.100.12/"), ("IP", "198.51.100.12"), ("URL", "http://localhost/"),
                                      ("SHA256", hashlib.sha256(b"f").hexdigest()), ("DOMAIN", "corp.example"), ("DOMAIN", "reply-5.test")]
    assert [r[0] for r in rows] == [f"IOC-00{i}" for i in range(1, 9)]
    hits = I.match_indicators(ind, FE.valid_feed(FE.example_feed(spark)), ["feed-a", "feed-b", "feed-c"])
    assert {r.status for r in hits.where("source = 'feed-c'").collect()} == {"error"}
    s = {r.case_id: r for r in I.summarise(hits).collect()}
    assert (s["a"].total_indicators, s["a"].malicious, s["a"].suspicious, s["a"].malicious_confidence, s["a"].disputed) == (8, 2, 1, 80, False)
    assert s["b"].disputed and s["b"].benign


@pytest.mark.parametrize("bad", [{"type": "EMAIL"}, {"value": "zz", "type": "SHA256"}, {"value": "1.2.3", "type": "IP"}, {"confidence": 101}, {"status": None}])
def test_one_bad_record_rejects_a_feed(spark, tmp_path, bad):
    good = {"type": "DOMAIN", "value": "a.test", "status": "suspicious", "confidence": 5, "source": "s", "reason": "r"}
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"feed_version": "1", "indicators": [good]}))
    feed = FE.read_indicator_feed(spark, str(path), "own")
    row = FE.valid_feed(feed).first()
    assert row.normalized_value == "a.test" and row.feed_sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    path.write_text(json.dumps({"feed_version": "1", "indicators": [good, good | bad]}))
    with pytest.raises(ValueError):
        FE.valid_feed(FE.read_indicator_feed(spark, str(path), "own"))


CLASSES = {"192.0.2.1": "DOCUMENTATION", "127.0.0.1": "LOOPBACK", "169.254.1.1": "LINK_LOCAL", "10.0.0.1": "PRIVATE", "172.31.0.1": "PRIVATE", "172.32.0.1": "GLOBAL", "240.0.0.1": "PRIVATE",
           "224.0.0.1": "MULTICAST", "100.64.0.1": "RESERVED", "192.0.0.9": "GLOBAL", "8.8.8.8": "GLOBAL", "256.1.1.1": "INVALID", "1.2.3": "INVALID", "01.2.3.4": "INVALID", "[10.0.0.1]": "PRIVATE",
           "2001:db8::1": "DOCUMENTATION", "::1": "LOOPBACK", "fe80::1": "LINK_LOCAL", "fd00::1": "PRIVATE", "ff02::1": "MULTICAST", "2606:4700::1": "GLOBAL"}


def test_address_classes(spark):
    got = {r.ip: r.c for r in spark.createDataFrame([(k,) for k in CLASSES], "ip string").select("ip", G.classify_ip(F.col("ip")).alias("c")).collect()}
    assert got == CLASSES


def test_origins(spark):
    rows = {"high": ["by mx from relay.example.org (relay [8.8.4.4])", "from desk (x [45.83.4.7]) by relay"], "medium": ["from r.example.org ([8.8.4.4])", "from [192.168.0.4]"],
            "low": ["from a.example.org ([203.0.113.9])"], "none": ["from b ([10.1.1.1])"], "empty": []}
    got = {r.case_id: r for r in G.trace_origin(spark.createDataFrame([message(k, received_headers=v) for k, v in rows.items()], PARSED), FE.example_geo(spark), FE.example_intel(spark)).collect()}
    assert {k: (r.selected_origin_ip, r.confidence) for k, r in got.items()} == {
        "high": ("45.83.4.7", "HIGH"), "medium": ("8.8.4.4", "MEDIUM"), "low": ("203.0.113.9", "LOW"), "none": (None, "UNKNOWN"), "empty": (None, "UNKNOWN")}
    assert got["high"].country_code == "NL" and got["medium"].intel_source == "unmatched" and got["medium"].is_vpn is None and got["empty"].status == "NO_CANDIDATE"
    assert "documentation range" in got["low"].limitations and got["high"].candidate_ips[0].hop_index == 0


def _correlate(spark, rules=None, ml=None, ioc=None, geo=None, cross=0, parsed=True):
    one = lambda rows, schema: spark.createDataFrame([("c", *rows)] if rows else [], f"case_id string, {schema}")
    graph = spark.createDataFrame([("c", True)] * cross, "case_id string, is_cross_engine boolean")
    return C.correlate(one((parsed,), "parsed boolean"), one(rules, "total_score int"), one(ml, "model_status string, phishing_probability double"),
                       one(ioc, "malicious_confidence int, suspicious_confidence int, benign boolean, disputed boolean"),
                       one(geo, "confidence string, is_tor_exit boolean, is_vpn boolean, is_proxy boolean, is_datacenter_hosting boolean"), graph).first()


def test_correlation_cases(spark):
    all_four = _correlate(spark, (90,), ("ready", 0.95), (95, None, False, False), ("HIGH", True, True, False, False))
    assert all_four.final_score >= 80 and (all_four.final_assessment, all_four.correlation_confidence) == ("HIGH_RISK", "HIGH")
    clash = _correlate(spark, (80,), ("ready", 0.1), (None, None, None, False), ("LOW", None, None, None, None))
    assert clash.conflicts == ["rules high, text low"] and clash.correlation_confidence == "MEDIUM"
    severe = _correlate(spark, (0,), ("ready", 0.0), (90, None, False, False), ("UNKNOWN", None, None, None, None))
    assert severe.final_score == 65.0 and severe.final_assessment == "HIGH_RISK"
    two = _correlate(spark, (50,), None, (None, 40, False, False), None)
    assert two.coverage == 60.0 and two.rules_points == pytest.approx(50 * 0.5833, abs=0.01) and two.ioc_points == pytest.approx(23.34)
    assert _correlate(spark, geo=("HIGH", True, False, False, False), parsed=False).final_assessment == "INCONCLUSIVE"
    assert _correlate(spark, parsed=False).coverage == 0
    assert _correlate(spark, (50,), cross=2).discount == 2.5


def test_corpus_splits_are_disjoint_and_exact(spark):
    rows = [("b" if i % 3 else "a", i, i % 4 == 0 and 1 or 0, f"h{i % 170}", True) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, seq long, label int, content_hash string, usable boolean")
    kept = K.keep_first(df)
    assert kept.count() == 170
    parts = K.split(kept)
    sizes = {(r.split): r.samples for r in K.manifest(parts).collect()}
    assert sum(sizes.values()) == 170 and abs(sizes["train"] - 119) <= 1
    assert set(K.overlaps(parts).first()) == {0}
    again = K.split(K.keep_first(df.repartition(7)))
    assert {tuple(r) for r in again.select("content_hash", "split").collect()} == {tuple(r) for r in parts.select("content_hash", "split").collect()}
    assert K.capped_sample(df, 15, 20).count() == 20


@pytest.mark.parametrize("p,prediction,confidence", [(0.0, "LEGITIMATE", "HIGH"), (0.29, "LEGITIMATE", "MEDIUM"), (0.3, "UNCERTAIN", "MEDIUM"), (0.5, "UNCERTAIN", "LOW"), (0.7, "UNCERTAIN", "MEDIUM"),
                                                     (0.71, "PHISHING", "MEDIUM"), (0.86, "PHISHING", "HIGH")])
def test_thresholds(spark, p, prediction, confidence):
    r = spark.createDataFrame([(p,)], "p double").select(M.predict(F.col("p")).alias("a"), M.confidence(F.col("p")).alias("b")).first()
    assert (r.a, r.b) == (prediction, confidence)


def test_classifier_learns_explains_and_falls_back(spark):
    bad, good = "verify your account password now", "minutes of the project meeting attached"
    rows = [(i, f"{bad if i % 2 else good} {i} item{i % 5}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc long, text string, label int")
    model = M.fit(df.where("doc < 60"), 10.0, 200)
    test = df.where("doc >= 60")
    scored = M.score(test, model).join(test, "doc")
    assert M.evaluate(scored).first().f1 == 1.0 and M.roc_auc(scored).first().roc_auc == 1.0 and M.errors(scored).count() == 0
    top = M.explain(M.contributions(test.where("doc = 61"), model)).where("direction = 'phishing' and rank = 1").first()
    assert top.term.split()[0] in bad
    assert M.score(spark.createDataFrame([(1, "", 0)], df.schema), model).first().probability is not None
    out = M.with_fallbacks(scored, F.lit(False), F.lit(True)).first()
    assert (out.model_status, out.prediction, out.probability, out.confidence) == ("unavailable", "UNCERTAIN", 0.5, "LOW")
    best, tried = M.grid_search(df.where("doc < 40"), test, ((1.0, 50), (10.0, 50)))
    assert len(tried) == 2 and best.n_docs == 60


EVENTS = "case_id string, place string, event_type string, event_timestamp timestamp, actor_type string, actor_id string, message string, metadata string"


def events(spark, n=9):
    rows = [(f"c{i % 2}", f"{i:03d}", "PARSED", f"2024-01-0{1 + i % 9} 10:00:00.{i}5", "SYSTEM", None if i % 2 else "w", f'é "{i}" 🙂', '{"a":1}' if i % 3 else None) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS.replace("event_timestamp timestamp", "event_timestamp string")).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))


def reference_hash(e, n, previous):
    ts = e.event_timestamp.isoformat() + "+00:00"
    payload = {"case_id": e.case_id, "event_sequence": n, "event_type": e.event_type, "event_timestamp": ts, "actor_type": e.actor_type, "actor_id": e.actor_id or None, "message": e.message,
               "metadata": json.loads(e.metadata or "{}"), "previous_event_hash": previous}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def test_chain_equals_hashing_one_by_one_and_verifies(spark):
    e = events(spark)
    chain = A.build_chain(e)
    want, last, n = {}, {}, {}
    for r in e.orderBy("place").collect():
        n[r.case_id] = n.get(r.case_id, 0) + 1
        h = reference_hash(r, n[r.case_id], last.get(r.case_id))
        want[(r.case_id, n[r.case_id])] = (last.get(r.case_id), h)
        last[r.case_id] = h
    assert {(r.case_id, r.event_sequence): (r.previous_event_hash, r.event_hash) for r in chain.collect()} == want
    assert A.verify_rows(chain).count() == 0
    cases = spark.createDataFrame([("c0",), ("c1",), ("empty",)], "case_id string")
    got = {r.case_id: r for r in A.verify_cases(cases, chain).collect()}
    assert got["empty"].valid and got["empty"].event_count == 0 and got["c0"].last_event_hash == last["c0"]
    kinds = lambda df: {r.error_type for r in A.verify_rows(df).collect()}
    second = (F.col("case_id") == "c0") & (F.col("event_sequence") == 2)
    assert kinds(chain.withColumn("message", F.when(second, "x").otherwise(F.col("message")))) == {"event_hash_mismatch"}
    assert kinds(chain.withColumn("metadata", F.when(second, "{}").otherwise(F.col("metadata")))) <= {"event_hash_mismatch"}
    assert kinds(chain.where(~second)) == {"sequence_anomaly", "previous_hash_mismatch"}
    assert "sequence_anomaly" in kinds(chain.unionByName(chain.where(second)))


def test_manifest_hash_ignores_order_and_integrity(spark):
    rows = [("c", "attachment", "b", "s1", 1), ("c", "attachment", "a", "s2", 2), ("c", "raw_email", "m", "s3", 3)]
    schema = "case_id string, artifact_type string, artifact_name string, sha256 string, size_bytes long"
    digests = {A.composite_hash(spark.createDataFrame(r, schema).repartition(p)).first().composite_sha256 for r, p in ((rows, 1), (rows[::-1], 3))}
    assert len(digests) == 1
    cases = spark.createDataFrame([("a", "p1", "x", 3), ("b", "p2", "y", 4), ("c", "p3", "z", 5)], "case_id string, stored_path string, sha256 string, file_size long")
    now = spark.createDataFrame([("p1", "x", 3), ("p2", "n", 6)], "stored_path string, sha256 string, file_size long")
    assert {tuple(r) for r in A.integrity(cases, now).collect()} == {("a", "VERIFIED", 0), ("b", "COMPROMISED", 2), ("c", "FILE_MISSING", None)}
    assert [r.case_id for r in A.pending(cases, [cases.limit(3), cases.where("case_id <> 'b'")]).collect()] == ["b"]
    assert A.pending(cases, [cases], force=True).count() == 3


def mail_bytes(subject="Grüße", html=True):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "Ann Lee <ann@Corp.Example>", "Bob <bob@x.example>, carl@y.example", subject, "<1@corp.example>"
    m["Received"] = "from a ([8.8.8.8]) by b"
    m.set_content("See https://a.example/x. and https://a.example/x")
    if html:
        m.add_alternative('<html><head><title>t</title></head><body><script>var u="http://no.example"</script>Hi <a href="https://b.example/y">link</a></body></html>', subtype="html")
    m.add_attachment(b"data", maintype="application", subtype="pdf", filename="../../etc/in voice.pdf")
    return m.as_bytes()


def test_scan_parse_and_stream_agree(spark, tmp_path):
    box = tmp_path / "mail"
    box.mkdir()
    (box / "a.eml").write_bytes(mail_bytes())
    (box / "b.EML").write_bytes(mail_bytes("plain", False))
    (box / "c.txt").write_bytes(b"x")
    (box / "d.eml").write_bytes(b"")
    (box / "e.msg").write_bytes(b"\xd0\xcf")
    scanned = S.scan(spark, str(box))
    reasons = {r.original_filename: r.reject_reason for r in scanned.drop("content").collect()}
    assert reasons == {"a.eml": None, "b.EML": None, "c.txt": "extension", "e.msg": None}  # Spark's reader passes over empty files
    rows = spark.createDataFrame([("x/d.eml", None, 0, b""), ("x/f.eml", None, 30_000_000, b"1")], "path string, modificationTime timestamp, length long, content binary")
    assert [r.reject_reason for r in S.admitted(rows).orderBy("stored_path").collect()] == ["empty", "too large"]
    cases = scanned.where("reject_reason is null")
    parsed = {r.case_id: r for r in S.parse_mail(cases).collect()}
    names = {r.case_id: r.original_filename for r in cases.drop("content").collect()}
    by_name = {names[k]: r for k, r in parsed.items()}
    a = by_name["a.eml"]
    assert (a.subject, a.sender.domain, a.sender.display_name, [t.address for t in a.recipients.to]) == ("Grüße", "corp.example", "Ann Lee", ["bob@x.example", "carl@y.example"])
    assert a.urls == ["https://a.example/x", "https://b.example/y"] and a.received_headers == ["from a ([8.8.8.8]) by b"]
    assert [(f.filename, f["size"], f.sha256) for f in a.attachments] == [("in voice.pdf", 4, hashlib.sha256(b"data").hexdigest())]
    assert by_name["e.msg"].parser_status == "unsupported_format" and S.scorable(S.parse_mail(cases)).count() == 2
    out = str(tmp_path / "out")
    q = run_intake(read_mail_stream(spark, str(box)), lambda df, _: S.parse_mail(df.where("reject_reason is null")).select("case_id", "subject", "parser_status").write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(k, r.subject, r.parser_status) for k, r in parsed.items()}


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "x.mbox").write_bytes(b"From a Mon\nSubject: one\n\nbody\n\nFrom b Tue\nSubject: two\n\nbody2\n")
    assert sorted(r.content.decode().split("\n")[0] for r in S.read_mbox(spark, str(tmp_path / "x.mbox")).collect()) == ["Subject: one", "Subject: two"]
    (tmp_path / "m.csv").write_text('file,message\n"kay/in/1.","Subject: a\n\nhe said ""hi"""\n')
    row = S.read_mail_csv(spark, str(tmp_path / "m.csv")).first()
    assert row.mailbox == "kay" and row.content.decode().endswith('he said "hi"')
    import io
    import tarfile
    with tarfile.open(tmp_path / "c.tar.bz2", "w:bz2") as tar:
        for n in ("h/1", "h/2"):
            info = tarfile.TarInfo(n)
            info.size = 5
            tar.addfile(info, io.BytesIO(b"mail" + n[-1:].encode()))
    assert sorted(r.content for r in S.read_archives(spark, str(tmp_path / "c.tar.bz2")).collect()) == [b"mail1", b"mail2"]
    (tmp_path / "l.csv").write_text("label,subject,body\n Phishing ,s,b\nlegitimate,t,c\n")
    assert [r.label for r in S.read_labelled_csv(spark, str(tmp_path / "l.csv")).collect()] == [1, 0]
    first, second = spark.createDataFrame([("a", 1), ("b", 1)], "case_id string, v int"), spark.createDataFrame([("a", 2)], "case_id string, v int")
    S.write_results(first, str(tmp_path / "r"))
    time.sleep(0.01)
    S.write_results(second, str(tmp_path / "r"))
    assert {(r.case_id, r.v) for r in S.latest(spark, str(tmp_path / "r")).collect()} == {("a", 2), ("b", 1)}
    S.write_splits(spark.createDataFrame([("h", "train"), ("g", "test")], "content_hash string, split string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_stream_appends_the_chain_that_a_batch_builds(spark, tmp_path):
    e = events(spark, 12)
    src = str(tmp_path / "ev")
    e.where("place < '005'").coalesce(1).write.parquet(src)
    rows = append_chain(spark.readStream.schema(e.schema).parquet(src))
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        rows.writeStream.format("parquet").option("path", str(tmp_path / "chain")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    try:
        run()
        e.where("place >= '005'").coalesce(1).write.mode("append").parquet(src)
        run()
    finally:
        spark.conf.unset(conf)
    want = {(r.case_id, r.event_sequence, r.previous_event_hash, r.event_hash) for r in A.build_chain(e).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "chain")).select("case_id", "event_sequence", "previous_event_hash", "event_hash").collect()} == want


def test_html_text_and_views(spark):
    r = spark.createDataFrame([("<head><title>x</title></head><style>p{}</style><p>A&amp;B</p><!-- c --> C",)], "h string").select(T.visible_text(F.col("h")).alias("t")).first()
    assert r.t == "A&B C"
    df = spark.createDataFrame([message("c", body_text="x" * 501)], PARSED)
    v = W.overview(df).first()
    assert v.sender == "Ann <a@corp.example>" and v.snippet == "x" * 500 + "..."
    none = spark.createDataFrame([], "case_id string, final_score double, final_assessment string, correlation_confidence string, coverage double, explanation string")
    states = spark.createDataFrame([("a", "queued"), ("b", "complete")], "case_id string, status string")
    assert {r.case_id: r.final_assessment for r in W.executive_summary(states, none).collect()} == {"a": "PENDING", "b": "INCONCLUSIVE"}


IPV6 = {"2002::1": "PRIVATE", "2001::1": "PRIVATE", "2001:10::1": "PRIVATE", "100::1": "PRIVATE", "::ffff:10.0.0.1": "PRIVATE", "::ffff:127.0.0.1": "LOOPBACK", "::ffff:8.8.8.8": "RESERVED",
        "zz:1": "INVALID", "::::": "INVALID", "1::2::3": "INVALID", "12345::1": "INVALID", "1:2:3:4:5:6:7": "INVALID", "::1": "LOOPBACK", "::": "PRIVATE", "fe80::1": "LINK_LOCAL", "fc00::5": "PRIVATE",
        "ff02::1": "MULTICAST", "2a00:1450::1": "GLOBAL", "2001:db8::5": "DOCUMENTATION", "64:ff9b::1": "RESERVED", "4000::1": "RESERVED", "2001:20::1": "GLOBAL"}


def test_classes_of_ipv6_addresses(spark):
    rows = spark.createDataFrame([(k,) for k in IPV6], "ip string").select("ip", G.classify_ip(F.col("ip")).alias("c"), G.is_reserved_or_documentation(F.col("ip")).alias("r")).collect()
    assert {r.ip: r.c for r in rows} == IPV6
    assert {r.ip for r in rows if r.r} == {k for k, c in IPV6.items() if c in ("DOCUMENTATION", "LOOPBACK", "LINK_LOCAL", "PRIVATE")}


def test_rerun_without_rows_leaves_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "case_id string, v int")
    S.write_results(rows, str(tmp_path / "r"))
    S.write_results(rows.where("case_id = 'z'"), str(tmp_path / "r"), cases=rows.where("case_id = 'a'"))
    assert [tuple(r) for r in S.latest(spark, str(tmp_path / "r")).select("case_id", "v").collect()] == [("b", 1)]


def test_splits_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("x", "train"), ("y", "test")], "text string, split string")
    S.write_splits(rows, str(tmp_path / "s"))
    assert {tuple(r) for r in S.read_splits(spark, str(tmp_path / "s"), "text string").select("text", "split").collect()} == {("x", "train"), ("y", "test")}


def test_messages_without_sender_and_nameless_parts():
    raw = b"To: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nhi\r\n--x\r\nContent-Type: application/pdf\r\n\r\nzz\r\n--x--\r\n"
    got = S.parse_bytes("c", raw)
    assert got["sender"] is None and [a["filename"] for a in got["attachments"]] == ["attachment_1"] and got["body_text"].strip() == "hi"


def test_lifecycle_of_failed_and_forced_cases(spark):
    rows = [("ok", True, True, True, True, True, True, True), ("bad", False, True, True, True, True, True, True), ("part", True, True, None, True, False, True, False)]
    df = spark.createDataFrame(rows, "case_id string, parser boolean, rules boolean, ml boolean, ioc boolean, geo boolean, correlation boolean, intact boolean")
    events = L.lifecycle_events(df, F.col("case_id") == "ok")
    got = {}
    for r in sorted(events.collect(), key=lambda r: r.event_sequence):
        got.setdefault(r.case_id, []).append(r.event_type)
    assert got["bad"] == ["PROCESSING_STARTED", "PARSER_STARTED", "PARSER_FAILED", "CASE_ANALYSIS_FAILED"]
    assert got["ok"][0] == "ANALYSIS_RERUN" and got["ok"][-2:] == ["CASE_ANALYSIS_COMPLETED", "EVIDENCE_INTEGRITY_VERIFIED"] and len(got["ok"]) == 16
    assert {"ML_FAILED", "GEO_FAILED", "EVIDENCE_INTEGRITY_FAILURE"} < set(got["part"])
    assert {r.case_id: r.status for r in L.case_status(events).collect()} == {"ok": "complete", "bad": "failed", "part": "complete"}


def test_mbox_keeps_bytes(spark, tmp_path):
    (tmp_path / "m.mbox").write_bytes(b"From a\nSubject: x\n\ncaf\xe9\nFrom b\nSubject: y\n\nna\xefve\nFrom c\nSubject: FOLDER INTERNAL DATA\n\n-\n")
    found = {bytes(r.content) for r in S.read_mbox(spark, str(tmp_path)).collect()}
    assert found == {b"Subject: x\n\ncaf\xe9", b"Subject: y\n\nna\xefve"}


def test_entities_in_text_and_links(spark):
    html = '<a href="http://a.test/?x=1&amp;y=2">l</a><script>"http://no.test"</script><title>http://t.test</title>caf&#233;&#x1F600;&#0;&#55296; &lt;b&gt;'
    row = spark.createDataFrame([(html,)], "html string").select(T.visible_text(F.col("html")).alias("t"), T.extract_urls(F.lit(None).cast("string"), F.col("html")).alias("u")).first()
    assert row.t == "l café\U0001f600&#0;&#55296; <b>" and row.u == ["http://a.test/?x=1&y=2", "http://t.test"]


def test_undecided_rules_say_so(spark):
    row = R.evaluate_rules(spark.createDataFrame([message(received_headers=None)], PARSED)).where("rule_id = 'RULE-HDR-001'").first()
    assert (row.matched, row.score, row.evidence) == (False, 0, R.UNDECIDED)


def test_digest_of_a_feed_reaches_the_summary(spark):
    feed = FE.valid_feed(FE.example_feed(spark)).withColumn("feed_sha256", F.concat(F.lit("of "), F.col("source")))
    parsed = spark.createDataFrame([message(urls=["http://bad-1.test/", "https://docs.example.org/"])], PARSED)
    row = I.summarise(I.match_indicators(I.extract_indicators(parsed), feed)).first()
    assert (row.feed_versions, row.feed_hashes) == ("1", "of feed-a,of feed-b")


def test_latest_view(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "case_id string, t int, x string")
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert {(r.case_id, r.x, r.found) for r in W.latest_view(cases, rows, "t").collect()} == {("a", "new", True), ("b", None, False)}
