"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterlens.functions import html_text as HT
from letterlens.functions import text as T
from letterlens.functions import urls as U
from letterlens.operators import audit as A
from letterlens.operators import classifier as M
from letterlens.operators import correlation as C
from letterlens.operators import corpus as K
from letterlens.operators import indicators as I
from letterlens.operators import origin as G
from letterlens.operators import report as RP
from letterlens.operators import rule_texts as RT
from letterlens.operators import rules as R
from letterlens.operators import views as W
from letterlens.plans.stored import Stored
from letterlens.shared import new_folder, write_once
from letterlens.sources import archives as AR
from letterlens.sources import feeds as FE
from letterlens.sources import indicator_sources as SO
from letterlens.sources import mail as S
from letterlens.sources import mail_view as V
from letterlens.sources import result_tables as RS


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    """The derived mail for the rules, whose terms are looked for once in each document."""
    return V.parsed_mail(spark, d, R.searched)


def flagship_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return R.score_rules(_ruled(spark, d)).groupBy("rules_verdict").agg(F.count("*").alias("messages"), F.avg("total_score").alias("mean_score"))


def r_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.evaluate_rules(_ruled(spark, d), evidence=False)


def r_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.score_rules(_ruled(spark, d))


def r_scores_of_stored_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.score_hits(R.evaluate_rules(_ruled(spark, d), evidence=False))


def r_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rules(_ruled(spark, d))


def u_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return V.parsed_mail(spark, d).select("case_id", F.explode("urls").alias("url")).select(
        "case_id", "url", U.host(u).alias("host"), U.normal_url(u).alias("normal"), U.part(u, "authority").alias("authority"))


def i_indicators(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_indicators(V.parsed_mail(spark, d))


def i_matches(spark: SparkSession, d: str) -> DataFrame:
    return I.match_indicators(i_indicators(spark, d), FE.valid_feed(FE.example_feed(spark)))


def i_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.summarise_lookup(i_indicators(spark, d), FE.valid_feed(FE.example_feed(spark)))


def g_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = G.candidates(V.parsed_mail(spark, d)).withColumn("c", F.explode("candidate_ips"))
    place = F.array_position(F.filter("candidate_ips", lambda x: x.hop_index == F.col("c.hop_index")), F.col("c"))
    return found.select("case_id", "c.hop_index", place.cast("int").alias("place"), "c.ip", "c.classification", "c.reverse_dns_hint")


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return G.trace_origin(V.parsed_mail(spark, d), FE.example_geo(spark), FE.example_intel(spark))


def g_origins(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).drop("candidate_ips", "limitations")


def g_origins_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).groupBy(F.coalesce("origin_class", F.lit("none")).alias("origin_class"), "confidence").agg(F.count("*").alias("messages"))


def c_entities(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False, keep_matches=False).graph


def c_assessments(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False, lean=True).assessed.select("case_id", "rules_signal", "ml_signal", "ioc_signal", "geo_signal", "coverage", "cross_entities", "severe", "final_score", "final_assessment",
                                            "correlation_confidence", F.concat_ws(";", "conflicts").alias("conflicts"))


def c_explanations(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False, lean=True).assessed.select("case_id", "explanation", F.concat_ws("; ", "limitations").alias("limitations"))


def c_trained_assessments(spark: SparkSession, d: str) -> DataFrame:
    """The assessments with the text signal of the trained classifier, which scores the whole mail."""
    store = Stored(spark, d, raw=False, lean=True)
    text, enough = T.composite(F.col("subject"), F.col("body_text"), F.col("body_html"))
    samples = V.flat_mail(spark, d).select(F.col("case_id").alias("doc"), text.alias("text"), enough.alias("enough"))
    scored = M.score(samples, M.fit(_splits(spark, d).where("split = 'train'"))).join(samples.select("doc", "enough"), "doc")
    ml = M.with_fallbacks(scored, F.lit(True), F.col("enough")).select(F.col("doc").alias("case_id"), "model_status", F.col("probability").alias("phishing_probability"))
    return store.correlated(ml).select("case_id", "rules_signal", "ml_signal", "ioc_signal", "geo_signal", "coverage", "final_score", "final_assessment", "correlation_confidence")


def c_top_evidence(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False, lean=True).evidence


def _page_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def p_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _page_columns(spark, d).select("page_id", T.visible_text(F.col("html")).alias("text"))


def p_exact_text(spark: SparkSession, d: str) -> DataFrame:
    return _page_columns(spark, d).select("page_id", HT.exact_visible_text(F.col("html")).alias("text"))


def p_text_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the path of patterns compares with the tokeniser on all pages: equal texts, words of each, words found by both."""
    both = _page_columns(spark, d).select(T.visible_text(F.col("html")).alias("fast"), HT.exact_visible_text(F.col("html")).alias("exact"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    w = both.select(F.expr("fast = exact").alias("same"), words("fast").alias("f"), words("exact").alias("e"))
    return w.agg(F.count("*").alias("pages"), F.count_if("same").alias("equal_pages"), F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("exact_words"),
                 F.coalesce(F.sum(F.size(F.array_intersect("e", "f"))), F.lit(0)).alias("common_distinct"), F.coalesce(F.sum(F.size(F.array_distinct("e"))), F.lit(0)).alias("exact_distinct"),
                 F.coalesce(F.sum(F.size(F.array_distinct("f"))), F.lit(0)).alias("fast_distinct"))


def p_urls(spark: SparkSession, d: str) -> DataFrame:
    return _page_columns(spark, d).select("page_id", F.concat_ws(" ", T.extract_urls(F.col("url"), F.col("html"))).alias("urls"))


def p_white_space(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.clean_space(F.col("text")).alias("text"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples: label 1 is low quality, the source stands for a mailbox."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text, enough = T.composite(F.lit(""), F.col("text"), F.lit(None).cast("string"))
    return docs.join(labels, "doc_id").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("seq"), (1 - F.col("quality")).alias("label"),
                                              T.content_hash(F.lit(""), F.col("text"), F.lit(None).cast("string")).alias("content_hash"), enough.alias("usable"), text.alias("text"))


def m_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return K.keep_first(_samples(spark, d)).select("source", "seq", "label", "content_hash", "copies")


def m_dedupe_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.dedupe_counts(K.keep_first(_samples(spark, d)))


def m_capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return K.capped_sample(_samples(spark, d)).select("source", "seq", "content_hash")


def m_split(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of all texts are made and written once; what follows reads no text."""
    keys = write_once(_samples(spark, d).select("source", "seq", "label", "content_hash"), new_folder(spark, "hashes"))
    return K.split(K.keep_first(keys)).select("content_hash", "label", "split")


def m_split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return K.manifest(m_split(spark, d))


def m_split_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return K.overlaps(write_once(m_split(spark, d), new_folder(spark, "split")))


def m_profile(spark: SparkSession, d: str) -> DataFrame:
    return K.profile(_samples(spark, d))


def _doc_texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")


def m_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return M.most_frequent(M.frequencies(_doc_texts(spark, d)))


def m_tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = _doc_texts(spark, d)
    return M.weights(docs, M.most_frequent(M.frequencies(docs)).select("term", "df"), docs.count()).select("doc", "term", F.round("weight", 6).alias("weight"))


def _given_scores(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in score, from the share of marks in a text."""
    marks = F.length(F.regexp_replace("text", r"[^!*#$%&|]", ""))
    return _samples(spark, d).select(F.col("seq").alias("doc"), "source", "label", F.least(F.lit(1.0), marks / 40.0).alias("probability"))


def m_predictions(spark: SparkSession, d: str) -> DataFrame:
    return M.with_fallbacks(_given_scores(spark, d), F.lit(True), F.col("doc") % 50 != 0)


def m_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(_given_scores(spark, d), 0.5)


def m_external_rates(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(_given_scores(spark, d), 0.5, "source").select("source", "tp", "fp", "fn", "tn", "false_positive_rate")


def m_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_auc(_given_scores(spark, d))


def m_errors(spark: SparkSession, d: str) -> DataFrame:
    return M.errors(_given_scores(spark, d))


def m_trained_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the train split, measured on the test split."""
    parts = _splits(spark, d)
    test = parts.where("split = 'test'")
    scored = M.score(test, M.fit(parts.where("split = 'train'"))).join(test.select("doc", "label"), "doc")
    return M.evaluate(scored).crossJoin(M.roc_auc(scored))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a case log: a user is a case."""
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.format_string("CASE-%010d", "user_id").alias("case_id"), F.struct("ts", "event_id").alias("place"), "event_type", F.col("ts").alias("event_timestamp"),
        F.lit("SYSTEM").alias("actor_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise("worker").alias("actor_id"), F.concat(F.lit('said "é" '), F.col("event_id").cast("string")).alias("message"),
        F.col("props").alias("metadata"))


def a_chain(spark: SparkSession, d: str) -> DataFrame:
    return A.build_chain(_events(spark, d)).select("case_id", "event_sequence", "event_type", "previous_event_hash", "event_hash")


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """A chain in which messages were changed, rows deleted and numbers repeated."""
    chain = A.build_chain(_events(spark, d))
    n = F.conv(F.substring("event_hash", 1, 4), 16, 10).cast("int")
    return (chain.withColumn("message", F.when(n % 23 == 0, F.concat("message", F.lit("!"))).otherwise(F.col("message"))).where(n % 31 != 0)
            .withColumn("event_sequence", F.when(n % 37 == 0, F.col("event_sequence") - 1).otherwise(F.col("event_sequence"))))


def a_verify_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_rows(_tampered(spark, d))


def a_verify_cases(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_cases(_events(spark, d).select("case_id").distinct(), _tampered(spark, d))


def a_runs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("next", F.lead("event_timestamp").over(Window.partitionBy("case_id").orderBy("place")))
    return A.number_runs(e.select("case_id", F.col("event_type").alias("engine"), F.col("event_timestamp").alias("started_at"), F.col("next").alias("finished_at"))).drop("started_at", "finished_at")


def a_status(spark: SparkSession, d: str) -> DataFrame:
    return A.status(_events(spark, d)).select("case_id", "status")


def a_manifest(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, lean=True).artifacts


def a_composite_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.composite_hash(Stored(spark, d, lean=True).artifacts)


def a_case_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs of each case with status, output and error, in order of their start."""
    return Stored(spark, d).runs.orderBy("case_id", "started_at").drop("started_at", "finished_at")


def v_parsed_summary(spark: SparkSession, d: str) -> DataFrame:
    return W.parsed_summary(V.parsed_mail(spark, d, lambda t: F.substring(t, 1, 1), counts=True))


def v_overview(spark: SparkSession, d: str) -> DataFrame:
    return W.overview(V.parsed_mail(spark, d, lambda t: F.substring(t, 1, RP.SNIPPET + 1), counts=True))


def v_ioc(spark: SparkSession, d: str) -> DataFrame:
    return W.ioc_view(V.flat_mail(spark, d), i_summary(spark, d))


def v_ioc_findings(spark: SparkSession, d: str) -> DataFrame:
    return W.ioc_findings(i_matches(spark, d))


def v_hops(spark: SparkSession, d: str) -> DataFrame:
    return W.hop_section(V.parsed_mail(spark, d))


def v_executive_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose digest begins with 0 have not been correlated, complete or not."""
    store = Stored(spark, d, raw=False, lean=True)
    return W.executive_summary(store.status, store.assessed.where(F.substring(F.sha2("case_id", 256), 1, 1) != "0"))


def v_latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return W.latest_by(e.select(F.col("user_id").alias("case_id"), "ts", "event_id", "event_type"), "ts", "event_id").select("case_id", "event_id", "event_type")


def a_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False).events


def a_provenance(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, keep_matches=False).provenance


def v_status(spark: SparkSession, d: str) -> DataFrame:
    return Stored(spark, d, raw=False).status


def v_geo(spark: SparkSession, d: str) -> DataFrame:
    return W.geo_view(V.flat_mail(spark, d), _origins(spark, d).where("selected_origin_ip is not null"))


def v_reserved_ips(spark: SparkSession, d: str) -> DataFrame:
    return G.candidates(V.parsed_mail(spark, d)).select(F.explode("candidate_ips.ip").alias("ip")).distinct().withColumn("reserved", G.is_reserved_or_documentation(F.col("ip")))


def v_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = Stored(spark, d, lean=True).manifest
    return W.manifest_view(rows, A.composite_hash(rows))


def v_correlation(spark: SparkSession, d: str) -> DataFrame:
    store = Stored(spark, d, raw=False, lean=True)
    return W.correlation_view(store.flat, store.assessed)


def m_leaks(spark: SparkSession, d: str) -> DataFrame:
    return K.leaks(_samples(spark, d))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    """The split samples, written once, as a fit and its evaluation read them several times."""
    kept = write_once(K.keep_first(_samples(spark, d)), new_folder(spark, "kept"))
    return write_once(K.split(kept).select(F.col("seq").alias("doc"), "text", "label", "split"), new_folder(spark, "splits"))


def m_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document scored by the model that is fitted on the train split."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    scored = M.score(docs, M.fit(_splits(spark, d).where("split = 'train'")))
    return M.with_fallbacks(scored, F.lit(True), F.lit(True)).select("doc", "probability", "prediction", "confidence", "model_status")


def m_explanations(spark: SparkSession, d: str) -> DataFrame:
    """The terms that speak most for each side in every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    return M.explain(M.contributions(docs, M.fit(_splits(spark, d).where("split = 'train'"))))


def m_grid(spark: SparkSession, d: str) -> DataFrame:
    """F1 on the validation split of each candidate of the grid."""
    parts = _splits(spark, d)
    _, tried = M.grid_search(parts.where("split = 'train'"), parts.where("split = 'validation'"))
    return spark.createDataFrame([(i, t["c"], t["size"], t["terms"], t["f1"], t["passes"]) for i, t in enumerate(tried)], "candidate int, c double, size int, terms long, f1 double, passes int")


def m_model_card(spark: SparkSession, d: str) -> DataFrame:
    parts = _splits(spark, d)
    return M.model_card(M.fit(parts.where("split = 'train'")), parts).drop("training_seconds")  # reruns agree


def v_text(spark: SparkSession, d: str) -> DataFrame:
    """The last of two text results of each case; some cases have none."""
    store = Stored(spark, d, raw=False)
    last = store.ml.where("model_status = 'ready'").withColumn("run", F.lit(2))
    first = last.withColumns({"phishing_probability": 1 - F.col("phishing_probability"), "run": F.lit(1)})
    return W.latest_view(store.flat, first.unionByName(last), "run")


def v_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The last of two provenance rows of each case, the first of which lacks the feed."""
    store = Stored(spark, d, keep_matches=False)
    last = store.provenance.withColumn("run", F.lit(2))
    first = last.withColumns({"ioc_feed_version": F.lit(None).cast("string"), "run": F.lit(1)})
    return W.latest_view(store.flat, first.unionByName(last), "run")


def v_timeline(spark: SparkSession, d: str) -> DataFrame:
    return a_chain(spark, d).orderBy("case_id", "event_sequence")


def v_report(spark: SparkSession, d: str) -> DataFrame:
    store = Stored(spark, d, RP.SNIPPET + 1)
    reports = RP.report(cases=store.flat.join(store.status.hint("merge"), "case_id"), parsed=store.parsed, hits=RT.with_texts(R.evaluate_rules(store.parsed)), scores=store.scores, ml=store.ml_results, matches=store.matches,
                        origins=store.origins, assessed=store.assessed, evidence=store.evidence, graph=store.graph, chain=store.chain, errors=A.verify_rows(store.chain), runs=store.runs,
                        provenance=store.provenance, manifest=store.manifest)
    return reports.select("case_id", "report_sha256", "report_json")


def p_parse_rendered_mail(spark: SparkSession, d: str) -> DataFrame:
    """The derived mail rendered as bytes and parsed back."""
    return S.parse_mail(S.rfc822(V.flat_mail(spark, d))).select("case_id", "subject", F.size("received_headers").alias("hops"), F.concat_ws(" ", "urls").alias("urls"), "parser_status")


def a_pending(spark: SparkSession, d: str) -> DataFrame:
    """Cases that lack a result in one of six bucketed tables, and which engines' results they lack."""
    store, run = Stored(spark, d, raw=False, lean=True), uuid.uuid4().hex[:12]
    ids = lambda df: df.select("case_id").distinct()
    results = {"parsed": ids(store.mail.where("sender.domain <> ''")), "rules": ids(store.scores), "ml": ids(store.ml.where("model_status = 'ready'")), "ioc": ids(I.values(store.mail, store.files).join(store.mail.select("case_id").hint("merge"), "case_id", "left_semi")),
               "geo": ids(store.origins.where("selected_origin_ip is not null")), "correlation": ids(store.assessed)}
    names = {k: f"letterlens_{run}_{k}" for k in ("cases", *RS.ENGINES)}
    for k, rows in {"cases": ids(store.flat), **results}.items():
        RS.keep_bucketed(rows, f"{store.folder}/ids-{k}", table=names[k])
    pending = RS.pending_of_tables(spark, names["cases"], [names[k] for k in RS.ENGINES])
    return pending.join(RS.completeness(spark, names["cases"], {k: names[k] for k in RS.ENGINES}).hint("merge"), "case_id")


def i_source_matches(spark: SparkSession, d: str) -> DataFrame:
    """The indicators of all mail against three sources that are plugged in, one of which fails."""
    given = [dict(zip(("source", "type", "value", "status", "confidence", "reason"), r, strict=True)) | {"feed_version": "1"} for r in FE.EXAMPLE_INDICATORS]
    sources = [SO.Records(n, tuple(r for r in given if r["source"] == n)) for n in ("feed-a", "feed-b")]
    sources.append(SO.JsonFeed("feed-c", "file:///nowhere/feed.json"))
    matches = SO.match_sources(i_indicators(spark, d), sources)
    return matches.groupBy("case_id", "source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("known_malicious", "suspicious", "known_benign", "not_found", "error")])


def g_network_origins(spark: SparkSession, d: str) -> DataFrame:
    """Origins in networks of many lengths, which are made from the suppliers; the longest one counts."""
    k = F.col("s_suppkey")
    base = F.when(k % 3 == 0, F.concat(F.lit("45.83."), (k % 100).cast("string"), F.lit("."), (k % 256).cast("string"))).when(
        k % 3 == 1, F.concat(F.lit("203.0.113."), (k % 40).cast("string"))).otherwise(F.concat(F.lit("185.220.101."), (k % 30).cast("string")))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(base, F.lit("/"), (F.lit(8) + k % 25).cast("string")).alias("ip"), F.concat(F.lit("N"), F.lpad((k % 97).cast("string"), 2, "0")).alias("country_code"),
                                                              (F.lit(64500) + k % 50).cast("int").alias("asn"), F.when(k % 2 == 0, (k % 90).cast("int")).alias("accuracy_radius_km"), F.lit("2").alias("version"), F.lit("ab" * 32).alias("feed_sha256"))
    intel = FE.example_intel(spark).withColumns({"version": F.lit("3"), "feed_sha256": F.lit("cd" * 32)})
    out = G.enrich(G.select_origin(G.candidates(V.parsed_mail(spark, d))), rows, intel)
    return out.select("case_id", "selected_origin_ip", "country_code", "asn", "accuracy_radius_km", "is_tor_exit", "intel_source", "geo_database_version", "geo_database_sha256", "network_feed_version", "network_feed_sha256")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages of a mailbox, their source."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("message"))


def s_mail_csv(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as quoted CSV and read back by ranges of bytes."""
    to = new_folder(spark, "mail-csv")
    _messages(spark, d).write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(to)
    rows = S.read_mail_csv(spark, to)
    return rows.select("path", "mailbox", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256).alias("sha256"))


def s_mail_archive(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as bzip2 tar archives and read back block by block."""
    to = new_folder(spark, "mail-archives")
    AR.write_archives(_messages(spark, d).select(F.col("file").alias("name"), F.encode(F.concat("message", F.lit("\n")), "UTF-8").alias("content")), to)
    return S.read_archives(spark, to).select(F.regexp_extract("path", "#(.*)$", 1).alias("name"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def r_rule_texts(spark: SparkSession, d: str) -> DataFrame:
    """What matched rules say, counted over all mail."""
    return RT.with_texts(R.count_rules(_ruled(spark, d))).select("rule_id", "rule_name", "message", "rationale", "remediation", "matched")
