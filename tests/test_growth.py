"""What keeps the work of a query in proportion to its tables: texts searched once, terms counted in rows, no unmeasured broadcasts."""

from pathlib import Path

from pyspark.sql import functions as F

from letterlens.functions import urls as U
from letterlens.operators import audit as A
from letterlens.operators import classifier as M
from letterlens.operators import correlation as C
from letterlens.operators import indicators as I
from letterlens.operators import networks as N
from letterlens.operators import origin as G
from letterlens.operators import rules as R
from letterlens.plans import queries as Q
from letterlens.plans.stored import Stored
from letterlens.shared import new_folder, write_once
from letterlens.sources import feeds as FE
from letterlens.sources import mail_view as V
from letterlens.sources import result_tables as RS

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_find_in_the_short_text_what_they_find_in_the_whole(spark):
    words = "x" * 300
    texts = [None, "", "otp", words, f"URGENT {words} Legal action {words}", f"{words} account will be", f"{words} final", f"final {words}", f"{words} PIN", f"Key {words} banK account {words}İ"]
    ends = ["", " notice", " number", " closed today", " action", "t now"]
    rows = [(f"{i}-{j}", t, e) for i, t in enumerate(texts) for j, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "id string, text string, end string")
    terms = [t for r in R.CATALOGUE if r.category == "content" for t in r.terms]
    def found(text):
        low = F.lower(F.concat(F.coalesce(text, F.lit("")), F.col("end")))
        return F.array(*[F.contains(low, F.lit(t)) for t in terms])
    for head in (0, 501):
        out = df.select(found(F.col("text")).alias("whole"), found(R.searched(F.col("text"), head)).alias("short")).collect()
        assert all(r.whole == r.short for r in out) and any(any(r.whole) for r in out)
    assert df.select(F.max(F.length(R.searched(F.col("text"))))).first()[0] < 150


def test_attachment_lists_are_the_rows_of_attachments(spark):
    rows = V.attachments(spark, SF).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("n", "filename", "size", "sha256"))).alias("a"))
    want = {r.case_id: [tuple(x)[1:] for x in r.a] for r in rows.collect()}
    got = {r.case_id: [(x.filename, x["size"], x.sha256) for x in r.attachments] for r in V.attachment_lists(spark, SF).collect()}
    assert got == want and len(got) > 100


def test_no_text_goes_into_the_messages_that_are_stored(spark):
    assert Stored(spark, SF).parsed.agg(F.max(F.length("body_text"))).first()[0] < 1500


def test_tables_of_cases_are_not_broadcast(spark):
    store = Stored(spark, SF)
    assert "Broadcast" not in _plan(store.log) and "Broadcast" not in _plan(store.runs) and "Broadcast" not in _plan(store.status)


def test_terms_counted_in_rows_are_those_counted_by_groups(spark):
    texts = [(1, "Ada lent Ada a bóok, a bóok!"), (2, None), (3, ""), (4, "one"), (5, "ada lent one ét _x 12"), (6, "Слово два ada lent")]
    key = lambda rows: sorted(tuple(r) for r in rows)
    for more in ([], [(1, "ada lent"), (None, "ada"), (None, "lent ada")]):  # docs of one row, and of several
        df = spark.createDataFrame(texts + more, "doc long, text string")
        tf = M.counts(df)
        vocab = M.vocabulary(tf, 8)
        assert key(M.most_frequent(M.frequencies(df), 8).collect()) == key(vocab.collect())
        want = {(r.doc, r.term): r.weight for r in M.tfidf(tf, vocab, 6).collect() if r.doc is not None}
        got = {(r.doc, r.term): r.weight for r in M.weights(df, vocab.select("term", "df"), 6).collect() if r.doc is not None}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_counting_terms_shuffles_no_row_per_term_and_text(spark):
    docs = Q._doc_texts(spark, SF)
    vocab = M.most_frequent(M.frequencies(docs), 50).select("term", "df")
    assert "Exchange hashpartitioning" not in _plan(M.weights(docs, vocab, 10))


def test_chain_is_read_once_to_verify_cases(spark):
    events = Q._events(spark, SF)
    assert _plan(A.verify_cases(events.select("case_id").distinct(), Q._tampered(spark, SF))).count("MapInArrow") == 1


def test_escapes_of_few_and_of_many_kinds(spark):
    import json
    texts = ["plain", "said é é \U0001f600", "".join(map(chr, range(0x4E00, 0x4E60))) + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(A.ascii_escaped(F.col("t"))).collect()] == [json.dumps(t)[1:-1] for t in texts]


def test_what_joins_stored_tables_by_case_moves_no_rows(spark):
    store = Stored(spark, SF)
    for df in (I.summarise(store.matches), store.provenance, store.flat.join(store.origins.hint("merge"), "case_id"), A.verify_rows(store.chain)):
        assert "Exchange" not in _plan(df)


def test_small_feeds_of_few_lengths_shuffle_nothing(spark):
    store = Stored(spark, SF)
    assert "Exchange hashpartitioning(_ip" not in _plan(G.trace_origin(store.parsed, FE.example_geo(spark), FE.example_intel(spark)))
    ips = [(1, "10.1.2.3"), (2, "10.1.9.9"), (3, "2001:db8::7"), (4, "no address"), (5, None), (6, "11.0.0.1"), (7, "10.1.2.3")]
    rows = spark.createDataFrame(ips, "id int, ip string")
    feed = N.networks(spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.2.0/24", "b"), ("2001:db8::/32", "c"), ("10.1.2.0/24", "d")], "ip string, field string"))
    got = {r.id: (r.field, r.matched_prefix) for r in N.longest_match(rows, "ip", feed, ["field"]).collect()}
    assert got == {1: ("b", 24), 2: ("a", 8), 3: ("c", 32), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("b", 24)}
    assert got == {r.id: (r.field, r.matched_prefix) for r in N.longest_match(rows, "ip", feed, ["field"], limit=0).collect()}


def test_counts_of_attachments_are_the_sizes_of_their_lists(spark):
    lists = {r.case_id: r[1] for r in V.parsed_mail(spark, SF).select("case_id", F.size("attachments")).collect()}
    counts = V.parsed_mail(spark, SF, counts=True)
    assert {r.case_id: r.attachment_count for r in counts.select("case_id", "attachment_count").collect()} == lists
    assert "collect_list" not in _plan(Q.v_overview(spark, SF))


def test_rules_are_counted_and_listed_without_evidence_as_with_it(spark):
    parsed = write_once(V.parsed_mail(spark, SF, R.searched), new_folder(spark, "rules")).where("case_id < 'CASE-0000000400'")
    whole, key = R.evaluate_rules(parsed), lambda df: sorted(map(tuple, df.collect()))
    bare = R.evaluate_rules(parsed, evidence=False)
    assert bare.dtypes == whole.drop("evidence").dtypes and key(bare) == key(whole.drop("evidence"))
    want = whole.groupBy("rule_id", "category", "severity").agg(F.count("*").alias("evaluated"), F.count_if("matched").alias("matched"), F.sum("score").alias("points"))
    assert key(R.count_rules(parsed)) == key(want) and R.count_rules(parsed.where("false")).count() == 0
    assert "Generate" not in _plan(R.count_rules(parsed)).split("HashAggregate", 1)[1]


def test_stored_mail_holds_no_digests_and_gives_them_back(spark):
    store, key = Stored(spark, SF, keep_matches=False), lambda df: sorted(map(str, df.collect()))
    whole = V.parsed_mail(spark, SF, R.searched, cases=True, raw=True)
    assert key(store.parsed.select("case_id", "case", "attachments")) == key(whole.select("case_id", "case", "attachments"))
    kept = spark.read.parquet(f"{store.folder}/parsed")
    assert kept.where("exists(attachments.sha256, x -> x is not null)").isEmpty() and "sha256" not in kept.schema["case"].dataType.simpleString()
    assert store.matches.count() == 2 * store.indicators.count() and "matches" not in store.matches.inputFiles()[0]


def test_summary_by_lookup_and_graph_in_parts_are_those_of_matches(spark):
    store, key = Stored(spark, SF, raw=False), lambda df: sorted(map(str, df.collect()))
    odd = store.feed.withColumns({"feed_version": F.concat("source", (F.col("confidence") % 3).cast("string")), "feed_sha256": F.when(F.col("status") != "suspicious", "ab")})
    for feed, sources in ((store.feed, None), (odd, ["feed-a", "gone", "feed-b"]), (odd, ["feed-b"])):
        want = I.summarise(I.match_indicators(store.indicators, feed, sources))
        got = I.summarise_lookup(store.indicators, feed, sources)
        assert got.dtypes == want.dtypes and key(got) == key(want)
    whole = C.entities(C.observations(store.matches, store.origins, store.parsed))
    assert key(store.graph) == key(whole)
    cross = ["case_id", "entity_type", "entity_value", "engines"]
    assert key(C.crossed(store.indicators, store.origins, store.parsed).select(cross)) == key(whole.where("is_cross_engine").select(cross))
    assert "collect_set" not in _plan(I.summarise_lookup(store.indicators, store.feed))


def test_parts_of_urls_are_those_of_the_pattern(spark):
    urls = [None, "", ":", "//", "a:b", "a/b:c", "http:", "http:/x", "http://", "://h/p", "http://h?q#f", "http://h#f?q", "//h:80/p", "x y://u@h:1\n/p\n?q\n#f\ng", "HTTP://[::1]:80?#", "a:b:c//d", " http://H "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select(U.parts(F.col("u")).alias("p"), *[U.part(F.col("u"), n).alias(n) for n in ("scheme", "authority", "path")]).collect()
    assert [tuple(r.p) if r.p else (None,) * 3 for r in rows] == [(r.scheme, r.authority, r.path) for r in rows]


def test_stored_mail_is_dealt_one_side_after_the_other(spark):
    store, names = Stored(spark, SF, raw=False, keep_matches=False), []

    def keep(df, name):
        names.append(name)
        return RS.keep_bucketed(df, f"{new_folder(spark, 'sides')}/{name}", name == "files")
    assert "Exchange" not in _plan(V.parsed_mail(spark, SF, R.searched, digests=False, keep=keep)) and names == ["files", "messages"]
    assert "candidate_ips" not in store.origins.columns and store.parsed.count() == 1500
    assert {p.name for p in Path(store.folder.removeprefix("file://")).iterdir()} == {"parsed", "origins"}


def _odd_mail(spark):
    urls = [["http://User@H.test:80?q", " https://A.test:443/P?#f ", None, "//x", "http://198.51.100.12:80/verify?login", "https://[2001:db8::1]/Secure"], [], ["http://h.test./", "HTTP://B.test?x=1&y#z", "mailto:a@b.test", "http://localhost/%41%42%43%44"]]
    lines = [["from x 1.2.3.4 and 2001:db8::1 [fe80::1] 010.1.1.1", "from [10.0.0.1] 8.8.8.8 2606:4700::1111"], [], ["no", "1:2:3:4:5:6:7:8 127.0.0.1"]]
    files = [["invoice.pdf.exe", None, "a.JS"], [], ["", "notes.tar.gz"]]
    rows = [(f"c{i}", u, r, [(f, 1, "AB" * 32 if f else None) for f in fs]) for i, (u, r, fs) in enumerate(zip(urls, lines, files, strict=True))]
    return spark.createDataFrame(rows, "case_id string, urls array<string>, received_headers array<string>, attachments array<struct<filename:string,size:bigint,sha256:string>>").withColumns({
        "headers": F.create_map(F.lit("Reply-To"), F.array(F.lit("help@Reply-5.test"))), "sender": F.struct(F.lit("PayPal").alias("display_name"), F.lit("Evil.test.").alias("domain"), F.lit("x").alias("raw"), F.lit("x").alias("address")),
        "recipients": F.struct(F.array("sender").alias("to"), F.array("sender").alias("reply_to")), "subject": F.lit("s"), "body_text": F.lit("Act now"), "body_html": F.lit(None).cast("string")})


def test_what_is_found_row_by_row_is_what_is_found_in_lists(spark):
    key = lambda df: sorted(map(str, df.collect()))
    mails = ["case_id", "urls", "received_headers", "attachments", "headers", "sender", "recipients", "subject", "body_text", "body_html"]
    driver = V.parsed_mail(spark, SF, R.searched).where("case_id < 'CASE-0000000300'")
    for parsed in (write_once(_odd_mail(spark).select(mails), new_folder(spark, "odd")), write_once(driver.select(mails), new_folder(spark, "mail"))):
        files = parsed.select("case_id", F.inline("attachments"))
        what = ["case_id", "ioc_type", "normalized_value", "source_context"]
        assert key(I.values(parsed, files).select(what).distinct()) == key(I.extract_indicators(parsed).select(what).distinct()) and not I.values(parsed, files).isEmpty()
        assert key(I.values(parsed, types=["IP"]).distinct()) == key(I.values(parsed).where("ioc_type = 'IP'").distinct())
        apart = R.link_hits(parsed), R.file_hits(files)
        assert key(R.score_rules(parsed.drop("attachments"), apart=apart)) == key(R.score_rules(parsed))
        best = R.best_hits(parsed, 20, apart=apart).select("case_id", "rule_id", "score")
        assert key(best) == key(R.evaluate_rules(parsed, evidence=False).where("matched").select("case_id", "rule_id", "score"))
        want = G.select_origin(G.candidates(parsed)).withColumn("candidate_ips_count", F.size("candidate_ips")).drop("candidate_ips")
        assert key(G.count_candidates(parsed)) == key(want)
        feed = FE.valid_feed(FE.example_feed(spark))
        known = ["case_id", "malicious_confidence", "suspicious_confidence", "benign", "disputed"]
        assert key(I.outcomes(parsed, feed).select(known)) == key(I.summarise_lookup(I.extract_indicators(parsed), feed).where("matched > 0").select(known))


def test_lean_store_gives_what_the_whole_one_gives(spark):
    whole, lean, key = Stored(spark, SF), Stored(spark, SF, lean=True), lambda df: sorted(map(str, df.collect()))
    for name in ("assessed", "evidence", "artifacts"):
        a, b = getattr(whole, name), getattr(lean, name)
        assert key(a) == key(b.select(a.columns)), name
    assert "attachments" not in lean.mail.columns and {p.name for p in Path(lean.folder.removeprefix("file://")).iterdir()} == {"messages", "origins", "malicious"}


def test_evidence_behind_the_files_is_numbered_with_them(spark):
    """A malicious sender's indicator has a number behind those of the attachments."""
    stores = [Stored(spark, SF), Stored(spark, SF, raw=False, lean=True)]
    for s in stores:
        s.feed = s.feed.withColumn("status", F.when(F.col("ioc_type") == "DOMAIN", "known_malicious").otherwise(F.col("status")))
    cols = ["case_id", "ioc_id", "source", "normalized_value", "status"]
    want, got = stores[0].matches.where("status = 'known_malicious'"), stores[1].malicious.where("status = 'known_malicious'")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) and not want.where("normalized_value = 'microsoft-login.test'").isEmpty()
