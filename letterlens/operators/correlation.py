"""Correlation of the four signals into one assessment per case.

Every input has one row per case, so the join shuffles each once on case_id; all scoring after it is arithmetic within
the row. Entities are aggregated per case before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterlens.functions import urls as U

# Weights, factors and thresholds of the policy.
WEIGHTS = {"rules": 0.35, "ml": 0.30, "ioc": 0.25, "geo": 0.10}
OVERLAP_POINTS, OVERLAP_FACTOR = 2.5, 0.5
SEVERE_CONFIDENCE, SEVERE_SCORE = 85, 65.0
LEAST_COVERAGE, HIGH, ELEVATED = 40.0, 60.0, 25.0
#: Added before rounding, so that decimal halves go up whatever their binary form.
NUDGE = 1e-9
TRUST = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.25}
TOP, TOP_RULES = 10, 3
#: Who sees entities, in order of their names.
ENGINES = ("GEO", "IOC", "RULES")


def observations(matches: DataFrame, origins: DataFrame | None, parsed: DataFrame | None = None) -> DataFrame:
    """(case_id, entity_type, entity_value, engine). With parsed, hosts of links to raw addresses count for RULES."""
    value = F.lower(F.trim("normalized_value"))
    entity = lambda kind, x: F.struct(kind.alias("entity_type"), x.alias("entity_value"))
    host = F.when(F.col("ioc_type") == "URL", F.nullif(F.regexp_extract(value, r"https?://([^/:?#]+)", 1), F.lit("")))
    found = F.array_compact(F.array(entity(F.col("ioc_type"), value), F.when(host.isNotNull(), entity(F.lit("DOMAIN"), host))))
    ioc = matches.select("case_id", F.inline(found)).withColumn("engine", F.lit("IOC"))
    if origins is None:
        return ioc
    geo = origins.where("selected_origin_ip is not null").select("case_id", F.lit("IP").alias("entity_type"), F.lower("selected_origin_ip").alias("entity_value"), F.lit("GEO").alias("engine"))
    out = ioc.unionByName(geo)
    if parsed is not None:
        links = U.with_parts(parsed.select("case_id", F.explode("urls").alias("url")))
        h = F.col("host")
        raw = links.select("case_id", F.explode(F.array(F.when(h.rlike(U.IPV4) | h.rlike(U.IPV6), h))).alias("entity_value")).where("entity_value is not null")
        out = out.unionByName(raw.select("case_id", F.lit("IP").alias("entity_type"), "entity_value", F.lit("RULES").alias("engine")))
    return out


def entities(seen: DataFrame) -> DataFrame:
    """A row per case and entity with its engines (of ENGINES), and whether two engines or more saw it."""
    by = {e: F.col(f"_{e}") for e in ENGINES}
    rows = seen.groupBy("case_id", "entity_type", "entity_value").agg(F.count("*").alias("observations"), *[F.bool_or(F.col("engine") == e).alias(f"_{e}") for e in by])
    return rows.select("case_id", "entity_type", "entity_value", F.concat_ws(",", *[F.when(c, e) for e, c in by.items()]).alias("engines"), "observations",
                       (sum((F.coalesce(c.cast("int"), F.lit(0)) for c in by.values()), F.lit(0)) >= 2).alias("is_cross_engine"))


def crossed(indicators: DataFrame, origins: DataFrame, parsed: DataFrame) -> DataFrame:
    """The entities that two engines or more saw, which are addresses, as only the indicators see other than those."""
    seen = observations(indicators.where("ioc_type = 'IP'"), origins, parsed)
    return entities(seen.where("entity_type = 'IP'")).where("is_cross_engine")


def entity_graph(matches: DataFrame, origins: DataFrame, parsed: DataFrame) -> DataFrame:
    """entities(observations(matches, origins, parsed)). Addresses are grouped over all engines, which takes a shuffle.

    What else the indicators see no other engine does; it is grouped as it is dealt, by case.
    """
    addresses = observations(matches.where("ioc_type = 'IP'"), origins, parsed).where("entity_type = 'IP'")
    others = observations(matches.where("ioc_type <> 'IP'"), None)
    return entities(others).unionByName(entities(addresses))


def ioc_signal(malicious: Column, suspicious: Column, benign: Column) -> Column:
    return (F.when(malicious.isNotNull(), 0.85 + 0.15 * malicious / 100).when(suspicious.isNotNull(), 0.50 + 0.15 * suspicious / 100)
            .when(benign, 0.05).otherwise(0.0))


def geo_signal(confidence: Column, tor: Column, vpn: Column, proxy: Column, hosting: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    risk = (F.when(yes(tor), 0.40).otherwise(0.0) + F.when(yes(vpn) | yes(proxy), 0.25).otherwise(0.0) + F.when(yes(hosting) & ~yes(tor), 0.15).otherwise(0.0))
    trust = F.lit(0.0)
    for name, x in TRUST.items():
        trust = F.when(confidence == name, x).otherwise(trust)
    return F.round(F.least(F.lit(1.0), risk * trust), 4)


def correlate(cases: DataFrame, rules: DataFrame | None, ml: DataFrame | None, iocs: DataFrame, geo: DataFrame, graph: DataFrame) -> DataFrame:
    """One row per case.

    cases: case_id, and parsed (whether the message was parsed). rules: total_score. ml: model_status,
    phishing_probability. Where one of these is None, cases have its columns. iocs: summaries of indicators. geo: traced origins. graph: entities. A missing row makes a
    signal unavailable, but a parsed case without indicators has an indicator signal of 0.
    """
    cross = graph.where("is_cross_engine").groupBy("case_id").agg(F.count("*").alias("cross_entities"))
    if ml is not None:
        cases = cases.join(ml.select("case_id", "model_status", "phishing_probability").hint("merge"), "case_id", "left")
    if rules is not None:
        cases = cases.join(rules.select("case_id", "total_score").hint("merge"), "case_id", "left")
    on = (cases.join(iocs.select("case_id", "malicious_confidence", "suspicious_confidence", "benign", "disputed", F.lit(True).alias("has_iocs")).hint("merge"), "case_id", "left")
          .join(geo.select("case_id", F.col("confidence").alias("origin_confidence"), "is_tor_exit", "is_vpn", "is_proxy", "is_datacenter_hosting").hint("merge"), "case_id", "left")
          .join(cross.hint("merge"), "case_id", "left"))  # merged: by their bytes on disk, compressed, tables look smaller than what a driver would hold
    signal = {
        "rules": F.when(F.col("total_score").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("total_score"))) / 100),
        "ml": F.when(F.col("model_status") == "ready", F.col("phishing_probability")),
        "ioc": F.when(F.coalesce("has_iocs", F.lit(False)) | F.col("parsed"), ioc_signal(F.col("malicious_confidence"), F.col("suspicious_confidence"), F.coalesce("benign", F.lit(False)))),
        "geo": F.when(F.col("origin_confidence").isNotNull(), geo_signal(F.col("origin_confidence"), *[F.col(c) for c in ("is_tor_exit", "is_vpn", "is_proxy", "is_datacenter_hosting")]))}
    on = on.select("case_id", "disputed", "malicious_confidence", F.coalesce("cross_entities", F.lit(0)).alias("cross_entities"), *[s.cast("double").alias(f"{n}_signal") for n, s in signal.items()])
    there = lambda n: F.col(f"{n}_signal").isNotNull()
    base = sum((F.when(there(n), w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    on = on.withColumn("base", base).withColumn("coverage", F.round(F.col("base") * 100, 1))
    for n, w in WEIGHTS.items():
        weight = F.coalesce(F.round(F.try_divide(F.lit(w), F.col("base")), 4), F.lit(0.0))
        on = on.withColumn(f"{n}_points", F.when(there(n), F.round(F.col(f"{n}_signal") * weight * 100 + NUDGE, 2)).otherwise(0.0))
    r, m = F.col("rules_signal"), F.col("ml_signal")
    disagree = F.when((r >= 0.60) & (m <= 0.30), "rules high, text low").when((r <= 0.25) & (m >= 0.70), "text high, rules low")
    conflicts = F.array_compact(F.array(disagree, F.when(F.col("disputed"), "feeds disagree")))
    on = (on.withColumn("discount", F.round(F.col("cross_entities") * OVERLAP_POINTS * OVERLAP_FACTOR, 2))
          .withColumn("base_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((F.col(f"{n}_points") for n in WEIGHTS), F.lit(0.0)) - F.col("discount"))))
          .withColumn("severe", F.coalesce(F.col("malicious_confidence") >= SEVERE_CONFIDENCE, F.lit(False))).withColumn("conflicts", conflicts))
    on = on.withColumn("final_score", F.round(F.when(F.col("severe"), F.greatest("base_score", F.lit(SEVERE_SCORE))).otherwise(F.col("base_score")) + NUDGE, 1))
    n = F.size("conflicts")
    score, coverage = F.col("final_score"), F.col("coverage")
    on = (on.withColumn("final_assessment", F.when(coverage < LEAST_COVERAGE, "INCONCLUSIVE").when(score >= HIGH, "HIGH_RISK").when(score >= ELEVATED, "SUSPICIOUS").otherwise("BENIGN"))
          .withColumn("correlation_confidence", F.when((coverage >= 90) & (n == 0), "HIGH").when((coverage >= 60) & (n <= 1), "MEDIUM").otherwise("LOW")))
    missing = F.concat_ws(", ", *[F.when(~there(e), e.upper()) for e in WEIGHTS])
    limits = F.array_compact(F.array(
        F.when(coverage < 100, F.concat(F.lit("unavailable: "), missing)), F.when(F.col("cross_entities") > 0, F.format_string("%d entities seen by several engines", "cross_entities")),
        F.when(F.col("severe") & (F.col("base_score") < SEVERE_SCORE), "raised by a severe indicator"), F.when(coverage < LEAST_COVERAGE, "coverage too low")))
    words = F.concat_ws(" ", F.format_string("%s (score %.1f of 100, confidence %s).", "final_assessment", "final_score", "correlation_confidence"),
                        F.when(r >= 0.40, F.format_string("Rules found notable anomalies (%.1f points).", "rules_points")), F.when(m >= 0.60, F.format_string("The text reads as phishing (%.2f).", "ml_signal")),
                        F.when(F.col("malicious_confidence").isNotNull(), "Indicators match known malicious infrastructure."),
                        F.when(F.col("geo_signal") >= 0.20, "The origin is an anonymising relay."), F.when(n > 0, F.concat(F.lit("Conflicts: "), F.concat_ws("; ", "conflicts"), F.lit("."))))
    return on.withColumn("limitations", limits).withColumn("explanation", words).drop("base", "disputed", "malicious_confidence")


def top_evidence(matches: DataFrame, hits: DataFrame, ml: DataFrame, geo: DataFrame, cases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` items of evidence of a case: malicious indicators, the three best rules, text, relay.

    Each kind is ranked and cut within its case before the kinds meet; a case without evidence gets a row saying so.
    """
    from pyspark.sql import Window

    def item(df, tier, order, engine, kind, impact):
        return df.select("case_id", F.lit(tier).alias("tier"), order.alias("place"), F.lit(engine).alias("engine"), kind.alias("evidence_type"), impact.alias("impact"))
    rule = Window.partitionBy("case_id").orderBy(F.desc("score"), "rule_id")
    rules = hits.where("matched").withColumn("n", F.row_number().over(rule)).where(F.col("n") <= TOP_RULES)
    tor, vpn = F.coalesce("is_tor_exit", F.lit(False)), F.coalesce("is_vpn", F.lit(False))
    parts = [
        item(matches.where("status = 'known_malicious'"), 1, F.concat_ws("/", "ioc_id", "source"), "IOC", F.col("normalized_value"), F.lit("high")),
        item(rules, 2, F.col("n").cast("string"), "RULES", F.col("rule_id"), F.when(F.col("score") >= 15, "high").otherwise("medium")),
        item(ml.where("model_status = 'ready' and phishing_probability >= 0.65"), 3, F.lit(""), "ML", F.lit("phishing_probability"), F.when(F.col("phishing_probability") >= 0.85, "high").otherwise("medium")),
        item(geo.where(tor | vpn), 4, F.lit(""), "GEO", F.when(tor, "tor_routing").otherwise("vpn_routing"), F.when(tor, "medium").otherwise("low"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("tier", "place"))).where(F.col("rank") <= top)
    return cases.select("case_id").join(ranked.hint("merge"), "case_id", "left").select(
        "case_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("engine", F.lit("CORRELATION")).alias("engine"),
        F.coalesce("evidence_type", F.lit("baseline_clear")).alias("evidence_type"), F.coalesce("impact", F.lit("low")).alias("impact"))
