"""The rule catalogue: each rule is a boolean Column with evidence over a parsed message.

All rules are evaluated in one projection; exploding them gives the long table, conditional sums give the scores, so no
row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterlens.functions import urls as U

VERSION = "1.0.0"
# Term lists, extensions, patterns, category caps and verdict thresholds that results depend on.
BRANDS = ("microsoft", "apple", "google", "paypal", "amazon", "netflix", "bank of america", "chase", "wells fargo", "it support", "helpdesk",
          "security team", "account security", "executive office")
URGENCY = ("urgent", "immediately", "act now", "action required", "verify now", "account suspended", "account will be closed", "within 24 hours",
           "within 48 hours", "immediate action", "final notice")
SENSITIVE = ("password", "credentials", "verification code", "security code", "one-time password", "otp", "banking information", "bank account",
             "credit card", "debit card", "pin number", "ssn", "social security")
THREATS = ("account suspended", "account disabled", "account terminated", "legal action", "law enforcement", "security breach",
           "unauthorized access", "access restricted", "payment failed")
AUTH_WORDS = ("login", "signin", "verify", "password", "account", "secure", "update")
DANGEROUS = (".exe", ".scr", ".bat", ".cmd", ".js", ".vbs", ".ps1", ".hta", ".docm", ".xlsm", ".pif", ".application", ".gadget", ".msi", ".msp",
             ".com", ".cpl", ".jar", ".wsf", ".wsh")
HIDDEN = (".exe", ".scr", ".bat", ".cmd", ".js", ".vbs", ".ps1", ".hta", ".jar", ".pif", ".cpl")
LURES = ("invoice", "payment", "receipt", "remittance", "wire", "bill", "statement", "order", r"po[_-]?\d+", "refund")
CAPS = {"header": 20, "sender": 35, "recipient": 10, "content": 35, "url": 40, "attachment": 45}
HIGH_RISK, SUSPICIOUS, MOST = 50, 20, 100
UNDECIDED = "not decided: a field is missing"


def lure_pattern(lures: Iterable[str] = LURES) -> str:
    return r"(?i)(^|[\W_])(" + "|".join(lures) + r")([\W_]|$)"


@dataclass(frozen=True)
class Rule:
    """matched and evidence are made from terms, which a catalogue may override."""

    rule_id: str
    category: str
    severity: str
    score: int
    matched: Callable[[tuple], Column]
    evidence: Callable[[tuple], Column] = lambda terms: F.lit("")
    terms: tuple = ()
    enabled: bool = True
    #: Of a rule on links or files, the test of one of them.
    test: Callable[[object, tuple], Column] | None = None


def _header(name: str) -> Column:
    """The first value of a header, whatever the case of its name."""
    found = F.filter(F.map_entries("headers"), lambda e: F.lower(e.key) == name)
    return F.get(F.get(found, F.lit(0)).value, F.lit(0))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _domain() -> Column:
    return F.lower(F.trim(_or_empty(F.col("sender.domain"))))


def _return_domain() -> Column:
    path = _or_empty(_header("return-path"))
    return F.lower(F.trim(F.regexp_replace(_or_empty(F.get(F.split(path, "@", 2), F.lit(1))), r"[> \r\n]+$", "")))


def _reply_domain() -> Column:
    return F.lower(F.trim(_or_empty(F.get(F.col("recipients.reply_to"), F.lit(0)).domain)))


def _terms_in(text: Column, terms: tuple) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), t) for t in terms])) if terms else F.array().cast("array<string>")


def _any_of(text: Column, terms: tuple) -> Column:
    """A chain of plain tests: inside a lambda the text would be put together again for every term."""
    return reduce(or_, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))


def _text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[_or_empty(F.col(c)) for c in columns]))


#: Texts that several rules search, put together once per message.
PREPARED = {"_title_text": ("body_text", "subject"), "_body_text": ("body_text", "body_html")}


def _link(u: Column) -> Column:
    """What rules ask of a link, found once."""
    named = lambda a: F.struct(u.alias("url"), a.alias("authority"), U.is_ip(U.host_of(a)).alias("is_ip"), F.lower(F.concat(U.part(u, "path"), F.lit(" "), U.part(u, "query"))).alias("rest"))
    return U.bound(U.part(u, "authority"), named)


def prepared(parsed: DataFrame) -> DataFrame:
    """Texts, links and domains that several rules read, each made once per message."""
    links = F.transform(F.coalesce("urls", F.array().cast("array<string>")), _link)
    files = {"_files": F.transform(F.coalesce("attachments.filename", F.array().cast("array<string>")), _or_empty)} if "attachments" in parsed.columns else {}
    return parsed.withColumns({**{name: _text(*columns) for name, columns in PREPARED.items()}, "_links": links, **files, "_from": _domain(), "_return": _return_domain(), "_reply": _reply_domain()})


def searched(text: Column, head: int = 0, rules: Iterable[Rule] = ()) -> Column:
    """A short text in which content rules find the terms that they find in the whole, whatever is put behind it.

    It has the first `head` characters, every term found, each on a line of its own, and the end, in which a term may begin
    that goes on behind it. No term has a line's end.
    """
    terms = tuple(dict.fromkeys(t for r in rules or CATALOGUE if r.category == "content" for t in r.terms))
    most = max(map(len, terms), default=1)
    if any("\n" in t for t in terms):
        return text
    low, found = F.lower(text), F.lit("")
    short = U.bound(low, lambda x: F.concat_ws("\n", F.substring(text, 1, head), F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t)), t) for t in terms])) if terms else found, F.right(text, F.lit(most))))
    return F.when(F.length(text) > head + 2 * most, short).otherwise(text)


def _in_text(rule_id: str, severity: str, score: int, terms: tuple, column: str) -> Rule:
    text = lambda: F.col(column)
    return Rule(rule_id, "content", severity, score, lambda t: _any_of(text(), t), lambda t: F.concat_ws(", ", _terms_in(text(), t)), terms)


def _brands(terms: tuple) -> Column:
    name, domain = F.lower(_or_empty(F.col("sender.display_name"))), F.lower(_or_empty(F.col("sender.domain")))
    claimed = [F.when(F.contains(name, F.lit(b)) & ~F.contains(domain, F.lit(b.replace(" ", ""))), b) for b in terms]
    return F.when((name != "") & (domain != ""), F.coalesce(*claimed, F.lit(None).cast("string")))


def _urls(test: Callable[[Column], Column]) -> Column:
    """The links, as prepared() has them, that pass a test."""
    return F.filter("_links", test)


def _of_urls(rule_id: str, severity: str, score: int, test: Callable[[Column, tuple], Column], terms: tuple = ()) -> Rule:
    return Rule(rule_id, "url", severity, score, lambda t: F.exists("_links", lambda u: test(u, t)),
                lambda t: F.concat_ws(" ", F.slice(_urls(lambda u: test(u, t)), 1, 5)["url"]), terms, test=test)


def _of_files(rule_id: str, severity: str, score: int, test: Callable[[Column, tuple], Column], terms: tuple = ()) -> Rule:
    return Rule(rule_id, "attachment", severity, score, lambda t: F.exists("_files", lambda n: test(n, t)), lambda t: F.concat_ws(" ", F.filter("_files", lambda n: test(n, t))), terms, test=test)


def _extension(name: Column) -> Column:
    """The last extension; dots that begin a name begin no extension."""
    return F.lower(F.regexp_extract(F.when(F.contains(name, F.lit("/")), F.regexp_replace(name, r"^.*/", "")).otherwise(name), r"^\.*[^.].*?(\.[^.]*)$", 1))


def _to() -> Column:
    return F.get(F.col("recipients.to"), F.lit(0))


CATALOGUE: tuple[Rule, ...] = (
    Rule("RULE-HDR-001", "header", "low", 5, lambda t: F.size("received_headers") >= 3, lambda t: F.size("received_headers").cast("string")),
    Rule("RULE-HDR-002", "header", "low", 10, lambda t: F.trim(_or_empty(_header("message-id"))) == ""),
    Rule("RULE-HDR-003", "header", "low", 10, lambda t: (F.col("_from") != "") & (F.col("_return") != "") & (F.col("_from") != F.col("_return")),
         lambda t: F.concat_ws(" ", "_from", "_return")),
    Rule("RULE-SENDER-001", "sender", "medium", 20, lambda t: (F.col("_from") != "") & (F.col("_reply") != "") & (F.col("_reply") != F.col("_from")),
         lambda t: F.concat_ws(" ", "_from", "_reply")),
    Rule("RULE-SENDER-002", "sender", "high", 25, lambda t: _brands(t).isNotNull(), lambda t: _or_empty(_brands(t)), BRANDS),
    Rule("RULE-SENDER-003", "sender", "low", 15, lambda t: F.col("_from") == ""),
    Rule("RULE-RECIPIENT-001", "recipient", "low", 5, lambda t: _to().isNull() | F.contains(
        F.lower(F.concat_ws(" ", _to().raw, _to().address, _to().display_name)), F.lit("undisclosed"))),
    _in_text("RULE-CONTENT-001", "low", 10, URGENCY, "_title_text"),
    _in_text("RULE-CONTENT-002", "medium", 20, SENSITIVE, "_body_text"),
    _in_text("RULE-CONTENT-003", "medium", 15, THREATS, "_body_text"),
    Rule("RULE-CONTENT-004", "content", "info", 2, lambda t: F.length(_or_empty(F.col("body_html"))) > 0),
    _of_urls("RULE-URL-001", "info", 2, lambda u, t: F.lit(True)),
    _of_urls("RULE-URL-002", "low", 10, lambda u, t: F.lower(u.url).startswith("http://")),
    _of_urls("RULE-URL-003", "high", 25, lambda u, t: u.is_ip),
    _of_urls("RULE-URL-004", "medium", 20, lambda u, t: F.contains(u.authority, F.lit("@")) | (F.length(u.url) - F.length(F.replace(u.url, F.lit("%"), F.lit(""))) > 3)),
    _of_urls("RULE-URL-005", "medium", 15, lambda u, t: u.rest.rlike(r"(?U)\b(" + "|".join(t) + r")\b"), AUTH_WORDS),
    _of_files("RULE-ATTACH-001", "info", 2, lambda n, t: F.lit(True)),
    _of_files("RULE-ATTACH-002", "high", 30, lambda n, t: _extension(n).isin(*t), DANGEROUS),
    _of_files("RULE-ATTACH-003", "high", 35, lambda n, t: (F.size(F.split(n, r"\.")) >= 3) & F.concat(F.lit("."), F.lower(F.element_at(F.split(n, r"\."), -1))).isin(*t), HIDDEN),
    _of_files("RULE-ATTACH-004", "medium", 15, lambda n, t: n.rlike(lure_pattern(t)), LURES),
)


def catalogue(disabled: Iterable[str] = (), terms: dict[str, tuple] | None = None, scores: dict[str, int] | None = None) -> tuple[Rule, ...]:
    """The catalogue with rules switched off, term lists or scores replaced."""
    return tuple(replace(r, enabled=r.rule_id not in set(disabled), terms=(terms or {}).get(r.rule_id, r.terms), score=(scores or {}).get(r.rule_id, r.score)) for r in CATALOGUE)


def evaluate_rules(parsed: DataFrame, rules: Iterable[Rule] = CATALOGUE, evidence: bool = True) -> DataFrame:
    """A row per message and enabled rule: case_id, rule_id, category, severity, matched, score, evidence (if wanted).

    A rule that cannot be decided, over missing columns' nulls, does not match, and its evidence says so.
    """
    if not evidence:
        return _bare_hits(parsed, [r for r in rules if r.enabled])

    def row(r: Rule) -> Column:
        found = r.matched(r.terms)
        hit = F.coalesce(found, F.lit(False))
        return F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), hit.alias("matched"),
                        F.when(hit, r.score).otherwise(0).alias("score"), F.when(hit, F.coalesce(r.evidence(r.terms), F.lit(""))).when(found.isNull(), UNDECIDED).otherwise("").alias("evidence"))
    return prepared(parsed).select("case_id", F.inline(F.array(*[row(r) for r in rules if r.enabled])))


def _wide(parsed: DataFrame, rules: Iterable[Rule], *more: str, apart: Iterable[DataFrame] = ()) -> DataFrame:
    """A row per message: whether each rule matches, in a column of its name. apart: tables of rules decided by case_id, which is among `more`."""
    known = {c: df for df in apart for c in df.columns if c != "case_id"}
    out = prepared(parsed).select(*more, *[F.coalesce(r.matched(r.terms), F.lit(False)).alias(r.rule_id) for r in rules if r.rule_id not in known])
    for df in apart:
        out = out.join(df.hint("merge"), "case_id", "left")
    return out.select(*more, *[F.coalesce(F.col(f"`{r.rule_id}`"), F.lit(False)).alias(r.rule_id) for r in rules]) if known else out


def link_hits(parsed: DataFrame, rules: Iterable[Rule] = CATALOGUE) -> DataFrame:
    """case_id and a boolean for each rule on links, for the messages that have some. A row per link, so that Spark compiles the tests."""
    rows = U.with_parts(parsed.select("case_id", F.explode("urls").alias("url")))
    query = F.when(F.contains("url", F.lit("?")), U.part(F.col("url"), "query")).otherwise("")
    rows = rows.select("case_id", "url", "authority", (F.col("host").rlike(U.IPV4) | F.col("host").rlike(U.IPV6)).alias("is_ip"), F.lower(F.concat("path", F.lit(" "), query)).alias("rest"))
    return _tested(rows, SimpleNamespace(**{c: F.col(c) for c in ("url", "authority", "is_ip", "rest")}), [r for r in rules if r.category == "url" and r.test])


def file_hits(files: DataFrame, rules: Iterable[Rule] = CATALOGUE) -> DataFrame:
    """case_id and a boolean for each rule on attachments, from files (case_id, filename), a row each; they are grouped before they are shuffled."""
    return _tested(files.select("case_id", _or_empty(F.col("filename")).alias("name")), F.col("name"), [r for r in rules if r.category == "attachment" and r.test])


def _tested(rows: DataFrame, item: object, rules: list[Rule]) -> DataFrame:
    return rows.groupBy("case_id").agg(*[F.bool_or(r.test(item, r.terms)).alias(r.rule_id) for r in rules if r.enabled])


def best_hits(parsed: DataFrame, best: int, rules: Iterable[Rule] = CATALOGUE, apart: Iterable[DataFrame] = ()) -> DataFrame:
    """Of a message's matching rules the `best` with the highest scores, ties by rule_id: case_id, rule_id, matched, score. They are chosen in its row."""
    rules = sorted((r for r in rules if r.enabled), key=lambda r: (-r.score, r.rule_id))
    found = F.array_compact(F.array(*[F.when(F.col(f"`{r.rule_id}`"), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(True).alias("matched"), F.lit(r.score).alias("score"))) for r in rules]))
    return _wide(parsed, rules, "case_id", apart=apart).select("case_id", F.inline(F.slice(found, 1, best)))


def _bare_hits(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Of a message's row only its matches are unfolded; what is the same for every message is looked up by place."""
    def known(values: list, kind: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("at") + 1)
    hits = _wide(parsed, rules, "case_id").select("case_id", F.posexplode(F.array(*[F.col(f"`{r.rule_id}`") for r in rules])).alias("at", "matched"))
    return hits.select("case_id", known([r.rule_id for r in rules], "string").alias("rule_id"), known([r.category for r in rules], "string").alias("category"),
                       known([r.severity for r in rules], "string").alias("severity"), "matched", F.when(F.col("matched"), known([r.score for r in rules], "int")).otherwise(0).alias("score"))


def count_rules(parsed: DataFrame, rules: Iterable[Rule] = CATALOGUE) -> DataFrame:
    """A row per enabled rule: rule_id, category, severity, evaluated, matched, points; none without messages.

    Counted in the messages' rows, before there is a row per rule.
    """
    rules = [r for r in rules if r.enabled]
    sums = _wide(parsed, rules).agg(F.count("*").alias("evaluated"), *[F.count_if(F.col(f"`{r.rule_id}`")).alias(r.rule_id) for r in rules])
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), "evaluated",
                              F.col(f"`{r.rule_id}`").alias("matched"), (F.col(f"`{r.rule_id}`") * r.score).alias("points")) for r in rules])
    return sums.where("evaluated > 0").select(F.inline(rows))


def verdict(total: Column) -> Column:
    return F.when(total >= HIGH_RISK, "HIGH_RISK").when(total >= SUSPICIOUS, "SUSPICIOUS").otherwise("BENIGN")


def score_rules(parsed: DataFrame, rules: Iterable[Rule] = CATALOGUE, apart: Iterable[DataFrame] = (), more: Iterable[str] = ()) -> DataFrame:
    """A row per message: the capped score of each category, total_score, rules_verdict, matched and evaluated counts.

    Scores are sums within the row; nothing is grouped or shuffled. apart: tables of link_hits() and file_hits(), where
    their rules are decided row by row of theirs. more: columns of parsed that go along.
    """
    rules = [r for r in rules if r.enabled]
    wide = _wide(parsed, rules, "case_id", *more, apart=apart).select("case_id", *more, *[F.col(f"`{r.rule_id}`").cast("int").alias(r.rule_id) for r in rules])
    points = {c: sum((F.col(f"`{r.rule_id}`") * r.score for r in rules if r.category == c), F.lit(0)) for c in CAPS}
    scored = wide.select("case_id", *more, *[F.least(points[c], F.lit(cap)).alias(f"{c}_score") for c, cap in CAPS.items()],
                         sum((F.col(f"`{r.rule_id}`") for r in rules), F.lit(0)).alias("matched_rules_count"), F.lit(len(rules)).alias("total_rules_evaluated"))
    scored = scored.withColumn("total_score", F.least(sum((F.col(f"{c}_score") for c in CAPS), F.lit(0)), F.lit(MOST)))
    return scored.withColumn("rules_verdict", verdict(F.col("total_score")))


def score_hits(hits: DataFrame) -> DataFrame:
    """The same scores from the long table of stored hits: a pivot of capped sums."""
    sums = hits.groupBy("case_id").agg(
        *[F.least(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("score"))), F.lit(0)), F.lit(cap)).cast("int").alias(f"{c}_score") for c, cap in CAPS.items()],
        F.count_if("matched").cast("int").alias("matched_rules_count"), F.count("*").cast("int").alias("total_rules_evaluated"))
    sums = sums.withColumn("total_score", F.least(sum((F.col(f"{c}_score") for c in CAPS), F.lit(0)), F.lit(MOST)))
    return sums.withColumn("rules_verdict", verdict(F.col("total_score")))
