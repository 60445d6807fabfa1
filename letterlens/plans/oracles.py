"""DuckDB SQL for the registered queries, over the same derived mail."""

from __future__ import annotations

from letterlens.functions import urls as U
from letterlens.operators import origin as G
from letterlens.operators import report as RP
from letterlens.operators import rule_texts as RT
from letterlens.operators import rules as R
from letterlens.sources import feeds as FE
from letterlens.sources.mail_view import oracle_ctes


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _any(items: str, var: str, test: str) -> str:
    return f"len(list_filter({items}, lambda {var}: {test})) > 0"


def sql_host(u: str) -> str:
    rest = f"regexp_replace(regexp_extract({u}, '{U.URL}', 4), '^.*@', '')"
    return f"lower(CASE WHEN {rest} LIKE '[%' THEN regexp_extract({rest}, '^\\[([^\\]]*)', 1) ELSE regexp_replace({rest}, ':.*$', '') END)"


_EXT = r"lower(regexp_extract(filename, '^\.*[^.].*?(\.[^.]*)$', 1))"
_DOMAIN = "lower(trim(from_domain))"
_RETURN = r"lower(coalesce(regexp_replace(regexp_extract(return_path, '@(.*)$', 1), '[> \r\n]+$', ''), ''))"
_PATHQ = f"lower(regexp_extract(u, '{U.URL}', 5) || ' ' || regexp_extract(u, '{U.URL}', 7))"
#: A rule's test over the flat mail m joined with per-message attachment flags f.
RULE_SQL = {
    "RULE-HDR-001": "len(received) >= 3",
    "RULE-HDR-002": "trim(coalesce(message_id, '')) = ''",
    "RULE-HDR-003": f"{_DOMAIN} <> '' AND {_RETURN} <> '' AND {_DOMAIN} <> {_RETURN}",
    "RULE-SENDER-001": f"{_DOMAIN} <> '' AND coalesce(reply_domain, '') <> '' AND lower(reply_domain) <> {_DOMAIN}",
    "RULE-SENDER-002": f"{_DOMAIN} <> '' AND " + _any(_list(R.BRANDS), "b", f"contains(lower(display_name), b) AND NOT contains({_DOMAIN}, replace(b, ' ', ''))"),
    "RULE-SENDER-003": f"{_DOMAIN} = ''",
    "RULE-RECIPIENT-001": "to_raw IS NULL OR contains(lower(to_raw), 'undisclosed')",
    "RULE-CONTENT-001": _any(_list(R.URGENCY), "t", "contains(lower(body_text || ' ' || subject), t)"),
    "RULE-CONTENT-002": _any(_list(R.SENSITIVE), "t", "contains(lower(body_text || ' ' || coalesce(body_html, '')), t)"),
    "RULE-CONTENT-003": _any(_list(R.THREATS), "t", "contains(lower(body_text || ' ' || coalesce(body_html, '')), t)"),
    "RULE-CONTENT-004": "coalesce(body_html, '') <> ''",
    "RULE-URL-001": "len(urls) > 0",
    "RULE-URL-002": _any("urls", "u", "lower(u) LIKE 'http://%'"),
    "RULE-URL-003": _any("urls", "u", f"regexp_matches({sql_host('u')}, '{U.IPV4}') OR regexp_matches({sql_host('u')}, '{U.IPV6}')"),
    "RULE-URL-004": _any("urls", "u", f"contains(regexp_extract(u, '{U.URL}', 4), '@') OR length(u) - length(replace(u, '%', '')) > 3"),
    "RULE-URL-005": _any("urls", "u", f"regexp_matches({_PATHQ}, '\\b({'|'.join(R.AUTH_WORDS)})\\b')"),
    "RULE-ATTACH-001": "coalesce(n_att, 0) > 0",
    "RULE-ATTACH-002": "coalesce(dangerous, false)",
    "RULE-ATTACH-003": "coalesce(hidden, false)",
    "RULE-ATTACH-004": "coalesce(lure, false)",
}


def _flags() -> str:
    ext = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return (f"f AS (SELECT case_id, count(*) AS n_att, bool_or({_EXT} IN {ext(R.DANGEROUS)}) AS dangerous,"
            f" bool_or(len(string_split(filename, '.')) >= 3 AND '.' || lower(string_split(filename, '.')[-1]) IN {ext(R.HIDDEN)}) AS hidden,"
            f" bool_or(regexp_matches(filename, '{R.lure_pattern()}')) AS lure FROM att GROUP BY case_id)")


def hits_ctes() -> str:
    """CTEs up to hits: a row per message and rule."""
    rows = ", ".join(f"{{'rule_id': '{r.rule_id}', 'category': '{r.category}', 'severity': '{r.severity}', 'points': {r.score}, 'matched': coalesce({RULE_SQL[r.rule_id]}, false)}}" for r in R.CATALOGUE)
    return (f"{oracle_ctes()},\n{_flags()},\nh AS (SELECT mail.case_id, unnest([{rows}]) AS r FROM mail LEFT JOIN f ON f.case_id = mail.case_id),\n"
            "hits AS (SELECT case_id, r.rule_id AS rule_id, r.category AS category, r.severity AS severity, r.matched AS matched, CASE WHEN r.matched THEN r.points ELSE 0 END AS score FROM h)")


def scores_ctes() -> str:
    cats = ", ".join(f"CAST(least(sum(score) FILTER (category = '{c}'), {cap}) AS INTEGER) AS {c}_score" for c, cap in R.CAPS.items())
    total = " + ".join(f"{c}_score" for c in R.CAPS)
    return (f"{hits_ctes()},\ns AS (SELECT case_id, {cats}, CAST(count(*) FILTER (matched) AS INTEGER) AS matched_rules_count, CAST(count(*) AS INTEGER) AS total_rules_evaluated FROM hits GROUP BY case_id),\n"
            f"scores AS (SELECT *, CASE WHEN total_score >= {R.HIGH_RISK} THEN 'HIGH_RISK' WHEN total_score >= {R.SUSPICIOUS} THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS rules_verdict\n"
            f"FROM (SELECT *, least({total}, {R.MOST}) AS total_score FROM s) x)")


def sql_domain(x: str) -> str:
    v = f"regexp_replace(lower(trim({x})), '\\.$', '')"
    return f"CASE WHEN regexp_matches({v}, '{U.DOMAIN}') THEN {v} END"


def sql_url(u: str) -> str:
    part = lambda n: f"regexp_extract({u}, '{U.URL}', {n})"
    where = f"lower({part(4)})"
    return (f"CASE WHEN {part(2)} <> '' THEN lower({part(2)}) || '://' || CASE WHEN lower({part(2)}) = 'http' THEN regexp_replace({where}, ':80$', '') "
            f"WHEN lower({part(2)}) = 'https' THEN regexp_replace({where}, ':443$', '') ELSE {where} END || CASE WHEN {part(5)} = '' THEN '/' ELSE {part(5)} END "
            f"|| CASE WHEN {part(7)} = '' THEN '' ELSE '?' || {part(7)} END || CASE WHEN {part(9)} = '' THEN '' ELSE '#' || {part(9)} END END")


def indicator_ctes() -> str:
    """CTEs up to ind: the numbered indicators of each message."""
    host, local = sql_host("u"), ", ".join(f"'{x}'" for x in U.LOCAL)
    return f"""{oracle_ctes()},
url AS (SELECT case_id, p, urls[p] AS u FROM (SELECT case_id, urls, unnest(generate_series(1, len(urls))) AS p FROM mail) x),
hst AS (SELECT *, {host} AS h, regexp_matches({host}, '{U.IPV4}') AS ip FROM url),
cand AS (
  SELECT case_id, 1 AS st, p, 0 AS sub, 'URL' AS ioc_type, u AS original_value, {sql_url('u')} AS normalized_value, 'email_url' AS source_context FROM url
  UNION ALL SELECT case_id, 1, p, 1, 'IP', h, h, 'url_ip' FROM hst WHERE ip
  UNION ALL SELECT case_id, 1, p, 2, 'DOMAIN', h, {sql_domain('h')}, 'url_domain' FROM hst WHERE NOT ip AND h NOT IN ({local})
  UNION ALL SELECT case_id, 2, n, 0, 'SHA256', sha256, sha256, 'attachment_hash' FROM att WHERE case_id IN (SELECT case_id FROM mail)
  UNION ALL SELECT case_id, 3, 1, 0, 'DOMAIN', lower(from_domain), {sql_domain('from_domain')}, 'sender_domain' FROM mail
  UNION ALL SELECT case_id, 4, 1, 0, 'DOMAIN', reply_domain, {sql_domain('reply_domain')}, 'reply_to_domain' FROM mail),
one AS (SELECT * FROM cand WHERE normalized_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, ioc_type, normalized_value, source_context ORDER BY st, p, sub) = 1),
ind AS (SELECT case_id, 'IOC-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY st, p, sub) || '', 3, '0') AS ioc_id, ioc_type, original_value, normalized_value, source_context FROM one)"""


def feed_ctes() -> str:
    rows = ", ".join("(" + ", ".join([str(i), *(repr(x) if isinstance(x, str) else str(x) for x in r)]) + ")" for i, r in enumerate(FE.EXAMPLE_INDICATORS))
    value = f"CASE t WHEN 'URL' THEN {sql_url('v')} WHEN 'DOMAIN' THEN {sql_domain('v')} ELSE v END"
    return (f"raw(place, source, t, v, status, confidence, reason) AS (VALUES {rows}),\n"
            f"feed AS (SELECT source, t AS ioc_type, {value} AS normalized_value, status, confidence, reason, '1' AS feed_version FROM raw\n"
            "QUALIFY row_number() OVER (PARTITION BY source, ioc_type, normalized_value ORDER BY place DESC) = 1)")


def match_ctes() -> str:
    return f"""{indicator_ctes()},
{feed_ctes()},
hit AS (SELECT i.*, s.source, coalesce(f.status, 'not_found') AS status, coalesce(f.confidence, 0) AS confidence, f.reason, f.feed_version
  FROM ind i CROSS JOIN (SELECT DISTINCT source FROM feed) s LEFT JOIN feed f USING (source, ioc_type, normalized_value)),
isum AS (SELECT case_id, count(DISTINCT ioc_id) AS total_indicators, count(*) FILTER (status NOT IN ('not_found', 'error')) AS matched, count(*) FILTER (status = 'known_malicious') AS malicious,
  count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'not_found') AS not_found, bool_or(bad AND good) AS disputed,
  max(confidence) FILTER (status = 'known_malicious') AS malicious_confidence, max(confidence) FILTER (status = 'suspicious') AS suspicious_confidence, bool_or(good) AS benign,
  coalesce(string_agg(DISTINCT feed_version, ','), '') AS feed_versions
  FROM (SELECT *, bool_or(status = 'known_malicious') OVER w AS bad, bool_or(status = 'known_benign') OVER w AS good FROM hit WINDOW w AS (PARTITION BY case_id, ioc_type, normalized_value)) x GROUP BY case_id)"""


def origin_ctes() -> str:
    """CTEs up to org: the origin of each message with its enrichment."""
    num = "(CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536 + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT))"
    cls = "CASE " + " ".join(f"WHEN {num} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in G.ranges()) + " ELSE 'GLOBAL' END"
    geo = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in FE.EXAMPLE_GEO)
    intel = ", ".join(f"('{r[0]}', {r[1]}, {r[2]}, {r[3]}, {r[4]})" for r in FE.EXAMPLE_INTEL)
    return f"""hop AS (SELECT case_id, len(received) - p AS hop_index, received[p] AS line FROM (SELECT case_id, received, unnest(generate_series(1, len(received))) AS p FROM mail) x),
ips AS (SELECT case_id, hop_index, line, l, l[q] AS ip, q FROM (SELECT *, unnest(generate_series(1, len(l))) AS q FROM (SELECT *, regexp_extract_all(line, '\\b[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}\\b') AS l FROM hop) a) b),
cnd AS (SELECT case_id, CAST(hop_index AS INTEGER) AS hop_index, CAST(q AS INTEGER) AS place, ip, {cls} AS classification,
  CASE WHEN contains(regexp_extract(line, 'from\\s+([a-zA-Z0-9._-]+)', 1), '.') AND NOT regexp_matches(replace(regexp_extract(line, 'from\\s+([a-zA-Z0-9._-]+)', 1), '.', ''), '^[0-9]*$')
       THEN regexp_extract(line, 'from\\s+([a-zA-Z0-9._-]+)', 1) END AS reverse_dns_hint FROM ips),
sel AS (SELECT * FROM cnd WHERE classification IN ('GLOBAL', 'DOCUMENTATION') QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY hop_index, place) = 1),
tot AS (SELECT case_id, max(hop_index) + 1 AS total_hops, count(*) FILTER (classification IN ('PRIVATE', 'LOOPBACK')) AS private_hops FROM cnd GROUP BY case_id),
geo(ip, country_code, asn) AS (VALUES {geo}),
intel(ip, is_tor_exit, is_vpn, is_proxy, is_datacenter_hosting) AS (VALUES {intel}),
org AS (SELECT mail.case_id, CASE WHEN sel.ip IS NULL THEN 'NO_CANDIDATE' ELSE 'SUCCESS' END AS status, sel.ip AS selected_origin_ip, sel.classification AS origin_class,
  sel.hop_index AS origin_hop, CAST(coalesce(total_hops, 0) AS INTEGER) AS total_hops, CAST(coalesce(private_hops, 0) AS INTEGER) AS private_hops,
  CASE WHEN sel.ip IS NULL THEN 'UNKNOWN' WHEN sel.hop_index = 0 AND total_hops >= 2 THEN 'HIGH' WHEN sel.hop_index <= 2 AND total_hops >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  country_code, asn, is_tor_exit, is_vpn, is_proxy, is_datacenter_hosting, CASE WHEN intel.ip IS NULL THEN 'unmatched' ELSE 'feed' END AS intel_source
  FROM mail LEFT JOIN sel ON sel.case_id = mail.case_id LEFT JOIN tot ON tot.case_id = mail.case_id LEFT JOIN geo ON geo.ip = sel.ip LEFT JOIN intel ON intel.ip = sel.ip)"""


def correlation_ctes() -> str:
    """CTEs up to cor: the assessment of each message, all four signals of which are there but for some texts'."""
    scores, matches = scores_ctes(), match_ctes()[len(oracle_ctes()):]
    points = "round({s} * round({w} / base, 4) * 100 + 1e-9, 2)"
    each = lambda n, w: f"CASE WHEN {n}_signal IS NULL THEN 0 ELSE {points.format(s=f'{n}_signal', w=w)} END"
    return f"""{scores}{matches},
{origin_ctes()},
ml AS (SELECT case_id, CASE WHEN k % 17 = 0 THEN 'insufficient_text' ELSE 'ready' END AS model_status, (k * 37 % 101) / 100.0::DOUBLE AS p FROM mail),
obs AS (SELECT case_id, ioc_type AS entity_type, lower(trim(normalized_value)) AS entity_value, 'IOC' AS engine FROM hit
  UNION ALL SELECT case_id, 'DOMAIN', h, 'IOC' FROM (SELECT case_id, regexp_extract(lower(trim(normalized_value)), 'https?://([^/:?#]+)', 1) AS h FROM hit WHERE ioc_type = 'URL') x WHERE h <> ''
  UNION ALL SELECT case_id, 'IP', lower(selected_origin_ip), 'GEO' FROM org WHERE selected_origin_ip IS NOT NULL
  UNION ALL SELECT case_id, 'IP', h, 'RULES' FROM hst WHERE regexp_matches(h, '{U.IPV4}') OR regexp_matches(h, '{U.IPV6}')),
ent AS (SELECT case_id, entity_type, entity_value, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, count(*) AS observations, count(DISTINCT engine) >= 2 AS is_cross_engine FROM obs GROUP BY ALL),
sig AS (SELECT mail.case_id, total_score / 100.0::DOUBLE AS rules_signal, CASE WHEN model_status = 'ready' THEN p END AS ml_signal,
  CASE WHEN malicious_confidence IS NOT NULL THEN 0.85::DOUBLE + 0.15::DOUBLE * malicious_confidence / 100 WHEN suspicious_confidence IS NOT NULL THEN 0.50::DOUBLE + 0.15::DOUBLE * suspicious_confidence / 100
       WHEN benign THEN 0.05 ELSE 0.0 END AS ioc_signal,
  round(least(1.0, (CASE WHEN is_tor_exit THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN is_vpn OR is_proxy THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_datacenter_hosting AND NOT is_tor_exit THEN 0.15::DOUBLE ELSE 0 END)
    * CASE org.confidence WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.6::DOUBLE WHEN 'LOW' THEN 0.25::DOUBLE ELSE 0 END), 4) AS geo_signal,
  CASE WHEN model_status = 'ready' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS base, coalesce(x.n, 0) AS cross_entities, coalesce(malicious_confidence >= 85, false) AS severe, coalesce(disputed, false) AS disputed
  FROM mail JOIN scores USING (case_id) JOIN ml USING (case_id) LEFT JOIN isum ON isum.case_id = mail.case_id JOIN org ON org.case_id = mail.case_id
  LEFT JOIN (SELECT case_id, count(*) AS n FROM ent WHERE is_cross_engine GROUP BY case_id) x ON x.case_id = mail.case_id),
bas AS (SELECT *, greatest(0.0, least(100.0, {each('rules', 0.35)} + {each('ml', 0.30)} + {each('ioc', 0.25)} + {each('geo', 0.10)} - round(cross_entities * 2.5 * 0.5, 2))) AS base_score,
  concat_ws(';', CASE WHEN rules_signal >= 0.60 AND ml_signal <= 0.30 THEN 'rules high, text low' WHEN rules_signal <= 0.25 AND ml_signal >= 0.70 THEN 'text high, rules low' END,
    CASE WHEN disputed THEN 'feeds disagree' END) AS conflicts FROM sig),
cor AS (SELECT *, CASE WHEN final_score >= 60 THEN 'HIGH_RISK' WHEN final_score >= 25 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS final_assessment,
  CASE WHEN coverage >= 90 AND conflicts = '' THEN 'HIGH' WHEN coverage >= 60 AND NOT contains(conflicts, ';') THEN 'MEDIUM' ELSE 'LOW' END AS correlation_confidence
  FROM (SELECT *, round(base * 100, 1) AS coverage, round(CASE WHEN severe THEN greatest(base_score, 65.0) ELSE base_score END + 1e-9, 1) AS final_score FROM bas) x)"""


def explained_ctes() -> str:
    """CTEs up to exp: assessments with what explains and limits them."""
    points = "floor(round(rules_signal * round(0.35 / base, 4) * 100 + 1e-9, 2) * 10 + 0.5 + 1e-9) / 10"  # halves go up
    return f"""{correlation_ctes()},
exp AS (SELECT *, concat_ws('; ', CASE WHEN coverage < 100 THEN 'unavailable: ' || concat_ws(', ', CASE WHEN rules_signal IS NULL THEN 'RULES' END, CASE WHEN ml_signal IS NULL THEN 'ML' END) END,
    CASE WHEN cross_entities > 0 THEN cross_entities || ' entities seen by several engines' END, CASE WHEN severe AND base_score < 65 THEN 'raised by a severe indicator' END) AS limitations,
  concat_ws(' ', final_assessment || ' (score ' || printf('%.1f', final_score) || ' of 100, confidence ' || correlation_confidence || ').',
    CASE WHEN rules_signal >= 0.40 THEN 'Rules found notable anomalies (' || printf('%.1f', {points}) || ' points).' END,
    CASE WHEN ml_signal >= 0.60 THEN 'The text reads as phishing (' || printf('%.2f', ml_signal) || ').' END,
    CASE WHEN mal THEN 'Indicators match known malicious infrastructure.' END, CASE WHEN geo_signal >= 0.20 THEN 'The origin is an anonymising relay.' END,
    CASE WHEN conflicts <> '' THEN 'Conflicts: ' || replace(conflicts, ';', '; ') || '.' END) AS explanation
  FROM cor LEFT JOIN (SELECT case_id AS c, malicious_confidence IS NOT NULL AS mal FROM isum) i ON c = case_id)"""


def manifest_ctes() -> str:
    """CTEs up to man and cmp: the artifacts of each message, and the digest of them all."""
    return f"""{correlation_ctes()},
art AS (SELECT case_id, 'parsed_result' AS artifact_type, 'parsed_data.json' AS artifact_name, '{{"subject":"' || subject || '","urls":"' || array_to_string(urls, ' ') || '"}}' AS body, 'parser' AS source FROM mail
  UNION ALL SELECT case_id, 'rule_result', 'rules_results.json', '{{"total_score":' || total_score || ',"verdict":"' || rules_verdict || '"}}', 'rules' FROM scores
  UNION ALL SELECT case_id, 'ml_result', 'ml_results.json', '{{"pred":"' || CASE WHEN p < 0.30 THEN 'LEGITIMATE' WHEN p > 0.70 THEN 'PHISHING' ELSE 'UNCERTAIN' END || '","prob":' || p || '}}', 'ml' FROM ml
  UNION ALL SELECT case_id, 'correlation_result', 'correlation.json', '{{"assessment":"' || final_assessment || '","score":' || final_score || '}}', 'correlation' FROM cor),
man AS (SELECT case_id, artifact_type, artifact_name, length(body) AS size_bytes, sha256(body) AS sha256, source, false AS immutable FROM art
  UNION ALL SELECT case_id, 'attachment', filename, size, sha256, 'parser', true FROM att WHERE case_id IN (SELECT case_id FROM mail)
  UNION ALL SELECT case_id, 'raw_email', case_id || '.eml', strlen(body_text), sha256(body_text), 'quarantine', true FROM mail),
cmp AS (SELECT case_id, count(*) AS artifacts, sha256('[' || string_agg('{{"artifact_type":"' || artifact_type || '","artifact_name":"' || artifact_name || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}}',
  ',' ORDER BY artifact_type, artifact_name, sha256, size_bytes) || ']') AS composite_sha256 FROM man GROUP BY case_id)"""


def samples_cte() -> str:
    body = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
    return (f"smp AS (SELECT coalesce(source, '') AS source, doc_id AS seq, 1 - quality AS label, sha256(' ' || {body}) AS content_hash, length({body}) >= 10 AS usable, text FROM documents JOIN labels USING (doc_id)),\n"
            "kept AS (SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies, row_number() OVER (PARTITION BY content_hash ORDER BY source, seq) AS rn FROM smp),\n"
            "fst AS (SELECT * FROM kept WHERE rn = 1)")


_SPLIT = ("pl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(content_hash || '42'), source, seq) AS place, count(*) OVER (PARTITION BY label) AS total FROM fst),\n"
          "spl AS (SELECT content_hash, label, CASE WHEN place <= round(total * 0.70::DOUBLE) THEN 'train' WHEN place <= round(total * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM pl)")
_SCORED = ("sc AS (SELECT seq AS doc, source, label, least(1.0, length(regexp_replace(text, '[^!*#$%&|]', '', 'g')) / 40.0::DOUBLE) AS probability FROM smp)")
_CONFUSED = ("cf AS (SELECT {by} count(*) FILTER (probability >= 0.5 AND label = 1) AS tp, count(*) FILTER (probability >= 0.5 AND label <> 1) AS fp, count(*) FILTER (probability < 0.5 AND label = 1) AS fn,"
             " count(*) FILTER (probability < 0.5 AND label <> 1) AS tn FROM sc {group})")
_TERMS = ("tok AS (SELECT doc_id AS doc, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM documents),\n"
          "trm AS (SELECT doc, unnest(w) AS term FROM tok UNION ALL SELECT doc, w[i] || ' ' || w[i + 1] FROM (SELECT doc, w, unnest(generate_series(1, len(w) - 1)) AS i FROM tok) x),\n"
          "tf AS (SELECT doc, term, count(*) AS tf FROM trm GROUP BY ALL),\n"
          "voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS df FROM tf GROUP BY term ORDER BY corpus_count DESC, term LIMIT {n})")
_EVENTS = ("ev AS (SELECT 'CASE-' || lpad(user_id || '', 10, '0') AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, ts, event_id, props,\n"
           "  '{\"actor_id\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"worker\"' END || ',\"actor_type\":\"SYSTEM\",\"case_id\":\"CASE-' || lpad(user_id || '', 10, '0') || '\",\"event_sequence\":' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)\n"
           "  || ',\"event_timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00\",\"event_type\":\"' || event_type\n"
           "  || '\",\"message\":\"said \\\"\\u00e9\\\" ' || event_id || '\",\"metadata\":' || coalesce(props, '{}') || ',\"previous_event_hash\":' AS head FROM events),\n"
           "chn AS (SELECT case_id, seq, CAST(NULL AS VARCHAR) AS prev, sha256(head || 'null}') AS hash FROM ev WHERE seq = 1\n"
           "  UNION ALL SELECT ev.case_id, ev.seq, c.hash, sha256(ev.head || '\"' || c.hash || '\"}') FROM chn c JOIN ev ON ev.case_id = c.case_id AND ev.seq = c.seq + 1)")

_TAMPERED = ("tam AS (SELECT case_id, CASE WHEN n % 37 = 0 THEN seq - 1 ELSE seq END AS seq, prev, hash, n FROM (SELECT *, CAST('0x' || substr(hash, 1, 4) AS INTEGER) AS n FROM chn) x WHERE n % 31 <> 0),\n"
             "ord AS (SELECT *, row_number() OVER w AS expected, lag(hash) OVER w AS before FROM tam WINDOW w AS (PARTITION BY case_id ORDER BY seq, hash)),\n"
             "bad AS (SELECT case_id, seq, 'sequence_anomaly' AS error_type FROM ord WHERE seq <> expected UNION ALL SELECT case_id, seq, 'previous_hash_mismatch' FROM ord WHERE prev IS DISTINCT FROM before\n"
             "  UNION ALL SELECT case_id, seq, 'event_hash_mismatch' FROM ord WHERE n % 23 = 0 OR n % 37 = 0)")


def _life() -> str:
    """CTEs life, with the events of a case's analysis as a list, and sta, its state."""
    stage = lambda s, ok: f"'{s}_STARTED', CASE WHEN {ok} THEN '{s}_COMPLETED' ELSE '{s}_FAILED' END"
    rest = ", ".join(stage(s, ok) for s, ok in (("RULES", "true"), ("ML", "k % 17 <> 0"), ("IOC", "true"), ("GEO", "k % 23 <> 0"), ("CORRELATION", "true")))
    good, bad = (f"[{rest}, 'CASE_ANALYSIS_COMPLETED', CASE WHEN k % 29 <> 0 THEN 'EVIDENCE_INTEGRITY_VERIFIED' ELSE 'EVIDENCE_INTEGRITY_FAILURE' END] "
                 "|| CASE WHEN k % 5 = 0 THEN ['ANALYST_VIEWED'] ELSE [] END || CASE WHEN k % 3 = 0 THEN ['REPORT_GENERATED'] ELSE [] END", "['CASE_ANALYSIS_FAILED']")
    return ("life AS (SELECT case_id, k, sent, ['CASE_CREATED', 'EVIDENCE_STORED'] || CASE WHEN k % 37 = 0 THEN [] ELSE ['JOB_QUEUED'] || CASE WHEN k % 41 = 0 THEN [] ELSE (CASE WHEN k % 7 = 0 THEN ['ANALYSIS_RERUN'] ELSE [] END)"
            f" || ['PROCESSING_STARTED', {stage('PARSER', "from_domain <> ''")}] || (CASE WHEN from_domain <> '' THEN {good} ELSE {bad} END) END END AS e, from_domain <> '' AS parsed FROM mail),\n"
            "sta AS (SELECT case_id, CASE WHEN k % 37 = 0 THEN 'queue_failed' WHEN k % 41 = 0 THEN 'queued' WHEN parsed THEN 'complete' ELSE 'failed' END AS status FROM life)")


def _log() -> str:
    """CTEs up to run, on top of man: the recorded events, their chain, and the runs of each case."""
    when = "strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    engine = "CASE artifact_type WHEN 'parsed_result' THEN 'parser' WHEN 'rule_result' THEN 'rules' WHEN 'ml_result' THEN 'ml' WHEN 'correlation_result' THEN 'correlation' END"
    return f"""{_life()},
evs AS (SELECT case_id, seq, e[seq] AS event_type, CAST(sent AS TIMESTAMP) + to_seconds(seq) AS moment, e[seq + 1] AS then_ FROM (SELECT case_id, sent, e, unnest(generate_series(1, len(e))) AS seq FROM life) x),
lg AS (SELECT *, {when} AS ts, CASE WHEN event_type IN ('ANALYST_VIEWED', 'REPORT_GENERATED') THEN 'ANALYST' ELSE 'SYSTEM' END AS who,
  CASE WHEN event_type IN ('ANALYST_VIEWED', 'REPORT_GENERATED') THEN 'analyst-1' ELSE 'worker' END AS id, lower(replace(event_type, '_', ' ')) AS message FROM evs),
hd AS (SELECT *, '{{"actor_id":"' || id || '","actor_type":"' || who || '","case_id":"' || case_id || '","event_sequence":' || seq || ',"event_timestamp":"' || ts || '","event_type":"' || event_type || '","message":"' || message
  || '","metadata":{{}},"previous_event_hash":' AS head FROM lg),
lnk AS (SELECT case_id, seq, sha256(head || 'null}}') AS hash FROM hd WHERE seq = 1
  UNION ALL SELECT h.case_id, h.seq, sha256(h.head || '"' || l.hash || '"}}') FROM lnk l JOIN hd h ON h.case_id = l.case_id AND h.seq = l.seq + 1),
rn AS (SELECT case_id, lower(regexp_extract(event_type, '^(.*)_STARTED$', 1)) AS engine, seq, ts, CASE WHEN ends_with(then_, '_COMPLETED') THEN 'completed' WHEN ends_with(then_, '_FAILED') THEN 'failed' ELSE 'running' END AS status, then_
  FROM lg WHERE ends_with(event_type, '_STARTED') AND event_type <> 'PROCESSING_STARTED'),
run AS (SELECT rn.case_id, rn.engine, 'RUN-' || rn.case_id || '-' || rn.engine || '-1' AS run_id, 1 AS n, ts, CAST(1000 AS BIGINT) AS duration_ms, status, CASE WHEN status = 'failed' THEN lower(replace(then_, '_', ' ')) END AS error_message,
  CASE WHEN status = 'completed' THEN sha256 END AS output_fingerprint FROM rn LEFT JOIN (SELECT case_id, {engine} AS engine, sha256 FROM man WHERE {engine} IS NOT NULL) o ON o.case_id = rn.case_id AND o.engine = rn.engine)"""


def _quad(ip: str) -> str:
    """The number of an IPv4 address."""
    return "(" + " + ".join(f"CAST(string_split({ip}, '.')[{i}] AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4)) + ")"


_WAITING = "'The case is in status ''' || status || '''; its signals have not been correlated.'"


def _rule_texts() -> str:
    return ", ".join("(" + _list((k, *v))[1:-1] + ")" for k, v in RT.TEXTS.items())


#: CTEs up to prv and up to tev: versions behind the results, and the first items of evidence.
_PROVENANCE = """aset AS (SELECT case_id, sha256('[' || string_agg('{"filename":"' || filename || '","sha256":"' || sha256 || '","size":' || size || '}', ',' ORDER BY filename, sha256, size) || ']') AS h FROM att GROUP BY case_id),
fv AS (SELECT case_id, min(feed_version) AS feed_version FROM hit GROUP BY case_id),
prv AS (SELECT mail.case_id, sha256(body_text) AS raw_evidence_sha256, CASE WHEN from_domain <> '' THEN '1.0.0' END AS parser_version, '1.0.0' AS rules_engine_version,
  CASE WHEN k % 17 <> 0 THEN '1.0.0' END AS ml_model_version, CASE WHEN k % 17 <> 0 THEN '1.0.0' END AS ml_preprocessing_version, fv.feed_version AS ioc_feed_version,
  CASE WHEN fv.case_id IS NOT NULL THEN '1.0.0' END AS ioc_engine_version, CASE WHEN selected_origin_ip IS NOT NULL THEN '1.0.0' END AS geo_analysis_version,
  '1.0.0' AS correlation_engine_version, '1.0.0' AS correlation_policy_version, CASE WHEN from_domain <> '' THEN aset.h END AS attachment_manifest_sha256
FROM mail LEFT JOIN fv ON fv.case_id = mail.case_id LEFT JOIN org ON org.case_id = mail.case_id LEFT JOIN aset ON aset.case_id = mail.case_id)"""
_EVIDENCE = """rl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, rule_id) AS n FROM hits WHERE matched),
ev AS (SELECT case_id, 1 AS tier, ioc_id || '/' || source AS place, 'IOC' AS engine, normalized_value AS evidence_type, 'high' AS impact FROM hit WHERE status = 'known_malicious'
  UNION ALL SELECT case_id, 2, n || '', 'RULES', rule_id, CASE WHEN score >= 15 THEN 'high' ELSE 'medium' END FROM rl WHERE n <= 3
  UNION ALL SELECT case_id, 3, '', 'ML', 'phishing_probability', CASE WHEN p >= 0.85 THEN 'high' ELSE 'medium' END FROM ml WHERE model_status = 'ready' AND p >= 0.65
  UNION ALL SELECT case_id, 4, '', 'GEO', CASE WHEN is_tor_exit THEN 'tor_routing' ELSE 'vpn_routing' END, CASE WHEN is_tor_exit THEN 'medium' ELSE 'low' END FROM org WHERE is_tor_exit OR is_vpn),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY tier, place) AS INTEGER) AS rank FROM ev),
tev AS (SELECT mail.case_id, coalesce(rank, 1) AS rank, coalesce(engine, 'CORRELATION') AS engine, coalesce(evidence_type, 'baseline_clear') AS evidence_type, coalesce(impact, 'low') AS impact
FROM mail LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) r ON r.case_id = mail.case_id)"""


def _report() -> str:
    """The report of each case as canonical JSON, and its digest."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    note = {k: text(v) for k, v in RP.NOTES.items()}
    found = {k: text(v) for k, v in RP.FINDINGS.items()}
    lists = lambda name, fields, order, source: f"{name} AS (SELECT case_id, list({{{fields}}} ORDER BY {order}) AS l FROM {source} GROUP BY case_id)"
    host = lambda word: f"nullif(regexp_extract(trim(line), '(?i)\\b{word}\\s+([a-zA-Z0-9._-]+)', 1), '')"
    points = lambda n, w: f"CASE WHEN {n}_signal IS NULL THEN 0.0::DOUBLE ELSE round({n}_signal * round({w} / base, 4) * 100 + 1e-9, 2) END"
    part = lambda n, w: f"{n}: {{availability: CASE WHEN {n}_signal IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END, contribution: {points(n, w)}, normalized_value: coalesce({n}_signal, 0.0::DOUBLE)}}"
    as_list = lambda c, by: f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, '{by}') END"
    state = "CASE WHEN k % 31 = 0 THEN 'FILE_MISSING' WHEN k % 29 = 0 THEN 'COMPROMISED' ELSE 'VERIFIED' END"
    sender = "CASE WHEN coalesce(display_name, '') <> '' THEN display_name || ' <' || from_address || '>' ELSE from_address END"
    to = "CASE WHEN to_raw IS NULL THEN CAST([] AS VARCHAR[]) ELSE [to_raw] END"
    none = "CAST([] AS VARCHAR[])"
    empty = "CAST([] AS STRUCT(content_type VARCHAR, filename VARCHAR, safe_handling_note VARCHAR, sha256 VARCHAR, size_bytes BIGINT)[])"
    limits = ("list_filter([CASE WHEN coalesce(n_c, 0) = 0 THEN 'no candidate addresses' END, CASE WHEN private_hops > 0 THEN private_hops || ' private hops ignored' END, CASE WHEN coalesce(n_c, 0) > 0 AND selected_origin_ip IS NULL THEN 'no public address' END, "
              "CASE WHEN confidence = 'MEDIUM' THEN 'origin at hop ' || origin_hop END, CASE WHEN confidence = 'LOW' THEN CASE WHEN total_hops = 1 THEN 'single hop' ELSE 'origin deep in the path' END END, "
              "CASE WHEN origin_class = 'DOCUMENTATION' THEN 'documentation range' END, CASE WHEN selected_origin_ip IS NOT NULL THEN 'relays may hide or forge the path' END], lambda x: x IS NOT NULL)")
    code = ("CASE WHEN ord(c) < 128 THEN c WHEN ord(c) < 65536 THEN '\\u' || lpad(lower(hex(ord(c))), 4, '0') "
            "ELSE '\\u' || lower(hex(55296 + (ord(c) - 65536) // 1024)) || '\\u' || lower(hex(56320 + (ord(c) - 65536) % 1024)) END")
    reserved = "coalesce(origin_class IN ('DOCUMENTATION', 'LOOPBACK', 'LINK_LOCAL', 'PRIVATE'), false)"
    return f"""WITH RECURSIVE {manifest_ctes()[4:]},
{explained_ctes()[len(correlation_ctes()) + 2:]},
{_log()},
{_PROVENANCE},
{_EVIDENCE},
tx(rule_id, rule_name, message, rationale, remediation) AS (VALUES {_rule_texts()}),
{lists('s_rule', 'category: category, description: message, points: CAST(score AS INTEGER), rule_id: rule_id, rule_name: rule_name, severity: severity', 'rule_id', '(SELECT * FROM hits JOIN tx USING (rule_id) WHERE matched) x')},
{lists('s_ioc', "confidence: confidence, feed_sha256: CAST(NULL AS VARCHAR), feed_version: feed_version, ioc_type: ioc_type, matched: status NOT IN ('not_found', 'error'), reason: reason, source: source, status: upper(status), value: original_value", "ioc_id || '/' || source", 'hit')},
n_ioc AS (SELECT case_id, count(*) AS total_iocs, count(*) FILTER (contains(upper(status), 'MALICIOUS')) AS m, count(*) FILTER (contains(upper(status), 'SUSPICIOUS')) AS s, count(*) FILTER (contains(upper(status), 'NOT_FOUND')) AS n,
  coalesce(list(DISTINCT 'v' || feed_version ORDER BY 'v' || feed_version) FILTER (feed_version IS NOT NULL), {none}) AS labels FROM hit GROUP BY case_id),
{lists('s_ev', 'engine: engine, evidence_type: evidence_type, impact: impact, rank: rank', 'rank', 'tev')},
{lists('s_ent', 'engines: engines, entity_type: entity_type, entity_value: entity_value, is_cross_engine: is_cross_engine, observations: observations', "entity_type || '/' || entity_value", 'ent')},
{lists('s_log', "actor: who || ':' || id, event_hash: hash, event_sequence: seq, event_type: event_type, message: message, 'timestamp': ts", 'seq', '(SELECT lg.*, hash FROM lg JOIN lnk USING (case_id, seq)) x')},
{lists('s_run', "duration_ms: duration_ms, engine_name: engine, error_message: error_message, output_fingerprint: output_fingerprint, run_id: run_id, started_timestamp: ts, status: status, version: '1.0.0'", "ts || '/' || run_id", 'run')},
{lists('s_art', 'artifact_name: artifact_name, artifact_type: artifact_type, immutable: immutable, sha256: sha256, size_bytes: size_bytes, source: source', "artifact_type || '/' || artifact_name || '/' || sha256", 'man')},
{lists('s_att', f"content_type: 'application/octet-stream', filename: filename, safe_handling_note: {note['attachment']}, sha256: sha256, size_bytes: size", 'n', 'att')},
{lists('s_hop', f"by_host: {host('by')}, from_host: {host('from')}, hop_index: CAST(hop_index AS INTEGER), ip: nullif(regexp_extract(line, '([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})', 1), ''), protocol: {host('with')}, raw_snippet: substr(trim(line), 1, 120)", 'hop_index', 'hop')},
n_c AS (SELECT case_id, count(*) AS n_c FROM cnd GROUP BY case_id),
body AS (SELECT mail.case_id, to_json({{
  analysis_runs: CASE WHEN s_run.l IS NOT NULL THEN {{runs: s_run.l, total_runs: len(s_run.l)}} END,
  attachment_findings: {{attachments: coalesce(s_att.l, {empty}), total_attachments: coalesce(len(s_att.l), 0)}},
  audit_timeline: {{audit_chain_valid: true, events: s_log.l, total_events: len(s_log.l)}},
  case_info: {{case_id: mail.case_id, case_status: sta.status, email_date: CAST(NULL AS VARCHAR), evidence_sha256: sha256(body_text), file_size_bytes: strlen(body_text), message_id: message_id, original_filename: mail.case_id || '.eml',
    recipients: {to}, sender: {sender}, subject: subject, upload_timestamp: strftime(CAST(mail.sent AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+00:00'}},
  correlation: {{conflicts: {as_list('exp.conflicts', ';')}, correlation_confidence: exp.correlation_confidence, correlation_version: '1.0.0', engine_breakdown: {{{part('geo', 0.10)}, {part('ioc', 0.25)}, {part('ml', 0.30)}, {part('rules', 0.35)}}},
    evidence_coverage_percent: coverage, evidence_graph_entities: coalesce(s_ent.l, []), explanation: explanation, final_assessment: final_assessment, final_score: final_score, limitations: {as_list('exp.limitations', '; ')}, policy_version: '1.0.0', top_evidence: s_ev.l}},
  email_overview: {{attachments_count: coalesce(len(s_att.l), 0), body_plain_snippet: CASE WHEN length(body_text) > 500 THEN substr(body_text, 1, 500) || '...' ELSE body_text END, cc: {none}, content_type: CAST(NULL AS VARCHAR), date: CAST(NULL AS VARCHAR),
    message_id: message_id, reply_to: 'help@' || reply_domain, return_path: return_path, sender_from: coalesce({sender}, 'Not available'), subject: coalesce(nullif(subject, ''), '(No Subject)'), 'to': {to}, urls_count: len(urls)}},
  evidence_integrity: {{bytes_altered: CASE {state} WHEN 'FILE_MISSING' THEN -1 WHEN 'COMPROMISED' THEN 1 ELSE 0 END, current_sha256: CASE {state} WHEN 'FILE_MISSING' THEN 'MISSING_ON_DISK' WHEN 'COMPROMISED' THEN sha256(body_text || '!') ELSE sha256(body_text) END,
    integrity_status: {state}, message: CASE {state} WHEN 'FILE_MISSING' THEN {found['FILE_MISSING']} WHEN 'COMPROMISED' THEN {found['COMPROMISED']} ELSE {found['VERIFIED']} END, original_sha256: sha256(body_text)}},
  evidence_manifest: {{artifacts: s_art.l, manifest_sha256: cmp.composite_sha256, total_artifacts: cmp.artifacts}},
  executive_summary: {{concise_summary: explanation, confidence: exp.correlation_confidence, evidence_coverage_percent: coverage, final_assessment: final_assessment, risk_score: final_score}},
  forensic_disclaimer: {note['disclaimer']},
  geo_findings: {{analysis_version: '1.0.0', asn: asn, candidate_ips_count: coalesce(n_c, 0), confidence: org.confidence, country: country_code, disclaimer: {note['geo']}, is_documentation_range: {reserved}, is_hosting: is_datacenter_hosting, is_proxy: is_proxy,
    is_tor: is_tor_exit, is_vpn: is_vpn, limitations: {limits}, selected_origin_ip: selected_origin_ip, selection_method: 'earliest public relay', status: org.status}},
  header_analysis: CASE WHEN s_hop.l IS NOT NULL THEN {{notes: {note['hops']}, received_chain: s_hop.l, total_hops: len(s_hop.l)}} END,
  ioc_findings: CASE WHEN s_ioc.l IS NOT NULL THEN {{feed_provenance: labels, indicators: s_ioc.l, malicious_iocs: m, not_found_iocs: n_ioc.n, suspicious_iocs: n_ioc.s, total_iocs: total_iocs}} END,
  metadata: {{case_id: mail.case_id, report_version: '1.0.0'}},
  ml_findings: {{confidence: CASE WHEN model_status <> 'ready' THEN 'LOW' WHEN abs(p - 0.5) >= 0.35 THEN 'HIGH' WHEN abs(p - 0.5) >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END, interpretation_note: {note['ml']}, model_status: model_status, model_version: '1.0.0',
    phishing_probability: p, prediction: CASE WHEN p < 0.30 THEN 'LEGITIMATE' WHEN p > 0.70 THEN 'PHISHING' ELSE 'UNCERTAIN' END, preprocessing_version: '1.0.0', top_features: {none}}},
  provenance: {{attachment_manifest_sha256: attachment_manifest_sha256, correlation_engine_version: correlation_engine_version, correlation_policy_version: correlation_policy_version, geo_analysis_version: geo_analysis_version, ioc_engine_version: ioc_engine_version,
    ioc_feed_version: ioc_feed_version, ml_model_version: ml_model_version, ml_preprocessing_version: ml_preprocessing_version, parser_version: parser_version, raw_evidence_sha256: raw_evidence_sha256, rules_engine_version: rules_engine_version}},
  rules_findings: {{category_scores: {{attachment: attachment_score, content: content_score, header: header_score, recipient: recipient_score, sender: sender_score, url: url_score}}, matched_rules: coalesce(s_rule.l, []), rules_engine_version: '1.0.0', status: 'COMPLETED',
    total_rules_evaluated: total_rules_evaluated, total_score: total_score, verdict: rules_verdict}}}}) AS j
  FROM mail JOIN sta USING (case_id) JOIN exp USING (case_id) JOIN scores USING (case_id) JOIN ml USING (case_id) JOIN org USING (case_id) JOIN prv USING (case_id) JOIN cmp USING (case_id) JOIN s_log USING (case_id) JOIN s_art USING (case_id) JOIN s_ev USING (case_id)
  LEFT JOIN s_run USING (case_id) LEFT JOIN s_att USING (case_id) LEFT JOIN s_rule USING (case_id) LEFT JOIN s_ioc USING (case_id) LEFT JOIN n_ioc USING (case_id) LEFT JOIN s_ent USING (case_id) LEFT JOIN s_hop USING (case_id) LEFT JOIN n_c USING (case_id)),
esc AS (SELECT case_id, CASE WHEN regexp_matches(CAST(j AS VARCHAR), '[^\\x00-\\x7f]') THEN array_to_string(list_transform(regexp_extract_all(CAST(j AS VARCHAR), '(?s).'), lambda c: {code}), '') ELSE CAST(j AS VARCHAR) END AS report_json FROM body)
SELECT case_id, sha256(report_json) AS report_sha256, report_json FROM esc"""


ORACLES = {
    "a_lifecycle": f"{oracle_ctes()},\n{_life()}\nSELECT case_id, CAST(generate_subscripts(e, 1) AS INTEGER) AS event_sequence, unnest(e) AS event_type FROM life",
    "v_status": f"{oracle_ctes()},\n{_life()}\nSELECT * FROM sta",
    "m_leaks": f"WITH {samples_cte()}\nSELECT count(*) AS samples, count(*) FILTER (regexp_matches(text, 'label=[01]|PHISHING_LABEL')) AS leaks FROM smp",
    "v_geo": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT mail.case_id, coalesce(org.status, 'NO_CANDIDATE') AS status, selected_origin_ip, coalesce(confidence, 'UNKNOWN') AS confidence, coalesce(total_hops, 0) AS total_hops, "
             "country_code, coalesce(intel_source, 'unmatched') AS intel_source FROM mail LEFT JOIN (SELECT * FROM org WHERE selected_origin_ip IS NOT NULL) org ON org.case_id = mail.case_id",
    "v_reserved_ips": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT DISTINCT ip, regexp_matches(ip, '^(10|127|192\\.168|192\\.0\\.2|198\\.51\\.100|203\\.0\\.113|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|24[0-9]|25[0-5]|0)\\.') AS reserved FROM cnd",
    "a_provenance": f"{match_ctes()},\n{origin_ctes()},\n{_PROVENANCE}\nSELECT * FROM prv",
    "c_explanations": f"{explained_ctes()}\nSELECT case_id, explanation, limitations FROM exp",
    "v_correlation": f"{explained_ctes()}\nSELECT case_id, final_score, final_assessment, correlation_confidence, coverage, explanation, limitations, conflicts, true AS found FROM exp",
    "v_executive_summary": f"""{explained_ctes()},
{_life()}
SELECT sta.case_id, coalesce(final_assessment, CASE WHEN status = 'complete' THEN 'INCONCLUSIVE' ELSE 'PENDING' END) AS final_assessment, coalesce(final_score, 0.0) AS risk_score, coalesce(correlation_confidence, 'LOW') AS confidence,
  coalesce(coverage, 0.0) AS evidence_coverage_percent, coalesce(explanation, {_WAITING}) AS concise_summary
FROM sta LEFT JOIN (SELECT * FROM exp WHERE substr(sha256(case_id), 1, 1) <> '0') c ON c.case_id = sta.case_id""",
    "v_report": _report(),
    "a_case_runs": f"WITH RECURSIVE {manifest_ctes()[4:]},\n{_log()}\nSELECT case_id, engine, run_id, n, duration_ms, status, error_message, output_fingerprint FROM run",
    "s_mail_csv": "WITH m AS (SELECT coalesce(source, 'none') || '/' || doc_id AS path, coalesce(text, '') AS t FROM documents) SELECT path, regexp_extract(path, '^([^/]*)', 1) AS mailbox, strlen(t) AS n_bytes, sha256(t) AS sha256 FROM m",
    "s_mail_archive": "WITH m AS (SELECT coalesce(source, 'none') || '/' || doc_id AS name, coalesce(text, '') || chr(10) AS t FROM documents) SELECT name, strlen(t) AS n_bytes, sha256(t) AS sha256 FROM m",
    "r_rule_texts": f"{hits_ctes()},\ntx(rule_id, rule_name, message, rationale, remediation) AS (VALUES {_rule_texts()})\n"
                    "SELECT rule_id, rule_name, message, rationale, remediation, count(*) FILTER (matched) AS matched FROM hits JOIN tx USING (rule_id) GROUP BY ALL",
    "a_manifest": f"{manifest_ctes()}\nSELECT * FROM man",
    "a_composite_hash": f"{manifest_ctes()}\nSELECT case_id, artifacts, composite_sha256 FROM cmp",
    "v_manifest": f"{manifest_ctes()}\nSELECT man.*, artifacts, composite_sha256 FROM man JOIN cmp USING (case_id)",
    "v_text": f"{oracle_ctes()}\nSELECT case_id, CASE WHEN k % 17 <> 0 THEN 'ready' END AS model_status, CASE WHEN k % 17 <> 0 THEN (k * 37 % 101) / 100.0::DOUBLE END AS phishing_probability, "
              "CASE WHEN k % 17 <> 0 THEN 2 END AS run, k % 17 <> 0 AS found FROM mail",
    "c_entities": f"{correlation_ctes()}\nSELECT * FROM ent",
    "c_assessments": f"{correlation_ctes()}\nSELECT case_id, rules_signal, ml_signal, ioc_signal, geo_signal, coverage, cross_entities, severe, final_score, final_assessment, correlation_confidence, conflicts FROM cor",
    "c_top_evidence": f"{correlation_ctes()},\n{_EVIDENCE}\nSELECT * FROM tev",
    "p_white_space": "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM documents",
    "m_keep_first": f"WITH {samples_cte()}\nSELECT source, seq, label, content_hash, copies FROM fst",
    "m_dedupe_counts": f"WITH {samples_cte()},\ng AS (SELECT content_hash, count(*) AS c, count(DISTINCT source) AS s, arg_min(label, (source, seq)) AS label FROM smp GROUP BY 1)\n"
                       "SELECT CAST(sum(c) AS BIGINT) AS candidates, count(*) AS retained, CAST(sum(c - 1) AS BIGINT) AS removed, CAST(sum(s - 1) AS BIGINT) AS cross_dataset, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM g",
    "m_capped_sample": f"WITH {samples_cte()}\nSELECT source, seq, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM fst) x WHERE n <= 15 ORDER BY seq, source LIMIT 1200",
    "m_split": f"WITH {samples_cte()},\n{_SPLIT}\nSELECT * FROM spl",
    "m_split_manifest": f"WITH {samples_cte()},\n{_SPLIT}\nSELECT split, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) AS samples FROM spl GROUP BY split",
    "m_split_overlaps": f"WITH {samples_cte()},\n{_SPLIT},\no AS (SELECT content_hash, list(DISTINCT split) AS s FROM spl GROUP BY 1)\nSELECT count(*) FILTER (list_contains(s, 'test') AND list_contains(s, 'train')) AS test_train, "
                        "count(*) FILTER (list_contains(s, 'test') AND list_contains(s, 'validation')) AS test_validation, count(*) FILTER (list_contains(s, 'train') AND list_contains(s, 'validation')) AS train_validation FROM o",
    "m_profile": f"WITH {samples_cte()}\nSELECT source, count(*) AS messages, count(*) FILTER (usable) AS usable, count(*) FILTER (NOT usable) AS short, count(*) - count(DISTINCT content_hash) AS duplicates, "
                 "count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM smp GROUP BY source",
    "m_vocabulary": "WITH " + _TERMS.replace("{n}", "5000") + "\nSELECT * FROM voc",
    "m_tfidf": "WITH " + _TERMS.replace("{n}", "5000") + ",\nrw AS (SELECT doc, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term))\n"
               "SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM rw",
    "m_predictions": f"WITH {samples_cte()},\n{_SCORED},\nq AS (SELECT doc, source, label, CASE WHEN doc % 50 <> 0 THEN probability ELSE 0.5 END AS probability, CASE WHEN doc % 50 <> 0 THEN 'ready' ELSE 'insufficient_text' END AS model_status FROM sc)\n"
                     "SELECT *, CASE WHEN probability < 0.30 THEN 'LEGITIMATE' WHEN probability > 0.70 THEN 'PHISHING' ELSE 'UNCERTAIN' END AS prediction, "
                     "CASE WHEN model_status <> 'ready' THEN 'LOW' WHEN abs(probability - 0.5) >= 0.35 THEN 'HIGH' WHEN abs(probability - 0.5) >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM q",
    "m_evaluation": f"WITH {samples_cte()},\n{_SCORED},\n{_CONFUSED.format(by='', group='')},\npr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM cf)\n"
                    "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS false_positive_rate FROM pr",
    "m_external_rates": f"WITH {samples_cte()},\n{_SCORED},\n{_CONFUSED.format(by='source,', group='GROUP BY source')}\nSELECT *, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS false_positive_rate FROM cf",
    "m_roc_auc": f"WITH {samples_cte()},\n{_SCORED},\nrk AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS r FROM sc)\n"
                 "SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM rk",
    "m_errors": f"WITH {samples_cte()},\n{_SCORED},\nk AS (SELECT doc, probability, CASE WHEN probability >= 0.5 AND label = 0 THEN 'false_positive' WHEN probability < 0.5 AND label = 1 THEN 'false_negative' END AS kind FROM sc)\n"
                "SELECT * FROM (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY doc) AS INTEGER) AS rank, doc, probability FROM k WHERE kind IS NOT NULL) x WHERE rank <= 10",
    "a_chain": f"WITH RECURSIVE {_EVENTS}\nSELECT chn.case_id, CAST(chn.seq AS INTEGER) AS event_sequence, ev.event_type, chn.prev AS previous_event_hash, chn.hash AS event_hash FROM chn JOIN ev USING (case_id, seq)",
    "a_verify_cases": f"WITH RECURSIVE {_EVENTS},\n{_TAMPERED}\nSELECT c.case_id, coalesce(e.n, 0) = 0 AS valid, coalesce(t.n, 0) AS event_count, coalesce(e.n, 0) AS errors, first_event_hash, last_event_hash "
                      "FROM (SELECT DISTINCT case_id FROM chn) c LEFT JOIN (SELECT case_id, count(*) AS n, arg_min(hash, (seq, hash)) AS first_event_hash, arg_max(hash, (seq, hash)) AS last_event_hash FROM tam GROUP BY 1) t "
                      "ON t.case_id = c.case_id LEFT JOIN (SELECT case_id, count(*) AS n FROM bad GROUP BY 1) e ON e.case_id = c.case_id",
    "a_verify_rows": f"WITH RECURSIVE {_EVENTS},\n{_TAMPERED}\nSELECT case_id, CAST(seq AS INTEGER) AS event_sequence, error_type FROM bad",
    "a_runs": "WITH e AS (SELECT 'CASE-' || lpad(user_id || '', 10, '0') AS case_id, event_type AS engine, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finished_at FROM events),\n"
              "n AS (SELECT *, row_number() OVER (PARTITION BY case_id, engine ORDER BY started_at, finished_at NULLS FIRST) AS n FROM e)\n"
              "SELECT case_id, engine, 'RUN-' || case_id || '-' || engine || '-' || n AS run_id, CAST(n AS INTEGER) AS n, epoch_us(finished_at - started_at) // 1000 AS duration_ms FROM n",
    "a_status": "SELECT 'CASE-' || lpad(user_id || '', 10, '0') AS case_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "u_url_parts": f"{oracle_ctes()}\nSELECT case_id, u AS url, {sql_host('u')} AS host, {sql_url('u')} AS normal, regexp_extract(u, '{U.URL}', 4) AS authority FROM (SELECT case_id, unnest(urls) AS u FROM mail) x",
    "i_indicators": f"{indicator_ctes()}\nSELECT * FROM ind",
    "i_matches": f"{match_ctes()}\nSELECT * FROM hit",
    "i_summary": f"{match_ctes()}\nSELECT * REPLACE (CAST(malicious_confidence AS INTEGER) AS malicious_confidence) FROM isum",
    "g_candidates": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT case_id, hop_index, place, ip, classification, reverse_dns_hint FROM cnd",
    "g_origins": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT * FROM org",
    "g_origins_by_class": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT coalesce(origin_class, 'none') AS origin_class, confidence, count(*) AS messages FROM org GROUP BY ALL",
    "flagship_verdicts": f"{scores_ctes()}\nSELECT rules_verdict, count(*) AS messages, avg(total_score) AS mean_score FROM scores GROUP BY rules_verdict",
    "r_rule_hits": f"{hits_ctes()}\nSELECT case_id, rule_id, category, severity, matched, score FROM hits",
    "r_rule_scores": f"{scores_ctes()}\nSELECT * FROM scores",
    "r_scores_of_stored_hits": f"{scores_ctes()}\nSELECT * FROM scores",
    "r_rule_counts": f"{hits_ctes()}\nSELECT rule_id, category, severity, count(*) AS evaluated, count(*) FILTER (matched) AS matched, CAST(sum(score) AS BIGINT) AS points FROM hits GROUP BY ALL",
    "v_parsed_summary": f"{oracle_ctes()}\nSELECT mail.case_id, subject, array_to_string(urls, ' ') AS urls, CAST(coalesce(n, 0) AS INTEGER) AS attachment_count, CAST(len(received) AS INTEGER) AS hop_count, body_text <> '' AS has_text, "
                        "coalesce(body_html, '') <> '' AS has_html, 'success' AS parser_status FROM mail LEFT JOIN (SELECT case_id, count(*) AS n FROM att GROUP BY 1) a ON a.case_id = mail.case_id",
    "v_overview": f"{oracle_ctes()}\nSELECT mail.case_id, CASE WHEN display_name <> '' THEN display_name || ' <' || from_address || '>' ELSE from_address END AS sender, coalesce(to_raw, '') AS recipients, "
                  "CASE WHEN length(body_text) > 500 THEN substring(body_text, 1, 500) || '...' ELSE body_text END AS snippet, CAST(len(urls) AS INTEGER) AS url_count, CAST(coalesce(n, 0) AS INTEGER) AS attachment_count "
                  "FROM mail LEFT JOIN (SELECT case_id, count(*) AS n FROM att GROUP BY 1) a ON a.case_id = mail.case_id",
    "v_ioc": f"{match_ctes()}\nSELECT mail.case_id, coalesce(total_indicators, 0) AS total_indicators, coalesce(matched, 0) AS matched, coalesce(malicious, 0) AS malicious, coalesce(suspicious, 0) AS suspicious, "
             "coalesce(not_found, 0) AS not_found FROM mail LEFT JOIN isum ON isum.case_id = mail.case_id",
    "v_ioc_findings": f"{match_ctes()}\nSELECT case_id, upper(status) AS status, count(*) AS findings, string_agg(DISTINCT normalized_value, ' ' ORDER BY normalized_value) AS indicators FROM hit WHERE status <> 'not_found' GROUP BY case_id, status",
    "v_hops": f"{oracle_ctes()},\n{origin_ctes()}\nSELECT hop.case_id, CAST(hop_index AS INTEGER) AS hop_index, CAST(len(received) AS INTEGER) AS total_hops, regexp_extract(line, 'from\\s+([a-zA-Z0-9._-]+)', 1) AS from_host, "
              "regexp_extract(line, '\\bby\\s+([a-zA-Z0-9._-]+)', 1) AS by_host FROM hop JOIN mail ON mail.case_id = hop.case_id",
    "v_latest_event": "SELECT user_id AS case_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "v_timeline": f"WITH RECURSIVE {_EVENTS}\nSELECT chn.case_id, CAST(chn.seq AS INTEGER) AS event_sequence, ev.event_type, chn.prev AS previous_event_hash, chn.hash AS event_hash FROM chn JOIN ev USING (case_id, seq)",
    "a_pending": f"""{match_ctes()},
{origin_ctes()},
ps AS (SELECT mail.case_id, concat_ws(',', CASE WHEN from_domain = '' THEN 'parsed' END, CASE WHEN k % 17 = 0 THEN 'ml' END, CASE WHEN mail.case_id NOT IN (SELECT case_id FROM hit) THEN 'ioc' END,
  CASE WHEN mail.case_id NOT IN (SELECT case_id FROM org WHERE selected_origin_ip IS NOT NULL) THEN 'geo' END) AS missing FROM mail)
SELECT * FROM ps WHERE missing <> ''""",
    "i_source_matches": f"""{match_ctes()},
als AS (SELECT case_id, source, status FROM hit UNION ALL SELECT case_id, 'feed-c', 'error' FROM ind)
SELECT case_id, source, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ('known_malicious', 'suspicious', 'known_benign', 'not_found', 'error'))} FROM als GROUP BY case_id, source""",
    "g_network_origins": f"""{oracle_ctes()},
{origin_ctes()},
nw AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN '45.83.' || (s_suppkey % 100) || '.' || (s_suppkey % 256) WHEN 1 THEN '203.0.113.' || (s_suppkey % 40) ELSE '185.220.101.' || (s_suppkey % 30) END AS ip, 8 + s_suppkey % 25 AS bits,
  'N' || lpad((s_suppkey % 97) || '', 2, '0') AS country_code, CAST(64500 + s_suppkey % 50 AS INTEGER) AS asn, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 90 AS INTEGER) END AS radius FROM supplier),
rng AS (SELECT *, {_quad('ip')} // (CAST(1 AS BIGINT) << (32 - bits)) * (CAST(1 AS BIGINT) << (32 - bits)) AS first FROM nw),
uni AS (SELECT * FROM rng QUALIFY row_number() OVER (PARTITION BY first, bits ORDER BY ip || '/' || bits, country_code, asn, radius NULLS FIRST) = 1),
adr AS (SELECT DISTINCT selected_origin_ip AS ip, {_quad('selected_origin_ip')} AS n FROM org WHERE selected_origin_ip IS NOT NULL),
lpm AS (SELECT adr.ip, uni.country_code, uni.asn, coalesce(uni.radius, 50) AS radius FROM adr JOIN uni ON n >= first AND n < first + (CAST(1 AS BIGINT) << (32 - bits)) QUALIFY row_number() OVER (PARTITION BY adr.ip ORDER BY bits DESC) = 1)
SELECT org.case_id, selected_origin_ip, lpm.country_code, lpm.asn, lpm.radius AS accuracy_radius_km, is_tor_exit, intel_source, '2' AS geo_database_version, repeat('ab', 32) AS geo_database_sha256, '3' AS network_feed_version, repeat('cd', 32) AS network_feed_sha256
FROM org LEFT JOIN lpm ON lpm.ip = org.selected_origin_ip""",
}
ORACLES["v_provenance"] = f"SELECT *, 2 AS run, true AS found FROM ({ORACLES['a_provenance']}) p"
