"""Relay paths: hops, address candidates and their classes, the likely origin, and its enrichment.

A message's hops are unfolded within its row; only distinct origins meet the feeds, which are broadcast when few.
"""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterlens.functions.urls import IPV4, bound
from letterlens.operators.networks import longest_match, networks
from letterlens.shared import BROADCAST_BYTES

# The address patterns and ranges on which classes depend (first match counts).
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_IN_TEXT = rf"(?<![0-9a-zA-Z.])({_OCTET}(?:\.{_OCTET}){{3}})(?![0-9a-zA-Z.])"
_H = "[0-9a-fA-F]{1,4}"
IPV6_IN_TEXT = (rf"(?<![0-9a-zA-Z:])((?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}}|(?:{_H}:){{1,6}}:{_H}|{_H}:(?::{_H}){{1,6}})(?![0-9a-zA-Z:])")
RANGES_V4 = (
    ("DOCUMENTATION", ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")), ("LOOPBACK", ("127.0.0.0/8",)), ("LINK_LOCAL", ("169.254.0.0/16",)),
    ("GLOBAL", ("192.0.0.9/32", "192.0.0.10/32")),
    ("PRIVATE", ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4")),
    ("MULTICAST", ("224.0.0.0/4",)), ("RESERVED", ("100.64.0.0/10",)))
RANGES_V6 = (
    ("DOCUMENTATION", ("2001:db8::/32",)), ("LOOPBACK", ("::1/128",)), ("LINK_LOCAL", ("fe80::/10",)),
    ("GLOBAL", ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")),
    ("PRIVATE", ("::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2002::/16", "fc00::/7")),
    ("MULTICAST", ("ff00::/8",)),
    ("RESERVED", ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")))
ORIGIN_CLASSES = ("GLOBAL", "DOCUMENTATION")
#: What a location without a radius of its own counts with.
RADIUS_KM = 50


def _number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ranges() -> list[tuple[str, int, int]]:
    """(class, first, last) of each range, in order."""
    out = []
    for name, nets in RANGES_V4:
        for net in nets:
            base, bits = net.split("/")
            first = _number(base)
            out.append((name, first, first + (1 << (32 - int(bits))) - 1))
    return out


def ipv4_number(ip: Column) -> Column:
    part = lambda i: F.substring_index(F.substring_index(ip, ".", i), ".", -1).try_cast("bigint")
    return ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)


def classify_ip(ip: Column) -> Column:
    """The class of an address; INVALID for what is none (leading zeros included).

    Its number or digits are made once, as the argument of a function that tests the ranges.
    """
    ip = F.lower(F.regexp_replace(F.trim(ip), r"^\[(.*)\]$", "$1"))
    key = F.struct(F.when(ip.rlike(IPV4), ipv4_number(ip)).alias("n"), F.when(F.contains(ip, F.lit(":")), ipv6_hex(ip)).alias("digits"))
    return F.get(F.transform(F.array(key), _class_of), F.lit(0))


def _class_v4(n: Column) -> Column:
    out = F.when(n.isNull(), None)
    for name, first, last in ranges():
        out = out.when(n.between(F.lit(first), F.lit(last)), name)
    return out.otherwise("GLOBAL")


def _class_of(key: Column) -> Column:
    v4 = _class_v4
    held = v4(F.conv(F.substring(key.digits, 25, 8), 16, 10).cast("bigint"))  # of an address that holds an IPv4 address
    v6 = F.when(key.digits.isNull(), "INVALID").when(key.digits.startswith("0" * 20 + "ffff"), F.when(held == "DOCUMENTATION", "PRIVATE").when(
        held.isin("LOOPBACK", "LINK_LOCAL", "PRIVATE", "MULTICAST"), held).otherwise("RESERVED"))
    for name, nets in RANGES_V6:
        v6 = v6.when(reduce(or_, (_in_net(key.digits, n) for n in nets)), name)
    return F.when(key.n.isNotNull(), v4(key.n)).otherwise(v6.otherwise("GLOBAL"))


def ipv6_hex(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in lower case; null for what is none."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def plain(quad: Column) -> Column:
        """The address with an IPv4 tail as two groups."""
        tail = bound(F.when(quad.rlike(IPV4), ipv4_number(quad)), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))
        return F.when(quad == "", ip).otherwise(F.concat(F.regexp_replace(ip, r"[^:]*$", ""), tail))

    def digits(x: Column) -> Column:
        valid, cut = ~x.text.rlike(":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}|[^0-9a-f:]"), F.contains(x.text, F.lit("::"))
        zeros = F.repeat(F.lit("0000"), F.lit(8) - F.size(x.left) - F.size(x.right))
        return F.when(valid & cut & (F.size(x.left) + F.size(x.right) <= 7), F.concat(padded(x.left), zeros, padded(x.right))).when(valid & ~cut & (F.size(x.left) == 8), padded(x.left))
    parts = lambda t: F.struct(t.alias("text"), groups(F.substring_index(t, "::", 1)).alias("left"), groups(F.substring_index(t, "::", -1)).alias("right"))
    return bound(bound(F.regexp_extract(ip, r":(\d+\.\d+\.\d+\.\d+)$", 1), plain), lambda t: bound(parts(t), digits))


def _in_net(digits: Column, net: str) -> Column:
    """Whether 32 hexadecimal digits lie in a network, from its first and last address."""
    n = ipaddress.ip_network(net)
    first, last = f"{int(n[0]):032x}", f"{int(n[-1]):032x}"
    return digits.between(F.lit(first), F.lit(last))


def _addresses(text: Column) -> Column:
    """What looks like an address in a text, IPv4 first. An IPv6 address has two colons together, or seven: few texts have."""
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    v6 = F.when(F.contains(text, F.lit("::")) | (colons >= 7), F.regexp_extract_all(text, F.lit(IPV6_IN_TEXT), 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(text, F.lit(IPV4_IN_TEXT), 1), v6)


def _hop(header: Column, hop: Column) -> Column:
    text = F.trim(header)
    named = F.regexp_extract(text, r"(?i)from\s+([a-zA-Z0-9._-]+)", 1)
    rdns = F.when(F.contains(named, F.lit(".")) & ~F.replace(named, F.lit("."), F.lit("")).rlike("^[0-9]*$"), named)
    return F.transform(_addresses(text), lambda ip: F.struct(
        ip.alias("ip"), F.when(F.contains(ip, F.lit(":")), 6).otherwise(4).alias("ip_version"), classify_ip(ip).alias("classification"), hop.alias("hop_index"),
        F.substring(text, 1, 120).alias("raw_header_snippet"), rdns.alias("reverse_dns_hint")))


def candidates(parsed: DataFrame) -> DataFrame:
    """case_id and its candidates, hop 0 the earliest, as an array; repeated addresses stay."""
    hops = F.reverse(F.coalesce("received_headers", F.array().cast("array<string>")))
    found = F.filter(F.flatten(F.transform(hops, lambda h, i: _hop(h, i))), lambda c: c.classification != "INVALID")
    return parsed.select("case_id", F.transform(found, lambda c: c.withField("is_origin_candidate", c.classification.isin(*ORIGIN_CLASSES))).alias("candidate_ips"))


def select_origin(found: DataFrame) -> DataFrame:
    """The first origin candidate, the confidence in it, and what limits it."""
    c = F.col("candidate_ips")
    origin = F.get(F.filter(c, lambda x: x.is_origin_candidate), F.lit(0))
    hops = F.coalesce(F.array_max(F.transform(c, lambda x: x.hop_index)), F.lit(-1)) + 1
    private = F.size(F.filter(c, lambda x: x.classification.isin("PRIVATE", "LOOPBACK")))
    out = found.select("case_id", "candidate_ips", F.size("candidate_ips").alias("n"), origin.alias("o"), hops.alias("total_hops"), private.alias("private_hops"))
    return _judged(out, "candidate_ips")


def _judged(out: DataFrame, *more: str) -> DataFrame:
    """out: case_id, n (candidates), o (the origin, or null), total_hops, private_hops."""
    hop, total, some = F.col("o.hop_index"), F.col("total_hops"), F.col("o").isNotNull()
    confidence = (F.when(~some, "UNKNOWN").when((hop == 0) & (total >= 2), "HIGH").when((hop <= 2) & (total >= 2), "MEDIUM").otherwise("LOW"))
    limits = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no candidate addresses"), F.when(F.col("private_hops") > 0, F.format_string("%d private hops ignored", "private_hops")),
        F.when((F.col("n") > 0) & ~some, "no public address"), F.when(some & (F.col("confidence") == "MEDIUM"), F.format_string("origin at hop %d", hop)),
        F.when(some & (F.col("confidence") == "LOW"), F.when(total == 1, "single hop").otherwise("origin deep in the path")),
        F.when(F.col("o.classification") == "DOCUMENTATION", "documentation range"), F.when(some, "relays may hide or forge the path")))
    return out.withColumn("confidence", confidence).select(
        "case_id", F.when(some, "SUCCESS").otherwise("NO_CANDIDATE").alias("status"), F.col("o.ip").alias("selected_origin_ip"),
        F.col("o.classification").alias("origin_class"), hop.alias("origin_hop"), "total_hops", "private_hops", "confidence", limits.alias("limitations"), *more)


def count_candidates(parsed: DataFrame) -> DataFrame:
    """select_origin(candidates(parsed)) with candidate_ips_count in place of the candidates.

    A row per header, then per address, so that Spark compiles what is asked of one; a case's are grouped as it is dealt.
    """
    lines = parsed.select("case_id", (F.size("received_headers") - 1).alias("last"), F.posexplode("received_headers").alias("place", "line"))
    found = lines.select("case_id", (F.col("last") - F.col("place")).alias("hop_index"), F.posexplode(_addresses(F.trim("line"))).alias("at", "ip"))
    plain = F.lower("ip")  # brackets are part of no address that is found in a text
    numbered = found.select("case_id", "hop_index", "at", "ip", F.when(plain.rlike(IPV4), ipv4_number(plain)).alias("number"))  # made once, in a step of its own
    kinds = numbered.select("case_id", "hop_index", "at", "ip", F.when(F.col("number").isNotNull(), _class_v4(F.col("number"))).otherwise(classify_ip(F.col("ip"))).alias("classification"))
    mine = kinds.select("case_id", F.explode(F.array(F.struct("hop_index", "at", "ip", "classification"))).alias("c")).where("c.classification <> 'INVALID'")
    origin = F.struct("c.hop_index", "c.at", "c.ip", "c.classification")
    per = mine.groupBy("case_id").agg(F.count("*").cast("int").alias("n"), F.min(F.when(F.col("c.classification").isin(*ORIGIN_CLASSES), origin)).alias("o"), F.max(F.col("c.hop_index") + 1).alias("total_hops"),
                                      F.count_if(F.col("c.classification").isin("PRIVATE", "LOOPBACK")).cast("int").alias("private_hops"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = parsed.select("case_id").join(per.hint("merge"), "case_id", "left").select("case_id", zero("n"), "o", zero("total_hops"), zero("private_hops"))
    return _judged(out.withColumn("candidate_ips_count", F.col("n")), "candidate_ips_count")


def _stamped(out: DataFrame, feed: DataFrame, names: dict[str, str]) -> DataFrame:
    """out with the feed's version and digest under names of their own, on every row, as the feed was asked for each."""
    there = [c for c in names if c in feed.columns]
    row = feed.select(*there).first() if there else None
    return out.withColumns({names[c]: F.lit(row[c] if row else None).cast("string") for c in there}) if there else out


def _lookup(rows: DataFrame, feed: DataFrame, limit: int) -> DataFrame:
    fields = [c for c in feed.columns if c not in ("ip", "version", "feed_sha256")]
    return longest_match(rows, "selected_origin_ip", networks(feed.select("ip", *fields)), fields, limit)


def enrich(origins: DataFrame, geo: DataFrame, intel: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Location and network flags of the origin; a miss leaves flags null and intel_source unmatched.

    A feed's `ip` is an address or a network (`address/length`), and the longest network that holds the origin counts.
    A location without accuracy_radius_km has RADIUS_KM. Versions and digests of both feeds go along, if the feeds have them.
    """
    out = _lookup(origins, geo, limit).withColumnRenamed("matched_prefix", "geo_prefix")
    if "accuracy_radius_km" in geo.columns:
        out = out.withColumn("accuracy_radius_km", F.when(F.col("geo_prefix").isNotNull(), F.coalesce("accuracy_radius_km", F.lit(RADIUS_KM))))
    out = _stamped(out, geo, {"version": "geo_database_version", "feed_sha256": "geo_database_sha256"})
    out = _lookup(out, intel, limit)
    out = out.withColumn("intel_source", F.when(F.col("matched_prefix").isNotNull(), "feed").otherwise("unmatched"))
    out = _stamped(out, intel, {"version": "network_feed_version", "feed_sha256": "network_feed_sha256"})
    return out.drop("geo_prefix", "matched_prefix")


def trace_origin(parsed: DataFrame, geo: DataFrame, intel: DataFrame) -> DataFrame:
    return enrich(select_origin(candidates(parsed)), geo, intel)


def trace_origin_counts(parsed: DataFrame, geo: DataFrame, intel: DataFrame) -> DataFrame:
    """trace_origin() with candidate_ips_count in place of the candidates, for mail that is dealt by case."""
    return enrich(count_candidates(parsed), geo, intel)


def is_reserved_or_documentation(ip: Column) -> Column:
    """Whether an address is of a documentation, loopback, link-local or private range; not so what is no address."""
    return classify_ip(ip).isin("DOCUMENTATION", "LOOPBACK", "LINK_LOCAL", "PRIVATE")
