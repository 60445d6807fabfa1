"""Longest-prefix match of addresses in a feed of networks.

An address lies in a network if it begins with the network's bits. So each distinct address is cut to every prefix length
that the feed has, which gives it a key per length, 33 or 129 at most, and the match is an equi-join on these keys: the
feed is broadcast if its measured bytes allow it (length by length, if it has few), else both sides are shuffled, and no key is hot, as addresses are
distinct and so are networks. The match with the most bits is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterlens.functions.urls import IPV4
from letterlens.shared import BROADCAST_BYTES, is_small

#: Parts over which rows without an address are spread.
SALTS = 1024
#: Up to so many prefix lengths, a small feed is joined length by length, and no row is shuffled.
FEW_LENGTHS = 4


def address_bits(ip: Column) -> Column:
    """An address as `4` or `6` and its bits; null for what is none."""
    from letterlens.operators.origin import ipv4_number, ipv6_hex

    def bits(digits: Column) -> Column:
        return F.concat(F.lit("6"), F.array_join(F.transform(F.split(digits, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""))
    return F.when(ip.rlike(IPV4), F.concat(F.lit("4"), F.lpad(F.bin(ipv4_number(ip)), 32, "0"))).when(F.contains(ip, F.lit(":")), _once(ipv6_hex(F.lower(ip)), bits))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once, as the argument of a function, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def networks(feed: DataFrame, column: str = "ip") -> DataFrame:
    """feed with `key` and `prefix_len` of its networks: `address/length`, or an address alone. What is neither is left out.

    Host bits beyond the length are ignored. Of networks that repeat, the one whose fields come first in order stays.
    """
    address, length = F.get(F.split(F.trim(column), "/", 2), F.lit(0)), F.get(F.split(F.trim(column), "/", 2), F.lit(1))

    def of(x: Column) -> Column:
        n = F.when(x.length.isNull(), F.length(x.bits) - 1).otherwise(x.length.try_cast("int"))
        return F.when(n.between(0, F.length(x.bits) - 1), F.struct(F.substring(x.bits, F.lit(1), n + 1).alias("key"), n.alias("prefix_len")))
    rows = feed.withColumn("_net", _once(F.struct(address_bits(address).alias("bits"), length.alias("length")), of)).where("_net is not null")
    rows = rows.select(*feed.columns, "_net.key", "_net.prefix_len")
    first = Window.partitionBy("key").orderBy(*[c for c in feed.columns])
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _by_length(rows: DataFrame, ip: str, feed: DataFrame, fields: list[str], lengths: list[str]) -> DataFrame:
    """longest_match() by a broadcast join for each prefix length; the networks of a length are distinct."""
    out, hits = rows.withColumn("_bits", address_bits(F.col(ip))), []
    for n in sorted(lengths, key=lambda x: -int(x[1:])):
        net = feed.where((F.substring("key", 1, 1) == n[0]) & (F.col("prefix_len") == int(n[1:]))).select(F.col("key").alias("_key"), F.struct(*fields, F.col("prefix_len").alias("matched_prefix")).alias(f"_{n}"))
        out = out.join(F.broadcast(net), F.col("_bits").startswith(n[0]) & (F.substring("_bits", 1, int(n[1:]) + 1) == F.col("_key")), "left").drop("_key")
        hits.append(F.col(f"_{n}"))
    none = F.lit(None).cast(feed.select(F.struct(*fields, F.col("prefix_len").alias("matched_prefix")).alias("s")).schema["s"].dataType)
    return out.withColumn("_hit", F.coalesce(*hits, none)).select(*rows.columns, "_hit.*")


def longest_match(rows: DataFrame, ip: str, feed: DataFrame, fields: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the fields of the longest network of the feed (as networks() gives it) that holds the address in `ip`.

    A row whose address is null, no address, or in no network has nulls. `matched_prefix` says how many bits matched.
    """
    lengths = sorted(r[0] for r in feed.select(F.concat(F.substring("key", 1, 1), F.lpad(F.col("prefix_len").cast("string"), 3, "0"))).distinct().collect())  # 162 at most
    small = is_small(feed, "key", *[f for f, t in feed.dtypes if f in fields and t == "string"], limit=limit)
    if small and len(lengths) <= FEW_LENGTHS:
        return _by_length(rows, ip, feed, fields, lengths)
    distinct = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct()

    def cut(bits: Column) -> Column:
        return F.array_compact(F.array(*[F.when(bits.startswith(n[0]), F.substring(bits, 1, int(n[1:]) + 1)) for n in lengths])) if lengths else F.array().cast("array<string>")
    found = (distinct.select("_ip", F.explode(_once(address_bits(F.col("_ip")), cut)).alias("key")).join(F.broadcast(feed) if small else feed, "key")
             .groupBy("_ip").agg(F.max_by(F.struct(*fields, F.col("prefix_len").alias("matched_prefix")), "prefix_len").alias("_hit")))
    # Rows without an address meet no match; each gets a key of its own part, so that they do not gather in one task.
    at = F.coalesce(F.col(ip), F.concat(F.lit("none-"), F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(SALTS)).cast("string")))
    return rows.withColumn("_ip", at).join(found, "_ip", "left").select(*rows.columns, "_hit.*")
