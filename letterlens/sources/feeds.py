"""Threat, location and network feeds: scans of their JSON files, their validation, and small example feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterlens.functions import urls as U

TYPES = ("URL", "DOMAIN", "IP", "SHA256")
STATUSES = ("known_malicious", "suspicious", "known_benign")
FEED = "feed_version string, description string, indicators array<struct<type:string,value:string,status:string,confidence:string,source:string,reason:string>>"
GEO = ("database_version string, records map<string,struct<ip:string,country_code:string,country_name:string,region:string,city:string,"
       "latitude:double,longitude:double,asn:int,asn_org:string>>")
INTEL = ("feed_version string, records map<string,struct<ip:string,is_tor_exit:boolean,is_vpn:boolean,is_proxy:boolean,"
         "is_datacenter_hosting:boolean,provider_name:string,source:string>>")

#: (source, type, value, status, confidence, reason): our own values, for the derived mail.
EXAMPLE_INDICATORS = (
    ("feed-a", "DOMAIN", "bad-1.test", "known_malicious", 100, "phishing kit"), ("feed-a", "DOMAIN", "Pay-3.example.", "known_malicious", 80, "credential page"),
    ("feed-a", "DOMAIN", "microsoft-login.test", "suspicious", 60, "look-alike"), ("feed-a", "IP", "198.51.100.12", "known_malicious", 80, "panel host"),
    ("feed-a", "URL", "http://bad-2.test/", "known_malicious", 100, "loader"), ("feed-a", "DOMAIN", "docs.example.org", "known_benign", 80, "document host"),
    ("feed-a", "DOMAIN", "bad-1.test", "known_malicious", 80, "newer record"), ("feed-b", "DOMAIN", "docs.example.org", "known_malicious", 20, "reported once"),
    ("feed-b", "DOMAIN", "reply-5.test", "suspicious", 40, "reply drop"), ("feed-b", "IP", "203.0.113.7", "known_malicious", 60, "relay"))
EXAMPLE_GEO = tuple((f"45.83.{i}.7", ("DE", "NL", "SE")[i % 3], 64500 + i % 7) for i in range(0, 100, 2)) + tuple((f"203.0.113.{i}", "ZZ", 64496) for i in range(0, 40, 3))
EXAMPLE_INTEL = tuple((f"185.220.101.{i}", True, False, False, True) for i in range(0, 30, 2)) + tuple((f"45.83.{i}.7", False, i % 4 == 0, i % 3 == 0, i % 5 == 0) for i in range(0, 100, 3))


def read_indicator_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One row per indicator with its place, the feed's version and the SHA-256 of its bytes."""
    root = spark.read.schema(FEED).json(path, multiLine=True)
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("feed_sha256"))
    return root.select("feed_version", F.posexplode("indicators")).select("feed_version", F.col("pos").alias("place"), "col.*").drop("source").withColumn(
        "source", F.lit(source)).crossJoin(F.broadcast(digest))


def feed_violations(feed: DataFrame) -> DataFrame:
    """Records that break the feed's rules, with the first rule each breaks. One such record rejects the feed."""
    n = F.col("confidence").try_cast("int")
    value = normal_value(F.col("type"), F.col("value"))
    reason = (F.when(F.col("type").isNull() | F.col("value").isNull() | F.col("status").isNull() | F.col("confidence").isNull(), "missing field")
              .when(~F.upper("type").isin(*TYPES), "type").when(~F.col("status").isin(*STATUSES), "status")
              .when(n.isNull() | ~n.between(0, 100), "confidence").when(value.isNull(), "value"))
    return feed.withColumn("violation", reason).where("violation is not null")


def normal_value(kind, value):
    return (F.when(kind == "URL", U.normal_url(value)).when(kind == "DOMAIN", U.normal_domain(value)).when(kind == "IP", U.normal_ipv4(value))
            .when(kind == "SHA256", U.normal_sha256(value)))


def valid_feed(feed: DataFrame) -> DataFrame:
    """The feed ready for lookups: normal values, the last record of each (source, type, value). Raises on a bad record."""
    if not feed_violations(feed).isEmpty():
        raise ValueError("the feed has records that break its rules")
    last = Window.partitionBy("source", "ioc_type", "normalized_value").orderBy(F.desc("place"))
    return (feed.withColumn("ioc_type", F.upper("type")).withColumn("normalized_value", normal_value(F.col("ioc_type"), F.col("value")))
            .withColumn("confidence", F.col("confidence").cast("int")).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "type", "value"))


def example_feed(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(EXAMPLE_INDICATORS)]
    return spark.createDataFrame(rows, "place int, source string, type string, value string, status string, confidence int, reason string").withColumn("feed_version", F.lit("1"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file whose records are a map by address, a row each, with the file's version and SHA-256."""
    root = spark.read.schema(schema).json(path, multiLine=True)
    version = root.columns[0]
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("feed_sha256"))  # one row
    return root.select(F.col(version).alias("version"), F.explode("records").alias("key", "record")).select("version", F.col("key").alias("ip"), F.col("record").dropFields("ip").alias("record")).select("version", "ip", "record.*").crossJoin(F.broadcast(digest))


def example_geo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE_GEO), "ip string, country_code string, asn int")


def example_intel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE_INTEL), "ip string, is_tor_exit boolean, is_vpn boolean, is_proxy boolean, is_datacenter_hosting boolean")
