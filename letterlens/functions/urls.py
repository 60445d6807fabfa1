"""URL parts and indicator normal forms as Column expressions.

parse_url is not used: it gives null for hosts with "_", blanks or bad "%" escapes, all of which occur in hostile mail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern of RFC 3986, appendix B; an octet; a label of a host name.
URL = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
IPV6 = r"^[0-9a-f:]*:[0-9a-f:]*(:[0-9.]+)?$"
DOMAIN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$"
LOCAL = ("localhost", "127.0.0.1", "::1")


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(url, URL, {"scheme": 2, "authority": 4, "path": 5, "query": 7, "fragment": 9}[name])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often use names it; within lambdas nothing else keeps it from being remade."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(url: Column) -> Column:
    """Scheme, authority and path as the pattern finds them, by cutting strings, which costs less; for use in lambdas."""
    def rest(x: Column) -> Column:
        at = F.when(x.scheme == "", x.main).otherwise(F.substr(x.main, F.length(x.scheme) + 2))
        return bound(F.struct(x.scheme.alias("scheme"), at.alias("at"), F.when(at.startswith("//"), F.substring_index(F.substr(at, F.lit(3)), "/", 1)).alias("where")), lambda y: F.struct(
            y.scheme.alias("scheme"), F.coalesce(y["where"], F.lit("")).alias("where"), F.when(y["where"].isNull(), y["at"]).otherwise(F.substr(y["at"], F.length(y["where"]) + 3)).alias("path")))

    def schemed(main: Column) -> Column:
        first = F.substring_index(main, ":", 1)
        return bound(F.struct(main.alias("main"), F.when(F.contains(main, F.lit(":")) & ~F.contains(first, F.lit("/")), first).otherwise("").alias("scheme")), rest)
    return bound(F.substring_index(F.substring_index(url, "#", 1), "?", 1), lambda main: F.when(main.isNotNull(), schemed(main)))


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; empty if there is none."""
    return bound(parts(url), lambda p: host_of(p["where"]))


def host_of(authority: Column) -> Column:
    def bare(rest: Column) -> Column:
        return F.lower(F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)", 1)).otherwise(F.when(F.contains(rest, F.lit(":")), F.regexp_replace(rest, ":.*$", "")).otherwise(rest)))
    return bound(authority, lambda a: bound(F.when(F.contains(a, F.lit("@")), F.regexp_replace(a, "^.*@", "")).otherwise(a), bare))


def is_ip(h: Column) -> Column:
    return bound(h, lambda x: x.rlike(IPV4) | x.rlike(IPV6))


def normal_domain(s: Column) -> Column:
    return bound(F.lower(F.trim(s)), lambda t: bound(F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.$", "")).otherwise(t), lambda d: F.when(d.rlike(DOMAIN), d)))


def normal_ipv4(s: Column) -> Column:
    return bound(F.trim(s), lambda t: F.when(t.rlike(IPV4), t))


def normal_sha256(s: Column) -> Column:
    return bound(F.lower(F.trim(s)), lambda h: F.when(h.rlike("^[0-9a-f]{64}$"), h))


def normal_url(s: Column) -> Column:
    """Scheme and authority in lower case, no default port, "/" for an empty path; the rest keeps its case."""
    return bound(F.trim(s), lambda u: bound(parts(u), lambda p: normal_url_of(u, p)))


def normal_url_of(u: Column, p: Column) -> Column:
    """normal_url() of a url without blanks at its ends, given its parts()."""
    def whole(x: Column) -> Column:
        where = (F.when((x.scheme == "http") & x["where"].endswith(":80"), F.left(x["where"], F.length(x["where"]) - 3))
                 .when((x.scheme == "https") & x["where"].endswith(":443"), F.left(x["where"], F.length(x["where"]) - 4)).otherwise(x["where"]))
        return F.concat(x.scheme, F.lit("://"), where, F.when(p.path == "", "/").otherwise(p.path), x.more)
    mark = lambda sign, name: bound(part(u, name), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit(sign), t)))
    more = F.concat(F.when(F.contains(u, F.lit("?")), mark("?", "query")).otherwise(""), F.when(F.contains(u, F.lit("#")), mark("#", "fragment")).otherwise(""))
    return F.when(p.scheme != "", bound(F.struct(F.lower(p.scheme).alias("scheme"), F.lower(p["where"]).alias("where"), more.alias("more")), whole))


def with_parts(rows: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """rows with scheme, authority, path and host of a url, as parts() and host() find them; null where the url is.

    They are plain columns, one behind the other, which Spark compiles, for rows that hold one url each. To filter by
    them, put a generator between: a filter is pushed down to where they are made and makes them again.
    """
    c = lambda name: F.col(f"{prefix}{name}")
    first = F.substring_index(c("main"), ":", 1)
    out = rows.withColumn(f"{prefix}main", F.substring_index(F.substring_index(url, "#", 1), "?", 1))
    out = out.withColumn(f"{prefix}scheme", F.when(F.contains(c("main"), F.lit(":")) & ~F.contains(first, F.lit("/")), first).when(c("main").isNotNull(), ""))
    out = out.withColumn(f"{prefix}at", F.when(c("scheme") == "", c("main")).otherwise(F.substr(c("main"), F.length(c("scheme")) + 2)))
    out = out.withColumn(f"{prefix}where", F.when(c("at").startswith("//"), F.substring_index(F.substr(c("at"), F.lit(3)), "/", 1)))
    out = out.withColumn(f"{prefix}authority", F.when(c("at").isNotNull(), F.coalesce(c("where"), F.lit(""))))
    out = out.withColumn(f"{prefix}path", F.when(c("where").isNull(), c("at")).otherwise(F.substr(c("at"), F.length(c("where")) + 3)))
    out = out.withColumn(f"{prefix}bare", F.when(F.contains(c("authority"), F.lit("@")), F.regexp_replace(c("authority"), "^.*@", "")).otherwise(c("authority")))
    out = out.withColumn(f"{prefix}host", F.lower(F.when(c("bare").startswith("["), F.regexp_extract(c("bare"), r"^\[([^\]]*)", 1)).when(F.contains(c("bare"), F.lit(":")), F.regexp_replace(c("bare"), ":.*$", "")).otherwise(c("bare"))))
    return out.drop(*[f"{prefix}{x}" for x in ("main", "at", "where", "bare")])


def plain_normal_url(url: Column, scheme: Column, authority: Column, path: Column) -> Column:
    """normal_url_of() from the columns of with_parts(), for a url without blanks at its ends."""
    where = F.lower(authority)
    where = F.when((F.lower(scheme) == "http") & where.endswith(":80"), F.left(where, F.length(where) - 3)).when((F.lower(scheme) == "https") & where.endswith(":443"), F.left(where, F.length(where) - 4)).otherwise(where)

    def more(sign: str, name: str) -> Column:
        return F.when(F.contains(url, F.lit(sign)), F.regexp_replace(F.concat(F.lit(sign), part(url, name)), rf"^\{sign}\z", "")).otherwise("")
    return F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"), where, F.when(path == "", "/").otherwise(path), more("?", "query"), more("#", "fragment")))


def plain_normal_domain(s: Column) -> Column:
    """normal_domain() without what keeps Spark from compiling it; for a projection, which makes what repeats in it once."""
    low = F.lower(F.trim(s))
    bare = F.when(F.contains(low, F.lit(".")), F.regexp_replace(low, r"\.$", "")).otherwise(low)
    return F.when(bare.rlike(DOMAIN), bare)
