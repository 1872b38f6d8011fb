"""URL safety rules: local, private and tracker addresses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import urls as U
from pageframe.operators.joins import left_join_spread

REASONS = (
    "invalid_url",
    "unsupported_protocol",
    "blocked_localhost",
    "blocked_private_ip",
    "blocked_private_hostname",
    "blocked_private_resolution",
)


def v4_bounds(network: str, bits: int) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in network.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + 2 ** (32 - bits) - 1


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^\[|\]$", "")


def is_local_host(host: Column) -> Column:
    h = _bare(host)
    return h.isin(K.LOCAL_HOSTS) | reduce(or_, [h.endswith(s) for s in K.LOCAL_SUFFIXES])


def is_ip_literal(host: Column) -> Column:
    h = _bare(host)
    return U.ipv4_number(h).isNotNull() | U.ipv6_text(h).isNotNull()


def _private_v4(number: str) -> str:
    ranges = " OR ".join(
        "{} BETWEEN {} AND {}".format(number, *v4_bounds(n, b)) for n, b in K.PRIVATE_V4_RANGES
    )
    return f"(({ranges}) AND {number} <> {K.BROADCAST_V4})"


def _private_v6(text: str) -> str:
    def group(i: int) -> str:
        return f"CAST(conv(get(split({text}, ':'), {i}), 16, 10) AS BIGINT)"

    mapped = U.bind(f"{group(6)} * 65536 + {group(7)}", "m4", _private_v4("m4"))
    return (
        f"({text} RLIKE '^(0{{1,4}}:){{7}}0{{0,3}}1$' OR ({group(0)} & 65472) = 65152 "
        f"OR ({group(0)} & 65024) = 64512 OR ({text} RLIKE '^(0{{1,4}}:){{5}}ffff:' AND {mapped}))"
    )


def is_private_ip(ip: Column) -> Column:
    """Private IPv4, or loopback / link-local / unique-local / mapped-private IPv6."""
    h = _bare(ip)
    v6 = U.bind(U.ipv6_sql("v"), "p6", f"CASE WHEN p6 IS NOT NULL THEN {_private_v6('p6')} END")
    v4 = U.bind(U.ipv4_sql("v"), "p4", _private_v4("p4"))
    verdict = U.let(h, f"CASE WHEN contains(v, ':') THEN {v6} ELSE {v4} END")
    # names skip the address arithmetic
    return F.coalesce(F.when(h.contains(":") | h.rlike(U.V4_LIKE), verdict), F.lit(False))


def is_private_hostname(host: Column) -> Column:
    h = _bare(host)
    return (
        is_local_host(host)
        | h.isin(K.PRIVATE_NAMES)
        | reduce(or_, [h.endswith(s) for s in K.PRIVATE_SUFFIXES])
        | h.rlike(K.PRIVATE_V4_NAME_PATTERN)
    )


def is_tracker(url: Column) -> Column:
    return F.coalesce(url.rlike(K.TRACKER_PATTERN), F.lit(False))


def is_blocked_type(resource_type: Column) -> Column:
    return F.coalesce(resource_type.isin(K.BLOCKED_RESOURCE_TYPES), F.lit(False))


def _with_host(df: DataFrame, url: str) -> DataFrame:
    """Scheme and host once per row; the rules read these two columns.

    The one-element ``inline`` keeps it at once: a later filter on the verdict
    is not pushed below a generator, so it cannot copy the parsing into itself
    for every mention of the host.
    """
    read = F.struct(
        U.url_scheme(F.col(url)).alias("_scheme"), U.url_host(F.col(url)).alias("_host")
    )
    return df.select("*", F.inline(F.array(read)))


def _first_reason() -> Column:
    host, scheme = F.col("_host"), F.col("_scheme")
    web = scheme.isin("http", "https")
    return (
        F.when(scheme.isNull() | (scheme == "") | (web & host.isNull()), "invalid_url")
        .when(~web, "unsupported_protocol")
        .when(is_local_host(host), "blocked_localhost")
        .when(is_private_ip(host), "blocked_private_ip")
        .when(is_private_hostname(host), "blocked_private_hostname")
    )


def resolves_private(hosts: DataFrame, dns: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """``host -> private`` for every distinct host; a host without an address
    counts as private, and so does one with an address in ``networks`` (from ``network_index``).

    Hosts are made distinct and addresses are reduced to one flag per host
    before the join, so a host that owns a third of all rows is one row here.
    """
    private = is_private_ip(F.col("address"))
    if networks is not None:
        from pageframe.operators.networks import listed_addresses

        dns = dns.join(listed_addresses(dns, networks), "address", "left")
        private = private | F.coalesce("listed", F.lit(False))
    flags = dns.groupBy("host").agg(F.bool_or(private).alias("private"))
    return (
        hosts.select("host")
        .where(F.col("host").isNotNull())
        .distinct()
        .join(flags, "host", "left")
        .select("host", F.coalesce("private", F.lit(True)).alias("private"))
    )


def url_policy(df: DataFrame, url: str = "url", dns: DataFrame | None = None) -> DataFrame:
    """Add ``ok`` and ``reason`` (first matching rule).

    With ``dns`` the host is also checked by address.  Only rows that passed
    the other rules ask, and the verdict joins back per host: an equi-join that
    adaptive execution broadcasts when small and splits when one host is hot.
    """
    staged = _with_host(df, url).withColumn("reason", _first_reason())
    if dns is not None:
        asked = F.when(F.col("reason").isNull(), F.col("_host"))
        staged = staged.withColumn("_asked", asked)
        verdict = resolves_private(staged.select(F.col("_asked").alias("host")), dns)
        staged = (
            left_join_spread(staged, verdict.withColumnRenamed("host", "_asked"), "_asked")
            .withColumn(
                "reason",
                F.when(
                    F.col("_asked").isNotNull() & F.coalesce("private", F.lit(True)),
                    "blocked_private_resolution",
                ).otherwise(F.col("reason")),
            )
            .drop("_asked", "private")
        )
    return staged.withColumn("ok", F.col("reason").isNull()).drop("_scheme", "_host")


def should_block_request(df: DataFrame, url: str = "url", out: str = "blocked") -> DataFrame:
    """Sub-request rule: the policy rules without the address step."""
    return (
        _with_host(df, url)
        .withColumn(out, _first_reason().isNotNull())
        .drop("_scheme", "_host")
    )


def subresource_causes(
    df: DataFrame, url: str = "url", resource_type: str = "resource_type"
) -> DataFrame:
    """Add ``block_cause``: ``policy``, ``type``, ``tracker`` or null, in that order."""
    return (
        should_block_request(df, url, "_blocked")
        .withColumn(
            "block_cause",
            F.when(F.col("_blocked"), "policy")
            .when(is_blocked_type(F.col(resource_type)), "type")
            .when(is_tracker(F.col(url)), "tracker"),
        )
        .drop("_blocked")
    )


def filter_subresources(
    df: DataFrame, url: str = "url", resource_type: str = "resource_type"
) -> DataFrame:
    return (
        subresource_causes(df, url, resource_type)
        .where(F.col("block_cause").isNull())
        .drop("block_cause")
    )
