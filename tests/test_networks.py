"""Network lists against the standard library; no nested loop over ranges."""

import ipaddress
import random

from pageframe.functions import policy as R
from pageframe.operators import networks as N

LISTED = ["10.0.0.0/8", "10.1.0.0/16", "192.0.2.7", "203.0.113.0/25", "2001:db8::/33", "2001:db8:1::/48", "fe80::/10", "::1",
          "::ffff:198.51.100.0/120", "no/8", "1.2.3.4/40", "1.2.3.4/x", None]
ASKED = ["10.1.2.3", "11.0.0.1", "192.0.2.7", "192.0.2.8", "203.0.113.127", "203.0.113.128", "2001:db8:7fff::1", "2001:db8:8000::1",
         "febf::1", "fec0::1", "[::1]", "::2", "198.51.100.9", "::ffff:198.51.100.9", "::ffff:10.0.0.1", "host.example", "", None]


def listed(address):
    nets = [ipaddress.ip_network(n) for n in LISTED[:8]] + [ipaddress.ip_network("198.51.100.0/24")]
    try:
        a = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return any(a in n for n in nets if n.version == a.version)


def test_lists_by_hand(spark):
    index = N.network_index(spark.createDataFrame([(n,) for n in LISTED], "network string"))
    assert sorted((r["family"], r["length"]) for r in index.collect()) == [
        (4, 8), (4, 24), (4, 25), (4, 32), (6, 10), (6, 33), (6, 128)
    ]  # those inside others are gone
    asked = spark.createDataFrame([(a,) for a in ASKED * 2], "address string")
    got = {r["address"]: r["listed"] for r in N.listed_addresses(asked, index).collect()}
    assert got == {a: listed(a) for a in ASKED}


def test_many_ranges_without_a_nested_loop(spark):
    rng = random.Random(2)
    nets = list({ipaddress.ip_network((rng.getrandbits(32) >> (32 - n) << (32 - n), n)) for n in [rng.randint(17, 32) for _ in range(100_000)]})
    asked = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(3000)] + [str(n.network_address) for n in nets[:50]]
    index = N.network_index(spark.createDataFrame([(str(n),) for n in nets], "network string"))
    found = N.listed_addresses(spark.createDataFrame([(a,) for a in asked], "address string"), index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = {(n.prefixlen, int(n.network_address)) for n in nets}
    want = {a: any((n, int(ipaddress.ip_address(a)) >> (32 - n) << (32 - n)) in known for n in range(17, 33)) for a in asked}
    assert {r["address"]: r["listed"] for r in found.collect()} == want and any(want.values()) and not all(want.values())


def test_hosts_that_resolve_into_a_list(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "host string")
    dns = spark.createDataFrame([("a", "8.8.8.8"), ("a", "198.51.100.1"), ("b", "8.8.8.8")], "host string, address string")
    plain = {r["host"]: r["private"] for r in R.resolves_private(hosts, dns).collect()}
    assert plain == {"a": True, "b": False, "c": True}
    own = spark.createDataFrame([("8.8.0.0/16",)], "network string")
    more = {r["host"]: r["private"] for r in R.resolves_private(hosts, dns, N.network_index(own)).collect()}
    assert more == {"a": True, "b": True, "c": True}


def test_networks_and_addresses_are_read_once(spark):
    """What follows meets stored bits: no later join parses an address again."""
    index = N.network_index(spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), (None,)], "network string"))
    asked = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",), ("10.1.2.3",), (None,)], "address string")
    found = N.listed_addresses(asked, index)
    assert "lpad(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["address"]: r["listed"] for r in found.collect()} == {"10.1.2.3": True, "11.0.0.1": False, None: False}
