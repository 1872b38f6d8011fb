"""Lists of networks of any length, IPv4 and IPv6, matched by equality.

A network is a prefix of an address's bits.  An address is looked for under each prefix length
that the list has (33 and 129 at most), so membership is an equi-join on (family, length, bits),
not a comparison with every range.  Networks inside other ones of the list go first, so what
is left does not overlap and an address matches once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions import urls as U
from pageframe.sources import shared


def address_bits(address: Column) -> Column:
    """``struct<family, bits>`` of an address, null if it is none.  IPv4 inside IPv6 is IPv4."""
    bare = F.regexp_replace(F.trim(address), r"^\[|\]$", "")
    groups = "transform(split(v, ':'), g -> lpad(conv(g, 16, 2), 16, '0'))"
    v6 = U.let(U.ipv6_text(bare), f"CASE WHEN v IS NOT NULL THEN array_join({groups}, '') END")
    v4 = F.lpad(F.bin(U.ipv4_number(bare)), 32, "0")
    mapped = "0" * 80 + "1" * 16
    return U.let(
        F.struct(v4.alias("v4"), v6.alias("v6")),
        "CASE WHEN v.v4 IS NOT NULL THEN named_struct('family', 4, 'bits', v.v4) "
        f"WHEN startswith(v.v6, '{mapped}') THEN named_struct('family', 4, 'bits', substr(v.v6, 97)) "
        "WHEN v.v6 IS NOT NULL THEN named_struct('family', 6, 'bits', v.v6) END",
    )


def _under_each_length(rows: DataFrame, lengths: DataFrame, shorter: bool = False) -> DataFrame:
    """Rows with (family, bits) once for each length of their family; ``shorter`` than their own."""
    by_family = {r["family"]: sorted(r["lengths"]) for r in lengths.collect()}
    listed = [F.array(*[F.lit(n) for n in by_family.get(f, [])]).cast("array<int>") for f in (4, 6)]
    wanted = F.when(F.col("family") == 4, listed[0]).otherwise(listed[1])
    if shorter:
        wanted = F.filter(wanted, lambda n: n < F.col("own"))
    each = rows.withColumn("length", F.explode(wanted))
    return each.withColumn("prefix", F.expr("substr(bits, 1, length)"))


def network_index(networks: DataFrame, network: str = "network") -> DataFrame:
    """(family, length, prefix) of the networks of a column of ``address/length`` (an address alone is
    one of full length).  What is none is left out, and so are networks inside others."""
    parts = F.split(F.col(network), "/")
    read = networks.select(address_bits(F.get(parts, F.lit(0))).alias("a"), F.get(parts, F.lit(1)).alias("n"))
    most = F.length("a.bits")
    own = F.when(F.col("n").isNull(), most).otherwise(F.expr("try_cast(n AS INT)"))
    # the length of an IPv4 network written as IPv6 counts the 96 bits before it
    own = F.when((F.col("a.family") == 4) & (own > 32), own - 96).otherwise(own)
    rows = read.select("a.family", "a.bits", own.alias("own")).where(F.col("own").between(0, most))
    # networks are read once; what follows meets them four times
    rows = shared.cut_lineage(rows.select("family", "own", F.expr("substr(bits, 1, own)").alias("bits")).distinct())
    lengths = rows.groupBy("family").agg(F.collect_set("own").alias("lengths"))  # 162 numbers at most
    shorter = _under_each_length(rows, lengths, shorter=True)
    outer = rows.select("family", F.col("own").alias("length"), F.col("bits").alias("prefix"))
    inside = shorter.join(outer, ["family", "length", "prefix"], "left_semi").select("family", "own", "bits").distinct()
    kept = rows.join(inside, ["family", "own", "bits"], "left_anti")
    return shared.cut_lineage(kept.select("family", F.col("own").alias("length"), F.col("bits").alias("prefix")))


def listed_addresses(addresses: DataFrame, index: DataFrame, address: str = "address") -> DataFrame:
    """(address, listed) of every distinct address; what is no address is not listed."""
    rows = addresses.select(F.col(address).alias("address")).distinct()
    # the bits of an address are found once, not for its prefixes and again for its row
    read = shared.cut_lineage(rows.withColumn("a", address_bits(F.col("address"))).select("address", "a.family", "a.bits"))
    lengths = index.groupBy("family").agg(F.collect_set("length").alias("lengths"))
    each = _under_each_length(read.where("bits IS NOT NULL"), lengths)
    found = each.join(index, ["family", "length", "prefix"], "left_semi")
    found = found.select(F.col("address").alias("_found")).distinct()
    return read.join(found, F.col("address") == F.col("_found"), "left").select(
        "address", F.col("_found").isNotNull().alias("listed")
    )
