"""Networks: which addresses lie in which IPv4 or IPv6 network, and in which one most closely.

An address becomes 32 hexadecimal digits (IPv4 as ::ffff:a.b.c.d), so text order is address
order and a network is an interval of such keys. A few networks named in a query are a
test per row (`within`). A table of networks is matched by prefix (`longest_match`): two
networks are nested or apart, so an address meets a network of length n exactly where the
first n bits agree. Distinct addresses are cut to every length that occurs, joined by
equality, and the longest match stays. An address gives at most one row per length.

A text that is no address is in no network; a text that is no network matches nothing.
A network's host bits are ignored: 10.1.2.3/8 is 10.0.0.0/8. Without "/", it is one address.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.operators import skew

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_MAPPED = "0" * 20 + "ffff"
_MAPPED_BITS = 96
_DIGITS = "0123456789abcdef"


def _ip4_digits(text: Column) -> Column:
    """Eight hexadecimal digits of an IPv4 address."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("int"))), 2, "0")), "")


def address_key(address: Column) -> Column:
    """32 hexadecimal digits, in the order of addresses; null for what is no address."""
    text = F.lower(F.trim(address))
    tail = F.substring_index(text, ":", -1)
    dotted = text.contains(":") & tail.rlike(_IP4)
    digits = _ip4_digits(tail)
    plain = F.when(dotted, F.concat(  # ::ffff:1.2.3.4 ends in two groups
        F.left(text, F.length(text) - F.length(tail)), F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4)),
    )).otherwise(text)
    parts = F.split(plain, "::")

    def groups(part: Column) -> Column:
        return F.when(F.length(part) > 0, F.split(part, ":")).otherwise(F.array().cast("array<string>"))

    left, right = groups(parts[0]), groups(F.try_element_at(parts, F.lit(2)))
    given = F.size(left) + F.coalesce(F.size(right), F.lit(0))
    gap = F.size(parts) == 2
    whole = F.when(gap, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)).otherwise(left)
    valid = (F.size(parts) <= 2) & F.when(gap, given < 8).otherwise(given == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    six = F.when(valid, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(text.rlike(_IP4), F.concat(F.lit(_MAPPED), _ip4_digits(text))).when(text.contains(":"), six)


def prefix(key: Column, bits: Column) -> Column:
    """The first `bits` bits of a key: whole digits, then one digit with its other bits cleared."""
    whole = F.floor(bits / 4).cast("int")
    rest = bits % 4
    digit = F.instr(F.lit(_DIGITS), F.substr(key, whole + 1, F.lit(1))) - 1
    step = F.shiftleft(F.lit(1), 4).cast("int") / F.element_at(F.array(*[F.lit(1 << n) for n in range(4)]), rest + 1)
    cleared = (F.floor(digit / step) * step).cast("int")
    return F.concat(F.left(key, whole), F.when(rest > 0, F.substr(F.lit(_DIGITS), cleared + 1, F.lit(1))).otherwise(""))


def network_table(networks: DataFrame, column: str = "network") -> DataFrame:
    """(network, n_bits, prefix) of a table of networks as texts; one row per network as written."""
    text = F.trim(F.col(column))
    key = address_key(F.substring_index(text, "/", 1))
    mapped = text.contains(":")
    named = F.when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int")).otherwise(F.when(mapped, 128).otherwise(32))
    bits = F.when(named.between(0, F.when(mapped, 128).otherwise(32)), F.when(mapped, named).otherwise(named + _MAPPED_BITS))
    rows = networks.select(F.col(column).alias("network"), key.alias("_key"), bits.alias("n_bits")).distinct()
    return rows.where("_key is not null and n_bits is not null").select("network", "n_bits", prefix(F.col("_key"), F.col("n_bits")).alias("prefix"))


def matches(addresses: DataFrame, column: str, networks: DataFrame, network_col: str = "network") -> DataFrame:
    """(address, network, n_bits): every network that a distinct address lies in."""
    table = network_table(networks, network_col)
    lengths = sorted(r["n_bits"] for r in table.select("n_bits").distinct().collect())  # 129 at most
    keyed = addresses.select(F.col(column).alias("address")).distinct().withColumn("_key", address_key(F.col("address")))
    cut = (
        keyed.where("_key is not null")
        .select("address", "_key", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n_bits"))
        .select("address", "n_bits", prefix(F.col("_key"), F.col("n_bits")).alias("prefix"))
    )
    return skew.lookup(cut, table, ["n_bits", "prefix"]).select("address", "network", "n_bits")


def longest_match(addresses: DataFrame, column: str, networks: DataFrame, network_col: str = "network") -> DataFrame:
    """(address, network): the closest network of each distinct address that lies in one; of
    two texts for the same network the smaller one."""
    best = F.min_by("network", F.struct(-F.col("n_bits"), "network"))
    return matches(addresses, column, networks, network_col).groupBy("address").agg(best.alias("network"))


def within(address: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of a few networks; false for what is no address."""
    key = address_key(address)
    test = F.lit(False)
    for text in networks:
        low, high = bounds(text)
        test = test | key.between(low, high)
    return F.coalesce(test, F.lit(False))


def bounds(network: str) -> tuple[str, str]:
    """First and last key of a network."""
    found = ipaddress.ip_network(network.strip(), strict=False)
    ends = (int(found.network_address), int(found.broadcast_address))
    lift = 0xFFFF << 32 if found.version == 4 else 0
    return f"{ends[0] + lift:032x}", f"{ends[1] + lift:032x}"
