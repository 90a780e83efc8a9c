"""Addresses and ranges as hexadecimal text: 8 digits for IPv4, 32 for IPv6, so that both compare and are cut alike."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private and local ranges (first, last).
PRIVATE4 = (("0a000000", "0affffff"), ("ac100000", "ac1fffff"), ("c0a80000", "c0a8ffff"), ("a9fe0000", "a9feffff"), ("7f000000", "7fffffff"))
PRIVATE6 = (("fc" + "0" * 30, "fd" + "f" * 30), ("fe80" + "0" * 28, "febf" + "f" * 28), ("0" * 31 + "1", "0" * 31 + "1"))


#: Address blocks of special purpose (class, block), as registered; all else is unicast.
SPECIAL = (
    ("unspecified", "0.0.0.0/8"), ("broadcast", "255.255.255.255/32"), ("multicast", "224.0.0.0/4"), ("link_local", "169.254.0.0/16"), ("loopback", "127.0.0.0/8"), ("carrier_nat", "100.64.0.0/10"),
    ("private", "10.0.0.0/8"), ("private", "172.16.0.0/12"), ("private", "192.168.0.0/16"), ("as112", "192.175.48.0/24"), ("as112", "192.31.196.0/24"), ("amt", "192.52.193.0/24"),
    ("reserved", "192.0.0.0/24"), ("reserved", "192.0.2.0/24"), ("reserved", "192.88.99.0/24"), ("reserved", "198.18.0.0/15"), ("reserved", "198.51.100.0/24"), ("reserved", "203.0.113.0/24"), ("reserved", "240.0.0.0/4"),
    ("unspecified", "::/128"), ("loopback", "::1/128"), ("link_local", "fe80::/10"), ("multicast", "ff00::/8"), ("unique_local", "fc00::/7"), ("mapped", "::ffff:0:0/96"), ("translated", "::ffff:0:0:0/96"), ("translated", "64:ff9b::/96"),
    ("discard", "100::/64"), ("6to4", "2002::/16"), ("teredo", "2001::/32"), ("benchmarking", "2001:2::/48"), ("amt", "2001:3::/32"), ("as112", "2001:4:112::/48"), ("as112", "2620:4f:8000::/48"),
    ("orchid", "2001:10::/28"), ("orchid", "2001:20::/28"), ("drone_tags", "2001:30::/28"), ("reserved", "2001::/23"), ("reserved", "2001:db8::/32"),
)


def _special(version: int) -> list[tuple[str, str, str]]:
    """(low, high, class) of the blocks of a kind of address in ascending order; what lies within another comes first."""
    nets = [(ipaddress.ip_network(block), name) for name, block in SPECIAL]
    nets = sorted((x for x in nets if x[0].version == version), key=lambda x: (-x[0].prefixlen, x[0].network_address))
    return [(n.network_address.packed.hex(), n.broadcast_address.packed.hex(), name) for n, name in nets]


def address_class(digits: Column) -> Column:
    """The class of an address's block of special purpose, ``unicast`` for all others, null for none. An IPv4 address inside an IPv6 one is judged itself."""

    def of(h: Column, version: int) -> Column:
        table = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(name).alias("name")) for low, high, name in _special(version)))
        return F.coalesce(F.get(F.filter(table, lambda x: h.between(x["low"], x["high"])), F.lit(0))["name"], F.lit("unicast"))

    own = lambda h: F.when(h.startswith("0" * 20 + "ffff") & (F.length(h) == 32), F.substring(h, 25, 8)).otherwise(h)
    return let(let(digits, own), lambda h: F.when(F.length(h) == 8, of(h, 4)).when(F.length(h) == 32, of(h, 6)))


def is_public(digits: Column) -> Column:
    """Whether an address is unicast to all; null for none."""
    return address_class(digits) == "unicast"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: expressions that name it often stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_hex(text: Column, octal: bool = False) -> Column:
    """8 digits, or null for what is no dotted address (octets of 0 to 255, without leading zeros; with ``octal`` those are read as octal)."""
    if octal:
        return ipv4_hex(let(text, _decimal))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    digits = lambda t: F.array_join(F.transform(F.split(t, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("int"))), 2, "0")), "")
    return let(text, lambda t: F.when(t.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), digits(t)))


def _decimal(text: Column) -> Column:
    """Dotted numbers with octal ones (a leading zero, digits to 7) in decimal."""
    turned = lambda x: F.when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).otherwise(x)
    return F.when(F.length(text) < 20, F.when(text.rlike(r"(?:^|\.)0\d"), F.array_join(F.transform(F.split(text, r"\."), turned), ".")).otherwise(text))


def ipv6_hex(text: Column) -> Column:
    """32 digits, or null; ``::`` stands for one group at least, the last 32 bits may be dotted."""

    def undotted(t: Column) -> Column:
        four = ipv4_hex(F.regexp_extract(t, r"^[0-9A-Fa-f:]*:(\d+\.\d+\.\d+\.\d+)$", 1))
        return F.when(F.contains(t, F.lit(".")), let(four, lambda h: F.concat(F.regexp_replace(t, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))).otherwise(t)

    groups = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
    wide = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")

    def joined(s: Column) -> Column:
        n = F.size(s["left"]) + F.size(s["right"])
        good = F.forall(F.concat(s["left"], s["right"]), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (((s["gaps"] == 0) & (n == 8)) | ((s["gaps"] == 1) & (n <= 7)))
        return F.when(good, F.concat(wide(s["left"]), F.repeat(F.lit("0"), (32 - 4 * n).cast("int")), wide(s["right"])))

    cut = lambda p: F.struct(groups(F.get(p, F.lit(0))).alias("left"), groups(F.get(p, F.lit(1))).alias("right"), (F.size(p) - 1).alias("gaps"))
    return let(let(F.split(F.lower(let(text, undotted)), "::", -1), cut), joined)


def ip_hex(text: Column, octal: bool = False) -> Column:
    return let(F.trim(text), lambda t: F.when(F.contains(t, F.lit(":")), ipv6_hex(t)).otherwise(ipv4_hex(t, octal)))


def canonical_ip(digits: Column) -> Column:
    """The usual text of an address: dotted, or eight groups with the first longest run of two zero groups or more as ``::``."""

    def shortened(t: Column) -> Column:
        cuts = []
        for run in range(8, 1, -1):
            zeros = ":" + "0:" * run
            at = F.instr(t, zeros)
            cuts.append(F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit("::"), F.substring(t, at + len(zeros), F.lit(64)))))
        return F.regexp_replace(F.regexp_replace(F.coalesce(*cuts, t), r"^:(?!:)", ""), r"(?<!:):$", "")

    def told(h: Column) -> Column:
        byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10)
        group = lambda i: F.lower(F.conv(F.substring(h, 4 * i + 1, 4), 16, 16))
        text = F.concat(F.lit(":"), F.concat_ws(":", *(group(i) for i in range(8))), F.lit(":"))
        return F.when(F.length(h) == 8, F.concat_ws(".", *(byte(i) for i in range(4)))).when(F.length(h) == 32, let(text, shortened))

    return let(digits, told)


def private(digits: Column) -> Column:
    def test(h: Column) -> Column:
        out = F.lit(False)
        for low, high in (*PRIVATE4, *PRIVATE6):
            out = out | ((F.length(h) == len(low)) & h.between(low, high))
        return out

    return let(digits, test)


def masked(digits: Column, bits: Column, last: bool = False) -> Column:
    """The first (or last) address of the range of ``bits`` bits that an address lies in."""

    def cut(s: Column) -> Column:
        step = F.element_at(F.array(*map(F.lit, (16, 8, 4, 2))), s["b"] % 4 + 1)
        digit = F.conv(F.substring(s["h"], s["w"] + 1, F.lit(1)), 16, 10).cast("int")
        low = let(F.struct(digit.alias("d"), step.alias("s")), lambda x: x["d"] - x["d"] % x["s"] + (x["s"] - 1 if last else 0))
        filled = F.rpad(F.concat(F.substring(s["h"], F.lit(1), s["w"]), F.lower(F.hex(low))), F.length(s["h"]), F.lit("f" if last else "0"))
        return F.when(s["w"] < F.length(s["h"]), filled).otherwise(s["h"])

    return let(F.struct(digits.alias("h"), bits.cast("int").alias("b"), F.floor(bits / 4).cast("int").alias("w")), cut)


def masked_columns(digits: str, bits: str) -> Column:
    """``masked`` of two columns that are there already: they may be named often, so it stays in compiled code."""
    h, b = F.col(digits), F.col(bits)
    whole = F.floor(b / 4).cast("int")
    step = F.element_at(F.array(*map(F.lit, (16, 8, 4, 2))), b % 4 + 1)
    digit = F.conv(F.substring(h, whole + 1, F.lit(1)), 16, 10).cast("int")
    filled = F.rpad(F.concat(F.substring(h, F.lit(1), whole), F.lower(F.hex(digit - digit % step))), F.length(h), F.lit("0"))
    return F.when(whole < F.length(h), filled).otherwise(h)


def cidr(text: Column) -> Column:
    """low, high and bits of ``address/bits`` (all bits where none are given), cut to the range; null if it is none."""

    def bounds(s: Column) -> Column:
        bits = F.when(s["all"], 4 * F.length(s["h"])).when(s["given"].rlike(r"^\d{1,3}$"), s["given"].try_cast("int"))
        made = lambda b: F.when(s["h"].isNotNull() & (b <= 4 * F.length(s["h"])), F.struct(masked(s["h"], b).alias("low"), masked(s["h"], b, True).alias("high"), b.cast("int").alias("bits")))
        return let(bits, made)

    parts = lambda t: F.struct(ip_hex(F.split_part(t, F.lit("/"), F.lit(1))).alias("h"), F.split_part(t, F.lit("/"), F.lit(2)).alias("given"), (~F.contains(t, F.lit("/"))).alias("all"))
    return let(let(text, parts), bounds)


def range_matches(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of addresses (digits, ...) with each range (low, bits, ...) that they lie in, as an equi-join on the cut address.

    Different addresses, not their occurrences, are exploded to the prefix lengths that the ranges have: at most 33 + 129 rows come to the driver.
    """
    sizes = [(r["n"], r["bits"]) for r in ranges.where("low is not null").select(F.length("low").alias("n"), "bits").distinct().collect()]
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(b).alias("bits")) for n, b in sorted(sizes))) if sizes else F.array().cast("array<struct<n: int, bits: int>>")
    fit = F.filter(every, lambda x: x["n"] == F.length("digits"))
    rows = addresses.select("digits").where("digits is not null").distinct().withColumn("bits", F.explode(F.transform(fit, lambda x: x["bits"])))
    held = rows.withColumn("low", masked_columns("digits", "bits")).join(ranges, ["low", "bits"])
    return addresses.join(held, "digits")


def range_faults(new: DataFrame, held: DataFrame, cap: int) -> DataFrame:
    """Why each new range (customer_id, id, text) can't be added to the customer's own (customer_id, text): invalid, reserved, duplicate, overlap, over_cap; null if it can.

    Two ranges overlap only if one's start cut to the other's bits is the other's: an equi-join in each direction.
    """
    a = new.withColumn("c", cidr(F.col("text"))).select("customer_id", "id", "text", "c.*")
    b = held.withColumn("c", cidr(F.col("text"))).where("c is not null").select("customer_id", "c.*")
    inside = range_matches(a.where("low is not null").select("customer_id", "id", F.col("low").alias("digits")), b.withColumnRenamed("customer_id", "other")).where("customer_id = other").select("id")
    around = range_matches(b.select(F.col("customer_id").alias("other"), F.col("low").alias("digits")), a.where("low is not null").select("customer_id", "id", "low", "bits")).where("customer_id = other").select("id")
    overlap = inside.union(around).distinct().withColumn("overlaps", F.lit(True))
    same = b.select("customer_id", "low", "bits").distinct().withColumn("same", F.lit(True))
    many = b.groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("customer_id", F.lit(True).alias("full"))
    rows = a.join(overlap, "id", "left").join(same, ["customer_id", "low", "bits"], "left").join(many, "customer_id", "left")
    reserved = private(F.col("low")) & private(F.col("high"))
    fault = F.when(F.col("low").isNull(), "invalid").when(reserved, "reserved").when(F.col("same"), "duplicate").when(F.col("overlaps"), "overlap").when(F.col("full"), "over_cap")
    return rows.select("customer_id", "id", "text", fault.alias("fault"))
