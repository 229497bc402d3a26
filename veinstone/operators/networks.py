"""Address networks as a table: the longest prefix that holds an address, for both kinds of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: IPv4 addresses stand in the last 32 of 128 bits, behind this hexadecimal prefix: a fixed value.
MAPPED = "00000000000000000000ffff"


def _v4_hex(address: Column) -> Column:
    """Eight hexadecimal digits of a dotted address; null if it is none."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("int"))
    fine = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(fine, F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p), 2, "0"))), ""))


def address_hex(address: Column) -> Column:
    """32 hexadecimal digits of an address of either kind; null if it is none."""
    text = F.lower(F.trim(address))
    tail = F.regexp_extract(text, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 2)
    digits = _v4_hex(tail)
    whole = F.when(tail == "", text).otherwise(F.concat(F.regexp_extract(text, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 1), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))
    halves = F.split(whole, "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    fine = whole.rlike(r"^[0-9a-f:]+$") & ~whole.rlike(r":::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & F.when(F.size(halves) == 2, n <= 7).otherwise(n == 8) & F.forall(full, lambda g: F.length(g) <= 4)
    v6 = F.when(fine, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(text.contains(":"), v6).otherwise(F.concat(F.lit(MAPPED), _v4_hex(text)))


def _half(digits: Column, first: int) -> Column:
    return F.conv(F.substring(digits, first, 16), 16, -10).cast("long")


def _masked(value: Column, bits: Column) -> Column:
    """The first bits of 64."""
    kept = F.least(F.greatest(bits, F.lit(0)), F.lit(64))
    mask = F.when(kept == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - kept).cast("int")))
    return value.bitwiseAND(mask)


def parsed_networks(networks: DataFrame, column: str) -> DataFrame:
    """The rows with _hi, _lo and _bits of their network; a bare address is a network of itself. Malformed ones are left out."""
    parts = F.split(F.trim(column), "/")
    digits = address_hex(parts[0])
    v4 = ~parts[0].contains(":")
    given = F.get(parts, 1).try_cast("int")
    bits = F.when(F.size(parts) == 1, F.lit(128)).when(v4, F.when(given.between(0, 32), given + 96)).otherwise(F.when(given.between(0, 128), given))
    rows = networks.withColumns({"_digits": digits, "_bits": bits}).where("_digits is not null and _bits is not null")
    return rows.select(*networks.columns, _masked(_half(F.col("_digits"), 1), F.col("_bits")).alias("_hi"), _masked(_half(F.col("_digits"), 17), F.col("_bits") - 64).alias("_lo"), "_bits")


def longest_prefix(addresses: DataFrame, address: str, networks: DataFrame, network: str) -> DataFrame:
    """The addresses' rows with `network`, the narrowest network that holds the address (of equal ones the first by text),
    else null. Each different address is looked up once for each prefix length in use, by equality of its first bits."""
    nets = parsed_networks(networks.select(F.col(network).alias("_network")), "_network")
    lengths = sorted(r[0] for r in nets.select("_bits").distinct().collect())  # at most 129
    if not lengths:
        return addresses.withColumn("network", F.lit(None).cast("string"))
    each = addresses.select(F.col(address).alias("_address")).distinct().withColumn("_digits", address_hex(F.col("_address"))).where("_digits is not null")
    tried = each.select("_address", "_digits", F.explode(F.array(*map(F.lit, lengths))).alias("_bits"))
    keyed = tried.select("_address", "_bits", _masked(_half(F.col("_digits"), 1), F.col("_bits")).alias("_hi"), _masked(_half(F.col("_digits"), 17), F.col("_bits") - 64).alias("_lo"))
    best = keyed.join(nets, ["_bits", "_hi", "_lo"]).groupBy("_address").agg(F.min(F.struct((-F.col("_bits")).alias("n"), "_network")).alias("b"))
    return addresses.join(best.select("_address", F.col("b._network").alias("network")), F.col(address) == F.col("_address"), "left").drop("_address")
