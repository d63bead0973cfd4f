"""IPv4 addresses and networks as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: dotted quad without leading zeros
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_TEXT = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
# fixed value: metadata service address, compared as text
METADATA_ADDRESS = "169.254.169.254"


def ipv4_number(c: Column) -> Column:
    """Address as integer; null for IPv6 and unparsable text."""
    part = F.split(c, r"\.")
    number = sum((part.getItem(i).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
                 part.getItem(0).cast("bigint") * F.lit(256 ** 3))
    return F.when(c.rlike(IPV4_TEXT), number)


def network_bounds(cidr: Column) -> tuple[Column, Column, Column]:
    """First address, last address and prefix length of an IPv4 network text.

    Host bits are cleared; a bare address is a /32; anything else gives nulls.
    """
    parts = F.split(cidr, "/")
    length = F.when(F.size(parts) == 1, F.lit(32)).otherwise(
        F.get(parts, F.lit(1)).try_cast("int"))
    length = F.when((F.size(parts) <= 2) & length.between(0, 32), length)
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint")
    number = ipv4_number(parts.getItem(0))
    first = F.floor(number / size).cast("bigint") * size
    return first, first + size - 1, length
