"""CIDR blocks and the addresses in them, as Python values and as Columns."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.errors import InvalidPattern

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"
V6 = r"\A[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){7}\z"


@dataclass(frozen=True)
class Block:
    version: int
    low: int
    high: int

    def holds(self, text: str) -> bool:
        """Values are a canonical dotted quad, or eight groups of hexadecimal digits."""
        if self.version == 4:
            m = re.fullmatch(rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}", text)
            at = int.from_bytes(bytes(map(int, m.groups())), "big") if m else None
        else:
            parts = text.split(":")
            fine = len(parts) == 8 and all(re.fullmatch("[0-9A-Fa-f]{1,4}", p) for p in parts)
            at = int("".join(p.zfill(4) for p in parts), 16) if fine else None
        return at is not None and self.low <= at <= self.high


def parse(text: str) -> Block:
    address, slash, bits = text.partition("/")
    if not slash or not (bits.isascii() and bits.isdigit()):
        raise InvalidPattern(f"cidr: {text!r} has no prefix length")
    try:
        net = ipaddress.ip_network(f"{address}/{int(bits)}", strict=False)
    except ValueError as e:
        raise InvalidPattern(f"cidr: {e}") from None
    if net.version == 6 and ("." in address or "%" in address):
        raise InvalidPattern(f"cidr: {text!r}")
    return Block(net.version, int(net.network_address), int(net.broadcast_address))


def v4_number(v: Column) -> Column:
    part = F.split(v, r"\.")
    number = sum((part[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), part[0].cast("long") * 256**3)
    return F.when(v.rlike(V4), number)


def v6_digits(v: Column) -> Column:
    """32 hexadecimal digits in lower case, in the order of the addresses; null for anything else."""
    return F.when(v.rlike(V6), F.lower(F.array_join(F.transform(F.split(v, ":"), lambda g: F.lpad(g, 4, "0")), "")))


def within(v: Column, block: Block) -> Column:
    if block.version == 4:
        return F.coalesce(v4_number(v).between(block.low, block.high), F.lit(False))
    return F.coalesce(v6_digits(v).between(f"{block.low:032x}", f"{block.high:032x}"), F.lit(False))
