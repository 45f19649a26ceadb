"""Column expressions for addresses, ports and TCP flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag bits and their names, in bit order.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
# Rule letters of the same flags.
FLAG_LETTERS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}


def flag_text(bits: Column) -> Column:
    """Flag bitmask to text; SYN-ACK and FIN-ACK have names of their own."""
    names = F.array(
        *[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for n, b in FLAG_BITS.items()]
    )
    joined = F.array_join(F.array_compact(names), "-")
    return (
        F.when(bits == 0x12, "SYN-ACK")
        .when(bits == 0x11, "FIN-ACK")
        .when(joined == "", bits.cast("string"))
        .otherwise(joined)
    )


def flag_booleans(text: Column) -> dict[str, Column]:
    """Six booleans by substring of the flag text, FALSE for NULL."""
    return {
        f"flag_{n.lower()}": F.coalesce(F.upper(text).contains(n), F.lit(False)) for n in FLAG_BITS
    }


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text to a number; NULL for anything else."""
    p = F.split(ip, r"\.")
    num = sum(
        (F.try_element_at(p, F.lit(i + 1)).try_cast("long") * (256 ** (3 - i)) for i in range(1, 4)),
        F.try_element_at(p, F.lit(1)).try_cast("long") * 256**3,
    )
    return F.when(F.size(p) == 4, num)


def cidr_bounds(net: Column) -> tuple[Column, Column]:
    """First and last address number of ``a.b.c.d`` or ``a.b.c.d/n``."""
    parts = F.split(net, "/")
    bits = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    base = ip_number(F.element_at(parts, 1))
    low = base - F.pmod(base, size)
    return low, low + size - 1


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), F.coalesce(port.cast("string"), F.lit("None")))
