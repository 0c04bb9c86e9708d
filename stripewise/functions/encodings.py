"""Lightweight encodings as Column expressions: everything here stays inside generated code.

The byte encoders proper, which depend on the order of values, are in `stripewise.operators.runs`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from the UNIX epoch to 2015-01-01 UTC.
EPOCH_2015 = 1_420_070_400
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def zigzag(x: Column) -> Column:
    """Signed to unsigned so that small magnitudes become small numbers: 0, -1, 1, -2, 2 become 0, 1, 2, 3, 4."""
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    x = x.cast("long")
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1).cast("long")))


def varint_length(x: Column) -> Column:
    """Bytes of the unsigned base-128 form of the 64 bits of x."""
    return F.ceil(F.length(F.bin(x.cast("long"))) / 7).cast("int")


def signed_varint_length(x: Column) -> Column:
    return varint_length(zigzag(x))


def varint(x: Column) -> Column:
    """The unsigned base-128 form of the 64 bits of x, least significant group first, as bytes."""
    last = varint_length(x) - 1

    def byte(k: Column) -> Column:
        group = F.call_function("shiftrightunsigned", x.cast("long"), k * 7).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(F.when(k < last, group.bitwiseOR(F.lit(128).cast("long"))).otherwise(group)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), byte), ""))


def signed_varint(x: Column) -> Column:
    return varint(zigzag(x))


def wrapping_delta(x: Column, before: Column) -> Column:
    """x - before; null where the difference leaves 64 bits."""
    return F.try_subtract(x.cast("long"), before.cast("long"))


def pack_bits(bits: Column, place: Column) -> Column:
    """An aggregate: up to eight booleans as one byte, first the most significant. place: 0 to 7."""
    return F.sum(F.when(F.coalesce(bits, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(7) - place.cast("int"))).otherwise(F.lit(0).cast("long")))


def nanos(ts: Column) -> Column:
    """Nanoseconds within the second; sources of microseconds have multiples of 1000."""
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) * 1000


def pack_nanos(n: Column) -> Column:
    """Nanoseconds with their trailing decimal zeros counted in the low three bits, where there are two or more."""
    n = n.cast("long")
    zeros = F.length(F.regexp_extract(n.cast("string"), "(0*)$", 1))
    stripped = F.shiftleft((n / F.pow(F.lit(10.0), zeros)).cast("long"), 3).bitwiseOR((zeros - 1).cast("long"))
    return F.when((n != 0) & (n % 100 == 0), stripped).otherwise(F.shiftleft(n, 3))


def unpack_nanos(packed: Column) -> Column:
    packed = packed.cast("long")
    code = packed.bitwiseAND(F.lit(7).cast("long"))
    return (F.shiftright(packed, 3) * F.when(code == 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), code + 1)).cast("long")).cast("long")


def seconds_since_2015(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp")) - EPOCH_2015


def epoch_millis(ts: Column) -> Column:
    """UNIX milliseconds, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def epoch_day(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date"))


def decimal_text(x: Column) -> Column:
    """A decimal without its fraction if that is zero, else with all digits of its scale."""
    return F.when(x % 1 == 0, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def decimal_unscaled(x: Column, scale: int, precision: int = 38) -> Column:
    """The digits of a decimal of this scale as an integer, of all 38 digits if need be.

    A product that fits 38 digits is computed as such; wider decimals lose digits in products, so theirs are taken from the text.
    """
    if precision + scale + 2 <= 38:
        return (x * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)")
    return F.translate(F.format_number(x, scale), ",.", "").cast("decimal(38,0)")


def decimal_scale(x: Column, scale: int) -> Column:
    """What the stream of scales holds: the scale for every value that is there."""
    return F.when(x.isNotNull(), F.lit(scale))


def _little_endian(bits: Column, digits: int) -> Column:
    def turned(x: Column) -> Column:
        told = F.lpad(F.hex(x), digits, "0")
        return F.unhex(F.concat(*(F.substring(told, k, 2) for k in range(digits - 1, 0, -2))))

    # the bits are asked for once, and then turned
    return F.element_at(F.transform(F.array(bits), turned), 1)


def double_bytes(x: Column) -> Column:
    """The eight bytes of a double, the lowest first; NaN has one form."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(x.isNotNull(), _little_endian(bits.cast("long"), 16))


def float_bytes(x: Column) -> Column:
    """The four bytes of a float, the lowest first; NaN has one form."""
    bits = F.call_function("java_method", F.lit("java.lang.Float"), F.lit("floatToIntBits"), F.coalesce(x.cast("float"), F.lit(0.0).cast("float")))
    return F.when(x.isNotNull(), _little_endian(bits.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8))


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def present(x: Column) -> Column:
    return x.isNotNull()


def container_length(x: Column) -> Column:
    """Elements of a list or entries of a map; null for null."""
    return F.when(x.isNotNull(), F.size(x))


def fits_long(x: Column) -> Column:
    """A decimal sum as a long; null if it leaves 64 bits, whatever the order it was added up in."""
    return F.when(x.between(F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")), x.cast("long"))
