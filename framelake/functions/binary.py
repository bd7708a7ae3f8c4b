"""Column expressions over raw big-endian bytes (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: record layout of a scan-line file -----------------------------------
RECORD_BYTES = 6448
HEADER_BYTES = 16
PARAM_BYTES = 32
PACKED_BYTES = 5120
PIXELS_PER_LINE = 4096
MAGIC_HEX = "FAF3340A01"
GROUP_LINES = 16
NANOS_PER_EXPOSURE_TICK = 12.5
# -----------------------------------------------------------------------------------------


def be_uint(raw: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at a zero-based byte offset."""
    return F.conv(F.hex(F.substring(raw, offset + 1, width)), 16, 10).cast("bigint")


def be_float(raw: Column, offset: int = 0) -> Column:
    """IEEE-754 single precision value stored big-endian at ``offset``."""
    return float_from_bits(be_uint(raw, offset, 4))


def float_from_bits(bits: Column) -> Column:
    """Reinterpret the low 32 bits of a BIGINT as an IEEE-754 single precision value."""
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF))
    mantissa = bits.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    fraction = mantissa / F.lit(float(1 << 23))
    normal = F.pow(F.lit(2.0), (exponent - 127).cast("double")) * (1.0 + fraction)
    subnormal = F.pow(F.lit(2.0), F.lit(-126.0)) * fraction
    infinite = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    magnitude = F.when(exponent == 255, infinite).when(exponent == 0, subnormal).otherwise(normal)
    return (sign * magnitude).cast("float")


def exposure_ns(ticks: Column) -> Column:
    """Exposure counter (u24) to whole nanoseconds, truncated."""
    return F.floor(ticks.cast("double") * NANOS_PER_EXPOSURE_TICK).cast("bigint")


def pts_ns(frame_id: Column, fps: float) -> Column:
    """Presentation time of a frame: index times the truncated frame duration."""
    return frame_id.cast("bigint") * F.lit(int(1_000_000_000 / fps)).cast("bigint")


def line_header(raw: Column) -> Column:
    """Header fields of one scan-line record."""
    return F.struct(
        (F.substring(raw, 1, 5) == F.unhex(F.lit(MAGIC_HEX))).alias("valid"),
        be_uint(raw, 9, 1).bitwiseAND(F.lit(0x0F)).cast("int").alias("nibble"),
        be_uint(raw, 5, 1).cast("smallint").alias("channel_id"),
        be_uint(raw, 6, 1).cast("smallint").alias("strip_number"),
        be_uint(raw, 7, 3).alias("row_number"),
        be_uint(raw, 10, 3).alias("camera_microseconds"),
    )


def unpack_quad(b0: Column, b1: Column, b2: Column, b3: Column, b4: Column) -> list[Column]:
    """Top eight bits of the four 10-bit pixels packed in five bytes."""
    return [
        b0,
        F.shiftleft(b1.bitwiseAND(F.lit(63)), 2).bitwiseOR(F.shiftright(b2, 6)),
        F.shiftleft(b2.bitwiseAND(F.lit(15)), 4).bitwiseOR(F.shiftright(b3, 4)),
        F.shiftleft(b3.bitwiseAND(F.lit(3)), 6).bitwiseOR(F.shiftright(b4, 2)),
    ]
