"""Order-preserving key encodings as column expressions to binary, and their inverses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = -(1 << 63)


def u64(c: Column) -> Column:
    """A non-negative long as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def i64(c: Column) -> Column:
    """A signed long: big-endian with the sign bit turned over."""
    return u64(c.cast("long").bitwiseXOR(F.lit(_SIGN)))


def _long(b: Column) -> Column:
    # conv() yields an unsigned decimal; its upper half lies beyond a signed long
    d = F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")
    return F.when(d >= F.lit(str(1 << 63)).cast("decimal(20,0)"), d - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("long")


def u64_decode(b: Column) -> Column:
    return _long(b)


def i64_decode(b: Column) -> Column:
    return _long(b).bitwiseXOR(F.lit(_SIGN))


def descending(b: Column) -> Column:
    """Every byte turned over: the order of equally long keys is reversed."""
    return F.unhex(F.translate(F.hex(b), "0123456789ABCDEF", "FEDCBA9876543210"))


def text(c: Column) -> Column:
    return F.encode(c, "utf-8")


def text_decode(b: Column) -> Column:
    return F.decode(b, "utf-8")


def escaped(b: Column) -> Column:
    """Binary-safe component of a composite key: 00 becomes 00FF, and the component ends with 0000. Keeps the order."""
    spaced = F.regexp_replace(F.hex(b), "(..)", "$1.")
    return F.unhex(F.concat(F.translate(F.regexp_replace(spaced, "00\\.", "00.FF."), ".", ""), F.lit("0000")))


def delimited(*parts: Column, delimiter: bytes = b"\x00") -> Column:
    """Components joined by a byte that none of them holds."""
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(delimiter), p]
    return F.concat(*out)


def length_prefixed(b: Column) -> Column:
    """A component after its length in four big-endian bytes (groups equal lengths; not in byte order across lengths)."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b)


def fixed(b: Column, width: int, pad: bytes = b"\x00") -> Column:
    """A component of exactly this width; a longer one is an error."""
    return F.when(F.octet_length(b) > width, F.raise_error(F.lit(f"a component is longer than {width} bytes")).cast("binary")).otherwise(F.rpad(b, width, F.lit(pad)))


def composite(*parts: Column) -> Column:
    return F.concat(*parts)


def timestamp(c: Column) -> Column:
    """Milliseconds since the epoch, big-endian, sign bit turned over."""
    return i64(F.unix_millis(c.cast("timestamp")))


def uuid(c: Column) -> Column:
    return F.unhex(F.translate(c, "-", ""))


def cell(c: Column, low: float, high: float, bits: int = 31) -> Column:
    """The place of a coordinate among 2 ** bits equal steps from low to high; beyond the ends, the first or last step; null stays null."""
    steps = 1 << bits
    at = F.floor((c.cast("double") - low) / (high - low) * steps)
    return F.when(c.isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(steps - 1)).cast("long"))


def _shift(name: str, n: Column, by: Column) -> Column:
    return F.call_function(name, n, by.cast("int"))


def morton(*parts: Column, bits: int = 31) -> Column:
    """Z-order key of whole numbers of `bits` bits each: their bits in turn, the last part's lowest. Null if a part is null."""
    n = len(parts)
    if n * bits > 63:
        raise ValueError("a key has at most 63 bits")
    one = F.lit(1).cast("long")

    def spread(part: Column, place: int) -> Column:
        bit = lambda i: _shift("shiftleft", _shift("shiftright", part.cast("long"), i).bitwiseAND(one), i * n + place)
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda done, i: done.bitwiseOR(bit(i)))

    code = spread(parts[-1], 0)
    for place, part in enumerate(reversed(parts[:-1]), 1):
        code = code.bitwiseOR(spread(part, place))
    return u64(code)


def morton_decode(b: Column, part: int, parts: int, bits: int = 31) -> Column:
    """One of the numbers that morton() put together, counted from 0."""
    code, one, place = u64_decode(b), F.lit(1).cast("long"), parts - 1 - part
    bit = lambda i: _shift("shiftleft", _shift("shiftright", code, i * parts + place).bitwiseAND(one), i)
    return F.when(b.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda done, i: done.bitwiseOR(bit(i))))


_TOP = np.uint64(1 << 63)


@F.arrow_udf(T.BinaryType())
def _f64(values: pa.Array) -> pa.Array:
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    n = np.where(np.isnan(x), np.uint64(0x7FF8 << 48), x.view(np.uint64))
    raw = np.where(n & _TOP, ~n, n | _TOP).astype(">u8")
    offsets = pa.py_buffer(8 * np.arange(len(x) + 1, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(raw.tobytes())])


@F.arrow_udf(T.DoubleType())
def _f64_decode(values: pa.Array) -> pa.Array:
    n = np.frombuffer(b"".join(b"\xff" * 8 if b is None else b for b in values.to_pylist()), ">u8").astype(np.uint64)
    return pa.array(np.where(n & _TOP, n & ~_TOP, ~n).view(np.float64), pa.float64())


def f64(c: Column | str) -> Column:
    """A double: positive values get the sign bit turned over, negative ones all bits; every NaN sorts after infinity. Null stays null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), _f64(x))


def f64_decode(b: Column | str) -> Column:
    x = F.col(b) if isinstance(b, str) else b
    return F.when(x.isNotNull(), _f64_decode(x))


def render(b: Column, mode: str = "auto") -> Column:
    """A key or value for display: hex, utf8, len, none, or auto (text where it is printable, else hex)."""
    as_hex, as_text = F.concat(F.lit("0x"), F.lower(F.hex(b))), F.decode(b, "utf-8")
    printable = F.is_valid_utf8(b.cast("string")) & ~b.cast("string").rlike(r"[\x00-\x1f\x7f]")
    options = {"hex": as_hex, "utf8": as_text, "len": F.octet_length(b).cast("string"), "none": F.lit(None).cast("string")}
    return F.when(printable, b.cast("string")).otherwise(as_hex) if mode == "auto" else options[mode]


def parse(s: str) -> bytes:
    """A key given as text, or as hex after 0x."""
    return bytes.fromhex(s[2:]) if s.startswith("0x") else s.encode()
