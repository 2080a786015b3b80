"""A binary form of values: a tag byte and a big-endian payload, nested. Bulk data belong in Parquet; this form serves
exchange of single values in binary columns (READ-DTYPE, WRITE-DTYPE and their packet forms)."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

#: Tags of the exchange format.
NULL, VOID, TRUE, FALSE, INT, FLOAT, STRING, SYMBOL, PAIR, PACKET, VECTOR, OID = 0x01, 0x02, 0x0A, 0x0B, 0x03, 0x04, 0x06, 0x07, 0x08, 0x05, 0x09, 0x0C


class Symbol(str):
    """A name, upper-cased."""


def encode(x) -> bytes:
    if x is None or (isinstance(x, (list, tuple)) and not x):
        return bytes([NULL])
    if x is True or x is False:
        return bytes([TRUE if x else FALSE])
    if isinstance(x, int):
        if -(2**31) <= x < 2**31:
            return struct.pack(">Bi", INT, x)
        return struct.pack(">Bq", OID, x)
    if isinstance(x, float):
        return struct.pack(">Bd", FLOAT, x)
    if isinstance(x, (bytes, bytearray)):
        return struct.pack(">BI", PACKET, len(x)) + bytes(x)
    if isinstance(x, str):
        data = x.encode()
        return struct.pack(">BI", SYMBOL if isinstance(x, Symbol) else STRING, len(data)) + data
    if isinstance(x, (list, tuple)):
        return struct.pack(">BI", VECTOR, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return encode([[k, v] for k, v in sorted(x.items())])
    raise TypeError(f"no binary form for {type(x).__name__}")


def decode(data: bytes):
    value, end = _decode(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _decode(data: bytes, at: int):
    tag = data[at]
    at += 1
    if tag in (NULL, VOID):
        return None, at
    if tag in (TRUE, FALSE):
        return tag == TRUE, at
    if tag == INT:
        return struct.unpack_from(">i", data, at)[0], at + 4
    if tag in (OID, FLOAT):
        return struct.unpack_from(">q" if tag == OID else ">d", data, at)[0], at + 8
    if tag in (PACKET, STRING, SYMBOL):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            raise ValueError("cut off")
        raw = data[at + 4 : at + 4 + n]
        return (bytes(raw) if tag == PACKET else Symbol(raw.decode()) if tag == SYMBOL else raw.decode()), at + 4 + n
    if tag == VECTOR:
        n = struct.unpack_from(">I", data, at)[0]
        at += 4
        out = []
        for _ in range(n):
            v, at = _decode(data, at)
            out.append(v)
        return out, at
    raise ValueError(f"unknown tag {tag:#x}")


@F.pandas_udf(BinaryType())
def write_packet(s: pd.Series) -> pd.Series:
    """WRITE-DTYPE-TO-PACKET of values given as JSON text."""
    return s.map(lambda x: None if x is None else encode(json.loads(x)))


@F.pandas_udf(StringType())
def read_packet(b: pd.Series) -> pd.Series:
    """READ-DTYPE-FROM-PACKET, as JSON text."""
    return b.map(lambda x: None if x is None else json.dumps(decode(bytes(x)), ensure_ascii=False))


@F.pandas_udf(LongType())
def dtype_size(s: pd.Series) -> pd.Series:
    """DTYPE-SIZE of values given as JSON text."""
    return s.map(lambda x: None if x is None else len(encode(json.loads(x))))


def write_file(path: str, *values) -> None:
    """WRITE-DTYPE-TO-FILE, ADD-DTYPE-TO-FILE, WRITE-DTYPE: values one after the other, behind those already there."""
    with open(path, "ab") as f:
        for v in values:
            data = encode(v)
            f.write(struct.pack(">I", len(data)) + data)


def read_file(path: str) -> list:
    """READ-DTYPE-FROM-FILE, READ-DTYPE: all values of a file."""
    with open(path, "rb") as f:
        data = f.read()
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        out.append(decode(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def write_to_string(x) -> str:
    """WRITE-TO-STRING: a value as JSON text."""
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def read_from_string(s: str):
    """READ-FROM-STRING, PARSE-ARG: JSON text as a value; what is no JSON is a string."""
    try:
        return json.loads(s)
    except ValueError:
        return s


def read_from_file(path: str):
    """READ-FROM-FILE."""
    with open(path, encoding="utf-8") as f:
        return read_from_string(f.read())
