"""Control messages and pictures as bytes: encoders and parsers for Arrow batches."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(text: str) -> bytes:
    """A string with a zero after it, filled to four bytes."""
    raw = text.encode() + b"\0"
    return raw + b"\0" * (-len(raw) % 4)


def bundle(messages: list[tuple[str, int]]) -> bytes:
    """Messages of one integer each in a bundle to be taken at once (time tag 1)."""
    out = padded("#bundle") + struct.pack(">Q", 1)
    for address, value in messages:
        body = padded(address) + padded(",i") + struct.pack(">i", value)
        out += struct.pack(">i", len(body)) + body
    return out


def parse(data: bytes) -> list[tuple[str, int]]:
    """The messages of a bundle; what is cut short or no bundle gives those read so far."""
    out, at = [], 16
    if data[:8] != padded("#bundle"):
        return out
    while at + 4 <= len(data):
        size = struct.unpack_from(">i", data, at)[0]
        body, at = data[at + 4:at + 4 + size], at + 4 + size
        end = body.find(b"\0")
        if end < 0 or len(body) < size or size < 12:
            break
        out.append((body[:end].decode(errors="replace"), struct.unpack_from(">i", body, size - 4)[0]))
    return out


def bundles(df: DataFrame, key: str, values: str, prefix: str = "/remote/parameters/p") -> DataFrame:
    """key and the bundle of its values, one message each."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "data": [bundle([(f"{prefix}{k}", int(v)) for k, v in enumerate(vs)]) for vs in pdf[values]]})

    return df.select(key, values).mapInPandas(run, f"{key} long, data binary")


def addressed(df: DataFrame, keep: list[str], address: Column, value: str) -> DataFrame:
    """keep and data: a bundle of one message for each row, to an address of its own."""
    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out["data"] = [bundle([(a, int(v))]) for a, v in zip(pdf["_address"], pdf["_value"])]
            yield out

    rows = df.select(*keep, address.alias("_address"), F.col(value).alias("_value"))
    return rows.mapInPandas(run, ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep], "data binary"]))


def messages(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """key, address, value of every message."""
    def run(batches):
        for pdf in batches:
            rows = [(k, a, v) for k, d in zip(pdf[key], pdf[data]) for a, v in parse(bytes(d))]
            yield pd.DataFrame(rows, columns=[key, "address", "value"])

    return df.select(key, data).mapInPandas(run, f"{key} long, address string, value int")


def datagram_count(sizes: Column, most: int) -> Column:
    """Datagrams that groups of these sizes fill in order; a group is not split and may exceed most alone."""
    start = F.struct(F.lit(0).cast("double").alias("used"), F.lit(0).alias("n"))

    def step(s, size):
        size = size.cast("double")
        new = (s["n"] == 0) | (s["used"] + size > most)
        return F.struct(F.when(new, size).otherwise(s["used"] + size).alias("used"), F.when(new, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(sizes, start, step)["n"]


def png(rows: list[list[int]]) -> bytes:
    """A grey picture of 8 bits in PNG format, rows not filtered."""
    h, w = len(rows), len(rows[0])

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> list[list[int]] | None:
    """Rows of a grey picture of 8 bits with any row filter; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, w, h = 8, b"", 0, 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8:at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, lace) != (8, 0, 0):
                return None
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    raw, out, above = zlib.decompress(body), [], [0] * w
    for y in range(h):
        kind, line, row = raw[y * (w + 1)], raw[y * (w + 1) + 1:(y + 1) * (w + 1)], []
        for x, v in enumerate(line):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((v + (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out.append(row)
        above = row
    return out


def png_round_trip(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """key, samples: pictures of width samples a row written as PNG and read again."""
    def run(batches):
        for pdf in batches:
            back = [png_samples(png([[int(v) for v in vs[k:k + width]] for k in range(0, len(vs), width)])) for vs in pdf[values]]
            yield pd.DataFrame({key: pdf[key], "samples": [[v for r in rows for v in r] for rows in back]})

    return df.select(key, values).mapInPandas(run, f"{key} long, samples array<int>")
