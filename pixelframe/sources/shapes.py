"""Point shapefiles through Spark's binary reader: one row for each record.

Numeric and float fields become doubles, all others strings.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def parse_points(data: bytes) -> list[tuple[float, float]]:
    """Coordinates of a point .shp file."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">I", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind not in (1, 11, 21):
            raise ValueError("not a point shapefile")
        out.append(struct.unpack_from("<2d", data, at + 12))
        at += 8 + size
    return out


def parse_table(data: bytes) -> tuple[list[tuple[str, str, int]], list[list]]:
    """((name, type, width) of the fields, records) of a .dbf file; deleted records are skipped."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name, kind, width = data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16]
        fields.append((name, kind, width))
        at += 32
    rows = []
    for i in range(n):
        record = data[head + i * size : head + (i + 1) * size]
        if record[:1] == b"*":
            continue
        row, at = [], 1
        for _, kind, width in fields:
            text = record[at : at + width].decode("latin-1").strip()
            row.append((float(text) if text else None) if kind in "NF" else text)
            at += width
        rows.append(row)
    return fields, rows


def read_points(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """lon, lat and the fields of ``path`` (without extension); a missing target names the candidates."""
    files = {}
    for ext in ("shp", "dbf"):
        files[ext] = bytes(spark.read.format("binaryFile").load(f"{path}.{ext}").select("content").first()[0])
    fields, rows = parse_table(files["dbf"])
    names = [name for name, _, _ in fields]
    if target is not None and target not in names:
        raise ValueError(f"no field {target!r}, there are {names}")
    n, head, size = struct.unpack_from("<IHH", files["dbf"], 4)
    points = [p for i, p in enumerate(parse_points(files["shp"])) if i >= n or files["dbf"][head + i * size] != 0x2A]  # not of deleted records
    pdf = pd.DataFrame([[*p, *r] for p, r in zip(points, rows, strict=True)], columns=["lon", "lat", *names])
    kinds = ", ".join(f"`{name}` {'double' if kind in 'NF' else 'string'}" for name, kind, _ in fields)
    return spark.createDataFrame(pdf, f"lon double, lat double, {kinds}")


def write_points(lon_lat: list[tuple[float, float]], fields: list[tuple[str, str, int]], rows: list[list]) -> tuple[bytes, bytes]:
    """(.shp, .dbf) contents of a few points."""
    xs, ys = zip(*lon_lat, strict=True) if lon_lat else ((0.0,), (0.0,))
    head = struct.pack(">I5II", 9994, 0, 0, 0, 0, 0, 50 + 14 * len(lon_lat)) + struct.pack("<Ii4d4d", 1000, 1, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    shp = head + b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<i2d", 1, *p) for i, p in enumerate(lon_lat))
    size = 1 + sum(w for _, _, w in fields)
    dbf = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), size)
    dbf += b"".join(name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([w, 6 if kind == "F" else 0]) + bytes(14) for name, kind, w in fields) + b"\r"
    for row in rows:
        dbf += b" " + b"".join(("" if v is None else str(v)).encode("latin-1").rjust(w)[:w] for v, (_, _, w) in zip(row, fields, strict=True))
    return shp, dbf + b"\x1a"
