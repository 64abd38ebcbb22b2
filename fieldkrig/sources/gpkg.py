"""GeoPackage files: point layers and single-band coverage rasters, with the standard library's sqlite3.

A GeoPackage is one SQLite file, so it is read and written on the driver; the rows
become a DataFrame.  Rasters are 16-bit PNG tiles with a scale and an offset;
pixel 0 means no data.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidParameter
from .points import Grid

PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(path)


def decode_point(blob: bytes) -> tuple[float, float] | None:
    """(x, y) of a point geometry; None if it is empty or no point.  Either byte order, with or without an SRID or Z."""
    if len(blob) < 8 or blob[:2] != b"GP":
        return None
    flags = blob[3]
    if flags & 0x10:
        return None
    at = 8 + ENVELOPE.get((flags >> 1) & 7, -10**6)
    if at < 8 or len(blob) < at + 5:
        return None
    order = "<" if blob[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", blob, at + 1)
    at += 5
    if kind & 0x20000000:  # an SRID follows
        at += 4
    if (kind & 0x0FFFFFFF) % 1000 != 1 or len(blob) < at + 16:
        return None
    x, y = struct.unpack_from(order + "dd", blob, at)
    return None if x != x or y != y else (x, y)


def encode_point(x: float, y: float, srs_id: int) -> bytes:
    return b"GP" + bytes([0, 1]) + struct.pack("<i", srs_id) + struct.pack("<BIdd", 1, 1, x, y)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_layers(path: str, kind: str = "features") -> list[tuple[str, int]]:
    """(table, srs_id) of the layers of a kind: features or 2d-gridded-coverage."""
    with _open(path) as db:
        return db.execute("select table_name, srs_id from gpkg_contents where data_type = ? order by table_name", (kind,)).fetchall()


def read_points(spark: SparkSession, path: str, layer: str | None = None, value: str | None = None) -> tuple[DataFrame, int]:
    """(id, x, y[, value]; rows skipped for want of a point or a number).  Without a name, the only layer."""
    layers = [t for t, _ in list_layers(path)]
    if layer is None:
        if len(layers) != 1:
            raise InvalidParameter(f"name one of the layers: {', '.join(layers)}")
        layer = layers[0]
    if layer not in layers:
        raise InvalidParameter(f"no layer {layer!r}; there are: {', '.join(layers)}")
    with _open(path) as db:
        columns = [r[1] for r in db.execute(f"pragma table_info({_quoted(layer)})")]
        (geometry,) = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        if value is not None and value not in columns:
            raise InvalidParameter(f"no column {value!r}; there are: {', '.join(columns)}")
        rows, skipped = [], 0
        for i, (blob, v) in enumerate(db.execute(f"select {_quoted(geometry)}, {_quoted(value) if value else '0'} from {_quoted(layer)}")):
            p = decode_point(blob) if blob else None
            if p is None or not isinstance(v, (int, float)):
                skipped += 1
                continue
            rows.append((i, *p, float(v)) if value else (i, *p))
    return spark.createDataFrame(rows, "id long, x double, y double" + (", value double" if value else "")), skipped


def _create(db: sqlite3.Connection) -> None:
    db.execute("pragma application_id = 1196444487")
    db.execute("pragma user_version = 10300")
    db.executescript(
        """create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
        create table if not exists gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text not null default '2000-01-01T00:00:00Z', min_x double, min_y double, max_x double, max_y double, srs_id integer);
        create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);
        create table if not exists gpkg_tile_matrix_set (table_name text primary key, srs_id integer not null, min_x double, min_y double, max_x double, max_y double);
        create table if not exists gpkg_tile_matrix (table_name text not null, zoom_level integer not null, matrix_width integer, matrix_height integer, tile_width integer, tile_height integer, pixel_x_size double, pixel_y_size double, primary key (table_name, zoom_level));
        create table if not exists gpkg_2d_gridded_coverage_ancillary (id integer primary key, tile_matrix_set_name text unique, datatype text not null default 'integer', scale real not null default 1, offset real not null default 0, precision real default 1, data_null real, grid_cell_encoding text default 'grid-value-is-center');
        create table if not exists gpkg_2d_gridded_tile_ancillary (id integer primary key, tpudt_name text not null, tpudt_id integer not null, scale real not null default 1, offset real not null default 0, min real, max real, mean real, std_dev real);"""
    )
    for name, srs in (("undefined cartesian", -1), ("undefined geographic", 0)):
        db.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, 'NONE', ?, 'undefined', null)", (name, srs, srs))


def _srs(db: sqlite3.Connection, srs_id: int) -> None:
    db.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srs_id}", srs_id, srs_id))


def write_points(df: DataFrame, path: str, layer: str, srs_id: int = -1) -> int:
    """Writes x, y and every other numeric column as REAL; returns the number of rows.  Rows come to the driver one by one."""
    attributes = [c for c, t in df.dtypes if c not in ("x", "y") and t in ("double", "float", "int", "bigint")]
    with _open(path) as db:
        _create(db)
        _srs(db, srs_id)
        if db.execute("select 1 from gpkg_contents where table_name = ?", (layer,)).fetchone():
            raise InvalidParameter(f"layer {layer!r} exists")
        db.execute(f"create table {_quoted(layer)} (fid integer primary key, geom blob{''.join(f', {_quoted(a)} real' for a in attributes)})")
        low, high, n = [float("inf")] * 2, [float("-inf")] * 2, 0
        insert = f"insert into {_quoted(layer)} (geom{''.join(f', {_quoted(a)}' for a in attributes)}) values (?{', ?' * len(attributes)})"
        for r in df.select("x", "y", *attributes).toLocalIterator():
            low, high, n = [min(low[0], r["x"]), min(low[1], r["y"])], [max(high[0], r["x"]), max(high[1], r["y"])], n + 1
            db.execute(insert, (encode_point(r["x"], r["y"], srs_id), *(None if r[a] is None else float(r[a]) for a in attributes)))
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *(low if n else (None, None)), *(high if n else (None, None)), srs_id))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POINT', ?, 0, 0)", (layer, srs_id))
    return n


def encode_png(pixels: np.ndarray) -> bytes:
    """A 16-bit grey PNG."""
    h, w = pixels.shape
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    lines = np.zeros((h, 1 + 2 * w), np.uint8)
    lines[:, 1:] = pixels.astype(">u2").view(np.uint8).reshape(h, 2 * w)
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a 16-bit grey PNG without interlacing; all five line filters."""
    if data[:8] != PNG_HEAD:
        raise InvalidParameter("no PNG")
    at, packed, w, h = 8, b"", 0, 0
    while at + 8 <= len(data):
        (size,), tag = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlace) != (16, 0, 0):
                raise InvalidParameter("only 16-bit grey PNGs without interlacing are read")
        elif tag == b"IDAT":
            packed += body
        at += 12 + size
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error as e:
        raise InvalidParameter(f"damaged PNG: {e}") from None
    if not w or not h or len(raw) != h * (1 + 2 * w):
        raise InvalidParameter("damaged PNG")
    lines, out = raw.reshape(h, 1 + 2 * w), np.zeros((h, 2 * w), np.int64)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        above = out[y - 1] if y else np.zeros(2 * w, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        elif kind in (1, 3, 4):
            for i in range(2 * w):
                a, b, c = (out[y, i - 2] if i > 1 else 0), above[i], (above[i - 2] if i > 1 else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                out[y, i] = (line[i] + guess) & 255
        else:
            raise InvalidParameter("damaged PNG")
    return out.astype(np.uint8).view(">u2").astype(np.uint16)


def write_raster(values: DataFrame, grid: Grid, path: str, layer: str, value: str = "value", srs_id: int = -1) -> None:
    """One tile with the whole grid: values scaled to pixels 1 to 65535; null and NaN are pixel 0.  Rows: ix, iy, value."""
    nx, ny = grid.n
    z = np.full((ny, nx), np.nan)
    for r in values.select("ix", "iy", value).toLocalIterator():
        if r[value] is not None:
            z[r["iy"], r["ix"]] = r[value]
    seen = z[np.isfinite(z)]
    low, high = (float(seen.min()), float(seen.max())) if len(seen) else (0.0, 1.0)
    scale = (high - low) / 65534 or 1.0
    offset = low - scale
    pixels = np.where(np.isfinite(z), np.clip(np.rint((z - offset) / scale), 1, 65535), 0).astype(np.uint16)
    box = (grid.origin[0], grid.origin[1], grid.origin[0] + nx * grid.size[0], grid.origin[1] + ny * grid.size[1])
    with _open(path) as db:
        _create(db)
        _srs(db, srs_id)
        if db.execute("select 1 from gpkg_contents where table_name = ?", (layer,)).fetchone():
            raise InvalidParameter(f"layer {layer!r} exists")
        db.execute(f"create table {_quoted(layer)} (id integer primary key, zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, '2d-gridded-coverage', ?, ?, ?, ?, ?, ?)", (layer, layer, *box, srs_id))
        db.execute("insert into gpkg_tile_matrix_set values (?, ?, ?, ?, ?, ?)", (layer, srs_id, *box))
        db.execute("insert into gpkg_tile_matrix values (?, 0, 1, 1, ?, ?, ?, ?)", (layer, nx, ny, *grid.size))
        db.execute("insert into gpkg_2d_gridded_coverage_ancillary (tile_matrix_set_name, scale, offset, data_null) values (?, ?, ?, 0)", (layer, scale, offset))
        tile = db.execute(f"insert into {_quoted(layer)} (zoom_level, tile_column, tile_row, tile_data) values (0, 0, 0, ?)", (encode_png(pixels[::-1]),)).lastrowid
        db.execute("insert into gpkg_2d_gridded_tile_ancillary (tpudt_name, tpudt_id) values (?, ?)", (layer, tile))


def read_raster(spark: SparkSession, path: str, layer: str) -> tuple[DataFrame, Grid]:
    """(ix, iy, x, y, value; grid) of the finest zoom level, tiles joined; no data is null."""
    with _open(path) as db:
        found = db.execute("select datatype, scale, offset, data_null from gpkg_2d_gridded_coverage_ancillary where tile_matrix_set_name = ?", (layer,)).fetchone()
        if found is None:
            raise InvalidParameter(f"no raster {layer!r}")
        kind, scale, offset, null = found
        if kind != "integer":
            raise InvalidParameter("only integer tiles are read")
        zoom, mw, mh, tw, th, px, py = db.execute("select zoom_level, matrix_width, matrix_height, tile_width, tile_height, pixel_x_size, pixel_y_size from gpkg_tile_matrix where table_name = ? order by zoom_level desc limit 1", (layer,)).fetchone()
        min_x, max_y = db.execute("select min_x, max_y from gpkg_tile_matrix_set where table_name = ?", (layer,)).fetchone()
        pixels = np.zeros((mh * th, mw * tw), np.int64)
        factor, shift = np.ones(pixels.shape), np.zeros(pixels.shape)
        tiles = db.execute(f"select t.tile_column, t.tile_row, t.tile_data, a.scale, a.offset from {_quoted(layer)} t left join gpkg_2d_gridded_tile_ancillary a on a.tpudt_id = t.id and a.tpudt_name = ? where t.zoom_level = ?", (layer, zoom))
        for column, row, data, s, o in tiles:
            at = slice(row * th, (row + 1) * th), slice(column * tw, (column + 1) * tw)
            pixels[at] = decode_png(data)
            factor[at], shift[at] = s if s is not None else 1.0, o if o is not None else 0.0
    pixels, factor, shift = pixels[::-1], factor[::-1], shift[::-1]  # rows from the lower edge
    value = np.where(pixels == (0 if null is None else null), np.nan, (pixels * factor + shift) * scale + offset)
    grid = Grid((min_x, max_y - mh * th * py), (px, py), (mw * tw, mh * th))
    rows = [(ix, iy, None if np.isnan(v) else float(v)) for iy, line in enumerate(value) for ix, v in enumerate(line)]
    cells = spark.createDataFrame(rows, "ix int, iy int, value double")
    return grid.frame(spark).select("ix", "iy", "x", "y").join(cells, ["ix", "iy"]), grid
