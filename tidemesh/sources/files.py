"""Point clouds, correspondences and scan positions from files, and clouds and voxels to files."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AXES = ("x", "y", "z")


def read_xyz(spark: SparkSession, *paths: str, delimiter: str | None = None, skip_header: int = 0, comment: str = "#", xyz_columns: Sequence[int] = (0, 1, 2), normal_columns: Sequence[int] = (), additional: Mapping[str, int] | None = None, types: Mapping[str, str] | None = None):
    """Text clouds as DataFrames of x, y, z, optional nx, ny, nz and named extra columns by index; several paths give a tuple.

    Columns are parted by `delimiter`, or by white space. Lines with another number of fields than the first, or fields
    that are no numbers, raise when read; empty lines and what follows `comment` are left out. types gives SQL types of
    extra columns (default double).
    """
    if len(paths) > 1:
        return tuple(read_xyz(spark, p, delimiter=delimiter, skip_header=skip_header, comment=comment, xyz_columns=xyz_columns, normal_columns=normal_columns, additional=additional, types=types) for p in paths)
    lines = spark.read.text(paths[0]).select("value", F.col("_metadata.file_block_start").alias("at"))
    if skip_header:
        head = [r[0] for r in spark.read.text(paths[0]).limit(skip_header).collect()]
        lines = lines.filter(~((F.col("at") == 0) & F.col("value").isin(head)))
    text = F.trim(F.regexp_replace("value", f"\\Q{comment}\\E.*$", "")) if comment else F.trim("value")
    lines = lines.select(text.alias("value")).filter("value <> ''")
    parts = F.split("value", "\\s+" if delimiter is None else f"\\s*\\Q{delimiter}\\E\\s*")
    first = lines.select(F.size(parts)).first()
    width = first[0] if first else 3
    wanted = dict(zip(AXES, xyz_columns)) | dict(zip(("nx", "ny", "nz"), normal_columns)) | dict(additional or {})
    if max(wanted.values()) >= width:
        raise ValueError(f"the file has {width} columns; is the delimiter right?")
    whole = F.when(F.size(parts) == width, parts).otherwise(F.raise_error(F.concat(F.lit("a line has another number of fields: "), "value")))
    rows = lines.select(whole.alias("p"))
    return rows.select(*[F.col("p")[i].cast((types or {}).get(n, "double")).alias(n) for n, i in wanted.items()])


def as_cloud(spark: SparkSession, cloud) -> DataFrame:
    """A DataFrame as it is; an n x 3 array as points with ids 0..n-1."""
    if isinstance(cloud, DataFrame):
        return cloud
    a = np.asarray(cloud, float)
    if a.ndim != 2 or a.shape[1] != 3:
        raise ValueError("a cloud is an n x 3 array")
    return spark.createDataFrame(pa.table({"point_id": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}))


def regular_corepoints(spark: SparkSession, low: Sequence[float], high: Sequence[float], count: Sequence[int], z: float = 0.0) -> DataFrame:
    """A grid of count[0] x count[1] corepoints from low to high, x-major."""
    nx, ny = count
    i, j = F.expr(f"id div {ny}"), F.col("id") % ny
    step = [(high[k] - low[k]) / max(n - 1, 1) for k, n in enumerate((nx, ny))]
    return spark.range(nx * ny).select(F.col("id").alias("corepoint_id"), (low[0] + i * step[0]).alias("x"), (low[1] + j * step[1]).alias("y"), F.lit(float(z)).alias("z"))


def read_correspondences(spark: SparkSession, path: str) -> DataFrame:
    """(id0, id1[, label]) from a CSV without header; fewer than two columns is an error."""
    first = spark.read.text(path).first()
    n = len(first[0].split(",")) if first else 0
    if n < 2:
        raise ValueError("correspondences need at least two columns")
    names = ["id0", "id1", "label"][: min(n, 3)] + [f"c{k}" for k in range(3, n)]
    rows = spark.read.csv(path, schema=", ".join(f"{c} double" for c in names), mode="FAILFAST")
    return rows.select(*[F.col(c).cast("long").alias(c) for c in names[:3]])


def scan_positions(spark: SparkSession, info: Mapping | str) -> DataFrame:
    """(scanpos_id, ox, oy, oz, sigma_range, sigma_scan, sigma_yaw) from {"1": {origin, sigma_*}, ...} or a JSON file of it; ids count from 1."""
    if isinstance(info, str):
        info = json.loads(Path(info).read_text())
    rows = []
    for k in range(1, len(info) + 1):
        if str(k) not in info:
            raise ValueError('scan positions are numbered "1", "2", ...')
        s = info[str(k)]
        numbers = [*s["origin"], s["sigma_range"], s["sigma_scan"], s["sigma_yaw"]]
        if len(s["origin"]) != 3 or not all(isinstance(v, float) for v in numbers):
            raise ValueError("origins are three floats and sigmas are floats")
        rows.append((k, *numbers))
    return spark.createDataFrame(rows, "scanpos_id int, ox double, oy double, oz double, sigma_range double, sigma_scan double, sigma_yaw double")


#: Text forms of a timestamp that are understood, in the order tried. Fixed values.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MMMM d, yyyy, h:mma", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd_HHmmss", "yyyyMMdd")
_PYTHON = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%B %d, %Y, %I:%M%p", "%B %d, %Y", "%d %B %Y", "%b %d, %Y", "%Y%m%d_%H%M%S", "%Y%m%d")


def timestamp(value) -> datetime | None:
    """A datetime from a datetime, a date, (year, day of year), a text or None; anything else is an error."""
    import re

    if value is None or isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, tuple) and len(value) == 2:
        return datetime(int(value[0]), 1, 1) + timedelta(days=int(value[1]) - 1)
    if isinstance(value, str):
        text = re.sub(r"(\d)(st|nd|rd|th)\b", r"\1", value.strip())
        for f in _PYTHON:
            try:
                return datetime.strptime(text, f)
            except ValueError:
                continue
    raise ValueError(f"no timestamp: {value!r}")


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a text column in any of FORMATS; null if none fits."""
    plain = F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])


# --- LAS ---------------------------------------------------------------------------------------------------------

#: Sizes and first fields of LAS point records by format. Fixed values of the public LAS 1.4 specification.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_COLOUR = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_RECORDS = {0: _OLD, 1: [*_OLD, ("gps_time", "<f8")], 2: [*_OLD, *_COLOUR], 3: [*_OLD, ("gps_time", "<f8"), *_COLOUR], 6: _NEW, 7: [*_NEW, *_COLOUR], 8: [*_NEW, *_COLOUR, ("nir", "<u2")]}
_EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_SQL = {"u1": "int", "i1": "int", "<u2": "int", "<i2": "int", "<u4": "long", "<i4": "int", "<u8": "long", "<i8": "long", "<f4": "float", "<f8": "double"}


def las_header(path: str) -> dict:
    """Header of an uncompressed LAS file; LAZ is refused."""
    with open(path, "rb") as f:
        h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        form = h[104]
        if form & 0x80:
            raise ValueError(f"{path} is compressed (LAZ), which needs a decoder that is not here")
        if form not in _RECORDS:
            raise ValueError(f"point format {form} is not known")
        day, year = struct.unpack_from("<HH", h, 90)
        size, = struct.unpack_from("<H", h, 105)
        count, = struct.unpack_from("<Q", h, 247) if h[25] >= 4 else struct.unpack_from("<I", h, 107)
        header, start, vlrs = struct.unpack_from("<HII", h, 94)
        fields = list(_RECORDS[form])
        f.seek(header)
        for _ in range(vlrs):
            v = f.read(54)
            body = f.read(struct.unpack_from("<H", v, 20)[0])
            if v[2:18].rstrip(b"\0") == b"LASF_Spec" and struct.unpack_from("<H", v, 18)[0] == 4:
                fields += [(body[k + 4 : k + 36].rstrip(b"\0").decode(), _EXTRA[body[k + 2]]) for k in range(0, len(body), 192)]
        used = np.dtype(fields).itemsize
        return {"path": path, "record": fields + ([("_rest", f"V{size - used}")] if size > used else []), "names": fields, "start": start, "count": count, "scale": struct.unpack_from("<3d", h, 131), "offset": struct.unpack_from("<3d", h, 155), "created": datetime(year, 1, 1) + timedelta(days=day - 1) if year else None, "new": form >= 6}


class _LasSlice(InputPartition):
    def __init__(self, header: dict, lo: int, hi: int):
        super().__init__((lo, hi))
        self.header, self.lo, self.hi = header, lo, hi


class _LasReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rows", 1_000_000))

    def partitions(self):
        h = las_header(self.path)
        return [_LasSlice(h, lo, min(lo + self.rows, h["count"])) for lo in range(0, h["count"], self.rows)] or [_LasSlice(h, 0, 0)]

    def read(self, part: _LasSlice) -> Iterator[pa.RecordBatch]:
        h, kind = part.header, np.dtype(part.header["record"])
        with open(h["path"], "rb") as f:
            f.seek(h["start"] + part.lo * kind.itemsize)
            a = np.frombuffer(f.read((part.hi - part.lo) * kind.itemsize), kind)
        made = {"point_id": np.arange(part.lo, part.hi, dtype=np.int64)} | {c.lower(): a[c] * h["scale"][k] + h["offset"][k] for k, c in enumerate("XYZ")}
        if h["new"]:
            made |= {"return_number": (a["returns"] & 15).astype(np.int32), "number_of_returns": (a["returns"] >> 4).astype(np.int32)}
        else:
            made |= {"return_number": (a["flags"] & 7).astype(np.int32), "number_of_returns": (a["flags"] >> 3 & 7).astype(np.int32)}
        from pyspark.sql.pandas.types import to_arrow_type

        cols = [pa.array(np.ascontiguousarray(made[f.name] if f.name in made else a[f.name])).cast(to_arrow_type(f.dataType)) for f in self.schema]
        yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema])


class LasDataSource(DataSource):
    """spark.read.format("tidemesh_las").load(path): point_id, x, y, z, return_number, number_of_returns and the record's fields and extra dimensions."""

    @classmethod
    def name(cls) -> str:
        return "tidemesh_las"

    def schema(self) -> str:
        h = las_header(self.options["path"])
        own = [(n, t) for n, t in h["names"] if n not in ("X", "Y", "Z", "returns", "flags")]
        return ", ".join(["point_id long, x double, y double, z double, return_number int, number_of_returns int", *[f"`{n}` {_SQL[t]}" for n, t in own]])

    def reader(self, schema):
        return _LasReader(schema, self.options)


def read_las(spark: SparkSession, *paths: str, normal_columns: Sequence[str] = (), additional: Mapping[str, str] | None = None):
    """LAS clouds (point_id, x, y, z, optional nx, ny, nz and extra dimensions under new names); several paths give a tuple.

    Records are read in slices, one task each; only the columns that are used are handed on.
    """
    if len(paths) > 1:
        return tuple(read_las(spark, p, normal_columns=normal_columns, additional=additional) for p in paths)
    spark.dataSource.register(LasDataSource)
    df = spark.read.format("tidemesh_las").load(paths[0])
    named = dict(zip(normal_columns, ("nx", "ny", "nz"))) | dict(additional or {})
    missing = set(named) - set(df.columns)
    if missing:
        raise ValueError(f"no such dimensions: {sorted(missing)}")
    return df.select("point_id", *AXES, *[F.col(f"`{a}`").alias(b) for a, b in named.items()])


def _write_parts(df: DataFrame, path: str, suffix: str, encode: Callable[[pa.Table], bytes]) -> int:
    """One file per task in a folder all tasks reach; a task that runs again writes the same file. Returns the rows written."""
    Path(path).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        rows = sum(b.num_rows for b in got)
        if rows:
            k = TaskContext.get().partitionId()
            part = Path(path) / f".part-{k:05d}.{TaskContext.get().taskAttemptId()}"
            part.write_bytes(encode(pa.Table.from_batches(got)))
            part.rename(Path(path) / f"part-{k:05d}.{suffix}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64())})

    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_las(df: DataFrame, path: str, extra: Sequence[str] = (), scale: float = 0.00025, point_format: int = 6) -> int:
    """Writes x, y, z and `extra` columns to LAS 1.4 files, one per task in folder `path`; returns the number of points. Repartition before to choose the number of files.

    Columns named like a field of the point format (intensity, classification, gps_time, ...) fill it, return_number and
    number_of_returns their halves of a byte, 1 where they are not given; values are cut to what the field can hold and
    nulls written as 0. Others become extra dimensions (booleans as bytes, nulls in real numbers as NaN).
    """
    rows = df.select(*[F.col(a).cast("double").alias(a) for a in AXES], *[F.col(c).cast("int").alias(c) if df.schema[c].dataType.simpleString() == "boolean" else F.col(c) for c in extra])

    def encode(t: pa.Table) -> bytes:
        xyz = np.stack([t[a].to_numpy() for a in AXES], 1)
        offset = np.round(xyz.mean(0))
        kinds, standard = [], {n for n, _ in _RECORDS[point_format]} - {"X", "Y", "Z", "returns"}
        for c in extra:
            if c in standard or c in ("return_number", "number_of_returns"):
                continue
            a = t[c].to_numpy()
            kinds.append((c, "<f8" if a.dtype.kind not in "iu" else f"<i{a.dtype.itemsize}", a))
        rec = np.zeros(len(t), np.dtype([*_RECORDS[point_format], *[(c, k) for c, k, _ in kinds]]))
        for k, a in enumerate("XYZ"):
            rec[a] = np.rint((xyz[:, k] - offset[k]) / scale)
        first, of = (np.clip(np.nan_to_num(t[c].to_numpy().astype(float), nan=1.0), 0, 15).astype("u1") if c in extra else np.ones(len(t), "u1") for c in ("return_number", "number_of_returns"))
        rec["returns"] = first | of << 4
        for c in standard & set(extra):
            a, kind = np.nan_to_num(t[c].to_numpy().astype(float)), rec.dtype[c]
            rec[c] = np.clip(np.rint(a), np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "iu" else a
        for c, _, a in kinds:
            rec[c] = a
        codes = {v: k for k, v in _EXTRA.items()}
        body = b"".join(struct.pack("<2xBB32s156x", codes[k], 0, c.encode()[:32]) for c, k, _ in kinds)
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"extra bytes") + body if kinds else b""
        low, high = xyz.min(0), xyz.max(0)
        box = [v for k in range(3) for v in (high[k], low[k])]
        h = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I3d3d6dQQIQ15Q", b"LASF", 0, 16, 0, 0, 0, b"\0" * 8, 1, 4, b"", b"tidemesh", 1, 2000, 375, 375 + len(vlr), 1 if vlr else 0, point_format, rec.dtype.itemsize, 0, *[0] * 5, *[scale] * 3, *offset, *box, 0, 0, 0, len(rec), len(rec), *[0] * 14)
        return h + vlr + rec.tobytes()

    return _write_parts(rows, path, "las", encode)


#: The 12 triangles of a cube by corner number (bit 0: x, bit 1: y, bit 2: z). Fixed values.
_FACES = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def cube_mesh(voxels: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices (vx, vy, vz, corner, x, y, z) and faces (vx, vy, vz, a, b, c) of voxels at center x, y, z."""
    v = voxels.select("vx", "vy", "vz", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner"))
    at = [(F.col(a) + (F.shiftright("corner", k).bitwiseAND(1) - 0.5) * float(size)).alias(a) for k, a in enumerate(AXES)]
    f = voxels.select("vx", "vy", "vz", F.explode(F.array(*[F.struct(*[F.lit(i).alias(n) for i, n in zip(t, "abc")]) for t in _FACES])).alias("f"))
    return v.select("vx", "vy", "vz", "corner", *at), f.select("vx", "vy", "vz", "f.*")


def write_ply(voxels: DataFrame, path: str, size: float, features: Sequence[str] = (), binary: bool = True, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> int:
    """Cubes for voxels at center x, y, z with float features, as PLY meshes, one per task in folder `path`; returns the number of voxels."""
    rows = voxels.select(*AXES, *[F.col(c).cast("float").alias(c) for c in features])

    def encode(t: pa.Table) -> bytes:
        n = len(t)
        corners = np.array([[k & 1, k >> 1 & 1, k >> 2] for k in range(8)]) - 0.5
        xyz = np.stack([t[a].to_numpy() for a in AXES], 1)[:, None] + corners[None] * size - np.array(shift)
        vertex = np.zeros(8 * n, np.dtype([(a, "<f8") for a in AXES] + [(c, "<f4") for c in features]))
        for k, a in enumerate(AXES):
            vertex[a] = xyz.reshape(-1, 3)[:, k]
        for c in features:
            vertex[c] = np.repeat(t[c].to_numpy(), 8)
        face = np.zeros(12 * n, np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        face["n"], face["v"] = 3, (np.arange(n)[:, None, None] * 8 + np.array(_FACES)[None]).reshape(-1, 3)
        head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {8 * n}", *[f"property double {a}" for a in AXES], *[f"property float {c}" for c in features], f"element face {12 * n}", "property list uchar int vertex_indices", "end_header", ""]
        body = vertex.tobytes() + face.tobytes() if binary else "".join(" ".join(map(str, r)) + "\n" for r in vertex.tolist()).encode() + "".join(f"3 {a} {b} {c}\n" for a, b, c in face["v"].tolist()).encode()
        return "\n".join(head).encode() + body

    return _write_parts(rows, path, "ply", encode)
