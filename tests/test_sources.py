from datetime import date, datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemesh.operators import voxel
from tidemesh.sources import files, store
from tidemesh.streaming import ingest


def test_xyz_text(spark, tmp_path):
    p = tmp_path / "a.xyz"
    p.write_text("# two planes\n1 2 3\n\n  4.5\t5 6 # end\n")
    assert rows(files.read_xyz(spark, str(p))) == [(1.0, 2.0, 3.0), (4.5, 5.0, 6.0)]
    q = tmp_path / "b.csv"
    q.write_text("head\nx,y,z,i,n\n1,2,3,7,0.5\n4,5,6,8,0.25\n")
    got = files.read_xyz(spark, str(q), delimiter=",", skip_header=2, additional={"intensity": 3, "n": 4}, types={"intensity": "int"})
    assert rows(got) == [(1.0, 2.0, 3.0, 7, 0.5), (4.0, 5.0, 6.0, 8, 0.25)] and dict(got.dtypes)["intensity"] == "int"
    assert len(files.read_xyz(spark, str(p), str(p))) == 2
    with pytest.raises(ValueError):
        files.read_xyz(spark, str(q), skip_header=2)
    p.write_text("1 2 3\n4 5\n")
    with pytest.raises(Exception, match="number of fields"):
        files.read_xyz(spark, str(p)).collect()
    p.write_text("1 2 three\n")
    with pytest.raises(Exception):
        files.read_xyz(spark, str(p)).collect()


def test_las_round_trip_in_slices(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 500
    df = spark.createDataFrame([(i, *map(float, v), int(i % 7), bool(i % 2)) for i, v in enumerate(rng.uniform(3e5, 3e5 + 50, (n, 3)))], "point_id long, x double, y double, z double, label long, ok boolean").coalesce(1)
    assert files.write_las(df, str(tmp_path / "out"), ["label", "ok"]) == n
    path = str(next((tmp_path / "out").glob("part-*.las")))
    got = files.read_las(spark, path, additional={"label": "label", "ok": "ok"})
    a, b = np.array(rows(got)), np.array(rows(df))
    assert np.abs(a[:, 1:4] - b[:, 1:4].astype(float)).max() <= 0.00026 and (a[:, 4:].astype(int) == b[:, 4:].astype(int)).all()
    sliced = spark.read.format("tidemesh_las").option("rows", 100).load(path)
    assert sliced.rdd.getNumPartitions() == 5 and sliced.count() == n
    with pytest.raises(ValueError):
        files.read_las(spark, path, additional={"colour": "c"})
    bad = bytearray(open(path, "rb").read())
    bad[104] |= 0x80
    (tmp_path / "z.laz").write_bytes(bytes(bad))
    with pytest.raises(ValueError, match="LAZ"):
        files.las_header(str(tmp_path / "z.laz"))


def test_ply_cubes(spark, tmp_path):
    c = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 2.5, 0.5, 0.5)], "point_id long, x double, y double, z double")
    v = voxel.delta(c, c, 1.0)
    corners, faces = files.cube_mesh(v, 1.0)
    assert corners.count() == 16 and faces.count() == 24
    assert rows(corners.agg(F.min("x"), F.max("x"))) == [(0.0, 3.0)]
    for binary in (True, False):
        out = tmp_path / str(binary)
        assert files.write_ply(v.coalesce(1), str(out), 1.0, ["change_type"], binary) == 2
        data = next(out.glob("*.ply")).read_bytes()
        head, _, body = data.partition(b"end_header\n")
        assert b"element vertex 16" in head and b"element face 24" in head
        assert len(body) == 16 * 28 + 24 * 13 if binary else body.count(b"\n") == 40


def test_small_sources(spark, tmp_path):
    grid = rows(files.regular_corepoints(spark, (0, 0), (2, 3), (3, 4), 7.0))
    assert grid[0] == (0, 0.0, 0.0, 7.0) and grid[5] == (5, 1.0, 1.0, 7.0) and grid[-1] == (11, 2.0, 3.0, 7.0)
    p = tmp_path / "c.csv"
    p.write_text("1,2,1\n3,4,0\n")
    assert rows(files.read_correspondences(spark, str(p))) == [(1, 2, 1), (3, 4, 0)]
    p.write_text("1\n2\n")
    with pytest.raises(ValueError):
        files.read_correspondences(spark, str(p))
    info = {"1": {"origin": [1.0, 2.0, 3.0], "sigma_range": 0.1, "sigma_scan": 0.2, "sigma_yaw": 0.3}}
    assert rows(files.scan_positions(spark, info)) == [(1, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3)]
    for bad in ({"2": info["1"]}, {"1": info["1"] | {"sigma_yaw": 1}}):
        with pytest.raises(ValueError):
            files.scan_positions(spark, bad)
    assert files.as_cloud(spark, np.zeros((4, 3))).count() == 4
    with pytest.raises(ValueError):
        files.as_cloud(spark, np.zeros((4, 2)))


def test_timestamps(spark):
    assert files.timestamp((2010, 34)) == datetime(2010, 2, 3) and files.timestamp(date(2010, 2, 3)) == datetime(2010, 2, 3)
    assert files.timestamp("February 3rd, 2010, 9:27AM") == datetime(2010, 2, 3, 9, 27) and files.timestamp(None) is None
    for bad in ("foo", 42, (1, 2, 3)):
        with pytest.raises(ValueError):
            files.timestamp(bad)
    df = spark.createDataFrame([("February 3rd, 2010, 9:27AM",), ("2010-02-03 09:27",), ("20100203_092700",), ("foo",), (None,)], "t string")
    assert [r[0] for r in df.select(files.parse_timestamp(F.col("t"))).collect()] == [datetime(2010, 2, 3, 9, 27)] * 3 + [None, None]


def plane(spark, z, n=12):
    return spark.createDataFrame([(i * n + j, i / 4, j / 4, float(z)) for i in range(n) for j in range(n)], "point_id long, x double, y double, z double")


CORE = [(1, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0), (2, 99.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
CORE_SCHEMA = "corepoint_id long, x double, y double, z double, nx double, ny double, nz double"


def test_store_sets_once_appends_and_invalidates(spark, tmp_path):
    path = str(tmp_path / "s")
    s = store.SpaceTimeStore(spark, path)
    core = spark.createDataFrame(CORE, CORE_SCHEMA)
    with pytest.raises(ValueError):
        s.set_reference_epoch(plane(spark, 0), None)
    s.set_reference_epoch(plane(spark, 0), datetime(2024, 1, 1))
    s.set_corepoints(core)
    with pytest.raises(Exception):
        s.set_corepoints(core)
    s.add_epochs((plane(spark, 0.5), datetime(2024, 1, 3)), (plane(spark, 0.25), datetime(2024, 1, 2)), radius=0.6, max_distance=2.0)
    s = store.SpaceTimeStore(spark, path)  # opened again
    assert rows(s.distances.filter("corepoint_id = 1"), "epoch_idx", "distance") == [(0, 0.25), (1, 0.5)]
    assert rows(s.epochs, "epoch_idx", "delta_seconds") == [(0, 86400.0), (1, 172800.0)]
    s.smooth(2)
    assert rows(s.distances_for_compute.filter("corepoint_id = 1"), "epoch_idx", "distance") == [(0, 0.25), (1, 0.25)]
    s.put("seeds", core)
    s.add_epochs((plane(spark, 1.0), (2024, 5)), radius=0.6, max_distance=2.0)
    assert not s.folder.has("seeds") and rows(s.distances_for_compute.filter("corepoint_id = 1"), "epoch_idx", "distance") == [(0, 0.25), (1, 0.5), (2, 1.0)]
    s.folder.note({"version": 99})
    with pytest.raises(ValueError):
        store.SpaceTimeStore(spark, path)
    assert store.SpaceTimeStore(spark, path, force=True).folder.notes()["epochs"] == 0


def test_saved_epochs(spark, tmp_path):
    path = str(tmp_path / "e")
    store.save_epoch(plane(spark, 0).withColumn("extra", F.lit(3)), path, "2024-02-01", [{"matrix": [[1.0]]}])
    cloud, meta = store.load_epoch(spark, path)
    assert cloud.count() == 144 and "extra" in cloud.columns and meta["timestamp"] == "2024-02-01T00:00:00" and meta["transformations"] == [{"matrix": [[1.0]]}]
    with pytest.raises(FileNotFoundError):
        store.load_epoch(spark, str(tmp_path / "none"))
    store.Folder(spark, path).note(meta | {"version": 99})
    with pytest.raises(ValueError):
        store.load_epoch(spark, path)


def test_streams_of_scans(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for k, z in ((1, 0.5), (2, 0.75)):
        plane(spark, z).withColumn("epoch_id", F.lit(k)).withColumn("ts", F.lit(datetime(2024, 1, k))).coalesce(1).write.parquet(str(src / f"e{k}"))
    schema = spark.read.parquet(str(src / "e1")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = ingest.distances_sink(stream, spark.createDataFrame(CORE, CORE_SCHEMA), plane(spark, 0), str(out), str(tmp_path / "c"), 0.6, 2.0)
    q.awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert rows(got.filter("corepoint_id = 1"), "epoch_id", "distance") == [(1, 0.5), (2, 0.75)]
    counts = ingest.voxel_counts(spark.readStream.schema(schema).parquet(str(src / "*")), 10.0, "1 day")
    w = counts.writeStream.outputMode("complete").format("memory").queryName("voxels").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert rows(spark.table("voxels").agg(F.sum("count"))) == [(288,)]


def test_las_standard_fields_are_filled_and_others_are_extra(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 70_000, 2, 3, 6, True, 0.5, None), (1.5, 2.5, 3.5, 12, 1, 1, None, False, None, 7)], "x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, kept boolean, gps_time double, mine int")
    extra = ["intensity", "return_number", "number_of_returns", "classification", "kept", "gps_time", "mine"]
    assert files.write_las(df.fillna({"mine": 0}).coalesce(1), str(tmp_path / "a"), extra) == 2
    path = str(next((tmp_path / "a").glob("*.las")))
    back = files.read_las(spark, path, additional={c: c for c in extra})
    assert sorted(tuple(r)[4:] for r in back.collect()) == [(12, 1, 1, 0, 0, 0.0, 7), (65535, 2, 3, 6, 1, 0.5, 0)]
    with pytest.raises(ValueError):
        files.read_las(spark, path, additional={"flagged": "f"})
