"""Packs as a data source: what is read, how much of it, and what is refused."""

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavelake.sources import packs

SAMPLES = "pack_id string, t_ms long, ax double, az double, lat double, note string"
META = json.dumps({"version": "0.8"})


def write(path, samples, frames=(), **more):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, body in {"samples.csv": samples, "events.csv": "﻿id,t_ms\r\n1,10\r\n", "meta.json": META, **more}.items():
            z.writestr(name, body)
        for name, body in frames:
            z.writestr(f"frames/{name}", body)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "a.zip", '﻿t_ms,ax,az,lat,note\r\n0,1.5,9.8,31.2,"x, ""y""\nz"\r\n17,oops,9.7,,\r\n', [("ev1_t10.jpg", b"J" * 900), ("sweep_t30.jpg", b"K" * 800), ("odd.txt", b"?")])
    write(tmp_path / "b.zip", " Timestamp ,AccX,Accelerometer Z,extra\n5,2.5,9.9,q\n6.5,3,9,q\n")
    write(tmp_path / "c.zip", "", segments=b"")
    return tmp_path


def test_headers_of_their_own(spark, folder):
    got = packs.read_member(spark, str(folder), "samples.csv", SAMPLES).orderBy("pack_id", "ax").collect()
    assert [tuple(r) for r in got] == [("a", 17, None, 9.7, None, None), ("a", 0, 1.5, 9.8, 31.2, 'x, "y"\nz'), ("b", 5, 2.5, 9.9, None, None), ("b", None, 3.0, 9.0, None, None)]
    assert packs.read_member(spark, str(folder), "segments.csv", "pack_id string, kind string").count() == 0
    assert [json.loads(r.body) for r in packs.read_member(spark, f"file://{folder}/a.zip", "meta.json", "pack_id string, body string").collect()] == [{"version": "0.8"}]


def test_members(spark, folder):
    names = packs.read_member(spark, str(folder), "", "pack_id string, name string, size long")
    assert names.filter("pack_id = 'a'").count() == 6
    frames = packs.read_member(spark, str(folder), "frames/", "pack_id string, name string, event_id long, t_ms long, content binary").orderBy("t_ms").collect()
    assert [(r.event_id, r.t_ms, len(r.content)) for r in frames] == [(None, None, 1), (1, 10, 900), (None, 30, 800)]


def test_large_packs_are_read_by_several_tasks(spark, tmp_path):
    write(tmp_path / "big.zip", "t_ms\n1\n", [(f"ev{i}_t{i}.jpg", bytes([i]) * 3000) for i in range(40)])
    spark.dataSource.register(packs.RidePacks)
    d = spark.read.format("ride_pack").schema("pack_id string, name string, event_id long, content binary").option("member", "frames/").option("split_bytes", 10_000).load(str(tmp_path))
    assert d.rdd.getNumPartitions() > 10
    assert sorted((r.event_id, r.content == bytes([r.event_id]) * 3000) for r in d.collect()) == [(i, True) for i in range(40)]


class Counted(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        out = super().read(n)
        self.seen += len(out)
        return out


def test_frames_are_not_read_for_samples(tmp_path):
    write(tmp_path / "p.zip", "t_ms,ax\n" + "".join(f"{i},{i}\n" for i in range(1000)), [(f"sweep_t{i}.jpg", b"F" * 500_000) for i in range(40)])
    data = (tmp_path / "p.zip").read_bytes()
    file = Counted(data)
    from pyspark.sql.types import StructType

    schema = StructType().add("pack_id", "string").add("t_ms", "long").add("ax", "double")
    reader = packs.PackReader({"path": "/", "member": "samples.csv"}, schema)
    rows = sum(b.num_rows for b in reader.read_pack(file, "p", 0, len(data)))
    assert rows == 1000 and file.seen < 200_000 < len(data) // 50


@pytest.mark.parametrize("more,error", [({"../x": b""}, "unsafe"), ({"/x": b""}, "unsafe")])
def test_refused(tmp_path, more, error):
    write(tmp_path / "p.zip", "t_ms\n", **more)
    with pytest.raises(ValueError, match=error):
        packs.directory(open(tmp_path / "p.zip", "rb"))
    assert packs.directory(open(tmp_path / "p.zip", "rb"), check=False)[1]


def test_other_bad_packs(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("samples.csv", "x")
    with pytest.raises(ValueError, match="compressed"):
        packs.directory(open(tmp_path / "z.zip", "rb"))
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("samples.csv", "x")
    with pytest.raises(ValueError, match="missing"):
        packs.directory(open(tmp_path / "m.zip", "rb"))
    (tmp_path / "t.zip").write_bytes((tmp_path / "m.zip").read_bytes()[:-10])
    with pytest.raises(zipfile.BadZipFile):
        packs.directory(open(tmp_path / "t.zip", "rb"))


def test_rows_of_another_width_are_an_error(spark, tmp_path):
    write(tmp_path / "p.zip", "t_ms,ax\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)column"):
        packs.read_member(spark, str(tmp_path), "samples.csv", "t_ms long").collect()


def test_loose_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿Time,AccX\n1,2\n2,3\n", encoding="utf-8")
    (tmp_path / "two.csv").write_text("accelerometer x,t_ms,speed_ms\n5,7,1.5\n")
    (tmp_path / "empty.csv").write_text("")
    got = packs.read_member(spark, str(tmp_path), "*.csv", "pack_id string, t long, ax double, speed double").orderBy("t").collect()
    assert [tuple(r) for r in got] == [("one", 1, 2.0, None), ("one", 2, 3.0, None), ("two", 7, 5.0, 1.5)]


def test_sql(spark, folder):
    packs.register(spark)
    spark.createDataFrame([(f"{folder}/a.zip",), (None,)], "path string").createOrReplaceTempView("pack_paths")
    got = spark.sql("SELECT m.name, m.event_id, m.t_ms, m.size FROM pack_paths p, LATERAL pack_members(p.path) m WHERE m.t_ms IS NOT NULL ORDER BY m.t_ms").collect()
    assert [tuple(r) for r in got] == [("frames/ev1_t10.jpg", 1, 10, 900), ("frames/sweep_t30.jpg", None, 30, 800)]


def test_written_packs_read_back(spark, tmp_path):
    s = spark.range(200).select((F.col("id") % 3).alias("pack_id"), F.col("id").alias("t_ms"), (F.col("id") / 7).alias("ax"))
    e = s.filter("t_ms % 10 = 0").select("pack_id", "t_ms", F.lit("坑洼").alias("final_label"))
    told = {r.pack_id: (r.samples, r.events) for r in packs.write_packs(s, e, str(tmp_path / "out")).collect()}
    assert told[0] == (67, 7) and sum(x for x, _ in told.values()) == 200
    back = packs.read_member(spark, str(tmp_path / "out"), "samples.csv", "pack_id string, t_ms long, ax double").withColumn("pack_id", F.col("pack_id").cast("long"))
    assert back.exceptAll(s).count() == 0 and back.count() == 200
    assert {r.final_label for r in packs.read_member(spark, str(tmp_path / "out"), "events.csv", "pack_id string, final_label string").collect()} == {"坑洼"}


def test_numbers():
    text = pa.array(["1", " -2.5 ", "+3", ".5", "1e3", "", None, "x", "7.0", "--1", "0.1", "1e", "-", "5."])
    assert packs.parsed(text, pa.float64()).to_pylist() == [1.0, -2.5, 3.0, 0.5, 1000.0, None, None, None, 7.0, None, 0.1, None, None, 5.0]
    assert packs.parsed(text, pa.int64()).to_pylist() == [1, None, 3, None, None, None, None, None, 7, None, None, None, None, 5]


def test_no_packs(spark, tmp_path):
    assert packs.read_member(spark, str(tmp_path), "samples.csv", SAMPLES).count() == 0
