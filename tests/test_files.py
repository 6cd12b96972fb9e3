"""Readers and writers."""

import datetime
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoptic import sources


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "HC" / "p1" / "SDMT").mkdir(parents=True)
    (tmp_path / "in" / "pwMS" / "p2" / "KD").mkdir(parents=True)
    return tmp_path


def test_wav(spark, folder):
    r = np.random.default_rng(0)
    x = (r.normal(size=(700, 2)) * 3000).astype("<i2")
    with wave.open(str(folder / "in/HC/p1/SDMT/a_b_run1.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(x.tobytes())
    files = sources.listed(spark, str(folder / "in"), "*.wav", "run", contents=True)
    got = sources.wav_samples(files).orderBy("idx").collect()
    np.testing.assert_allclose([g.value for g in got], x.mean(axis=1) / 2**15, atol=1e-12)
    assert got[0].rate == 8000
    info = sources.wav_info(files).first()
    assert (info.rate, info.channels, info.samples) == (8000, 2, 700)
    assert [tuple(d) for d in sources.directories(files, str(folder / "in"), "SDMT").collect()] == [("HC", "p1")]
    assert sources.listed(spark, str(folder / "in"), "*.wav", "kd").count() == 0


def test_npy(spark, folder):
    kind = [("t", "<f8"), ("x", "<f4"), ("y", "<f4"), ("status", "u1"), ("evt", "u1")]
    a = np.array([(0, 1, 2, 1, 0), (1, np.nan, 2, 1, 3), (2, 1, 1, 1, 5)], kind)
    np.save(folder / "in/HC/p1/SDMT/1_x.npy", a)
    np.save(folder / "in/pwMS/p2/KD/2_x.npy", np.array([a[0].tolist(), a[1].tolist()], float))
    rows = sources.npy_records(sources.listed(spark, str(folder / "in"), "*.npy", contents=True)).orderBy("path", "idx").collect()
    assert [(r.idx, r.x, r.status, r.evt) for r in rows] == [(0, 1, 1, 1), (1, None, 1, 3), (2, 1, 0, 5), (0, 1, 1, 1), (1, None, 1, 3)]
    assert sources.parsed(spark, a).count() == 3
    assert sources.parsed(spark, str(folder / "in/HC/p1/SDMT/1_x.npy")).count() == 3
    assert sources.parsed(spark, str(folder / "in/HC/p1/SDMT/1_x.npy"), lambda b: pd.DataFrame({"n": [len(b)]}), "n long").first().n > 0
    assert [r.evt for r in sources.fixations(spark, str(folder / "in/HC/p1/SDMT/1_x.npy")).orderBy("t").collect()] == [2, 2, 2]
    np.save(folder / "in/bad.npy", np.zeros(3))
    with pytest.raises(Exception, match="has no 5 columns"):
        sources.npy_records(sources.listed(spark, str(folder / "in"), "bad.npy", contents=True)).collect()


def test_fixation_csv_and_npy_round_trip(spark, folder):
    df = spark.createDataFrame([(i, i / 10, 0.5, 0.25, 1.0, float(i % 2 + 1)) for i in range(5)], "idx long, t double, eye_horizontal double, eye_vertical double, status double, evt double")
    sources.write_csv(df.coalesce(1), str(folder / "csv"), "idx")
    got = sources.fixation_csv(spark, str(folder / "csv")).orderBy("t")
    assert got.collect() == df.drop("idx").orderBy("t").collect()
    named = df.withColumns({"panel": F.lit("1"), "x": F.col("eye_horizontal"), "y": F.col("eye_vertical")})
    assert sources.write_npy(named, str(folder / "npy"), ["panel"], "idx", ["t", "x", "y", "status", "evt"]) == 1
    assert sources.npy_records(sources.listed(spark, str(folder / "npy"), contents=True)).count() == 5


def test_only_missing_series_are_written(spark, folder):
    df = spark.createDataFrame([("p1", "1", 1), ("p2", "1", 2)], "participant string, panel string, v int")
    path = str(folder / "out")
    sources.append_missing(df.where("v = 1"), path)
    sources.append_missing(df.withColumn("v", F.col("v") * 10), path)
    assert sorted((r.participant, r.v) for r in spark.read.parquet(path).collect()) == [("p1", 1), ("p2", 20)]


def test_series_have_no_folders_unless_they_had(spark, folder):
    df = spark.range(400).select((F.col("id") % 200).cast("string").alias("participant"), F.lit("1").alias("panel"), F.col("id").alias("v"))
    for layout in ("flat", "folders"):
        path = str(folder / layout)
        if layout == "folders":
            sources.write_records(df.where("participant = '7'"), path)
        for _ in range(2):
            sources.append_missing(df.where("v % 200 < 20"), path)
        assert sorted(r.v for r in spark.read.parquet(path).collect()) == sorted(i for i in range(400) if i % 200 < 20)
        folders = [f for f in (folder / layout).iterdir() if f.is_dir()]
        assert len(folders) == (20 if layout == "folders" else 0)


def test_short_files_are_decoded_together(spark, folder):
    rows = spark.range(900).select((F.col("id") % 300).alias("p"), F.col("id").cast("double").alias("t"), F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.lit(1.0).alias("status"), F.lit(2.0).alias("evt"))
    path = str(folder / "npy")
    assert sources.write_npy(rows, path, ["p"], "t", ["t", "x", "y", "status", "evt"]) == 300
    got = sources.npy_records(sources.listed(spark, path, "*.npy", contents=True)).select(F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("int").alias("p"), "idx", "t").collect()
    assert sorted((r.p, r.idx, r.t) for r in got) == sorted((i % 300, i // 300, float(i)) for i in range(900))


def test_image_shapes(spark, folder):
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x00" * 9)
    (folder / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\x00" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 1080, 1920) + b"\x00" * 10)
    for name, shape in (("a.png", (480, 640)), ("b.jpg", (1080, 1920))):
        r = sources.image_shapes(sources.listed(spark, str(folder), name, contents=True)).first()
        assert (r.height, r.width) == shape


def test_recording_date(spark):
    df = spark.createDataFrame([("MATLAB 5.0 MAT-file, Created on: Tue Jul  2 01:02:03 2024",), ("none",), (None,)], "h string")
    got = [r.d for r in df.select(sources.recording_date(F.col("h")).alias("d")).collect()]
    assert got == [datetime.datetime(2024, 7, 2, 1, 2, 3), datetime.datetime(2024, 7, 1), datetime.datetime(2024, 7, 1)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"seq_len": 200}')
    assert sources.config(str(tmp_path / "c.json"), stride_step=10) == {"center_data": True, "stride_step": 10, "seq_len": 200}


def test_checkpoint(spark, tmp_path):
    from isoptic.operators import vector

    df = spark.createDataFrame([([float(i % 2), 1.0],) for i in range(10)], "v array<double>")
    model, out = vector.kmeans(df, "v", 2)
    path = sources.write_checkpoint(model, str(tmp_path), "k", datetime.date(2024, 1, 2))
    assert path.endswith("2024-01-02/k") and type(model).load(path).getK() == 2 and out.select("cluster").distinct().count() == 2
