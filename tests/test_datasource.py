import os
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoptic.sources import datasource as D
from isoptic.sources import files
from test_mat import mat_file


def recording(n=5):
    left = np.linspace(0, 1, 2 * n).reshape(2, n)
    left[0, 1] = np.nan
    eye = lambda a: {"gazePoint": {"onDisplayArea": a}}
    data = {"gaze": {"left": eye(left), "right": eye(1 - left), "systemTimeStamp": np.arange(n) * 1000.0}}
    return mat_file({"data": data, "messages": [[np.array([1.0]), "slide 1"], [np.array([2.5]), "slide 2"]], "Dom_Eye": "r"}, packed=True)


@pytest.fixture
def sources(spark):
    D.register(spark)
    return spark


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def npy(folder, name, array):
    np.save(folder / name, array)
    return f"file:{folder}/{name}"


def records(n, start=0):
    a = np.zeros(n, [("t", "<f8"), ("x", "<f4"), ("n", ">i4"), ("ok", "?")])
    a["t"], a["x"], a["n"], a["ok"] = np.arange(start, start + n) / 7, np.arange(n) * 2, np.arange(n), np.arange(n) % 2
    return a


def test_one_npy_file_is_several_partitions(sources, tmp_path):
    uri = npy(tmp_path, "a.npy", records(1003))
    npy(tmp_path, "b.npy", records(5, 100))
    npy(tmp_path, "_hidden.npy", records(5))
    df = sources.read.format("npy").option("rows", 100).load(str(tmp_path))
    assert df.dtypes == [("path", "string"), ("idx", "bigint"), ("t", "double"), ("x", "float"), ("n", "int"), ("ok", "boolean")]
    assert df.rdd.getNumPartitions() == 12
    got = sorted(tuple(r) for r in df.where(F.col("path") == uri).collect())
    a = records(1003)
    assert got == [(uri, i, a["t"][i].item(), a["x"][i].item(), a["n"][i].item(), bool(a["ok"][i])) for i in range(1003)]


def test_conditions_reach_the_files(sources, tmp_path):
    uri = npy(tmp_path, "a.npy", records(1000))
    for k in range(5):
        npy(tmp_path, f"z{k}.npy", records(1000))
    df = sources.read.format("npy").option("rows", 100).load(f"file://{tmp_path}")
    some = df.where((F.col("path") == uri) & (F.col("idx") >= 250) & (F.col("idx") < 420) & (F.col("n") % 2 == 0))
    assert some.rdd.getNumPartitions() == 2  # 170 rows of one file, by 100
    assert sorted(r.idx for r in some.collect()) == list(range(250, 420, 2))
    conditions = [line for line in plan(some).splitlines() if "Filter" in line and "BatchScan" not in line]
    assert len(conditions) == 1 and "%" in conditions[0] and "250" not in conditions[0] and "420" not in conditions[0]
    assert df.where(F.col("idx") > 998).count() == 6 and df.where(F.col("idx") <= 1).count() == 12
    assert df.where(F.col("idx") == 7).rdd.getNumPartitions() == 6
    assert df.where(F.col("path").isin(uri, "file:/none")).count() == 1000
    assert df.where(F.col("path") == "none").collect() == []


@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_have_columns_by_place_or_name(sources, tmp_path, order):
    a = np.asarray(np.random.default_rng(0).normal(size=(307, 4)), order=order)
    npy(tmp_path, "a.npy", a)
    df = sources.read.format("npy").option("rows", 50).load(str(tmp_path)).orderBy("idx")
    assert np.array_equal(np.array([[r.c0, r.c1, r.c2, r.c3] for r in df.collect()]), a)
    named = sources.read.format("npy").option("names", "t, x").load(str(tmp_path)).orderBy("idx")
    assert named.columns == ["path", "idx", "t", "x"] and np.array_equal(np.array([[r.t, r.x] for r in named.collect()]), a[:, :2])


def test_what_is_no_table_fails(sources, tmp_path):
    npy(tmp_path, "a.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="is no table"):
        sources.read.format("npy").load(str(tmp_path)).collect()
    os.mkdir(tmp_path / "object")
    np.save(tmp_path / "object" / "o.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="is no table"):
        sources.read.format("npy").load(f"{tmp_path}/object").collect()
    with pytest.raises(Exception, match="FileNotFound|no NPY"):
        sources.read.format("npy").load(f"{tmp_path}/none").collect()
    os.mkdir(tmp_path / "short")
    (tmp_path / "short" / "s.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:50])
    with pytest.raises(Exception):  # noqa: B017
        sources.read.format("npy").load(f"{tmp_path}/short").collect()


def sound(path, x, width, channels=1, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_one_wav_file_is_several_partitions(sources, tmp_path, width):
    raw = np.random.default_rng(width).integers(0, 256, 1000 * width * 2, dtype=np.uint8).tobytes()
    sound(tmp_path / "a.wav", raw, width, 2)
    df = sources.read.format("wav").option("rows", 64).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 16
    want = {r.idx: r.value for r in files.wav_samples(files.listed(sources, str(tmp_path), "*.wav", contents=True)).collect()}
    got = {r.idx: r.value for r in df.collect()}
    assert got == want and len(got) == 1000
    assert df.where("idx >= 990").rdd.getNumPartitions() == 1
    assert {r.rate for r in df.collect()} == {8000}


def test_chunks_before_the_samples_are_passed_over(sources, tmp_path):
    sound(tmp_path / "a.wav", np.arange(10, dtype="<i2").tobytes(), 2)
    raw = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "a.wav").write_bytes(raw[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + raw[12:])
    got = sources.read.format("wav").load(str(tmp_path)).orderBy("idx").collect()
    assert [r.value for r in got] == [i / 2**15 for i in range(10)]


def test_mat_recordings_are_read_by_file(sources, tmp_path):
    names = []
    for k in range(3):
        (tmp_path / f"r{k}.mat").write_bytes(recording())
        names.append(f"file:{tmp_path}/r{k}.mat")
    from isoptic.sources import mat

    listed = files.listed(sources, f"file://{tmp_path}", "*.mat", contents=True)
    key = lambda r: str(tuple(r))
    for table, plain in (("gaze", mat.gaze), ("messages", mat.messages), ("recordings", mat.recordings)):
        df = sources.read.format("mat").option("table", table).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == 3
        assert sorted(map(key, df.collect())) == sorted(map(key, plain(listed).collect()))
        assert df.where(F.col("recording_id") == names[1]).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="table none"):
        sources.read.format("mat").option("table", "none").load(str(tmp_path)).collect()


def series(spark, n=600):
    return spark.range(n).select((F.col("id") % 7).alias("user"), F.concat(F.lit("p/"), (F.col("id") % 2).cast("string")).alias("panel"), F.col("id").alias("at"), (F.col("id") / 3).alias("x"))


def test_series_are_written_whole_and_read_back(sources, tmp_path):
    out = f"{tmp_path}/out"
    D.write_npy(series(sources), out, ["user", "panel"], "at", ["at", "x"])
    names = sorted(os.listdir(out))
    assert names == sorted(f"{u}_p%2F{p}.npy" for u in range(7) for p in range(2))
    got = sources.read.format("npy").load(out)
    assert sorted((r.at, r.x) for r in got.collect()) == [(i, i / 3) for i in range(600)]
    a = np.load(f"{out}/3_p%2F1.npy")
    assert list(a["at"]) == sorted(i for i in range(600) if i % 7 == 3 and i % 2 == 1)


def test_files_that_are_there_fail_are_skipped_or_replaced(sources, tmp_path):
    out = f"{tmp_path}/out"
    keys, cols = ["user", "panel"], ["at", "x"]
    D.write_npy(series(sources, 20), out, keys, "at", cols)
    with pytest.raises(Exception, match="files are there"):
        D.write_npy(series(sources, 40), out, keys, "at", cols)
    read = lambda: sources.read.format("npy").load(out).count()
    assert read() == 20
    D.write_npy(series(sources, 40), out, keys, "at", cols, existing="skip")
    assert read() == 20
    D.write_npy(series(sources, 40), out, keys, "at", cols, existing="replace")
    assert read() == 40
    D.write_npy(series(sources, 3), out, keys, "at", cols, mode="overwrite")
    assert read() == 3 and len(os.listdir(out)) == 3


def test_a_failing_task_leaves_nothing(sources, tmp_path):
    out = f"{tmp_path}/out"
    D.write_npy(series(sources, 20), out, ["user"], "at", ["x"])
    before = sorted(os.listdir(out))
    bad = series(sources).withColumn("x", F.when(F.col("at") < 599, F.col("x")).otherwise(F.raise_error(F.lit("broken")).cast("double")))
    with pytest.raises(Exception, match="broken"):
        D.write_npy(bad, out, ["user"], "at", ["x"], existing="replace")
    assert sorted(os.listdir(out)) == before
    with pytest.raises(Exception, match="no place in a NPY file"):
        D.write_npy(series(sources), out, ["user"], "at", ["panel"], existing="replace")
    assert sorted(os.listdir(out)) == before
    fresh = f"{tmp_path}/fresh"
    with pytest.raises(Exception, match="broken"):
        D.write_npy(bad, fresh, ["user"], "at", ["x"])
    assert not os.path.exists(fresh) or os.listdir(fresh) == []


def test_a_series_in_several_tasks_is_refused(sources, tmp_path):
    out = f"{tmp_path}/out"
    spread = series(sources, 60).select("user", "x").repartition(4)
    with pytest.raises(Exception, match="come together|several tasks"):
        spread.write.format("npy").option("keys", "user").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    with pytest.raises(Exception, match="no keys"):
        spread.write.format("npy").option("keys", "none").mode("append").save(out)


def test_many_small_files_share_partitions(sources, tmp_path):
    out = f"{tmp_path}/out"
    rows = sources.range(3000).select((F.col("id") % 600).alias("user"), F.col("id").alias("at"), F.when(F.col("id") % 7 != 0, F.col("id") / 3).alias("x"))
    D.write_npy(rows, out, ["user"], "at", ["at", "x"])
    df = sources.read.format("npy").option("rows", 2).load(out)
    assert df.rdd.getNumPartitions() <= D.PIECES + 1 < 600
    assert sorted((r.idx, r.at) for r in df.collect()) == sorted((i // 600, i) for i in range(3000))
    assert sorted((r.idx, r.at) for r in df.where("idx >= 1 and idx < 4").collect()) == sorted((i // 600, i) for i in range(600, 2400))


def test_series_are_cut_across_batches():
    a = pa.table({"k": [1, 1, 2, 3, 3, None, None, 4], "v": [1, 2, 3, 4, None, 6, 7, 8], "x": [float(i) for i in range(8)]})
    for size in (1, 2, 3, 8):
        got = [(k, r["v"].tolist(), r["x"].tolist()) for k, r in D.cut_series(iter(a.to_batches(size)), ["k"], ["v", "x"])]
        assert [k for k, _, _ in got] == [(1,), (2,), (3,), (None,), (4,)]
        assert [x for _, _, x in got] == [[0.0, 1.0], [2.0], [3.0, 4.0], [5.0, 6.0], [7.0]]
        assert [v[0] for _, v, _ in got] == [1, 3, 4.0, 6, 8] and np.isnan(got[2][1][1])
