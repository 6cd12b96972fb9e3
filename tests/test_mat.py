"""MAT files written here by the format's rules."""

import struct
import zlib

import numpy as np
import pytest

from isoptic.sources import listed, mat

KINDS = {"f8": (9, 6), "f4": (7, 7), "i4": (5, 12), "u2": (4, 11)}


def element(kind, raw, order):
    if 0 < len(raw) <= 4 and kind != 14:
        return struct.pack(f"{order}I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def array(name, x, order):
    def head(kind, shape):
        return element(6, struct.pack(f"{order}II", kind, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)

    if isinstance(x, str):
        body = head(4, (1, len(x))) + element(17, np.array([ord(c) for c in x], f"{order}u2").tobytes(), order)
    elif isinstance(x, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in x)
        body = head(2, (1, 1)) + element(5, struct.pack(f"{order}i", 32), order) + element(1, names, order) + b"".join(array("", v, order) for v in x.values())
    elif isinstance(x, list):
        cells = [c for col in zip(*x) for c in col]
        body = head(1, (len(x), len(x[0]))) + b"".join(array("", c, order) for c in cells)
    else:
        x = np.atleast_2d(x)
        kind, cls = KINDS[x.dtype.str[1:]]
        body = head(cls, x.shape) + element(kind, x.astype(x.dtype.newbyteorder(order)).tobytes(order="F"), order)
    return element(14, body, order)


def mat_file(variables, order="<", packed=False):
    head = b"MATLAB 5.0 MAT-file, Platform: PCWIN64, Created on: Mon Jul 15 10:11:12 2024".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    out = head
    for k, v in variables.items():
        e = array(k, v, order)
        if packed:
            z = zlib.compress(e)
            e = struct.pack(f"{order}II", 15, len(z)) + z
        out += e
    return out


@pytest.mark.parametrize(("order", "packed"), [("<", False), (">", False), ("<", True)])
def test_values(order, packed):
    x = np.arange(6, dtype=np.float64).reshape(2, 3)
    got = mat.load(mat_file({"x": x, "n": np.array([[7]], np.int32), "s": "ü text", "d": {"a": {"b": x.T.astype("f4")}, "c": "r"}, "m": [[np.array([1.0]), "one"], [np.array([2.0]), "two"]]}, order, packed))
    np.testing.assert_array_equal(got["x"], x)
    np.testing.assert_array_equal(got["d"]["a"]["b"], x.T)
    assert got["n"] == 7 and got["s"] == "ü text" and got["d"]["c"] == "r" and got["m"].tolist() == [[1.0, "one"], [2.0, "two"]]
    with pytest.raises(ValueError, match="not a MAT file"):
        mat.load(b"x" * 200)


def test_recordings(spark, tmp_path):
    n = 5
    left = np.linspace(0, 1, 2 * n).reshape(2, n)
    left[0, 1] = np.nan
    eye = lambda a: {"gazePoint": {"onDisplayArea": a}}
    data = {"gaze": {"left": eye(left), "right": eye(1 - left), "systemTimeStamp": np.arange(n) * 1000.0}}
    (tmp_path / "run_1.mat").write_bytes(mat_file({"data": data, "messages": [[np.array([1.0]), "slide 1"], [np.array([2.5]), "slide 2"]], "Dom_Eye": "r", "task_data": {"img_test_A1": np.array([1.0]), "strikes_img_test_A1": np.array([41.0]), "img_test__b": np.array([1.0]), "strikes_img_test_b": np.array([7.0])}}, packed=True))
    files = listed(spark, str(tmp_path), "*.mat", "run", contents=True)
    rows = mat.gaze(files).orderBy("idx").collect()
    assert [r.t_us for r in rows] == [0, 1000, 2000, 3000, 4000] and rows[1].left_x is None and rows[2].right_y == 1 - left[1, 2]
    assert [(m.seq, m.t_us, m.text) for m in mat.messages(files).orderBy("seq").collect()] == [(0, 1, "slide 1"), (1, 2.5, "slide 2")]
    about = mat.recordings(files).first()
    assert about.dom_eye == "r" and "Jul 15" in about.header
    assert [tuple(r)[1:] for r in mat.panel_scores(files, "SDMT").orderBy("ord").collect()] == [(1, "a1", 41.0), (2, "b", 7.0)]
    assert [tuple(r)[1:] for r in mat.panel_scores(files, "KD").orderBy("ord").collect()] == [(1, "1", 0.0), (2, "2", 0.0), (3, "3", 0.0)]
