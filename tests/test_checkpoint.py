"""Checkpoints made byte by byte, in both layouts."""

import io
import pickle
import struct
import zipfile

import numpy as np
import pytest

from isoptic.operators import autoencoder
from isoptic.sources import checkpoint as C

TYPES = {"f8": "DoubleStorage", "f4": "FloatStorage", "i8": "LongStorage"}


def text(s):
    return b"X" + struct.pack("<I", len(s.encode())) + s.encode()


def number(n):
    return b"J" + struct.pack("<i", n)


def tensor(key, array, old=False, offset=0, total=None, strides=None):
    """Opcodes of one tensor: a call with a storage's reference, offset, shape and strides."""
    kind = TYPES[array.dtype.str[1:]]
    steps = [s // array.itemsize for s in array.strides] if strides is None else strides
    tuple_of = lambda xs: b"(" + b"".join(map(number, xs)) + b"t"
    storage = b"(" + text("storage") + b"ctorch\n" + kind.encode() + b"\n" + text(key) + text("cpu") + number(array.size if total is None else total) + (b"N" if old else b"") + b"tQ"
    return b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + number(offset) + tuple_of(array.shape) + tuple_of(steps) + b"\x89" + b"ccollections\nOrderedDict\n)R" + b"tR"


def mapping(items):
    return b"ccollections\nOrderedDict\n)R(" + b"".join(text(k) + v for k, v in items) + b"u"


def state(arrays, old=False, epoch=4):
    own = mapping((k, tensor(str(i), a, old)) for i, (k, a) in enumerate(arrays.items()))
    # A state carries version notes as attributes.
    noted = own + b"}" + text("_metadata") + b"ccollections\nOrderedDict\n)Rsb"
    return b"\x80\x02}(" + text("epoch") + number(epoch) + text("state_dict") + noted + b"u."


def package(arrays, raw=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m/data.pkl", state(arrays) if raw is None else raw)
        for i, a in enumerate(arrays.values()):
            z.writestr(f"m/data/{i}", a.tobytes())
        z.writestr("m/version", "3\n")
    return out.getvalue()


def stream(arrays, raw=None):
    head = [pickle.dumps(x, 2) for x in (C.MAGIC, C.PROTOCOL, {"little_endian": True, "protocol_version": 1001, "type_sizes": {"short": 2}})]
    keys = [str(i) for i in range(len(arrays))][::-1]  # storages come in an order of their own
    tail = b"".join(struct.pack("<q", a.size) + a.tobytes() for a in list(arrays.values())[::-1])
    return b"".join(head) + (state(arrays, old=True) if raw is None else raw) + pickle.dumps(keys, 2) + tail


@pytest.fixture
def arrays():
    r = np.random.default_rng(0)
    return {"module.conv1.weight": r.normal(size=(2, 1, 2, 5)).astype("<f4"), "module.fc.bias": r.normal(size=3), "steps": np.array([7, 8], "<i8"), "one": np.array(2.5)}


@pytest.mark.parametrize("layout", [package, stream])
def test_both_layouts_give_the_weights(arrays, layout):
    got, rest = C.read_state(layout(arrays))
    assert list(got) == ["conv1.weight", "fc.bias", "steps", "one"] and rest == {"epoch": 4}
    for (_, want), found in zip(arrays.items(), got.values(), strict=True):
        assert found.dtype == want.dtype and found.shape == want.shape and (found == want).all()


def test_a_bare_state_and_views_are_read():
    a = np.arange(12.0)
    raw = b"\x80\x02" + mapping([("t", tensor("0", a.reshape(3, 4).T[1:3], offset=1, total=12, strides=[1, 4]))]) + b"."
    got, rest = C.read_state(package({"x": a}, raw))
    assert (got["t"] == a.reshape(3, 4).T[1:3]).all() and rest == {}


CODE = [
    b"cos\nsystem\n(" + text("true") + b"tR",
    b"cbuiltins\neval\n(" + text("1") + b"tR",
    b"ctorch.serialization\nload\n)R",
    b"(S'true'\nios\nsystem\n",  # looks up and calls in one opcode
    b"cbuiltins\nobject\n)\x81",
    text("os") + text("system") + b"\x93" + b"(" + text("true") + b"tR",
]


@pytest.mark.parametrize("layout", [package, stream])
@pytest.mark.parametrize("code", CODE)
def test_any_other_name_or_opcode_is_refused(arrays, layout, code, monkeypatch):
    import os

    monkeypatch.setattr(os, "system", lambda *_: pytest.fail("ran"))
    with pytest.raises(C.RefusedCheckpoint):
        C.read_state(layout(arrays, b"\x80\x04" + b"}(" + text("a") + code + b"u."))


@pytest.mark.parametrize(
    "raw",
    [
        b"\x80\x02" + mapping([("t", tensor("0", np.zeros(9), total=9))]) + b".",  # a storage that is too short
        b"\x80\x02" + mapping([("t", tensor("0", np.zeros(2), offset=3, total=4))]) + b".",  # beyond its end
        b"\x80\x02" + mapping([("t", tensor("0", np.zeros(2), total=4, strides=[-1]))]) + b".",
        b"\x80\x02]" + b".",
        b"\x80\x02}.",
        b"\x80\x02}",
        b"\x80\x02\x85.",
        b"not a pickle",
    ],
)
def test_damaged_files_are_refused(raw):
    with pytest.raises(C.RefusedCheckpoint):
        C.read_state(package({"x": np.zeros(4)}, raw))


def test_neither_layout_and_a_missing_file_fail(spark, tmp_path, arrays):
    with pytest.raises(C.RefusedCheckpoint):
        C.read_state(pickle.dumps(1))
    with pytest.raises(C.RefusedCheckpoint):
        C.read_state(b"")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        C.load_state(spark, f"file://{tmp_path}/none.pth")
    (tmp_path / "model.pth.tar").write_bytes(stream(arrays))
    got, rest = C.load_state(spark, f"file://{tmp_path}/model.pth.tar")
    assert rest["epoch"] == 4 and (got["fc.bias"] == arrays["module.fc.bias"]).all()


def test_a_model_runs_with_loaded_weights():
    w = autoencoder.initial(length=8, latent=3, channels=(2, 4), hidden=(3, 2), outward=(3, 2, 5), seed=6)
    loaded, _ = C.read_state(package({f"module.{k}": v for k, v in w.items()}))
    x = np.random.default_rng(1).normal(size=(2, 2, 8))
    assert np.allclose(autoencoder.encode(x, loaded), autoencoder.encode(x, w))
