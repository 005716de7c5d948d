import numpy as np
import pytest
from memlake.operators import formats, models, rank
from pyspark.sql import functions as F

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("half", [False, True])
def test_tensor_file_round_trip(half):
    t = {"a": RNG.normal(size=(3, 5)).astype(np.float32), "b": np.zeros((0, 2), np.float32), "c": np.float32(RNG.normal(size=4))}
    got = formats.from_safetensors(formats.to_safetensors(t, half))
    assert list(got) == list(t) and all(np.allclose(got[k], t[k], atol=1e-2 if half else 0) and got[k].shape == t[k].shape for k in t)
    with pytest.raises(formats.FormatError):
        formats.from_safetensors(b"\x01")


def test_tensor_files_as_a_source(spark, tmp_path):
    (tmp_path / "m.safetensors").write_bytes(formats.to_safetensors({"w": np.arange(6, dtype=np.float32).reshape(2, 3)}))
    got = formats.read_tensors(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r["tensor"], r["row"], r["values"]) for r in got) == [("w", 0, [0, 1, 2]), ("w", 1, [3, 4, 5])]


def test_deltas():
    base = RNG.normal(size=(10, 4)).astype(np.float32)
    now = base.copy()
    now[[2, 7]] += 0.5
    data = formats.delta_bytes(base, now, 1e-6)
    assert (formats.apply_delta(base, data) == now).all() and (formats.apply_delta(base, formats.delta_bytes(base, base)) == base).all()
    with pytest.raises(formats.FormatError):
        formats.apply_delta(base, data[:20] + b"\x00" + data[21:])
    with pytest.raises(formats.FormatError):
        formats.apply_delta(base[:, :3], data)
    with pytest.raises(formats.FormatError):
        formats.delta_bytes(base, now[:5])
    assert formats.unsealed(b"plain") == b"plain"


def test_packages():
    data = formats.pack_parts({"v": 1}, {"x": b"abc", "y": b""})
    assert formats.unpack_parts(data) == ({"v": 1}, {"x": b"abc", "y": b""})
    with pytest.raises(formats.FormatError):
        formats.unpack_parts(data[:-1] + b"z")


def test_mixture_gates_and_adapter(spark):
    x = RNG.normal(size=(5, 3))
    router, up, down = RNG.normal(size=(4, 3)), RNG.normal(size=(4, 2, 3)), RNG.normal(size=(4, 3, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", models.mixture(F.col("v"), router, up, down, (up[0], down[0])).alias("y")).collect()}
    for i, r in enumerate(x):
        logits = router @ r
        best = np.argsort(-logits, kind="stable")[:2]
        gate = np.exp(logits[best]) / np.exp(logits[best]).sum()
        want = down[0] @ np.maximum(up[0] @ r, 0) + sum(g * (down[e] @ np.maximum(up[e] @ r, 0)) for g, e in zip(gate, best, strict=True))
        assert np.allclose(got[i], want)


def test_approximate_search_finds_eight_of_ten(spark):
    x = RNG.normal(size=(400, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id < 10").select(F.col("id").alias("qid"), "vec")
    pairs = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    exact = pairs(rank.dense_top(v, q, 10))
    assert len(pairs(rank.ann_top(v, q, 10)) & exact) >= 80
    assert pairs(rank.ann_top(v.where("id < 200"), q, 10)) == pairs(rank.dense_top(v.where("id < 200"), q, 10))
