import json

import numpy as np
import pytest

from rasterloom import sinks
from rasterloom.errors import PlanError
from rasterloom.field import Noises, Terrain
from rasterloom.plans.blocks import block, export
from rasterloom.sources import files
from rasterloom.streaming import tiles

HEIGHT = Noises.fBm(frequency=0.05, octaves=2, amplitude=10)


def test_png_and_raw_tiles(spark, tmp_path):
    df = export(spark, {"h": HEIGHT, "n": Terrain.Normals(input=HEIGHT)}, (0, 0), (40, 24), 1.0, 16, 3)
    grey = {(r.tx, r.tz): r for r in sinks.tiles(df, ["h"], -5.0, 5.0, 16).collect()}
    v = block({"h": HEIGHT}, (0, 0), (40, 24), 1.0, 3)[0].astype(np.float32).astype(float)
    q = np.floor(np.clip((v + 5) / 10, 0, 1) * 65535 + 0.5).astype(np.uint16)
    for (tx, tz), r in grey.items():
        assert (sinks.read_png16(r.png) == q[tz * 16 : tz * 16 + 16, tx * 16 : tx * 16 + 16]).all()
    assert sum(r.clamped for r in grey.values()) == ((v < -5) | (v > 5)).sum() and len(grey) == 6
    assert sinks.read_png16(sinks.tiles(df, ["n_0", "n_1", "n_2"], 0, 0, 64).first().png).shape == (24, 40, 3)
    data = sinks.raw_blocks(df, ["h"], 64).first().data
    (tmp_path / "h.raw").write_bytes(bytes(data))
    back = files.read_raw(spark, str(tmp_path / "h.raw"), 40, 24).orderBy("z", "x").toPandas()["v"].to_numpy().reshape(24, 40)
    assert (back == v.astype(np.float32)).all()
    with pytest.raises(PlanError):
        sinks.tiles(df, ["h"] * 4, 0, 1, 16)


def test_sidecar(spark, tmp_path):
    df = export(spark, {"h": HEIGHT}, (0, 0), (16, 16), 1.0, 16, 3)
    job = {"seed": 3, "resolution": 1.0}
    values = sinks.sidecar(df, {"h": ["h"]}, job, {"h": (-1.0, 1.0)})
    sinks.write_sidecar(spark, values, str(tmp_path / "meta"))
    got = files.read_sidecar(spark, str(tmp_path / "meta"))
    assert got == json.loads(json.dumps(values)) and got["outputs"][0]["statistics"]["samples"] == 256 and got["params_hash"] == sinks.provenance(job)


def test_shapes_and_parameters(spark, tmp_path):
    feature = lambda kind, geometry, c: {"type": "Feature", "properties": {"kind": kind}, "geometry": {"type": geometry, "coordinates": c}}
    features = [feature("peak", "Point", [1, 2]), feature("river", "LineString", [[0, 0], [5, 6.5]]), feature("lake", "Polygon", [[[0, 0], [4, 0], [4, 4], [0, 0]]])]
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = files.read_shapes(spark, str(tmp_path / "s.geojson")).orderBy("shape", "point").collect()
    assert [(r.shape, r.kind, r.point, r.x, r.z) for r in rows] == [(0, "peak", 0, 1, 2), (1, "river", 0, 0, 0), (1, "river", 1, 5, 6.5), (2, "lake", 0, 0, 0), (2, "lake", 1, 4, 0), (2, "lake", 2, 4, 4)]
    assert files.parameters(["a=1.5", "b=x=y", "a=2"]) == {"a": 2.0, "b": "x=y"}
    with pytest.raises(PlanError):
        files.parameters(["nokey"])


def test_streamed_tiles_are_the_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    asked = [(0, tx, tz) for tx, tz in tiles.ring(10.0, 10.0, 16.0, 1)]
    for _ in range(2):  # the same requests twice
        spark.createDataFrame(asked, "level long, tx long, tz long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("level long, tx long, tz long").parquet(str(source))
    query = tiles.serve(stream, {"h": HEIGHT}, 16, 1.0, str(out), str(tmp_path / "state"), 3).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(out)).orderBy("sz", "sx").toPandas()
    want = export(spark, {"h": HEIGHT}, (-16, -16), (32, 32), 1.0, 64, 3).orderBy("sz", "sx").toPandas()
    assert asked[0] == (0, 0, 0) and len(got) == len(want) == 48 * 48 and got["h"].tolist() == want["h"].tolist()


def test_one_png_and_one_raw_file(spark, tmp_path):
    """Strips that the executors compress are one image and one stream, whatever the strips' height."""
    import struct
    import zlib

    from rasterloom import sinks
    from rasterloom.field import Noises, Terrain
    from rasterloom.plans.blocks import export

    h = Noises.fBm(frequency=0.05, octaves=2, amplitude=3)
    df = export(spark, {"h": h, "n": Terrain.Normals(input=h.gradient)}, (-3, 5), (40, 35), 1.0, 16, 4)
    rows = df.orderBy("sz", "sx").toPandas()
    v = rows["h"].to_numpy().astype(float).reshape(30, 43)
    expected = np.floor(np.clip((v + 1) / 2, 0, 1) * 65535 + 0.5).astype(np.uint16)
    files = []
    for strip in (7, 64):
        clamped = sinks.write_png(df, ["h"], -1.0, 1.0, str(tmp_path / f"{strip}.png"), strip)
        files.append((tmp_path / f"{strip}.png").read_bytes())
        assert (sinks.read_png16(files[-1]) == expected).all() and clamped == ((v < -1) | (v > 1)).sum() > 0
        at, data = 8, b""
        while at < len(files[-1]):
            n, kind = struct.unpack(">I4s", files[-1][at : at + 8])
            body = files[-1][at + 8 : at + 8 + n]
            assert struct.unpack(">I", files[-1][at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
            data += body if kind == b"IDAT" else b""
            at += 12 + n
        assert len(zlib.decompress(data)) == 30 * (1 + 2 * 43)  # the Adler sum is right too
    sinks.write_png(df, ["n_0", "n_1", "n_2"], 0, 1, str(tmp_path / "n.png"), 11)
    assert sinks.read_png16((tmp_path / "n.png").read_bytes()).shape == (30, 43, 3)
    sinks.write_raw(df, ["h", "n_1"], str(tmp_path / "h.raw"), 9)
    raw = np.frombuffer((tmp_path / "h.raw").read_bytes(), "<f4").reshape(30, 43, 2)
    assert np.allclose(raw[:, :, 0], v, atol=1e-6) and np.allclose(raw[:, :, 1].ravel(), rows["n_1"])


def test_png_filters_and_kinds():
    """Rows of every filter, 8 and 16 bits, grey and colours with and without alpha."""
    import struct
    import zlib

    from rasterloom import sinks

    rng = np.random.default_rng(2)

    def written(image, bits, colour):
        depth, width = image.shape[:2]
        raw = image.astype(">u2" if bits == 16 else "u1").reshape(depth, -1).view(np.uint8).reshape(depth, -1).astype(int)
        step = image.reshape(depth, width, -1).shape[2] * bits // 8
        rows = []
        for k in range(depth):
            kind, up = k % 5, raw[k - 1] if k else np.zeros(raw.shape[1], int)
            left = np.concatenate([np.zeros(step, int), raw[k][:-step]])
            corner = np.concatenate([np.zeros(step, int), up[:-step]])
            paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left.tolist(), up.tolist(), corner.tolist(), strict=True)]
            guess = (0 * up, left, up, (left + up) // 2, np.array(paeth))[kind]
            rows.append(bytes([kind]) + ((raw[k] - guess) % 256).astype(np.uint8).tobytes())
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, depth, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")

    for bits in (8, 16):
        for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
            image = rng.integers(0, 1 << bits, (11, 7, channels))
            got = sinks.read_png16(written(image, bits, colour))
            assert (got.reshape(11, 7, -1) == image[:, :, : 3 if channels > 2 else 1] * (257 if bits == 8 else 1)).all()
    assert sinks.luminance(np.full((2, 2, 3), 65535)).min() == pytest.approx(1)
    with pytest.raises(PlanError):
        sinks.read_png16(b"GIF89a")
