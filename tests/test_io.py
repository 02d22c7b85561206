"""The frame format, files, JPEG, contracts and manifests, streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.plans import runtime as rt
from rasterweave.plans.catalog import _GOOD, _variant
from rasterweave.plans.frame import Camera, Display, ImageFrame, Serial
from rasterweave.schema import DipError
from rasterweave.sources import framewire as fw
from rasterweave.sources import images, jpeg
from rasterweave.streaming import frames


def test_codec():
    image = fw.encode_frame("image", 2, 1, "RGB565", None, b"\x01\x02\x03\x04", swap=True)
    assert image[:3] == b"STW" and image[-4:] == b"\x02\x01\x04\x03"
    stream = image + fw.encode_frame("request", 3, 2, "MASK", None, b"") + fw.encode_frame("jpeg", None, None, None, None, b"abc") + fw.encode_frame("HISTOGRAM", None, None, None, 4, bytes(8))
    got = list(fw.decode_frames(stream, swap=True))
    assert [g[0] for g in got] == ["image", "request", "jpeg", "HISTOGRAM"]
    assert got[0][-1] == b"\x01\x02\x03\x04" and got[1][3] == "GRAYSCALE" and got[2][-1] == b"abc" and got[3][5] == 4
    for bad in (b"XX", stream[:-1], b"ST9"):
        with pytest.raises(DipError):
            list(fw.decode_frames(bad))
    with pytest.raises(DipError):
        fw.encode_frame("image", 2, 2, "GRAYSCALE", None, b"123")


def _dense(spark):
    return spark.createDataFrame([(i, 4, 2, "GRAYSCALE", 1, bytearray([i * 8 + k for k in range(8)])) for i in range(3)], "image_id long, width int, height int, format string, depth int, pixels binary")


def test_frames_through_spark(spark, tmp_path):
    wire = Serial(spark, str(tmp_path / "wire"))
    wire.send_images(_dense(spark).repartition(1))
    wire.send_array(spark.createDataFrame([(0, bytearray(8))], "seq long, payload binary"), "KERNEL", 4)
    wire.send_jpeg(jpeg.compress(_dense(spark), 90).limit(1))
    kinds = {r["kind"]: r["n"] for r in wire.capture().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"image": 3, "KERNEL": 1, "jpeg": 1}
    wire.capture().limit(1).write.format("framewire").option("path", str(tmp_path / "wire2")).mode("append").save()
    wire.capture().filter("kind = 'jpeg'").write.format("framewire").option("path", str(tmp_path / "wire2")).mode("overwrite").save()
    assert [r["kind"] for r in Serial(spark, str(tmp_path / "wire2")).capture().collect()] == ["jpeg"]


def test_frames_of_several_files_stay_apart(spark, tmp_path):
    dense = spark.createDataFrame([(i, 4, 2, "GRAYSCALE", 1, bytearray([(i * 8 + k) % 256 for k in range(8)])) for i in (-5, 0, 3, 2**40, 77)], "image_id long, width int, height int, format string, depth int, pixels binary")
    wire = Serial(spark, str(tmp_path / "wire"))
    wire.send_images(dense.filter("image_id < 3").repartition(1), named=True)
    wire.send_images(dense.filter("image_id >= 3").repartition(2, "image_id"), named=True)
    assert len(os.listdir(tmp_path / "wire")) > 1
    got = wire.named_images().select(*dense.columns)
    assert sorted((r["image_id"], bytes(r["pixels"])) for r in got.collect()) == sorted((r["image_id"], bytes(r["pixels"])) for r in dense.collect())
    # without names, frames are told apart by file and place
    plain = Serial(spark, str(tmp_path / "plain"))
    for i in (0, 3):
        plain.send_images(dense.filter(f"image_id = {i}").repartition(1))
    found = plain.capture().collect()
    assert sorted((r["seq"], r["frame_id"]) for r in found) == [(0, 0), (0, 1 << 32)] and len({r["file"] for r in found}) == 2
    pixels = frames.frame_pixels(plain.capture())
    assert pixels.count() == 16 and pixels.select("image_id", "y", "x").distinct().count() == 16


def test_numbers_on_the_wire(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, -1, 258, 2**62, -(2**63))], "n long")
    out = df.select("n", fw.id_payload(F.col("n")).alias("p")).withColumn("back", fw.payload_id(F.col("p"))).collect()
    assert all(r["back"] == r["n"] and bytes(r["p"]) == r["n"].to_bytes(8, "little", signed=True) for r in out)


def test_stream_of_frames(spark, tmp_path):
    wire = Serial(spark, str(tmp_path / "in"))
    wire.send_images(_dense(spark).repartition(1))
    seen = []
    q = frames.process(frames.capture(spark, str(tmp_path / "in")), frames.frame_pixels, lambda df, n: seen.append(df.agg(F.sum("v")).first()[0]), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert seen == [sum(range(24))]


def test_files(spark, tmp_path):
    f = ImageFrame.of_images(_dense(spark), 4, 2, "GRAYSCALE")
    assert Display(str(tmp_path / "out")).show(f) == 3
    rgb = f.convert("RGB888")
    assert Display(str(tmp_path / "out")).show(rgb.convert("RGB565")) == 3
    assert sorted(os.listdir(tmp_path / "out")) == ["0.pgm", "0.ppm", "1.pgm", "1.ppm", "2.pgm", "2.ppm"]
    camera = Camera(spark, str(tmp_path / "out"))
    with pytest.raises(DipError):
        camera.capture()
    back = camera.init("QVGA", "GRAYSCALE").capture()
    assert back.filter("format = 'GRAYSCALE'").count() == 3 and sorted(bytes(r["pixels"])[0] for r in back.filter("format = 'GRAYSCALE'").collect()) == [0, 8, 16]
    assert {(r["width"], r["height"], len(r["pixels"])) for r in back.collect()} == {(320, 240, 320 * 240), (320, 240, 320 * 240 * 3)}
    (tmp_path / "out" / "bad.pgm").write_bytes(b"P5\n4 x\n255\n")
    (tmp_path / "out" / "short.pgm").write_bytes(b"P5 # a comment\n4 4\n255\n123")
    every = images.read_pnm(spark, str(tmp_path / "out"))
    assert {r["status"]: r["n"] for r in every.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"OK": 6, "INVALID_FORMAT": 1, "INVALID_SIZE": 1}
    assert every.select("image_id").distinct().count() == 8 and camera.capture().count() == 6
    assert camera.setRes("QQVGA").capture().select("width", "height").distinct().collect() == [(160, 120)]
    camera.stop()
    for act in (camera.capture, lambda: camera.set_res("VGA")):
        with pytest.raises(DipError):
            act()
    screen = Display(str(tmp_path / "screen"))
    assert screen.clear(spark, "RED") == 1 and os.listdir(tmp_path / "screen") == ["0.ppm"]
    assert (tmp_path / "screen" / "0.ppm").read_bytes().startswith(b"P6\n480 272\n255\n\xf8\x00\x00") or (tmp_path / "screen" / "0.ppm").read_bytes().startswith(b"P6\n480 272\n255\n\xff\x00\x00")
    screen.deinit()
    with pytest.raises(DipError):
        screen.show(f)
    assert screen.init().show(f) == 3
    with pytest.raises(DipError):
        camera.init("CIF", "GRAYSCALE")
    assert {r["v"] for r in images.clear(f.px, "TEAL").collect()} == {0x0410}
    with pytest.raises(DipError):
        Display(str(tmp_path)).show(rgb.convert("HSI"))


def _decoded(spark, raw):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(raw)))
    w, h = image.getWidth(), image.getHeight()
    raster = image.getRaster()
    if raster.getNumBands() == 1:
        return np.array([[raster.getSample(x, y, 0) for x in range(w)] for y in range(h)])
    return np.array([[[(image.getRGB(x, y) >> s) & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])


def test_jpeg_is_read_by_another_decoder(spark):
    y, x = np.mgrid[:20, :13]
    gray = (y * 9 + x * 5).clip(0, 255).astype(np.uint8)
    assert np.abs(_decoded(spark, jpeg.encode(gray.tobytes(), 13, 20, "GRAYSCALE", 95)).astype(int) - gray).max() <= 6
    rgb = np.stack([gray, 255 - gray, gray // 2], 2)
    assert np.abs(_decoded(spark, jpeg.encode(rgb.tobytes(), 13, 20, "RGB888", 100)).astype(int) - rgb).mean() < 2
    noise = np.random.default_rng(0).integers(0, 256, (16, 16), np.uint8)
    sizes = [len(jpeg.encode(noise.tobytes(), 16, 16, "GRAYSCALE", q)) for q in (1, 50, 100)]
    assert sizes == sorted(sizes) and np.abs(_decoded(spark, jpeg.encode(noise.tobytes(), 16, 16, "GRAYSCALE", 500)).astype(int) - noise).max() <= 3
    assert [r["size"] for r in jpeg.compress(_dense(spark), 50, capacity=10).collect()] == [-1] * 3
    with pytest.raises(DipError):
        jpeg.encode(b"123", 2, 2, "GRAYSCALE")
    # our own decoder sees what the other one sees, within the bound of the quantisation
    for quality in (5, 50, 95):
        raw = jpeg.encode(noise.tobytes(), 16, 16, "GRAYSCALE", quality)
        assert np.abs(jpeg.decode(raw)[0].clip(0, 255) - _decoded(spark, raw)).max() <= 1.5
        assert np.sqrt(((jpeg.decode(raw)[0] - noise) ** 2).mean()) <= jpeg.error_bound(quality)
    y, cb, cr = jpeg.decode(jpeg.encode(rgb.tobytes(), 13, 20, "RGB888", 100))
    assert np.abs(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], 2) - rgb).mean() < 2
    for bad in (b"", b"\xff\xd8\xff\xd9x"):
        with pytest.raises(DipError):
            jpeg.decode(bad)


IN = rt.Contract(12, 2, 2, 3, flags=frozenset({"NPU_READ"}))
OUT = rt.Contract(1, 1, 1, 1, flags=frozenset({"NPU_WRITE"}))


def test_runtime_contracts(spark):
    run = rt.Runtime()
    with pytest.raises(DipError) as e:
        run.infer(bytes(12), IN, OUT)
    assert e.value.code == -8
    run.init(lambda raw: raw[:1], IN, OUT)
    out, took = run.infer(b"\x07" + bytes(11), IN, OUT)
    assert out == b"\x07" and took >= 0 and run.events == "CTRtI"
    from dataclasses import replace

    for tensor, output, data, status in (
        (replace(IN, width=3), OUT, bytes(12), "INVALID_SIZE"),
        (replace(IN, type="i8"), OUT, bytes(12), "INVALID_FORMAT"),
        (IN, replace(OUT, flags=frozenset({"READ_ONLY"})), bytes(12), "INVALID_ARG"),
        (IN, OUT, None, "NULL_PTR"),
    ):
        with pytest.raises(DipError) as e:
            run.infer(data, tensor, output)
        assert e.value.status == status
    for bad, status in ((replace(IN, width=0), "INVALID_SIZE"), (replace(IN, bytes=11), "INVALID_SIZE"), (replace(IN, layout="x"), "NOT_SUPPORTED")):
        with pytest.raises(DipError) as e:
            rt.Runtime().init(lambda raw: raw, bad, OUT)
        assert e.value.status == status
    with pytest.raises(DipError):
        rt.Runtime().init(None, IN, OUT)
    rows = spark.createDataFrame([(1, bytearray(b"\x09" * 12)), (2, bytearray(b"\x01")), (3, None)], "tensor_id long, payload binary")
    got = {r["tensor_id"]: (r["status"], r["payload"] and bytes(r["payload"])) for r in run.run(rows).collect()}
    assert got == {1: (0, b"\x09"), 2: (-5, None), 3: (-2, None)}


CASES = [
    (("model", "source_sha256"), "ab"), (("io", "input", "type"), "u16"), (("io", "input", "height"), 0), (("memory", "weights_bytes"), 0), (("io", "input", "width"), 65536), (("memory", "weights_bytes"), 1 << 32),
    (("memory", "activations_bytes"), 1 << 32), (("io", "input", "zero_point"), 1 << 31), (("io", "output", "zero_point"), -(1 << 31) - 1), (("legal", "license"), "a\tb"), (("legal", "license"), ""), (("extra",), {}),
    (("deployment", "inference_location"), "host"),
]


def test_manifests(spark):
    texts = [json.dumps(_GOOD), _variant("io", "input", "width", value=65535), _variant("memory", "weights_bytes", value=(1 << 32) - 1), _variant("io", "input", "zero_point", value=-(1 << 31))]
    bad = [_variant(*path, value=value) for path, value in CASES]
    large = json.loads(json.dumps(_GOOD))
    large["io"]["input"] |= {"width": 65535, "height": 65535, "channels": 2}
    bad.append(json.dumps(large))
    assert [bool(rt.manifest_text_faults(t)) for t in texts + bad] == [False] * len(texts) + [True] * len(bad)
    assert rt.manifest_text_faults(_variant("io", "input", "scale", value="1")) and rt.manifest_text_faults(_variant("io", "input", "width", value=True)) and rt.manifest_text_faults("{")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad + ["{", None])], "i int, t string")
    got = [r["ok"] for r in df.select("i", rt.manifest_valid(F.col("t")).alias("ok")).orderBy("i").collect()]
    assert got == [True] * len(texts) + [False] * (len(bad) + 2)
    assert spark.range(1).select(rt.identifier(F.lit("a-b c1"))).first()[0] == "a_b_c1"


def test_memory_contracts():
    assert rt.cache_range(0x1003, 61) == (0x1000, 64) and rt.cache_range(0x1020, 32) == (0x1020, 32)
    for bad in ((None, 4), (4, 0), ((1 << 64) - 1, 8)):
        with pytest.raises(DipError):
            rt.cache_range(*bad)
    assert rt.allocation(8, 32, "DMA")[0] == 8
    for bad in ((0, 32, "DMA"), (8, 3, "DMA"), (8, 32, "EXTERNAL_FLASH")):
        with pytest.raises(DipError):
            rt.allocation(*bad)
    rt.tic()
    assert rt.toc() >= 0 and rt.vendor_backend(lambda: True, bytes)(b"a") == b"a"
    with pytest.raises(DipError):
        rt.vendor_backend(lambda: False, bytes)
