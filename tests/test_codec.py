from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.__main__ import main
from cadenza.operators import codec, imu
from cadenza.plans.containers import _video
from cadenza.sources import container, export, handles


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-10, ((a.astype(float) - b) ** 2).mean()))


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 600])
def test_levels_round_trip(n):
    rng = np.random.default_rng(n)
    for flat in (np.zeros(n, np.int16), rng.integers(-300, 300, n).astype(np.int16), (rng.integers(-9, 9, n) * (rng.random(n) < 0.05)).astype(np.int16)):
        raw = codec.pack_levels(flat)
        assert np.array_equal(codec.unpack_levels(raw, n), flat) and len(raw) % 3 == 0
        runs = np.frombuffer(raw, codec._PAIR)
        assert all(r == 1 for v, r in runs.tolist() if v)


@pytest.mark.parametrize(("shape", "boxed"), [((64, 64), True), ((100, 60), False), ((13, 9), True)])
def test_frame_round_trip(shape, boxed):
    residual = np.zeros((*shape, 3), np.int16)
    assert np.abs(codec.decode_frame(codec.encode_frame(residual, None, 50, boxed), boxed)).max() == 0
    residual[4:9, 3:8] = 80
    mask = np.zeros(shape, bool)
    mask[4:9, 3:8] = True
    got = codec.decode_frame(codec.encode_frame(residual, mask, 80, boxed), boxed)
    assert got.shape == residual.shape and got[4:9, 3:8].mean() > 60 and psnr(residual, got) > 30


def test_videos_round_trip(spark, tmp_path):
    of = _video(spark, 60, 32).unionByName(_video(spark, 40, 32).withColumn("video", F.lit(1)))
    coded = codec.encode(of, quality=75, warmup=60, shortest=10, width=2, valley=1.2)
    container.write(coded, f"file://{tmp_path}/v")
    raw = {(r.video, r.frame_idx): np.frombuffer(r.pixels, np.uint8) for r in of.collect()}
    got = {(r.video, r.frame_idx): np.frombuffer(r.pixels, np.uint8) for r in codec.decode(coded).collect()}
    assert set(got) == set(raw)
    assert min(psnr(raw[k], got[k]) for k in raw) > 25 and np.mean([psnr(raw[k], got[k]) for k in raw]) > 30
    sizes = [len(r.content) for r in container.files(spark, f"file://{tmp_path}/v").collect()]
    assert len(sizes) == 2 and sum(sizes) * 5 < 100 * 32 * 32 * 3
    meta = container.metadata(container.chunks(container.files(spark, f"file://{tmp_path}/v"))).collect()
    assert sorted(r.meta.total_frames for r in meta) == [40, 60] and all(r.meta.n_cycles == len(r.meta.cycle_map) for r in meta)


@pytest.mark.parametrize("options", [{"temporal": False}, {"boxed": False}, {"skip": 5000.0}, {"codebook": True}])
def test_other_modes_round_trip(spark, options):
    of = _video(spark, 60, 32)
    raw = {r.frame_idx: np.frombuffer(r.pixels, np.uint8) for r in of.collect()}
    if "codebook" in options:
        rng = np.random.default_rng(0)
        options = {"codebook": np.concatenate([np.zeros((1, 64)), rng.normal(0, 3, (15, 64)).round()])}
    coded = codec.encode(of, quality=75, warmup=60, shortest=10, width=2, valley=1.2, **options)
    got = {r.frame_idx: np.frombuffer(r.pixels, np.uint8) for r in codec.decode(coded).collect()}
    kinds = {c[1] for c in container.parse_chunks(bytes(coded.first().content))}
    assert (7 in kinds) == ("codebook" in options) and (5 in kinds or "skip" not in options)
    assert np.mean([psnr(raw[k], got[k]) for k in got]) > (10 if "codebook" in options else 25)
    assert set(got) == set(raw) or "skip" in options


def test_codebook_and_coded_frames():
    rng = np.random.default_rng(1)
    book = np.concatenate([np.zeros((1, 64)), rng.integers(-20, 20, (30, 64))])
    assert np.array_equal(codec.unpack_codebook(codec.pack_codebook(book)), book)
    # a residual that is made of codes comes back as good as the transform lets it
    levels = [book[rng.integers(0, 31, 4)] for _ in range(3)]
    residual = codec._restored(levels, 50, 16, 16)
    mask = np.ones((16, 16), bool)
    for boxed in (True, False):
        got = codec.decode_frame_vq(codec.encode_frame_vq(residual, mask, 50, book, boxed), book, boxed)
        assert got.shape == (16, 16, 3) and np.abs(got - residual).max() <= 1


def test_orientations_are_stored_and_frames_stabilised(spark):
    of = _video(spark, 60, 32)
    turns = of.select("video", "frame_idx", imu.quaternion(F.lit(0.0), F.lit(0.0), F.sin(F.col("frame_idx") * 0.002), F.cos(F.col("frame_idx") * 0.002)).alias("q")).where("frame_idx <> 7")
    limits = {"warmup": 60, "shortest": 10, "width": 2, "valley": 1.2}
    coded = codec.encode(of, quality=75, orientation=turns, **limits)
    content = bytes(coded.first().content)
    got = codec.orientations(content)
    want = np.array([[0, 0, np.sin(k * 0.002), np.cos(k * 0.002)] for k in range(60) if k != 7])
    assert got.shape == (59, 4) and np.abs(got - want).max() < 1e-3
    rows = container.orientations(container.chunks(coded.select(F.lit("v").alias("path"), "content"))).orderBy("k").collect()
    assert np.allclose([[r.x, r.y, r.z, r.w] for r in rows], got)
    still = {r.frame_idx: r.pixels for r in codec.stabilised(of, turns).collect()}
    assert bytes(still[0]) == bytes(of.where("frame_idx = 0").first().pixels) and bytes(still[7]) == bytes(of.where("frame_idx = 7").first().pixels)
    assert codec.orientations(bytes(codec.encode(of, quality=75, **limits).first().content)) is None


def test_handles_push_and_pull(spark):
    of = [np.frombuffer(r.pixels, np.uint8).reshape(32, 32, 3) for r in _video(spark, 60, 32).orderBy("frame_idx").collect()]
    recorder = handles.Recorder(spark, 32, 32, fps=25.0, quality=75, warmup=60, shortest=10, width=2, valley=1.2)
    with pytest.raises(ValueError, match="no frame"):
        recorder.encode()
    for f in of:
        recorder.push_frame(f)
    for _ in range(400):
        recorder.push_gyro(np.zeros(3))
    with pytest.raises(ValueError, match="shape"):
        recorder.push_frame(of[0][:5])
    player = handles.Player(recorder.encode())
    assert (len(player), player.fps, player.width, player.height, recorder.frame_count) == (60, 25.0, 32, 32, 60)
    assert np.allclose(player.orientations(), [[0, 0, 0, 1]] * 60)
    pulled = []
    while (f := player.next_frame()) is not None:
        pulled.append(f)
    assert len(pulled) == 60 and np.array_equal(player[-1], pulled[-1]) and np.mean([psnr(a, b) for a, b in zip(of, pulled)]) > 30
    assert np.array_equal(np.concatenate(list(player.iter_cycles())), np.stack(pulled))
    with pytest.raises(IndexError):
        player[60]


def test_export_save_and_command_line(spark, tmp_path, capsys):
    coded = codec.encode(_video(spark, 30, 16).unionByName(_video(spark, 12, 16).withColumn("video", F.lit(1))), quality=75, warmup=30, shortest=10, width=2, valley=1.2)
    assert export.save(coded, f"{tmp_path}/in") == 2
    found = container.discover(spark, f"file://{tmp_path}/in")
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["0.dfy", "1.dfy"]
    with pytest.raises(ValueError, match="suffix"):
        container.discover(spark, f"file://{tmp_path}/in/a.txt")
    with pytest.raises(FileNotFoundError):
        container.discover(spark, f"file://{tmp_path}/in", ".xyz")
    one = codec.decode(container.files(spark, f"file://{tmp_path}/in/0.dfy"), key="path")
    calls = []
    assert export.export(one, f"{tmp_path}/out", on_progress=lambda k, n: calls.append((k, n))) == 30
    assert calls[0] == (0, 30) and calls[-1] == (29, 30) and len(calls) == 30
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names[0] == "frame_00.png" and names[-1] == "frame_29.png"
    raw = (tmp_path / "out" / "frame_03.png").read_bytes()
    body = zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16])
    frame = np.frombuffer(one.where("frame_idx = 3").first().pixels, np.uint8).reshape(16, 16, 3)
    assert np.array_equal(np.frombuffer(body, np.uint8).reshape(16, 49)[:, 1:].reshape(16, 16, 3), frame[:, :, ::-1])
    with pytest.raises(ValueError, match="aren't offered"):
        export.export(one, f"{tmp_path}/out.mp4")
    assert [export.format_of(p) for p in ("a.MOV", "a/b.JPG", "x.png", "dir", "a.b/c", "z.webm")] == ["mp4", "jpeg", "png", "png", "png", "mp4"]
    main(["info", f"file://{tmp_path}/in"])
    said = capsys.readouterr().out
    assert "frames     30" in said and "frames     12" in said and "resolution 16 x 16" in said
    main(["export", f"file://{tmp_path}/in", f"{tmp_path}/all"])
    assert len(list((tmp_path / "all").rglob("*.png"))) == 42
