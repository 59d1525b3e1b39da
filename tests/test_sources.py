from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import container, scenes
from cadenza.sources import frames as io


def content(*chunks, tail=b""):
    return container.pack_header(100, 30.0, 64, 48, 3) + b"".join(container.pack_chunk(*c) for c in chunks) + tail


def test_header_without_python(spark):
    df = spark.createDataFrame([("a", bytearray(content()))], "path string, content binary")
    h = container.headers(df).first().header
    assert tuple(h) == (100, 30.0, 64, 48, 3)
    bad = spark.createDataFrame([("a", bytearray(b"nope" + bytes(20)))], "path string, content binary")
    with pytest.raises(Exception, match="magic"):
        container.headers(bad).collect()


def test_chunks_round_trip_on_disk(spark, tmp_path):
    header = F.struct(F.lit(100).cast("long").alias("frames"), F.lit(25.0).alias("fps"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.lit(1).alias("flags"))
    chunks = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("compress"), F.lit(bytearray(p)).alias("payload")) for k, c, p in ((1, True, b"\x00\xff\n" * 9), (2, False, bytes(range(256))), (7, True, b""))))
    rows = spark.range(3).select(F.col("id").alias("video"), header.alias("header"), F.lit('{"cycle_map":[[0,0],[1,0]]}').alias("metadata"), chunks.alias("chunks"))
    path = f"file://{tmp_path}/out"
    container.write(container.assemble(rows), path)
    of = container.files(spark, path)
    assert of.count() == 3
    got = container.chunks(of)
    for r in got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "compressed", "payload"))).alias("c")).collect():
        assert [(x.kind, x.compressed, bytes(x.payload)) for x in r.c] == [(1, True, b"\x00\xff\n" * 9), (2, False, bytes(range(256))), (7, True, b""), (6, False, b'{"cycle_map":[[0,0],[1,0]]}\n')]
    sizes = {r.path: r.bytes for r in container.bytes_written(got).collect()}
    assert all(len(r.content) == sizes[r.path] for r in of.collect())
    assert [(r.kind, r.idx) for r in container.playback(container.metadata(got)).where("pos < 2").orderBy("path", "pos").collect()] == [(0, 0), (1, 0)] * 3


def test_strict_and_lenient_reading():
    whole = content((1, b"abc"), (9, b"new"), (2, b"def", False), tail=b"\x02\x00\x00\x00\x00\x09xy")
    assert [c[1] for c in container.parse_chunks(whole, lenient=True)] == [1, 2]
    with pytest.raises(ValueError, match="unknown"):
        list(container.parse_chunks(whole))
    with pytest.raises(ValueError, match="truncated"):
        list(container.parse_chunks(content(tail=b"\x01\x00")))


def test_synthetic_access_and_clips(spark):
    of = io.synthetic(spark, 20).cache()
    assert of.count() == 20 and len(of.first().px) == 256
    assert io.at_index(of, 0, -1).first().frame_idx == 19 and io.at_index(of, 0, 0).first().frame_idx == 0
    for index in (20, -21):
        with pytest.raises(IndexError):
            io.at_index(of, 0, index)
    assert [r.frame_idx for r in io.between(of, 3, 10, 3).orderBy("frame_idx").collect()] == [3, 6, 9]
    index = io.clip_index(spark.createDataFrame([(0, 20), (1, 3)], "video int, n long"), 8, 5)
    assert [(r.video, r.start) for r in index.orderBy("start").collect()] == [(0, 0), (0, 5), (0, 10)]
    clips = io.clips(of.withColumn("k", F.col("frame_idx")), index, 8).collect()
    assert len(clips) == 3 and all(len(c.px) == 8 for c in clips)


def test_png_names_and_signature(spark):
    row = io.png(io.synthetic(spark, 1), 16, 16).first()
    assert row.name == "frame_000000.png" and bytes(row.content[:8]) == b"\x89PNG\r\n\x1a\n"


def test_scenes_rest_and_repeat(spark):
    of = [np.frombuffer(r.pixels, np.uint8).reshape(54, 96, 3).astype(int) for r in scenes.bench(spark, 40, 2, 54, 96, radius=6).orderBy("frame_idx").collect()]
    change = [np.abs(a - b).mean() for a, b in zip(of, of[1:])]
    assert len(of) == 40 and change[0] == change[1] == 0 and max(change[20:22]) == 0 and min(change[6:18]) > 0.5
    assert (of[0] == of[20]).all() and (of[0][27, 24] == scenes.TOOL).all()
    view = [np.frombuffer(r.pixels, np.uint8).reshape(90, 160, 3).astype(int) for r in scenes.point_of_view(spark, 2, 20, 160, 90).orderBy("frame_idx").collect()]
    skin = [(np.abs(f - np.array(scenes.SKIN)).max(axis=2) < 25).sum() for f in view]
    assert len(view) == 40 and max(skin[0], skin[1], skin[19]) < 40 < min(skin[8], skin[12]) and abs(skin[8] - skin[28]) < 0.3 * skin[8]
