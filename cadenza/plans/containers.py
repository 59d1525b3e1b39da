"""Queries of sources and sinks: containers, access by index, clips, export."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import codec, rle
from cadenza.plans.coding import _LEVELS, _levels
from cadenza.plans.inputs import FRAMES, NUMBERED, frames, numbered
from cadenza.plans.registry import query
from cadenza.session import ship
from cadenza.sources import container
from cadenza.sources import frames as io
from cadenza.streaming.online import folder

_MAP = [[0, 0], [1, 0], [1, 1], [0, 1]]


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's coded frames as a container file, written and found again: (path, content)."""
    rows = _levels(spark, sf_dir).withColumn("payload", io.pack_pairs(rle.encode(F.col("levels"))))
    chunk = F.struct(F.lit(2).alias("kind"), (F.col("frame_idx") % 2 == 0).alias("compress"), F.col("payload").alias("payload"), F.col("frame_idx").alias("at"))
    grouped = rows.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame_idx", chunk.alias("c")))).alias("r"), F.count("*").alias("n"))
    header = F.struct(F.col("n").alias("frames"), F.lit(30.0).alias("fps"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(0).alias("flags"))
    record = {"fps": 30.0, "n_cycles": 4, "n_canonicals": 2, "quality": 50, "use_temporal": True, "use_bbox": False, "cycle_map": _MAP}
    meta = F.concat(F.lit('{"video":'), F.col("video").cast("string"), F.lit(',"total_frames":'), F.col("n").cast("string"), F.lit("," + container.to_json(record)[1:]))
    path = folder(spark)
    container.write(container.assemble(grouped.select("video", header.alias("header"), meta.alias("metadata"), F.col("r.c").alias("chunks"))), path)
    return container.files(spark, path)


def _named(stored: DataFrame) -> DataFrame:
    """Chunks with the video that their file's metadata names."""
    video = F.get_json_object(F.col("payload").cast("string"), "$.video").cast("int")
    return stored.join(stored.where(F.col("kind") == container.METADATA).select("path", video.alias("video")), "path")


@query(f"WITH {FRAMES} SELECT count(*) AS frames, CAST(30 AS DOUBLE) AS fps, 8 AS width, 8 AS height, 0 AS flags FROM frames GROUP BY video")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.headers(_stored(spark, sf_dir)).select("header.*")


@query(f"""WITH {_LEVELS}, marked AS (SELECT *, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video, frame_idx ORDER BY k) AS island FROM levels),
sizes AS (SELECT video, frame_idx, count(*) FILTER (WHERE v <> 0) + count(DISTINCT island) FILTER (WHERE v = 0) AS n FROM marked GROUP BY video, frame_idx)
SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS INTEGER) AS pos, 2 AS kind, frame_idx % 2 = 0 AS compressed, 3 * n AS payload_bytes FROM sizes""")
def container_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all files but the metadata, which names the video."""
    stored = container.chunks(_stored(spark, sf_dir))
    return _named(stored).where("kind = 2").select("video", "pos", "kind", "compressed", F.octet_length("payload").cast("long").alias("payload_bytes"))


@query(f"WITH {FRAMES} SELECT video, count(*) + 1 AS chunks, CAST(0 AS BIGINT) AS unaccounted FROM frames GROUP BY video")
def container_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's chunks, and its bytes on disk less those that its chunks account for."""
    stored = _stored(spark, sf_dir)
    of = container.chunks(stored)
    counts = _named(of).groupBy("path", "video").agg(F.count("*").alias("chunks"))
    sizes = container.bytes_written(of).join(stored.select("path", F.octet_length("content").alias("on_disk")), "path")
    return counts.join(sizes, "path").select("video", "chunks", (F.col("on_disk") - F.col("bytes")).alias("unaccounted"))


@query(f"WITH {FRAMES}, n AS (SELECT video, count(*) AS n FROM frames GROUP BY video) SELECT n AS total_frames, CAST(p - 1 AS INTEGER) AS pos, CAST([0, 1, 1, 0][p] AS INTEGER) AS kind, CAST([0, 0, 1, 1][p] AS INTEGER) AS idx FROM n, range(1, 5) t(p)")
def playback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = container.metadata(container.chunks(_stored(spark, sf_dir)))
    return container.playback(meta).join(meta.select("path", F.col("meta.total_frames").alias("total_frames")), "path").select("total_frames", "pos", "kind", "idx")


@query(f"WITH {FRAMES} SELECT video, frame_idx, round(list_sum(px), 4) AS total FROM frames WHERE (video = 3 AND frame_idx = (SELECT max(frame_idx) FROM frames WHERE video = 3))")
def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last frame of video 3, by index -1."""
    return io.at_index(frames(spark, sf_dir), 3, -1).select("video", "frame_idx", F.round(F.aggregate("px", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"WITH {FRAMES} SELECT video, frame_idx, round(list_sum(px), 4) AS total FROM frames WHERE frame_idx >= 20 AND frame_idx < 200 AND (frame_idx - 20) % 3 = 0")
def slice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.between(frames(spark, sf_dir), 20, 200, 3).select("video", "frame_idx", F.round(F.aggregate("px", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f'WITH {FRAMES} SELECT video, count(*) AS total_frames, min(frame_idx) AS "first", max(frame_idx) AS "last", round(count(*) / 30.0, 6) AS seconds FROM frames GROUP BY video')
def describe_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.counts(frames(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH {NUMBERED}, n AS (SELECT video, count(*) AS n FROM frames GROUP BY video), c AS (SELECT video, unnest(range(0, n - 15, 4)) AS start FROM n WHERE n >= 16)
SELECT c.video, CAST(c.start // 4 AS INTEGER) AS clip, c.start, round(sum(list_sum(f.px)), 4) AS total FROM c JOIN numbered f ON f.video = c.video AND f.k >= c.start AND f.k < c.start + 16 GROUP BY c.video, c.start""")
def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 16 frames, 4 apart, and the sum of their cells."""
    of = numbered(spark, sf_dir).withColumn("k", F.col("k").cast("long"))
    index = io.clip_index(of.groupBy("video").agg(F.count("*").alias("n")), 16, 4)
    total = F.aggregate(F.flatten("px"), F.lit(0.0), lambda s, v: s + v)
    return io.clips(of, index, 16).select("video", "clip", "start", F.round(total, 4).alias("total"))


@query(f"WITH {FRAMES} SELECT video, frame_idx, round(list_sum(list_transform(px, lambda v: 255 - v)), 4) AS total FROM frames")
def transform_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function on batches of frames: the negative."""

    def negative(batches):
        for batch in batches:
            px = batch.column(2)
            turned = pa.ListArray.from_arrays(px.offsets, pc.subtract(255.0, px.values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), turned], batch.schema.names)

    of = frames(spark, sf_dir)
    return io.apply(of, negative, of.schema).select("video", "frame_idx", F.round(F.aggregate("px", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""WITH n AS (SELECT label AS video, count(*) AS n FROM embeddings GROUP BY label)
SELECT video, CAST(i AS INTEGER) AS i, CAST(floor(i * (n - 1) / 9.0 + 1e-9) AS INTEGER) AS k FROM n, range(0, 10) t(i)""")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.operators.prediction import even_samples as places

    n = frames(spark, sf_dir).groupBy("video").agg(F.count("*").cast("int").alias("n"))
    return n.select("video", F.posexplode(places(F.col("n"))).alias("i", "k"))


@query(f"""WITH {FRAMES}, u AS (SELECT video, frame_idx, unnest(px) AS v FROM frames)
SELECT video, frame_idx, format('frame_{{:06d}}.png', frame_idx) AS name, CAST(sum(CAST(trunc(least(greatest(v, 0), 255)) AS INTEGER)) AS BIGINT) AS total FROM u GROUP BY video, frame_idx""")
def export_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame as a PNG file's bytes: its name, and the sum of the pixels read back from it."""
    files = io.png(frames(spark, sf_dir), 8, 8)
    return files.select("video", "frame_idx", "name", F.aggregate(io.read_png("content"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""WITH p AS (SELECT f AS frame_idx, c, 8.0 + 4.8 * sin(2 * pi() * (f * (4 / 60.0))) AS cx, 8.0 + 3.2 * sin(4 * pi() * (f * (4 / 60.0))) AS cy FROM range(60) a(f), range(256) b(c))
SELECT 0 AS video, frame_idx, CAST(sum(CASE WHEN (c % 16 - cx) ** 2 + (c // 16 - cy) ** 2 <= 9 THEN 200 ELSE 100 END) AS DOUBLE) AS total FROM p GROUP BY frame_idx""")
def synthetic_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.synthetic(spark, 60).select("video", "frame_idx", F.aggregate("px", F.lit(0.0), lambda s, x: s + x).alias("total"))


def _video(spark: SparkSession, frames: int = 120, side: int = 64) -> DataFrame:
    """A disc of one colour going round four times, as pixels."""
    grey = io.synthetic(spark, frames, side, side, cycles=4, radius=6.0)
    lit = F.transform("px", lambda v: F.when(v > 150, F.lit("C86450")).otherwise(F.lit("646464")))
    return grey.select("video", "frame_idx", F.lit(side).alias("height"), F.lit(side).alias("width"), F.unhex(F.array_join(lit, "")).alias("pixels"))


@query()
def container_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic video through the whole codec: error of each frame, and the file's share of the raw bytes."""
    ship(spark)
    of = _video(spark)
    coded = codec.encode(of, quality=30, warmup=60, shortest=20, width=3, valley=1.1)
    path = folder(spark)
    container.write(coded, path)
    stored = container.files(spark, path)
    decoded = codec.decode(stored, key="path")
    share = stored.select("path", (F.octet_length("content") / F.lit(120 * 64 * 64 * 3)).alias("share"))
    errors = decoded.join(of.select("frame_idx", F.col("pixels").alias("raw")), "frame_idx").select("path", "frame_idx", codec._change("pixels", "raw").alias("error"))
    return errors.join(share, "path").select("frame_idx", F.round("error", 4).alias("error"), F.round("share", 5).alias("share"))
