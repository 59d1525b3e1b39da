"""Queries of transform coding, run lengths, codebooks and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import arrays, transform
from cadenza.operators import background as bg
from cadenza.operators import prediction, rle, vq
from cadenza.plans.inputs import CELLS, FRAMES, NUMBERED, frames, numbered
from cadenza.plans.registry import query
from cadenza.sources import frames as io

QUALITY = 50
_LUMA = transform.quant_table(QUALITY)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = transform.literal(_LUMA)
    return frames(spark, sf_dir).withColumn("levels", transform.quantise(transform.dct("px"), table))


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = transform.literal(_LUMA)
    return _levels(spark, sf_dir).withColumn("back", transform.idct(transform.dequantise(F.col("levels"), table)))


_ONE = "CASE WHEN {k} = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) * cos(pi() * (2 * {n} + 1) * {k} / 16) END"
_TABLE = f"CAST([{', '.join(f'{v}.0' for v in _LUMA)}] AS DOUBLE[])"
_LEVELS = CELLS + f""", basis AS (SELECT k, p, ({_ONE.format(k='(k // 8)', n='(p // 8)')}) * ({_ONE.format(k='(k % 8)', n='(p % 8)')}) AS w FROM range(64) a(k), range(64) b(p)),
coefs AS (SELECT c.video, c.frame_idx, b.k, sum(c.v * b.w) AS x FROM cells c JOIN basis b ON c.cell = b.p GROUP BY c.video, c.frame_idx, b.k),
levels AS (SELECT video, frame_idx, k, CAST(least(greatest(round_even(x / ({_TABLE})[k + 1], 0), -32767), 32767) AS INTEGER) AS v FROM coefs)"""
_BACK = _LEVELS + f""", back AS (SELECT l.video, l.frame_idx, b.p AS cell, sum(l.v * ({_TABLE})[l.k + 1] * b.w) AS y FROM levels l JOIN basis b ON l.k = b.k GROUP BY l.video, l.frame_idx, b.p),
pairs AS (SELECT c.video, c.frame_idx, c.cell, c.v AS a, b.y AS b FROM cells c JOIN back b ON c.video = b.video AND c.frame_idx = b.frame_idx AND c.cell = b.cell)"""


@query(f"""SELECT CAST(q AS INTEGER) AS quality, luma, CAST(i - 1 AS INTEGER) AS k,
  CAST(least(greatest(floor((base[i] * CASE WHEN q < 50 THEN 5000.0 / q ELSE 200.0 - 2.0 * q END + 50.0) / 100.0), 1), 255) AS INTEGER) AS step
FROM (SELECT unnest([1, 10, 25, 30, 50, 75, 90, 100]) AS q), (SELECT true AS luma, CAST([{', '.join(map(str, transform.LUMA))}] AS DOUBLE[]) AS base
  UNION ALL SELECT false, CAST([{', '.join(map(str, transform.CHROMA))}] AS DOUBLE[])), range(1, 65) t(i)""")
def quant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = F.array(*(F.struct(F.lit(luma).alias("luma"), transform.literal(v).alias("base")) for luma, v in ((True, transform.LUMA), (False, transform.CHROMA))))
    rows = spark.range(1).select(F.explode(F.array(*(F.lit(q) for q in (1, 10, 25, 30, 50, 75, 90, 100)))).alias("quality")).select("quality", F.explode(tables).alias("t"))
    rows = rows.select("quality", "t.luma", F.posexplode("t.base").alias("k", "base"))
    return rows.select("quality", "luma", "k", transform.quant_step(F.col("base"), F.col("quality")).cast("int").alias("step"))


@query(f"WITH {_LEVELS} SELECT video, frame_idx, CAST(k AS INTEGER) AS k, v AS coef FROM levels")
def dct_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("video", "frame_idx", F.posexplode("levels").alias("k", "coef"))


@query(f"WITH {_LEVELS} SELECT video, frame_idx, CAST(k AS INTEGER) AS k, v AS coef FROM levels")
def dct_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dct_quantize() with the transform as a Column expression."""
    levels = transform.quantise(transform.transformed(F.col("px"), native=False), transform.literal(_LUMA))
    return frames(spark, sf_dir).select("video", "frame_idx", F.posexplode(levels).alias("k", "coef"))


@query(f"""WITH {_BACK} SELECT video, frame_idx, round(max(abs(a - b)), 6) AS max_err, round(CASE WHEN avg((a - b) ** 2) < 1e-10 THEN 100.0 ELSE 10 * log10(65025.0 / avg((a - b) ** 2)) END, 6) AS psnr
FROM pairs GROUP BY video, frame_idx""")
def idct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.array_max(F.zip_with("px", "back", lambda a, b: F.abs(a - b)))
    error = arrays.psnr(arrays.mean_squared_error(F.col("px"), F.col("back")))
    return _round_trip(spark, sf_dir).select("video", "frame_idx", F.round(off, 6).alias("max_err"), F.round(error, 6).alias("psnr"))


@query(f"""WITH {FRAMES}, p AS (SELECT video, frame_idx, px[1] AS b, px[2] AS g, px[3] AS r FROM frames),
q AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM p)
SELECT video, frame_idx, round(y, 6) AS y, round((b - y) * (0.5 / 0.886), 6) AS cb, round((r - y) * (0.5 / 0.701), 6) AS cr, round(b, 6) AS b2, round(g, 6) AS g2, round(r, 6) AS r2 FROM q""")
def ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three cells of a frame as blue, green and red, there and back."""
    b, g, r = (F.get("px", k) for k in range(3))
    out = frames(spark, sf_dir).select("video", "frame_idx", *(c.alias(n) for n, c in zip(("y", "cb", "cr"), transform.ycbcr(b, g, r), strict=True)))
    back = transform.bgr(F.col("y"), F.col("cb"), F.col("cr"))
    out = out.select("*", *(c.alias(n) for n, c in zip(("b2", "g2", "r2"), back, strict=True)))
    return out.select("video", "frame_idx", *(F.round(c, 6).alias(c) for c in ("y", "cb", "cr", "b2", "g2", "r2")))


@query(f"""WITH {CELLS}, cropped AS (SELECT video, frame_idx, cell // 8 AS y, cell % 8 AS x, v FROM cells WHERE cell // 8 < 5 AND cell % 8 < 6),
grid AS (SELECT f.video, f.frame_idx, g.p // 8 AS y, g.p % 8 AS x, g.p FROM frames f, range(64) g(p))
SELECT g.video, g.frame_idx, CAST(g.p AS INTEGER) AS pos, round(coalesce(c.v, 0), 6) AS v FROM grid g LEFT JOIN cropped c ON g.video = c.video AND g.frame_idx = c.frame_idx AND g.y = c.y AND g.x = c.x""")
def pad_blockify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of 5 x 6 cells padded with zeros to a block of 8 x 8."""
    crop = F.filter("px", lambda v, i: (F.floor(i / 8) < 5) & (i % 8 < 6))
    out = frames(spark, sf_dir).select("video", "frame_idx", crop.alias("c"))
    block = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.when((F.floor(p / 8) < 5) & (p % 8 < 6), F.get(F.col("c"), (F.floor(p / 8) * 6 + p % 8).cast("int"))).otherwise(0.0))
    return out.select("video", "frame_idx", F.posexplode(block).alias("pos", "v")).withColumn("v", F.round("v", 6))


_RLE = _LEVELS + """, marked AS (SELECT *, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video, frame_idx ORDER BY k) AS island FROM levels),
parted AS (SELECT *, (row_number() OVER (PARTITION BY video, frame_idx, island, v <> 0 ORDER BY k) - 1) // 255 AS part FROM marked),
runs AS (SELECT video, frame_idx, min(k) AS start, max(v) AS value, 1 AS run FROM parted WHERE v <> 0 GROUP BY video, frame_idx, k
  UNION ALL SELECT video, frame_idx, min(k), 0, count(*) FROM parted WHERE v = 0 GROUP BY video, frame_idx, island, part)"""


@query(f"WITH {_RLE} SELECT video, frame_idx, CAST(row_number() OVER (PARTITION BY video, frame_idx ORDER BY start) - 1 AS INTEGER) AS ord, CAST(value AS INTEGER) AS value, CAST(run AS INTEGER) AS run FROM runs")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _levels(spark, sf_dir).select("video", "frame_idx", F.posexplode(rle.encode(F.col("levels"))).alias("ord", "p"))
    return out.select("video", "frame_idx", "ord", "p.value", "p.run")


@query(f"WITH {_RLE} SELECT video, frame_idx, CAST(start AS INTEGER) AS start, CAST(value AS INTEGER) AS value, CAST(run AS INTEGER) AS run FROM runs")
def rle_encode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _levels(spark, sf_dir).select("video", "frame_idx", F.posexplode("levels").alias("pos", "v"))
    return rle.encode_rows(cells, ["video", "frame_idx"])


@query(f"WITH {_LEVELS} SELECT video, frame_idx, CAST(k AS INTEGER) AS pos, v FROM levels")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _levels(spark, sf_dir).withColumn("bytes", io.deflate()(io.pack_pairs(rle.encode(F.col("levels")))))
    pairs = io.unpack_pairs(io.inflate("bytes"))
    return packed.select("video", "frame_idx", F.posexplode(rle.decode(pairs, F.lit(64))).alias("pos", "v"))


@query(f"WITH {_LEVELS} SELECT video, frame_idx, count(*) FILTER (WHERE v <> 0) AS nonzero FROM levels GROUP BY video, frame_idx HAVING count(*) FILTER (WHERE v <> 0) > 0")
def nonzero_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vq.nonzero(_levels(spark, sf_dir)).select("video", "frame_idx", F.size(F.filter("levels", lambda v: v != 0)).cast("long").alias("nonzero"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).withColumn("pairs", io.pack_pairs(rle.encode(F.col("levels")))).withColumn("packed", io.deflate()("pairs"))


@query(f"WITH {_RLE} SELECT video, frame_idx, 3 * count(*) AS rle_bytes, 3 * count(*) AS inflated_bytes FROM runs GROUP BY video, frame_idx")
def coded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each frame's run lengths, and again after they were deflated and inflated."""
    return _packed(spark, sf_dir).select("video", "frame_idx", F.octet_length("pairs").cast("long").alias("rle_bytes"), F.octet_length(io.inflate("packed")).cast("long").alias("inflated_bytes"))


@query()
def deflated_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each frame's coded levels: run lengths, deflated."""
    return _packed(spark, sf_dir).select("video", "frame_idx", F.octet_length("packed").alias("coded_bytes"))


@query(f"""WITH {FRAMES}, u AS (SELECT video, frame_idx, unnest(px) AS a, unnest(coalesce(lag(px) OVER (PARTITION BY video ORDER BY frame_idx), list_transform(px, lambda x: NULL))) AS b FROM frames)
SELECT video, frame_idx, CAST(sum(CAST(trunc(a) AS INTEGER) - CAST(trunc(least(greatest(b, 0), 255)) AS INTEGER)) AS BIGINT) AS total, count(*) AS cells FROM u WHERE b IS NOT NULL GROUP BY video, frame_idx""")
def temporal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prediction.temporal_delta(frames(spark, sf_dir)).where("delta is not null")
    return out.select("video", "frame_idx", F.aggregate("delta", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("delta").cast("long").alias("cells"))


@query(f"WITH {NUMBERED} SELECT video, frame_idx, CASE WHEN k % 26 = 0 THEN 'I' ELSE 'P' END AS type, CAST(k // 26 AS BIGINT) AS run FROM numbered")
def ip_frame_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("video", "frame_idx", prediction.frame_type(F.col("k")).alias("type"), F.floor(F.col("k") / 26).alias("run"))


_PAIRED = NUMBERED + """, canon AS (SELECT video + 1 AS video, k, px FROM numbered),
lens AS (SELECT video, max(k) AS last FROM canon GROUP BY video)"""


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    of = numbered(spark, sf_dir)
    return of.where("video > 0"), of.select((F.col("video") + 1).alias("video"), "k", "px")


def _totals(df: DataFrame) -> DataFrame:
    return df.select("video", F.col("k").cast("long").alias("k"), F.aggregate("delta", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _delta_sql(join: str, ref: str) -> str:
    return f"""WITH {_PAIRED}, u AS (SELECT n.video, n.k, unnest(n.px) AS a, unnest({ref}) AS b FROM numbered n {join} WHERE n.video > 0)
SELECT video, CAST(k AS BIGINT) AS k, CAST(sum(CAST(trunc(a) AS INTEGER) - CAST(trunc(b) AS INTEGER)) AS BIGINT) AS total FROM u GROUP BY video, k"""


@query(_delta_sql("JOIN canon c ON n.video = c.video AND n.k = c.k", "c.px"))
def canonical_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video against the one before it as representative; frames beyond its end are dropped."""
    return _totals(prediction.canonical_delta(*_canonical(spark, sf_dir)))


@query(_delta_sql("LEFT JOIN canon c ON n.video = c.video AND n.k = c.k", "coalesce(c.px, list_transform(n.px, lambda x: CAST(0 AS DOUBLE)))"))
def canonical_delta_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(prediction.canonical_delta(*_canonical(spark, sf_dir), beyond="zero"))


@query(_delta_sql("JOIN lens l ON n.video = l.video JOIN canon c ON n.video = c.video AND least(n.k, l.last) = c.k", "c.px"))
def canonical_delta_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(prediction.canonical_delta(*_canonical(spark, sf_dir), beyond="last"))


@query(f"""WITH {NUMBERED}, d AS (SELECT video, k, k // 26 AS g, unnest(px) AS a, unnest(coalesce(lag(px) OVER (PARTITION BY video ORDER BY k), px)) AS b, generate_subscripts(px, 1) - 1 AS cell FROM numbered),
delta AS (SELECT video, k, g, cell, CASE WHEN k % 26 = 0 THEN CAST(trunc(a) AS BIGINT) ELSE CAST(trunc(a) AS BIGINT) - CAST(trunc(b) AS BIGINT) END AS d FROM d)
SELECT video, CAST(k AS BIGINT) AS k, CAST(cell AS INTEGER) AS cell, CAST(sum(d) OVER (PARTITION BY video, g, cell ORDER BY k) AS BIGINT) AS v FROM delta""")
def open_loop_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from whole-level changes summed since the last I frame."""
    of = numbered(spark, sf_dir).select("video", "k", F.posexplode("px").alias("cell", "v")).withColumn("v", F.col("v").cast("long"))
    prev = F.lag("v").over(W.partitionBy("video", "cell").orderBy("k"))
    kind = prediction.frame_type(F.col("k"))
    deltas = of.select("video", "k", "cell", kind.alias("type"), F.when(kind == "I", F.col("v")).otherwise(F.col("v") - prev).alias("d"))
    return prediction.decode_open_loop(deltas).withColumn("k", F.col("k").cast("long"))


_LESS = """, cells AS (SELECT video, frame_idx, k, generate_subscripts(px, 1) AS cell, unnest(px) AS v FROM numbered),
means AS (SELECT video, cell, avg(v) AS mean FROM cells GROUP BY video, cell),
less AS (SELECT c.video, c.k, c.cell, least(greatest(c.v - m.mean, -128), 127) AS v FROM cells c JOIN means m ON c.video = m.video AND c.cell = m.cell),
sizes AS (SELECT video, max(k) + 1 AS n FROM numbered GROUP BY video)"""
_OFFSETS = f"""WITH {NUMBERED}{_LESS},
grid AS (SELECT a.video AS pair, o AS "offset", CAST(least(a.n, b.n) - abs(o) AS BIGINT) AS n FROM sizes a JOIN sizes b ON b.video = a.video + 1, range(-20, 21) t(o)),
spots AS (SELECT pair, "offset", CAST(floor(i * (n - 1) / CAST(least(n, 10) - 1 AS DOUBLE) + 1e-9) AS BIGINT) AS i FROM grid, range(0, 10) t(i) WHERE n >= 5 AND i < least(n, 10)),
errors AS (SELECT s.pair, s."offset", s.i, avg((a.v - b.v) ** 2) AS mse FROM spots s
  JOIN less a ON a.video = s.pair AND a.k = s.i + greatest(-s."offset", 0) JOIN less b ON b.video = s.pair + 1 AND b.k = s.i + greatest(s."offset", 0) AND a.cell = b.cell GROUP BY s.pair, s."offset", s.i),
offsets AS (SELECT pair, "offset", avg(mse) AS mse FROM errors GROUP BY pair, "offset")"""


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each video less its background, and the one after it."""
    of = numbered(spark, sf_dir)
    means = bg.model_arrays(bg.statistics(bg.cells(of)))
    less = of.join(means, "video").select("video", "k", F.zip_with("px", "mean", lambda v, m: v - m).alias("px"))
    last = of.agg(F.max("video")).first()[0]
    return less.where(F.col("video") < last).withColumnRenamed("video", "pair"), less.where("video > 0").select((F.col("video") - 1).alias("pair"), "k", "px")


@query(_OFFSETS + ' SELECT pair, CAST("offset" AS INTEGER) AS "offset", round(mse, 6) AS mse FROM offsets')
def phase_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.phase_offsets(*_sequences(spark, sf_dir)).withColumn("mse", F.round("mse", 6))


@query(_OFFSETS + ' SELECT pair, CAST(arg_min("offset", (mse, "offset")) AS INTEGER) AS "offset", round(min(mse), 6) AS mse FROM offsets GROUP BY pair')
def phase_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.best_offset(prediction.phase_offsets(*_sequences(spark, sf_dir))).withColumn("mse", F.round("mse", 6))


@query(f"""WITH {NUMBERED}, u AS (SELECT a.video AS pair, a.k, unnest(a.px) AS x, unnest(b.px) AS y FROM numbered a JOIN numbered b ON b.video = a.video + 1 AND a.k = b.k WHERE a.k % 10 = 0),
e AS (SELECT pair, k, avg((x - y) ** 2) AS mse FROM u GROUP BY pair, k) SELECT pair, round(avg(mse), 6) AS mse FROM e GROUP BY pair""")
def sequence_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = numbered(spark, sf_dir)
    a = of.join(of.select((F.col("video") - 1).alias("video")).distinct(), "video", "left_semi").withColumnRenamed("video", "pair")
    return prediction.sequence_mse(a, of.select((F.col("video") - 1).alias("pair"), "k", "px")).withColumn("mse", F.round("mse", 6))


@query(f"WITH {NUMBERED} SELECT video, frame_idx, CAST(k AS INTEGER) AS k FROM numbered WHERE k < video + 3")
def frame_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skipped cycle repeats the first video + 3 frames of its representative."""
    of = numbered(spark, sf_dir)
    return prediction.frame_skip(of, of.select("video", (F.col("video") + 3).alias("n")).distinct()).select("video", "frame_idx", "k")


@query()
def closed_loop_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames coded against what a decoder has: type, levels that aren't 0, and PSNR."""
    of = numbered(spark, sf_dir)
    coded = prediction.closed_loop(of, bg.model_arrays(bg.statistics(bg.cells(of))), _LUMA)
    out = coded.join(of.select("video", "k", "px"), ["video", "k"])
    mse = arrays.mean_squared_error(F.transform("px", lambda v: transform.clip(v, 0.0, 255.0)), F.col("decoded"))
    return out.select("video", "k", "type", F.size(F.filter("levels", lambda v: v != 0)).alias("nonzero"), F.round(arrays.psnr(mse), 4).alias("psnr"))


_BOOK = _LEVELS + """, book AS (SELECT video AS code, k, avg(v) AS c FROM levels GROUP BY video, k),
dist AS (SELECT l.video, l.frame_idx, b.code, sum((l.v - b.c) ** 2) AS dist FROM levels l JOIN book b ON l.k = b.k GROUP BY l.video, l.frame_idx, b.code),
best AS (SELECT video, frame_idx, arg_min(code, (round(dist, 9), code)) AS code, min(dist) AS dist FROM dist GROUP BY video, frame_idx)"""


def _codebook(levels: DataFrame) -> DataFrame:
    """The mean block of each video: a codebook that any engine makes alike."""
    rows = levels.select("video", F.posexplode("levels").alias("k", "v")).groupBy("video", "k").agg(F.avg("v").alias("c"))
    return rows.groupBy(F.col("video").alias("code")).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("r")).select("code", F.col("r.c").alias("centroid"))


@query(f"WITH {_BOOK} SELECT video, frame_idx, CAST(code AS INTEGER) AS code, round(dist, 5) AS dist FROM best")
def vq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    return vq.encode(levels, _codebook(levels)).select("video", "frame_idx", "code", F.round("dist", 5).alias("dist"))


@query(f"WITH {_BOOK} SELECT video, frame_idx, CAST(code AS INTEGER) AS code, round(dist / 64, 5) AS mse FROM best")
def vq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    book = _codebook(levels)
    out = vq.distortion(vq.decode(vq.encode(levels, book), book))
    return out.select("video", "frame_idx", "code", F.round("mse", 5).alias("mse"))


@query()
def codebook_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of 16 by k-means, through half floats and back."""
    book = vq.train(vq.nonzero(_levels(spark, sf_dir)), 16)
    back = book.withColumn("half", vq.unpack_half(vq.pack_half("centroid")))
    return back.select("code", F.round(F.sqrt(arrays.squared_distance(F.col("centroid"), F.transform("centroid", lambda v: F.lit(0.0)))), 6).alias("norm"), F.round(F.array_max(F.zip_with("centroid", "half", lambda a, b: F.abs(a - b))), 6).alias("loss"))
