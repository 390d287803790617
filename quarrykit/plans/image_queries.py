"""Queries over rasters: 64 values of an embedding are an 8 by 8 raster of one channel, its label the class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..functions import rasters
from ..operators import images, profile
from .catalogue import register
from .table_queries import rounded

DOUBLES = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS p FROM embeddings)\n"
#: Bytes of a raster: values scaled to 0..255 by one rule for all.
BYTES = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, greatest(0, floor(x::double * 400 + 128)))::double) AS p FROM embeddings)\n"
MEAN = "(list_sum({a}) / 64)"


def rasters_of(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    return e.withColumns({"height": F.lit(8), "width": F.lit(8), "channels": F.lit(1)})


def bytes_of(spark, sf):
    return rasters_of(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(v * 400 + 128).cast("double")))))


@register("img_brightness_contrast", BYTES + "SELECT vec_id, round(list_sum(p) / 64, 6) AS brightness, round(sqrt(list_sum(list_transform(p, lambda x: (x - m) * (x - m))) / 64), 6) AS contrast FROM (SELECT vec_id, p, list_sum(p) / 64 AS m FROM e)")
def brightness(spark, sf):
    return rounded(images.brightness_contrast(bytes_of(spark, sf)).select("vec_id", "brightness", "contrast"), "brightness", "contrast")


_BRIGHT = BYTES + """, b AS (SELECT label, list_sum(p) / 64 AS v FROM e), q AS (SELECT label, avg(v) AS m, var_samp(v) AS s, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1),
o AS (SELECT b.label, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n FROM b JOIN q ON b.label = q.label GROUP BY 1), r AS (SELECT q.label, round(m, 2) AS mean, round(s, 2) AS var, round(q2, 2) AS median, round(q3 - q1, 2) AS iqr, n::bigint AS n_outliers FROM q JOIN o ON q.label = o.label)
SELECT *, label = (SELECT arg_max(label, mean) FROM r) AS brightest, label = (SELECT arg_min(label, mean) FROM r) AS darkest, mean > (SELECT quantile_cont(mean, 0.5) FROM r) AS above_median FROM r"""


@register("img_brightness_by_class", _BRIGHT)
def brightness_by_class(spark, sf):
    return images.brightness_report(images.brightness_contrast(bytes_of(spark, sf)), "label")


def _norm(name, method, expression):
    stats = "(SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest(p) AS v FROM e))"

    @register(name, BYTES + f"SELECT vec_id, round(list_sum(q), 4) AS total, round(q[1], 6) AS first, round(q[64], 6) AS last FROM (SELECT vec_id, list_transform(p, lambda x: {expression}) AS q FROM e, {stats})")
    def query(spark, sf):
        out = images.normalize(bytes_of(spark, sf), method)
        out = out.select("vec_id", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"), F.col("pixels")[0].alias("first"), F.col("pixels")[63].alias("last"))
        return rounded(rounded(out, "total", digits=4), "first", "last")

    return query


_norm("img_norm_minmax01", "minmax_01", "(x - lo) / (hi - lo + 1e-8)")
_norm("img_norm_minmaxm11", "minmax_m11", "2 * ((x - lo) / (hi - lo + 1e-8)) - 1")
_norm("img_norm_zscore", "zscore_global", "(x - m) / (s + 1e-8)")
_norm("img_norm_zscore_channel", "zscore_channel", "(x - m) / (s + 1e-8)")


@register("img_flip", BYTES + "SELECT vec_id, list_transform(range(0, 64), lambda i: p[(i // 8) * 8 + (7 - i % 8) + 1])[1:8] AS first_row FROM e")
def flip(spark, sf):
    return bytes_of(spark, sf).select("vec_id", F.slice(images.flip(F.col("pixels"), 8), 1, 8).alias("first_row"))


@register("img_brightness_adjust", BYTES + "SELECT vec_id, list_sum(list_transform(p, lambda x: least(255, abs(round(1.2::double * x - 20))))) AS total FROM e")
def brightness_adjust(spark, sf):
    return bytes_of(spark, sf).select("vec_id", F.aggregate(images.adjust(F.col("pixels"), 1.2, -20), F.lit(0.0), lambda a, v: a + v).alias("total"))


_SHIFTED = BYTES + ", z AS (SELECT vec_id, p, list_transform(p, lambda x: least(255, abs(round(1.2::double * x - 20)))) AS q FROM e)\n"


def _shifted(spark, sf):
    return bytes_of(spark, sf).withColumn("other", images.adjust(F.col("pixels"), 1.2, -20))


@register("img_psnr", _SHIFTED + ", m AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) / 64 AS mse FROM z) SELECT vec_id, round(mse, 6) AS mse, round(CASE WHEN mse > 0 THEN 20 * log10(255 / sqrt(mse)) END, 6) AS psnr FROM m")
def psnr(spark, sf):
    mse, value = images.mse_psnr(F.col("pixels"), F.col("other"))
    return rounded(_shifted(spark, sf).select("vec_id", mse.alias("mse"), value.alias("psnr")), "mse", "psnr")


@register("img_ssim", _SHIFTED + """, m AS (SELECT vec_id, list_sum(p) / 64 AS a, list_sum(q) / 64 AS b, list_sum(list_transform(p, lambda x: x * x)) / 64 AS aa, list_sum(list_transform(q, lambda x: x * x)) / 64 AS bb, list_sum(list_transform(range(1, 65), lambda i: p[i] * q[i])) / 64 AS ab FROM z)
SELECT vec_id, round((2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)), 6) AS ssim FROM m""")
def ssim(spark, sf):
    return rounded(_shifted(spark, sf).select("vec_id", images.ssim(F.col("pixels"), F.col("other")).alias("ssim")), "ssim")


HASHED = "WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings)\n"


@register("img_hash_hamming_pairs", HASHED + "SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: (x.b[i] <> y.b[i])::int))::bigint AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE list_sum(list_transform(range(1, 65), lambda i: (x.b[i] <> y.b[i])::int)) <= 20")
def hamming(spark, sf):
    df = rasters_of(spark, sf).select("vec_id", images.sign_hash(F.col("pixels")).alias("h"))
    return images.hamming_pairs(df, "vec_id", "h", 20).withColumn("distance", F.col("distance").cast("long"))


def _greedy_sql(hashed: str, most: int) -> str:
    """Rows in order of id, each kept unless a kept one is near: a walk in a recursive query."""
    return f"""WITH RECURSIVE {hashed}, n AS (SELECT vec_id, h, row_number() OVER (ORDER BY vec_id) AS i FROM hashed),
w AS (SELECT 0::bigint AS i, []::STRUCT(id BIGINT, h UBIGINT)[] AS kept UNION ALL
 SELECT n.i, CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k.h, n.h)::bit) <= {most})) > 0 THEN w.kept ELSE list_append(w.kept, {{'id': n.vec_id, 'h': n.h}}) END FROM w JOIN n ON n.i = w.i + 1),
k AS (SELECT unnest(kept) AS k FROM w WHERE i = (SELECT count(*) FROM n))
SELECT n.vec_id AS "key", min(k.k.id) AS kept_by FROM n JOIN k ON k.k.id < n.vec_id AND bit_count(xor(k.k.h, n.h)::bit) <= {most} GROUP BY 1"""


_SIGNS = "hashed AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (2::hugeint ** (63 - i))::hugeint ELSE 0::hugeint END))::ubigint AS h FROM embeddings)"


def _phash_sql() -> str:
    """The perceptual hash of an 8 by 8 raster: enlarged to 32 by 32, its low cosine frequencies are one 8 by 8 matrix on either side."""
    left = (rasters.dct_matrix(32) @ rasters._line_matrix(8, 32))[:8]
    rows = ", ".join("[" + ", ".join(f"{v!r}::double" for v in r) + "]" for r in left.tolist())
    value = "list_sum(list_transform(range(0, 64), lambda j: m[(u // 8) + 1][(j // 8) + 1] * m[(u % 8) + 1][(j % 8) + 1] * p[j + 1]))"
    return BYTES.rstrip().removeprefix("WITH ") + f""", mat AS (SELECT [{rows}] AS m), low AS (SELECT vec_id, list_transform(range(0, 64), lambda u: {value}) AS f FROM e, mat),
bits AS (SELECT vec_id, f, list_sum(f[9:64]) / 56 AS a FROM low),
hashed AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN f[i + 1] > a THEN (2::hugeint ** (63 - i))::hugeint ELSE 0::hugeint END))::ubigint AS h FROM bits)"""


@register("img_dedupe", _greedy_sql(_SIGNS, 20))
def dedupe(spark, sf):
    df = rasters_of(spark, sf).select("vec_id", images.sign_hash(F.col("pixels")).alias("h"))
    return images.greedy_duplicates(images.hamming_pairs(df, "vec_id", "h", 20))


@register("img_dedupe_phash", _greedy_sql(_phash_sql(), 10))
def dedupe_phash(spark, sf):
    return images.hash_duplicates(images.phash(bytes_of(spark, sf)), "vec_id", "phash", 10)


@register("img_phash", f"WITH {_phash_sql()} SELECT vec_id, CASE WHEN h >= 9223372036854775808 THEN (h::hugeint - 18446744073709551616)::bigint ELSE h::bigint END AS phash FROM hashed")
def phash(spark, sf):
    return images.phash(bytes_of(spark, sf)).select("vec_id", "phash")


@register("img_edge_density")
def edges(spark, sf):
    return images.edge_densities(bytes_of(spark, sf), ["vec_id", "label"], 32).groupBy("method").agg(F.avg("edge_density").alias("mean"), F.count("*").alias("n"))


@register("img_resize_quality")
def resize_quality(spark, sf):
    return images.quality(images.resize(bytes_of(spark, sf), 64), 32).select("vec_id", "psnr", "ssim")


@register("img_color_spaces")
def color_spaces(spark, sf):
    grey = bytes_of(spark, sf)
    rgb = grey.withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, 255 - v, F.abs(v - 128))))).withColumn("channels", F.lit(3))
    out = None
    for space in ("RGB", "HSV", "LAB", "Grayscale"):
        one = images.convert_color(rgb, space).select(F.lit(space).alias("space"), images.array_mean(F.col("pixels")).alias("m")).groupBy("space").agg(F.avg("m").alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


@register("img_color_space_scores")
def color_scores(spark, sf):
    grey = bytes_of(spark, sf)
    rgb = grey.withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, 255 - v, F.abs(v - 128))))).withColumn("channels", F.lit(3))
    return images.color_space_scores(rgb, "vec_id", "label")


@register("img_augmentation", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, (SELECT max(n) FROM c)::bigint AS n, ((SELECT max(n) FROM c) - n)::bigint AS n_made FROM c")
def augmentation(spark, sf):
    return images.augment(bytes_of(spark, sf), "vec_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("copy") > 0).cast("long")).alias("n_made"))


@register("img_augmentation_experiment")
def augmentation_experiment(spark, sf):
    return images.augmentation_experiment(bytes_of(spark, sf), "vec_id", "label")


@register("img_pixel_histogram", BYTES + ", b AS (SELECT least(floor((v - 0) / 2.55::double), 99)::bigint AS bin FROM (SELECT unnest(p) AS v FROM e)) SELECT bin, count(*)::bigint AS n, round(count(*)::double / (SELECT count(*) FROM b) / 2.55::double, 9) AS density FROM b GROUP BY 1")
def pixel_histogram(spark, sf):
    return rounded(profile.histogram(images.pixel_rows(bytes_of(spark, sf), ["vec_id"]), "value", 100, 0.0, 255.0), "density", digits=9)


@register("img_pixels_by_class", BYTES + """, v AS (SELECT label, unnest(p) AS v FROM e), q AS (SELECT label, count(*) AS n, min(v) AS lo, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3, max(v) AS hi FROM v GROUP BY 1)
SELECT q.label, any_value(n)::bigint AS n, any_value(lo) AS min, any_value(q1) AS q1, any_value(md) AS median, any_value(q3) AS q3, any_value(hi) AS max, count(*) FILTER (v.v < q1 - 1.5 * (q3 - q1) OR v.v > q3 + 1.5 * (q3 - q1))::bigint AS n_outliers FROM v JOIN q ON v.label = q.label GROUP BY 1""")
def pixels_by_class(spark, sf):
    return profile.five_numbers(images.pixel_rows(bytes_of(spark, sf), ["label"]), "value", ["label"])


@register("img_flip_whole", BYTES + "SELECT vec_id, list_transform(range(0, 64), lambda i: p[(i // 8) * 8 + (7 - i % 8) + 1]) AS flipped FROM e")
def flip_whole(spark, sf):
    return bytes_of(spark, sf).select("vec_id", images.flip(F.col("pixels"), 8).alias("flipped"))


def _rgb(spark, sf):
    """Three channels from one, so that statistics by channel differ."""
    return bytes_of(spark, sf).withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, 255 - v, F.abs(v - 128))))).withColumn("channels", F.lit(3))


_RGB = BYTES + ", c AS (SELECT vec_id, flatten(list_transform(p, lambda v: [v, 255 - v, abs(v - 128)])) AS p FROM e)\n"


def _norm_whole(method, expression):
    stats = "(SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest(p) AS v FROM c))"

    @register(f"img_norm_rgb_{method}", _RGB + f"SELECT vec_id, list_transform(p, lambda x: round({expression}, 5)) AS pixels FROM c, {stats}")
    def query(spark, sf):
        return images.normalize(_rgb(spark, sf), method, channels=3).select("vec_id", F.transform("pixels", lambda v: F.round(v, 5)).alias("pixels"))

    return query


_norm_whole("minmax_01", "(x - lo) / (hi - lo + 1e-8)")
_norm_whole("minmax_m11", "2 * ((x - lo) / (hi - lo + 1e-8)) - 1")
_norm_whole("zscore_global", "(x - m) / (s + 1e-8)")


@register("img_norm_rgb_zscore_channel", _RGB + """, v AS (SELECT unnest(range(0, 192)) % 3 AS k, unnest(p) AS v FROM c), s AS (SELECT list(m ORDER BY k) AS m, list(s ORDER BY k) AS s FROM (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY 1))
SELECT vec_id, list_transform(range(0, 192), lambda i: round((p[i + 1] - s.m[i % 3 + 1]) / (s.s[i % 3 + 1] + 1e-8), 5)) AS pixels FROM c, s""")
def norm_channel(spark, sf):
    return images.normalize(_rgb(spark, sf), "zscore_channel", channels=3).select("vec_id", F.transform("pixels", lambda v: F.round(v, 5)).alias("pixels"))


@register("img_brightest_by_class", BYTES + "SELECT label, arg_max(vec_id, v * 1000 - vec_id) AS brightest, arg_min(vec_id, v * 1000 + vec_id) AS darkest FROM (SELECT vec_id, label, list_sum(p) AS v FROM e) GROUP BY 1")
def brightest(spark, sf):
    sums = bytes_of(spark, sf).select("vec_id", "label", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("v"))
    return sums.groupBy("label").agg(F.max_by("vec_id", F.col("v") * 1000 - F.col("vec_id")).alias("brightest"), F.min_by("vec_id", F.col("v") * 1000 + F.col("vec_id")).alias("darkest"))
