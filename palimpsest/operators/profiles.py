"""Line finding on row profiles (key, y, n): bands, valleys, pitch and folds over ordered bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Fixed values of line finding.
GAP_MERGE, MERGED_HEIGHT = 3, 1.65
TALL, SPLIT_SLACK = 1.55, 0.15
VALLEY_RATIO, VALLEY_PEAK, NEIGHBOUR_PEAK = 0.8, 0.55, 0.18
STRONG_LAG = 0.5
TOO_TALL, TOO_LOW, LEAST_BANDS = 2.4, 0.45, 3


def bands_above(profile: DataFrame, threshold: float, least_height: int) -> DataFrame:
    """Maximal runs of rows with n >= threshold of at least least_height: (key, y0, y1)."""
    w = Window.partitionBy("key").orderBy("y")
    high = profile.where(F.col("n") >= threshold).withColumn("_g", F.col("y") - F.row_number().over(w))
    return high.groupBy("key", "_g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).where(F.col("y1") - F.col("y0") >= least_height).drop("_g")


def smooth(profile: DataFrame, radius: int) -> DataFrame:
    """Add sm: the mean of n over rows within radius, clipped at the ends."""
    return profile.withColumn("sm", F.avg("n").over(Window.partitionBy("key").orderBy("y").rowsBetween(-radius, radius)))


def valleys(profile: DataFrame, radius: int = 3, span: int = 40) -> DataFrame:
    """Rows where lines split: local minima of the smoothed profile, deep against both sides and the peak."""
    w = Window.partitionBy("key").orderBy("y")
    whole = Window.partitionBy("key")
    sm = smooth(profile, radius).withColumn("_peak", F.max("n").over(whole)).withColumn("_h", F.count("*").over(whole))
    sides = F.least(F.coalesce(F.max("sm").over(w.rowsBetween(-span, -1)), F.lit(0.0)), F.coalesce(F.max("sm").over(w.rowsBetween(1, span)), F.lit(0.0)))
    found = sm.withColumn("_low", (F.col("sm") <= F.lag("sm").over(w)) & (F.col("sm") <= F.lead("sm").over(w))).withColumn("_side", sides)
    deep = (F.col("_side") >= F.col("_peak") * NEIGHBOUR_PEAK) & (F.col("sm") / F.col("_side") <= VALLEY_RATIO) & (F.col("sm") / F.col("_peak") < VALLEY_PEAK)
    return found.where(F.col("_low") & deep & (F.col("y") >= radius) & (F.col("y") < F.col("_h") - radius)).select("key", "y")


def keep_apart(splits: DataFrame, least_gap: int) -> DataFrame:
    """Per key, in order, keep a split only if it lies more than least_gap after the last one kept: (key, kept)."""
    ordered = splits.groupBy("key").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    kept = F.aggregate(
        "ys",
        F.array().cast("array<int>"),
        lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > least_gap), F.concat(acc, F.array(y.cast("int")))).otherwise(acc),
    )
    return ordered.select("key", F.transform("ys", lambda y: y.cast("int")).alias("ys")).select("key", kept.alias("kept"))


def merge_thin(bands: DataFrame) -> DataFrame:
    """Per key, in order, join a band to the one before over a small gap if the result stays near the median height."""
    ordered = bands.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("y0").cast("int").alias("y0"), F.col("y1").cast("int").alias("y1")))).alias("bs"))
    heights = F.array_sort(F.transform("bs", lambda b: b["y1"] - b["y0"]))
    ordered = ordered.withColumn("target", F.element_at(heights, (F.floor(F.size("bs") / 2) + 1).cast("int")))
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        "bs",
        F.array().cast("array<struct<y0:int,y1:int>>"),
        lambda acc, b: F.when(
            (F.size(acc) > 0) & (b["y0"] - last(acc)["y1"] <= GAP_MERGE) & (b["y1"] - last(acc)["y0"] <= F.col("target") * MERGED_HEIGHT),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["y0"].alias("y0"), b["y1"].alias("y1")))),
        ).otherwise(F.concat(acc, F.array(b))),
    )
    return ordered.select("key", F.explode(merged).alias("b")).select("key", "b.y0", "b.y1")


def pitch(profile: DataFrame, lo: int, hi: int) -> DataFrame:
    """Line pitch by autocorrelation of the profile's differences: (key, pitch), 0 without a positive peak.

    The best local maximum over lags lo..hi, then the smallest local maximum with half its score.
    """
    w = Window.partitionBy("key").orderBy("y")
    d = profile.select("key", "y", (F.col("n") - F.lag("n").over(w)).alias("d")).where("d is not null")
    lags = d.withColumn("lag", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).select("key", "lag", (F.col("y") + F.col("lag")).alias("y"), F.col("d").alias("d0"))
    scores = lags.join(d, ["key", "y"]).groupBy("key", "lag").agg((F.sum(F.col("d0") * F.col("d")) / F.count("*")).alias("s"))
    by_lag = Window.partitionBy("key").orderBy("lag")
    peaks = scores.withColumn("a", F.lag("s").over(by_lag)).withColumn("b", F.lead("s").over(by_lag)).where("s >= a and s >= b and s > 0")
    best = peaks.withColumn("top", F.max("s").over(Window.partitionBy("key"))).where(F.col("s") >= F.col("top") * STRONG_LAG)
    return profile.select("key").distinct().join(best.groupBy("key").agg(F.min("lag").alias("pitch")), "key", "left").select("key", F.coalesce("pitch", F.lit(0)).alias("pitch"))


def split_tall(bands: DataFrame) -> DataFrame:
    """Cut bands (key, y0, y1, pitch) much taller than the pitch into equal, touching slices."""
    height = F.col("y1") - F.col("y0")
    parts = F.when(height <= F.col("pitch") * TALL, 1).otherwise(F.greatest(F.lit(2), F.floor((height + F.col("pitch") * SPLIT_SLACK) / F.col("pitch") + 0.5))).cast("int")
    cut = bands.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    step = height / F.col("parts")
    return cut.select("key", F.floor(F.col("y0") + F.col("i") * step).alias("y0"), F.ceil(F.col("y0") + (F.col("i") + 1) * step).alias("y1"))


def drop_tall(bands: DataFrame) -> DataFrame:
    """Drop bands (key, y0, y1) far above the upper median height of their key, from three bands on."""
    heights = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")).over(Window.partitionBy("key")))
    ranked = bands.withColumn("_hs", heights)
    upper = F.element_at("_hs", (F.floor(F.size("_hs") / 2) + 1).cast("int"))
    return ranked.where((F.size("_hs") < LEAST_BANDS) | (F.col("y1") - F.col("y0") <= upper * TOO_TALL)).drop("_hs")


def drop_low(bands: DataFrame) -> DataFrame:
    """Drop bands (key, y0, y1) far below the median height of their key, from three bands on."""
    w = Window.partitionBy("key")
    height = F.col("y1") - F.col("y0")
    ranked = bands.withColumn("_n", F.count("*").over(w)).withColumn("_mid", F.median(height).over(w))
    return ranked.where((F.col("_n") < LEAST_BANDS) | (height >= F.col("_mid") * TOO_LOW)).drop("_n", "_mid")
