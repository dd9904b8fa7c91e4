"""Label, depth and row-subset operators on pixel tables and manifests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import colour
from pixelmill.functions.seeded import hash_order, uniform
from pixelmill.operators.ordered import first_n, row_index

# Six render labels to background / wire / connector.
SIX_TO_THREE = {0: 0, 5: 0, 1: 1, 2: 1, 3: 1, 4: 2}


def lookup(col: str | Column, mapping: Mapping[int, int]) -> Column:
    """Map lookup as an expression; NULL for a value that is not a key."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.create_map(*pairs)[c]


def recode_labels(
    df: DataFrame,
    mapping: Mapping[int, int] = SIX_TO_THREE,
    col: str = "label",
    out: str = "label3",
    strict: bool = True,
) -> DataFrame:
    """Recode labels; an unexpected value fails the job, or is NULL if not strict."""
    code = lookup(col, mapping)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unexpected label "), F.col(col).cast("string")))
        code = F.coalesce(code, bad.cast("int"))
    return df.withColumn(out, code)


def recode_violations(
    df: DataFrame, mapping: Mapping[int, int] = SIX_TO_THREE, col: str = "label", by=()
) -> DataFrame:
    bad = df.filter(~F.col(col).isin(list(mapping)))
    return bad.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))


def legacy_cache_label(df: DataFrame, col: str = "label", out: str = "cache_label") -> DataFrame:
    """0 becomes the ignore value 255, 1..5 become 0..4."""
    return df.withColumn(out, F.when(F.col(col) == 0, 255).otherwise(F.col(col) - 1))


def binary_label(
    df: DataFrame, include_noise: bool = False, col: str = "label", out: str = "binary"
) -> DataFrame:
    return df.withColumn(out, F.col(col).between(1, 5 if include_noise else 4).cast("int"))


def three_way_from_depth(
    df: DataFrame, label: str = "label", depth: str = "depth_mm", out: str = "label3"
) -> DataFrame:
    code = F.when(F.col(label) > 0, 1).when(F.col(depth) > 0, 2).otherwise(0)
    return df.withColumn(out, code)


def threshold_mask(df: DataFrame, col: str, thr: int = 1, out: str = "mask") -> DataFrame:
    return df.withColumn(out, (F.col(col) >= thr).cast("int"))


def depth16_to_8(df: DataFrame, col: str = "depth_mm", out: str = "depth8") -> DataFrame:
    return df.withColumn(out, colour.depth16_to_8(col))


def depth_window_normalise(
    df: DataFrame,
    object_mask: Column,
    frame: str = "frame_id",
    depth: str = "depth_mm",
    out: str = "depth_norm",
    min_px: int = 50,
    pad: float = 0.10,
) -> DataFrame:
    """Scale depth to 0..255 in a padded p2..p98 window of the object pixels.

    Too few object pixels: all rendered pixels; too few of these or no spread: 0.
    The window is per frame, so its percentiles see one frame at a time.
    """
    d, rendered = F.col(depth), F.col(depth) > 0
    obj = F.when(object_mask & rendered, d)
    every = F.when(rendered, d)
    at = F.array(F.lit(0.02), F.lit(0.98))
    win = df.groupBy(frame).agg(
        F.count(obj).alias("_no"),
        F.count(every).alias("_na"),
        F.percentile(obj, at).alias("_po"),
        F.percentile(every, at).alias("_pa"),
    )
    p = F.when(F.col("_no") >= min_px, F.col("_po")).when(F.col("_na") >= min_px, F.col("_pa"))
    win = win.select(frame, p[0].alias("_lo0"), p[1].alias("_hi0"))
    span = F.col("_hi0") - F.col("_lo0")
    win = win.select(
        frame,
        (F.col("_lo0") - pad * span).alias("_lo"),
        (F.col("_hi0") + pad * span).alias("_hi"),
        (span >= 1e-3).alias("_ok"),
    )
    share = (d - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    value = F.when(F.col("_ok") & rendered, F.rint(clipped * 255.0)).otherwise(0).cast("int")
    return df.join(win.hint("merge"), frame).withColumn(out, value).drop("_lo", "_hi", "_ok")


def filter_sets(df: DataFrame, sets: Iterable[int], col: str = "set_id") -> DataFrame:
    return df.filter(F.col(col).isin(list(sets)))


def first_n_sets(
    df: DataFrame, n: int, col: str = "set_id", order: str = "line_no"
) -> DataFrame:
    """Rows of the first n distinct sets in line order."""
    firsts = df.groupBy(col).agg(F.min(order).alias("_first"))
    keep = first_n(firsts, n, [], ["_first", col]).select(col)
    return df.join(keep, col, "left_semi")


def filter_category(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    col: str = "category",
) -> DataFrame:
    if include:
        df = df.filter(F.col(col).isin(list(include)))
    if exclude:
        df = df.filter(~F.col(col).isin(list(exclude)))
    return df


def every_nth(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, start: int = 0
) -> DataFrame:
    """Every n-th row of each group, from index ``start``."""
    i = F.col("_i")
    return row_index(df, group, order, "_i").filter((i >= start) & ((i - start) % n == 0)).drop("_i")


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k truncated evenly spaced rows per group, first and last included.

    Row i is picked when some j in 0..k-1 has floor(j (n-1) / (k-1)) = i, which is
    decided from i alone.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    rows = row_index(df, group, order, "_i").join(counts, list(group))
    i, last = F.col("_i"), F.col("_n") - 1
    gaps = F.least(F.lit(k).cast("bigint"), F.col("_n")) - 1
    j = F.floor((i * gaps + last - 1) / last)
    hit = F.when(gaps <= 0, i == 0).otherwise(j * last < (i + 1) * gaps)
    return rows.filter(hit).drop("_i", "_n")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str | Sequence[str]) -> DataFrame:
    """n rows in the order of a seeded hash of their key."""
    keys = [key] if isinstance(key, str) else list(key)
    h = df.withColumn("_h", hash_order(seed, *keys))
    return first_n(h, n, [], ["_h", *keys]).drop("_h")


def licence_filter(df: DataFrame, col: str = "licence") -> DataFrame:
    """Keep CC0, public domain and CC BY; drop non-commercial and no-derivatives."""
    s = F.lower(F.coalesce(F.col(col), F.lit("")))
    barred = s.rlike(r"(^|[^a-z])nc([^a-z]|$)|non-?commercial|noderiv|(^|[^a-z])nd([^a-z]|$)")
    return df.filter(~barred & s.rlike(r"cc0|public domain|cc[ -]by|pdm"))


def offset_set_id(df: DataFrame, k: int | Column, base: str = "base") -> DataFrame:
    """Add k to the set id inside the base name and in ``set_id`` if there is one."""
    k = F.lit(k) if isinstance(k, int) else k
    rest = F.regexp_extract(base, r"^\d+(_.*)$", 1)
    number = F.regexp_extract(base, r"^(\d+)_", 1).cast("bigint") + k
    out = df.withColumn(base, F.concat(_pad3(number), rest))
    return out.withColumn("set_id", F.col("set_id") + k) if "set_id" in df.columns else out


def _pad3(number: Column) -> Column:
    s = number.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def to_hsv(df: DataFrame) -> DataFrame:
    return df.withColumns(colour.hsv())


def colour_bin(df: DataFrame, out: str = "colour_bin") -> DataFrame:
    c = colour.hsv()
    return df.withColumn(out, colour.colour_bin(c["hue"], c["sat"], c["val"]))


def luma(df: DataFrame, out: str = "luma") -> DataFrame:
    return df.withColumn(out, colour.luma())


def hsv_range_mask(
    df: DataFrame, lo: Sequence[float], hi: Sequence[float], out: str = "mask"
) -> DataFrame:
    """1 where hue (degrees), saturation and value all lie in their closed range."""
    c = colour.hsv()
    inside = F.lit(True)
    for name, a, b in zip(("hue", "sat", "val"), lo, hi):
        inside = inside & c[name].between(float(a), float(b))
    return df.withColumn(out, inside.cast("int"))


def hsv_jitter(
    df: DataFrame,
    group: Sequence[str],
    seed: int,
    hue_deg: float = 25.0,
    sat: float = 0.25,
    val: float = 0.20,
) -> DataFrame:
    """One hue / saturation / value shift per group, a function of (seed, group)."""
    c = colour.hsv()

    def spread(tag):
        return uniform(f"{seed}/{tag}", *group) * 2.0 - 1.0

    shifted = df.withColumns(
        {
            "_h": (c["hue"] + spread("hue") * hue_deg + 360.0) % 360.0,
            "_s": F.least(F.lit(1.0), c["sat"] * (1.0 + spread("sat") * sat)),
            "_v": F.least(F.lit(1.0), c["val"] * (1.0 + spread("val") * val)),
        }
    )
    rgb = colour.hsv_to_rgb(F.col("_h"), F.col("_s"), F.col("_v"))
    return shifted.withColumns(rgb).drop("_h", "_s", "_v")
