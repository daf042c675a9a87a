"""Image operators over decoded rows (width, height, channels, data as Spark's image source gives them).

NumPy over Arrow batches; every function gives null where the data can't be read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordering import before_by_sort
from gleanery.runtime import cut

STATISTICS = ["mean_red", "mean_green", "mean_blue", "brightness", "saturation", "border_brightness"]
STYLES = {"soil": (110, 72, 46), "vegetation": (62, 96, 44), "sky": (150, 170, 195), "straw": (170, 150, 95)}  # fixed values
IMAGE = "struct<width:int, height:int, channels:int, data:binary>"


def to_array(width: int, height: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB bytes (height, width, 3); null for broken rows. The source stores BGR(A) or grey."""
    if data is None or not width or not height or width < 0 or channels not in (1, 3, 4) or len(data) != width * height * channels:
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def to_row(x: np.ndarray) -> dict:
    x = np.clip(x, 0, 255).astype(np.uint8)
    return {"width": x.shape[1], "height": x.shape[0], "channels": 3, "data": x[..., ::-1].tobytes()}


def _weights(n: int, to: int) -> np.ndarray:
    """(to, n) triangle filter weights: interpolation upwards, area-like averaging downwards."""
    scale = n / to
    reach = max(scale, 1.0)
    centre = (np.arange(to)[:, None] + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(n)[None, :] + 0.5 - centre) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize without keeping the aspect."""
    rows = np.tensordot(_weights(x.shape[0], height), x.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(_weights(x.shape[1], width), rows, axes=(1, 1)), 0, 1)


def hsv_value_saturation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and saturation in [0, 1]."""
    top, low = x.max(axis=-1) / 255.0, x.min(axis=-1) / 255.0
    return top, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0.0)


def perceptual_hash(x: np.ndarray, size: int = 16) -> str:
    """pHash: grey, 4 * size squared, two-dimensional DCT, low block above its median."""
    n = 4 * size
    grey = resize(np.rint(x @ np.array([0.299, 0.587, 0.114]))[..., None], n, n)[..., 0]
    k = np.arange(n)
    dct = 2 * np.cos(np.pi * k[:size, None] * (2 * k[None, :] + 1) / (2 * n))
    low = dct @ grey @ dct.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def quality(x: np.ndarray) -> tuple[float, float, float, float]:
    """Brightness mean and deviation, variance of the Laplacian, mean saturation."""
    light = x.mean(axis=2) / 255.0
    curved = np.zeros(1)
    if light.shape[0] > 2 and light.shape[1] > 2:
        curved = np.diff(light, 2, axis=0)[:, 1:-1] + np.diff(light, 2, axis=1)[1:-1]
    _, saturation = hsv_value_saturation(x)
    return tuple(float(v) for v in (light.mean(), light.std(), curved.var(), saturation.mean()))


def statistics(x: np.ndarray, side: int = 64) -> tuple[float, ...]:
    """`STATISTICS` of a thumbnail."""
    thumb = np.rint(resize(x, side, side))
    inner = np.zeros((side, side), bool)
    inner[1:-1, 1:-1] = True
    per_channel = thumb.reshape(-1, 3).mean(axis=0) / 255.0
    of_pixels = [v.mean() for v in hsv_value_saturation(thumb)]
    return (*per_channel, *of_pixels, thumb[~inner].mean() / 255.0)


def features(x: np.ndarray, side: int = 32, grey: bool = False) -> list[float]:
    """Means and deviations of the channels and the mean of all: 7 numbers in colour, 3 in grey."""
    small = np.rint(resize(x, side, side)) / 255.0
    if grey:
        small = (small @ np.array([0.299, 0.587, 0.114]))[..., None]
    return [*small.mean(axis=(0, 1)), *small.std(axis=(0, 1)), float(small.mean())]


def foreground(x: np.ndarray, bright: float = 0.70, pale: float = 0.35) -> np.ndarray:
    """True off the background, which is bright and unsaturated at once."""
    value, saturation = hsv_value_saturation(x)
    return ~((value > bright) & (saturation < pale))


def downsample(x: np.ndarray, long_edge: int) -> np.ndarray:
    """Smaller if the long edge is longer, else as it is."""
    h, w = x.shape[:2]
    if max(h, w) <= long_edge:
        return x
    scale = long_edge / max(h, w)
    return resize(x, max(1, round(h * scale)), max(1, round(w * scale)))


#: Of each style: waves over the side, across and down, and how much of the light they take. Own choices.
WAVES = {"soil": (30, 30, 0.30), "vegetation": (24, 3, 0.35), "sky": (1, 2, 0.15), "straw": (20, 12, 0.30)}


def procedural_background(seed: int, side: int, waves: int = 24) -> np.ndarray:
    """A texture in one of the styles: plane waves of seeded direction, length and phase over its colour."""
    rng = np.random.default_rng(seed)
    style = list(STYLES)[int(rng.integers(len(STYLES)))]
    across, down, depth = WAVES[style]
    at = np.arange(side) / side
    turns_x, turns_y = rng.uniform(-across, across, waves), rng.uniform(-down, down, waves)
    phase = rng.uniform(0.0, 2 * np.pi, waves)
    # cos(a + b) as two outer products: all waves at once.
    ax, ay = 2 * np.pi * np.outer(turns_x, at), 2 * np.pi * np.outer(turns_y, at) + phase[:, None]
    field = (np.cos(ay).T @ np.cos(ax) - np.sin(ay).T @ np.sin(ax)) / np.sqrt(waves)
    shade = 1.0 + depth * field[..., None] * rng.uniform(0.7, 1.0, 3)
    return np.clip(np.array(STYLES[style], float) * shade, 0, 255)


def corners(x: np.ndarray) -> list[np.ndarray]:
    """Patches of a third of either side from where the subject hardly is."""
    high, wide = x.shape[0] // 3, x.shape[1] // 3
    if not high or not wide:
        return []
    return [x[rows, columns] for rows in (slice(high), slice(-high, None)) for columns in (slice(wide), slice(-wide, None))]


def composite(x: np.ndarray, background: np.ndarray, seed: int, scale: tuple[float, float] = (0.5, 1.0), least: float = 0.04) -> np.ndarray | None:
    """The subject, smaller and shifted by the seed, before a background of the image's own size.

    Each pixel of the result looks up where it comes from in the image; what falls outside of it
    or off its subject is background. Null where the subject is under `least` of the image.
    """
    subject = foreground(x)
    if subject.mean() < least:
        return None
    rng = np.random.default_rng(seed)
    h, w = subject.shape
    size, down, right = rng.uniform(*scale), *rng.uniform(0.0, 1.0, 2)
    rows = np.floor((np.arange(h) - down * (1.0 - size) * h) / size).astype(int)
    columns = np.floor((np.arange(w) - right * (1.0 - size) * w) / size).astype(int)
    inside = ((rows >= 0) & (rows < h))[:, None] & ((columns >= 0) & (columns < w))[None, :]
    pick = np.ix_(np.clip(rows, 0, h - 1), np.clip(columns, 0, w - 1))
    return np.where((inside & subject[pick])[..., None], x[pick], resize(background, h, w))


def _over(compute, kind: str):
    """A pandas UDF of an image's four columns."""

    @F.pandas_udf(kind)
    def run(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for w, h, c, d in zip(width, height, channels, data):
            x = None if pd.isna(w) or pd.isna(h) or pd.isna(c) else to_array(int(w), int(h), int(c), d)
            out.append(None if x is None else compute(x))
        return pd.Series(out, dtype=object)

    return run


def _image(compute):
    """A pandas UDF from an image's four columns to those of another."""

    @F.pandas_udf(IMAGE)
    def run(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("width", "height", "channels", "data"))
        out = []
        for w, h, c, d in zip(width, height, channels, data):
            x = None if pd.isna(w) or pd.isna(h) or pd.isna(c) else to_array(int(w), int(h), int(c), d)
            out.append(none if x is None else to_row(np.rint(compute(x))))
        return pd.DataFrame(out, columns=list(none))

    return run


def _columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ("width", "height", "channels", "data")]


def with_hash(images: DataFrame, size: int = 16) -> DataFrame:
    return images.withColumn("phash", _over(lambda x: perceptual_hash(x, size), "string")(*_columns()))


def _struct(compute, names: list[str]):
    @F.pandas_udf("array<double>")
    def run(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for w, h, c, d in zip(width, height, channels, data):
            x = None if pd.isna(w) or pd.isna(h) or pd.isna(c) else to_array(int(w), int(h), int(c), d)
            out.append(None if x is None else [float(v) for v in compute(x)])
        return pd.Series(out, dtype=object)

    return lambda df, to: df.withColumn(to, run(*_columns())).withColumns({n: F.get(F.col(to), F.lit(k)) for k, n in enumerate(names)}).drop(to)


def with_quality(images: DataFrame) -> DataFrame:
    return _struct(quality, ["mean_brightness", "brightness_std", "sharpness", "mean_saturation"])(images, "__q")


def with_statistics(images: DataFrame) -> DataFrame:
    return _struct(statistics, STATISTICS)(images, "__s")


def with_features(images: DataFrame, side: int = 32, grey: bool = False) -> DataFrame:
    names = [f"f{k}" for k in range(3 if grey else 7)]
    return _struct(lambda x: features(x, side, grey), names)(images, "__f")


def with_foreground_share(images: DataFrame) -> DataFrame:
    return _struct(lambda x: [foreground(x).mean()], ["foreground_share"])(images, "__m")


def resized(images: DataFrame, side: int) -> DataFrame:
    """Rows with the image resized to a square."""
    return _replace(images, _image(lambda x: resize(x, side, side)))


def shrunk(images: DataFrame, long_edge: int) -> DataFrame:
    """Rows downsampled to a long edge; the JPEG round trip of it needs an encoder that isn't here."""
    return _replace(images, _image(lambda x: downsample(x, long_edge)))


def _replace(images: DataFrame, made) -> DataFrame:
    rest = [c for c in images.columns if c not in ("width", "height", "channels", "data")]
    return images.withColumn("__i", made(*_columns())).select(*rest, "__i.*")


def harvested(images: DataFrame) -> DataFrame:
    """Corner patches of the train split, never of another: (path, patch, width, height, channels, data)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, w, h, c, d in zip(pdf["path"], pdf["width"], pdf["height"], pdf["channels"], pdf["data"]):
                x = to_array(w, h, c, d)
                rows += [{"path": p, "patch": k, **to_row(y)} for k, y in enumerate(corners(x) if x is not None else [])]
            yield pd.DataFrame(rows, columns=["path", "patch", "width", "height", "channels", "data"])

    train = images.filter("split = 'train'").select("path", "width", "height", "channels", "data")
    return train.mapInPandas(run, "path string, patch int, width int, height int, channels int, data binary")


PRODUCT = "aug__"


def is_product(path: Column) -> Column:
    """Whether a file is a product of augmentation, by its name."""
    return F.element_at(F.split(path, "/"), -1).startswith(PRODUCT)


def product_counts(images: DataFrame) -> DataFrame:
    """(class_name, originals, products)."""
    made = is_product(F.col("path"))
    return images.groupBy("class_name").agg(F.count_if(~made).alias("originals"), F.count_if(made).alias("products"))


def without_products(images: DataFrame) -> DataFrame:
    return images.filter(~F.coalesce(is_product(F.col("path")), F.lit(False)))


def augmented(images: DataFrame, copies: int, seed: int = 42, patches: DataFrame | None = None) -> DataFrame:
    """Composites of train originals, `copies` each, with their lineage.

    Backgrounds are those of `patches` (rows of `harvested`), dealt by the seed, or without
    these, or if there are none, procedural ones. Refuses rows without a split: augmentation comes
    after splitting. Prior products aren't augmented again. Images without enough foreground
    give none.
    """
    if not images.filter("split is null").isEmpty():
        raise ValueError("images without split")
    originals = without_products(images.filter("split = 'train'"))
    plan = fan_out(originals.select("path", "class_name", *("width", "height", "channels", "data")), "path", copies, seed)
    many = 0
    if patches is not None:
        numbered = before_by_sort(patches.withColumn("__all", F.lit(0)), ["__all"], ["path", "patch"], F.lit(1), "__k")
        numbered = cut(numbered.select("__k", F.struct("width", "height", "channels", "data").alias("background")))
        many = numbered.count()
    if many:
        plan = plan.withColumn("__k", F.col("seed") % F.lit(many)).join(numbered, "__k").drop("__k")
    else:
        plan = plan.withColumn("background", F.lit(None).cast(IMAGE))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x = to_array(r.width, r.height, r.channels, r.data)
                behind = None if r.background is None else to_array(*(r.background[c] for c in ("width", "height", "channels", "data")))
                if behind is None:
                    behind = procedural_background(r.seed & 0x7FFFFFFF, 256)
                y = None if x is None else composite(x, behind, r.seed & 0x7FFFFFFF)
                if y is not None:
                    rows.append({"path": r.augmented, "original": r.path, "class_name": r.class_name, "copy_index": r.copy_index, **to_row(y)})
            yield pd.DataFrame(rows, columns=["path", "original", "class_name", "copy_index", "width", "height", "channels", "data"])

    return plan.mapInPandas(run, "path string, original string, class_name string, copy_index int, width int, height int, channels int, data binary")


def fan_out(rows: DataFrame, path: str, copies: int, seed: int = 42) -> DataFrame:
    """Each row once for each copy, with the copy's name and seed."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    x = rows.withColumn("copy_index", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 0 else F.lit(0))
    x = x if copies > 0 else x.limit(0)
    name = F.concat(folder, F.lit(PRODUCT), F.col("copy_index").cast("string"), F.lit("__"), stem, F.lit(".png"))
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(path), F.col("copy_index").cast("string")), 256), 1, 15)
    return x.withColumn("augmented", name).withColumn("seed", F.conv(digits, 16, 10).cast("bigint"))
