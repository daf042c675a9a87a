"""Image sources and pixel operators, on PNG files written by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.names import alias_table
from gleanery.operators import pixels
from gleanery.sources import images, manifests


def png(x):
    h, w, _ = x.shape
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + x[r].tobytes() for r in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def leaf(seed, h=90, w=120):
    rng = np.random.default_rng(seed)
    x = np.full((h, w, 3), 235, np.uint8)
    coarse = rng.integers(0, 120, (6, 8, 3))
    x[15:-15, 20:-20] = np.clip(pixels.resize(coarse, h - 30, w - 40) + [0, 60, 0], 0, 255).astype(np.uint8)
    return x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for c, names in {"Healthy": ["a", "b"], "braunrost": ["c"], "mystery": ["d"]}.items():
        (root / c).mkdir()
        for k, n in enumerate(names):
            (root / c / f"{n}.png").write_bytes(png(leaf(ord(n))))
    good = (root / "Healthy/a.png").read_bytes()
    (root / "Healthy/text.jpg").write_bytes(b"not an image")
    (root / "Healthy/half.png").write_bytes(good[: len(good) // 2])
    (root / "Healthy/empty.png").write_bytes(b"")
    (root / "Healthy/tiny.png").write_bytes(png(leaf(1, 40, 60)[:20, :20]))
    (root / "Healthy/notes.txt").write_bytes(b"text")
    (root / "Healthy/.DS_Store").write_bytes(b"x")
    (root / "Healthy/._a.png").write_bytes(b"x")
    return str(root)


def test_inspect(spark, folder):
    got = {r["rel_path"]: r for r in images.inspect(spark, folder).collect()}
    reasons = {k.split("/")[1]: r["reason"] for k, r in got.items() if k.startswith("Healthy")}
    assert reasons == {"a.png": None, "b.png": None, "text.jpg": "corrupt or truncated", "half.png": "corrupt or truncated", "empty.png": "empty", "tiny.png": "too small", "notes.txt": "unsupported extension"}
    assert got["Healthy/a.png"]["true_format"] == "PNG" and (got["Healthy/a.png"]["width"], got["Healthy/a.png"]["height"]) == (120, 90)


def test_class_and_registry_scans(spark, folder):
    names = spark.createDataFrame([("Healthy", []), ("Brown Rust", ["braunrost"]), ("Tan Spot", [])], "name string, aliases array<string>")
    known, unknown, missing = images.class_scan(spark, folder, alias_table(names, "name"))
    assert {r["class_name"] for r in known.collect()} == {"Healthy", "Brown Rust"}
    assert [r[0] for r in unknown.collect()] == ["mystery"] and [r[0] for r in missing.collect()] == ["Tan Spot"]
    registry = spark.createDataFrame([("", "Healthy", "Healthy")], "source string, folder string, class_name string")
    parent, name = folder.rsplit("/", 1)
    registry = registry.withColumn("source", F.lit(name))
    assert images.registry_scan(spark, parent, registry, per_folder=2).count() == 2
    gone = registry.withColumn("folder", F.lit("absent"))
    with pytest.raises(FileNotFoundError):
        images.registry_scan(spark, parent, gone)
    assert images.registry_scan(spark, parent, gone, strict=False).count() == 0


def test_pixels_over_frames(spark, folder):
    rows = images.decode(spark, folder).filter("width > 32")
    x = pixels.with_hash(rows)
    got = {r["path"].rsplit("/", 1)[1]: r["phash"] for r in x.select("path", "phash").collect()}
    assert all(len(h) == 64 for h in got.values())
    smaller = {r["path"].rsplit("/", 1)[1]: r["phash"] for r in pixels.with_hash(pixels.shrunk(rows, 80)).select("path", "phash").collect()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert bits(got["a.png"], smaller["a.png"]) < 40 < bits(got["a.png"], got["b.png"])
    q = pixels.with_quality(rows).first()
    assert 0 < q["mean_brightness"] < 1 and q["sharpness"] > 0
    s = pixels.with_statistics(rows).first()
    assert s["border_brightness"] > 0.85 and all(0 <= s[c] <= 1 for c in pixels.STATISTICS)
    assert pixels.with_features(rows).first()["f6"] is not None
    assert pixels.with_features(rows, grey=True).columns[-1] == "f2"
    assert 0.2 < pixels.with_foreground_share(rows).first()["foreground_share"] < 0.7
    r = pixels.resized(rows, 32).first()
    assert (r["width"], r["height"], len(r["data"])) == (32, 32, 32 * 32 * 3)
    broken = spark.createDataFrame([(None, 2, 3, bytearray(b"x")), (-1, -1, -1, None), (2, 2, 3, bytearray(b"x"))], "width int, height int, channels int, data binary")
    assert [r["phash"] for r in pixels.with_hash(broken).collect()] == [None] * 3
    assert [r["mean_red"] for r in pixels.with_statistics(broken).collect()] == [None] * 3


def test_augmentation(spark, folder):
    rows = images.decode(spark, folder).filter("width > 32").withColumn("class_name", F.lit("Healthy"))
    rows = rows.withColumn("split", F.when(F.col("path").endswith("a.png"), "test").otherwise("train"))
    out = pixels.augmented(rows, 2).collect()
    assert len(out) == 6 and all("aug__" in r["path"] and "a.png" not in r["original"] for r in out)
    again = {r["path"]: bytes(r["data"]) for r in pixels.augmented(rows, 2).collect()}
    assert again == {r["path"]: bytes(r["data"]) for r in out}
    with pytest.raises(ValueError, match="without split"):
        pixels.augmented(rows.withColumn("split", F.lit(None).cast("string")), 1)
    assert {r["path"].rsplit("/", 1)[1] for r in pixels.harvested(rows).collect()} == {"b.png", "c.png", "d.png"}
    pale = np.full((64, 64, 3), 240, np.uint8)
    assert pixels.composite(pale, leaf(3), 1) is None


def test_upload_rules(spark):
    rows = [(False, "a.png", 1, 64, 64), (True, None, 1, 64, 64), (True, "a.txt", 1, 64, 64), (True, "a.png", 0, 64, 64), (True, "a.png", 11 << 20, 64, 64), (True, "a.png", 9, None, None), (True, "a.png", 9, 31, 64), (True, "A.JPG", 9, 32, 32)]
    df = spark.createDataFrame(rows, "m boolean, n string, s long, w int, h int")
    got = [r[0]["status"] for r in df.select(images.upload_status(*(F.col(c) for c in "mnswh"))).collect()]
    assert got == [503, 400, 415, 400, 413, 400, 400, 200]


def test_folder_conditions(spark):
    df = spark.createDataFrame([("/x/lighting=Flash/angle=/Healthy/a.png",), ("/x/a.png",)], "p string")
    got = [tuple(r[0]) for r in df.select(images.folder_conditions(F.col("p"), ["lighting", "angle"])).collect()]
    assert got == [("flash", "unspecified"), ("unspecified", "unspecified")]


def test_cache_computes_only_misses(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("sha256", F.sha2("path", 256))

    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, size long, mtime long")
    cache = str(tmp_path / "cache")
    assert images.with_cache(spark, files, cache, compute).count() == 2
    more = spark.createDataFrame([("a", 1, 1), ("b", 3, 1)], "path string, size long, mtime long")
    assert images.with_cache(spark, more, cache, compute).count() == 2
    assert seen == [2, 1]


def test_manifests(spark, tmp_path):
    row = dict.fromkeys(manifests.MANIFEST, "v") | {"in_balanced": True, "split": "train", "source_path": "b"}
    df = spark.createDataFrame([row, row | {"source_path": "a", "in_balanced": False}])
    manifests.write_manifest(df, str(tmp_path / "m"))
    back = manifests.read_csv(spark, str(tmp_path / "m"), manifests.MANIFEST).collect()
    assert [(r["source_path"], r["in_balanced"]) for r in back] == [("a", "false"), ("b", "true")]
    manifests.stage(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/balanced")).count() == 1 and spark.read.parquet(str(tmp_path / "s/full")).count() == 2
    assert manifests.read_fingerprints(spark, str(tmp_path / "none.csv")).collect() == []
    (tmp_path / "f.csv").write_text("file,sha256,phash\na,ab,cd\nb,,ef\n")
    assert [r["file"] for r in manifests.read_fingerprints(spark, str(tmp_path / "f.csv")).collect()] == ["a"]
    (tmp_path / "p.csv").write_text("file,filename,actual_class,predicted_class,confidence,correct,low_confidence,p_x\nf,f,x,x,0.5,TRUE,0,0.5\nf,f,,x,bad,1,no,\n")
    p = manifests.read_predictions(spark, str(tmp_path / "p.csv"), ["x"]).collect()
    assert (p[0]["confidence"], p[0]["correct"], p[0]["low_confidence"]) == (0.5, True, False) and p[1]["confidence"] is None
    (tmp_path / "c.csv").write_text("file,actual_class,lighting,background,distance,angle,quality,notes\na, ,Flash,,x,y,z,\n")
    c = manifests.read_conditions(spark, str(tmp_path / "c.csv")).first()
    assert (c["actual_class"], c["lighting"], c["background"]) == (None, "flash", "unspecified")
