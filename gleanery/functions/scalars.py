"""Column expressions: fingerprints, paths, names, prediction arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What file scans skip and accept.
METADATA_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep"]
METADATA_FOLDERS = ["__MACOSX", ".AppleDouble", ".Spotlight-V100", ".Trashes", "$RECYCLE.BIN", "System Volume Information"]
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_words(digits: Column, words: int = 4) -> Column:
    """Hex digits as signed 64-bit words; short values are filled with zeros."""
    return F.array(*(F.conv(F.rpad(F.substring(digits, 16 * k + 1, 16), 16, "0"), 16, -10).cast("bigint") for k in range(words)))


def word_distance(a: Column, b: Column, words: int = 4) -> Column:
    """Differing bits of two word arrays."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of up to 64 digits; an error if lengths differ."""
    apart = word_distance(hash_words(a), hash_words(b))
    return F.when(F.length(a) == F.length(b), apart).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("hashes of different length")).cast("int"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_metadata(path: Column) -> Column:
    """Operating-system bookkeeping: fixed names, ``._`` files, fixed folders."""
    name = file_name(path)
    return name.isin(METADATA_NAMES) | name.startswith("._") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, METADATA_FOLDERS)))


def relative(path: Column, root: str) -> Column:
    """`path` below `root`, or as it is if elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def safe_part(text: Column) -> Column:
    """Slashes as underscores, other unsafe runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "/", "_"), r"[^A-Za-z0-9._\-]+", "-"), "^-+|-+$", "")


def staged_name(source: Column, path: Column, converted: Column) -> Column:
    """``<source>__<folder>__<stem><ext>``; converted files carry the new extension."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    ext = F.when(converted.isNotNull(), F.regexp_extract(converted, r"->(\w+)$", 1)).otherwise(extension(path))
    return F.concat(source, F.lit("__"), safe_part(folder), F.lit("__"), safe_part(stem), F.lit("."), ext)


def stable_seed(*parts: Column) -> Column:
    """Unsigned 64-bit number of joined parts."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def true_format(content: Column) -> Column:
    """Container format by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
        .when(head.startswith("424D"), "BMP")
        .when(head.startswith("47494638"), "GIF")
    )


def percent(share: Column, digits: int = 1) -> Column:
    return F.when(share.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", share * 100))


def reported(value: Column, digits: int) -> Column:
    """A number of a report: rounded half to even, as the language of the reports does it."""
    return F.bround(value.cast("double"), digits)


def megapixels(width: Column, height: Column) -> Column:
    return width * height / F.lit(1e6)


def aspect(width: Column, height: Column) -> Column:
    """Width over height; 0 for height 0."""
    return F.when(height == 0, 0.0).otherwise(width / height)


# ---- prediction arithmetic over an array of probabilities in label order


def top_index(p: Column) -> Column:
    """0-based index of the largest probability, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    """Normalised entropy, probabilities clipped to [1e-12, 1]."""
    terms = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s - x * F.ln(x))
    return total / F.when(F.size(p) > 1, F.ln(F.size(p))).otherwise(1.0)


def margin(p: Column) -> Column:
    """Largest less second probability; 1 for one class."""
    ranked = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))).otherwise(1.0)


def uncertainty_reasons(p: Column, low: float = 0.60, high_entropy: float = 0.80, thin_margin: float = 0.10, enabled: bool = True) -> Column:
    """Why a prediction is uncertain; without `enabled` only low confidence counts."""
    reasons = [F.when(F.array_max(p) < low, "low_confidence")]
    if enabled:
        reasons = [F.when(entropy(p) > high_entropy, "high_entropy"), F.when(margin(p) < thin_margin, "thin_margin"), *reasons]
    return F.array_compact(F.array(*reasons))


def ranked_distribution(p: Column, labels: list[str]) -> Column:
    """(class, probability) structs, largest first, equals in label order."""
    zipped = F.transform(p, lambda x, i: F.struct((-x).alias("o"), i.alias("i"), F.element_at(F.array(*map(F.lit, labels)), i + 1).alias("class"), x.alias("probability")))
    return F.transform(F.array_sort(zipped), lambda s: F.struct(s["class"].alias("class"), s["probability"].alias("probability")))
