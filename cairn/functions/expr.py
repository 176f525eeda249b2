"""Column builders: names and extensions, parents, content identifiers, sizes and other display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIDv1, raw codec, and the multihash prefixes of 32-byte digests.
CID_PREFIX = {"sha2-256": "01551220", "blake3": "01551e20"}
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Image types by extension, and the type of everything else.
IMAGE_TYPES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "svg": "image/svg+xml",
    "avif": "image/avif",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}
OTHER_TYPE = "application/octet-stream"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last component; empty without a dot."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def parents(path: Column) -> Column:
    """Every proper ancestor of an absolute path except the root, outermost first."""
    up = lambda parts: F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return once(F.split(path, "/"), up)


def relative_parents(rel: Column) -> Column:
    """Every proper ancestor of a relative path, outermost first."""
    up = lambda parts: F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return once(F.split(rel, "/"), up)


def virtual_path(prefix: str, rel: Column) -> Column:
    """Where a scanned entry lives in the catalog; the scan's root is the prefix itself, or nothing under the root prefix."""
    slashed = F.translate(rel, "\\", "/")
    return F.when(slashed == "", F.lit(prefix or None).cast("string")).otherwise(F.concat(F.lit(f"{prefix}/"), slashed))


def once(value: Column, f) -> Column:
    """``f`` of a value that's bound as a lambda's variable: computed once, and no column is referred to from inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _base32(nibbles: Column) -> Column:
    """Hex digits (72, padded to 75) in groups of 20 bits, as base32 text with the multibase mark."""
    five = lambda h: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.lpad(F.conv(F.substring(h, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    shown = once(F.rpad(nibbles, 75, "0"), lambda h: F.translate(F.array_join(five(h), ""), DIGITS32, BASE32))
    return F.concat(F.lit("b"), F.substring(shown, 1, 58))


def cid_from_hex(digest: Column, profile: str = "sha2-256") -> Column:
    """A digest in hex as CIDv1 text: multibase base32, lower case."""
    return _base32(F.upper(F.concat(F.lit(CID_PREFIX[profile]), digest)))


def cid_bytes_to_string(cid: Column) -> Column:
    """36 bytes to text, whatever the hash."""
    return _base32(F.hex(cid))


def cid_string_to_bytes(cid: Column) -> Column:
    """Text to 36 bytes; an error if it isn't a CIDv1 of a 32-byte digest."""
    four = lambda x: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.lpad(F.conv(F.substring(x, i * 4 + 1, F.lit(4)), 32, 16), 5, "0"))
    body = once(F.rpad(F.translate(F.substring(cid, 2, 58), BASE32, DIGITS32), 60, "0"), lambda x: F.array_join(four(x), ""))
    good = cid.rlike(r"^b[a-z2-7]{58}\z")
    return F.when(good, F.unhex(F.substring(body, 1, 72))).otherwise(F.raise_error(F.concat(F.lit("invalid CID: "), cid)).cast("binary"))


def content_cid(content: Column) -> Column:
    """CID of content under the SHA-256 profile, computed by the JVM."""
    return cid_from_hex(F.sha2(content, 256), "sha2-256")


def saved(original: Column, stored: Column) -> Column:
    return F.greatest(original - stored, F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, rounded half up to one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(part.cast("double") / whole * 100 * 10) / 10).otherwise(F.lit(0.0))


def space_saved(original: Column, stored: Column) -> Column:
    """Saved share in percent; null where nothing was stored."""
    return F.when(original > 0, (1 - stored.cast("double") / original) * 100)


def format_size(size: Column) -> Column:
    """Bytes as B, or as KB, MB or GB with one decimal (half to even)."""
    one = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / (1 << power), 1))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, one(10, "KB")).when(size < 1 << 30, one(20, "MB")).otherwise(one(30, "GB"))


def pad_left(text: Column, width: int = 10) -> Column:
    return F.lpad(text, F.greatest(F.char_length(text), F.lit(width)), F.lit(" "))


def octal(mode: Column) -> Column:
    return F.conv(mode.cast("string"), 10, 8)


def shown_time(seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit("—")).otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def compression_ratio(original: Column, stored: Column) -> Column:
    return F.when(original > 0, F.round(stored.cast("double") / original * 100, 1))


def short_cid(cid: Column) -> Column:
    return F.substring(cid, 1, 20)


def image_type(path: Column) -> Column:
    pairs = [F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit(OTHER_TYPE))


def log_name(prefix: str) -> str:
    """The error log's name for a target prefix."""
    inner = prefix.strip("/").replace("/", "_")
    return f"errors_{''.join(c if c.isalnum() or c in '-_' else '_' for c in inner) or 'root'}.log"
