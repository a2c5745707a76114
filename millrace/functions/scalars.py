"""Column functions: labels, hashes, names, URLs and text pieces, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelled out so that every engine reads it alike.
SPACE = "[ \\t\\n\\r\\f\\x0B]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash_label(key: Column | str, n: int) -> Column:
    """md5(key), read as one big-endian number, modulo n: computed from two 64-bit halves."""
    digest = F.md5(_c(key).cast("string").cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")
    shift = (1 << 64) % n
    return (((half(1) % n) * F.lit(shift) + half(17) % n) % n).cast("int")


def range_label(key: Column | str, low: float, high: float, n: int) -> Column:
    """Nearest of n evenly spaced points (half to even): the outer labels get half a range each."""
    return F.rint((_c(key).cast("double") - F.lit(float(low))) / F.lit(float(high - low)) * F.lit(float(n - 1))).cast("int")


def hexhash(c: Column | str) -> Column:
    """First two hexadecimal digits of the md5."""
    return F.substring(F.md5(_c(c).cast("string").cast("binary")), 1, 2)


def words(c: Column | str) -> Column:
    """Array of white-space separated words, without empty ones."""
    return F.filter(F.split(_c(c), SPACE), lambda w: w != "")


def clean_words(c: Column | str) -> Column:
    """Lower-cased words after ASCII punctuation is taken out."""
    return words(F.lower(F.translate(_c(c), PUNCTUATION, "")))


def letters(c: Column | str, low: str = "a", high: str = "z") -> Column:
    """Array of the lower-cased text's characters between two bounds."""
    return F.filter(F.split(F.lower(_c(c)), ""), lambda x: (x >= low) & (x <= high))


def safe_name(c: Column | str) -> Column:
    """Characters that object names may not hold become underscores."""
    return F.regexp_replace(_c(c), "[^A-Za-z0-9_@:-]", "_")


def compliant_name(c: Column | str) -> Column:
    """Names for file systems that refuse colons."""
    return F.translate(_c(c), ":", "_")


def blob_name(url: Column | str) -> Column:
    """Last path part of a URL, up to a dollar sign."""
    return F.element_at(F.split(F.element_at(F.split(_c(url), "/"), -1), "\\$"), 1)


def job_name(url: Column | str) -> Column:
    """Last path part but one, null where there is none."""
    return F.try_element_at(F.split(_c(url), "/"), F.lit(-2))


def scheme(url: Column | str) -> Column:
    """Part before '://', empty where there is none."""
    return F.when(F.instr(_c(url), "://") > 0, F.substring_index(_c(url), "://", 1)).otherwise(F.lit(""))


def rest(url: Column | str) -> Column:
    """Part after '://', else the whole."""
    u = _c(url)
    return F.when(F.instr(u, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(url)) if isinstance(url, str) else F.substring_index(u, "://", -1)).otherwise(u)


def net_location(url: Column | str) -> Column:
    """Host with its port, of a URL with a scheme."""
    return F.when(F.instr(_c(url), "://") > 0, F.substring_index(rest(url), "/", 1)).otherwise(F.lit(""))


def url_path(url: Column | str) -> Column:
    """What follows the first slash after the host, of a URL with a scheme."""
    r = rest(url)
    return F.when((F.instr(_c(url), "://") > 0) & (F.instr(r, "/") > 0), F.regexp_replace(r, "^[^/]*/", "")).when(F.instr(_c(url), "://") > 0, F.lit("")).otherwise(_c(url))


def format_size(n: Column | str) -> Column:
    """Whole units of bytes to terabytes, the largest below 1024."""
    x = _c(n).cast("double")
    out = None
    for k, unit in reversed(list(enumerate(("bytes", "KB", "MB", "GB", "TB")))):
        text = F.concat(F.floor(x / F.lit(float(1024**k))).cast("string"), F.lit(f" {unit}"))
        out = text if out is None else F.when(x < F.lit(float(1024 ** (k + 1))), text).otherwise(out)
    return out


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
