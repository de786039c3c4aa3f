"""String, time and number helpers as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from sembla.session import ship_package


def parse_seconds(text: Column) -> Column:
    """``[[hh:]mm:]ss.d`` as seconds; null where it isn't of that form."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)
    good = F.trim(text).rlike(r"^(\d+:){0,2}\d+(\.\d+)?$")
    get = lambda i: F.try_element_at(parts, F.lit(i)).cast("double")
    return F.when(good, F.when(n == 3, get(1) * 3600 + get(2) * 60 + get(3)).when(n == 2, get(1) * 60 + get(2)).otherwise(get(1)))


def format_seconds(seconds: Column) -> Column:
    """hh:mm:ss.fff, rounded to milliseconds; a minus sign before negative times."""
    ms = F.round(F.abs(seconds) * 1000).cast("long")
    sign = F.when(seconds < 0, "-").otherwise("")
    return F.concat(sign, F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000))


def parse_fraction(text: Column) -> Column:
    """``a/b`` or a number; null for a zero divisor or another form."""
    parts = F.split(F.trim(text), "/")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, a).when((F.size(parts) == 2) & (b != 0), a / b)


def parse_bool(text: Column) -> Column:
    """true, yes, on, 1 / false, no, off, 0 in any case; null otherwise."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "on", "1"), True).when(t.isin("false", "no", "off", "0"), False)


def trim_decimals(text: Column) -> Column:
    """Trailing zeros of a fraction, and a point left alone, removed."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def disk_size(size: Column) -> Column:
    """Bytes as a number with one decimal and a unit of 1024."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = None
    for i, u in reversed(list(enumerate(units))):
        text = F.format_string(f"%.1f {u}", size.cast("double") / 1024.0**i) if i else F.format_string(f"%d {u}", size.cast("long"))
        out = F.when(size >= 1024.0**i, text) if out is None else out.when(size >= 1024.0**i, text)
    return out.otherwise(F.format_string("%d B", size.cast("long")))


def fixed_decimals(value: Column, decimals: int) -> Column:
    """A double with so many decimals, its exact binary value rounded as printf does; format_string rounds its shortest decimal form instead."""
    ship_package()

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{decimals}f}" for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    # asNondeterministic: run once, not again for the filter that explode asks for
    return F.arrow_udf(run, "string").asNondeterministic()(value.cast("double"))


def base_name(path: Column) -> Column:
    """The file name of a path."""
    return F.regexp_replace(path, r"^.*/", "")


def extension(path: Column) -> Column:
    """The lower-case extension of a path, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(""))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."[:n]))).otherwise(text)


def split_brackets(text: str, separator: str = ",") -> list[str]:
    """Parts of a text at separators outside round, square and curly brackets."""
    parts, depth, part = [], 0, ""
    for ch in text:
        depth += (ch in "([{") - (ch in ")]}")
        if ch == separator and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    return [*parts, part]


def interval_bins(total: int, parts: int) -> list[int]:
    """``parts`` whole sizes that sum to total and differ by at most 1, the error spread evenly."""
    return [total * (i + 1) // parts - total * i // parts for i in range(parts)]


def natural_key(name: Column) -> Column:
    """A sort key in which numbers inside a name count by value: digits are padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")
