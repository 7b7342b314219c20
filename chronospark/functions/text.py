"""Text of cells: CSV escapes, numbers, sizes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_escape(v: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; quotes doubled."""
    return F.when(v.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def render_double(v: Column) -> Column:
    """Integral finite values without decimals."""
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(9.2e18))
    return F.when(finite & (v == F.rint(v)), v.try_cast("long").cast("string")).otherwise(v.cast("string"))


def decimal_sep(text: Column, numeric: Column, sep: str = ",") -> Column:
    """Another decimal separator, in single numbers only."""
    return F.when(numeric, F.translate(text, ".", sep)).otherwise(text)


def name_path(name: Column, sep: str = ".") -> Column:
    """A namespaced name as a path of groups."""
    return F.concat(F.lit("/"), F.replace(name, F.lit(sep), F.lit("/")))


def name_parts(name: Column, sep: str = ".") -> Column:
    return F.split(name, "\\Q" + sep + "\\E")


def fmt_bytes(n: Column) -> Column:
    k, m, g = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n >= g, F.format_string("%.2f GiB", n / g)).when(n >= m, F.format_string("%.2f MiB", n / m))
        .when(n >= k, F.format_string("%.2f KiB", n / k)).otherwise(F.format_string("%d B", n.cast("long")))
    )


def mask_pattern(mask: str) -> str:
    """A mask with * and ? as an anchored regular expression in lower case."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c for c in mask.lower())
    return f"^{out}$"
