"""Keys, search folding, cell addresses and Excel dates."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that search folding joins.
FOLD_SPACE = "\u0009-\u000d\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_FOLD = re.compile(f"[{FOLD_SPACE}]+")
_JS_TRIM = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- stable keys -------------------------------------------------------------------------


def py_normalize_key(key: str, form: str = "NFC", case_fold: bool = False, separator: str = "posix", trim: bool = True) -> str:
    if separator == "posix":
        key = key.replace("\\", "/")
    if trim:
        key = key.strip("/")
    put = (lambda s: s) if form == "none" else (lambda s: unicodedata.normalize(form, s))
    key = put(key)
    return put(key.lower()) if case_fold else key


def _unicode_key(key: pa.Array, form: pa.Array, fold: pa.Array) -> pa.Array:
    return pa.array(
        [None if k is None else py_normalize_key(k, f or "none", bool(c), "as-is", False) for k, f, c in zip(key.to_pylist(), form.to_pylist(), fold.to_pylist())],
        pa.string(),
    )


def _udf(fn, *columns: Column) -> Column:
    """Declared where it is used, for a Python worker that imports this module has no session."""
    return F.arrow_udf(fn, "string")(*columns)


def normalize_key(key: Column | str, form: Column | str, case_fold: Column | str, separator: Column | str, trim: Column | str) -> Column:
    """A stable key under the policy that the source's row holds.

    In order: backslashes become slashes, outer slashes go, the Unicode form,
    and, for a folding source, lower case and the form again. Only the last
    two need Python, since Spark has no Unicode normalisation.
    """
    k = _c(key)
    k = F.when(_c(separator) == "posix", F.translate(k, "\\", "/")).otherwise(k)
    k = F.when(_c(trim), F.regexp_replace(k, "^/+|/+$", "")).otherwise(k)
    return _udf(_unicode_key, k, _c(form), _c(case_fold))


def basename(key: Column | str) -> Column:
    return F.element_at(F.split(_c(key), "/"), -1)


def extension(key: Column | str) -> Column:
    """In lower case, without the dot; empty if the name has none or only a leading dot."""
    return F.lower(F.regexp_extract(basename(key), r"^.+\.([^.]*)$", 1))


# --- search ------------------------------------------------------------------------------


def py_fold(text: str) -> str:
    return _FOLD.sub(" ", unicodedata.normalize("NFKC", text)).strip(_JS_TRIM).lower()


def py_view_fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def _fold_all(text: pa.Array) -> pa.Array:
    return pa.array([py_fold(t or "") for t in text.to_pylist()], pa.string())


def _view_fold_all(text: pa.Array) -> pa.Array:
    return pa.array([py_view_fold(t or "") for t in text.to_pylist()], pa.string())


def search_fold(text: Column | str) -> Column:
    """NFKC, white space to single spaces, trimmed, lower case; zero-width characters stay. Null is empty."""
    return _udf(_fold_all, _c(text))


def view_fold(text: Column | str) -> Column:
    """NFKC and lower case only. Null is empty."""
    return _udf(_view_fold_all, _c(text))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(query: str) -> str:
    """A LIKE pattern for a substring, with ``!`` as the escape character."""
    return "%" + re.sub(r"([%_!])", r"!\1", query) + "%"


def required_text(value: object, name: str = "text", most: int = 4096) -> str:
    if not isinstance(value, str) or not value.strip() or len(value.strip()) > most:
        raise ValueError(f"{name} must be a text of 1 to {most} characters")
    return value.strip()


# --- cell addresses ----------------------------------------------------------------------

_ADDRESS = r"^([A-Z]{1,3})([1-9][0-9]*)$"
LAST_COLUMN, LAST_ROW = 16384, 1048576


def address_row(address: Column | str, last_row: int | None = LAST_ROW) -> Column:
    """Null if the address isn't one of a sheet, whose rows don't end if ``last_row`` is None."""
    return _coordinates(address, last_row)[0]


def address_column(address: Column | str, last_row: int | None = LAST_ROW) -> Column:
    return _coordinates(address, last_row)[1]


def _coordinates(address: Column | str, last_row: int | None) -> tuple[Column, Column]:
    a = _c(address)
    letters = F.regexp_extract(a, _ADDRESS, 1)
    row = F.regexp_extract(a, _ADDRESS, 2).try_cast("bigint")
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    fine = a.rlike(_ADDRESS) & (column <= LAST_COLUMN) & (row.isNotNull() if last_row is None else row <= last_row)
    return F.when(fine, row), F.when(fine, column)


def cell_address(row: Column | str, column: Column | str, last_row: int | None = LAST_ROW) -> Column:
    """The inverse; null outside a sheet."""
    r, c = _c(row).cast("bigint"), _c(column).cast("bigint")
    letter = lambda n: F.chr(n + 65)
    third = (c - 1) % 26
    rest = F.floor((c - 1) / 26)
    second = F.when(rest > 0, letter((rest - 1) % 26)).otherwise("")
    rest2 = F.floor((rest - 1) / 26)
    first = F.when(rest2 > 0, letter((rest2 - 1) % 26)).otherwise("")
    fine = c.between(1, LAST_COLUMN) & (r >= 1 if last_row is None else r.between(1, last_row))
    return F.when(fine, F.concat(first, second, letter(third), r.cast("string")))


def py_coordinates(address: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6})", address)
    if not m:
        raise ValueError(f"not a cell address: {address!r}")
    column = 0
    for x in m[1]:
        column = column * 26 + ord(x) - 64
    if column > LAST_COLUMN or int(m[2]) > LAST_ROW:
        raise ValueError(f"cell address outside a sheet: {address!r}")
    return int(m[2]), column


# --- number formats and dates --------------------------------------------------------------

# The number formats that files refer to by id alone.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00",
    5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Ids whose format depends on the locale.
LOCALE_FORMATS = (*range(23, 37), *range(41, 45), *range(50, 59))
_LITERALS = r"\[[^\]]*\]|\"[^\"]*\"|\\."


def is_date_format(code: Column | str) -> Column:
    """Whether a letter of a date or time is left without bracketed, quoted and escaped parts."""
    return F.regexp_replace(_c(code), _LITERALS, "").rlike("(?i)[ymdhs]")


def py_is_date_format(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(_LITERALS, "", code), re.IGNORECASE))


LAST_SERIAL = 2958465
# How a built-in format without a code is named, and what the day that only Excel has shows as.
BUILTIN_NAME = "組み込み書式"
ONLY_IN_EXCEL = "1900-02-29（Excelにしか存在しない日）"


def excel_date(value: Column | str, value_type: Column | str, number_format: Column | str, date_system: Column | str) -> Column:
    """How a stored serial number shows under a date format; empty where it is none.

    Serials count days from 1899-12-31, with a 29 February 1900 that never was
    (serial 60), or from 1904-01-01; fractions are rounded to seconds. ``m``
    means minutes where the format has hours or seconds, else months. Serial 0 of the
    1900 system is a time without a date, and a time of zero beside a date isn't shown.
    """
    late = _c(date_system) == "1904"
    fine = _c(value_type) == "n"
    serial = _c(value).try_cast("double")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")

    raw = F.coalesce(_c(number_format), F.lit(""))
    named = F.regexp_extract(raw, f"^{BUILTIN_NAME} ([0-9]+)", 1).try_cast("int")
    bare = F.regexp_replace(raw, r"\[[^\]]*\]|\"[^\"]*\"|\.", "")

    # Each step's values are computed once and bound as an array's one element; written out, the expression would repeat them dozens of times.
    def read(f):
        dated = F.coalesce(f["named"].between(27, 36) | f["named"].between(50, 58), F.lit(False))
        times, days, months = (f["bare"].rlike(f"(?i)[{x}]") for x in ("hs", "yd", "m"))
        free = f["named"].isNull()
        return F.struct((dated | (free & times)).alias("clock"), (dated | (free & (days | (months & ~times)))).alias("calendar"), f["late"].alias("late"), f["serial"].alias("serial"))

    def split(p):
        rounded = F.floor((p["serial"] - F.floor(p["serial"])) * 86400 + 0.5)
        day = (F.floor(p["serial"]) + F.floor(rounded / 86400)).cast("int")
        return F.struct(p["calendar"].alias("calendar"), p["clock"].alias("clock"), p["late"].alias("late"), day.alias("day"), (rounded % 86400).cast("int").alias("seconds"))

    def show(q):
        at = lambda epoch: F.date_format(F.date_add(F.lit(epoch).cast("date"), q["day"]), "yyyy-MM-dd")
        date = F.when(q["late"], at("1904-01-01")).when(q["day"] == 60, F.lit(ONLY_IN_EXCEL)).when(q["day"] < 60, at("1899-12-31")).otherwise(at("1899-12-30"))
        time = F.concat_ws(":", two(F.floor(q["seconds"] / 3600)), two(F.floor(q["seconds"] / 60) % 60), two(q["seconds"] % 60))
        has_date = q["calendar"] & (q["day"] >= F.when(q["late"], 0).otherwise(1))
        has_time = q["clock"] & ((q["seconds"] != 0) | ~has_date)
        return F.when(has_date & has_time, F.concat_ws(" ", date, time)).when(has_date, date).when(has_time, time).otherwise("")

    start = F.struct(named.alias("named"), bare.alias("bare"), late.alias("late"), serial.alias("serial"))
    usable = fine & serial.isNotNull() & ~F.isnan(serial) & (serial >= 0) & (serial <= LAST_SERIAL)
    return F.when(usable, F.transform(F.transform(F.transform(F.array(start), read), split), show)[0]).otherwise("")
