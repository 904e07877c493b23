"""Column expressions that many operators share: missing values, numbers and dates in text, title case.

All are native expressions that give null instead of an error on dirty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a reader takes for null.
NULL_TOKENS = ("", "NA", "N/A", "null", "None")
#: Columns that describe rows and are neither profiled nor cleaned; so is any name that starts with "_".
META_COLUMNS = (
    "source_kind", "source_name", "source_path", "unit_kind", "container_name", "sheet_name", "slide_number",
    "paragraph_index", "table_index", "cell_label", "style_json", "notes",
)
#: Currency symbols that a number may bear.
CURRENCY = "$£€¥₹"
#: Date patterns in the order in which they are tried; month first where day and month are ambiguous.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "M/d/yyyy", "d/M/yyyy",
    "d-M-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d-MMM-yy",
)
#: Strftime directives and the patterns that stand for them.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%j": "DDD", "%f": "SSSSSS", "%%": "%"}


def is_meta(name: str) -> bool:
    return name in META_COLUMNS or name.startswith("_")


def data_columns(df: DataFrame) -> list[str]:
    """The columns that are no metadata."""
    return [c for c in df.columns if not is_meta(c)]


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(c: Column, sentinels: Iterable[object] = ()) -> Column:
    """Null, empty text, or one of the sentinels as text."""
    text = c.cast("string")
    return c.isNull() | text.isin("", *(str(s) for s in sentinels))


def is_blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def parse_number(c: Column, parens: str = "negative") -> Column:
    """The number in a text: currency symbols, thousands separators and spaces go; other text than digits, sign, point
    and exponent goes too ("5 USD" is 5). parens: what "(2)" is, "negative" or "strip"."""
    text = F.trim(c.cast("string"))
    if parens == "negative":
        text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    text = F.regexp_replace(F.regexp_replace(text, f"[{re.escape(CURRENCY)},\\s()]", ""), r"[^0-9.\-+eE]", "")
    number = text.try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def plain_number(c: Column) -> Column:
    """The number that a text is, after symbols, separators and parentheses; null if anything else is in it."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"^\((.*)\)$", "-$1"), f"[{re.escape(CURRENCY)},\\s]", "")
    return F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))


def is_numeric_text(c: Column) -> Column:
    """Whether a text is a number: "(2)", "$3" and "1,000" are; false for null and empty text."""
    return plain_number(c).isNotNull()


def java_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; literal letters are quoted."""
    out = ""
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", strftime):
        if part.startswith("%"):
            if part not in STRFTIME:
                raise ValueError(f"unknown date directive {part}")
            out += STRFTIME[part]
        else:
            out += f"'{part}'" if part.isalpha() else part
    return out


#: What the text for a run of pattern letters looks like; runs that are not named match anything.
SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3,4}", "MMMM": "[A-Za-z]{3,9}", "XXX": r"(Z|[+-]\d{2}:\d{2})"} | {c: r"\d{1,2}" for c in "MdHhms"} | {c * 2: r"\d{2}" for c in "MdHhms"}


def date_shape(pattern: str) -> str:
    """A regular expression that all texts of a date pattern match."""
    out = ""
    for part in re.finditer(r"'(?P<quoted>[^']*)'|(?P<letters>(?P<one>[A-Za-z])(?P=one)*)|(?P<other>[^A-Za-z'])", pattern):
        text = part["quoted"] if part["quoted"] is not None else part["other"]
        out += re.escape(text) if text is not None else SHAPES.get(part["letters"], ".*")
    return f"^{out}$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The timestamp in a text by the first pattern that fits, else null. Only patterns of the text's shape are tried."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*(F.when(text.rlike(date_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats)).cast("timestamp_ntz")


def is_date(c: Column) -> Column:
    """Whether a text is a date of one of the known patterns."""
    return parse_date(c).isNotNull()


def is_text(c: Column) -> Column:
    """Whether a value is neither empty nor a number."""
    return ~is_blank(c) & ~is_numeric_text(c)


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised: O'Connor, Jean-Luc."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalise), "")


def pattern(text: str, flags: Iterable[str] | str = ()) -> str:
    """A Python or Rust regular expression for Java: named groups and flags i, m, s, x (a is Java's default)."""
    names = {"ignorecase": "i", "multiline": "m", "dotall": "s", "verbose": "x", "ascii": "a"}
    given = flags.replace("|", ",").split(",") if isinstance(flags, str) else flags
    letters = ""
    for flag in given:
        flag = flag.strip().lower().removeprefix("re.")
        flag = names.get(flag, flag)
        if not flag:
            continue
        if not set(flag) <= set("imsxa"):
            raise ValueError(f"unknown regex flag {flag!r}")
        letters += flag.replace("a", "")
    text = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", text.replace("(?P<", "(?<"))
    return (f"(?{letters})" if letters else "") + text


def replacement(text: str) -> str:
    """A Python replacement for Java: \\1 and \\g<name> become $1 and ${name}, a literal $ is escaped."""
    text = text.replace("$", "\\$")
    return re.sub(r"\\g<(\d+)>", r"$\1", re.sub(r"\\g<([A-Za-z_]\w*)>", r"${\1}", re.sub(r"\\(\d+)", r"$\1", text)))


def literal_replacement(text: str) -> str:
    """A text that Java's replacement takes literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
