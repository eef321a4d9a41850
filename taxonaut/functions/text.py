"""Text normalisation as Column expressions (no Python on the executors).

White space means Python's Unicode white space throughout: Java's \\s is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Every character that Python's str.isspace() knows, as a Java regex class.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
# A classification code such as A3, A01 or A1-1-3, its brackets and its leading form.
CODE = r"[A-Za-z]+\p{Nd}*(?:-\p{Nd}+)*"
OPEN, CLOSE = r"[\(\[（【]", r"[\)\]）】]"
TRAILING_CODE = rf"{SPACE}*{OPEN}{SPACE}*({CODE}){SPACE}*{CLOSE}{SPACE}*$"
LEADING_CODE = rf"^{SPACE}*({CODE}){SPACE}*[:：]{SPACE}*"
CJK = r"[\x{4e00}-\x{9fff}]"
LONG_TEXT = 60

# The family of a column type, by its first word.
TYPES = {
    "bigint": "INTEGER",
    "binary": "BINARY",
    "blob": "BINARY",
    "bool": "BOOLEAN",
    "boolean": "BOOLEAN",
    "char": "STRING",
    "clob": "STRING",
    "date": "DATE",
    "datetime": "DATETIME",
    "decimal": "DECIMAL",
    "double": "FLOAT",
    "float": "FLOAT",
    "int": "INTEGER",
    "integer": "INTEGER",
    "json": "JSON",
    "mediumint": "INTEGER",
    "nchar": "STRING",
    "number": "DECIMAL",
    "numeric": "DECIMAL",
    "nvarchar": "STRING",
    "nvarchar2": "STRING",
    "real": "FLOAT",
    "smallint": "INTEGER",
    "string": "STRING",
    "text": "STRING",
    "time": "TIME",
    "timestamp": "DATETIME",
    "tinyint": "INTEGER",
    "varbinary": "BINARY",
    "varchar": "STRING",
    "varchar2": "STRING",
}
LEVELS = ("L1", "L2", "L3", "L4")


def strip(x: Column) -> Column:
    """White space trimmed off both ends, inner runs kept; null stays null."""
    return F.regexp_replace(x.cast("string"), f"^{SPACE}+|{SPACE}+$", "")


def clean(x: Column) -> Column:
    """White space runs as one space, ends trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"{SPACE}+", " "))


def compact(x: Column) -> Column:
    """All white space removed; null as ''."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"{SPACE}+", "")


def strip_code(x: Column) -> Column:
    """Cleaned text without a trailing code in (), [], （） or 【】."""
    return F.trim(F.regexp_replace(clean(x), TRAILING_CODE, ""))


def extract_code(x: Column) -> Column:
    """The trailing code, null where there is none."""
    return F.nullif(F.regexp_extract(clean(x), TRAILING_CODE, 1), F.lit(""))


def split_code(x: Column) -> Column:
    """struct(name, code): a trailing code wins over a leading one ("A1-1: name"); code '' if none."""
    text = clean(x)
    trailing, leading = F.regexp_extract(text, TRAILING_CODE, 1), F.regexp_extract(text, LEADING_CODE, 1)
    name = F.when(trailing != "", F.regexp_replace(text, TRAILING_CODE, "")).when(leading != "", F.regexp_replace(text, LEADING_CODE, "")).otherwise(text)
    return F.struct(F.trim(name).alias("name"), F.when(trailing != "", trailing).otherwise(leading).alias("code"))


def normalize_name(x: Column) -> Column:
    """Lower case; runs of anything but ASCII letters, digits and CJK as one underscore, none at the ends."""
    joined = F.regexp_replace(F.lower(clean(x)), r"[^a-zA-Z0-9\x{4e00}-\x{9fff}]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def normalize_type(x: Column) -> Column:
    """Type family of the first word; an unknown type in upper case."""
    text = F.lower(clean(x))
    families = F.create_map(*[F.lit(v) for pair in TYPES.items() for v in pair])
    return F.coalesce(families[F.element_at(F.split(text, r"[\s(]", 2), 1)], F.upper(text))


def normalize_level(x: Column) -> Column:
    """L1 to L4 from 1, LEVEL1 or L1 in either case; '' stays, anything else raises."""
    text = F.upper(clean(x))
    level = F.regexp_replace(text, "^(?:LEVEL|L)?([1-4])$", "L$1")
    return F.when((level == "") | level.isin(*LEVELS), level).otherwise(F.raise_error(F.concat(F.lit("Unsupported data level: "), text)))


def standard_level(x: Column) -> Column:
    """struct(level, raw): like normalize_level, also "1级"; what is not understood has a null level and is never guessed."""
    text = clean(x)
    level = F.regexp_replace(F.upper(text), "^(?:(?:LEVEL|L)?([1-4])|([1-4])级)$", "L$1$2")
    return F.struct(F.when(level.isin(*LEVELS), level).alias("level"), text.alias("raw"))


def parse_category(x: Column) -> Column:
    """struct(name, code, parts, multi_part, is_long, malformed) of a raw category text.

    Parts are split at '-' only if there are two or more and each holds a CJK character.
    """
    text, found = clean(x), split_code(x)
    parts = F.transform(F.split(found["name"], "-"), strip)
    multi = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(CJK))
    return F.struct(
        found["name"].alias("name"), found["code"].alias("code"), F.when(multi, parts).otherwise(F.array(found["name"])).alias("parts"),
        multi.alias("multi_part"), (F.length(text) > LONG_TEXT).alias("is_long"), (text == "").alias("malformed"),
    )


def labelled_lines(head: str, labels: dict[str, str]) -> Column:
    """`head`, then a line "label：value" for every column that is not blank, in order."""
    lines = [F.when(clean(F.col(c)) != "", F.concat(F.lit(f"{label}："), strip(F.col(c)))) for c, label in labels.items()]
    return F.concat_ws("\n", F.lit(head), *lines)
