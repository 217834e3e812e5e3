"""Texts of files: decoding, lines, leading white space, binary files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB_WIDTH = 4
SNIFFED = 1024
_MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
_MAGIC = ("25504446", "89504E47", "FFD8FF", "504B0304", "1F8B", "7F454C46", "CAFEBABE")


def _starts(content: Column, mark: str) -> Column:
    return F.hex(F.substring(content, 1, len(mark) // 2)) == mark


def wide(content: Column, charset: str) -> Column:
    """Text of UTF-16 bytes: a surrogate without its partner and a single last byte become replacement characters."""
    digits = F.hex(content)
    first = "^..D" if charset == "UTF-16LE" else "^D"
    high, low = (lambda u, set=set: F.coalesce(u.rlike(first + set), F.lit(False)) for set in ("[89AB]", "[C-F]"))
    wrong = F.lit("FDFF" if charset == "UTF-16LE" else "FFFD")
    units = F.regexp_extract_all(digits, F.lit("(....)"), 1)

    def paired(u: Column, i: Column) -> Column:
        good = F.when(high(u), low(F.get(units, i + 1))).when(low(u), high(F.get(units, i - 1))).otherwise(F.lit(True))
        return F.when(good, u).otherwise(wrong)

    whole = F.concat(F.array_join(F.transform(units, paired), ""), F.when(F.length(digits) % 4 != 0, wrong).otherwise(F.lit("")))
    return F.decode(F.unhex(whole), charset)


def decoded(content: Column) -> Column:
    """Text of bytes by their mark, UTF-8 without one; invalid bytes become replacement characters, so no content is an error."""
    text = F.make_valid_utf8(content.cast("string"))
    for mark, charset in _MARKS.items():
        rest = F.substring(content, len(mark) // 2 + 1, 2**31 - 1)
        by_mark = F.make_valid_utf8(rest.cast("string")) if charset == "UTF-8" else wide(rest, charset)
        text = F.when(_starts(content, mark), by_mark).otherwise(text)
    return text


def is_binary(content: Column) -> Column:
    """Whether the first bytes look like no text: a zero byte without a mark of a wide encoding, or a known magic number."""
    head = F.substring(content, 1, SNIFFED)
    marked = F.lit(False)
    for mark in _MARKS:
        marked = marked | _starts(content, mark)
    magic = F.lit(False)
    for mark in _MAGIC:
        magic = magic | _starts(content, mark)
    return (F.position(F.lit(bytearray(b"\0")), head) > 0) & ~marked | magic


def lines(text: Column) -> Column:
    """Pieces between line feeds; a trailing empty one stays."""
    return F.split(text, "\n", -1)


def leading(line: Column) -> Column:
    """Spaces, tabs and the number of characters behind them without trailing white space; blank lines have none."""
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    rest = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    spaces = F.length(indent) - F.length(F.replace(indent, F.lit(" "), F.lit("")))
    return F.struct(spaces.cast("int").alias("spaces"), (F.length(indent) - spaces).cast("int").alias("tabs"), F.char_length(rest).cast("int").alias("text"))


def indentation(leading_struct: Column) -> Column:
    return leading_struct["spaces"] + TAB_WIDTH * leading_struct["tabs"]
