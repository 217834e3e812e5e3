"""Lines of code and indentation of files: path, name, content (binary), length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import languages as L
from loamline.functions import text as X
from loamline.session import ship


def with_language(files: DataFrame) -> DataFrame:
    """Adds text, known (a language with a grammar, or null), language and binary; only unknown files are sniffed."""
    ship(files.sparkSession)
    text = files.withColumn("text", X.decoded(F.col("content")))
    named = text.withColumn("known", L.known_language(F.col("name"), F.col("text")))
    return named.withColumn("language", L.language(F.col("name"), F.col("known"))).withColumn("binary", F.col("known").isNull() & X.is_binary(F.col("content")))


def loc(files: DataFrame, unknown_as_text: bool = True) -> DataFrame:
    """path and loc: language, binary, blanks, code, comments, lines, bytes.

    Unknown files count as text, whose lines are all comments; with
    ``unknown_as_text=False`` their lines are code. Binary files count nothing
    but their bytes.
    """
    named = with_language(files)
    rows = X.lines(F.col("text"))
    whole = F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
    other = L.COMMENT if unknown_as_text else L.CODE
    unknown = F.transform(whole, lambda x: F.when(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == "", L.BLANK).otherwise(other).cast("byte"))
    classes = F.when(F.col("known").isNull(), unknown).otherwise(L.line_classes("known", "text"))
    counted = named.withColumn("classes", F.when(F.col("binary"), F.array().cast("array<byte>")).otherwise(classes))

    def number(*kinds: int) -> Column:
        return F.size(F.filter("classes", lambda x: x.isin(*kinds))).cast("long")

    found = F.struct(
        "language", "binary", number(L.BLANK, L.BLANK_IN_COMMENT).alias("blanks"), number(L.CODE).alias("code"), number(L.COMMENT).alias("comments"),
        F.size("classes").cast("long").alias("lines"), F.col("length").cast("long").alias("bytes"),
    )
    return counted.select("path", found.alias("loc"))


def code_lines(files: DataFrame) -> DataFrame:
    """path, line_no, spaces, tabs, text of the lines whose indentation counts.

    Of known languages those that aren't comments, blank ones outside comments
    included; of unknown ones all; of binary files none.
    """
    named = with_language(files).filter(~F.col("binary"))
    rows = X.lines(F.col("text"))
    wanted = F.when(F.col("known").isNull(), rows).otherwise(
        F.filter(F.zip_with(rows, L.line_classes("known", "text"), lambda r, c: F.when(c.isin(L.CODE, L.BLANK), r)), lambda r: r.isNotNull())
    )
    each = named.select("path", F.posexplode(wanted).alias("line_no", "line"))
    return each.select("path", "line_no", X.leading(F.col("line")).alias("x")).select("path", "line_no", "x.*")


def indentation(lines: DataFrame, key: str = "path") -> DataFrame:
    """``key`` and indentation: statistics of the lines with any text; keys without such a line have no row.

    Percentiles are exact elements of the data; minimum and maximum are those of
    the data, and the deviation is that of the population.
    """
    indents = lines.filter("text > 0").select(key, X.indentation(F.struct("spaces", "tabs")).cast("long").alias("x"))

    def quantile(q: float) -> Column:
        return F.expr(f"cast(percentile_disc({q}) within group (order by x) as bigint)")

    stats = indents.groupBy(key).agg(
        F.count("*").alias("lines"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), quantile(0.5).alias("median"), quantile(0.75).alias("p75"),
        quantile(0.9).alias("p90"), quantile(0.99).alias("p99"), F.stddev_pop("x").alias("stddev"), F.sum("x").alias("sum"),
    )
    return stats.select(key, F.struct(*[c for c in stats.columns if c != key]).alias("indentation"))
