"""Raw delimited lines into typed rows and rejects with a reason.

The structural checks (quoting, number of columns) are plain column
expressions over the line.  The values are cast once for each *distinct* text
of a column: the distinct texts form a dictionary of casts and reasons, which is
joined back to the lines, so a text that a third of all lines share is parsed
once.  The join is an ordinary equi-join; adaptive execution splits a hot text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROKEN_QUOTING = "broken quoting"
WRONG_COLUMNS = "wrong column count"
INVALID_VALUE = "invalid value"

#: A plain decimal number in ASCII: sign, digits with a point, exponent.
DECIMAL = r"^([+-]?)([0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]([+-]?[0-9]+))?$"
#: White space and separators of any script.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@dataclass(frozen=True)
class Field:
    """A column: its name, type and the cast of its distinct texts.

    ``cast`` gets the text and returns ``(value, valid)``.
    """

    name: str
    type: str
    cast: Callable[[Column], tuple[Column, Column]]


def trimmed(text: Column) -> Column:
    """``text`` without blanks around it."""
    return F.trim(text, F.lit(BLANKS))


def nonblank(text: Column) -> tuple[Column, Column]:
    """Text that holds something besides blanks; kept as it is."""
    return text, trimmed(text) != ""


def _decimal(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of a decimal number: is it one, sign, digits without zeros around them, exponent of the last digit.

    Exact for any number of digits.  An exponent too long for BIGINT is null.
    """
    t = trimmed(text)
    ok = t.rlike(DECIMAL)
    mantissa = F.regexp_extract(t, DECIMAL, 2)
    exponent = F.regexp_extract(t, DECIMAL, 3)
    exponent = F.when(exponent == "", F.lit(0).cast("bigint")).otherwise(exponent.try_cast("bigint"))
    fraction = F.when(F.instr(mantissa, ".") > 0, F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    short = F.rtrim(digits, F.lit("0"))
    last = F.try_add(exponent - F.length(fraction), (F.length(digits) - F.length(short)).cast("bigint"))
    return ok, F.regexp_extract(t, DECIMAL, 1), F.ltrim(short, F.lit("0")), last


def one_of_halves(text: Column) -> tuple[Column, Column]:
    """A number equal to 0, 0.5 or 1."""
    ok, sign, digits, last = _decimal(text)
    plus = sign != "-"
    value = (
        F.when(ok & (digits == ""), F.lit(0.0))
        .when(ok & plus & (digits == "5") & (last == -1), F.lit(0.5))
        .when(ok & plus & (digits == "1") & (last == 0), F.lit(1.0))
    )
    return value, value.isNotNull()


def int32(text: Column) -> tuple[Column, Column]:
    """A number equal to an integer within +-2147483647, in any decimal notation."""
    ok, sign, digits, last = _decimal(text)
    size = F.length(digits) + last
    whole = F.when(digits == "", F.lit("0")).when(
        (last >= 0) & (size <= 10), F.concat(digits, F.repeat(F.lit("0"), F.when((last >= 0) & (last <= 10), last).otherwise(0).cast("int")))
    )
    number = whole.try_cast("bigint")
    value = F.when(ok & (number <= 2147483647), F.when(sign == "-", -number).otherwise(number).cast("int"))
    return value, value.isNotNull()


TRAIT = (Field("species", "string", nonblank), Field("binary_trait", "double", one_of_halves))
FOLDS = (Field("fold_id", "string", nonblank), Field("genus", "string", nonblank), Field("seed", "int", int32))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_fields(lines: DataFrame, raw: str, quote: str = '"', sep: str = "\t") -> DataFrame:
    """Add ``__fields`` (array of texts, quotes resolved) and ``__quoting`` (are they well formed) to ``lines``.

    A line is cut at its quotes: pieces of even position lie outside quotes.
    It is well formed if the number of quotes is even and each outside piece
    is empty between two quotes (a doubled quote) or begins and ends at
    separators.  No pattern with backtracking is used, so lines of any length
    pass in linear time.  A null line has no fields.
    """
    line = F.when(F.col(raw).endswith("\r"), F.substring(F.col(raw), F.lit(1), F.length(raw) - 1)).otherwise(F.col(raw))

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)

        def fits(piece: Column, i: Column) -> Column:
            starts, ends = (i == 0) | piece.startswith(sep), (i == n - 1) | piece.endswith(sep)
            return F.when(i % 2 == 1, F.lit(True)).otherwise((piece == "") | (starts & ends))

        def encoded(piece: Column, i: Column) -> Column:
            safe = F.replace(piece, F.lit("\x01"), F.lit("\x01a"))
            doubled = (piece == "") & (i > 0) & (i < n - 1)
            return F.when(i % 2 == 1, F.replace(safe, F.lit(sep), F.lit("\x01b"))).when(doubled, F.lit(quote)).otherwise(safe)

        good = (n % 2 == 1) & F.forall(F.transform(pieces, fits), lambda x: x)
        return F.struct(good.alias("good"), F.array_join(F.transform(pieces, encoded), "").alias("text"))

    decoded = lambda f: F.replace(F.replace(f, F.lit("\x01b"), F.lit(sep)), F.lit("\x01a"), F.lit("\x01"))
    good, text = F.col("__cut.good"), F.col("__cut.text")
    return (
        lines.withColumn("__cut", let(F.split(line, quote, -1), cut))
        .withColumn("__quoting", good)
        .withColumn("__fields", F.when(good, F.transform(F.split(text, sep, -1), decoded)))
        .drop("__cut")
    )


def value_dictionary(lines: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """``(position, text)`` of every distinct text in well-formed lines, with one value column per field and ``valid``."""
    texts = lines.where(F.col("__fields").isNotNull() & (F.size("__fields") == len(fields)))
    texts = texts.select(F.posexplode("__fields").alias("position", "text")).distinct()
    valid = F.lit(False)
    for i, field in enumerate(fields):
        value, ok = field.cast(F.col("text"))
        texts = texts.withColumn(field.name, F.when(F.col("position") == i, value).cast(field.type))
        valid = F.when(F.col("position") == i, ok).otherwise(valid)
    return texts.withColumn("valid", F.coalesce(valid, F.lit(False)))


def parse_lines(lines: DataFrame, fields: tuple[Field, ...], raw: str = "raw_line") -> DataFrame:
    """All lines with the typed ``fields`` and ``reason`` (null for a valid line).

    Every column of ``lines`` is kept under its name; one that clashes with a
    field is kept as ``raw_<name>``.  Reasons are tested in the order broken
    quoting, wrong column count, invalid value; a null line has the wrong
    column count.  Repeated lines each come out.
    """
    for name in [f.name for f in fields if f.name in lines.columns] + (["reason"] if "reason" in lines.columns else []):
        lines = lines.withColumnRenamed(name, f"raw_{name}")
        raw = f"raw_{name}" if raw == name else raw
    kept = lines.columns
    cut = split_fields(lines, raw)
    dictionary = value_dictionary(cut, fields)
    whole = cut.withColumn("__n", F.coalesce(F.size("__fields"), F.lit(-1)))
    for i, field in enumerate(fields):
        whole = whole.withColumn(f"__t{i}", F.when(F.col("__n") == len(fields), F.get(F.col("__fields"), F.lit(i))))
        words = dictionary.where(F.col("position") == i).select(
            F.col("text").alias(f"__t{i}"), field.name, F.col("valid").alias(f"__v{i}")
        )
        whole = whole.join(words, f"__t{i}", "left")
    bad = F.lit(False)
    for i in range(len(fields)):
        bad = bad | ~F.col(f"__v{i}")
    reason = (
        F.when(F.col(raw).isNotNull() & ~F.col("__quoting"), BROKEN_QUOTING)
        .when(F.col("__n") != len(fields), WRONG_COLUMNS)
        .when(bad, INVALID_VALUE)
    )
    return whole.withColumn("reason", reason).select(*kept, *[f.name for f in fields], "reason")


def data_lines(lines: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Lines other than the header, which is line 1 of a file; a null line number counts as data."""
    return lines.where(F.coalesce(F.col(line_no) != 1, F.lit(True)))


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())
