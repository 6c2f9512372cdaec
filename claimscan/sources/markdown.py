"""Markdown law books, case lists and word tables: cleaning and splitting, one row per document in, sections or rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscan.functions.text import SPACE, first_number, strip
from claimscan.functions.work import MAX_SMALL

# The marks that structure the source documents.
NUMERALS = "一二三四五六七八九十"
ARTICLE = "第.{1,3}条"
CASE = rf"###{SPACE}*案例{SPACE}*[0-9]+"
NUMBERED = rf"##{SPACE}*[{NUMERALS}]+[、.]"
INTERPRETATION = "【释义】"
GENERAL_BAN = "通用禁令"


def strip_markers(df: DataFrame, col: str) -> DataFrame:
    """Without page comments, lines of digits only, rulers and surplus empty lines."""
    c = F.col(col)
    for pattern, by in (
        (rf"<!--{SPACE}*第{SPACE}*[0-9]+{SPACE}*页{SPACE}*-->", ""),
        (rf"(?dm)^[0-9]+{SPACE}*$", ""),
        (rf"(?dm)^---{SPACE}*$", ""),
        (r"\n{3,}", "\n\n"),
        (rf"(?dm)^{SPACE}+$", ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    return df.withColumn(col, strip(c))


@dataclass(frozen=True)
class Kind:
    """How sections of one kind begin and end. ``pattern`` has a heading group and a body group."""

    pattern: str
    heading: int
    body: int
    keep: str = "true"  # SQL over heading and body


KINDS = {
    "law": Kind(
        rf"(?s)({ARTICLE}){SPACE}*(.*?)(?=\n{ARTICLE}{SPACE}|\z)", 1, 2,
        f"(contains(body, '{INTERPRETATION}') OR length(body) >= 200) AND length(value) >= 50",
    ),
    "bold_law": Kind(rf"(?s)\*\*({ARTICLE})\*\*{SPACE}*(.*?)(?=\n\*\*{ARTICLE}\*\*|\n## |\z)", 1, 2, "length(body) >= 10"),
    "case": Kind(rf"(?s)###{SPACE}*案例{SPACE}*([0-9]+){SPACE}*\n(.*?)(?={CASE}|\z)", 1, 2),
    "industry": Kind(rf"(?s){NUMBERED}{SPACE}*(.+?){SPACE}*\n(.*?)(?=\n{NUMBERED}|\z)", 1, 2),
    "general": Kind(rf"(?s)##{SPACE}*({GENERAL_BAN}.*?){SPACE}*\n(.*?)(?=\n## |\z)", 1, 2),
}


def law_value(heading: Column, body: Column) -> Column:
    """Article, its text, and its interpretation, if any, in a paragraph of its own."""
    at = F.instr(body, INTERPRETATION)
    text = strip(F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body))
    said = strip(F.when(at > 0, F.substring(body, at + len(INTERPRETATION), F.length(body))).otherwise(F.lit("")))
    return F.concat(heading, F.lit("\n"), text, F.when(said != "", F.concat(F.lit("\n\n" + INTERPRETATION), said)).otherwise(F.lit("")))


def split_sections(df: DataFrame, col: str, kind: str) -> DataFrame:
    """One row per section of ``kind``: the other columns, ``section_no``, ``heading``, ``body``, ``value``."""
    k = KINDS[kind]
    parts = F.arrays_zip(
        F.regexp_extract_all(F.col(col), F.lit(k.pattern), F.lit(k.heading)).alias("h"), F.regexp_extract_all(F.col(col), F.lit(k.pattern), F.lit(k.body)).alias("b")
    )
    others = [c for c in df.columns if c != col]
    rows = df.select(*others, F.posexplode(parts).alias("section_no", "x")).select(*others, "section_no", strip(F.col("x.h")).alias("heading"), strip(F.col("x.b")).alias("body"))
    value = law_value(F.col("heading"), F.col("body")) if kind == "law" else F.concat_ws("\n", "heading", "body")
    return rows.withColumn("value", value).filter(k.keep)


def lines_of(df: DataFrame, col: str) -> DataFrame:
    """One row per line: the other columns, ``line_no``, ``line``."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(F.split(F.col(col), r"\r\n|\r|\n")).alias("line_no", "line"))


def cells_of(line: Column, header: str = "序号") -> Column:
    """Cells of a table row; null for other lines, separators and headers."""
    line = strip(line)
    cells = F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")
    row = line.startswith("|") & ~line.rlike(rf"^\|[ \t\n\r\f\x0B\-|:]+\|$")
    return F.when(row & (F.size(cells) > 0) & (F.get(cells, F.lit(0)) != header), cells)


def parse_table_rows(df: DataFrame, col: str, expected_cols: int | None = None) -> DataFrame:
    """One row per table row: the other columns, ``line_no``, ``cells``; with ``expected_cols``, rows of just so many cells."""
    out = lines_of(df, col).withColumn("cells", cells_of(F.col("line"))).drop("line").filter("cells IS NOT NULL")
    return out.filter(F.size("cells") == expected_cols) if expected_cols else out


def carry_section_title(lines: DataFrame, key: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """Adds ``section``: the last numbered heading at or above each line, without its count."""
    title = F.regexp_extract(strip(F.col(line)), rf"^{NUMBERED}{SPACE}*(.+)", 1)
    plain = F.when(title != "", strip(F.regexp_replace(strip(title), rf"{SPACE}*[—\-]{SPACE}*[0-9]+\+?{SPACE}*$", "")))
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(plain, ignorenulls=True).over(w))


def ranges_of(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """(__n, __label) for every range (lo, hi, __label) that has a number (__n, distinct): an equi-join, for ranges of any number.

    A range of up to 2 ** level numbers lies in at most two bins of that size, and a number in one bin of each size that occurs.
    """
    sized = ranges.filter("lo <= hi").withColumn("level", F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int"))
    bin_ = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    binned = sized.withColumn("bin", F.explode(F.sequence(bin_("lo"), bin_("hi"))))
    levels = [r.level for r in sized.select("level").distinct().collect()]  # at most 64
    asked = numbers.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", bin_("__n"))
    return asked.join(binned, ["level", "bin"]).filter("__n BETWEEN lo AND hi").select("__n", "__label")


def range_label(df: DataFrame, num_col: str, ranges: DataFrame, out: str = "label", limit: int = MAX_SMALL) -> DataFrame:
    """Adds the label of the range (lo, hi, label) that has the number; ``""`` if none does. More than ``limit`` ranges are joined by bins."""
    r = ranges.select("lo", "hi", F.col("label").alias("__label"))
    n = F.col(num_col)
    number = n if dict(df.dtypes)[num_col] != "string" else first_number(n)
    rows = df.withColumn("__n", number)
    if r.limit(limit + 1).count() > limit:
        found = ranges_of(rows.select("__n").filter("__n IS NOT NULL").distinct(), r)
        return rows.join(found, "__n", "left").withColumn(out, F.coalesce("__label", F.lit(""))).drop("__n", "__label")
    joined = rows.join(F.broadcast(r), (F.col("__n") >= F.col("lo")) & (F.col("__n") <= F.col("hi")), "left")
    return joined.withColumn(out, F.coalesce("__label", F.lit(""))).drop("__n", "lo", "hi", "__label")
