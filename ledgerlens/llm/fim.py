"""Fill-in-middle transformation of whole texts, in Spark SQL functions only.

A text is cut into units by a regular expression (lines, each with its line break). The
first four groups of eight hex digits of ``sha256("<seed>:<key>")`` choose two cuts, whether
the text is changed, and the arrangement:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is, where it is empty, holds a sentinel, or is left out by the rate

``restore`` reads the sentinels of an output and its form and puts the parts in order again.
A sentinel starts with its only ``<`` and ends with its only ``>``, so none can arise from a
part's end and the next sentinel: the first occurrence of each is the one that was written.

Every row is worked on alone: one scan, no shuffle, no state; a lost task is run again.

Defined results: a null text is an empty one (0 units, ``plain``, an empty output); a null
key hashes as an empty string; a text without a line break is one unit; equal cuts give an
empty middle; repeated rows give equal results; an empty table stays empty; other columns
pass, but those named like an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a line with its break, or the rest
UNIT = r"[^\n]*\n|[^\n]+"
ADDED = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Sentinels:
    """Marks of the parts; each has one ``<``, its first, and one ``>``, its last character."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        whole = all(m[:1] == "<" and m[-1:] == ">" and m.count("<") == m.count(">") == 1 for m in marks)
        if not whole or len(set(marks)) < 3:
            raise ValueError(f"sentinels must be three different strings like <P>: {marks}")


MARKS = Sentinels()


def draw(key: Column, number: int, seed: int) -> Column:
    """The eight hex digits of that number (from 0) of the key's hash, as a number."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 8 * number + 1, 8), 16, 10).cast("long")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = UNIT, marks: Sentinels = MARKS) -> DataFrame:
    """Add ``n``, ``form``, ``prefix``, ``middle``, ``suffix`` (null where plain) and ``output``.

    Of a hundred texts, ``rate`` are rearranged, and of these ``spm`` with the suffix first.
    """
    # the columns that pass are one struct meanwhile, so their names clash with none
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED]).alias("row")
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(own, said.alias("said"), *[draw(F.col(f"`{key}`"), i, seed).alias(f"h{i + 1}") for i in range(4)])
    rows = rows.withColumn("units", F.regexp_extract_all("said", F.lit(unit), F.lit(0))).withColumn("n", F.size("units").cast("long"))

    cuts = [F.pmod(F.col(f"h{i}"), F.col("n") + 1) for i in (1, 2)]
    rows = rows.withColumn("first", F.least(*cuts).cast("int")).withColumn("last", F.greatest(*cuts).cast("int"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    whole = F.lit(True) if unit == UNIT else F.array_join("units", "") == F.col("said")  # text between units would be lost
    rows = rows.select(
        "row", "said", "n", "h3", "h4",
        whole.alias("whole"),
        part(F.lit(1), F.col("first")).alias("prefix"),
        part(F.col("first") + 1, F.col("last") - F.col("first")).alias("middle"),
        part(F.col("last") + 1, F.col("n").cast("int") - F.col("last")).alias("suffix"),
    )
    held = reduce(Column.__or__, [F.contains("said", F.lit(m)) for m in (marks.prefix, marks.suffix, marks.middle)])
    plain = (F.col("said") == "") | held | ~F.col("whole") | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = F.when(F.col("form") == "plain", F.col("said")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix", "middle", "suffix")]
    return rows.select("row.*", "n", "form", *shown, output.alias("output"))


def restore(output: Column, form: Column, marks: Sentinels = MARKS) -> Column:
    """The text of an output, read from its sentinels; null where they are not all there in order."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        """What stands after each of the first two marks and after the middle's."""
        rest = F.substring(output, F.lit(len(one) + 1), F.length(output))
        first = F.substring_index(rest, two, 1)
        rest = F.substring(rest, F.length(first) + len(two) + 1, F.length(rest))
        second = F.substring_index(rest, marks.middle, 1)
        return first, second, F.substring(rest, F.length(second) + len(marks.middle) + 1, F.length(rest))

    def whole(one: str, two: str) -> Column:
        at = [F.locate(m, output) for m in (one, two, marks.middle)]
        return (at[0] == 1) & (at[1] > 0) & (at[2] > at[1])

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    psm = F.when(whole(marks.prefix, marks.suffix), F.concat(prefix, middle, suffix))
    suffix, prefix, middle = parts(marks.suffix, marks.prefix)
    spm = F.when(whole(marks.suffix, marks.prefix), F.concat(prefix, middle, suffix))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
