"""The shape of CSV files: cells of each record, and quotes that stay open.

A line can begin outside or inside a quoted cell. For both, an expression says
how many cells it adds and where it ends, so lines are looked at apart, in one
aggregate. Only where some line leaves a quote open does the state of one line
depend on those before it: then each task folds its lines for both states, and
the folds, one for each part of a file, are put together in order.

Two quotes in a row stand for one inside a quoted cell, and a quote inside an
unquoted cell is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.shipping import ship


@dataclass(frozen=True)
class Shape:
    """``encoding`` is UTF-8 where every line is valid in it, else Latin-1;
    ``multiline`` says that a quoted cell holds a line end."""

    encoding: str
    multiline: bool


def cells(line: Column, sep: str) -> tuple[Column, Column]:
    """(cells, whether the last one stays open) of a line that begins outside a quoted cell."""
    at = re.escape(sep) if sep != "\t" else r"\t"
    closed = F.regexp_replace(line, f'(^|{at})"[^"]*"', "$1x")
    cut = F.regexp_replace(closed, f'(^|{at})"[^"]*$', "$1x")
    return F.length(cut) - F.length(F.replace(cut, F.lit(sep), F.lit(""))) + 1, cut != closed


def lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A row for each line: blank, and (cells, is_open) if it begins outside, (ends, more, opens_again) if inside a quoted cell."""
    line = F.replace("value", F.lit('""'), F.lit(""))
    n, opened = cells(line, sep)
    # What follows the quote that closes the cell goes on as an unquoted one.
    again, opened_again = cells(F.concat(F.lit("x"), F.substring(line, F.instr(line, '"') + 1, F.length(line))), sep)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), (F.col("value") == "").alias("blank"), n.alias("cells"), opened.alias("is_open"), F.contains(line, F.lit('"')).alias("ends"), (again - 1).alias("more"), opened_again.alias("opens_again"))


_FOLDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("lines", pa.int64()), ("lead", pa.int64()), ("lead_line", pa.int64()), ("bad_line", pa.int64()), ("bad_cells", pa.int64()), ("tail", pa.int64()), ("tail_line", pa.int64())])
FOLDS = "file string, start long, inside boolean, ends_inside boolean, lines long, lead long, lead_line long, bad_line long, bad_cells long, tail long, tail_line long"


class Fold:
    """What the lines of a part of a file come to, if it begins ``inside`` a quoted cell or not."""

    def __init__(self, inside: bool, width: int):
        self.begins, self.inside, self.width, self.n = inside, inside, width, 0
        #: Cells that the part adds to a record begun before it, and the line where that record ends.
        self.lead, self.lead_line = 0, None
        #: The first record of too many cells, and the record that is open at the end.
        self.bad, self.open, self.open_line = None, 0, None

    def line(self, blank: bool, cells: int, is_open: bool, ends: bool, more: int, opens_again: bool) -> None:
        self.n += 1
        if not self.inside:
            if not blank:
                self.open, self.open_line, self.inside = cells, self.n, is_open
                if not is_open:
                    self.closed()
        elif ends:
            carried = self.begins and self.open_line is None
            if carried:
                self.lead += more
            else:
                self.open += more
            self.inside = opens_again
            if not self.inside:
                if carried:
                    self.lead_line, self.begins = self.n, False
                else:
                    self.closed()

    def closed(self) -> None:
        if self.open > self.width and self.bad is None:
            self.bad = self.open_line, self.open

    def row(self, file: str, start: int, begins: bool) -> tuple:
        bad = self.bad or (None, None)
        still = self.inside and self.open_line is not None
        return file, start, begins, self.inside, self.n, self.lead, self.lead_line, *bad, self.open if still else None, self.open_line if still else None


def folds(spark: SparkSession, path: str, sep: str, width: int) -> DataFrame:
    """A row for each part of a file and each state in which it can begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[Fold, Fold]] = {}
        for batch in batches:
            for file, start, *row in zip(*(c.to_pylist() for c in batch.columns)):
                for fold in found.setdefault((file, start), (Fold(False, width), Fold(True, width))):
                    fold.line(*row)
        rows = [fold.row(*at, begins) for at, both in found.items() for begins, fold in zip((False, True), both)]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOLDS)], _FOLDS)

    return lines(ship(spark), path, sep).drop("value").mapInArrow(run, FOLDS)


def check(parts: list, width: int) -> None:
    """Raises where a record has too many cells or a quote stays open. ``parts`` are rows of FOLDS."""
    by_part: dict[tuple[str, int], dict[bool, object]] = {}
    for r in parts:
        by_part.setdefault((r["file"], r["start"]), {})[r["inside"]] = r
    file, before, inside, carried, since = None, 0, False, 0, 0
    for at in sorted(by_part):
        if at[0] != file:
            unclosed(inside, since)
            file, before, inside, carried = at[0], 0, False, 0
        r = by_part[at][inside]
        if inside:
            carried += r["lead"]
            if r["lead_line"] is not None and carried > width:
                too_many(since, carried, width)
        if r["bad_line"] is not None:
            too_many(before + r["bad_line"], r["bad_cells"], width)
        if r["tail_line"] is not None:
            carried, since = r["tail"], before + r["tail_line"]
        before, inside = before + r["lines"], r["ends_inside"]
    unclosed(inside, since)


def too_many(line: int, cells: int, width: int) -> None:
    raise ValueError(f"The CSV file can't be read: line {line} has {cells} cells, and the header has {width}.")


def unclosed(inside: bool, line: int) -> None:
    if inside:
        raise ValueError(f"The CSV file can't be read: the quote opened in line {line} is never closed.")


def shape_of(spark: SparkSession, path: str, sep: str, width: int) -> Shape:
    """One scan; a second one where quoted cells hold line ends, or to say which
    line is wrong. Raises ValueError for a record of more cells than ``width``
    and for a quote that is never closed; missing cells are no error."""
    # Line ends are single bytes in both encodings, so lines can be tested apart.
    got = lines(spark, path, sep).agg(F.count_if(~F.is_valid_utf8("value")).alias("invalid"), F.coalesce(F.bool_or("is_open"), F.lit(False)).alias("is_open"), F.max(F.when(~F.col("blank"), F.col("cells"))).alias("most")).first()
    if got["is_open"] or (got["most"] or 0) > width:
        check(folds(spark, path, sep, width).collect(), width)
    return Shape("ISO-8859-1" if got["invalid"] else "UTF-8", got["is_open"])


def widths(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(cells, lines): how many lines that are not blank have so many cells, for files without line ends in cells."""
    return lines(spark, path, sep).where(~F.col("blank")).groupBy("cells").agg(F.count("*").alias("lines"))
