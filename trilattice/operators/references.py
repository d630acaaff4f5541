"""Boxes of map references, and the lattice of labelled cells over projected coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trilattice.functions import units as U

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def reference_box(ref: Column, west: float, south: float, east: float, north: float, step: float = 0.05, parts: int = 5) -> Column:
    """The box of F12, F12c (quadrant) or F12-c3 (part), in either case; null for what names no cell.

    Rows count from the north; quadrants run a, b in the north and c, d in the south.
    """
    ncol, nrow = round((east - west) / step), round((north - south) / step)
    text = F.upper(F.trim(ref))
    pattern = rf"^([A-Z])([0-9]+)([A-D]?)(?:-([A-{LETTERS[parts - 1]}])([1-{parts}]))?$"
    group = lambda i: F.regexp_extract(text, pattern, i)
    col, row = F.ascii(group(1)) - 65, F.try_to_number(group(2), F.lit("999999999")).cast("int")
    known = text.rlike(pattern) & (col < ncol) & (row >= 1) & (row <= nrow)
    x0, x1, xm = (U.tick(west, step, col, plus) for plus in (0, 1, 0.5))
    y1, y0, ym = (U.tick(north, -step, row, plus) for plus in (-1, 0, -0.5))
    quadrant = group(3)
    x0, x1 = F.when(quadrant.isin("B", "D"), xm).otherwise(x0), F.when(quadrant.isin("A", "C"), xm).otherwise(x1)
    y0, y1 = F.when(quadrant.isin("A", "B"), ym).otherwise(y0), F.when(quadrant.isin("C", "D"), ym).otherwise(y1)
    is_part = group(4) != ""
    wide, high = (x1 - x0) / parts, (y1 - y0) / parts
    px, py = x0 + (F.ascii(group(4)) - 65) * wide, y1 - (F.try_to_number(group(5), F.lit("9")).cast("int") - 1) * high
    return F.when(known, F.when(is_part, box(px, py - high, px + wide, py)).otherwise(box(x0, y0, x1, y1)))


@dataclass(frozen=True)
class LabelledCells:
    """Square cells A1, B1 ... from the north-west corner (x0, y0); columns past Z are AA, AB ..."""

    x0: float
    y0: float
    cell: float
    columns: int
    rows: int

    @classmethod
    def over(cls, xmin: float, ymin: float, xmax: float, ymax: float, cell: float = 5000.0) -> "LabelledCells":
        """The cells over a box, its corner moved outward to a multiple of the cell."""
        if not (xmax > xmin and ymax > ymin and cell > 0):
            raise ValueError("the box or the cell has no extent")
        x0, y0 = xmin // cell * cell, -(-ymax // cell) * cell
        return cls(x0, y0, float(cell), int(-(-(xmax - x0) // cell)), int(-(-(y0 - ymin) // cell)))

    def label(self, x: Column, y: Column) -> Column:
        """The label of the cell at a point; null outside."""
        i, j = F.floor((x - self.x0) / self.cell), F.floor((F.lit(self.y0) - y) / self.cell)
        letter = lambda c: F.char(c.cast("int") + 65)
        digits, first, width = [], 0, 26
        while first < self.columns:
            k, name = i - first, letter((i - first) % 26)
            for _ in range(len(digits)):
                k = F.floor(k / 26)
                name = F.concat(letter(k % 26), name)
            digits.append((first + width, name))
            first, width = first + width, width * 26
        name = F.lit(None).cast("string")
        for end, text in reversed(digits):
            name = F.when(i < end, text).otherwise(name)
        return F.when((i >= 0) & (i < self.columns) & (j >= 0) & (j < self.rows), F.concat(name, (j + 1).cast("string")))

    def cell_box(self, label: Column) -> Column:
        """The box of one label, in either case; null for what names no cell."""
        text = F.upper(F.trim(label))
        column = F.regexp_extract(text, "^([A-Z]{1,6})([1-9][0-9]{0,8})$", 1)
        i = F.aggregate(F.split(column, ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64)) - 1
        j = F.try_to_number(F.regexp_extract(text, "^([A-Z]{1,6})([1-9][0-9]{0,8})$", 2), F.lit("999999999")).cast("long") - 1
        x, y = F.lit(self.x0) + i * self.cell, F.lit(self.y0) - j * self.cell
        return F.when((column != "") & (i < self.columns) & (j < self.rows), box(x, y - self.cell, x + self.cell, y))

    def region(self, ref: Column, aliases: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
        """The box of a label, of a range like C4-D5 (hyphen or en dash), or of an alias; null for anything else."""
        ends = F.split(F.trim(ref), "[-–]")
        a, b = self.cell_box(F.get(ends, F.lit(0))), self.cell_box(F.get(ends, F.lit(1)))
        both = box(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"]))
        found = F.when(F.size(ends) == 1, a).when((F.size(ends) == 2) & a.isNotNull() & b.isNotNull(), both)
        for name, given in (aliases or {}).items():
            found = F.when(F.trim(ref) == name, box(*(F.lit(float(v)) for v in given))).otherwise(found)
        return found
