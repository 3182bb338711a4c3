"""Vetting sheets as drawings: the panels' rows become marks of one SVG text per star, by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.plans.panels import sheet
from starfold.plans.stars import _classified
from starfold.sources.tables import light_curves

#: Panels by their place in a grid of three columns, and the size of a cell and its margin.
PLACES = ("curve", "phase", "phase_zoom", "odd_even", "secondary", "river", "probabilities", "text")
ACROSS, WIDE, HIGH, MARGIN = 3, 320, 200, 24
#: Colours of series; the first that fits a series' name, or else black.
COLOURS = {"odd": "#c0392b", "even": "#2471a3", "transits": "#999999", "transit": "#27ae60", "eclipsing_binary": "#c0392b", "blend": "#8e44ad", "other": "#7f8c8d"}


def _scaled(value: str, low: str, high: str, room: int) -> Column:
    """Where a value lies between the least and the greatest of its panel; in the middle if they are equal, nowhere if it is null."""
    span = F.col(high) - F.col(low)
    return F.when(span > 0, (F.col(value) - F.col(low)) / span * room).when(F.col(value).isNotNull(), room / 2)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def marks(panels: DataFrame) -> DataFrame:
    """tic_id, place, at, mark of rows of (tic_id, panel, series, x, y, shown): a circle, line, cell, bar or line of text each."""
    place = F.array_position(F.array(*map(F.lit, PLACES)), F.col("panel")) - 1
    own = Window.partitionBy("tic_id", "panel")
    rows = panels.filter(F.col("panel").isin(*PLACES)).withColumns({"place": place.cast("int"), "line": F.when(F.col("panel") == "river", F.expr("try_cast(series as double)"))})
    rows = rows.withColumns({"x0": F.min("x").over(own), "x1": F.max("x").over(own), "y0": F.min("y").over(own), "y1": F.max("y").over(own), "l0": F.min("line").over(own), "l1": F.max("line").over(own)})
    rows = rows.withColumn("nth", F.dense_rank().over(own.orderBy("series")) - 1)
    left, top = (F.col("place") % ACROSS) * WIDE + MARGIN, F.floor(F.col("place") / ACROSS) * HIGH + MARGIN
    width, height = WIDE - 2 * MARGIN, HIGH - 2 * MARGIN
    x, y = left + _scaled("x", "x0", "x1", width), top + height - _scaled("y", "y0", "y1", height)
    colour = F.lit("#000000")
    for name, value in COLOURS.items():
        colour = F.when(F.col("series") == name, value).otherwise(colour)
    cells = F.col("l1") - F.col("l0") + 1
    shade = F.lit(255) - _scaled("y", "y0", "y1", 255).cast("int")
    number = lambda v: F.when(v.isNotNull(), F.format_string("%.2f", v.cast("double")))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    bar = height / F.lit(len(PLACES)) * 1.5
    drawn = (
        F.when(F.col("panel") == "text", text('<text class="text" x="', number(left), '" y="', number(top + 14 + F.col("nth") * 16), '">', F.col("series"), ": ", escaped(F.col("shown")), "</text>"))
        .when(F.col("panel") == "probabilities", text('<rect class="bar" x="', number(left), '" y="', number(top + F.col("nth") * (bar + 4)), '" width="', number(F.col("y") * width), '" height="', number(bar), '" fill="', colour, '"><title>', F.col("series"), "</title></rect>"))
        .when(F.col("panel") == "river", text('<rect class="cell" x="', number(x), '" y="', number(top + (F.col("line") - F.col("l0")) / cells * height), '" width="4" height="', number(height / cells), '" fill="rgb(', shade.cast("string"), ",", shade.cast("string"), ",", shade.cast("string"), ')"/>'))
        .when(F.col("y").isNull(), text('<line class="transit" x1="', number(x), '" x2="', number(x), '" y1="', number(top), '" y2="', number(top + height), '" stroke="', colour, '"/>'))
        .otherwise(text('<circle class="', F.col("panel"), '" cx="', number(x), '" cy="', number(y), '" r="1.2" fill="', colour, '"/>'))
    )
    return rows.withColumn("mark", drawn).filter("mark is not null").select("tic_id", "place", F.struct("place", "series", "x", "y", "mark").alias("at"))


def drawings(panels: DataFrame) -> DataFrame:
    """tic_id, svg: all panels of a star as one drawing; a panel without rows has only its title.

    Rows that lack what their kind of mark needs are left out.  A star's curve is
    one text, so its points meet in one task, as its panels do.
    """
    ordered = F.transform(F.array_sort(F.collect_list("at")), lambda m: m["mark"])
    titles = "".join(f'<text class="title" x="{i % ACROSS * WIDE + MARGIN}" y="{i // ACROSS * HIGH + MARGIN - 6}">{name}</text>' for i, name in enumerate(PLACES))
    high = -(-len(PLACES) // ACROSS) * HIGH
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{ACROSS * WIDE}" height="{high}" font-family="sans-serif" font-size="11">'
    return marks(panels).groupBy("tic_id").agg(F.concat(F.lit(head + titles), F.array_join(ordered, ""), F.lit("</svg>")).alias("svg"))


def figure_sheets(spark, sf) -> DataFrame:
    """The vetting sheet of every star as a drawing."""
    return drawings(sheet(light_curves(spark, sf), _classified(spark, sf)))


QUERIES = {"figure_sheets": figure_sheets}
