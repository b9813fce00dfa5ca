"""Line charts of small frames, where matplotlib is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A chart is for a series of dates; more rows than this aren't one.
MAX_ROWS = 100_000


def line_chart(frame: DataFrame, y: str, y2: str | None = None, x: str = "date", title: str = "", save_to: str | None = None):
    """Column y over x, y2 on a second axis; saved to a file if asked for. Returns the figure."""
    from matplotlib import pyplot

    rows = frame.select(x, y, *([y2] if y2 else [])).orderBy(x).limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows are too many for a chart")
    figure, axis = pyplot.subplots(figsize=(12, 5))
    axis.plot(rows[x], rows[y], label=y)
    if y2:
        axis.twinx().plot(rows[x], rows[y2], color="tab:orange", label=y2)
    axis.set_title(title)
    figure.autofmt_xdate()
    if save_to:
        figure.savefig(save_to)
    return figure
