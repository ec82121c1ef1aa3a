"""Lines of text from word boxes, and a red box from runs of pixels: geometry by windows, joins and aggregation.

Tables have a column that tells pages apart; rows without one make a page of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hue, saturation and value from and to of the two reds, and how a box must be.
REDS = [((0, 70, 50), (10, 255, 255)), ((170, 70, 50), (180, 255, 255))]
LEAST_AREA, ASPECT, PADDING, REACH = 5_000, (1.5, 3.5), 10, 2
#: Rows of a band: rectangles meet in the bands that they are in.
BAND = 32
#: Rectangles of a page that a task works on by itself, of a block of pages, and pairs or rows at a time; beyond all coordinates.
MOST, BLOCK, SOME, LIMIT = 16_384, 8_192, 1_000_000, 2**62


def lines(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, line (from 1), text and score of each line of word boxes (text, left, top, width, height, score).

    Words are of one line where the middle halves of their heights overlap, directly or by words
    between; in it they stand by their left edge (ties: top, then text). Words without text or place
    are left out; score is the mean of the words' scores, of which null and negative ones count as 0.5.
    """
    known = tokens.where("trim(text) <> '' and left is not null and top is not null and height is not null")
    known = known.select(page, F.trim("text").alias("text"), "left", "top", F.when(F.col("score") >= 0, F.col("score")).otherwise(0.5).alias("score"), (F.col("top") + F.col("height") / 4).alias("_from"), (F.col("top") + F.col("height") * 3 / 4).alias("_to"))
    order = Window.partitionBy(page).orderBy("_from", "_to", "left", "text")
    known = known.withColumn("_fresh", F.coalesce(F.col("_from") > F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    known = known.withColumn("line", F.sum(F.col("_fresh").cast("int")).over(order))
    said = F.array_sort(F.collect_list(F.struct("left", "top", "text")))
    return known.groupBy(page, "line").agg(F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("text"), F.avg("score").alias("score"))


def full_text(found: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, text and score of all lines."""
    said = F.array_sort(F.collect_list(F.struct("line", "text")))
    return found.groupBy(page).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"), F.avg("score").alias("score"))


def red(hue: str = "hue", saturation: str = "saturation", value: str = "value", reds: list = REDS) -> Column:
    parts = (hue, saturation, value)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip(parts, low, high)]) for low, high in reds])


def rectangles(runs: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, x0, x1, y0 and y1 (ends inclusive): runs of neighbouring rows with the same ends are put together, as far as they come together."""
    kinds = dict(runs.dtypes)
    given = runs.where("x0 is not null and x1 is not null and y is not null").select(F.col(page).alias("page"), "x0", "x1", "y")

    def run(batches):
        for batch in filter(len, batches):
            codes = batch.column(0).dictionary_encode("encode").indices.to_numpy()
            x0, x1, y = (c.to_numpy() for c in batch.columns[1:])
            starts = _stacks(codes, x0, x1, y)
            if len(starts) > len(y) // 4:  # runs of other stacks may be between those of one
                order = np.lexsort((y, x1, x0, codes))
                batch, codes, x0, x1, y = batch.take(pa.array(order)), codes[order], x0[order], x1[order], y[order]
                starts = _stacks(codes, x0, x1, y)
            low = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*low.columns, pa.array(y[np.append(starts[1:], len(y)) - 1])], names=["page", "x0", "x1", "y0", "y1"])

    return given.mapInArrow(run, f"page {kinds[page]}, x0 {kinds['x0']}, x1 {kinds['x1']}, y0 {kinds['y']}, y1 {kinds['y']}").withColumnRenamed("page", page)


def _stacks(codes: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where runs don't lie right below the one before, or on it, with the same ends."""
    on = (codes[1:] == codes[:-1]) & (x0[1:] == x0[:-1]) & (x1[1:] == x1[:-1]) & (y[1:] - y[:-1] >= 0) & (y[1:] - y[:-1] <= 1)
    return np.flatnonzero(np.append(True, ~on)[: len(y)])


def components(rects: DataFrame, keep: Callable[[DataFrame], DataFrame], page: str = "doc_id") -> DataFrame:
    """rects (with id) and component: the least id of the rectangles of the page that hang together by touching ones, also at corners.

    Ids go to smaller ones over touching pairs, and each to where the one that it points to points, so
    chains halve with each round; `keep` stores what a round gives.
    """
    edges = keep(_touching(rects, page))
    labels = keep(rects.select(F.col("id").alias("a"), F.col("id").alias("label")))
    while True:
        near = edges.join(labels.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, "a", "left").select("a", F.least("label", F.coalesce("near", "label")).alias("next"), F.col("label").alias("was"))
        jumped = least.join(least.select(F.col("a").alias("next"), F.col("next").alias("further")), "next")
        new = keep(jumped.select("a", F.least("next", "further").alias("label"), "was"))
        if new.where("label <> was").isEmpty():
            return rects.join(new.select(F.col("a").alias("id"), F.col("label").alias("component")), "id")
        labels = new.drop("was")


def _touching(rects: DataFrame, page: str) -> DataFrame:
    """Pairs a, b of ids, both ways."""
    bands = F.explode(F.sequence(F.floor((F.col("y0") - 1) / BAND), F.floor((F.col("y1") + 1) / BAND)))
    one = rects.select(page, bands.alias("band"), *[F.col(c).alias(f"a_{c}") for c in ("id", "x0", "x1", "y0", "y1")])
    two = one.select(page, "band", *[F.col(f"a_{c}").alias(f"b_{c}") for c in ("id", "x0", "x1", "y0", "y1")])
    met = one.join(two, [page, "band"]).where("a_id <> b_id and a_x0 <= b_x1 + 1 and b_x0 <= a_x1 + 1 and a_y0 <= b_y1 + 1 and b_y0 <= a_y1 + 1")
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def red_boxes(runs: DataFrame, sizes: DataFrame, keep: Callable[[DataFrame], DataFrame], page: str = "doc_id", least_area: float = LEAST_AREA, aspect: tuple[float, float] = ASPECT, padding: int = PADDING, reach: int = REACH) -> DataFrame:
    """page, x, y, w and h of the red box of each page that has one, with padding.

    runs: y, x0, x1 (inclusive), hue, saturation and value of runs of like pixels; sizes: width and
    height of each page. Red runs grow by `reach` pixels to all sides, so small gaps close; what hangs
    together is a box if its outline's area and its aspect fit. The largest is taken (ties: the highest,
    then leftmost). The area is that between the centres of the outermost pixels of neighbouring rows.

    Only rectangles of runs are shuffled, once, by page. Blocks of pages are then worked on in their
    tasks; the rectangles of pages that have over MOST go on as a table, which `keep` stores.
    """
    rects = rectangles(runs.where(red()), page).repartition(page).join(sizes.hint("merge"), page)
    grown = rects.select(page, F.greatest(F.col("x0") - reach, F.lit(0)).alias("x0"), F.least(F.col("x1") + reach, F.col("width") - 1).alias("x1"), F.greatest(F.col("y0") - reach, F.lit(0)).alias("y0"), F.least(F.col("y1") + reach, F.col("height") - 1).alias("y1"), "width", "height")
    grown = grown.where("x0 <= x1 and y0 <= y1")  # what is outside the page is gone
    kinds = dict(grown.dtypes)
    ends, corner = ["x0", "x1", "y0", "y1"], ["x", "y", "w", "h"]
    given = grown.select(F.col(page).alias("page"), *[F.col(c).cast("bigint") for c in (*ends, "width", "height")]).sortWithinPartitions("page")
    schema = f"page {kinds[page]}, " + ", ".join(f"{c} bigint" for c in (*ends, "width", "height", *corner))
    done = keep(given.mapInArrow(lambda batches: _pages(batches, least_area, aspect), schema).withColumnRenamed("page", page))
    best = done.where("x is not null").select(page, *corner, "width", "height")
    large = done.where("x is null")
    if not large.isEmpty():
        best = best.unionByName(_largest(large.select(page, *ends, "width", "height"), keep, page, least_area, aspect))
    best = best.select(page, *[F.col(c).cast(kinds["x0" if c in "xw" else "y0"]).alias(c) for c in corner], F.col("width").cast(kinds["width"]), F.col("height").cast(kinds["height"]))
    x, y = F.greatest(F.col("x") - padding, F.lit(0)), F.greatest(F.col("y") - padding, F.lit(0))
    right, low = F.least(F.col("x") + F.col("w") + padding, F.col("width")), F.least(F.col("y") + F.col("h") + padding, F.col("height"))
    return best.select(page, x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))


def _largest(rects: DataFrame, keep: Callable[[DataFrame], DataFrame], page: str, least_area: float, aspect: tuple[float, float]) -> DataFrame:
    """page, x, y, w, h, width and height of the box of each page, by joins: for pages of any number of rectangles."""
    rects = keep(rects.distinct().withColumn("id", F.monotonically_increasing_id()))
    found = components(rects, keep, page)
    rows = found.select(page, "component", "width", "height", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).groupBy(page, "component", "width", "height", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    span = F.col("x1") - F.col("x0")
    shapes = rows.groupBy(page, "component", "width", "height").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), (F.sum(span) - (F.min_by(span, "y") + F.max_by(span, "y")) / 2).alias("area"))
    fits = shapes.where((F.col("area") >= least_area) & (F.col("w") / F.col("h")).between(*aspect))
    return fits.groupBy(page).agg(F.min(F.struct((-F.col("area")).alias("area"), "y", "x", "w", "h", "width", "height")).alias("b")).select(page, "b.x", "b.y", "b.w", "b.h", "b.width", "b.height")


def _pages(batches, least_area: float, aspect: tuple[float, float]):
    """The boxes of pages whose rectangles (page, x0, x1, y0, y1, width, height) come together, without those; of pages of over MOST the rectangles, without boxes."""
    held, long = None, None  # the rectangles of the last page, which may go on; the key of a page that has too many
    for batch in filter(len, batches):
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(np.diff(rows.column(0).dictionary_encode("encode").indices.to_numpy(), prepend=-1))
        ends, last = np.append(starts[1:], rows.num_rows), rows.column(0).slice(starts[-1], 1)
        plain = (ends - starts <= MOST) & (np.arange(len(starts)) < len(starts) - 1)
        if long is not None and long.equals(rows.column(0).slice(0, 1)):
            plain[0] = False
        through = ~plain
        through[-1] = (ends - starts)[-1] > MOST or (long is not None and long.equals(last))
        if through.any():
            yield _with_nulls(rows.filter(pa.array(np.repeat(through, ends - starts))), 4)
        held, long = (rows.slice(rows.num_rows), last) if through[-1] else (rows.slice(starts[-1]), None)
        yield from _boxes(rows.filter(pa.array(np.repeat(plain, ends - starts))), least_area, aspect)
    if held is not None:
        yield from _boxes(held, least_area, aspect)


def _with_nulls(rows: pa.RecordBatch, after: int) -> pa.RecordBatch:
    names = [*rows.schema.names, *("x", "y", "w", "h")[:after]]
    return pa.RecordBatch.from_arrays([*rows.columns, *[pa.nulls(rows.num_rows, pa.int64())] * after], names=names)


def _boxes(rows: pa.RecordBatch, least_area: float, aspect: tuple[float, float]):
    """The best box of each page, for a few thousand rectangles of whole pages at a time."""
    codes = rows.column(0).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    firsts = np.flatnonzero(np.diff(codes, prepend=-1))
    cuts = firsts[np.flatnonzero(np.diff(firsts // BLOCK, prepend=-1))].tolist()
    for i, j in zip(cuts, [*cuts[1:], rows.num_rows]):
        part, of = rows.slice(i, j - i), codes[i:j] - codes[i]
        x0, x1, y0, y1 = (c.to_numpy() for c in part.columns[1:5])
        component = _labels(of, x0, x1, y0, y1)
        first, component = np.unique(component, return_inverse=True)
        n = len(first)
        x, y, right, low = np.full(n, LIMIT), np.full(n, LIMIT), np.full(n, -LIMIT), np.full(n, -LIMIT)
        for f, to, c in ((np.minimum, x, x0), (np.minimum, y, y0), (np.maximum, right, x1), (np.maximum, low, y1)):
            f.at(to, component, c)
        w, h = right - x + 1, low - y + 1
        base = np.cumsum(h) - h
        near, far = np.full(h.sum(), LIMIT), np.full(h.sum(), -LIMIT)
        for r, at in _spread(y1 - y0 + 1):
            row = base[component[r]] + y0[r] - y[component[r]] + at
            np.minimum.at(near, row, x0[r])
            np.maximum.at(far, row, x1[r])
        span = far - near  # what hangs together leaves no row out
        area = np.add.reduceat(span, base) - (span[base] + span[base + h - 1]) / 2
        fits = np.flatnonzero((area >= least_area) & (w / h >= aspect[0]) & (w / h <= aspect[1]))
        best = fits[np.lexsort((h[fits], w[fits], x[fits], y[fits], -area[fits], of[first[fits]]))]
        best = best[np.flatnonzero(np.diff(of[first[best]], prepend=-1))]
        at = pa.array(first[best])
        none = pa.nulls(len(best), pa.int64())
        columns = [part.column(0).take(at), *[none] * 4, *(part.column(k).take(at) for k in (5, 6)), *(pa.array(c[best]) for c in (x, y, w, h))]
        yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "x", "y", "w", "h"])


def _labels(of: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The least place of those rectangles of a page (of) that each hangs together with: roots go to the least root that they touch, until none does."""
    label, n = np.arange(len(of)), y1.max(initial=0) + 3
    order = np.lexsort((y0, of))
    key = (of * n + y0)[order]
    ends = np.searchsorted(key, of[order] * n + y1[order] + 1, "right")  # below it begin those that may touch
    edges = []
    for r, at in _spread(ends - np.arange(len(of)) - 1):
        a, b = order[r], order[r + 1 + at]
        met = (x0[a] <= x1[b] + 1) & (x0[b] <= x1[a] + 1)
        edges.append((a[met], b[met]))
    a, b = (np.concatenate(c) for c in zip(*edges)) if edges else (label[:0], label[:0])
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _spread(counts: np.ndarray):
    """Each place as often as it counts, with 0, 1 and so on; about SOME at a time."""
    counts = np.maximum(counts, 0)
    sums = np.cumsum(counts)
    cuts = np.flatnonzero(np.diff((sums - counts) // SOME, prepend=-1)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(counts)]):
        if (n := counts[i:j].sum()):
            yield np.repeat(np.arange(i, j), counts[i:j]), np.arange(n) - np.repeat(sums[i:j] - counts[i:j] - (sums[i] - counts[i]), counts[i:j])
