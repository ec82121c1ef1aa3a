"""Skew of pages by votes of their ink, and local thresholds from summed-area tables of bands of tiles.

Tables have a column that tells pages apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest angle and step in degrees, pixels of a bin of offsets, ink that a page must have.
MOST, STEP, BIN, LEAST_INK = 10.0, 0.5, 2, 100
#: Runs of a list, and of a block of pages; cells a run in which votes are counted directly, beyond which they are sorted.
PACK, BLOCK, DENSE = 256, 16_384, 32
# Side of the window and what a pixel may be darker than its mean.
WINDOW, DARKER = 31, 10
#: Rows of a band of a page in which thresholds are found, and pixels across that are worked on at a time.
BAND, ACROSS = 256, 2_048


def skew(runs: DataFrame, page: str = "doc_id", most: float = MOST, step: float = STEP) -> DataFrame:
    """page and angle in degrees (clockwise, as y goes down) of runs of ink (y, x0, x1, inclusive).

    Each run votes with its length, for each angle, for the offset of the line at that angle through
    its middle. The angle whose votes are the most uneven (the largest sum of squares) wins: lines of
    text then fall into few offsets. Ties go to the smaller angle, first to the negative one; a page
    with less ink than LEAST_INK pixels has the angle 0.

    Only runs are shuffled, packed in lists by page; the pages of a task go by in order, each angle's
    votes of a block of them are counted at once, and of a page that goes on only its votes are held.
    """
    n = round(most / step)
    turns = [(i * step, math.cos(math.radians(i * step)), math.sin(math.radians(i * step))) for i in sorted(range(-n, n + 1), key=lambda i: (abs(i), i))]
    kinds = dict(runs.dtypes)
    given = runs.select(F.col(page).alias("page"), "y", "x0", "x1")
    packed = given.mapInArrow(_packed, f"page {kinds[page]}, " + ", ".join(f"{c} array<{kinds[c]}>" for c in ("y", "x0", "x1")))
    together = packed.repartition("page").sortWithinPartitions("page")

    def run(batches):
        held = None  # the last page, which may go on: its key, sharpness, votes and ink so far
        for keys, at, y, x0, x1 in (part for batch in filter(len, batches) for part in _parts(batch)):
            x, w = (x0 + x1) / 2, x1 - x0 + 1
            on = held is not None and held[0].equals(keys.slice(0, 1))
            if held is not None and not on:
                yield _angles(*held[:2], held[3], turns)
            there = ~np.isnan(w)
            ink = np.bincount(at[there], w[there], len(keys))
            there &= ~np.isnan(y)
            sharp, votes = _sharpness(at[there], y[there], x[there], w[there], len(keys), turns, held[2] if on else None)
            ink[0] += held[3][0] if on else 0
            yield _angles(keys.slice(0, len(keys) - 1), sharp[:-1], ink[:-1], turns)
            held = keys.slice(len(keys) - 1), sharp[-1:], votes, ink[-1:]
        if held is not None:
            yield _angles(*held[:2], held[3], turns)

    return together.mapInArrow(run, f"page {kinds[page]}, angle double").withColumnRenamed("page", page)


def _packed(batches):
    """A page's runs as lists, PACK at most of one batch."""
    for batch in filter(len, batches):
        codes = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        batch, codes = batch.take(pa.array(order)), codes[order]
        starts = np.union1d(np.flatnonzero(np.diff(codes, prepend=-1)), np.arange(0, len(codes), PACK))
        offsets = pa.array(np.append(starts, len(codes)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), *(pa.ListArray.from_arrays(offsets, c) for c in batch.columns[1:])], names=batch.schema.names)


def _parts(batch: pa.RecordBatch):
    """Of about BLOCK runs at a time: the pages' keys, and the page's place, y, x0 and x1 of each run."""
    sizes = batch.column(1).value_lengths().to_numpy()
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(sizes)]):
        part = batch.slice(i, j - i)
        codes = part.column(0).dictionary_encode("encode").indices.to_numpy()
        firsts = np.flatnonzero(np.diff(codes, prepend=-1))
        yield part.column(0).take(pa.array(firsts)), np.repeat(codes.astype(np.int64), sizes[i:j]), *(c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns[1:])


def _sharpness(at: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, pages: int, turns: list, held: list | None) -> tuple[np.ndarray, list]:
    """The sum of squares of the votes of each page at each angle, and the last page's offsets and votes; held: those that the first has already."""
    sharp, last = np.zeros((pages, len(turns))), []
    for a, (_, c, s) in enumerate(turns):
        offset, weight, of = np.floor((y * c - x * s) / BIN), w, at
        if held is not None:
            offset, weight, of = np.concatenate([held[a][0], offset]), np.concatenate([held[a][1], w]), np.concatenate([np.zeros(len(held[a][0]), np.int64), at])
        low = offset.min() if len(offset) else 0.0
        span = int(offset.max() - low) + 1 if len(offset) else 1
        key = (offset - low).astype(np.int64) + of * span
        if pages * span <= DENSE * len(key):
            votes = np.bincount(key, weight, pages * span).reshape(pages, span)
            sharp[:, a] = np.einsum("ij,ij->i", votes, votes)
            there = np.flatnonzero(votes[-1])
            last.append((there + low, votes[-1][there]))
        else:
            key, where = np.unique(key, return_inverse=True)
            votes, mine = np.bincount(where, weight, len(key)), key >= (pages - 1) * span
            sharp[:, a] = np.bincount(key // span, votes * votes, pages)
            last.append((key[mine] - (pages - 1) * span + low, votes[mine]))
    return sharp, last


def _angles(keys: pa.Array, sharp: np.ndarray, ink: np.ndarray, turns: list) -> pa.RecordBatch:
    angles = np.array([t[0] for t in turns])
    found = np.where(ink >= LEAST_INK, angles[sharp.argmax(axis=1)], 0.0)
    return pa.RecordBatch.from_arrays([keys, pa.array(found)], names=["page", "angle"])


def local_threshold(tiles: DataFrame, page: str = "doc_id", window: int = WINDOW, darker: float = DARKER) -> DataFrame:
    """tiles with `light`: 255 for each pixel brighter than the mean of the window around it less `darker`, else 0.

    tiles: x0, y0, width, height and pixels (one byte each, row by row), cut anywhere, but so that no
    pixel of a page is in two. Pages are worked on in bands of rows: each tile's rows go to the bands
    that they are in or are half a window from, and only these rows. Sums of windows come from a table
    of sums over a band, four of its entries each, whatever the window; what bands give of a tile is
    put together. Windows at a page's edge have the pixels that there are. A tile without pixels, or
    with another number of bytes than its sides tell, gives null.
    """
    reach = window // 2
    box = ["x0", "y0", "width", "height"]
    known = tiles.where((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("pixels") == F.col("width") * F.col("height")) & F.col("x0").isNotNull() & F.col(page).isNotNull())
    # a band's middle is at a multiple of BAND, so that a page's first rows need no band above it
    band = lambda y: F.floor((y + BAND // 2) / BAND)
    low, high = F.col("y0") - reach, F.col("y0") + F.col("height") - 1 + reach
    spread = known.select(F.col(page).alias("page"), *[F.col(c).cast("bigint") for c in box], "pixels", F.explode(F.sequence(band(low), band(high))).alias("band"))
    edge = F.col("band") * BAND - BAND // 2
    first = F.greatest(F.col("y0"), edge - reach)
    count = F.least(F.col("y0") + F.col("height"), edge + BAND + reach) - first
    rows = spread.select("page", "band", *box, first.alias("first"), F.substring("pixels", ((first - F.col("y0")) * F.col("width") + 1).cast("int"), (count * F.col("width")).cast("int")).alias("pixels"))
    together = rows.repartition("page", "band").sortWithinPartitions("page", "band", "x0", "y0")
    kind = dict(tiles.dtypes)[page]

    def run(batches):
        held = None  # the rows of the band that may go on
        for batch in filter(len, batches):
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            starts = _starts(rows)
            if starts[-1]:
                yield _bands(rows.slice(0, starts[-1]), starts, reach, darker)
            held = rows.slice(starts[-1])
        if held is not None:
            yield _bands(held, [0, held.num_rows], reach, darker)

    light = together.mapInArrow(run, f"page {kind}, band bigint, x0 bigint, y0 bigint, width bigint, height bigint, light binary")
    whole = light.groupBy("page", *box).agg(F.array_sort(F.collect_set(F.struct("band", "light"))).alias("parts"))
    joined = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["light"]).otherwise(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["light"])), "")))
    whole = whole.select(F.col("page").alias(page), *box, joined.alias("light"))
    return tiles.join(whole.hint("merge"), [page, *box], "left")  # tiles come to much more than their tables' files tell: none is broadcast


def _starts(rows: pa.RecordBatch) -> list[int]:
    """Where the first two columns change, from 0 on."""
    codes = [np.diff(rows.column(k).dictionary_encode().indices.to_numpy(), prepend=-1) != 0 for k in (0, 1)]
    return np.flatnonzero(codes[0] | codes[1]).tolist()


def _bands(rows: pa.RecordBatch, starts: list[int], reach: int, darker: float) -> pa.RecordBatch:
    """What is light of the tiles in their bands; rows: page, band, x0, y0, width, height, first and pixels of their rows in it or within reach."""
    band, *columns = (c.to_pylist() for c in rows.columns[1:])
    light = [x for i, j in zip(starts, starts[1:]) for x in _band(band[i] * BAND - BAND // 2, *(c[i:j] for c in columns), reach, darker)]
    found = pa.RecordBatch.from_arrays([*rows.columns[:6], pa.array(light, pa.binary())], names=[*rows.schema.names[:6], "light"])
    return found.filter(found.column(6).is_valid())


def _band(low: int, x0: list, y0: list, width: list, height: list, first: list, pixels: list, reach: int, darker: float) -> list[bytes | None]:
    spans = [(max(y, low), min(y + h, low + BAND)) for y, h in zip(y0, height)]
    top, bottom = min(a for a, _ in spans), max(b for _, b in spans)
    if bottom <= top:  # other bands' rows only
        return [None] * len(x0)
    parts = [np.frombuffer(p, np.uint8).reshape(-1, w) for p, w in zip(pixels, width)]
    out = [np.empty((b - a, w), np.uint8) if b > a else None for w, (a, b) in zip(width, spans)]
    meet: dict[int, list[int]] = {}  # tiles by the parts of the band that their halo meets, each ACROSS pixels wide
    for i, (x, w) in enumerate(zip(x0, width)):
        for part in range((x - reach) // ACROSS, (x + w - 1 + reach) // ACROSS + 1):
            meet.setdefault(part, []).append(i)
    for part, those in meet.items():
        left, right = max(part * ACROSS, min(x0[i] for i in those)), min((part + 1) * ACROSS, max(x0[i] + width[i] for i in those))
        if right <= left:
            continue
        value = np.zeros((bottom - top + 2 * reach, right - left + 2 * reach))
        there = np.zeros_like(value)
        for i in those:
            y, x, to_y, to_x = max(first[i], top - reach), max(x0[i], left - reach), min(first[i] + len(parts[i]), bottom + reach), min(x0[i] + width[i], right + reach)
            if to_y > y and to_x > x:
                at = slice(y - top + reach, to_y - top + reach), slice(x - left + reach, to_x - left + reach)
                value[at] = parts[i][y - first[i] : to_y - first[i], x - x0[i] : to_x - x0[i]]
                there[at] = 1
        n = _windows(there, reach)
        bright = value[reach : reach + bottom - top, reach : reach + right - left] * n > _windows(value, reach) - darker * n
        for i in those:
            (a, b), x, to_x = spans[i], max(x0[i], left), min(x0[i] + width[i], right)
            if b > a and to_x > x:
                out[i][:, x - x0[i] : to_x - x0[i]] = np.where(bright[a - top : b - top, x - left : to_x - left], 255, 0)
    return [x if x is None else x.tobytes() for x in out]


def _windows(a: np.ndarray, reach: int) -> np.ndarray:
    """The sums of the windows around the pixels that are `reach` from all edges."""
    side, sums = 2 * reach + 1, np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    sums[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    return sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]
