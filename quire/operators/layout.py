"""Layout detections of one page: duplicates, nesting, labels, order.

A page has at most a few hundred boxes, so what depends on boxes kept before (greedy suppression, merging to a fixed point, swaps,
recursive cuts) runs in numpy on many pages at once: pages of like size are rows of padded arrays, and a loop goes over the boxes of a page or the
levels of its cuts, not over pages. Everything else is an expression or a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.geometry import Box
from quire.operators.spatial import pairs

# Thresholds of the layout stage.
NMS_IOU, NESTED_FORMULA, FORMULA_COVER, SAME_ROW, LEAST_GAP, NARROW_SHARE = 0.9, 0.7, 0.7, 10.0, 5.0, 0.1


def by_pages(boxes: DataFrame, keys: Sequence[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work on whole pages, many at a time: it gets their rows and, from 0, the number of each row's page; rows of a page stand together.

    A window by page deals and sorts the rows where they are not dealt by page already, so pages that come from a window or a group move no second time.
    Only the last page of a batch waits for the next batch.
    """
    names = list(keys)

    def numbered(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), bool)
        for k in names:
            column = frame[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch.drop(columns="_rows") if rest is None else pd.concat([rest, batch.drop(columns="_rows")], ignore_index=True)
            if not len(frame):
                continue
            page = numbered(frame)
            cut = int(np.searchsorted(page, page[-1]))
            if cut:
                yield work(frame.iloc[:cut], page[:cut])
            rest = frame.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield work(rest, np.zeros(len(rest), int))

    return boxes.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*names))).mapInPandas(run, schema)


#: Places of a padded array; what a step holds is a few such arrays.
_PLACES = 1 << 16


def _by_size(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (of sizes from starts on) of like size together: their numbers, and of each, in a row, its places and which of them are its own."""
    order = np.argsort(sizes, kind="stable")
    ranked, at = sizes[order], 0
    while at < len(order):
        alike = int(np.searchsorted(ranked, max(2 * ranked[at], 8), "right"))
        end = min(alike, at + max(1, _PLACES // int(ranked[alike - 1])))
        some = order[at:end]
        along = np.arange(ranked[end - 1])
        own = along < sizes[some, None]
        yield some, np.where(own, starts[some, None] + along, starts[some, None]), own
        at = end


def _pages(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each page."""
    sizes = np.bincount(page)
    return np.cumsum(sizes) - sizes, sizes


def _sortable(column: pd.Series) -> np.ndarray:
    """Numbers that sort as the column does, nulls last."""
    if pd.api.types.is_numeric_dtype(column.dtype):
        return column.to_numpy()
    codes = pd.factorize(column, sort=True)[0]
    return np.where(codes < 0, len(codes), codes)


def _corners(frame: pd.DataFrame) -> np.ndarray:
    return frame[["x0", "y0", "x1", "y1"]].to_numpy(float)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _iou(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(box[..., 2], others[..., 2]) - np.maximum(box[..., 0], others[..., 0]), 0, None)
    h = np.clip(np.minimum(box[..., 3], others[..., 3]) - np.maximum(box[..., 1], others[..., 1]), 0, None)
    area = lambda b: np.clip(b[..., 2] - b[..., 0], 0, None) * np.clip(b[..., 3] - b[..., 1], 0, None)
    union = area(box) + area(others) - w * h
    return np.divide(w * h, union, out=np.zeros(union.shape), where=union > 0)


def suppress(boxes: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id", most: float = NMS_IOU) -> DataFrame:
    """Greedy suppression: by falling score (ties: box_id), a box goes if a kept one overlaps it by more than `most` (IoU), whatever the classes."""

    def work(frame: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((_sortable(frame[box_id]), -frame["score"].to_numpy(float), page))]
        xy, kept = _corners(frame), np.ones(len(frame), bool)
        for _, rows, own in _by_size(*_pages(page)):
            box, stays = xy[rows], own.copy()
            for i in range(own.shape[1] - 1):
                stays[:, i + 1 :] &= ~(stays[:, i, None] & (_iou(box[:, i, None], box[:, i + 1 :]) > most))
            kept[rows[own]] = stays[own]
        return frame[kept]

    return by_pages(boxes, keys, work, _schema(boxes))


def merge_nested_formulas(boxes: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id", overlap: float = NESTED_FORMULA) -> DataFrame:
    """Formula boxes that cover each other by `overlap` of the smaller one become their union, until none do. The better score stays, with its id."""

    def merged(rows: list[dict]) -> list[dict]:
        changed = True
        while changed:
            changed = False
            for i in range(len(rows)):
                for j in range(i + 1, len(rows)):
                    a, b = rows[i], rows[j]
                    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
                    small = min((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (a, b))
                    if w > 0 and h > 0 and small > 0 and w * h / small >= overlap:
                        best = dict(a if a["score"] >= b["score"] else b)
                        best |= {"x0": float(np.floor(min(a["x0"], b["x0"]))), "y0": float(np.floor(min(a["y0"], b["y0"]))), "x1": float(np.ceil(max(a["x1"], b["x1"]))), "y1": float(np.ceil(max(a["y1"], b["y1"])))}
                        rows[i] = best
                        del rows[j]
                        changed = True
                        break
                if changed:
                    break
        return rows

    def work(frame: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((_sortable(frame[box_id]), page))]
        starts, sizes = _pages(page)
        xy, met = _corners(frame), np.zeros(len(starts), bool)
        for some, rows, own in _by_size(starts, sizes):
            x0, y0, x1, y1 = (np.where(own, xy[rows, k], np.nan) for k in range(4))
            area = (x1 - x0) * (y1 - y0)
            for i in range(own.shape[1] - 1):
                a, b = np.s_[:, i, None], np.s_[:, i + 1 :]
                w, h, small = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b]), np.minimum(area[a], area[b])
                some_area = (w > 0) & (h > 0) & (small > 0)
                met[some] |= (some_area & (w * h / np.where(some_area, small, 1) >= overlap)).any(axis=1)
        # Only pages on which two boxes meet are worked on one by one.
        alone = frame[~met[page]]
        done = [r for p in np.flatnonzero(met) for r in merged(frame.iloc[starts[p] : starts[p] + sizes[p]].to_dict("records"))]
        return pd.concat([alone, pd.DataFrame(done, columns=frame.columns)], ignore_index=True) if done else alone

    return by_pages(boxes, keys, work, _schema(boxes))


def relabel_formulas(formulas: DataFrame, parents: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id", cover: float = FORMULA_COVER) -> DataFrame:
    """formulas with formula_type: inline_formula where a parent covers `cover` of them, else display_formula."""
    hit = pairs(formulas, parents, keys, g.overlap_of_first(Box.named("a_"), Box.named("b_")) >= cover, "left_semi").select(*keys, F.col(f"a_{box_id}").alias(box_id), F.lit(True).alias("hit"))
    return formulas.join(hit, [*keys, box_id], "left").withColumn("formula_type", F.when(F.col("hit"), "inline_formula").otherwise("display_formula")).drop("hit")


def header_or_footer(kind: Column, box: Box, page_height: Column) -> Column:
    """A header in the lower half of the page is a footer and a footer in the upper half a header."""
    middle = box.center[1]
    return F.when((kind == "header") & (middle > page_height / 2), "footer").when((kind == "footer") & (middle < page_height / 2), "header").otherwise(kind)


def rows_first(boxes: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id", same_row: float = SAME_ROW) -> DataFrame:
    """boxes with place (from 0): by y, then x; a box moves before its forerunner while both begin within same_row of height and it begins further left."""

    def work(frame: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((_sortable(frame[box_id]), frame["x0"].to_numpy(), frame["y0"].to_numpy(), page))]
        starts, sizes = _pages(page)
        x, y, placed = frame["x0"].to_numpy().copy(), frame["y0"].to_numpy().copy(), np.arange(len(frame))
        for i in range(sizes.max() - 1):
            at = starts[sizes > i + 1] + i  # of each page the box that may go back, one place behind
            while len(at):
                back = ~(np.abs(y[at + 1] - y[at]) >= same_row) & ~(x[at + 1] >= x[at])
                at = at[back]
                for v in (x, y, placed):
                    v[at], v[at + 1] = v[at + 1], v[at]
                at = at[~np.isin(at, starts)] - 1
        return frame.iloc[placed].assign(place=_in_pages(sizes))

    return by_pages(boxes, keys, work, _schema(boxes, "place long"))


def _largest_gap(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """(width, where) of the widest empty stretch between intervals, by the running maximum of their ends."""
    order = np.argsort(low, kind="stable")
    reached = np.maximum.accumulate(high[order])[:-1]
    gaps = low[order][1:] - reached
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    k = int(gaps.argmax())
    return float(gaps[k]), float(reached[k] + gaps[k] / 2)


def cut_order(xy: np.ndarray, least_gap: float = LEAST_GAP, narrow: float = NARROW_SHARE) -> list[int]:
    """Reading order of boxes by recursive cuts along their widest gap; rows by (y, x) where there is no gap of least_gap.

    A vertical gap is also sought without boxes narrower than `narrow` of the region, which may bridge columns; those
    then join the side that holds their centre.
    """

    def walk(ids: np.ndarray) -> list[int]:
        if len(ids) <= 1:
            return ids.tolist()
        b = xy[ids]
        vertical, x = _largest_gap(b[:, 0], b[:, 2])
        horizontal, y = _largest_gap(b[:, 1], b[:, 3])
        if vertical < least_gap:
            width = b[:, 2].max() - b[:, 0].min()
            wide = b[:, 2] - b[:, 0] >= narrow * width
            if 1 < wide.sum() < len(ids):
                again, where = _largest_gap(b[wide, 0], b[wide, 2])
                if again >= least_gap and again > vertical:
                    vertical, x = again, where
        if max(vertical, horizontal) < least_gap:
            return ids[np.lexsort((ids, b[:, 0], b[:, 1]))].tolist()
        first = (b[:, 1] + b[:, 3]) / 2 < y if horizontal >= vertical else (b[:, 0] + b[:, 2]) / 2 < x
        if first.all() or not first.any():
            return ids[np.lexsort((ids, b[:, 0], b[:, 1]))].tolist()
        return walk(ids[first]) + walk(ids[~first])

    return walk(np.arange(len(xy)))


def _largest_gaps(low: np.ndarray, high: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_largest_gap of each row of padded intervals."""
    order = np.argsort(np.where(own, low, np.inf), axis=1, kind="stable")
    place = lambda v, pad: np.take_along_axis(np.where(own, v, pad), order, axis=1)
    begin, reached = place(low, np.inf)[:, 1:], np.maximum.accumulate(place(high, -np.inf), axis=1)[:, :-1]
    gaps = np.where(np.isfinite(begin), begin - reached, -np.inf)
    k = gaps.argmax(axis=1)[:, None]
    widest, where = (np.take_along_axis(v, k, axis=1)[:, 0] for v in (gaps, reached))
    return np.where(widest > 0, widest, 0.0), np.where(widest > 0, where + widest / 2, 0.0)


def cut_orders(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least_gap: float = LEAST_GAP, narrow: float = NARROW_SHARE) -> np.ndarray:
    """cut_order of many pages (boxes of sizes from starts on): the boxes in reading order, each page in its own places. One round cuts all regions of one depth."""
    placed = np.arange(len(xy))
    finite = np.isfinite(xy).all(axis=1)
    odd = np.array([not finite[a : a + n].all() for a, n in zip(starts, sizes)], bool) if not finite.all() else np.zeros(len(starts), bool)
    for a, n in zip(starts[odd], sizes[odd]):
        placed[a : a + n] = a + np.array(cut_order(xy[a : a + n], least_gap, narrow))
    starts, sizes = starts[~odd & (sizes > 1)], sizes[~odd & (sizes > 1)]
    while len(starts):
        more = []
        for some, rows, own in _by_size(starts, sizes):
            ids, size = placed[rows], sizes[some]
            x0, y0, x1, y1 = (xy[ids, k] for k in range(4))
            vertical, x = _largest_gaps(x0, x1, own)
            horizontal, y = _largest_gaps(y0, y1, own)
            width = np.where(own, x1, -np.inf).max(axis=1) - np.where(own, x0, np.inf).min(axis=1)
            wide = own & (x1 - x0 >= narrow * width[:, None])
            count = wide.sum(axis=1)
            again = np.flatnonzero((vertical < least_gap) & (count > 1) & (count < size))
            if len(again):
                gap, where = _largest_gaps(x0[again], x1[again], wide[again])
                better = (gap >= least_gap) & (gap > vertical[again])
                vertical[again[better]], x[again[better]] = gap[better], where[better]
            first = np.where((horizontal >= vertical)[:, None], (y0 + y1) / 2 < y[:, None], (x0 + x1) / 2 < x[:, None]) & own
            n = first.sum(axis=1)
            whole = (np.maximum(vertical, horizontal) < least_gap) | (n == 0) | (n == size)
            region = np.broadcast_to(np.arange(len(some))[:, None], own.shape)
            for these, by in ((own & whole[:, None], lambda m: np.lexsort((ids[m], x0[m], y0[m], region[m]))), (own & ~whole[:, None], lambda m: np.lexsort((~first[m], region[m])))):
                placed[rows[these]] = ids[these][by(these)]
            a, n, size = starts[some][~whole], n[~whole], size[~whole]
            more += [(a, n), (a + n, size - n)]
        starts, sizes = (np.concatenate(v) for v in zip(*more))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    return placed


def _in_pages(sizes: np.ndarray) -> np.ndarray:
    """Places from 0 within each page."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def reading_places(boxes: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id") -> DataFrame:
    """boxes with place (from 0) in cut_order."""

    def work(frame: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((_sortable(frame[box_id]), page))]
        starts, sizes = _pages(page)
        return frame.iloc[cut_orders(_corners(frame), starts, sizes)].assign(place=_in_pages(sizes))

    return by_pages(boxes, keys, work, _schema(boxes, "place long"))


def union_area(boxes: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, area: what all boxes of a page cover together."""

    def work(frame: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        starts, sizes = _pages(page)
        xy, area = _corners(frame), np.zeros(len(starts))
        for some, rows, own in _by_size(starts, sizes):
            own = own & (xy[rows, 0] < xy[rows, 2]) & (xy[rows, 1] < xy[rows, 3])
            x0, y0, x1, y1 = (np.where(own, xy[rows, k], np.inf) for k in range(4))
            edges = np.sort(np.concatenate([x0, x1], axis=1), axis=1)
            left, right = edges[:, :-1], edges[:, 1:]
            covered, reached = np.zeros(left.shape), np.full(left.shape, -np.inf)
            order = np.argsort(y0, axis=1, kind="stable")
            # In each strip between two edges: the boxes from above, each by what it adds below those before it.
            for j in order.T[: own.sum(axis=1).max(initial=0)]:
                of = lambda v: np.take_along_axis(v, j[:, None], axis=1)
                low = of(y1)
                begin = np.maximum(of(y0), reached)
                adds = of(own) & (of(x0) <= left) & (of(x1) >= right) & (low > begin)
                covered += np.where(adds, low, 0.0) - np.where(adds, begin, 0.0)
                reached = np.where(adds, low, reached)
            inside = np.isfinite(right)
            area[some] = (covered * (np.where(inside, right, 0.0) - np.where(inside, left, 0.0))).sum(axis=1)
        return frame.iloc[starts][list(keys)].assign(area=area)

    return by_pages(boxes, keys, work, ", ".join([*(f"{k} {dict(boxes.dtypes)[k]}" for k in keys), "area double"]))
