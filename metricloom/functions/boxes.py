"""Bounding boxes [left, top, right, bottom] in NumPy: overlaps and the greedy matches of many images side by side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs of boxes, over all images side by side, at a time.
PAIRS = 1 << 19


def areas(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(0, boxes[..., 2] - boxes[..., 0]) * np.maximum(0, boxes[..., 3] - boxes[..., 1])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each pair within each image; 0 where both are empty."""
    low, high = np.maximum(a[..., :, None, :2], b[..., None, :, :2]), np.minimum(a[..., :, None, 2:4], b[..., None, :, 2:4])
    common = np.prod(np.maximum(0, high - low), axis=-1)
    union = areas(a)[..., :, None] + areas(b)[..., None, :] - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def _padded(rows: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` of each image side by side, and which of them are real."""
    at = first[:, None] + np.arange(width)
    real = np.arange(width) < count[:, None]
    return rows[np.where(real, at, 0)] if len(rows) else np.zeros((*at.shape, rows.shape[1])), real


def _runs(states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal states other than 0 along the last axis: flat row, state, first place and length."""
    flat = states.reshape(-1, states.shape[-1])
    new = np.ones(flat.shape, bool)
    new[:, 1:] = flat[:, 1:] != flat[:, :-1]
    row, first = np.nonzero(new)
    length = np.diff(np.append(row * flat.shape[1] + first, flat.size))
    state = flat[row, first]
    held = state > 0
    return row[held], state[held], first[held], length[held]


def matched(truth: np.ndarray, truth_of: np.ndarray, found: np.ndarray, found_of: np.ndarray, images: int, ious: Sequence[float] = (0.5,), class_id: int | None = None, area: tuple[float, float] | None = None, most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Image, label, prediction, first threshold and number of thresholds of each box, for runs of ``ious`` that agree.

    ``truth``: rows of box and class, ``found``: rows of box, class and score, each with the number of its image, in their
    order. Detections of the class, best first and at most ``most``, each take the true box that overlaps most, and at
    least by the threshold, among those not yet taken (of equal ones the later). A taken box is (1, score), another
    detection (0, score), another box (1, 0). Boxes outside the ``area`` range don't count; a detection is within by its
    own area unless it took a box. Images with like numbers of boxes go through the ranks of detections together.
    """
    if class_id is not None:
        keep = truth[:, 4] == class_id
        truth, truth_of = truth[keep], truth_of[keep]
        keep = found[:, 4] == class_id
        found, found_of = found[keep], found_of[keep]
    order = np.lexsort((-found[:, 5], found_of))
    found, found_of = found[order], found_of[order]
    n_truth, n_found = np.bincount(truth_of, minlength=images), np.bincount(found_of, minlength=images)
    truth_first, found_first = np.cumsum(n_truth) - n_truth, np.cumsum(n_found) - n_found
    if most is not None:
        n_found = np.minimum(n_found, most)
    steps = np.asarray(ious, float)
    size = lambda n: np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)
    kind = size(n_truth) * 64 + size(n_found)
    for k in np.unique(kind[(n_truth > 0) | (n_found > 0)]):
        group = np.flatnonzero(kind == k)
        wide_t, wide_f = int(n_truth[group].max()), int(n_found[group].max())
        each = max(1, PAIRS // (max(1, wide_t) * max(1, wide_f)))
        for part in np.split(group, np.arange(each, len(group), each)):
            t, t_real = _padded(truth, truth_first[part], n_truth[part], wide_t)
            f, f_real = _padded(found, found_first[part], n_found[part], wide_f)
            within = lambda boxes: np.ones(boxes.shape[:-1], bool) if area is None else (areas(boxes) >= area[0]) & (areas(boxes) <= area[1])
            counts, own = within(t) & t_real, within(f) & f_real
            shared = overlaps(f, t)
            free = np.repeat(t_real[:, None, :], len(steps), 1)
            states = np.zeros((len(part), wide_f, len(steps)), np.int8)  # 1: no match, 2: a match, 0: doesn't count
            for rank in range(wide_f if wide_t else 0):
                ok = free & (shared[:, rank, None, :] >= steps[None, :, None]) & f_real[:, rank, None, None]
                value = np.where(ok, shared[:, rank, None, :], -1.0)
                best = wide_t - 1 - np.argmax(value[:, :, ::-1], axis=2)
                image, step = np.nonzero(ok.any(2))
                taken = best[image, step]
                free[image, step, taken] = False
                states[image, rank, step] = np.where(counts[image, taken], 2, -1)
            states = np.where(states == 0, own[:, :, None], np.maximum(states, 0)).astype(np.int8)
            row, state, first, length = _runs(states)
            yield part[row // wide_f if wide_f else row], (state == 2).astype(float), f[:, :, 5].ravel()[row], first, length
            row, _, first, length = _runs((free & counts[:, None, :]).transpose(0, 2, 1).astype(np.int8))
            yield part[row // wide_t if wide_t else row], np.ones(len(row)), np.zeros(len(row)), first, length


def matches(truth: list[list[float]], found: list[list[float]], ious: Sequence[float] = (0.5,), class_id: int | None = None, area: tuple[float, float] | None = None, most: int | None = None) -> list[list[tuple[float, float]]]:
    """Labels and predictions of one image at each overlap threshold."""
    out: list[list[tuple[float, float]]] = [[] for _ in ious]
    t, f = np.array(truth, float).reshape(-1, 5), np.array(found, float).reshape(-1, 6)
    for part in matched(t, np.zeros(len(t), np.int64), f, np.zeros(len(f), np.int64), 1, ious, class_id, area, most):
        for _, label, score, first, n in zip(*(x.tolist() for x in part), strict=True):
            for k in range(first, first + n):
                out[k].append((label, score))
    return out
