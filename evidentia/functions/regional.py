"""Regional repair: a mask cut into typed regions, each with its own strategies, blended and scored by area."""

from __future__ import annotations

import numpy as np

from . import kernels

MOST, LEAST = 6, 2


def segments(img: np.ndarray, mask: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(type, part) of 2 to 6 disjoint parts that make up the mask; a single pixel is one.

    Types go by the local variance (9 x 9) and gradient against their 60th and 70th percentiles in the mask; the connected
    parts of a type are regions. Of more than MOST the smallest are merged; too few are split at the median of the longer side.
    """
    return stack_segments(kernels.gray(img)[None], mask[None])[0]


def stack_segments(grays: np.ndarray, masks: np.ndarray) -> list[list[tuple[str, np.ndarray]]]:
    """segments() of each picture of a stack."""
    g = grays.astype(float)
    around = kernels.patches(g, 9)
    variance = np.maximum((around**2).mean((-2, -1)) - around.mean((-2, -1)) ** 2, 0)
    gradient = np.hypot(*kernels.sobel(g))
    rough, steep = np.zeros(len(g)), np.zeros(len(g))
    area = masks.sum((1, 2))
    for n in np.unique(area[area > 0]):
        own = area == n
        for limit, values, share in ((rough, variance, 60), (steep, gradient, 70)):
            limit[own] = np.percentile(values[own][masks[own]].reshape(-1, n), share, axis=1)
    kind = np.where(gradient >= steep[:, None, None], 2, np.where(variance >= rough[:, None, None], 1, 0))
    labels = [kernels.components(masks & (kind == k)) for k in range(3)]
    return [parts_of([label[i] for label in labels]) if area[i] else [] for i in range(len(g))]


def parts_of(labels: list[np.ndarray]) -> list[tuple[str, np.ndarray]]:
    parts = []
    for label, name in zip(labels, ("homogeneous", "textured", "strong_edges"), strict=True):
        parts += [(name, label == i) for i in np.flatnonzero(np.bincount(label.ravel()))[0 if label.all() else 1 :]]
    parts.sort(key=lambda p: -int(p[1].sum()))
    if len(parts) > MOST:
        rest = np.logical_or.reduce([p for _, p in parts[MOST - 1 :]])
        parts = [*parts[: MOST - 1], (parts[MOST - 1][0], rest)]
    while len(parts) < LEAST and parts[0][1].sum() > 1:
        name, part = parts.pop(0)
        ys, xs = np.nonzero(part)
        axis = ys if np.ptp(ys) >= np.ptp(xs) else xs
        order = np.argsort(axis, kind="stable")
        halves = [np.zeros_like(part) for _ in range(2)]
        for half, at in zip(halves, np.array_split(order, 2), strict=True):
            half[ys[at], xs[at]] = True
        parts = sorted([(name, h) for h in halves] + parts, key=lambda p: -int(p[1].sum()))
    return parts


def blend(base: np.ndarray, new: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Stacks: new inside the parts, base outside, mixed by a Gaussian of the part over 4 % of the short side (odd, 5 at least)."""
    n = max(5, int(0.04 * min(parts.shape[1:])) | 1)
    alpha = kernels.gaussian.planes((parts * 255).astype(np.uint8), n).astype(float)[:, None] / 255
    return np.clip(np.rint(base * (1 - alpha) + new * alpha), 0, 255).astype(np.uint8)


def meta_regional(img: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, float, list[tuple[str, str, int, float]]]:
    """(picture, area-weighted score, (type, strategy, area, score) of each region): the best of three strategies a region."""
    from ..operators.repair import picture_of, planes_of

    out, whole, report = meta_regional_stack(planes_of([img]), mask[None])
    return picture_of(out[0], img), whole[0], report[0]


def meta_regional_stack(pictures: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, list[float], list[list[tuple[str, str, int, float]]]]:
    """meta_regional() of each picture [c, y, x] of a stack; the regions of a type are tried together."""
    from ..operators.repair import blind_scores, grays, stack_executor
    from ..plans.forensics import REGION_PLAN

    out, report = pictures.copy(), [[] for _ in pictures]
    regions = [(i, j, name, part) for i, parts in enumerate(stack_segments(grays(pictures), masks)) for j, (name, part) in enumerate(parts)]
    mended = {}
    for kind, plan in REGION_PLAN.items():
        own = [r for r in regions if r[2] == kind]
        for some in (own[k : k + len(pictures)] for k in range(0, len(own), len(pictures))):
            img, parts = pictures[[r[0] for r in some]], np.stack([r[3] for r in some])
            tried = [stack_executor(strategy)(img, parts) for strategy in plan]
            scores = np.stack([blind_scores(img, after, parts) for after in tried])
            for k, (r, best) in enumerate(zip(some, scores.argmax(0), strict=True)):
                mended[r[:2]] = plan[best], float(scores[best, k]), tried[best][k]
    for turn in range(max((r[1] for r in regions), default=-1) + 1):
        own = [r for r in regions if r[1] == turn]
        at = [r[0] for r in own]
        out[at] = blend(out[at], np.stack([mended[r[:2]][2] for r in own]), np.stack([r[3] for r in own]))
        for i, j, name, part in own:
            report[i].append((name, mended[i, j][0], int(part.sum()), mended[i, j][1]))
    areas = [sum(r[2] for r in rows) for rows in report]
    return out, [sum(r[2] * r[3] for r in rows) / area if area else 0.0 for rows, area in zip(report, areas, strict=True)], report
