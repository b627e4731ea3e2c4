"""Pictures as rows: damage, strategies, scores, the best of each.

Kernels run in Arrow batches, a picture a row. Repair takes the pictures of one size in a batch as a stack [n, c, y, x].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import damage, kernels, regional
from ..plans.forensics import FAMILY_ORDER, STRATEGIES

PICTURE = "image_id string, height int, width int, n_channels int, data binary"


def pack(pixels: DataFrame) -> DataFrame:
    """Pixel relation (vec_id, y, x, v) -> one row a picture."""
    rows = pixels.groupBy("vec_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    hexed = F.unhex(F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["v"]), 2, "0")), ""))
    return rows.select(F.col("vec_id").cast("string").alias("image_id"), "height", "width", F.lit(1).alias("n_channels"), hexed.alias("data"))


def picture(row) -> np.ndarray:
    a = np.frombuffer(row.data, np.uint8)
    return a.reshape(row.height, row.width) if row.n_channels == 1 else a.reshape(row.height, row.width, row.n_channels)


def seed_of(image_id: str, salt: int) -> np.random.Generator:
    return np.random.default_rng([salt, *image_id.encode()])


#: Bytes of the pictures of a stack.
STACK = 1 << 16


def stacked(f):
    """f(rows of pictures of one size) -> rows, as a function of one row; f itself is its `stack`."""

    def one(row):
        return f([row])

    one.stack = f
    return one


def stacks(rows: list) -> Iterator[list]:
    """rows by size of picture, some at a time."""
    shapes: dict[tuple, list] = {}
    for row in rows:
        shapes.setdefault((row.height, row.width, row.n_channels), []).append(row)
    for shape, own in shapes.items():
        n = max(1, STACK // max(1, int(np.prod(shape))))
        yield from (own[i : i + n] for i in range(0, len(own), n))


def each(pictures: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> list of rows, over all pictures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = batch.itertuples(index=False)
            if not hasattr(f, "stack"):
                yield pd.DataFrame([x for row in rows for x in f(row)], columns=names)
                continue
            for some in stacks(list(rows)):
                yield pd.DataFrame(list(f.stack(some)), columns=names)

    return pictures.mapInPandas(run, schema)


def corrupt(pictures: DataFrame, kinds: list[str] | None = None, seed: int = 42, imperfect: bool = False) -> DataFrame:
    """One row a picture and kind of damage: image_id, kind, data, mask, touched (pixels of the mask).

    With imperfect set the mask is one that a poor detector would give.
    """

    def f(row):
        for i, kind in enumerate(kinds or damage.KINDS):
            out, mask = damage.KINDS[kind](picture(row), seed_of(row.image_id, seed + i))
            if imperfect:
                mask = damage.imperfect(mask, seed_of(row.image_id, seed + i))
            yield row.image_id, kind, row.height, row.width, row.n_channels, row.data, out.tobytes(), mask.tobytes(), int(mask.sum())

    return each(pictures, f, "image_id string, kind string, height int, width int, n_channels int, original binary, data binary, mask binary, touched long")


def planes_of(pictures: list[np.ndarray]) -> np.ndarray:
    """[y, x] or [y, x, c] pictures of one size -> [n, c, y, x]."""
    a = np.stack(pictures)
    return a[:, None] if a.ndim == 3 else np.ascontiguousarray(np.moveaxis(a, 3, 1))


def picture_of(planes: np.ndarray, like: np.ndarray) -> np.ndarray:
    """[c, y, x] -> a picture of the form of `like`."""
    return planes[0] if like.ndim == 2 else np.moveaxis(planes, 0, 2)


def by_mask(f):
    """f(pictures, mask) of stacks with one mask as a function of stacks (pictures, masks)."""

    def run(pictures: np.ndarray, masks: np.ndarray) -> np.ndarray:
        flat = np.packbits(masks.reshape(len(masks), -1), axis=1)
        _, first, kind = np.unique(flat.view(f"V{flat.shape[1]}").ravel(), return_index=True, return_inverse=True)
        out = np.empty_like(pictures)
        order = np.argsort(kind, kind="stable")
        for at, own in zip(first, np.split(order, np.cumsum(np.bincount(kind))[:-1]), strict=True):
            out[own] = f(pictures[own], masks[at])
        return out

    return run


def by_plane(f):
    """f(planes) as a function of stacks (pictures, masks)."""
    return lambda pictures, masks: f(pictures.reshape(-1, *pictures.shape[2:])).reshape(pictures.shape)


def inpainting(radius: int):
    return by_mask(lambda pictures, mask: kernels.inpaint_planes(pictures.reshape(-1, *mask.shape), mask, radius).reshape(pictures.shape))


def one_by_one(fix):
    """fix(picture, mask) of one picture as a function of stacks (pictures, masks)."""

    def run(pictures: np.ndarray, masks: np.ndarray) -> np.ndarray:
        single = [p[0] if len(p) == 1 else np.moveaxis(p, 0, 2) for p in pictures]
        return planes_of([fix(i, m) for i, m in zip(single, masks, strict=True)])

    return run


def executor(name: str, base: int = 3):
    """(picture, mask) -> picture of a strategy's name; its `stack` does so with stacks."""
    stack = stack_executor(name, base)

    def fix(i, m):
        return picture_of(stack(planes_of([i]), m[None])[0], i)

    fix.stack = stack
    return fix


def stack_executor(name: str, base: int = 3):
    """(pictures [n, c, y, x], masks [n, y, x]) -> pictures of a strategy's name."""
    k = kernels
    radius = {"inpainting_r3": max(3, base), "inpainting_r5": max(5, base + 2), "inpainting_r7": max(7, base + 4)}
    plain = {
        "denoise_median_blur": k.median.planes,
        "denoise_gaussian_blur": k.gaussian.planes,
        "denoise_bilateral": k.bilateral.planes,
        "deblur_light": k.column_smooth.planes,
        "deblur_strong": lambda p: k.column_smooth.planes(p, 2),
        "block_repair": k.box.planes,
    }
    if name == "conservative":
        return lambda i, m: i
    if name in plain:
        return by_plane(plain[name])
    if name in radius:
        return inpainting(radius[name])
    steps = None
    if name == "hybrid_denoise_inpaint":
        steps = [by_plane(k.median.planes), inpainting(max(5, base))]
    if name in CHAINS:
        steps = [CHAIN_STEPS.get(step) or stack_executor(step, base) for step in CHAINS[name]]
    if steps:

        def chain(i, m):
            for step in steps:
                i = step(i, m)
            return i

        return chain
    if name.startswith("criminisi_p"):
        size = int(name[11:])
        fill = one_by_one(lambda i, m: k.exemplar_fill(i, m, size))
        return lambda i, m: inpainting(3)(i, m) if min(m.shape[1:]) < size else fill(i, m)
    if name.startswith("patchmatch_p"):
        size, _, times = name[12:].partition("_i")
        return by_mask(lambda pictures, mask: k.onion_planes(pictures, mask, int(size), times=int(times or 5)))
    if name == "meta_regional":
        return lambda i, m: regional.meta_regional_stack(i, m)[0]
    raise ValueError(f"no strategy {name}")


# The steps of the composite strategies. Radii in chains are as named; a widened mask is not used by what follows.
CHAINS = {
    "denoise_then_inpaint": ("denoise_median_blur", "inpainting_r5"),
    "inpaint_then_sharpen": ("inpainting_r5", "deblur_light"),
    "deblur_then_inpaint": ("deblur_light", "inpainting_r3"),
    "block_then_inpaint": ("block_repair", "inpainting_r3"),
    "mask_dilate_inpaint": ("mask_dilate", "inpainting_r5"),
    "multi_pass_inpaint": ("inpainting_r3", "inpainting_r5", "inpainting_r7"),
}
CHAIN_STEPS = {"mask_dilate": lambda i, m: i} | {f"inpainting_r{r}": inpainting(r) for r in (3, 5, 7)}


def strategies(recommended: str = "hybrid", exhaustive: bool = False, base: int = 3) -> list[tuple[str, str, object]]:
    """(name, family, (picture, mask) -> picture): the baseline, then the plan in the order of the recommendation."""
    order = FAMILY_ORDER.get(recommended, FAMILY_ORDER["hybrid"])
    plan = [("conservative", "conservative")]
    for family in order:
        plan += [(s, family) for s in STRATEGIES[family]]
        if exhaustive and family == "patchmatch":
            plan.append(("patchmatch_p15_i20", "patchmatch"))
        if exhaustive and family == "inpainting":
            plan += [("criminisi_p9", "criminisi"), ("criminisi_p15", "criminisi")]
    if exhaustive:
        plan.append(("meta_regional", "meta_regional"))
    return [(name, family, executor(name, base)) for name, family in plan]


def grays(pictures: np.ndarray) -> np.ndarray:
    return pictures[:, 0] if pictures.shape[1] == 1 else kernels.gray(np.moveaxis(pictures[:, :3], 1, 3).reshape(len(pictures), -1, 3)).reshape(len(pictures), *pictures.shape[2:])


def of_each(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).reshape(len(a), -1)


def histograms(values: np.ndarray, size: int) -> np.ndarray:
    """Counts of the values below size in each row."""
    return np.bincount((np.arange(len(values))[:, None] * size + values).ravel(), minlength=len(values) * size).reshape(-1, size)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two stacks' planes by histograms of 32 bins; negative is 0, and flat histograms are alike."""
    x, y = (histograms(of_each(i) // 8, 32) / i[0].size for i in (a, b))
    flat = x.std(1) * y.std(1)
    both = ((x - x.mean(1)[:, None]) * (y - y.mean(1)[:, None])).mean(1)
    return np.where(flat > 0, np.maximum(0.0, both / np.where(flat > 0, flat, 1)), 1.0)


def blind_scores(before: np.ndarray, after: np.ndarray, masks: np.ndarray | None = None) -> np.ndarray:
    """blind_score() of each picture of a stack."""
    a, b = grays(before), grays(after)
    n, h, w = b.shape
    sharp = np.minimum(of_each(kernels.laplacian(b)).var(1) / 120, 1)
    noise = 1 - np.minimum(of_each(np.abs(b.astype(float) - kernels.gaussian.planes(b, 3))).mean(1) / 40, 1)
    da, db = (of_each(kernels.edges(i)).mean(1) for i in (a, b))
    edge = np.maximum(0.0, 1 - np.abs(da - db) / np.maximum(da, 0.001))
    flat = lambda i: i.reshape(-1, h, w)
    colour = alike(flat(before), flat(after)).reshape(n, -1).mean(1)
    size = 8
    down, along = len(range(0, h - size, size)), len(range(0, w - size, size))
    entropy, artefact = np.zeros(n), np.ones(n)
    if down and along:
        blocks = np.moveaxis(b[:, : down * size, : along * size].reshape(n, down, size, along, size), 2, 3).reshape(n * down * along, -1)
        p = histograms(blocks // 16, 16) / blocks.shape[1]
        entropy = np.minimum((-(p * np.log2(p + 1e-9)).sum(1)).reshape(n, -1).mean(1) / 4, 1)
        artefact = 1 - np.minimum(blocks.var(1).reshape(n, -1).mean(1) / 500, 1)
    delta = of_each(np.abs(a.astype(float) - b))
    mask = np.zeros(delta.shape, bool) if masks is None else of_each(masks)
    marked = mask.sum(1)
    outside = (delta * ~mask).sum(1) / np.maximum(1, mask.shape[1] - marked)
    consistent = np.maximum(0.2, 1 - np.minimum(outside / 80, 0.8))
    inside = (delta * mask).sum(1) / np.maximum(1, marked)
    effort = np.where(marked == 0, 1.0, np.where(inside < 3, 0.45, np.where(inside < 15, 0.60 + inside / 75, np.minimum(1.0, 0.80 + inside / 200))))
    return np.clip(100 * consistent * effort * (0.25 * sharp + 0.20 * noise + 0.20 * edge + 0.15 * colour + 0.10 * entropy + 0.10 * artefact), 0, 100)


def blind_score(before: np.ndarray, after: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Quality without an original: sharpness, noise, edges, colour, entropy, artefacts, times consistency and effort.

    With a mask consistency goes by the change outside it alone, and effort by the change inside; without one by the
    whole change, at full effort.
    """
    return float(blind_scores(planes_of([before]), planes_of([after]), None if mask is None else mask[None])[0])


def peaks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signal to noise ratio of each picture of two stacks."""
    mse = of_each((a.astype(float) - b.astype(float)) ** 2).mean(1)
    return np.where(mse == 0, 100.0, 10 * np.log10(255**2 / np.where(mse == 0, 1, mse)))


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    flat = lambda i: i.reshape(-1, *i.shape[2:])
    return kernels.similarities(flat(a), flat(b)).reshape(len(a), -1).mean(1)


def supervised_scores(original: np.ndarray, before: np.ndarray, after: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """supervised_score() of each picture of a stack."""
    p0, p1 = peaks(original, before), peaks(original, after)
    s0, s1 = similarities(original, before), similarities(original, after)
    whole, (h, w) = s1.copy(), masks.shape[1:]
    some = np.flatnonzero(masks.any((1, 2)))
    down, along = masks[some].any(2), masks[some].any(1)
    low = lambda a: np.maximum(0, a.argmax(1) - 8)
    high = lambda a, n: np.minimum(n, n - a[:, ::-1].argmax(1) + 8)
    boxes, kind = np.unique(np.stack([low(down), high(down, h), low(along), high(along, w)], 1), axis=0, return_inverse=True)
    for i, (y0, y1, x0, x1) in enumerate(boxes):
        own = some[kind.ravel() == i]
        a, b = original[own][:, :, y0:y1, x0:x1], after[own][:, :, y0:y1, x0:x1]
        zone = similarities(a, b) if min(a.shape[2:]) >= 7 else np.maximum(0.0, 1 - np.sqrt(of_each((a.astype(float) - b) ** 2).mean(1)) / 255)
        weight = np.maximum(0.3, 0.8 - 2 * of_each(masks[own]).mean(1))
        whole[own] = weight * zone + (1 - weight) * s1[own]
    return np.clip(60 * whole + 0.2 * np.minimum(p1, 100) + 30 * np.maximum(0.0, s1 - s0) + 0.2 * np.maximum(0.0, p1 - p0), 0, 100), p1, s1


def supervised_score(original: np.ndarray, before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    """(score, psnr, ssim): structure weighs most, in the mask's box the more the smaller the mask is."""
    return tuple(float(x[0]) for x in supervised_scores(planes_of([original]), planes_of([before]), planes_of([after]), mask[None]))


def refine(before: np.ndarray, after: np.ndarray, masks: np.ndarray, score, base: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Further inpainting of the best results at radius base, base + 2, base + 4: each must beat the best by over 0.1, or it ends.

    Stacks in, (pictures, which of them gained) out; score(pictures, places) gives the scores of those at places.
    """
    best, gained, left = after.copy(), np.zeros(len(after), bool), np.arange(len(after))
    top = score(best, left)
    for radius in (base, base + 2, base + 4):
        tried = inpainting(radius)(best[left], masks[left])
        now = score(tried, left)
        more = now > top[left] + 0.1
        left, tried, now = left[more], tried[more], now[more]
        if not len(left):
            break
        best[left], top[left], gained[left] = tried, now, True
    return best, gained


FAULTS = (ValueError, IndexError, FloatingPointError)


def attempt(fix, pictures: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
    """The pictures mended by a strategy, and the faults of those it failed on, by place."""
    run = getattr(fix, "stack", None) or one_by_one(fix)
    try:
        return run(pictures, masks), {}
    except FAULTS as fault:
        if len(pictures) == 1:
            return pictures, {0: str(fault)}
    parts = [attempt(fix, pictures[i : i + 1], masks[i : i + 1]) for i in range(len(pictures))]
    return np.concatenate([p for p, _ in parts]), {i: fault[0] for i, (_, fault) in enumerate(parts) if fault}


def repair(corrupted: DataFrame, most: int | None = None, supervised: bool = True, recommended: str = "hybrid", exhaustive: bool = False) -> DataFrame:
    """One row a damaged picture and strategy: image_id, kind, seq, strategy, family, score, psnr, ssim, blind, error, data.

    A strategy that fails on a picture has its fault in `error` and no score; the others go on. `most` bounds the rows
    with a result, the baseline among them. Last comes an iterative pass over the best, if it gains. With supervised off
    the original isn't read; psnr and ssim are null.
    """

    plan = strategies(recommended, exhaustive)

    @stacked
    def f(rows):
        like = picture(rows[0])
        before = planes_of([picture(row) for row in rows])
        masks = np.stack([np.frombuffer(row.mask, bool).reshape(like.shape[:2]) for row in rows])
        original = planes_of([np.frombuffer(row.original, np.uint8).reshape(like.shape) for row in rows]) if supervised else None

        def judged(after, at):
            blind = blind_scores(before[at], after, masks[at])
            none = [None] * len(blind)
            return [x.tolist() for x in supervised_scores(original[at], before[at], after, masks[at])] + [blind.tolist()] if supervised else [blind.tolist(), none, none, blind.tolist()]

        n = len(rows)
        top, kept, done = np.full(n, -np.inf), before.copy(), np.zeros(n, int)
        last, over = np.full(n, -1), np.zeros(n, bool)
        for seq, (name, family, fix) in enumerate(plan):
            last[~over] = seq
            over = over if most is None else done >= most
            at = np.flatnonzero(~over)
            if not len(at):
                break
            after, faults = attempt(fix, before[at], masks[at])
            good = np.array([i not in faults for i in range(len(at))])
            for i, fault in faults.items():
                yield rows[at[i]].image_id, rows[at[i]].kind, seq, name, family, None, None, None, None, fault, None
            at, after = at[good], after[good]
            if not len(at):
                continue
            done[at] += 1
            scores = judged(after, at)
            better = np.array(scores[0]) > top[at]
            top[at[better]], kept[at[better]] = np.array(scores[0])[better], after[better]
            for i, new, score, p, s, blind in zip(at, after, *scores, strict=True):
                yield rows[i].image_id, rows[i].kind, seq, name, family, round(score, 6), p, s, blind, None, picture_of(new, like).tobytes()
        some = np.flatnonzero((done > 0) & masks.any((1, 2)))
        if len(some):
            further, gained = refine(before[some], kept[some], masks[some], lambda after, at: np.array(judged(after, some[at])[0]))
            some, further = some[gained], further[gained]
            for i, new, score, p, s, blind in zip(some, further, *judged(further, some), strict=True) if len(some) else ():
                yield rows[i].image_id, rows[i].kind, int(last[i]) + 1, "iterative", "iterative", round(score, 6), p, s, blind, None, picture_of(new, like).tobytes()

    return each(corrupted, f, "image_id string, kind string, seq int, strategy string, family string, score double, psnr double, ssim double, blind double, error string, data binary")


def regional_repair(corrupted: DataFrame) -> DataFrame:
    """One row a region: image_id, kind, region, region_type, strategy, area, score, and the picture's weighted score."""

    @stacked
    def f(rows):
        before = [picture(row) for row in rows]
        masks = np.stack([np.frombuffer(row.mask, bool).reshape(before[0].shape[:2]) for row in rows])
        _, wholes, found = regional.meta_regional_stack(planes_of(before), masks)
        for row, whole, report in zip(rows, wholes, found, strict=True):
            for i, (name, strategy, area, score) in enumerate(report):
                yield row.image_id, row.kind, i, name, strategy, area, score, whole

    return each(corrupted, f, "image_id string, kind string, region int, region_type string, strategy string, area long, score double, weighted double")


def top_roles(candidates: DataFrame) -> DataFrame:
    """The best three of each damaged picture with their roles."""
    w = Window.partitionBy("image_id", "kind").orderBy(F.desc("score"), "seq")
    role = F.element_at(F.array(F.lit("best"), F.lit("second"), F.lit("third")), F.col("place"))
    return candidates.where("score is not null").withColumn("place", F.row_number().over(w)).where("place <= 3").withColumn("role", role)


def best(candidates: DataFrame) -> DataFrame:
    """The best candidate of each damaged picture; ties go to the earlier strategy."""
    w = Window.partitionBy("image_id", "kind").orderBy(F.desc("score"), "seq")
    return candidates.where("score is not null").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def hashes(pictures: DataFrame) -> DataFrame:
    def f(row):
        g = kernels.gray(picture(row))
        yield row.image_id, f"{kernels.difference_hash(g):016x}", f"{kernels.dct_hash(g):016x}"

    return each(pictures, f, "image_id string, dhash string, phash string")


def regions(corrupted: DataFrame) -> DataFrame:
    """Connected parts of the masks: image_id, kind, region, area."""

    def f(row):
        label = kernels.components(np.frombuffer(row.mask, bool).reshape(row.height, row.width))
        for i, n in enumerate(np.bincount(label.ravel())[1:], 1):
            yield row.image_id, row.kind, i, int(n)

    return each(corrupted, f, "image_id string, kind string, region int, area long")


def detections(pictures: DataFrame) -> DataFrame:
    """Dark, flat and calm places fused, small parts dropped: image_id, on (pixels), parts, anomaly (mean)."""

    def f(row):
        g = kernels.gray(picture(row))
        p = np.lib.stride_tricks.sliding_window_view(np.pad(g.astype(float), 1, "reflect"), (3, 3))
        votes = (g <= 30).astype(int) + (p.var((2, 3)) < 1500) + (np.hypot(*kernels.sobel(g)) < 150)
        label = kernels.components(votes >= 2)
        areas = np.bincount(label.ravel())[1:]
        yield row.image_id, int(areas[areas >= 2].sum()), int((areas >= 2).sum()), float(kernels.anomaly_map(g).mean())

    return each(pictures, f, "image_id string, on_pixels long, parts int, anomaly double")
