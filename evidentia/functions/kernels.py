"""NumPy picture kernels: filters, stencils, similarity, morphology, components, inpainting. Pictures are uint8 [y, x] or [y, x, c].

Stacks are planes [n, y, x] of pictures of one size; stencils, morphology and components take them as they take one plane.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def per_channel(f):
    """f of planes as a kernel of one picture; f itself is its `planes`."""

    def run(img, *a, **b):
        return f(img[None], *a, **b)[0] if img.ndim == 2 else np.moveaxis(f(np.ascontiguousarray(np.moveaxis(img, 2, 0)), *a, **b), 0, 2)

    run.planes, run.__name__ = f, f.__name__
    return run


def padded(a: np.ndarray, k: int, mode: str = "constant", **more) -> np.ndarray:
    """a with k more on each side of its last two axes."""
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(k, k)] * 2, mode, **more)


def windows(a: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (n, n), (-2, -1))


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of RGB, rounded."""
    return img if img.ndim == 2 else np.rint(img @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def patches(img: np.ndarray, n: int, mode: str = "reflect") -> np.ndarray:
    """[..., y, x, n, n] neighbourhoods; pictures smaller than the reach repeat their edge."""
    k = n // 2
    small = min(img.shape[-2:]) <= k
    return windows(padded(img, k, "edge" if small else mode), n)


def gaussian_weights(n: int, sigma: float = 0.0) -> np.ndarray:
    fixed = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}
    if sigma <= 0 and n in fixed:
        w = np.array(fixed[n], float)
    else:
        sigma = sigma if sigma > 0 else 0.3 * ((n - 1) / 2 - 1) + 0.8
        w = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


@per_channel
def gaussian(img: np.ndarray, n: int = 5, sigma: float = 0.0) -> np.ndarray:
    w = gaussian_weights(n, sigma)
    return np.clip(np.rint(np.einsum("zyxij,i,j->zyx", patches(img, n).astype(float), w, w)), 0, 255).astype(np.uint8)


@per_channel
def median(img: np.ndarray, n: int = 5) -> np.ndarray:
    return np.median(patches(img, n, "edge"), axis=(-2, -1)).astype(np.uint8)


@per_channel
def box(img: np.ndarray, n: int = 8) -> np.ndarray:
    p = np.pad(img.astype(float), ((0, 0), *((n // 2, n - n // 2 - 1),) * 2), "edge" if min(img.shape[-2:]) <= n // 2 else "reflect")
    return np.rint(windows(p, n).mean((-2, -1))).astype(np.uint8)


@per_channel
def bilateral(img: np.ndarray, n: int = 7, range_sigma: float = 50.0, space_sigma: float = 50.0) -> np.ndarray:
    p = patches(img, n).astype(float)
    d = np.arange(n) - n // 2
    far = d[:, None] ** 2 + d[None] ** 2
    w = np.where(far <= (n // 2) ** 2, np.exp(-far / (2 * space_sigma**2)), 0) * np.exp(-((p - img[..., None, None].astype(float)) ** 2) / (2 * range_sigma**2))
    return np.rint((w * p).sum((-2, -1)) / w.sum((-2, -1))).astype(np.uint8)


@per_channel
def column_smooth(img: np.ndarray, times: int = 1) -> np.ndarray:
    """A 5 x 1 Gaussian of deviation 1 down the columns."""
    w = gaussian_weights(5, 1.0)
    for _ in range(times):
        img = np.rint(np.einsum("zyxij,i->zyx", patches(img, 5)[..., 2:3].astype(float), w)).astype(np.uint8)
    return img


def laplacian(g: np.ndarray) -> np.ndarray:
    p = padded(g.astype(int), 1, "reflect")
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * p[..., 1:-1, 1:-1]


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = padded(g.astype(int), 1, "reflect")
    gx = p[..., :-2, 2:] + 2 * p[..., 1:-1, 2:] + p[..., 2:, 2:] - p[..., :-2, :-2] - 2 * p[..., 1:-1, :-2] - p[..., 2:, :-2]
    gy = p[..., 2:, :-2] + 2 * p[..., 2:, 1:-1] + p[..., 2:, 2:] - p[..., :-2, :-2] - 2 * p[..., :-2, 1:-1] - p[..., :-2, 2:]
    return gx, gy


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny: local maxima along the gradient, weak ones kept where they touch strong ones."""
    gx, gy = sobel(g)
    mag = np.abs(gx) + np.abs(gy)
    p = padded(mag, 1)
    around = lambda dy, dx: p[..., 1 + dy : p.shape[-2] - 1 + dy, 1 + dx : p.shape[-1] - 1 + dx]
    steep, flat = np.abs(gy) > 2.414 * np.abs(gx), np.abs(gy) < 0.414 * np.abs(gx)
    same = (gx > 0) == (gy > 0)
    one = np.where(flat, around(0, -1), np.where(steep, around(-1, 0), np.where(same, around(-1, -1), around(-1, 1))))
    two = np.where(flat, around(0, 1), np.where(steep, around(1, 0), np.where(same, around(1, 1), around(1, -1))))
    thin = (mag > one) & (mag >= two) & (mag > low)
    label = components(thin)
    strong = np.zeros(label.max(initial=0) + 1, bool)
    strong[label[thin & (mag > high)]] = True
    strong[0] = False
    return strong[label]


def ssim(a: np.ndarray, b: np.ndarray, n: int = 7) -> float:
    """Mean structural similarity: n x n uniform windows, sample covariance, channels averaged, border left out."""
    if a.ndim == 3:
        return float(np.mean([ssim(a[..., c], b[..., c], n) for c in range(a.shape[2])]))
    return float(similarities(a[None], b[None], n)[0])


def similarities(a: np.ndarray, b: np.ndarray, n: int = 7) -> np.ndarray:
    """The structural similarity of each plane of two stacks."""
    n = min(n, *a.shape[1:]) - (1 - min(n, *a.shape[1:]) % 2)
    x, y = (windows(i.astype(float), n).reshape(len(i), -1, n * n) for i in (a, b))
    f = n * n / max(1, n * n - 1)
    ux, uy = x.mean(2), y.mean(2)
    vx, vy, vxy = f * ((x * x).mean(2) - ux * ux), f * ((y * y).mean(2) - uy * uy), f * ((x * y).mean(2) - ux * uy)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * ux * uy + c1) * (2 * vxy + c2) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))).mean(1)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(np.mean((a.astype(float) - b.astype(float)) ** 2))
    return 100.0 if mse == 0 else 10 * float(np.log10(255**2 / mse))


def dilate(mask: np.ndarray, n: int = 3) -> np.ndarray:
    return windows(padded(mask, n // 2), n).any((-2, -1))


def erode(mask: np.ndarray, n: int = 3) -> np.ndarray:
    return windows(padded(mask, n // 2, constant_values=True), n).all((-2, -1))


def opened(mask: np.ndarray, n: int = 5) -> np.ndarray:
    return dilate(erode(mask, n), n)


def closed(mask: np.ndarray, n: int = 5) -> np.ndarray:
    return erode(dilate(mask, n), n)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts of mask, 0 elsewhere; labels go by the first pixel in reading order."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = padded(np.where(mask, label, mask.size + 1), 1, constant_values=mask.size + 1)
        p = np.minimum(np.minimum(p[..., :-2, :], p[..., 1:-1, :]), p[..., 2:, :])
        low = np.where(mask, np.minimum(np.minimum(p[..., :-2], p[..., 1:-1]), p[..., 2:]), 0)
        if np.array_equal(low, label):
            break
        label = low
        flat = np.r_[0, label.ravel()]
        label = np.where(mask, flat[label], 0)  # a label's own label: roots are reached in few rounds
    rank = np.zeros(mask.size + 1, bool)
    rank[label[mask]] = True
    return np.where(mask, np.cumsum(rank)[label], 0)


def marching(mask: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(pixel, known pixels within radius, their weights, sum of these) in the order in which the mask is filled.

    Pixels are places in reading order. All goes by the mask alone, so pictures with one mask are filled together.
    """
    h, w = mask.shape
    known = ~mask
    time = np.where(known, 0.0, np.inf)
    heap = [(0.0, int(y), int(x)) for y, x in zip(*np.nonzero(known & dilate(mask)), strict=True)]
    heapq.heapify(heap)
    while heap:
        t, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if not (0 <= ny < h and 0 <= nx < w) or known[ny, nx]:
                continue
            y0, y1, x0, x1 = max(0, ny - radius), min(h, ny + radius + 1), max(0, nx - radius), min(w, nx + radius + 1)
            ys, xs = np.nonzero(known[y0:y1, x0:x1])
            ys, xs = ys + y0, xs + x0
            far = (ny - ys) ** 2 + (nx - xs) ** 2
            near = far <= radius * radius
            if near.any():
                ys, xs, far = ys[near], xs[near], far[near]
            dy, dx = ny - ys, nx - xs
            ends = [time[min(h - 1, ny + 1), nx], time[max(0, ny - 1), nx], time[ny, min(w - 1, nx + 1)], time[ny, max(0, nx - 1)]]
            ty = ends[0] - ends[1] if np.isfinite(ends[:2]).all() else 0.0
            tx = ends[2] - ends[3] if np.isfinite(ends[2:]).all() else 0.0
            way = np.abs(dy * ty + dx * tx) / np.sqrt(far) + 1e-6
            weight = way / far / (1 + np.abs(time[ys, xs] - t))
            yield ny * w + nx, ys * w + xs, weight, weight.sum()
            time[ny, nx], known[ny, nx] = t + 1, True
            heapq.heappush(heap, (t + 1, ny, nx))


#: Steps of masks of so many weights at most are kept, those of so many masks.
KEPT_WEIGHTS, KEPT_MASKS = 2048, 2048


@lru_cache(KEPT_MASKS)
def kept_steps(mask: bytes, height: int, radius: int) -> tuple:
    return tuple(marching(np.frombuffer(mask, bool).reshape(height, -1), radius))


def inpaint_planes(planes: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """inpaint() of a stack with one mask."""
    if mask.all() or not mask.any():
        return planes.copy()
    out = planes.reshape(len(planes), -1).astype(float)
    small = int(mask.sum()) * min(mask.size, (2 * radius + 1) ** 2) <= KEPT_WEIGHTS
    for at, near, weight, total in kept_steps(mask.tobytes(), len(mask), radius) if small else marching(mask, radius):
        out[:, at] = (weight * out.take(near, axis=1)).sum(1) / total
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(planes.shape)


def inpaint(img: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Fill the mask from its border inwards by fast marching; a pixel is a mean of the known ones within radius, weighted
    by direction, distance and level, with their gradients."""
    if img.ndim == 3:
        return np.moveaxis(inpaint_planes(np.ascontiguousarray(np.moveaxis(img, 2, 0)), mask, radius), 0, 2)
    return inpaint_planes(img[None], mask, radius)[0]


def exemplar_fill(img: np.ndarray, mask: np.ndarray, size: int = 5) -> np.ndarray:
    """Fill by the best known patch, at the border place of highest confidence times edge strength first.

    Sources are patches without a masked pixel, every max(1, size // 3)-th; the first of equally good ones is taken. It
    ends where no source is left, and what is then open is inpainted.
    """
    k = size // 2
    h, w = mask.shape
    if min(h, w) < size or mask.all():
        return inpaint(img, mask)
    out, todo, conf = np.atleast_3d(img).astype(np.float32), mask.copy(), (~mask).astype(np.float32)
    step = max(1, size // 3)
    windows = lambda a: np.lib.stride_tricks.sliding_window_view(a, (size, size), (0, 1))
    free = ~windows(mask)[::step, ::step].any((2, 3))
    if not free.any():
        return inpaint(img, mask)
    source = np.moveaxis(windows(np.atleast_3d(img))[::step, ::step][free], 1, -1).astype(np.float32)  # [n, size, size, c]
    while todo.any():
        ys, xs = np.nonzero(todo & dilate(~todo))
        gy, gx = np.gradient(np.where(todo, 0, out.mean(2)))
        sums = np.pad(np.pad(conf, k).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        mean = (sums[ys + size, xs + size] - sums[ys, xs + size] - sums[ys + size, xs] + sums[ys, xs]) / size**2
        at = int(np.argmax(mean * (np.hypot(gy[ys, xs], gx[ys, xs]) / 255 + 0.001)))
        y, x = min(max(ys[at], k), h - k - 1), min(max(xs[at], k), w - k - 1)
        box = np.s_[y - k : y + k + 1, x - k : x + k + 1]
        hole, known = todo[box].copy(), np.flatnonzero(~todo[box])
        diff = source.reshape(len(source), size * size, -1)[:, known] - out[box].reshape(size * size, -1)[known]
        best = source[int(np.einsum("npc,npc->n", diff, diff).argmin())]
        out[box][hole] = best[hole]
        conf[box][hole] = conf[box].mean()
        todo[box] = False
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(img.shape)


def onion_fill(img: np.ndarray, mask: np.ndarray, size: int = 5, seed: int = 0, times: int = 5) -> np.ndarray:
    """Fill ring by ring, each pixel by the centre of the most alike of `times` * 8 known patches; seeded.

    All pixels of a ring are searched over what is known around each before it.
    """
    planes = np.moveaxis(np.atleast_3d(img), 2, 0)[None]
    return np.moveaxis(onion_planes(planes, mask, size, seed, times)[0], 0, 2).reshape(img.shape)


def onion_planes(pictures: np.ndarray, mask: np.ndarray, size: int = 5, seed: int = 0, times: int = 5) -> np.ndarray:
    """onion_fill() of pictures [n, c, y, x] with one mask: which patches are looked at goes by the mask alone."""
    rng, k = np.random.default_rng(seed), size // 2
    out, todo = pictures.astype(np.float32), mask.copy()
    n, c, h, w = pictures.shape
    ys, xs = np.nonzero(~mask)
    if not len(ys):
        return pictures.copy()
    wide = w + 2 * k
    patch = (np.arange(size)[:, None] * wide + np.arange(size)).ravel()
    while todo.any():
        ry, rx = np.nonzero(todo & dilate(~todo))
        here = padded(out, k, "edge").reshape(n, c, -1)
        good = ~windows(padded(todo, k, constant_values=True), size)[ry, rx].reshape(len(ry), -1)
        picks = np.stack([rng.integers(len(ys), size=len(ry)) for _ in range(times * 8)])
        value = np.zeros((n, c, len(ry)), np.float32)
        for j in range(len(ry)):
            of = patch[good[j]]
            corner = ys[picks[:, j]] * wide + xs[picks[:, j]]
            diff = here.take(corner[:, None] + of, axis=2) - here.take(ry[j] * wide + rx[j] + of, axis=2)[:, :, None]
            best = picks[np.einsum("nctp,nctp->nt", diff, diff).argmin(1), j]
            value[:, :, j] = out[np.arange(n), :, ys[best], xs[best]]
        out[:, :, ry, rx] = value
        todo[ry, rx] = False
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def area_resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = edge[:-1, None], edge[1:, None]
        return np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None) * m / n

    return weights(g.shape[0], h) @ g.astype(float) @ weights(g.shape[1], w).T


def dct_hash(g: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest frequencies of 32 x 32 against their mean without the first."""
    n = 32
    basis = np.cos(np.pi * (2 * np.arange(n) + 1)[None] * np.arange(8)[:, None] / (2 * n))
    basis[0] *= 0.5**0.5
    low = basis @ area_resize(g, n, n) @ basis.T
    return int("".join("01"[int(b)] for b in (low > low.ravel()[1:].mean()).ravel()), 2)


def difference_hash(g: np.ndarray) -> int:
    small = area_resize(g, 8, 9)
    return int("".join("01"[int(b)] for b in (small[:, :-1] > small[:, 1:]).ravel()), 2)


def anomaly_map(g: np.ndarray) -> np.ndarray:
    spread = lambda a: (a - a.min()) / max(1e-9, a.max() - a.min())
    return (spread(np.abs(g.astype(float) - gaussian(g, 9))) + spread(np.hypot(*sobel(g)))) / 2


def png(img: np.ndarray) -> bytes:
    """The picture as a PNG file."""
    h, w = img.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(img).reshape(h, -1)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
