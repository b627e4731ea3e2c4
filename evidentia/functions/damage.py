"""Damage kernels: (picture, seed) -> (picture, mask). Every random choice comes from the seed."""

from __future__ import annotations

import numpy as np

from . import kernels


def zone(img: np.ndarray, rng: np.random.Generator, share: float = 0.4) -> np.ndarray:
    h, w = img.shape[:2]
    zh, zw = max(2, int(h * share)), max(2, int(w * share))
    y, x = rng.integers(0, h - zh + 1), rng.integers(0, w - zw + 1)
    mask = np.zeros((h, w), bool)
    mask[y : y + zh, x : x + zw] = True
    return mask


def rectangle(img, rng):
    mask = zone(img, rng)
    return np.where(mask if img.ndim == 2 else mask[..., None], 0, img).astype(np.uint8), mask


def noise(img, rng, sigma: float = 25.0):
    mask = zone(img, rng)
    loud = np.clip(img + rng.normal(0, sigma, img.shape), 0, 255)
    return np.where(mask if img.ndim == 2 else mask[..., None], loud, img).astype(np.uint8), mask


def salt_pepper(img, rng):
    mask, dice = zone(img, rng), rng.random(img.shape[:2])
    out = img.copy()
    out[mask & (dice < 0.05)], out[mask & (dice > 0.95)] = 0, 255
    return out, mask


def blur(img, rng):
    mask = zone(img, rng)
    return np.where(mask if img.ndim == 2 else mask[..., None], kernels.gaussian(img, 5), img).astype(np.uint8), mask


def blocks(img, rng, size: int = 2):
    mask = zone(img, rng)
    h, w = img.shape[:2]
    coarse = img[(np.arange(h) // size * size)][:, (np.arange(w) // size * size)]
    return np.where(mask if img.ndim == 2 else mask[..., None], coarse, img).astype(np.uint8), mask


def filled(img, mask, rng, fill: str = "black"):
    """img with black, white, gray or noise where mask is."""
    flat = {"black": 0, "white": 255, "gray": 127}
    new = rng.integers(0, 256, img.shape) if fill == "noise" else flat[fill]
    return np.where(mask if img.ndim == 2 else mask[..., None], new, img).astype(np.uint8)


def bars(img, rng, count: int = 2, thickness: int = 1, vertical: bool = False, fill: str = "black"):
    """Bars across the whole picture, at sorted random places."""
    mask = np.zeros(img.shape[:2], bool)
    lines = mask.T if vertical else mask
    for at in np.sort(rng.integers(0, max(1, len(lines) - thickness + 1), count)):
        lines[at : at + thickness] = True
    return filled(img, mask, rng, fill), mask


def combined(img, rng, halo: int = 10, sigma: float = 12.0):
    """A filled rectangle with noise around it; the mask holds the rectangle only, so the noise is unmarked damage."""
    mask = zone(img, rng)
    near = kernels.dilate(mask, 2 * halo + 1)
    loud = np.clip(img + rng.normal(0, sigma, img.shape), 0, 255)
    noisy = np.where(near if img.ndim == 2 else near[..., None], loud, img).astype(np.uint8)
    return filled(noisy, mask, rng), mask


def scratches(img, rng, count: int = 2):
    h, w = img.shape[:2]
    mask = np.zeros((h, w), bool)
    for _ in range(count):
        y, slope = rng.uniform(0, h), np.tan(np.radians(rng.uniform(-30, 30)))
        line = np.rint(y + slope * (np.arange(w) - w / 2)).astype(int)
        good = (line >= 0) & (line < h)
        mask[line[good], np.arange(w)[good]] = True
    return np.where(mask if img.ndim == 2 else mask[..., None], 255, img).astype(np.uint8), mask


def dropout(img, rng, size: int = 4, ratio: float = 0.2):
    h, w = img.shape[:2]
    gone = rng.random((-(-h // size), -(-w // size))) < ratio
    mask = np.kron(gone, np.ones((size, size), bool))[:h, :w].astype(bool)
    return np.where(mask if img.ndim == 2 else mask[..., None], 0, img).astype(np.uint8), mask


def mixed(img, rng, steps=(bars, noise, blur)):
    """Several kinds of damage in turn; the mask is that of any of them."""
    mask = np.zeros(img.shape[:2], bool)
    for step in steps:
        img, more = step(img, rng)
        mask |= more
    return img, mask


def imperfect(mask, rng, widen: int = 1, shrink: int = 0, noise_ratio: float = 0.01):
    """mask as a poor detector would give it: grown and shrunk in 5 x 5 steps, then single pixels set and cleared at random."""
    for n, change in ((widen, kernels.dilate), (shrink, kernels.erode)):
        for _ in range(n):
            mask = change(mask, 5)
    dice = rng.random(mask.shape)
    return (mask | (dice < noise_ratio)) & (dice <= 1 - noise_ratio)


KINDS = {"rectangle_mask": rectangle, "noise": noise, "local_noise": salt_pepper, "local_blur": blur, "jpeg_block_artifacts": blocks, "multiple_bars": bars, "scratch_lines": scratches, "block_dropout": dropout, "mixed": mixed, "combined": combined}
