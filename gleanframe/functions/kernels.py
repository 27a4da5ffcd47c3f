"""Pixel measures of one decoded image, in NumPy."""

from __future__ import annotations

import math

import numpy as np

# The luma weights of 8-bit grey conversion, in 65536ths.
LUMA = (19595, 38470, 7471)
HASH_SIDE, DCT_SIDE = 8, 32


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.uint32) for k in range(3))
    return ((LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 32768) >> 16).astype(np.uint8)


def sharpness(luma: np.ndarray) -> float:
    """Variance of the edge image: eight times each pixel less its neighbours, clipped; borders as they are."""
    x = luma.astype(np.int32)
    out = x.copy()
    if min(x.shape) > 2:
        around = sum(x[1 + a : x.shape[0] - 1 + a, 1 + b : x.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
        out[1:-1, 1:-1] = np.clip(8 * x[1:-1, 1:-1] - around, 0, 255)
    return float(out.astype(np.float32).var())


def artifact_score(luma: np.ndarray) -> float:
    """1 for a clean image, less the more steps stand out at the borders of 8-pixel blocks."""
    x = luma.astype(np.float32)
    rows, cols = np.abs(np.diff(x, axis=0)), np.abs(np.diff(x, axis=1))
    # a side too short for borders counts as one without steps
    edges = [float(rows[7::8].mean()) if x.shape[0] > 16 else 0.0, float(cols[:, 7::8].mean()) if x.shape[1] > 16 else 0.0]
    inner = [float(d.mean()) for d in (rows, cols) if d.size]
    inside = sum(inner) / 2
    if inside < 1e-6:
        return 1.0
    ratio = sum(edges) / 2 / (inside + 1e-6)
    return min(1.0, max(0.0, 1.0 - (ratio - 1.0) / 0.6))


def _lanczos(n: int, m: int) -> np.ndarray:
    """Weights that resample n samples to m, three lobes wide, antialiased when shrinking."""
    scale = n / m
    reach = 3.0 * max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    at = (np.arange(n) + 0.5)[None, :] - centre[:, None]
    t = at / max(scale, 1.0)
    w = np.where(np.abs(at) < reach, np.sinc(t) * np.sinc(t / 3.0), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def perceptual_hash(luma: np.ndarray) -> int:
    """64 bits: which of the 8 by 8 lowest cosine coefficients of a 32 by 32 thumbnail exceed their median."""
    h, w = luma.shape
    across = np.clip(np.rint(luma.astype(np.float64) @ _lanczos(w, DCT_SIDE).T), 0, 255)
    small = np.clip(np.rint(_lanczos(h, DCT_SIDE) @ across), 0, 255)
    k = np.arange(DCT_SIDE)
    dct = 2 * np.cos(math.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * DCT_SIDE))
    low = (dct @ small @ dct.T)[:HASH_SIDE, :HASH_SIDE]
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)
