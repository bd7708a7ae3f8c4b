"""Numpy helpers for dense images, used inside Arrow tasks."""

from __future__ import annotations

import numpy as np


def image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width)


def unpack_10_to_8(packed: np.ndarray) -> np.ndarray:
    """(.., 5n) packed bytes to (.., 4n) eight-bit pixels."""
    b = packed.reshape(*packed.shape[:-1], -1, 5)
    out = np.empty((*b.shape[:-1], 4), np.uint8)
    out[..., 0] = b[..., 0]
    out[..., 1] = (b[..., 1] & 63) << 2 | b[..., 2] >> 6
    out[..., 2] = (b[..., 2] & 15) << 4 | b[..., 3] >> 4
    out[..., 3] = (b[..., 3] & 3) << 6 | b[..., 4] >> 2
    return out.reshape(*packed.shape[:-1], -1)


def nearest(image: np.ndarray, scale, offset, out_width: int, out_height: int) -> np.ndarray:
    height, width = image.shape
    x = (np.arange(out_width) - offset[0]) / scale[0]
    y = (np.arange(out_height) - offset[1]) / scale[1]
    in_x, in_y = (x >= 0) & (x < width), (y >= 0) & (y < height)
    out = np.zeros((out_height, out_width), image.dtype)
    out[np.ix_(in_y, in_x)] = image[np.ix_(y[in_y].astype(int), x[in_x].astype(int))]
    return out


def bilinear(image: np.ndarray, out_width: int, out_height: int) -> np.ndarray:
    """Resize with pixel centres aligned and edges repeated."""

    def axis(n_out: int, n_in: int):
        at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = axis(out_height, image.shape[0])
    x0, x1, fx = axis(out_width, image.shape[1])
    source = image.astype(np.float64)
    if source.ndim == 3:
        fx, fy = fx[:, None], fy[:, None, None]
    else:
        fy = fy[:, None]
    top = source[y0][:, x0] * (1 - fx) + source[y0][:, x1] * fx
    bottom = source[y1][:, x0] * (1 - fx) + source[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + bottom * fy + 0.5).astype(np.uint8)


def scaled(source: np.ndarray, out_width: int, out_height: int) -> np.ndarray:
    """Block mean for whole factors, bilinear otherwise."""
    height, width = source.shape
    if height % out_height or width % out_width:
        return bilinear(source, out_width, out_height)
    by, bx = height // out_height, width // out_width
    sums = source.reshape(out_height, by, width).sum(axis=1, dtype=np.uint32)
    sums = sums.reshape(out_height, out_width, bx).sum(axis=2)
    return ((sums + by * bx // 2) // (by * bx)).astype(np.uint8)


def iou_matrix(x_min, y_min, x_max, y_max) -> np.ndarray:
    """IoU of every two boxes of one bounded group."""
    x_min, y_min, x_max, y_max = (np.asarray(edge, np.float64) for edge in (x_min, y_min, x_max, y_max))
    width = np.maximum(0.0, np.minimum(x_max[:, None], x_max) - np.maximum(x_min[:, None], x_min))
    height = np.maximum(0.0, np.minimum(y_max[:, None], y_max) - np.maximum(y_min[:, None], y_min))
    shared = width * height
    area = (x_max - x_min) * (y_max - y_min)
    union = area[:, None] + area - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def greedy_keep(edges, classes, threshold: float) -> list[int]:
    """Positions kept by greedy suppression of a best-first group, within classes."""
    classes = np.asarray(classes)
    rivals = (iou_matrix(*edges) > threshold) & (classes[:, None] == classes)
    alive = np.ones(len(classes), bool)
    kept = []
    for place in range(len(classes)):
        if alive[place]:
            kept.append(place)
            alive &= ~rivals[place]
    return kept
