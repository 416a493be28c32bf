"""Degradations of page pictures, with the map of every point that a step moves, and presets of steps.

A step takes grey pixels as floats, random draws and its settings, and returns the pixels, a map of points or None, and
what was drawn. A setting is a number or a range (low, high) that is drawn from. Steps that move ink move the boxes of
a page with it: lines and words get the four corners they came to, and the box around them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Points = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Result = tuple[np.ndarray, Points | None, dict]
DESK = 116.0
BAND = 1 << 13  # pixels that are worked on at once


def draw(rng: np.random.Generator, setting) -> float:
    """A number as it is, or one of a range."""
    return float(rng.uniform(min(setting), max(setting))) if isinstance(setting, (tuple, list)) else float(setting)


def _weights(size: int, to: int) -> np.ndarray:
    """Triangle weights that take ``size`` samples to ``to``; a wider triangle where the picture shrinks."""
    step = size / to
    reach = max(1.0, step)
    w = np.maximum(0.0, 1 - np.abs((np.arange(size)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * step) / reach))
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    return _weights(g.shape[0], height) @ g.astype(np.float32) @ _weights(g.shape[1], width).T


def square(g: np.ndarray, size: int, best: Callable) -> np.ndarray:
    """Largest or smallest value of the square around each pixel, by doubling the reach along each side."""
    half = size // 2
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (half, half)
        x, have = np.pad(g, pads, mode="edge"), 1
        cut = lambda a, lo, n: a[lo : lo + n] if axis == 0 else a[:, lo : lo + n]  # noqa: B023, E731
        while have < size:
            step = min(have, size - have)
            n = x.shape[axis] - step
            x, have = best(cut(x, 0, n), cut(x, step, n)), have + step
        g = x
    return g


def blurred(g: np.ndarray, radius: float) -> np.ndarray:
    half = max(1, int(np.ceil(2.5 * radius)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / max(radius, 1e-3)) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (half, half)
        x, n = np.pad(g, pads, mode="edge"), g.shape[axis]
        g = sum(k * (x[i : i + n] if axis == 0 else x[:, i : i + n]) for i, k in enumerate(kernel.astype(np.float32)))
    return g


def soft_noise(shape: tuple[int, int], cell: int, rng: np.random.Generator) -> np.ndarray:
    """Noise between -1 and 1 that changes over ``cell`` pixels."""
    grid = np.clip(rng.normal(size=(max(2, shape[0] // cell), max(2, shape[1] // cell))), -3, 3) / 3
    return resize(grid, *shape)


def _spot(shape: tuple[int, int], x: float, y: float, spread: float) -> np.ndarray:
    v = np.exp(-((np.arange(shape[0]) - y) ** 2) / (2 * spread * spread))
    u = np.exp(-((np.arange(shape[1]) - x) ** 2) / (2 * spread * spread))
    return v[:, None] * u[None, :]


# light and ink


def gaussian_noise(g, rng, sigma=(4, 18)) -> Result:
    s = draw(rng, sigma)
    return g + rng.normal(0, s, g.shape), None, {"sigma": s}


def paper_grain(g, rng, strength=(6, 20)) -> Result:
    s = draw(rng, strength)
    return g + resize(rng.normal(0, s, (max(1, g.shape[0] // 4), max(1, g.shape[1] // 4))), *g.shape), None, {"strength": s}


def blur(g, rng, radius=(0.3, 1.6)) -> Result:
    r = draw(rng, radius)
    return blurred(g, r), None, {"radius": r}


def motion_blur(g, rng, length=(3, 9), angle=(0, 180)) -> Result:
    """A smear along a line; beyond the edges the page goes on as it ends."""
    n, a = max(2, round(draw(rng, length))), draw(rng, angle)
    reach = n // 2
    x = np.pad(g, reach, mode="edge")
    moves = [(reach + round(k * np.sin(np.deg2rad(a))), reach + round(k * np.cos(np.deg2rad(a)))) for k in range(-reach, reach + 1)]
    return sum(x[i : i + g.shape[0], j : j + g.shape[1]] for i, j in moves) / len(moves), None, {"length": n, "angle": a}


def brightness(g, rng, factor=(0.7, 1.25)) -> Result:
    f = draw(rng, factor)
    return g * f, None, {"factor": f}


def contrast(g, rng, factor=(0.6, 1.3)) -> Result:
    f, middle = draw(rng, factor), float(np.rint(g.mean()))
    return middle + (g - middle) * f, None, {"factor": f}


_QUANTA = np.array(
    [[16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
     [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]]
)
_WAVES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos(np.pi * (2 * n + 1) * k / 16) for n in range(8)] for k in range(8)], np.float32)


def jpeg(g, rng, quality=(25, 80)) -> Result:
    """What lossy compression leaves: waves of 8 x 8 blocks rounded to the quanta of a quality."""
    q = int(np.clip(round(draw(rng, quality)), 1, 95))
    quanta = np.clip((_QUANTA * (5000 / q if q < 50 else 200 - 2 * q) + 50) // 100, 1, 255).astype(np.float32)
    h, w = g.shape
    x = np.pad(np.clip(g, 0, 255).astype(np.float32), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    kept = np.rint(_WAVES @ blocks @ _WAVES.T / quanta) * quanta
    out = (_WAVES.T @ kept @ _WAVES).transpose(0, 2, 1, 3).reshape(x.shape) + 128
    return out[:h, :w], None, {"quality": q}


def downscale(g, rng, scale=(0.4, 0.9)) -> Result:
    s = float(np.clip(draw(rng, scale), 0.05, 1))
    small = resize(g, max(1, int(g.shape[0] * s)), max(1, int(g.shape[1] * s)))
    return resize(small, *g.shape), None, {"scale": s}


def ink_spread(g, rng, size=3) -> Result:
    n = int(size) | 1
    return square(g, n, np.minimum), None, {"size": n}


def ink_erosion(g, rng, size=3) -> Result:
    n = int(size) | 1
    return square(g, n, np.maximum), None, {"size": n}


def bleedthrough(g, rng, strength=(0.05, 0.22)) -> Result:
    s = draw(rng, strength)
    return g * (1 - s) + s * blurred(g[:, ::-1], 1.2), None, {"strength": s}


def shadow(g, rng, strength=(0.1, 0.45)) -> Result:
    s, a = draw(rng, strength), float(rng.uniform(0, 2 * np.pi))
    slope = np.linspace(0, np.sin(a), g.shape[0])[:, None] + np.linspace(0, np.cos(a), g.shape[1])[None, :]
    slope -= slope.min()
    return g * (1 - s * slope / max(1e-6, slope.max())), None, {"strength": s, "angle": a}


def vignette(g, rng, strength=(0.15, 0.5)) -> Result:
    s = draw(rng, strength)
    far = [((np.arange(n) - n / 2) / (n / 2)) ** 2 for n in g.shape]
    return g * (1 - s * (far[0][:, None] + far[1][None, :]) / 2), None, {"strength": s}


def glare(g, rng, strength=(0.15, 0.5)) -> Result:
    s, h, w = draw(rng, strength), *g.shape
    x, y = rng.uniform(0.15, 0.85) * w, rng.uniform(0.15, 0.85) * h
    return g + 255 * s * _spot(g.shape, x, y, rng.uniform(0.15, 0.4) * max(h, w)), None, {"strength": s, "x": float(x), "y": float(y)}


def stains(g, rng, count=(1, 4), strength=(0.05, 0.25)) -> Result:
    n, s, (h, w) = round(draw(rng, count)), draw(rng, strength), g.shape
    cover = sum((_spot(g.shape, rng.uniform(0, w), rng.uniform(0, h), rng.uniform(0.03, 0.14) * max(h, w)) for _ in range(n)), np.zeros(g.shape))
    cover = s * np.clip(cover, 0, 1)
    tint = 0.299 * rng.uniform(120, 190) + 0.587 * rng.uniform(90, 150) + 0.114 * rng.uniform(50, 110)
    return g + (tint - g) * cover, None, {"count": n, "strength": s}


def folds(g, rng, count=(1, 3), strength=(0.08, 0.3)) -> Result:
    n, s = round(draw(rng, count)), draw(rng, strength)
    crease = [np.zeros(g.shape[0]), np.zeros(g.shape[1])]
    for _ in range(n):
        side = int(rng.random() >= 0.5)
        long = g.shape[side]
        crease[side] += np.exp(-(((np.arange(long) - rng.uniform(0, long)) / (rng.uniform(0.004, 0.02) * long)) ** 2) / 2)
    return g * (1 - s * np.clip(crease[0][:, None] + crease[1][None, :], 0, 1)), None, {"count": n, "strength": s}


def illumination(g, rng, strength=(0.12, 0.4), scale=6) -> Result:
    s = draw(rng, strength)
    return g * (1 + s * soft_noise(g.shape, max(2, min(g.shape) // int(scale)), rng)), None, {"strength": s, "scale": int(scale)}


# what moves ink


def sampled(g: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float) -> np.ndarray:
    """Pixels at places between pixels, ``fill`` outside."""
    h, w = g.shape
    out = np.full(np.broadcast_shapes(x.shape, y.shape), fill, np.float64)
    inside = np.flatnonzero((x > -0.5) & (x < w - 0.5) & (y > -0.5) & (y < h - 0.5))  # the others are not read
    x, y = (np.minimum(np.maximum(np.broadcast_to(v, out.shape).ravel()[inside], 0), n - 1) for v, n in ((x, w), (y, h)))
    i, j = np.minimum(y.astype(np.intp), max(h - 2, 0)), np.minimum(x.astype(np.intp), max(w - 2, 0))
    v, u = y - i, x - j
    flat, at, below, right = g.ravel(), i * w + j, w if h > 1 else 0, 1 if w > 1 else 0
    read = lambda k: flat.take(k, mode="clip")
    rest = 1 - u
    top = read(at) * rest + read(at + right) * u
    at += below
    bottom = read(at) * rest + read(at + right) * u
    out.ravel()[inside] = top * (1 - v) + bottom * v
    return out


def apply_homography(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    d = np.where(np.abs(d) < 1e-9, 1e-9, d)
    return (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d


def _through(g: np.ndarray, m: np.ndarray, width: int, height: int, fill: float) -> np.ndarray:
    back, out = np.linalg.inv(m), np.empty((height, width))
    step = max(1, BAND // width)
    for top in range(0, height, step):  # in bands of rows, whose arrays stay in the cache
        x, y = apply_homography(back, np.arange(width)[None, :] + 0.5, np.arange(top, min(top + step, height))[:, None] + 0.5)
        out[top : top + step] = sampled(g, x - 0.5, y - 0.5, fill)
    return out


def rotation_map(width: float, height: float, degrees: float) -> tuple[np.ndarray, int, int]:
    """The homography of a rotation about the centre onto a canvas that holds it, and the canvas's size."""
    a = np.deg2rad(degrees)
    w, h = abs(width * np.cos(a)) + abs(height * np.sin(a)), abs(width * np.sin(a)) + abs(height * np.cos(a))
    wide, high = int(np.ceil(w)), int(np.ceil(h))
    turn = np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
    to, back = np.array([[1, 0, -width / 2], [0, 1, -height / 2], [0, 0, 1]]), np.array([[1, 0, wide / 2], [0, 1, high / 2], [0, 0, 1]])
    return back @ turn @ to, wide, high


def perspective_map(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The homography that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def rotation(g, rng, max_angle=4.0, fill=255.0) -> Result:
    a = float(rng.uniform(-max_angle, max_angle))
    m, w, h = rotation_map(g.shape[1], g.shape[0], a)
    return _through(g, m, w, h, fill), lambda x, y: apply_homography(m, x, y), {"angle": a}


def perspective(g, rng, magnitude=(0.01, 0.06), fill=255.0) -> Result:
    s, (h, w) = draw(rng, magnitude), g.shape
    corners = np.array([(0, 0), (w, 0), (w, h), (0, h)], float)
    moved = corners + rng.uniform(-1, 1, (4, 2)) * s * np.array([w, h])
    moved -= moved.min(0)
    m = perspective_map([tuple(c) for c in corners], [tuple(c) for c in moved])
    wide, high = (max(1, int(np.ceil(v))) for v in moved.max(0))
    return _through(g, m, wide, high, fill), lambda x, y: apply_homography(m, x, y), {"magnitude": s, "corners": np.round(moved, 2).tolist()}


def _displaced(g: np.ndarray, dx: np.ndarray, dy: np.ndarray, shade: np.ndarray, fill: float) -> tuple[np.ndarray, Points]:
    """Each pixel is read at its place and the displacement, to the nearest pixel, so that strokes stay sharp."""
    h, w = g.shape
    x, y = np.arange(w)[None, :] + dx, np.arange(h)[:, None] + dy
    dx, dy = np.broadcast_to(dx, g.shape), np.broadcast_to(dy, g.shape)
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    nearest = lambda v, n: np.minimum(np.maximum(np.rint(v), 0), n - 1).astype(np.intp)
    read = g.ravel().take(nearest(y, h) * w + nearest(x, w), mode="clip")

    def moved(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = px, py
        for _ in range(6):  # the place that is read from here, found step by step, as the field is smooth
            i, j = nearest(y, h), nearest(x, w)
            x, y = px - dx[i, j], py - dy[i, j]
        return x, y

    return np.where(inside, read, fill) * shade, moved


def wrinkles(g, rng, strength=(2, 7), scale=28, shading=(0.05, 0.22), fill=255.0) -> Result:
    s, dark = draw(rng, strength), draw(rng, shading)
    dx, dy = (s * soft_noise(g.shape, int(scale), rng) for _ in range(2))
    bend = np.abs(np.diff(dx, axis=1, append=dx[:, -1:])) + np.abs(np.diff(dy, axis=0, append=dy[-1:]))
    out, moved = _displaced(g, dx, dy, 1 - dark * bend / max(1e-6, float(bend.max())), fill)
    return out, moved, {"strength": s, "shading": dark, "scale": int(scale)}


def page_curl(g, rng, strength=(0.03, 0.12), edge="random", fill=255.0) -> Result:
    s = draw(rng, strength)
    edge = ("left", "right", "top", "bottom")[int(rng.integers(4))] if edge == "random" else edge
    along = 1 if edge in ("left", "right") else 0
    n = g.shape[along]
    near = 1 - np.arange(n) / max(1, n - 1)
    profile = (near if edge in ("left", "top") else near[::-1]) ** 2.5
    push = profile * s * n * (1 if edge in ("left", "top") else -1)
    side = (lambda v: v[None, :]) if along else (lambda v: v[:, None])
    zero = np.zeros((1, 1))
    out, moved = _displaced(g, side(push) if along else zero, zero if along else side(push), side(1 - 3.75 * s * profile), fill)
    return out, moved, {"strength": s, "edge": edge}


STEPS: dict[str, Callable[..., Result]] = {
    f.__name__: f
    for f in (
        gaussian_noise, paper_grain, blur, motion_blur, brightness, contrast, jpeg, downscale, ink_spread, ink_erosion, bleedthrough, shadow,
        vignette, glare, stains, folds, illumination, rotation, perspective, wrinkles, page_curl,
    )
}


@dataclass(frozen=True)
class Step:
    name: str
    probability: float = 1.0
    settings: dict = field(default_factory=dict)


def step(name: str, probability: float = 1.0, **settings) -> Step:
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}; one of {', '.join(sorted(STEPS))}")
    return Step(name, probability, settings)


PRESETS: dict[str, tuple[Step, ...]] = {
    "clean": (),
    "scan": (
        step("rotation", 0.7, max_angle=1.5), step("paper_grain", 0.8, strength=(4, 12)), step("bleedthrough", 0.25, strength=(0.03, 0.12)), step("ink_spread", 0.2),
        step("blur", 0.5, radius=(0.2, 0.7)), step("gaussian_noise", 0.6, sigma=(2, 8)), step("brightness", 0.5, factor=(0.92, 1.08)), step("jpeg", 0.6, quality=(60, 92)),
    ),
    "photo": (
        step("perspective", 0.85, fill=DESK), step("rotation", 0.6, max_angle=4.0, fill=DESK), step("page_curl", 0.35, strength=(0.02, 0.09)), step("wrinkles", 0.4, strength=(1.5, 5)),
        step("illumination", 0.7), step("shadow", 0.7), step("glare", 0.35, strength=(0.1, 0.4)), step("vignette", 0.5, strength=(0.1, 0.4)), step("motion_blur", 0.3),
        step("blur", 0.5, radius=(0.3, 1.4)), step("downscale", 0.5, scale=(0.45, 0.9)), step("gaussian_noise", 0.7, sigma=(4, 16)), step("jpeg", 0.9, quality=(25, 70)),
    ),
    "fax": (
        step("rotation", 0.5, max_angle=2.0), step("downscale", 0.9, scale=(0.3, 0.55)), step("contrast", 0.9, factor=(1.4, 2.2)), step("ink_erosion", 0.5),
        step("gaussian_noise", 0.7, sigma=(6, 20)), step("jpeg", 0.7, quality=(20, 55)),
    ),
    "archive": (
        step("rotation", 0.6, max_angle=2.5), step("paper_grain", 0.9, strength=(8, 22)), step("stains", 0.8), step("folds", 0.6), step("wrinkles", 0.7, shading=(0.08, 0.25)),
        step("bleedthrough", 0.6, strength=(0.08, 0.22)), step("ink_erosion", 0.4), step("contrast", 0.7, factor=(0.6, 0.95)), step("brightness", 0.6, factor=(0.8, 1.05)),
        step("gaussian_noise", 0.6, sigma=(3, 12)), step("jpeg", 0.5, quality=(45, 85)),
    ),
}


def run_steps(g: np.ndarray, steps: tuple[Step, ...], generator: Callable[[int], np.random.Generator]) -> tuple[np.ndarray, list[Points], list[tuple[str, dict]]]:
    """The pixels after the steps that are drawn, the maps of those that moved ink, and what each drew."""
    maps, done = [], []
    for number, s in enumerate(steps):
        rng = generator(number)
        if rng.random() > s.probability:
            continue
        g, moved, drawn = STEPS[s.name](g.astype(np.float32), rng, **s.settings)
        g = np.clip(g, 0, 255).astype(np.uint8)
        done.append((s.name, drawn))
        if moved is not None:
            maps.append(moved)
    return g, maps, done


def map_boxes(boxes: list[dict], maps: list[Points]) -> list[dict]:
    """The boxes around what some maps make of boxes, all of them mapped at once."""
    if not boxes or not maps:
        return boxes
    a = np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in boxes], float)
    x, y = a[:, [0, 2, 2, 0]], a[:, [1, 1, 3, 3]]
    for m in maps:
        x, y = m(x, y)
    return [{"x0": v[0], "y0": v[1], "x1": v[2], "y1": v[3]} for v in np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1).tolist()]


def map_page(page: dict, maps: list[Points], width: int, height: int) -> dict:
    """A page whose boxes went through some maps, on a canvas of another size; baselines go, as they are no lines any more."""

    def corners(b: dict) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.array([b["x0"], b["x1"], b["x1"], b["x0"]], float), np.array([b["y0"], b["y0"], b["y1"], b["y1"]], float)
        for m in maps:
            x, y = m(x, y)
        return x, y

    def placed(item: dict, quad: bool) -> dict:
        if item.get("bbox") is None:
            return item
        x, y = corners(item["bbox"])
        box = {"x0": float(x.min()), "y0": float(y.min()), "x1": float(x.max()), "y1": float(y.max())}
        return item | {"bbox": box} | ({"polygon": np.stack([x, y], 1).ravel().tolist()} if quad else {})

    def line(item: dict) -> dict:
        return placed(item, True) | {"baseline": None, "words": [placed(w, True) for w in item["words"] or []]}

    def region(item: dict) -> dict:
        table = item["table"]
        table = table and table | {"cells": [placed(c, False) for c in table["cells"] or []]}
        return placed(item, False) | {"lines": [line(x) for x in item["lines"] or []], "table": table}

    return page | {"width": width, "height": height, "regions": [region(r) for r in page["regions"] or []]}
