"""Per-frame kernels in numpy for what is sequential by definition.

A frame is an (n, 3) int64 array of Q16 colours. Divisions truncate towards
zero; ties go to the lowest index. They run inside ``applyInPandas`` on one
frame (a few thousand pixels), never on a whole table.
"""

from __future__ import annotations

import math

import numpy as np


class Refused(ValueError):
    """A kernel's shape or feasibility check failed."""


def trunc(x, n):
    """Quotient towards zero of int64 arrays."""
    return np.sign(x) * (np.abs(x) // n)


def distances(px: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = px[:, None, :] - c[None, :, :]
    return (d * d).sum(2)


def assign(px: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(px, c).argmin(1)


def quantize(px: np.ndarray, k: int, lloyd: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first seeds from the integer mean, then Lloyd steps; an empty cluster keeps its centroid."""
    n = len(px)
    if n <= 0 or k <= 0 or k > 256 or k > n:
        raise Refused(f"{k} colours of {n} pixels")
    mean = trunc(px.sum(0), n)
    chosen = [int(((px - mean) ** 2).sum(1).argmax())]
    near = ((px - px[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((px - px[chosen[-1]]) ** 2).sum(1))
    c = px[chosen].copy()
    for _ in range(lloyd):
        slot = assign(px, c)
        count = np.bincount(slot, minlength=k)
        total = np.stack([np.bincount(slot, weights=px[:, j].astype(float), minlength=k) for j in range(3)], 1).astype(np.int64)
        full = count > 0
        c[full] = trunc(total[full], count[full][:, None])
    return c, assign(px, c)


def fill(px: np.ndarray, c: np.ndarray, slot: np.ndarray, least: int) -> np.ndarray:
    """Give every slot ``least`` pixels: the poorest takes the nearest pixel of a richer one, in slot order."""
    k = len(c)
    if len(px) < least * k:
        raise Refused(f"{len(px)} pixels for {k} slots of {least}")
    slot, count = slot.copy(), np.bincount(slot, minlength=k)
    for s in range(k):
        while count[s] < least:
            free = np.flatnonzero((slot != s) & (count[slot] > least))
            if not len(free):
                break
            best = free[((px[free] - c[s]) ** 2).sum(1).argmin()]
            count[slot[best]] -= 1
            slot[best] = s
            count[s] += 1
    return slot


#: Error diffusion taps (dx, dy, numerator, denominator).
FLOYD_STEINBERG = ((1, 0, 7, 16), (-1, 1, 3, 16), (0, 1, 5, 16), (1, 1, 1, 16))
ATKINSON = ((1, 0, 1, 8), (2, 0, 1, 8), (-1, 1, 1, 8), (0, 1, 1, 8), (1, 1, 1, 8), (0, 2, 1, 8))


def diffuse(px: np.ndarray, c: np.ndarray, side: int, taps=FLOYD_STEINBERG, serpentine: bool = True) -> np.ndarray:
    """Error diffusion in scan order over a square frame."""
    if side * side != len(px):
        raise Refused(f"{len(px)} pixels are no square of side {side}")
    return diffuse_rows(px, c, side, taps, serpentine)


def diffuse_rows(px: np.ndarray, c: np.ndarray, width: int, taps=FLOYD_STEINBERG, serpentine: bool = True) -> np.ndarray:
    """Error diffusion in scan order over as many rows as the pixels fill; the last may be short."""
    work, out = px.astype(np.int64).copy(), np.empty(len(px), np.int64)
    for y in range(-(-len(px) // width)):
        forth = not serpentine or y % 2 == 0
        for step in range(width):
            x = step if forth else width - 1 - step
            at = y * width + x
            if at >= len(px):
                continue
            slot = int(((c - work[at]) ** 2).sum(1).argmin())
            out[at] = slot
            error = work[at] - c[slot]
            for dx, dy, num, den in taps:
                nx, ny = x + (dx if forth else -dx), y + dy
                if 0 <= nx < width and ny * width + nx < len(px):
                    work[ny * width + nx] += trunc(error * num, den)
    return out


def threshold_dither(px: np.ndarray, c: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of the two nearest colours the second where the pixel's place between them passes the mask (0-255)."""
    d = distances(px, c)
    first = d.argmin(1)
    if len(c) == 1:
        return first
    d[np.arange(len(px)), first] = np.iinfo(np.int64).max
    second = d.argmin(1)
    axis = c[second] - c[first]
    length = (axis * axis).sum(1)
    along = ((px - c[first]) * axis).sum(1)
    share = np.where(length > 0, np.clip(trunc(along * 65536, np.maximum(length, 1)), 0, 65536), 0)
    return np.where(share > (2 * mask.astype(np.int64) + 1) * 128, second, first)


def blue_noise(side: int, seed: int = 11, sigma: float = 1.5) -> np.ndarray:
    """A (side, side) mask of thresholds 0 to 255 whose levels are spread evenly, by voids and clusters on a torus."""
    n = side * side
    d = np.minimum(np.arange(side), side - np.arange(side))
    bump = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma))
    glow = lambda at: np.roll(bump, (at // side, at % side), (0, 1)).ravel()
    rank, on, energy = np.empty(n, np.int64), np.zeros(n, bool), np.zeros(n)

    def flip(at: int) -> None:
        nonlocal energy
        energy = energy + (-glow(at) if on[at] else glow(at))
        on[at] = not on[at]

    tightest = lambda: int(np.where(on, energy, -np.inf).argmax())
    emptiest = lambda: int(np.where(on, np.inf, energy).argmin())
    for at in np.argsort(splitmix64(seed, n), kind="stable")[: max(1, n // 10)]:
        flip(int(at))
    while True:  # move the tightest point to the largest void until it stays
        a = tightest()
        flip(a)
        b = emptiest()
        flip(b)
        if a == b:
            break
    start, base, light = int(on.sum()), on.copy(), energy.copy()
    for k in range(start - 1, -1, -1):
        a = tightest()
        flip(a)
        rank[a] = k
    on, energy = base, light
    for k in range(start, n):
        b = emptiest()
        flip(b)
        rank[b] = k
    return (rank * 256 // n).reshape(side, side)


def median_cut(px: np.ndarray, levels: int) -> np.ndarray:
    """Leaf number of each colour in a perfect binary tree: widest axis, sorted by (value, index), halves."""
    leaf, order = np.zeros(len(px), np.int64), np.arange(len(px))
    groups = [order]
    for _ in range(levels):
        nxt = []
        for g in groups:
            axis = int((px[g].max(0) - px[g].min(0)).argmax()) if len(g) else 0
            s = g[np.lexsort((g, px[g, axis]))]
            nxt += [s[: len(s) // 2], s[len(s) // 2 :]]
        groups = nxt
    for i, g in enumerate(groups):
        leaf[g] = i
    return leaf


def sinkhorn_cost(x, y, p, q, epsilon: float, rounds: int) -> float:
    """Transport cost of the entropic plan."""
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    return float((sinkhorn_plan(x, y, p, q, epsilon, rounds) * cost).sum())


def sinkhorn_divergence(x, y, p, q, epsilon: float, rounds: int) -> float:
    """Debiased: c(a, b) - c(a, a) / 2 - c(b, b) / 2."""
    cost = lambda a, b, u, v: sinkhorn_cost(a, b, u, v, epsilon, rounds)
    return cost(x, y, p, q) - cost(x, x, p, p) / 2 - cost(y, y, q, q) / 2


def bures_squared(mean_a, cov_a, mean_b, cov_b) -> float:
    """Squared Bures distance of two Gaussians."""

    def root(m):
        w, v = np.linalg.eigh(m)
        return (v * np.sqrt(np.maximum(w, 0))) @ v.T

    r = root(cov_a)
    cross = np.trace(root(r @ cov_b @ r))
    d = np.asarray(mean_a) - np.asarray(mean_b)
    return float(max(0.0, np.trace(cov_a) + np.trace(cov_b) - 2 * cross) + d @ d)


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n outputs of the generator, by position: no state is carried."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def splitmix64_first(seeds: np.ndarray) -> np.ndarray:
    """The first output of the generator for each seed."""
    z = seeds + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def gene_bytes(payload, parents) -> bytes:
    """Length-prefixed little-endian words of a payload and of its parents."""
    word = lambda x: (int(x) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return b"".join([word(len(payload)), *map(word, payload), word(len(parents)), *map(word, parents)])


def gene_hash(payload, parents) -> int:
    h = fnv1a64(gene_bytes(payload, parents))
    return h - (1 << 64) if h >= 1 << 63 else h


def box_sums(cube: np.ndarray, box) -> np.ndarray:
    """Sums over a box (low and high of three axes) of a cumulative cube with a border of zeros in front."""
    (i0, i1), (j0, j1), (k0, k1) = box
    upper = cube[i1, j1, k1] - cube[i0, j1, k1] - cube[i1, j0, k1] - cube[i1, j1, k0]
    return upper + cube[i0, j0, k1] + cube[i0, j1, k0] + cube[i1, j0, k0] - cube[i0, j0, k0]


def spread_of(m: np.ndarray) -> float:
    """Squared spread around the mean from moments (n, sums of three axes, sum of squares)."""
    return float(m[4] - (m[1] ** 2 + m[2] ** 2 + m[3] ** 2) / m[0]) if m[0] else 0.0


def variance_boxes(moments: np.ndarray, k: int) -> list:
    """Boxes of a grid of moments (bins, bins, bins, 5), at most k: always the box of most spread is cut where most of it goes.

    Of equal boxes the first is cut, of equal cuts the first by axis and place;
    parts go to the end. A box of one cell is never cut.
    """
    cube = np.zeros(tuple(n + 1 for n in moments.shape[:3]) + (5,))
    cube[1:, 1:, 1:] = moments.cumsum(0).cumsum(1).cumsum(2)
    boxes = [tuple((0, n) for n in moments.shape[:3])]
    while len(boxes) < k:
        spreads = [spread_of(box_sums(cube, b)) for b in boxes]
        worst = int(np.argmax(spreads))
        best = None
        for axis, (low, high) in enumerate(boxes[worst]):
            for at in range(low + 1, high):
                parts = [boxes[worst][:axis] + (cut,) + boxes[worst][axis + 1 :] for cut in ((low, at), (at, high))]
                gain = spreads[worst] - sum(spread_of(box_sums(cube, p)) for p in parts)
                if best is None or gain > best[0]:
                    best = gain, parts
        if best is None:
            break
        boxes[worst : worst + 1] = []
        boxes += best[1]
    return boxes


def sinkhorn_plan(x, y, p, q, epsilon: float, rounds: int) -> np.ndarray:
    """The entropic transport plan after a fixed number of log-domain rounds."""
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    f, g, lp, lq = np.zeros(len(x)), np.zeros(len(y)), np.log(p), np.log(q)

    def soft(m, axis):
        top = m.max(axis, keepdims=True)
        return (top + np.log(np.exp(m - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        f = -epsilon * soft((g[None, :] - cost) / epsilon + lq[None, :], 1)
        g = -epsilon * soft((f[:, None] - cost) / epsilon + lp[:, None], 0)
    return np.exp((f[:, None] + g[None, :] - cost) / epsilon + lp[:, None] + lq[None, :])


def free_barycenter(measures, support: np.ndarray, epsilon: float, rounds: int, steps: int) -> np.ndarray:
    """Support points moved ``steps`` times to the mean of their images in every measure (points, weights) of positive mass."""
    live = [(np.asarray(x, float), np.asarray(w, float)) for x, w in measures if np.sum(w) > 0]
    z = np.asarray(support, float)
    for _ in range(steps if live else 0):
        images = []
        for x, w in live:
            plan = sinkhorn_plan(z, x, np.full(len(z), 1 / len(z)), w / w.sum(), epsilon, rounds)
            mass = plan.sum(1, keepdims=True)
            images.append(np.where(mass > 0, plan @ x / np.maximum(mass, 1e-300), z))
        z = np.mean(images, 0)
    return z


def share_out(budget: int, least: int, weights: np.ndarray) -> np.ndarray:
    """Whole parts of ``budget`` by weight, ``least`` each first; the largest remainders get what is left."""
    free = budget - least * len(weights)
    if free < 0:
        raise Refused(f"{budget} for {len(weights)} slots of {least}")
    exact = weights / weights.sum() * free
    part = np.floor(exact).astype(np.int64)
    part[np.argsort(-(exact - part), kind="stable")[: free - part.sum()]] += 1
    return part + least


def entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def populations(budget: int, least: int, k: int, target: float) -> np.ndarray:
    """Populations of k slots whose entropy in nats comes near ``target``: the skew of a power law is halved 64 times."""
    rank, low, high = np.arange(1, k + 1, dtype=float), 0.0, 50.0
    for _ in range(64):
        skew = (low + high) / 2
        low, high = (skew, high) if entropy_of(share_out(budget, least, rank**-skew)) > target else (low, skew)
    return share_out(budget, least, rank ** -((low + high) / 2))


def scene(seed: int, kind: str, frames: int, side: int) -> np.ndarray:
    """(frames, side * side, 3) Q16 colours of a moving scene: gradient, blob, edge, waves, or the mean of all (mixed)."""
    if kind == "mixed":
        return np.rint(np.mean([scene(seed * 7 + i + 1, k, frames, side) for i, k in enumerate(("gradient", "blob", "edge", "waves"))], 0)).astype(np.int64)
    u = (splitmix64(seed, 8) >> np.uint64(11)).astype(float) / (1 << 53)
    y, x = np.meshgrid(np.linspace(0, 1, side), np.linspace(0, 1, side), indexing="ij")
    out = []
    for t in np.linspace(0.0, 1.0, frames):
        turn = 2 * np.pi * (u[0] + t * u[1])
        if kind == "gradient":
            v = 0.5 + 0.5 * ((x - 0.5) * np.cos(turn) + (y - 0.5) * np.sin(turn))
        elif kind == "blob":
            v = np.exp(-((x - 0.5 - 0.3 * np.cos(turn)) ** 2 + (y - 0.5 - 0.3 * np.sin(turn)) ** 2) / (0.02 + 0.05 * u[2]))
        elif kind == "edge":
            v = ((x - 0.5) * np.cos(turn) + (y - 0.5) * np.sin(turn) > 0.2 * (u[3] - 0.5)).astype(float)
        elif kind == "waves":
            v = 0.5 + 0.5 * np.sin(2 * np.pi * (2 + np.floor(4 * u[4])) * (x * np.cos(turn) + y * np.sin(turn)) + turn)
        else:
            raise Refused(f"unknown scene {kind}")
        out.append(np.stack([v, 0.4 * (u[5] - 0.5) * (2 * v - 1), 0.4 * (u[6] - 0.5) * (2 * v - 1)], -1).reshape(-1, 3))
    return np.rint(np.array(out) * 65536).astype(np.int64)


def tile_slice(seed: int, tile: int, frames: int, side: int) -> np.ndarray:
    """(frames, side, side) values of one slice of an endless stream, from its own number alone."""
    return tile_slices(seed, np.array([tile]), frames, side)[0]


def tile_slices(seed: int, tiles: np.ndarray, frames: int, side: int) -> np.ndarray:
    """(tiles, frames, side, side) values of slices of an endless stream, each from its own number alone.

    A block's tile is chosen by the colours of its four edges, which its
    neighbours compute alike, so slices fit without being made in order. There
    are sixteen tiles.
    """
    blocks = 4
    size = side // blocks
    at = np.arange(blocks, dtype=np.int64)
    words = np.broadcast_arrays(np.asarray(tiles, np.int64)[:, None, None, None], at[:, None, None], at[:, None], np.arange(2))
    hashed = fnv1a64_words(words) & np.uint64(0xFFFFFFFF)
    edge = (splitmix64_first(np.uint64(seed) ^ hashed) & np.uint64(1)).astype(np.int64)
    top, left = edge[..., 0], edge[..., 1]
    n = top + 2 * left + 4 * np.roll(top, -1, 1) + 8 * np.roll(left, -1, 2)
    grain = np.stack([(splitmix64(seed + k, frames * size * size) >> np.uint64(56)).astype(np.int64).reshape(frames, size, size) + k * 256 for k in range(16)])
    out = np.zeros((len(n), frames, side, side), np.int64)
    for by in range(blocks):
        for bx in range(blocks):
            out[:, :, by * size : (by + 1) * size, bx * size : (bx + 1) * size] = grain[n[:, by, bx]]
    return out


def fnv1a64_words(words) -> np.ndarray:
    """:func:`hash_words` of arrays, element by element."""
    h = np.uint64(0xCBF29CE484222325)
    for w in words:
        w = w.astype(np.int64).view(np.uint64)
        for shift in range(0, 64, 8):
            h = (h ^ (w >> np.uint64(shift) & np.uint64(0xFF))) * np.uint64(0x100000001B3)
    return h


def hash_words(words) -> int:
    return fnv1a64(b"".join(int(w).to_bytes(8, "little", signed=True) for w in words))


def scaled_plan(x, y, p, q, epsilon: float, rounds: int) -> np.ndarray:
    """The entropic plan by scaling the kernel's columns, then its rows, a fixed number of times; what the kernel does not reach stays 0."""
    kernel = np.exp(-((x[:, None, :] - y[None, :, :]) ** 2).sum(2) / epsilon)
    u, v = np.ones(len(x)), np.ones(len(y))
    share = lambda want, have: np.divide(want, have, out=np.zeros(len(want)), where=have != 0)
    for _ in range(rounds):
        v = share(q, u @ kernel)
        u = share(p, kernel @ v)
    return u[:, None] * kernel * v[None, :]


def cyclic_descriptor(frames, epsilon: float = 0.05, rounds: int = 30) -> list[float]:
    """Sixteen numbers of a loop of palettes (points, weights) that no rotation of the loop and no order of slots changes.

    Mean and deviation of the entropies of weights and of the Gaussians of the
    colours; sum and mean of the costs of transport to the next palette, mean
    entropy of the plans; spectral entropies of the three series; entropy rate
    of the first; the share by which the product of row-stochastic plans round
    the loop misses the identity; and four shares of power of the first series.
    """
    plain, colour, costs, plans, around = [], [], [], [], None
    for t, (x, w) in enumerate(frames):
        x, p = np.asarray(x, float), np.asarray(w, float) / np.sum(w)
        plain.append(-float((p[p > 0] * np.log(p[p > 0])).sum()))
        mean = p @ x
        det = np.linalg.det(((x - mean) * p[:, None]).T @ (x - mean))
        colour.append(0.5 * math.log((2 * math.pi * math.e) ** 3 * max(det, 1e-12)))
        y, v = frames[(t + 1) % len(frames)]
        y, q = np.asarray(y, float), np.asarray(v, float) / np.sum(v)
        plan = scaled_plan(x, y, p, q, epsilon, rounds)
        costs.append(float((plan * ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)).sum()))
        plans.append(-float((plan[plan > 0] * np.log(plan[plan > 0])).sum()))
        step = plan / np.maximum(plan.sum(1, keepdims=True), 1e-300)
        around = step if around is None else around @ step
    spectrum = lambda s: np.abs(np.fft.fft(s))[1:] ** 2

    def entropy(s):
        a = spectrum(s)
        return 0.0 if a.sum() <= 1e-12 else -float(sum(v * math.log(v) for v in a / a.sum() if v > 0))

    a = spectrum(plain)
    rate = 0.0 if a.sum() <= 1e-12 else 0.5 * math.log(2 * math.pi * math.e) + float(np.log(np.maximum(a, 1e-12)).sum()) / (2 * len(a))
    shares = a / a.sum() if a.sum() > 1e-12 else np.zeros(len(a))
    four = [float(shares[i]) if i < len(shares) else 0.0 for i in range(4)]
    return [np.mean(plain), np.std(plain), np.mean(colour), np.std(colour), sum(costs), np.mean(costs), np.mean(plans), entropy(plain), entropy(colour), entropy(costs), rate, 1 - np.trace(around) / len(around), *four]


def detail_head(coarse: np.ndarray, bands: np.ndarray, steps: int = 200, rate: float = 0.05, init: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Weights (7, 3) of [1, c, c * c] that predict seven bands by full-batch descent; and the loss, and that of predicting 0."""
    x = np.stack([np.ones_like(coarse), coarse, coarse * coarse], 1)
    theta = np.zeros((bands.shape[1], 3)) if init is None else init.copy()
    for _ in range(steps):
        theta -= rate * 2 * (x @ theta.T - bands).T @ x / len(x)
    return theta, float(((x @ theta.T - bands) ** 2).mean()), float((bands**2).mean())


def clustered_average(pairs: np.ndarray, k: int, rounds: int = 8, steps: int = 4, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Models of k clusters of users and each user's cluster, from (users, pairs, width) signed differences.

    Users start in the groups of their own models' directions (farthest first,
    spherical k-means); then each joins the model of least loss, and every
    model averages its users' steps.
    """

    def descend(d, theta, times):
        for _ in range(times):
            z = np.einsum("umw,uw->um", d, theta)
            theta = theta + rate * np.einsum("um,umw->uw", 1 / (1 + np.exp(z)), d) / d.shape[1]
        return theta

    own = descend(pairs, np.zeros((len(pairs), pairs.shape[2])), 50)
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    seeds = [0]
    while len(seeds) < min(k, len(unit)):
        seeds.append(int((unit @ unit[seeds].T).max(1).argmin()))
    centre = unit[seeds]
    for _ in range(10):
        group = (unit @ centre.T).argmax(1)
        for c in np.unique(group):
            v = unit[group == c].sum(0)
            centre[c] = v / max(np.linalg.norm(v), 1e-12)
    models = np.zeros((len(seeds), pairs.shape[2]))
    for r in range(rounds + 1):
        if r:
            group = np.stack([np.logaddexp(0, -pairs @ m).mean(1) for m in models], 1).argmin(1)
        for c in np.unique(group):
            users = pairs[group == c]
            for _ in range(2):
                models[c] = descend(users, np.broadcast_to(models[c], (len(users), models.shape[1])), steps).mean(0)
    return models, group


def user_pairs(seed: int, users: int, clusters: int, pairs: int, width: int, spread: float = 0.25, flips: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Signed differences (users, pairs, width) of users round ``clusters`` centres, a share of labels flipped; and the clusters."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = np.arange(users) % clusters
    taste = unit(unit(rng.standard_normal((clusters, width)))[group] + spread * unit(rng.standard_normal((users, width))))
    d = rng.standard_normal((users, pairs, width))
    sign = np.where(np.einsum("umw,uw->um", d, taste) > 0, 1.0, -1.0) * np.where(rng.random((users, pairs)) < flips, -1, 1)
    return d * sign[..., None], group


def psd_metric(anchor: np.ndarray, positive: np.ndarray, negative: np.ndarray, margin: float = 0.1, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """A lower triangle L whose metric L L' brings anchors nearer to positives than to negatives by a margin; and the mean hinge left."""
    low, near, far = np.eye(anchor.shape[1]), anchor - positive, anchor - negative

    def hinge():
        return np.maximum(0.0, ((near @ low) ** 2).sum(1) - ((far @ low) ** 2).sum(1) + margin)

    for _ in range(steps):
        live = hinge() > 0
        slope = 2 * (near[live].T @ near[live] - far[live].T @ far[live]) @ low / len(anchor)
        low = low - rate * np.tril(slope)
    return low, float(hinge().mean())
