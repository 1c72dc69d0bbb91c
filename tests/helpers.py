"""Slow and obvious versions of raster rules."""

import numpy as np

AROUND = [(-1, 0), (1, 0), (0, -1), (0, 1)], [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def labels(on, connectivity=8):
    """Flood fill; a label is first_y * 2**24 + first_x."""
    out = np.full(on.shape, -1, np.int64)
    steps = AROUND[connectivity == 8]
    for y in range(on.shape[0]):
        for x in range(on.shape[1]):
            if on[y, x] and out[y, x] < 0:
                stack, name = [(y, x)], y * (1 << 24) + x
                out[y, x] = name
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < on.shape[0] and 0 <= d < on.shape[1] and on[c, d] and out[c, d] < 0:
                            out[c, d] = name
                            stack.append((c, d))
    return out


def holes(on):
    lab = labels(~on, 4)
    edge = set(lab[0]) | set(lab[-1]) | set(lab[:, 0]) | set(lab[:, -1])
    return (lab >= 0) & ~np.isin(lab, list(edge))


def distance2(on):
    off = np.argwhere(~on)
    out = np.zeros(on.shape, np.int64)
    for y, x in np.argwhere(on):
        out[y, x] = ((off - (y, x)) ** 2).sum(1).min()
    return out


def walk_outline(on):
    """Border following around the first pixel's component: the list of visited pixels."""
    h, w = on.shape
    pad = np.pad(on, 1)
    y, x = np.argwhere(pad)[0]
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from west
    start, came, path = (y, x), 0, []
    first = None
    while True:
        path.append((y - 1, x - 1))
        for s in range(1, 9):
            i = (came + s) % 8
            if pad[y + ring[i][0], x + ring[i][1]]:
                break
        else:
            return path
        if first is None:
            first = ((y, x), i)
        elif ((y, x), i) == first:
            return path[:-1]
        y, x = y + ring[i][0], x + ring[i][1]
        came = (i + 4) % 8  # back to where we came from


def polygon_area(path):
    ys, xs = np.array([p[0] for p in path]), np.array([p[1] for p in path])
    return abs((xs * np.roll(ys, -1) - np.roll(xs, -1) * ys).sum()) / 2


def corners(path):
    if len(path) == 1:
        return path
    out = []
    n = len(path)
    for i in range(n):
        a, b, c = path[i - 1], path[i], path[(i + 1) % n]
        if (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1]):
            out.append(b)
    return out


def disc(shape, cy, cx, r):
    yy, xx = np.ogrid[:shape[0], :shape[1]]
    return (xx - cx) ** 2 + (yy - cy) ** 2 <= r * r
