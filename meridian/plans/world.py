"""Small synthetic worlds with answers that can be worked out by hand, in units of 1e-7 degrees."""

from __future__ import annotations

import json
import math

U = 10_000_000


def box(x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]]:
    return [(int(x * U), int(y * U)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def star(cx: float, cy: float, r: float, n: int = 12) -> list[tuple[int, int]]:
    """A star of 2n vertices on half degrees."""
    out = []
    for i in range(2 * n):
        q = r if i % 2 == 0 else r / 2
        out.append((int(round(2 * (cx + q * math.cos(math.pi * i / n)))) * U // 2, int(round(2 * (cy + q * math.sin(math.pi * i / n)))) * U // 2))
    return [p for i, p in enumerate(out) if p != out[i - 1]]


def tiled() -> list[tuple[str, list[list[list[tuple[int, int]]]]]]:
    """Zones as (name, polygons); a polygon is an outer ring and its holes. No gaps, no overlaps."""
    host, enclave, nested = box(10, 10, 20, 20), box(12, 12, 18, 18), box(14, 14, 16, 16)
    tri = [(-60 * U, -20 * U), (-54 * U, -20 * U), (-58 * U, -11 * U)]
    ell = [(int(x * U), int(y * U)) for x, y in ((40, 30), (50, 30), (50, 34), (44, 34), (44, 40), (40, 40))]
    isles = [box(-100, 0, -98, 3), box(-103, 5, -100, 8), box(-106, -9, -100, -3)]
    ponds = [box(-105, -8, -104, -7), box(-103, -6, -102, -5)]
    sun = star(90, -40, 6)
    strait = box(95, 50, 100, 56)  # from one ocean band into the next
    land = [
        ("Land/Triangle", [[tri]]),
        ("Land/Host", [[host, [enclave[k] for k in (2, 1, 0, 3)]], [nested]]),
        ("Land/Enclave", [[enclave, nested[::-1]]]),
        ("Land/Corner", [[ell]]),
        ("Land/Islands", [[isles[0]], [isles[1]], [isles[2], *ponds]]),
        ("Land/Ponds", [[p] for p in ponds]),
        ("Land/Star", [[sun]]),
        ("Land/Strait", [[strait]]),
    ]
    holes = [tri, host, ell, *isles, sun]
    oceans = []
    for k in range(-12, 13):
        x0, x1 = max(-180.0, 15 * k - 7.5), min(180.0, 15 * k + 7.5)
        own = [h for h in holes if x0 * U <= min(p[0] for p in h) and max(p[0] for p in h) <= x1 * U]
        clipped = [(max(x0, 95.0), min(x1, 100.0))] if max(x0, 95.0) < min(x1, 100.0) else []
        own = own + [box(a, 50, b, 56) for a, b in clipped]
        name = "Etc/GMT" if k == 0 else f"Etc/GMT{-k:+d}"
        oceans.append((name, [[box(x0, -90, x1, 90), *own]]))
    return land + oceans


def gappy() -> list[tuple[str, list[list[list[tuple[int, int]]]]]]:
    return [z for z in tiled() if not z[0].startswith("Etc/")]


def overlapping() -> list[tuple[str, list[list[list[tuple[int, int]]]]]]:
    """Two zones that overlap; the one with fewer vertices comes first."""
    return [("Land/Large", [[star(0, 0, 12)]]), ("Land/Small", [[box(-4, -4, 4, 4)]])]


def geojson(zones: list[tuple[str, list[list[list[tuple[int, int]]]]]]) -> str:
    """A FeatureCollection with closed rings; single polygons as Polygon, others as MultiPolygon."""
    close = lambda ring: [[x / U, y / U] for x, y in [*ring, ring[0]]]
    features = []
    for name, polys in zones:
        coords = [[close(r) for r in p] for p in polys]
        one = len(coords) == 1
        features.append({"type": "Feature", "properties": {"tzid": name}, "geometry": {"type": "Polygon" if one else "MultiPolygon", "coordinates": coords[0] if one else coords}})
    return json.dumps({"type": "FeatureCollection", "features": features})


def tables(zones) -> dict[str, list[tuple]]:
    """Rows of zones, polys, holes and edges, for oracle SQL and brute force."""
    out: dict[str, list[tuple]] = {"zones": [], "polys": [], "holes": [], "edges": [], "outline": [], "verts": []}
    poly = hole = 0
    for z, (name, polys) in enumerate(zones):
        out["zones"].append((z, name))
        for rings in polys:
            for k, ring in enumerate(rings):
                xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                bounds = (len(ring), min(xs), max(xs), min(ys), max(ys))
                out["polys" if k == 0 else "holes"].append((poly, z, *bounds) if k == 0 else (hole, poly, *bounds))
                out["verts"] += [(poly, hole if k else -1, i, x, y) for i, (x, y) in enumerate(ring)]
                for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring, strict=True):
                    (yl, xl), (yh, xh) = sorted([(y1, x1), (y2, x2)])
                    out["outline"].append((poly, min(x1, x2), max(x1, x2), yl, yh))
                    if y1 != y2:
                        out["edges"].append((poly, hole if k else -1, xl, yl, xh, yh))
                hole += k > 0
            poly += 1
    return out


def brute_force(zones, x: int, y: int) -> list[str]:
    """All zones that contain a point, by testing every ring."""

    def inside(ring) -> bool:
        odd = False
        for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring, strict=True):
            (yl, xl), (yh, xh) = sorted([(y1, x1), (y2, x2)])
            odd ^= yl < y <= yh and (xh - xl) * (y - yl) >= (x - xl) * (yh - yl)
        return odd

    return [name for name, polys in zones if any(inside(p[0]) and not any(inside(h) for h in p[1:]) for p in polys)]
