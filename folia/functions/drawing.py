"""Drawings: graphics orders as shapes, shapes as SVG.

``shapes`` walks an object's orders with a pen and gives what they draw as plain values in window
units, with y upward as the orders have it; ``markup`` turns them over and writes them. An order
at a given position is the one at the current position with bit 0x40 set and its start put first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from folia.functions import scans
from folia.functions.scans import s16, u16

# Colours by index, dashes in widths of the line by type, ends and joins of lines.
COLORS = {
    0xFF00: "#000000", 0xFF01: "#0000ff", 0xFF02: "#ff0000", 0xFF03: "#ff00ff", 0xFF04: "#00ff00", 0xFF05: "#00ffff", 0xFF06: "#ffff00", 0xFF07: "#000000", 0xFF08: "#000000", 0xFF10: "#a52a2a",
}
BLACK = "#000000"
DASHES = {1: (1, 3), 2: (6, 3), 3: (6, 3, 1, 3), 4: (1, 1), 5: (12, 3), 6: (6, 3, 1, 1, 1, 3)}
INVISIBLE, SOLID_FILL = 8, 0x10
ENDS = {0: "round", 1: "butt", 2: "square", 3: "round"}
JOINS = {0: "round", 1: "bevel", 2: "round", 3: "miter"}

GIVEN = 0x40
BOX, LINE, FILLET, FULL_ARC, RELATIVE, PARTIAL_ARC, CURVES = 0x80, 0x81, 0x85, 0x87, 0xA1, 0xA3, 0xA5
#: Least bytes of an order at the current position, beyond its start.
LEAST = {BOX: 6, LINE: 0, FILLET: 0, FULL_ARC: 2, RELATIVE: 0, PARTIAL_ARC: 14, CURVES: 12}

Point = tuple[float, float]


@dataclass(frozen=True)
class Window:
    """A drawing's window: units per inch, left, right, bottom, top."""

    upi: float
    left: int
    right: int
    bottom: int
    top: int

    @property
    def width(self) -> int:
        return self.right - self.left

    @property
    def height(self) -> int:
        return self.top - self.bottom


def window(descriptor: bytes) -> Window | None:
    """The first window among a descriptor's parameters."""
    at = 0
    while at + 2 <= len(descriptor):
        body = descriptor[at + 2 : at + 2 + descriptor[at + 1]]
        if len(body) < descriptor[at + 1]:
            return None
        if descriptor[at] == 0xF6 and len(body) >= 18:
            units = u16(body, 4)
            return Window(units / 10.0 if body[3] == 0 else units * 0.254, *(s16(body, k) for k in (10, 12, 14, 16)))
        at += 2 + len(body)
    return None


@dataclass(frozen=True)
class Style:
    color: str = BLACK
    width: float = 1.0
    kind: int = 7
    end: str = "round"
    join: str = "round"
    pattern: int = SOLID_FILL
    #: Images of the unit vectors: (p, s) and (r, q).
    arc: tuple[float, float, float, float] = (1.0, 1.0, 0.0, 0.0)

    @property
    def fill(self) -> str:
        return self.color if self.pattern == SOLID_FILL or 1 <= self.pattern <= 8 else "none"


@dataclass(frozen=True)
class Shape:
    """kind: line, box, ellipse, arc, curves or area; points: what places it; more: its other numbers, or an area's parts."""

    kind: str
    points: tuple[Point, ...]
    style: Style
    more: tuple = ()


def process_color(operand: bytes) -> str:
    """RGB and CMYK values; other spaces are black."""
    space, v = operand[1:2], operand[6:]
    if space == b"\x01" and len(v) >= 3:
        return "#" + v[:3].hex()
    if space == b"\x04" and len(v) >= 4:
        c, m, y, k = (x / 255 for x in v[:4])
        return "#" + bytes(int(255 * (1 - ink) * (1 - k)) for ink in (c, m, y)).hex()
    return BLACK


def _styled(style: Style, code: int, p: bytes) -> Style:
    """The style after an order that sets one; orders that don't, or are too short, leave it."""
    if code == 0xB2:
        return replace(style, color=process_color(p))
    if code == 0x26 and len(p) >= 2:
        return replace(style, color=COLORS.get(u16(p), BLACK))
    if code == 0x11 and len(p) >= 2:
        return replace(style, width=w) if (w := p[0] + p[1] / 256.0) > 0 else style
    if code == 0x22 and len(p) >= 8:
        return replace(style, arc=tuple(float(s16(p, k)) for k in (0, 2, 4, 6)))
    if not p:
        return style
    one = {
        0x0A: ("color", COLORS.get(0xFF00 | p[0], BLACK)), 0x18: ("kind", p[0]), 0x19: ("width", max(p[0], 1)), 0x1A: ("end", ENDS.get(p[0], "round")),
        0x1B: ("join", JOINS.get(p[0], "round")), 0x28: ("pattern", p[0] or SOLID_FILL),
    }
    return replace(style, **dict([one[code]])) if code in one else style


def _pairs(p: bytes) -> list[Point]:
    return [(s16(p, k), s16(p, k + 2)) for k in range(0, len(p) - 3, 4)]


def _signed(b: int) -> int:
    return b - 256 if b > 127 else b


@dataclass
class _Pen:
    at: Point = (0, 0)
    style: Style = field(default_factory=Style)
    out: list[Shape] = field(default_factory=list)
    area: list[Shape] | None = None  # parts of the open area
    bounded: bool = True

    def put(self, shape: Shape) -> None:
        (self.out if self.area is None or shape.kind in ("arc", "curves") else self.area).append(shape)

    def draw(self, kind: int, p: bytes) -> None:
        start = self.at
        if kind in (LINE, FILLET):
            points = [start, *_pairs(p)]
            self.at = points[-1]
            self.put(Shape("line", tuple(points), self.style))
        elif kind == RELATIVE:
            points = [start]
            for k in range(0, len(p) - 1, 2):
                points.append((points[-1][0] + _signed(p[k]), points[-1][1] + _signed(p[k + 1])))
            self.at = points[-1]
            self.put(Shape("line", tuple(points), self.style))
        elif kind == BOX:
            self.put(Shape("box", (start, (s16(p, 2), s16(p, 4))), self.style))
        elif kind == FULL_ARC:
            if (scale := p[0] + p[1] / 256.0) >= 1e-6:
                self.put(Shape("ellipse", (start,), self.style, (scale,)))
        elif kind == PARTIAL_ARC:
            self.partial_arc(start, p)
        elif kind == CURVES:
            points = _pairs(p)
            points = points[: len(points) // 3 * 3]
            if points:
                self.at = points[-1]
                self.put(Shape("curves", (start, *points), self.style))

    def partial_arc(self, start: Point, p: bytes) -> None:
        scale, (first, sweep) = p[4] + p[5] / 256.0, (int.from_bytes(p[k : k + 4], "big") / 65536.0 % 360.0 for k in (6, 10))
        x, y = s16(p), s16(p, 2)
        px, qy, rx, sy = (scale * v for v in self.style.arc)
        a, b = math.sqrt(px * px + sy * sy), math.sqrt(rx * rx + qy * qy)
        if scale < 1e-6 or sweep < 1e-6 or min(a, b) < 1e-6:
            return
        ends = []
        for angle in (math.radians(first), math.radians(first + sweep)):
            ends.append((x + px * math.cos(angle) + rx * math.sin(angle), y + sy * math.cos(angle) + qy * math.sin(angle)))
        self.at = ends[1]
        turn = -math.degrees(math.atan2(sy, px)) or 0.0
        self.put(Shape("arc", (start, *ends), self.style, (a, b, turn, int(sweep > 180), int(px * qy - rx * sy < 0))))

    def order(self, code: int, p: bytes) -> None:
        kind = code & ~GIVEN
        if code == 0x21 and len(p) >= 4:
            self.at = (s16(p), s16(p, 2))
        elif code == 0x68:
            self.area, self.bounded = [], bool(p and p[0] & 0x40)
        elif code == 0x60:
            if self.area:
                self.out.append(Shape("area", (), self.style, (tuple(self.area), self.bounded)))
            self.area = None
        elif kind in LEAST and code < 0x100:
            if code & GIVEN:  # a box has two bytes before its corners
                cut = 2 if kind == BOX else 0
                if len(p) < cut + 4 or len(p) - 4 < LEAST[kind]:
                    return
                self.at = (s16(p, cut), s16(p, cut + 2))
                p = p[:cut] + p[cut + 4 :]
            if len(p) >= LEAST[kind]:
                self.draw(kind, p)
        else:
            self.style = _styled(self.style, code, p)


def shapes(orders: bytes) -> list[Shape]:
    """What the orders of a graphics object draw."""
    pen = _Pen()
    for code, operand in scans.orders(orders):
        pen.order(code, operand)
    return pen.out


def _stroke(s: Style) -> str:
    if s.kind == INVISIBLE:
        return 'stroke="none"'
    dash = " ".join(str(round(v * (s.width or 1), 3)) for v in map(float, DASHES.get(s.kind, ())))
    return f'stroke="{s.color}" stroke-width="{s.width:.3g}" stroke-linecap="{s.end}" stroke-linejoin="{s.join}"' + (f' stroke-dasharray="{dash}"' if dash else "")


class _Writer:
    def __init__(self, frame: Window):
        self.frame = frame

    def xy(self, p: Point) -> str:
        return f"{p[0] - self.frame.left:.3g},{self.frame.top - p[1]:.3g}"

    def part(self, s: Shape, first: bool) -> str:
        """An area's part as a path."""
        if s.kind == "line":
            return " ".join([("M " if first else "L ") + self.xy(s.points[0]), *(f"L {self.xy(p)}" for p in s.points[1:])])
        if s.kind == "box":
            (x0, y0), (x1, y1) = s.points
            return "M " + " L ".join(map(self.xy, ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))) + " Z"
        (x, y), (scale,) = s.points[0], s.more
        p, q, r, t = s.style.arc
        a, b = math.sqrt(p * p + t * t) * scale, math.sqrt(r * r + q * q) * scale
        west, east = self.xy((x - a, y)), self.xy((x + a, y))
        return f"M {west} A {a:.3g},{b:.3g} 0 1 0 {east} A {a:.3g},{b:.3g} 0 1 0 {west} Z"

    def ellipse(self, s: Shape) -> str:
        p, q, r, t = (v * s.more[0] for v in s.style.arc)
        a, b = math.sqrt(p * p + t * t), math.sqrt(r * r + q * q)
        if min(a, b) < 1e-6:
            return ""
        turn = -math.degrees(math.atan2(t, p))
        x, y = self.xy(s.points[0]).split(",")
        paint = f'fill="{s.style.fill}" {_stroke(s.style)}'
        if abs(turn) >= 0.5:
            return f'<ellipse cx="{x}" cy="{y}" rx="{a:.3g}" ry="{b:.3g}" {paint} transform="rotate({turn:.3g} {x} {y})"/>'
        if abs(a - b) < 0.01:
            return f'<circle cx="{x}" cy="{y}" r="{a:.3g}" {paint}/>'
        return f'<ellipse cx="{x}" cy="{y}" rx="{a:.3g}" ry="{b:.3g}" {paint}/>'

    def element(self, s: Shape) -> str:
        if s.kind == "line":
            return f'<polyline points="{" ".join(map(self.xy, s.points))}" fill="none" {_stroke(s.style)}/>'
        if s.kind == "box":
            (x0, y0), (x1, y1) = s.points
            x, y = self.xy((min(x0, x1), max(y0, y1))).split(",")
            return f'<rect x="{x}" y="{y}" width="{abs(x1 - x0):.3g}" height="{abs(y1 - y0):.3g}" fill="{s.style.fill}" {_stroke(s.style)}/>'
        if s.kind == "ellipse":
            return self.ellipse(s)
        if s.kind == "area":
            parts, bounded = s.more
            path = " ".join(self.part(x, k == 0) for k, x in enumerate(parts)) + " Z"
            return f'<path d="{path}" fill="{s.style.fill}" {_stroke(s.style) if bounded else 'stroke="none"'}/>'
        if s.kind == "arc":
            a, b, turn, large, sweep = s.more
            start, first, last = map(self.xy, s.points)
            path = f"M {start} L {first} A {a:.3g},{b:.3g} {turn:.3g} {large} {sweep} {last}"
        else:
            p = list(map(self.xy, s.points))
            path = " ".join([f"M {p[0]}", *(f"C {p[k]} {p[k + 1]} {p[k + 2]}" for k in range(1, len(p), 3))])
        return f'<path d="{path}" fill="none" {_stroke(s.style)}/>'


def markup(found: list[Shape], frame: Window) -> str:
    """The shapes as SVG elements in the frame's units, y downward."""
    writer = _Writer(frame)
    return "".join(map(writer.element, found))


def drawn(descriptor: bytes, orders: bytes) -> dict | None:
    """An object's window size, number of shapes and markup; None without a window of some size or without a mark."""
    frame = window(descriptor)
    if frame is None or frame.width <= 0 or frame.height <= 0:
        return None
    found = shapes(orders)
    svg = markup(found, frame)
    return {"width": frame.width, "height": frame.height, "shapes": len(found), "svg": svg} if svg else None
