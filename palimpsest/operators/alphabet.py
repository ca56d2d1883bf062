"""Procedural glyph alphabets: 26 stroke figures per alphabet, drawn by a rule from the letter's number.

Glyphs carry advance and offsets in em and a bitmap (0..255) at EM pixels per em. Letters may share a bitmap
on purpose (twins), as ambiguous groups do.
"""

from __future__ import annotations

import numpy as np

EM = 32
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bitmap(font: int, letter: int, w: int, h: int) -> np.ndarray:
    """A stem plus strokes between grid points; which strokes is a bit pattern of the letter's number."""
    ys, xs = np.mgrid[0:h, 0:w]
    ink = xs < 3
    points = [(0, 0), (w - 1, 0), (0, h // 2), (w - 1, h // 2), (0, h - 1), (w - 1, h - 1)]
    strokes = [(0, 1), (2, 3), (4, 5), (1, 3), (3, 5), (0, 3), (2, 5), (1, 2), (3, 4)]
    code = (letter * 37 + 11 + 101 * font) % 509 or 255
    for bit, (a, b) in enumerate(strokes):
        if code >> bit & 1:
            (x0, y0), (x1, y1) = points[a], points[b]
            t = np.clip(((xs - x0) * (x1 - x0) + (ys - y0) * (y1 - y0)) / max((x1 - x0) ** 2 + (y1 - y0) ** 2, 1), 0, 1)
            ink |= (xs - x0 - t * (x1 - x0)) ** 2 + (ys - y0 - t * (y1 - y0)) ** 2 <= 2.3
    return (ink * 255).astype(np.uint8)


def glyphs(font: int, twins: tuple[str, ...] = ()) -> list[dict]:
    """The glyph rows (font, ch, adv, x0, y0, w, h, bitmap) of one alphabet."""
    same = {b: a for a, b in twins}
    rows = []
    for n, ch in enumerate(LETTERS):
        shape = LETTERS.index(same.get(ch, ch))
        w, h = 14 + (shape * 5 + font) % 9, 26
        rows.append({"font": f"alphabet-{font}", "ch": ch, "adv": (w + 3) / EM, "x0": 1 / EM, "y0": -h / EM, "w": w, "h": h, "bitmap": bitmap(font, shape, w, h).tobytes()})
    return rows


GLYPH_SCHEMA = "font string, ch string, adv double, x0 double, y0 double, w int, h int, bitmap binary"
