"""Column functions on transcription requests and their answers: sizes, times, labels, casing with marks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The page side that thresholds are made for, and the time model of the readers, in seconds.
BASE_SIDE = 1100
FIXED_S, MEGAPIXEL_S, LINE_S, MODEL_S, TAIL_S = 0.4, 0.1, 0.05, 0.5, 0.3
LINES_PER_PAGE, LEGACY_FACTOR = 40, 60
DETAIL_SIDE, BIG_PIXELS = 2200, 700_000


def half_up(x: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(x + 0.5)


def page_scale(w: Column, h: Column) -> Column:
    """How much larger than BASE_SIDE a page's longer side is; at least 1."""
    return F.greatest(F.lit(1.0), F.greatest(w, h) / BASE_SIDE)


def scaled_px(n: Column | float, scale: Column) -> Column:
    """A threshold in pixels at a page's scale; at least 1."""
    return F.greatest(F.lit(1), half_up((n if isinstance(n, Column) else F.lit(n)) * scale)).cast("int")


def uses_neural(font: Column, legacy: Column) -> Column:
    """The neural reader serves requests for one font, unless the old reader is asked for."""
    return (font != "__auto__") & ~legacy


def longest_side(neural: Column, detail: Column) -> Column:
    """Side to which an image is reduced: twice as long for detail with the neural reader."""
    return F.when(neural & detail, DETAIL_SIDE).otherwise(BASE_SIDE)


def fitted(w: Column, h: Column, side: Column) -> tuple[Column, Column]:
    """Width and height reduced to the side, never enlarged."""
    scale = F.least(F.lit(1.0), side / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), half_up(v * scale)).cast("int") for v in (w, h))


def estimated_lines(height_share: Column) -> Column:
    """Lines on a share of a page's height."""
    return F.greatest(F.lit(1), half_up(LINES_PER_PAGE * height_share)).cast("int")


def estimated_seconds(px: Column, height_share: Column, neural: Column, warm: Column, fonts: Column, factor: Column) -> Column:
    """Whole seconds of a request: the time model times the device's factor; the old reader takes longer, for each font."""
    seconds = FIXED_S + px / 1e6 * MEGAPIXEL_S + estimated_lines(height_share) * LINE_S
    fast = factor * (seconds + F.when(warm, 0.0).otherwise(MODEL_S))
    slow = factor * seconds * LEGACY_FACTOR * fonts
    return F.greatest(F.lit(1), half_up(F.round(F.when(neural, fast).otherwise(slow), 9))).cast("int")


def time_text(seconds: Column) -> Column:
    """Seconds as text, minutes apart from a minute on."""
    minutes, rest = F.floor(seconds / 60).cast("string"), (seconds % 60).cast("string")
    long = F.when(seconds % 60 == 0, F.concat(F.lit("ca. "), minutes, F.lit(" min"))).otherwise(F.concat(F.lit("ca. "), minutes, F.lit(" min "), rest, F.lit(" s")))
    return F.when(seconds < 60, F.concat(F.lit("ca. "), seconds.cast("string"), F.lit(" s"))).otherwise(long)


def share_text(part: Column, whole: Column) -> Column:
    """A share as whole percent with its counts; a dash for nothing."""
    percent = half_up(100.0 * part / whole).cast("string")
    return F.when(whole == 0, "-").otherwise(F.concat(percent, F.lit("% ("), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(")")))


def is_large(w: Column, h: Column, side: Column, neural: Column) -> Column:
    """Whether the old reader is warned of a large image."""
    return ~neural & ((w * h > BIG_PIXELS) | (F.greatest(w, h) >= side))


def font_label(font: Column, prefix: str) -> Column:
    """A font's name for people: without the family's prefix, spaces for hyphens."""
    return F.replace(F.regexp_replace(font, f"^{prefix}", ""), F.lit("-"), F.lit(" "))


def encoded(text: Column, offset: int) -> Column:
    """Letters A to Z as the code points of a symbol font at offset; others stay."""
    code = lambda c: F.decode(F.unhex(F.lpad(F.hex(F.ascii(c) + offset), 4, "0")), "UTF-16BE")
    shifted = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[A-Z]$"), code(c)).otherwise(c))
    return F.array_join(shifted, "")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def says(text: Column, first: str, second: str) -> Column:
    """Whether two words follow each other, with or without space between, anything but letters aside."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]+", " ")
    return letters.rlike(rf"\b{first}\s*{second}\b")


def marked_case(cells: Column, capital: Column) -> Column:
    """Cells (one letter, or alternatives like L/V) joined in lower case; the first keeps its case where capital holds."""
    return F.array_join(F.transform(cells, lambda c, i: F.when((i == 0) & capital, c).otherwise(F.lower(c))), "")


def status(error: Column, text: Column) -> Column:
    """How an answer is shown: error, empty or ok."""
    return F.when(error.isNotNull(), "error").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise("ok")


def em_of_height(height: Column) -> Column:
    """Font size of a line by its height alone."""
    return height / 0.75


def chosen_part(x: Column, y: Column, w: Column, h: Column, shown: Column, image_height: Column, side: Column) -> dict[str, Column]:
    """A rectangle drawn on an image that is shown at 1 / shown of its size: its box in the image, its size at most `side` long, its share of the height."""
    box = {"x0": x * shown, "y0": y * shown, "x1": (x + w) * shown, "y1": (y + h) * shown}
    dw, dh = fitted(w * shown, h * shown, side)
    return box | {"dw": dw, "dh": dh, "height_share": F.least(F.lit(1.0), h * shown / image_height)}


def answer(error: Column, cells: Column, label: Column, neural: Column, confidence: Column, lines: Column, ms: Column) -> dict[str, Column]:
    """An answer as it is shown: status, heading, text, legend and whether words are to be corrected.

    cells: the letters read, or alternatives like L/V. Only an answer with text has a heading, a legend (alternatives in order of appearance, none without) and
    corrections; these are left out for the neural reader, as is its confidence.
    """
    shown = F.array_join(F.transform(cells, lambda c: F.when(F.contains(c, F.lit("/")), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)), "")
    state = status(error, shown)
    tenths = half_up(ms / 100)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s"))
    sure = F.when(neural, "fast reader").otherwise(F.concat(F.lit("confidence "), half_up(F.round(confidence * 100, 9)).cast("string"), F.lit(" %")))
    heading = F.concat_ws(", ", label, sure, F.when(lines > 0, F.concat(lines.cast("string"), F.lit(" lines"))), seconds)
    others = F.array_distinct(F.filter(cells, lambda c: F.contains(c, F.lit("/"))))
    legend = F.when(F.size(others) > 0, F.array_join(others, ", "))
    ok = state == "ok"
    return {"status": state, "heading": F.when(ok, heading), "text": F.when(state == "error", error).otherwise(shown), "legend": F.when(ok, legend), "corrected": ok & ~neural}
