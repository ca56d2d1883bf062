"""Sources: raw gray pages, catalogs, photos, glyph atlases, word lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.operators import pixels

CATALOG = "file string, w int, h int, font string, level string, size int, text string"
ATLAS = (
    "emPx int, alphabet string, fonts map<string, struct<letters: map<string, "
    "struct<adv: double, x0: double, y0: double, w: int, h: int, bitmap: string>>, ambiguous: array<string>>>"
)


def catalog(spark: SparkSession, path: str, terms: tuple[str, ...] = ()) -> DataFrame:
    """A JSON catalog of pages; every term must be the font or the level of a row."""
    out = spark.read.schema(CATALOG).json(path, multiLine=True)
    for term in terms:
        out = out.where((F.col("font") == term) | (F.col("level") == term))
    return out


def raw_pages(spark: SparkSession, folder: str, pages: DataFrame) -> DataFrame:
    """Headerless gray bytes joined to their catalog rows; only pages whose size fits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("gray"))
    return pages.join(named, "file").where(F.octet_length("gray") == F.col("w") * F.col("h"))


def photos(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(decoded, rejected) files of a folder by Spark's image source.

    decoded: path, file, orientation (1 to 8), width, height, nChannels, data, and font, pt and letter from the file name, null where it
    doesn't say; rejected: path and length of files that can't be decoded.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    files = spark.read.format("binaryFile").load(folder).select("path", "length", orientation(F.col("content")).alias("orientation"))
    # the two sources write a local path with one and with three strokes, and one of them encodes it
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))), F.col(c))
    place = lambda c: F.regexp_replace(plain(c), "^file:/+", "file:/")
    rule = r"^(.+)-(\d+)pt-(A1|B2)\.jpg$"
    part = lambda n: F.nullif(F.regexp_extract("file", rule, n), F.lit(""))
    named = files.withColumn("file", F.element_at(F.split(plain("path"), "/"), -1)).withColumn("font", part(1)).withColumn("pt", part(2).try_cast("int")).withColumn("letter", part(3))
    usable = img.where("height > 0 and width > 0").select(place("origin").alias("_place"), "width", "height", "nChannels", "data")
    named = named.withColumn("_place", place("path"))
    return named.join(usable, "_place").drop("_place", "length"), named.join(usable, "_place", "left_anti").select("path", "length")


PIXELS = "img string, w int, h int, y int, x int, v int"
#: Rows of pixels that are handed on at once.
PIXEL_ROWS = 1 << 16


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of images -> their gray pixels, some rows of an image at a time."""
    for batch in batches:
        for img, w, h, channels, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            flat = np.frombuffer(data, np.uint8).reshape(h, w, channels).astype(np.int32)
            step = max(1, PIXEL_ROWS // w)
            for top in range(0, h, step):
                part = flat[top : top + step]
                gray = part[:, :, 0] if channels < 3 else (part[:, :, 2] * 77 + part[:, :, 1] * 150 + part[:, :, 0] * 29) >> 8
                y, x = np.indices(gray.shape, np.int32)
                same = lambda v, t, n=gray.size: pa.array([v] * n, t)
                columns = [same(img, pa.string()), same(w, pa.int32()), same(h, pa.int32()), pa.array((y + top).ravel()), pa.array(x.ravel()), pa.array(gray.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["img", "w", "h", "y", "x", "v"])


def photo_pixels(decoded: DataFrame) -> DataFrame:
    """Decoded photos, upright: a pixel table (img, w, h, y, x, v), img being the path. Channels come as blue, green, red; a fourth is not read."""
    px = decoded.select("path", "width", "height", "nChannels", "data").mapInArrow(_pixels, PIXELS)
    turns = decoded.where("orientation > 1").select(F.col("path").alias("img"), "orientation")
    return pixels.oriented(px.join(turns, "img", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1))))


def page_pixels(raw: DataFrame) -> DataFrame:
    """Raw pages (file, w, h, gray) as a pixel table (img, w, h, y, x, v), img being the file."""
    return raw.select("file", "w", "h", F.lit(1), "gray").mapInArrow(_pixels, PIXELS)


def atlas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(glyphs, ambiguous) of a JSON atlas; bitmaps are unpacked to bytes."""
    fonts = spark.read.schema(ATLAS).json(path, multiLine=True).select(F.explode("fonts").alias("font", "f"))
    glyphs = fonts.select("font", F.explode("f.letters").alias("ch", "g")).select("font", "ch", "g.adv", "g.x0", "g.y0", "g.w", "g.h", F.unbase64("g.bitmap").alias("bitmap"))
    return glyphs, fonts.select("font", F.explode("f.ambiguous").alias("grp"))


def custom_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; blanks and # comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')")


def dictionary_stems(spark: SparkSession, path: str, drop_flags: tuple[str, ...] = ()) -> DataFrame:
    """Stems of a .dic file: no counts, comments or tabs, letters only, without the given flag sets."""
    parts = spark.read.text(path).where("value not like '%\t%' and not startswith(value, '#') and not value rlike '^[0-9]+$'").select(F.split("value", "/").alias("p"))
    stems = parts.select(F.col("p")[0].alias("stem"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("flags")).where(F.col("stem").rlike(r"^\p{L}+$"))
    return stems.where(~F.col("flags").isin(*drop_flags)) if drop_flags else stems


def packed_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, rnk, len) of a text of words parted by spaces, in order of frequency."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("rnk", "word"))
    return words.select("word", "rnk", F.length("word").alias("len"))


def frequency_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, ord) of a JSON list of words, ord counting from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("words"))
    return whole.select(F.posexplode("words").alias("ord", "word")).select("word", "ord")


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of whole text files, white space collapsed, in capitals; the name is without its ending."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return texts.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("name"), F.upper(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("text"))


def image_files(spark: SparkSession, folder: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) files by their first bytes (JPEG, PNG, GIF, BMP): path, length, content, orientation (1 to 8).

    Spark doesn't list empty files at all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")
    image = F.hex(F.substring("content", 1, 4)).rlike("^(FFD8|89504E47|47494638|424D)")
    return files.where(image).withColumn("orientation", orientation(F.col("content"))), files.where(~image).select("path", "length")


#: Fixed values of photo files: segments without a length, tag number and kind of the orientation; segments that are looked through.
BARE_SEGMENTS, TAG, SHORT, MOST_SEGMENTS = ("01", "D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7"), 0x0112, 3, 1000


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(content: Column, at: Column, n: int) -> Column:
    """Hexadecimal digits of n bytes from a place on, counted from 0."""
    return F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))


def _number(content: Column, at: Column, n: int, big: Column) -> Column:
    """The unsigned number in n bytes, the highest first if big; null beyond the end."""
    digits = _digits(content, at, n)
    turned = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n, 0, -1)])
    return F.when(F.length(digits) == 2 * n, F.conv(F.when(big, digits).otherwise(turned), 16, 10).cast("long"))


def _tag_directory(content: Column) -> Column:
    """Where the tag directory of a JPEG begins; -1 without one.

    Segment by segment: each tells its length; the pixels end the search.
    """
    state = lambda at, found: F.struct(at.cast("long").alias("at"), found.cast("long").alias("found"))
    nothing = F.lit(-1)

    def step(s: Column, _: Column) -> Column:
        mark = _digits(content, s["at"], 2)
        kind = F.substring(mark, 3, 2)
        length = _number(content, s["at"] + 2, 2, F.lit(True))
        return (
            F.when((s["found"] >= 0) | (s["at"] < 0), s)
            .when((F.length(mark) < 4) | ~F.startswith(mark, F.lit("FF")) | kind.isin("DA", "D9"), state(nothing, nothing))
            .when(kind == "FF", state(s["at"] + 1, nothing))
            .when(kind.isin(*BARE_SEGMENTS), state(s["at"] + 2, nothing))
            .when((kind == "E1") & (_digits(content, s["at"] + 4, 6) == "457869660000"), state(s["at"], s["at"] + 10))
            .otherwise(state(F.coalesce(s["at"] + 2 + length, nothing), nothing))
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), state(F.lit(2), nothing), step, lambda s: s["found"])
    return F.when(_digits(content, F.lit(0), 2) == "FFD8", walked).when(_digits(content, F.lit(0), 2).isin("4D4D", "4949"), F.lit(0).cast("long")).otherwise(nothing.cast("long"))


def orientation(content: Column) -> Column:
    """The orientation tag of a photo's bytes (JPEG, or a bare tag directory), 1 to 8; 1 without a valid one.

    The tag directory says in which order its bytes stand and where its first list is; there the tag is looked for among the entries of twelve
    bytes. The same bytes elsewhere, in a thumbnail's list or a maker's note, don't count.
    """

    def entry(b: Column) -> Column:
        kind, value = _number(b["c"], b["e"] + 2, 2, b["big"]), _number(b["c"], b["e"] + 8, 2, b["big"])
        return F.when((kind == SHORT) & value.between(1, 8), value.cast("int"))

    def entries(b: Column) -> Column:
        first = lambda i: b["list"] + 2 + 12 * i
        there = F.least(b["n"], F.floor((F.octet_length(b["c"]) - b["list"] - 2) / 12))
        found = F.filter(F.sequence(F.lit(0).cast("long"), there - 1), lambda i: _number(b["c"], first(i), 2, b["big"]) == TAG)
        return F.when(there > 0, _once(F.struct(b["c"].alias("c"), b["big"].alias("big"), first(F.get(found, F.lit(0))).alias("e")), entry))

    def directory(b: Column) -> Column:
        order = _digits(b["c"], b["at"], 2)
        big = order == "4D4D"
        start = b["at"] + _number(b["c"], b["at"] + 4, 4, big)
        known = (b["at"] >= 0) & order.isin("4D4D", "4949") & (_number(b["c"], b["at"] + 2, 2, big) == 42)
        told = F.struct(b["c"].alias("c"), big.alias("big"), start.alias("list"), _number(b["c"], start, 2, big).alias("n"))
        return F.when(known, _once(told, entries))

    whole = lambda c: _once(F.struct(c.alias("c"), _tag_directory(c).alias("at")), directory)
    return F.coalesce(_once(content, whole), F.lit(1))


def font_files(spark: SparkSession, folder: str, prefix: str, glob: str = "*.ttf") -> DataFrame:
    """(key, path) of font files: their name without prefix and ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"))
    return files.select(F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), f"^{prefix}", "").alias("key"), "path")


def unknown_fonts(named: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Files (file, font) whose font has no glyphs."""
    return named.join(glyphs.select("font").distinct(), "font", "left_anti")


def run_figures(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the figures that a run has printed, as `name: value` or `name = value`."""
    pattern = r"^\s*([A-Za-z][A-Za-z ]*?)\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"
    found = spark.read.text(path).where(F.col("value").rlike(pattern))
    return found.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).cast("double").alias("value"))
