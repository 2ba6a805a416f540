"""Oversized texts cut into pieces at natural boundaries, with overlap, by ranges.

A text (a column value or a whole file) is handled in ranges of fixed length.
The worker of a range sees it with a halo on both sides and finds boundaries in
it.  The first strong boundary at or after a range's start is its anchor; the
worker of the range before sees the same anchor in its halo, so the boundary
tables of neighbours agree and nothing has to be exchanged.  Pieces run from
anchor to anchor.  Prefix sums over the ranges' piece and character counts turn
local numbers and offsets into those of the whole text; no worker and no shuffle
ever holds a whole giant text, nor does a file's content pass through a scan.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
#: Characters (bytes for files) of one range and of the halo on either side.
RANGE, HALO = 1 << 18, 1 << 13

# Boundaries by strength, strongest first; a boundary is the place where the next piece may begin.
_KINDS = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?।॥…]+[\"'”’)\]]*\s+(?=[^\sa-z])"),
    re.compile(r"[;:]\s+"),
    re.compile(r"[,)\]–—]\s+"),
    re.compile(r"\s+"),
]
STRONG, WORD = 3, 5  # kinds before STRONG may be anchors; WORD is the weakest
_MARK = re.compile(r"[̀-ͯऀ-ः़ा-ॏ॑-॔ॢॣஂா-்ௗ︀-️‍‌]")
# A full stop after these does not end a sentence (fixed values).
_ABBREVIATION = re.compile(r"(?:\b(?:Rs|No|Mr|Mrs|Ms|Dr|Sr|Sra|St|vs|etc|Art|Sec|p|m|a|e\.g|i\.e)|\b[A-Z]|\(?\b\d{1,3})\.\s*$")


def boundaries(text: str) -> list[list[int]]:
    """Places where a piece may begin, sorted, for each kind from the strongest to the weakest."""
    out = []
    for k, pattern in enumerate(_KINDS):
        at = [m.end() for m in pattern.finditer(text) if k != 2 or not _ABBREVIATION.search(text, max(0, m.start() - 8), m.end())]
        out.append([p for p in at if 0 < p < len(text)])
    return out


def _cut(text: str, bounds: list[list[int]], start: int, done: int, limit: int) -> tuple[int, bool]:
    """Where the piece that begins at ``start`` and must pass ``done`` ends, and whether at a boundary."""
    most = start + limit
    least = max(done + 1, start + limit // 2)
    for at in bounds:
        i = bisect_right(at, most) - 1
        if i >= 0 and at[i] >= least:
            return at[i], True
    for at in bounds:  # no boundary in the second half: the latest one that makes progress
        i = bisect_right(at, most) - 1
        if i >= 0 and at[i] > done:
            return at[i], True
    end = most
    while end > done + 1 and _MARK.match(text, end):  # never before a combining mark
        end -= 1
    return (end if end > done + 1 or not _MARK.match(text, end) else most), False


def _begin(text: str, bounds: list[list[int]], cut: int, overlap: int) -> int:
    """Where the piece after ``cut`` begins: ``overlap`` characters back, or slightly fewer at a boundary."""
    low = max(0, cut - overlap)
    if low == 0 or cut == 0:
        return low
    for at, slack in zip(bounds, (4, 4, 4, 4, 4, 6)):
        i = bisect_left(at, low)
        if i < len(at) and at[i] <= min(cut, low + overlap // slack):
            return at[i]
    while low < cut and _MARK.match(text, low):
        low += 1
    return low


def cut_range(text: str, first: int, last: int, limit: int = LIMIT, overlap: int = OVERLAP, bounds: list[list[int]] | None = None) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, ends at a boundary) of ``text[first:last]``; the first reaches back before ``first``."""
    bounds = boundaries(text) if bounds is None else bounds
    out, done = [], first
    start = _begin(text, bounds, first, overlap) if first else 0
    while last - start > limit:
        cut, natural = _cut(text, bounds, start, done, limit)
        out.append((start, cut, natural))
        done, start = cut, max(_begin(text, bounds, cut, overlap), start + 1)
        if done - start > overlap:
            start = done - overlap
    if last > done or not out:
        out.append((start, last, True))
    return out


def anchor(bounds: list[list[int]], at: int, reach: int) -> int:
    """The first strong boundary in ``[at, at + reach)``, else the first of any kind, else ``at`` itself."""
    for kinds in (bounds[:STRONG], bounds):
        found = [a[i] for a in kinds if (i := bisect_left(a, at)) < len(a) and a[i] < at + reach]
        if found:
            return min(found)
    return at


def _pieces(text: str, left: int, core: int, more: bool, limit: int, overlap: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Pieces of the range ``text[left:left + core]``; ``left`` characters of halo stand before, the rest after."""
    bounds = boundaries(text)
    first = anchor(bounds, left, HALO // 2) if left else 0
    last = anchor(bounds, left + core, HALO // 2) if more else len(text)
    return (cut_range(text, first, last, limit, overlap, bounds) if last > first else []), first


def split_texts(items: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters (code points).

    Returns ``*keys, piece_no`` (from 1), ``start, end`` (offsets in the text, end exclusive), ``natural`` (ends
    at a boundary or with the text), ``n_chars`` (of the whole text), ``piece``.  Null texts and texts within the
    limit give no row.  Repeated keys are told apart by content; equal rows give their pieces each.
    """
    assert overlap < limit // 2 and size > 4 * HALO
    n = F.length("_t")
    big = items.select(*keys, F.col(text).alias("_t"), n.alias("n_chars")).where(n > limit)
    own = ", ".join(f"{k} {t}" for k, t in items.select(*keys).dtypes)
    out = [*keys, "piece_no", "start", "end", "natural", "n_chars", "piece"]

    def whole(batches):
        for b in batches:
            rows = []
            for *k, x, total in b.itertuples(index=False):
                rows += [(*k, i, s, e, nat, total, x[s:e]) for i, (s, e, nat) in enumerate(cut_range(x, 0, len(x), limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=out)

    one = big.where(F.col("n_chars") <= size).mapInPandas(whole, f"{own}, piece_no int, start long, end long, natural boolean, n_chars int, piece string")
    return one.unionByName(_giants(big.where(F.col("n_chars") > size), keys, own, limit, overlap, size).select(*out))


def _giants(giants: DataFrame, keys: list[str], own: str, limit: int, overlap: int, size: int) -> DataFrame:
    """Pieces of texts longer than a range: each text is cut into ranges with halos once, the ranges are spread and
    cut, and prefix sums over the ranges' counts number the pieces.  Equal rows count once."""

    def ranges(batches):
        for b in batches:
            for *k, x, total, row in b.itertuples(index=False):
                for r in range((total - 1) // size + 1):  # a range at a time: no second copy of the text
                    left = HALO if r else 0
                    yield pd.DataFrame([(*k, total, row, r, left, min(size, total - r * size), x[r * size - left : (r + 1) * size + HALO])], columns=[*keys, "n_chars", "_h", "_r", "_left", "_core", "_x"])

    def cut(batches):
        for b in batches:
            rows = []
            for *k, total, row, r, left, core, x in b.itertuples(index=False):
                found, _ = _pieces(x, left, core, (r + 1) * size < total, limit, overlap)
                base = r * size - left
                rows += [(*k, total, row, r, i, s + base, e + base, nat, x[s:e]) for i, (s, e, nat) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*keys, "n_chars", "_h", "_r", "_i", "start", "end", "natural", "piece"])

    # the id is of content and place in the file, so that a lost executor's rows get the same one again
    marked = giants.withColumn("_h", F.xxhash64(*keys, "_t"))
    split = marked.mapInPandas(ranges, f"{own}, n_chars int, _h long, _r int, _left int, _core int, _x string").repartition(*keys, "_h", "_r")
    local = split.mapInPandas(cut, f"{own}, n_chars int, _h long, _r int, _i int, start long, end long, natural boolean, piece string")
    counts = local.groupBy(*keys, "_h", "_r", "start").agg(F.count("*").alias("_c")).groupBy(*keys, "_h", "_r").agg(F.count("*").alias("_n"), F.max("_c").alias("_copies"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_h").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*keys, "_h", "_r", before.alias("_b"))
    return local.join(sums, [*keys, "_h", "_r"]).withColumn("piece_no", (F.col("_b") + F.col("_i") + 1).cast("int"))


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of giant UTF-8 files by byte ranges: ``path, piece_no, start, end`` (code points), ``natural, piece``.

    Only names and lengths are listed; each worker reads its own byte range and halo.  Files within the limit
    give one piece, empty files none; undecodable bytes are replaced.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("_r", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int")))).repartition("path", "_r")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            out = []
            for name, length, rng in b.itertuples(index=False):
                source, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///") if re.match(r"file:/[^/]", name) else name)
                left = HALO if rng else 0
                with source.open_input_file(at) as f:
                    data = f.read_at(min(size + left + HALO, length - rng * size + left), rng * size - left)

                def aligned(p: int) -> int:  # the next start of a character
                    while p < len(data) and data[p] & 0xC0 == 0x80:
                        p += 1
                    return p

                lo, mid = aligned(0) if rng else 0, aligned(left)
                more = (rng + 1) * size < length
                hi = aligned(left + size) if more else len(data)
                end = len(data)
                if more:  # a character cut off at the end of the halo
                    while end > hi and data[end - 1] & 0xC0 == 0x80:
                        end -= 1
                    end -= end > hi and data[end - 1] >= 0xC0
                head, core, tail = (data[i:j].decode("utf-8", "replace") for i, j in ((lo, mid), (mid, hi), (hi, end)))
                x = head + core + tail
                found, _ = _pieces(x, len(head), len(core), more, limit, overlap)
                out += [(name, rng, i, s - len(head), e - len(head), nat, x[s:e], len(core)) for i, (s, e, nat) in enumerate(found)] or [(name, rng, -1, 0, 0, True, "", len(core))]
            yield pd.DataFrame(out, columns=["path", "_r", "_i", "_s", "_e", "natural", "piece", "_c"])

    local = ranges.select("path", "length", "_r").mapInPandas(run, "path string, _r int, _i int, _s long, _e long, natural boolean, piece string, _c long")
    sums = local.groupBy("path", "_r").agg(F.count_if(F.col("_i") >= 0).alias("_n"), F.max("_c").alias("_c"))
    before = Window.partitionBy("path").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return local.where("_i >= 0").join(sums, ["path", "_r"]).select("path", (F.col("_b") + F.col("_i") + 1).cast("int").alias("piece_no"), (F.col("_s") + F.col("_o")).alias("start"), (F.col("_e") + F.col("_o")).alias("end"), "natural", "piece")
