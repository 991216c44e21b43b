"""Same-name files in several formats: groups, the copy that is kept, fingerprints and whether contents agree."""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from foliary.functions import text as T

# Formats by preference.
FORMATS = {"docx": 0, "doc": 1, "pdf": 2}
FINGERPRINT_CHARS = 20_000
# Of window hashes; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15


def preference(ext: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(ext) == k, v) for k, v in FORMATS.items()])


def grouped(files: DataFrame, name: str = "stored_name") -> DataFrame:
    """Files of known formats with their group (stem) and whether they are its primary (best format, then first)."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rows = files.withColumn("ext", ext).withColumn("stem", T.file_stem(F.col(name))).withColumn("prio", preference(F.col("ext"))).where("prio is not null")
    best = rows.groupBy("stem").agg(F.min_by(name, F.struct("prio", name)).alias("primary_name"), F.count("*").alias("formats"))
    return rows.join(best, "stem").withColumn("is_primary", F.col(name) == F.col("primary_name"))


def compared(text: Column) -> Column:
    """What of a text is compared: all of it without white space."""
    # Blanks, most of the white space, go without the expression.
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")), r"(?U)\s+", "")


def fingerprint(text: Column) -> tuple[Column, Column]:
    """Length and SHA-256 of the first 20,000 characters of what is compared; null for a null text."""
    short = F.when(text.isNotNull(), F.substring(compared(text), 1, FINGERPRINT_CHARS))
    return F.length(short), F.sha2(short, 256)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the bits of one whole number for the places of ``b``."""
    places: dict[str, int] = {}
    points = _points(b)
    for c in set(a):
        places[c] = int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    open_ = full
    for c in a:
        met = open_ & places[c]
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(b) - open_.bit_count()


def _hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` points: equal windows have equal ones."""
    power, back = (np.cumprod(np.full(len(points), x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * power)])
    return (sums[width:] - sums[:-width]) * back[: len(points) - width + 1]


def _starts_with_head(a: str, b: str, head: int) -> bool:
    """Whether the library's first block is surely ``head``, all that two texts begin with.

    It is the first of the longest equal runs of characters that may start a block (rare ones of ``b``, the second text)
    with all that is equal around it. A longer one than the head's longest ends behind the head in both texts, so a window
    of one character more is in what both have from that length before the head's end on. Windows are compared by hashes,
    which may say no where it is yes.
    """
    points = _points(b)
    rare = np.bincount(points)[points] <= len(b) // 100 + 1 if len(b) >= 200 else np.ones(len(b), bool)
    edges = np.flatnonzero(np.diff(rare[:head].astype(np.int8), prepend=0, append=0))
    longest = int(np.max(edges[1::2] - edges[::2], initial=0))
    at, width = head - longest, longest + 1
    if min(len(a), len(b)) - at < width:
        return True
    sums = np.concatenate([[0], np.cumsum(rare[at:])])
    whole = sums[width:] - sums[:-width] == width
    return not whole.any() or not np.isin(_hashes(points[at:], width)[whole], _hashes(_points(a[at:]), width)).any()


def alike(a: str, b: str, least: float) -> bool:
    """Whether the standard library's ratio of two texts is ``least`` or more, without all of its blocks.

    Its blocks make a common subsequence, so the longest one bounds them: unlike texts, whose many short blocks cost most,
    are settled by that, and copies with another end by what both begin with. Of others its blocks are taken, the greater
    ranges first, until they or what is left decide.
    """
    total = len(a) + len(b)
    enough = lambda n: (2.0 * n / total if total else 1.0) >= least
    head = 0
    for step in (1 << k for k in range(min(len(a), len(b)).bit_length(), -1, -1)):
        if a[head : head + step] == b[head : head + step] and head + step <= min(len(a), len(b)):
            head += step
    if enough(head) and _starts_with_head(a, b, head):
        return True
    if not enough(min(len(a), len(b))) or not enough(head + sum((Counter(a[head:]) & Counter(b[head:])).values())) or not enough(head + _subsequence(a[head:], b[head:])):
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    ranges, found, left = [(-min(len(a), len(b)), 0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while ranges and not enough(found) and enough(found + left):
        most, alo, ahi, blo, bhi = heapq.heappop(ranges)
        left += most
        i, j, n = matcher.find_longest_match(alo, ahi, blo, bhi)
        if n:
            found += n
            for part in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                size = min(part[1] - part[0], part[3] - part[2])
                if size:
                    left += size
                    heapq.heappush(ranges, (-size, *part))
    return enough(found)


def _same(least: float) -> Callable[[Column, Column], Column]:
    """alike of two texts' columns; null where one is. One pair at a time is text."""

    @F.arrow_udf(BooleanType())
    def same(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            yield pa.array([alike(x.as_py(), y.as_py(), least) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.bool_())

    return same


def same_content(pairs: DataFrame, least: float = 0.85, pages: int = 2, shortened: bool = False) -> DataFrame:
    """pairs of (a_text, a_pages, b_text, b_pages) with same. Without white space: equal texts agree, both empty ones where
    their pages do; too many pages apart, one empty or lengths that can't reach the ratio differ. The costly ratio is asked
    only of the rows that are left. A null text is an empty one. shortened: the texts are what ``compared`` gives, and none is null; where only equal ones agree (least is above 1) their digests do.

    The ratio is by longest common blocks, as the standard library has it by default: from 200 characters on, those that
    make up over a hundredth of the second text start no block, so a text of few kinds of characters may be unlike even a
    shifted copy of it.
    """
    # As columns of one row that is unfolded, the shortened texts are made once; as plain ones each mention makes them anew.
    # Texts too many pages apart differ whatever they hold, so of those nothing is shortened.
    far = F.abs(F.col("a_pages") - F.col("b_pages")) > pages
    near = lambda text: compared(F.when(far & (F.col("a_pages") != F.col("b_pages")), F.lit("")).otherwise(F.col(text)))
    short = F.struct(near("a_text").alias("a_short"), near("b_text").alias("b_short"))
    rows = pairs.withColumns({"a_short": F.col("a_text"), "b_short": F.col("b_text")}) if shortened else pairs.select("*", F.inline(F.array(short)))
    a, b = F.length("a_short"), F.length("b_short")
    sure = F.when((a == 0) & (b == 0), F.col("a_pages") == F.col("b_pages")).when((a == 0) | (b == 0), False).when(far, False).when(F.col("a_short") == F.col("b_short"), True)
    # No ratio is above what the shorter text would give if all of it matched, nor above 1.
    sure = F.coalesce(sure, F.when((2 * F.least(a, b) < least * (a + b)) | F.lit(least > 1), False))
    if least > 1:
        return rows.withColumn("same", sure).drop("a_short", "b_short")
    # A settled row hands no texts to Python.
    asked = lambda text: F.when(sure.isNull(), F.col(text))
    return rows.withColumn("same", F.coalesce(sure, _same(least)(asked("a_short"), asked("b_short")))).drop("a_short", "b_short")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of a name keeps it; the others get -1, -2 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("n", n).withColumn("name", F.when(F.col("n") == 0, F.col(name)).otherwise(F.concat_ws("-", name, "n"))).drop("n")
