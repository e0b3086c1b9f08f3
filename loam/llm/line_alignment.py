"""Line dedup by pairwise alignment.

Documents overlap if they share a rare passage of ``MIN_WORDS`` words, or one of
twice as many, or their whole text, however common (that finds large groups of
near copies, whose lines are in thousands of documents). A passage is a line, or
as many lines in succession, blank ones left out, as have the words.

A rare passage stands in at most ``RARE`` different texts: each later document that
has it is aligned with each earlier one. A common passage of twice the words is
looked up in the first document that has it alone, as all pairs would grow with the
square of its count. So a later document is aligned with every earlier one that it
shares rare passages with, and with the first owners of its common ones; a common
passage that patience leaves unaligned with its first owner (as other lines stand in
another order there) stays, unless a rare passage leads to another owner. A copy of
a whole text is aligned with the first of its kind, which says all that the others do.
Candidates are aligned by patience diff over line hashes, short and blank lines too;
aligned common blocks of ``MIN_WORDS`` words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._shared import as_bytes, slices, small_batches
from loam.storage import stored

#: Documents that may have a passage for it to be rare; words from which a line or block counts.
RARE, MIN_WORDS = 20, 5


def unique_matches(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that stand once in either range, thinned to the longest run ascending in both (patience)."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {a[i]: i for i in range(a0, a1) if a[i] and in_a[a[i]] == 1}
    pairs = [(at[b[j]], j) for j in range(b0, b1) if b[j] in at and in_b[b[j]] == 1]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        n = bisect_left(tails, i)
        back[k] = ends[n - 1] if n else -1
        tails[n : n + 1] = [i]
        ends[n : n + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines in ``a`` and ``b``, ascending. Zero stands for a line that matches nothing."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] and a[a0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] and a[a1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = unique_matches(a, b, a0, a1, b0, b1)
        for i, j in anchors:
            todo.append((a0, i, b0, j))
            found.append((i, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            todo.append((a0, a1, b0, b1))
    return sorted(found)


def aligned(a: list[int], b: list[int], words_a: list[int], words_b: list[int], least: int = MIN_WORDS) -> list[int]:
    """Places in ``b`` of the lines of common blocks.

    Lines of ``least`` words or more are aligned first, then all lines between
    them. Aligned lines with only blank lines between them are one block; a block
    goes with these blank lines if it has ``least`` words, or is all that both texts say.
    """
    found = patience([x if n >= least else 0 for x, n in zip(a, words_a, strict=True)], [x if n >= least else 0 for x, n in zip(b, words_b, strict=True)])
    pairs: list[tuple[int, int]] = []
    i0 = j0 = 0
    for i, j in [*found, (len(a), len(b))]:
        pairs += ((i0 + x, j0 + y) for x, y in patience(a[i0:i], b[j0:j]))
        pairs.append((i, j))
        i0, j0 = i + 1, j + 1
    pairs.pop()
    blocks: list[list[int]] = []  # first place in b, last place in b, words
    last = (-1, -1)
    for i, j in pairs:
        if blocks and not any(words_a[last[0] + 1 : i]) and not any(words_b[last[1] + 1 : j]):
            blocks[-1][1], blocks[-1][2] = j, blocks[-1][2] + words_b[j]
        else:
            blocks.append([j, j, words_b[j]])
        last = i, j
    whole = max(sum(words_a), sum(words_b))
    return [k for first, end, words in blocks if words >= min(least, whole) for k in range(first, end + 1)]


def line_hashes(text: str | F.Column, min_words: int = MIN_WORDS) -> tuple[F.Column, F.Column]:
    """A hash for each line of a text, white space at its ends ignored, and its words, counted up to twice ``min_words``."""

    def words(line: F.Column) -> F.Column:
        enough = line.rlike(r"^\S+(?:\s+\S+){%d}" % (2 * min_words - 1))
        return F.when(line == "", 0).when(enough, 2 * min_words).otherwise(F.size(F.split(line, r"\s+")))

    bare = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\f\r")))
    return F.transform(bare, lambda line: F.xxhash64(line)), F.transform(bare, words)


def passages(h: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, kind, key``, without repeats: hashes of each document's shortest runs of lines, blank ones left out, that have enough words.

    Kind 0 has ``least`` words, kind 1 twice as many, or is the whole of a shorter text.
    Runs of both kinds from one line that are the same, as they have twice the words, are of kind 1 only.
    """
    full = words > 0
    h, words, doc = h[full].view(np.uint64), words[full], doc[full]
    at = np.arange(len(h))
    stop, before = np.searchsorted(doc, doc, "right"), np.concatenate([[0], np.cumsum(words)])
    short, long = (np.searchsorted(before, before[:-1] + n) for n in (least, 2 * least))
    start = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(h)]
    whole = np.where(start, np.minimum(long, stop), long)
    out = []
    for kind, end, some in ((0, short, (short <= stop) & (short != long)), (1, whole, whole <= stop)):
        i, end = at[some], end[some]
        key = np.zeros(len(i), np.uint64)
        for k in range(int((end - i).max(initial=0))):
            inside = i + k < end
            key[inside] = key[inside] * np.uint64(0x9E3779B97F4A7C15) + h[i[inside] + k]
        out.append((doc[i], np.full(len(i), kind, np.int32), key.view(np.int64)))
    d, kind, key = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((key, kind, d))
    d, kind, key = d[order], kind[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
    return d[new], kind[new], key[new]


def overlaps(lines: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``(later, first)``: for each document the earlier documents that it is aligned with.

    ``lines`` has ``o``, the order of documents, ``h`` and ``w``, their lines' hashes and words, for texts that differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w = b.column("h"), b.column("w")
            doc = np.repeat(np.arange(len(h)), h.value_lengths().to_numpy(zero_copy_only=False))
            d, kind, key = passages(h.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), doc, min_words)
            for k in range(0, len(d), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([b.column("o").take(pa.array(d[part])), pa.array(kind[part]), pa.array(key[part])], names=["o", "kind", "key"])

    keys = lines.mapInArrow(run, f"o {lines.schema['o'].dataType.simpleString()}, kind int, key long")
    owners = keys.groupBy("kind", "key").agg(F.min("o").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & ((F.col("kind") == 1) | (F.col("n") <= rare)))
    owners = stored(owners, "owners")  # so that the joins below have their own exchanges, which adaptive execution can split at a common line
    common = keys.join(owners.where(F.col("n") > rare).drop("n"), ["kind", "key"]).where("o > first").select(F.col("o").alias("later"), "first")
    few = keys.join(owners.where(F.col("n") <= rare).select("kind", "key"), ["kind", "key"]).groupBy("kind", "key").agg(F.sort_array(F.collect_list("o")).alias("all"))  # at most ``rare``
    each = few.select(F.posexplode("all").alias("k", "later"), "all").select("later", F.explode(F.slice("all", 1, F.col("k"))).alias("first"))
    return common.unionByName(each).distinct()


def align(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the text thinned, and columns ``n_lines``, ``n_removed``, ``n_aligned``.

    Earlier means a lesser id; null ids come last, and of equal ids the text
    with the lesser hash comes first. Rows equal in id and text count as one
    document: both are treated alike, and neither is held against the other.
    ``rare`` counts texts that differ, so copies of a whole make a line no commoner.
    Lines of fewer than ``min_words`` words, empty ones too, are deleted only
    within a common block that has as many.
    A null text stays null with no lines. All columns are returned; the three
    new ones take the place of columns of their names.
    """
    spark = documents.sparkSession
    small_batches(spark)
    order = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"))
    lines = documents.where(F.col(text_col).isNotNull()).select(order.alias("o"), *(c.alias(n) for c, n in zip(line_hashes(text_col, min_words), "hw", strict=True)))
    lines = stored(lines.where(F.exists("w", lambda x: x > 0)).dropDuplicates(["o"]), "lines")
    # of documents with the same text the first stands for all; the others are aligned with it
    alike = stored(lines.groupBy(F.col("o.print").alias("print")).agg(F.min("o").alias("first")), "alike")  # so that adaptive execution can split the join at a large group
    whole = lines.select(F.col("o").alias("later")).join(alike, F.col("later.print") == F.col("print")).where("later <> first").select("later", "first")
    firsts = lines.join(alike, F.col("o") == F.col("first"), "left_semi")
    pairs = stored(overlaps(firsts, rare, min_words).unionByName(whole), "overlaps")
    both = pairs.join(lines.select(F.col("o").alias("first"), F.col("h").alias("a"), F.col("w").alias("words_a")), "first")
    both = both.join(lines.select(F.col("o").alias("later"), F.col("h").alias("b"), F.col("w").alias("words_b")), "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [aligned(*x, min_words) for x in zip(*(b.column(n).to_pylist() for n in ("a", "b", "words_a", "words_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("later"), pa.array(got, pa.list_(pa.int32()))], names=["later", "places"])

    kind = lines.schema["o"].dataType.simpleString()
    places = both.select("later", "a", "b", "words_a", "words_b").mapInArrow(run, f"later {kind}, places array<int>")
    gone = places.groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__gone"), F.count("*").alias("__aligned"))
    gone = gone.select(F.col("later.id").alias("__id"), F.col("later.print").alias("__print"), "__gone", "__aligned")
    out = documents.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__print")), "left")
    added = ["n_lines", "n_removed", "n_aligned"]
    out = out.drop("__id", "__print", *added)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                texts, counts = [], []
                for t, lost, n in zip(as_bytes(b.column(text_col)), b.column("__gone").to_pylist(), b.column("__aligned").to_pylist(), strict=True):
                    lines_of, lost = [] if t is None else t.split(b"\n"), set(lost or ())
                    texts.append(t if not lost else b"\n".join(x for k, x in enumerate(lines_of) if k not in lost))
                    counts.append((len(lines_of), len(lost), n or 0))
                cols = {n: b.column(n) for n in b.schema.names if n not in ("__gone", "__aligned")}
                cols[text_col] = pa.array(texts, pa.binary()).cast(b.schema.field(text_col).type)
                yield pa.RecordBatch.from_pydict(cols | {n: pa.array([c[k] for c in counts], pa.int64()) for k, n in enumerate(added)})

    kinds = [f"`{n}` {k}" for n, k in out.drop("__gone", "__aligned").dtypes]
    return out.mapInArrow(thin, ", ".join([*kinds, *(f"{n} long" for n in added)]))
