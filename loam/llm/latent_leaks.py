"""Benchmark decontamination by latent semantic retrieval.

One pass over the texts writes a table of the benchmark's terms in each document
with their places; all else reads that. Documents are cut in passages, windows of
``window`` words that overlap by half. The TF-IDF matrix of all passages over the benchmark's terms is projected on its
leading right singular vectors, found by a distributed randomised SVD: each task
multiplies its passages by a random matrix and back (one power iteration), and
the sums, one row for each benchmark term, are made orthonormal on the driver.
Passages near an item by cosine in that space are candidates, if they share enough
of its weight; an item of more than two windows is looked for by its windows too. Each is read against the item: the longest common subsequence of words has to hold most of
the item, or a good part of it together with its answer, the item's last words.

The driver holds matrices of a block's terms times ``rank``. The benchmark is the query
set; one of more than ``MAX_ITEMS`` items or ``MAX_TERMS`` terms is searched block by
block, each in a space of its own. What is a leak is decided on the words alone,
whatever the space; which passages are read for it is approximate in any space, so
blocks can differ from the whole in borderline candidates (a test on planted
paraphrases finds the same rows for one, three and twenty blocks).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.llm._shared import among, as_bytes, by_text, release, slices, small_batches
from loam.storage import stored

WINDOW, RANK, COSINE = 32, 64, 0.3
#: Least weight that a candidate shares with an item: of the item's, and of the passage's or the item's if that is less.
OF_ITEM, OF_LESS = 0.25, 0.5
#: Shares of an item, in words, that a paraphrase keeps in order: without and with its answer; share of the answer.
ALONE, WITH_ANSWER, ANSWER = 0.8, 0.6, 0.75
#: Share of half-windows from which a term tells nothing of a subject.
COMMON = 0.02
#: Items and terms of one block.
MAX_ITEMS, MAX_TERMS, SEED = 50_000, 200_000, 7
_KEPT = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 0x7F else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_KEPT).split()


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        if m := places.get(y):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def answer_of(item: list) -> list:
    """An item's last quarter, four words at least."""
    return item[-max(4, math.ceil(len(item) / 4)) :]


def verdict(item: list, region: list, alone: float = ALONE, with_answer: float = WITH_ANSWER, answer: float = ANSWER) -> tuple[bool, float, float]:
    """Whether the region restates the item; the shares of the item and of its answer found in order."""
    share = common_length(item, region) / len(item)
    if share < with_answer:
        return False, share, 0.0
    last = answer_of(item)
    held = common_length(last, region) / len(last)
    return share >= alone or held >= answer, share, held


class Space:
    """The benchmark's terms, items and, later, weights and directions; sent to the tasks."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.half = window // 2
        self.ids, words = [i for i, _ in items], [words_of(t) for _, t in items]
        self.term = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.items = [[self.term[w] for w in ws] for ws in words]
        # what passages are compared with: each item, and windows of those of which a passage may hold too little
        cuts = [(k, x[min(at, len(x) - window) :][:window]) for k, x in enumerate(self.items) if len(x) > 2 * window for at in range(0, len(x), window)]
        self.parts, self.of = [*self.items, *(x for _, x in cuts)], [*range(len(self.items)), *(k for k, _ in cuts)]
        self.weight = np.ones(len(self.term), np.float32)
        self.basis = self.queries = self.full = self.keys = None

    def terms(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words of a text, and those that are terms of the benchmark with their places."""
        words, get = words_of(text), self.term.get
        of = np.array([get(w, -1) for w in words], np.int32)
        at = np.flatnonzero(of >= 0).astype(np.int32)
        return len(words), of[at], at


class Batch:
    """Documents' terms, laid in half-windows; passage k of a document has its half-windows k and k + 1."""

    def __init__(self, b: pa.RecordBatch, space: Space):
        release()
        self.ids = b.column("id")
        n_words = np.asarray(b.column("n_words")).astype(np.int64)
        sizes = np.asarray(pc.list_value_length(b.column("terms"))).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.all_terms, self.all_places = (np.asarray(b.column(c).flatten()) for c in ("terms", "places"))
        halves = -(-n_words // space.half)
        rows = np.where(halves > 0, np.maximum(halves, 2), 0)
        base = np.cumsum(rows) - rows
        counts = np.maximum(rows - 1, 0)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.first = base[self.owner] + self.nth
        used = space.weight[self.all_terms] > 0
        self.terms = self.all_terms[used]
        self.half = (self.all_places // space.half + np.repeat(base, sizes))[used]
        self.n_rows = int(rows.sum())

    def sums(self, matrix: np.ndarray) -> np.ndarray:
        """The terms' rows of ``matrix``, summed for each half-window."""
        out = np.zeros((self.n_rows, matrix.shape[1]), matrix.dtype)
        if len(self.half):
            starts = np.flatnonzero(np.concatenate([[True], self.half[1:] != self.half[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(self.half)]]))
            for k in range(sizes.max()):  # the k-th term of each half-window that has one
                at = starts[sizes > k] + k
                out[self.half[at]] += matrix[self.terms[at]]
        return out


def tokens(df: DataFrame, space: Space) -> DataFrame:
    """``id, n_words, terms, places``, of texts with a term."""
    share = df.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got = [share.value.terms(t or b"") for t in as_bytes(b.column("text"))]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(g[1]) for g in got])]), pa.int32())
                cols = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[k] for g in got]), pa.int32())) for k in (1, 2)]
                out = pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.int32()), *cols], names=["id", "n_words", "terms", "places"])
                yield out.filter(pc.greater(pc.list_value_length(cols[0]), 0))

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, n_words int, terms array<int>, places array<int>")


def _emit(total: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(np.abs(total).sum(1))
    return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32()), "vals": pa.array(list(total[rows].astype(float)), pa.list_(pa.float64()))})


def _summed(df: DataFrame, run, rows: int, width: int) -> np.ndarray:
    """The sum over all tasks of the matrices, ``rows`` by ``width``, that they emit by rows."""
    flat = df.mapInArrow(run, "row int, vals array<double>").groupBy("row").agg(*(F.sum(F.col("vals")[k]).alias(f"v{k}") for k in range(width)))
    got = flat.toPandas()  # a row for each of the benchmark's terms
    out = np.zeros((rows, width))
    at = got.pop("row").to_numpy()
    out[at] = got.to_numpy()
    return out


def fit(found: DataFrame, space: Space, rank: int, common: float) -> int:
    """Set the terms' weights from all half-windows, then the directions from the whole TF-IDF matrix; returns the half-windows."""
    context, n_terms = found.sparkSession.sparkContext, len(space.term)
    share = context.broadcast(space)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_terms + 1, 1))
        for b in batches:
            x = Batch(b, share.value)
            total[n_terms, 0] += x.n_rows
            code = np.sort(x.half * n_terms + x.terms)
            total[:n_terms, 0] += np.bincount(code[np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]] % n_terms, minlength=n_terms)
        yield _emit(total)

    seen = _summed(found, count, n_terms + 1, 1)[:, 0]
    halves, seen = int(seen[-1]), seen[:-1]
    weight = np.log((1 + halves) / (1 + seen)) * (seen <= common * halves)
    for item in space.items:  # an item of common terms alone keeps them
        if not weight[item].any():
            weight[item] = np.maximum(np.log((2 + halves) / (1 + seen[item])), 1e-3)
    space.weight = weight.astype(np.float32)
    width = min(rank, n_terms)
    start = np.random.default_rng(SEED).standard_normal((n_terms, width)).astype(np.float32)
    share.unpersist()
    share = context.broadcast((space, start * space.weight[:, None]))

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, matrix = share.value
        total = np.zeros((n_terms, width))
        for b in batches:
            x = Batch(b, s)
            sums = x.sums(matrix)
            y = sums[x.first] + sums[x.first + 1]
            at = np.zeros_like(sums)  # what the one or two passages with a half-window have
            at[x.first] = y
            at[x.first + 1] += y
            if len(x.terms):
                by = np.argsort(x.terms, kind="stable")
                t = x.terms[by]
                starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                total[t[starts]] += np.add.reduceat(at[x.half[by]], starts, axis=0)
        yield _emit(total * s.weight[:, None])

    basis = np.linalg.qr(_summed(found, iterate, n_terms, width) + 1e-9 * start)[0]
    share.unpersist()
    space.basis = (basis * space.weight[:, None]).astype(np.float32)
    q = np.stack([space.basis[i].sum(0) for i in space.parts])
    space.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    space.full = np.array([space.weight[i].sum() for i in space.parts])
    space.keys = np.sort(np.concatenate([np.unique(i) + k * n_terms for k, i in enumerate(space.parts)]).astype(np.int64))
    return halves


def candidates(x: Batch, s: Space, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passages, parts of items and cosines of pairs that are near in the latent space and share enough weight."""
    sums, mass = x.sums(s.basis), np.bincount(x.half, weights=s.weight[x.terms], minlength=x.n_rows)
    left, right = np.searchsorted(x.half, x.first), np.searchsorted(x.half, x.first + 2)
    some = np.flatnonzero(right > left)
    full, keys = s.full, s.keys
    for at in range(0, len(some), 1024):
        p = some[at : at + 1024]
        z = sums[x.first[p]] + sums[x.first[p] + 1]
        cos = z @ s.queries.T / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        i, q = np.nonzero(cos >= cosine)
        held, passage = full[q], (mass[x.first[p]] + mass[x.first[p] + 1])[i]
        least = np.maximum(OF_ITEM * held, OF_LESS * np.minimum(held, passage))
        fit_in = passage >= least
        i, q, least = i[fit_in], q[fit_in], least[fit_in]
        n = (right - left)[p[i]]
        if not len(n):
            continue
        begin = np.cumsum(n) - n
        at_term = np.arange(n.sum()) - np.repeat(begin - left[p[i]], n)
        t = x.terms[at_term].astype(np.int64)
        code = t + np.repeat(q, n) * len(s.weight)
        place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        shared = np.add.reduceat(np.where(keys[place] == code, s.weight[t], 0), begin)
        good = shared >= least
        yield p[i[good]], q[good], cos[i[good], q[good]]


def blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, most_items: int, most_terms: int) -> Iterator[Space]:
    """The benchmark's items that have a word, in spaces of so many items and terms at most, or one item."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    parts = max(1, -(-items.count() // most_items))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()  # about ``most_items``
        todo = [sorted(((r[0], r[1].encode()) for r in rows if words_of(r[1].encode())), key=lambda r: (str(r[0]), r[1]))]
        while todo:
            some = todo.pop()
            space = Space(some, window) if len(some) <= max(1, most_items) else None
            if len(some) > 1 and (space is None or len(space.term) > most_terms):
                todo += [some[len(some) // 2 :], some[: len(some) // 2]]
            elif some:
                yield space


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rank: int = RANK, cosine: float = COSINE, common: float = COMMON, alone: float = ALONE, with_answer: float = WITH_ANSWER, answer: float = ANSWER, most_items: int = MAX_ITEMS, most_terms: int = MAX_TERMS) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share``: one row for each document and item that it restates.

    The shares are those of the passage that holds most of the item. Null texts,
    and items without a word, match nothing. Repeated documents are reported
    once, as are equal ids; an empty benchmark or no documents give no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    id_kind, item_kind = df.schema["id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}, cosine double, lcs_share double, answer_share double"
    hits = None
    for space in blocks(benchmark, item_id, item_text, window, most_items, most_terms):
        found = stored(tokens(df, space), "terms")
        fit(found, space, rank, common)
        some = _search(found, space, schema, item_type, cosine, window, alone, with_answer, answer)
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_id})
    hits = hits.groupBy("id", "item").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b"))
    return hits.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "b.cosine", "b.lcs_share", "b.answer_share")


def _search(found: DataFrame, space: Space, schema: str, item_type: pa.DataType, cosine: float, window: int, alone: float, with_answer: float, answer: float) -> DataFrame:
    """``schema``: the leaks of one block's items, maybe more than one row for a document and item."""
    share = found.sparkSession.sparkContext.broadcast(space)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = share.value
        for b in batches:
            x = Batch(b, s)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for ps, qs, cos in candidates(x, s, cosine):
                for p, q, c in zip(ps.tolist(), qs.tolist(), cos.tolist(), strict=True):
                    d, q = int(x.owner[p]), s.of[q]
                    item = s.items[q]
                    middle, reach = (int(x.nth[p]) + 1) * s.half, max(window, len(item) + s.half)
                    lo, hi = x.begin[d], x.begin[d + 1]
                    places = x.all_places[lo:hi]
                    region = x.all_terms[lo + np.searchsorted(places, middle - reach) : lo + np.searchsorted(places, middle + reach)].tolist()
                    ok, lcs, held = verdict(item, region, alone, with_answer, answer)
                    if ok:
                        best[d, q] = max(best.get((d, q), (0.0,)), (lcs, held, c))
            if best:
                rows = pa.array([d for d, _ in best])
                item_ids = pa.array([s.ids[q] for _, q in best], item_type)
                yield pa.RecordBatch.from_arrays([x.ids.take(rows), item_ids, *(pa.array([v[k] for v in best.values()], pa.float64()) for k in (2, 0, 1))], names=["id", "item", "cosine", "lcs_share", "answer_share"])

    return found.mapInArrow(search, schema)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``documents`` without the rows that restate a benchmark item; other texts of their ids stay."""
    found = stored(leaks(by_text(documents, id_col, text_col), benchmark, "__row", text_col, **settings).select("__row").distinct(), "leaks")
    return among(documents, found, id_col, text_col, "left_anti")
