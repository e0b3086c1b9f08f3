"""Language identification by a blended-spectrum string kernel.

Two texts' kernel value is the number of n-grams, n from 1 to 3, present in both,
normalised by both texts' own numbers. Landmarks from a bounded labelled sample
give Nyström features; kernel ridge regression, one against the rest, is solved
on those. Presence is binary, so a text's kernel values to all landmarks and the
regression on them are one matrix product over the landmarks' n-grams, taken for
a batch of texts at once. Scoring is one pass over whole texts without a shuffle.

Every language that a row states is learned, however many there are. The sample has
``TOTAL_ROWS`` rows at most, or one of each language; ``ROWS_A_LANGUAGE`` bounds each
language's share. Texts become n-gram sets in the tasks that read them, so the driver
holds sets of at most ``SIZE`` codes. The more languages, the fewer landmarks each
(``TOTAL_LANDMARKS``), and the fewer of the landmarks' n-grams, the most frequent,
bear weights (``WEIGHTS`` numbers at most, which bind only beyond some 100 languages).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm._shared import slices, small_batches
from loam.storage import stored

#: Labelled rows taken for each language and in all, landmarks for each and in all, numbers in the model, and the ridge.
ROWS_A_LANGUAGE, TOTAL_ROWS, LANDMARKS, TOTAL_LANDMARKS, WEIGHTS, RIDGE = 300, 20_000, 40, 3000, 1 << 26, 1e-2
#: Languages up to which their counts are broadcast.
MANY = 50_000
ORDERS = (1, 2, 3)
UNKNOWN = "und"
BATCH = 256
LETTER = re.compile(r"[^\W\d_]")
#: Bytes to 64 symbols: letters apart, bytes beyond ASCII folded to 37, all else a space.
SYMBOL = np.array([ord(chr(b).lower()) - 96 if chr(b).isascii() and chr(b).isalpha() else 27 + b % 37 if b > 127 else 0 for b in range(256)], np.int64)
OFFSET = {n: sum(64**k for k in range(1, n)) for n in ORDERS}
SIZE = sum(64**n for n in ORDERS)


def grams(text: bytes, last: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text, as codes. ``last`` is scratch space of ``SIZE``."""
    s = SYMBOL[np.frombuffer(text, np.uint8)]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) else s  # runs of spaces are one
    out = []
    for n in ORDERS:
        if len(s) < n:
            continue
        code = np.full(len(s) - n + 1, OFFSET[n])
        for k in range(n):
            code += s[k : len(s) - n + 1 + k] * 64 ** (n - 1 - k)
        at = np.arange(len(code))
        last[code] = at
        out.append(code[last[code] == at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each n-gram code in ``weights``, or -1
    weights: np.ndarray  # n-grams times languages
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set of n-grams: the regressions' values."""
        present = np.zeros((len(sets), len(self.weights)), np.float32)
        norm = np.ones((len(sets), 1), np.float32)
        for i, g in enumerate(sets):
            c = self.column[g]
            present[i, c[c >= 0]] = 1
            norm[i] = np.sqrt(max(len(g), 1))
        return present @ self.weights / norm + self.bias


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nyström features of texts' n-gram sets; None without a text."""
    if not sets:
        return None
    languages = sorted(set(labels))
    each = max(1, min(landmarks, TOTAL_LANDMARKS // len(languages)))
    first: dict[str, list[int]] = {y: [] for y in languages}
    for i, y in enumerate(labels):
        if len(first[y]) < each:
            first[y].append(i)
    chosen = [i for y in languages for i in first[y]]
    codes, times = np.unique(np.concatenate([sets[i] for i in chosen]), return_counts=True)
    most = WEIGHTS // max(len(languages), len(chosen))
    vocabulary = np.sort(codes[np.lexsort((codes, -times))[:most]])
    column = np.full(SIZE, -1, np.int32)
    column[vocabulary] = np.arange(len(vocabulary))

    def unit(which: list[int]) -> np.ndarray:
        m = np.zeros((len(which), len(vocabulary)), np.float32)
        for r, i in enumerate(which):
            c = column[sets[i]]
            m[r, c[c >= 0]] = 1 / np.sqrt(max(len(sets[i]), 1))
        return m

    marks = unit(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    held = values > 1e-8 * values.max()
    root = vectors[:, held] / np.sqrt(values[held])
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    bias = target.mean(0)
    gram, right = np.zeros((held.sum(),) * 2), np.zeros((held.sum(), len(languages)))
    for k in range(0, len(sets), BATCH):
        phi = (unit(list(range(k, min(k + BATCH, len(sets))))) @ marks.T).astype(float) @ root
        gram += phi.T @ phi
        right += phi.T @ (target[k : k + BATCH] - bias)
    solved = np.linalg.solve(gram + ridge * len(sets) / len(chosen) * np.eye(len(gram)), right)
    return Model(languages, column, (marks.T @ (root @ solved)).astype(np.float32), bias.astype(np.float32))


def held_out(id_col: str) -> F.Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chosen(documents: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, total: int) -> DataFrame:
    """``id, text, lang``: labelled rows of at most ``rows`` ids of each language, and ``total`` in all or one a language; one row for an id, the least text.

    Ids are taken in the order of a hash. Only about twice as many as are needed, those of least hash, are sorted.
    """
    df = documents.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = stored(df.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("ids")), "languages")
    languages = named.count()
    each = max(1, min(rows, total // max(1, languages)))
    share = (F.lit(2.0 * each + 50) / F.greatest("ids", F.lit(1))).alias("share")
    hashed = df.select("id", "lang", F.xxhash64(F.col("id").cast("string")).alias("h")).join(F.broadcast(named.select("lang", share)) if languages <= MANY else named.select("lang", share), "lang")
    few = hashed.where(F.abs(F.col("h").cast("double")) <= F.col("share") * float(2**63)).groupBy("lang", "id").agg(F.min("h").alias("h"))
    picked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.abs(F.col("h").cast("double")), "h", "id"))).where(F.col("rank") <= each)
    picked = picked.select("id", "lang")
    return df.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")  # at most ``total`` rows are broadcast, or one a language


def sample(documents: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, total: int) -> list:
    """The rows of ``chosen``, by id."""
    return sorted(chosen(documents, id_col, text_col, lang_col, rows, total).collect(), key=lambda r: (str(r[0]), r[2], r[1]))


def learned(documents: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, total: int, landmarks: int) -> Model | None:
    """The model of the chosen rows whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(SIZE, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [grams(t.encode(), last) if t and LETTER.search(t) else None for t in b.column("text").to_pylist()]
                keep = [i for i, g in enumerate(sets) if g is not None]
                yield pa.RecordBatch.from_arrays([b.column(n).take(pa.array(keep, pa.int32())) for n in ("id", "lang")] + [pa.array([np.sort(sets[i]).astype("<i4").tobytes() for i in keep], pa.binary())], names=["id", "lang", "codes"])

    got = chosen(documents, id_col, text_col, lang_col, rows, total).select(F.col("id").cast("string").alias("id"), "lang", "text").mapInArrow(run, "id string, lang string, codes binary").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([np.frombuffer(bytes(r[2]), "<i4").astype(np.int64) for r in got], [r[1] for r in got], landmarks)


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_A_LANGUAGE, total: int = TOTAL_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """One row for each row of ``documents``: id, ``held_out``, ``lang_pred``, ``score`` from 0 to 1.

    Learns only from texts and non-null languages of rows that are not held out;
    a prediction sees the text alone. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if there is nothing to learn from.
    Equal values go to the language first by name. Repeated rows are predicted
    each; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    model = learned(documents, id_col, text_col, lang_col, rows, total, landmarks)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most SIZE codes and WEIGHTS numbers
    df = documents.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, last = shared.value, np.zeros(SIZE, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if m and t and LETTER.search(t)]
                for k in range(0, len(known), BATCH):
                    part = known[k : k + BATCH]
                    f = m.scores([grams(texts[i].encode(), last) for i in part]).astype(float)
                    p = np.exp(4 * (f - f.max(1, keepdims=True)))
                    for i, j, s in zip(part, p.argmax(1).tolist(), (1 / p.sum(1)).tolist(), strict=True):
                        name[i], score[i] = m.languages[j], s
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(name), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    out = df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
