"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
to those of each language by the Jensen-Shannon distance (base 2, so 0 to 1).
The language references are counted over every document that states the
language and passes the base rules. A document is rejected if it is too far
from all references. The common words of de, en, es and fr are fixed; those of any
other language that ``MIN_DOCUMENTS`` documents state are its most frequent words,
counted over these. The method abstains where a document states a language of which
there is no reference. Both distances count from a least number of words on. A sample
of n words differs from the language that it was drawn from by a distance in proportion
to 1/sqrt(n), so the limit of the common words grows as texts get shorter.

One pass over the texts makes a small feature table; references and verdicts
come from that. References are a row for each language that many documents state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.llm._shared import as_bytes, slices, small_batches
from loam.storage import stored

#: Frequent function words of each language; which words are counted is fixed, how often they occur is learned.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein als",
    "en": "the of and to in is that for it was on with as be by are this at from or an",
    "es": "de la que el en y a los se del las un por con una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur",
}
WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
SYMBOLS = b"#*$%&|<>"
#: Character classes, as byte values; the last class has every code point from U+0080 on.
CLASSES = [
    ("lower", bytes(range(97, 123))),
    ("upper", bytes(range(65, 91))),
    ("digit", bytes(range(48, 58))),
    ("space", b" \t\n\x0b\x0c\r"),
    ("stop", b".,;:!?'\"()-"),
    ("symbol", SYMBOLS),
]
N_CLASSES = len(CLASSES) + 2  # the rest of ASCII, and beyond ASCII
#: Distances beyond which a document differs from a language, and the words from which that is judged.
MAX_CHARS_JS, MAX_WORDS_JS, MIN_WORDS, MIN_WORDS_COMMON = 0.30, 0.26, 50, 50
#: Over the root of the number of words, the distance of common words that chance alone may make.
WORDS_NOISE = 2.54
#: Documents from which another language is learned, and its words that count as common.
MIN_DOCUMENTS, COMMON_WORDS = 50, 20
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hist array<int>"


def repeated(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    held = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(held)] |= held
    return int(covered.sum())


def _classes() -> np.ndarray:
    of = np.full(256, len(CLASSES), np.int64)
    for k, (_, members) in enumerate(CLASSES):
        of[list(members)] = k
    of[0xC0:] = N_CLASSES - 1
    return of


def measure(text: bytes, index: dict[bytes, int], class_of: np.ndarray) -> tuple:
    """The base counts of one text, and its histogram: character classes, common words, other words."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    points = int(by_byte[:0x80].sum() + by_byte[0xC0:].sum())
    spaces = int(by_byte[9:14].sum() + by_byte[32])
    counted = by_byte.copy()
    counted[0x80:0xC0] = 0  # continuation bytes
    classes = np.bincount(class_of, weights=counted, minlength=N_CLASSES).astype(np.int64)
    common = np.bincount([index[w] for w in text.lower().split() if w in index], minlength=len(index))
    hist = [*classes.tolist(), *common.tolist(), len(words) - int(common.sum())]
    return len(words), points - spaces, int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated(words), hist


def learned_words(documents: DataFrame, text_col: str, lang_col: str, least: int = MIN_DOCUMENTS, most: int = COMMON_WORDS) -> dict[str, list[str]]:
    """The most frequent words of each language but those of ``COMMON`` that at least ``least`` documents state."""
    df = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON))
    langs = [r[0] for r in df.groupBy("lang").count().where(F.col("count") >= least).select("lang").collect()]
    if not langs:
        return {}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.where(F.col("lang").isin(*langs)).select("lang", F.explode(F.split(lower, r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")  # each task hands on ``most`` rows of a language
    top = words.groupBy("lang", "word").count().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found: dict[str, list[str]] = {lang: [] for lang in langs}
    for lang, word in top.select("lang", "word").collect():
        found[lang].append(word)
    return found


def _measured(keep: pa.Schema, words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, class_of = {w.encode(): i for i, w in enumerate(words)}, _classes()
        for whole in batches:
            for b in slices(whole, "text"):
                got = [measure(t or b"", index, class_of) for t in as_bytes(b.column("text"))]
                cols = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)] + [pa.array([g[5] for g in got], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *cols], schema=keep)

    return run


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: list[str] = WORDS) -> DataFrame:
    """``id, lang``, the base counts and ``hist`` of each row, by ``words``, sorted; a null text counts as empty."""
    small_batches(documents.sparkSession)
    df = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["id"].dataType
    names = [x.split()[0] for x in FEATURES.split(", ")]
    keep = pa.schema([("id", to_arrow_type(kind)), ("lang", pa.string()), *((n, pa.int64()) for n in names[:5]), ("hist", pa.list_(pa.int32()))])
    return df.mapInArrow(_measured(keep, words), f"id {kind.simpleString()}, lang string, {FEATURES}")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def references(feats: DataFrame, langs: list[str], width: int) -> dict[str, np.ndarray]:
    """Each language's histogram, of so many bins, summed over all documents that state it and pass the base rules."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            hist = np.asarray(b.column("hist").flatten()).reshape(-1, width).astype(np.int64)
            langs = np.array(b.column("lang").to_pylist())
            for k in set(langs.tolist()):
                total[k] = total.get(k, 0) + hist[langs == k].sum(0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "hist": pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))})

    sums = feats.where(F.col("lang").isin(*langs) & ~base_failed()).select("lang", "hist").mapInArrow(add, "lang string, hist array<long>")
    rows = sums.select("lang", F.posexplode("hist")).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect()  # languages times bins
    found: dict[str, np.ndarray] = {}
    for lang, pos, n in rows:
        found.setdefault(lang, np.zeros(width))[pos] = n
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts ``p`` to the counts ``q``; 1 if either is empty."""
    total, other = p.sum(1, keepdims=True), q.sum()
    p, q = p / np.maximum(total, 1), (q / max(other, 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((total[:, 0] > 0) & (other > 0), np.sqrt(np.maximum(a + b, 0) / 2), 1.0)


def far_from_all(hist: np.ndarray, n_words: np.ndarray, refs: dict[str, np.ndarray], limits: tuple[float, float, int, int, float]) -> np.ndarray:
    """Whether each row is beyond a distance that its length lets count, for every language."""
    max_chars, max_words, min_words, min_common, noise = limits
    most = np.maximum(max_words, noise / np.sqrt(np.maximum(n_words, 1)))
    far = np.full(len(hist), bool(refs))
    for q in refs.values():
        chars = (n_words >= min_words) & (js_distance(hist[:, :N_CLASSES], q[:N_CLASSES]) > max_chars)
        words = (n_words >= min_common) & (js_distance(hist[:, N_CLASSES:], q[N_CLASSES:]) > most)
        far &= chars | words
    return far


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars_js: float = MAX_CHARS_JS, max_words_js: float = MAX_WORDS_JS, min_words: int = MIN_WORDS, min_words_common: int = MIN_WORDS_COMMON, min_documents: int = MIN_DOCUMENTS, words_noise: float = WORDS_NOISE) -> DataFrame:
    """One row for each row of ``documents``: id, base counts, ``base_failed``, ``kept``.

    Null texts and empty texts have no words, so they fail the base rules. A
    document of null ``lang`` adds to no reference but is held against all. The base
    rules alone decide on one that states a language without a reference (too few
    documents state it, and it isn't one of ``COMMON``), and on all if there is no
    reference at all. Repeated rows are
    judged one by one. Other columns are ignored, whatever their names.
    """
    other = learned_words(documents, text_col, lang_col, min_documents)
    words = sorted({*WORDS, *(w for ws in other.values() for w in ws)})
    width = N_CLASSES + len(words) + 1
    feats = stored(features(documents, id_col, text_col, lang_col, words), "quality")
    refs = references(feats, [*COMMON, *other], width)
    kind = feats.schema["id"].dataType.simpleString()

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = np.asarray(b.column("hist").flatten()).reshape(-1, width).astype(float)
            far = far_from_all(hist, np.asarray(b.column("n_words")), refs, (max_chars_js, max_words_js, min_words, min_words_common, words_noise))
            abstains = np.array([x is not None and x not in refs for x in b.column("lang").to_pylist()], bool)
            kept = ~np.asarray(b.column("base_failed")) & (abstains | ~far)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(7)), pa.array(kept)], names=[*b.schema.names[:7], "kept"])

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    out = feats.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "hist", "lang")
    out = out.mapInArrow(verdicts, f"id {kind}, {counts}, base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)

