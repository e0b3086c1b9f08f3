"""Byte-level BPE encoding and decoding by DuckDB recursive queries per partition.

Each Arrow batch is split by the tokenizer's pattern. Its distinct words become rows,
lists of tokens and of the ranks of each two neighbours; a recursive DuckDB query
contracts each word's leftmost pair of minimum rank until none is left. A pass joins
a word to the merge table for the two new pairs alone. A join to the vocabulary
decodes the tokens that are left. Words recur, so a worker keeps the last results in
a cache of fixed size; that changes no result.

The recursion takes a pass over a word for each of its merges, so the work on a word
grows with its length squared. Words longer than ``LONG_WORD`` bytes (Chinese without
spaces, a blob) are cut in pieces, which the same query encodes. Tokens are the
encoding of a word if each two neighbours are the encoding of their joined bytes:
the first contraction across a boundary of two tokens in the whole word would be the
first one in these two alone as well, as what is leftmost of least rank in the whole
is so in a part. So only the tokens at the cuts are tried, again by the query; where
two fail, some tokens on both sides are encoded anew as one piece, twice as many in
each round. Such pieces can be long if the word is periodic; a second query contracts
all pairs of the least rank in a pass that would come one after the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._shared import KEPT, slices, small_batches, trim

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
LONG_WORD, WORDS_AT_ONCE, CACHED = 256, 32_000, 180_000
#: Sum of the squared lengths of words of one query, which keeps every pass: some four bytes each.
STATE = 1 << 24

#: The rank of two tokens that make none.
NONE = 2147483647
CONTRACT = """
with recursive step(word, tokens, ranks, least) as (
    select word, tokens, ranks, list_min(ranks) from words
    union all
    select word, new_tokens, new_ranks, list_min(new_ranks)
    from (
        select word, tokens[1 : spot - 1] || [least] || tokens[spot + 2 :] as new_tokens,
               ranks[1 : spot - 2] || [coalesce(a.merged, 2147483647), coalesce(b.merged, 2147483647)] || ranks[spot + 2 :] as new_ranks
        from (select *, list_position(ranks, least) as spot from step where least < 2147483647) s
        left join merges a on a.pair = s.tokens[spot - 1]::bigint * 65536 + s.least
        left join merges b on b.pair = s.least::bigint * 65536 + s.tokens[spot + 2]
    )
)
select word, pos, name, piece
from (select word, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from step where least = 2147483647) join vocabulary using (token)
"""
#: For few and long words, rows of which are tokens: in a pass, the pairs of the word's least rank from the left, each second one where
#: they overlap, up to one whose token makes a pair of lesser rank with a neighbour, which is to come next.
CONTRACT_ALL = """
with recursive step(n, word, pos, token) as (
    select 0, word, pos, token from seed
    union all
    (
        with pairs as materialized (
            select s.word, s.pos, s.token, m.merged, lag(s.token) over w as left_token, lead(s.token, 2) over w as right_token, row_number() over w as nth
            from (select *, lead(token) over (partition by word order by pos) as following from step) s left join merges m on m.pair = s.token::bigint * 65536 + s.following
            window w as (partition by s.word order by s.pos)
        ),
        least as (select word, min(merged) as merged from pairs group by word having min(merged) is not null),
        found as (
            select p.*, nth - row_number() over (partition by p.word order by pos) as run
            from pairs p join least l on p.word = l.word and p.merged = l.merged
        ),
        chosen as (
            select * from (select *, row_number() over (partition by word, run order by pos) as place from found) where place % 2 = 1
        ),
        limits as (
            select c.word, min(c.pos) filter (a.merged < c.merged or b.merged < c.merged) as stop
            from chosen c
            left join merges a on a.pair = (case when place > 1 then c.merged else left_token end)::bigint * 65536 + c.merged
            left join merges b on b.pair = c.merged::bigint * 65536 + right_token
            group by c.word
        ),
        done as (select c.word, c.nth, c.merged from chosen c join limits l using (word) where stop is null or pos <= stop)
        select n.n, p.word, p.pos, coalesce(d.merged, p.token)
        from pairs p join least l on p.word = l.word cross join (select max(n) + 1 as n from step) n
        left join done d on d.word = p.word and d.nth = p.nth left join done g on g.word = p.word and g.nth = p.nth - 1
        where g.nth is null
    )
)
select s.word, s.pos, name, piece
from step s join (select word, max(n) as n from step group by word) l using (word, n) join vocabulary using (token)
"""
DECODE = """
select item, string_agg(hex, '' order by pos) as hex
from (select item, unnest(ids) as token, generate_subscripts(ids, 1) as pos from encoded) join vocabulary using (token)
group by item
"""


class Codec:
    """Encodes and decodes by one rank file; holds a DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, path: str, pattern: str, long_word: int = LONG_WORD):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.long_word = long_word
        self.ids_of: dict[str, str] = {}
        self.bytes_for: dict[str, bytes] = {}
        self.long: list[str] = []  # words that aren't kept
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        pair, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    merged.append(rank)
        self.fill("merges", {"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())})
        pieces = list(self.bytes_of.values())
        self.fill("vocabulary", {"token": pa.array(list(self.bytes_of), pa.int32()), "name": pa.array(map(str, self.bytes_of)), "piece": pa.array(pieces, pa.binary()), "hex": pa.array([b.hex() for b in pieces])})
        self.byte_tokens = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pairs = np.array([self.ranks.get(bytes([i, j]), NONE) for i in range(256) for j in range(256)], np.int32)

    def fill(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create or replace table {name} as from given")
        self.con.unregister("given")

    def seed(self, words: list[bytes]) -> None:
        """Table ``words``: each word's bytes as tokens, -1 at both ends, and the ranks of each two neighbours, which those at the ends haven't."""
        n, lengths = len(words), np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8)
        ends, of = np.concatenate([[0], np.cumsum(lengths)]), np.repeat(np.arange(n), lengths)
        place = np.arange(len(letters))
        tokens, ranks = np.full(len(letters) + 2 * n, -1, np.int32), np.full(len(letters) + n, NONE, np.int32)
        tokens[place + 2 * of + 1] = self.byte_tokens[letters]
        within = of[:-1] == of[1:]
        ranks[(place[1:] + of[1:])[within]] = self.byte_pairs[letters[:-1].astype(np.int32) * 256 + letters[1:]][within]
        lists = lambda values, extra: pa.ListArray.from_arrays(pa.array(ends + extra * np.arange(n + 1), pa.int32()), pa.array(values))
        self.fill("words", {"word": pa.array(np.arange(n, dtype=np.int32)), "tokens": lists(tokens, 2), "ranks": lists(ranks, 1)})

    def seed_rows(self, words: list[bytes]) -> None:
        """Table ``seed``: a row for each byte."""
        letters = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        self.fill("seed", {"word": pa.array(word), "pos": pa.array(np.arange(len(letters), dtype=np.int32)), "token": pa.array(self.byte_tokens[letters])})

    def by_query(self, words: list[bytes], query: str = CONTRACT) -> tuple[list[str], list[bytes]]:
        """For each word its ids joined by commas, and the bytes that they decode to, by the recursive query, which gives a row for each token."""
        if not words:
            return [], []
        (self.seed if query is CONTRACT else self.seed_rows)(words)
        done = self.con.execute(query).to_arrow_table().sort_by([("word", "ascending"), ("pos", "ascending")])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(done["word"].to_numpy(), minlength=len(words)))]), pa.int32())
        joined = lambda name, between: pc.binary_join(pa.ListArray.from_arrays(ends, done[name].combine_chunks()), between).to_pylist()
        return joined("name", ","), joined("piece", b"")

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Bounds of the words that go in one query; a word longer than ``long_word`` counts as one of that length."""
        start = held = 0
        for i, w in enumerate(words):
            size = min(len(w), self.long_word) ** 2
            if i > start and (i - start >= WORDS_AT_ONCE or held + size > STATE):
                yield start, i
                start, held = i, 0
            held += size
        if start < len(words):
            yield start, len(words)

    def tokens(self, pieces: set[bytes]) -> dict[bytes, list[int]]:
        """The ids of each piece."""
        out = {p: [self.ranks[p]] for p in pieces if p in self.ranks}
        rest = [p for p in pieces if p not in out]
        for query, some in ((CONTRACT, [p for p in rest if len(p) <= self.long_word]), (CONTRACT_ALL, [p for p in rest if len(p) > self.long_word])):
            for lo, hi in self.runs(some):
                out.update(zip(some[lo:hi], map(as_ints, self.by_query(some[lo:hi], query)[0]), strict=True))
        return out

    def by_pieces(self, words: list[bytes]) -> list[list[int]]:
        """The ids of long words, from pieces whose tokens at the cuts are tried and, where need be, encoded anew together."""
        n, bytes_of = self.long_word, self.bytes_of
        cut = [[w[i : i + n] for i in range(0, len(w), n)] for w in words]
        known = self.tokens({p for ps in cut for p in ps})
        out: list[list[int]] = []
        tried: list[list[int]] = []  # places in a word's ids of boundaries that are yet to be tried
        for ps in cut:
            out.append([t for p in ps for t in known[p]])
            tried.append(np.cumsum([len(known[p]) for p in ps])[:-1].tolist())
        reach = 1
        while any(tried):
            reach *= 2
            pairs = {(ids[at - 1], ids[at]) for ids, places in zip(out, tried, strict=True) for at in places}
            joined = self.tokens({bytes_of[a] + bytes_of[b] for a, b in pairs})
            spans: list[list[list[int]]] = []
            for ids, places in zip(out, tried, strict=True):
                found: list[list[int]] = []
                for at in places:
                    a, b = ids[at - 1], ids[at]
                    if joined[bytes_of[a] + bytes_of[b]] != [a, b]:
                        lo, hi = max(0, at - reach), min(len(ids), at + reach)
                        if found and lo <= found[-1][1]:
                            found[-1][1] = hi
                        else:
                            found.append([lo, hi])
                spans.append(found)
            anew = [[b"".join(map(bytes_of.__getitem__, ids[lo:hi])) for lo, hi in found] for ids, found in zip(out, spans, strict=True)]
            known = self.tokens({p for ps in anew for p in ps})
            for w, (ids, found, ps) in enumerate(zip(out, spans, anew, strict=True)):
                new, places, at = [], [], 0
                for (lo, hi), p in zip(found, ps, strict=True):
                    new += ids[at:lo]
                    places.append(len(new))
                    new += known[p]
                    places.append(len(new))
                    at = hi
                new += ids[at:]
                out[w], tried[w] = new, sorted({p for p in places if 0 < p < len(new)})
        return out

    def decode_many(self, encoded: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation over the vocabulary."""
        self.fill("encoded", {"item": pa.array(range(len(encoded)), pa.int32()), "ids": pa.array(encoded, pa.list_(pa.int32()))})
        out = [b""] * len(encoded)
        done = self.con.execute(DECODE).to_arrow_table()
        for item, text in zip(done["item"].to_pylist(), done["hex"].to_pylist(), strict=True):
            out[item] = bytes.fromhex(text)
        return out

    def learn(self, words: list[str]) -> None:
        """Put these distinct words' ids and decoded bytes in the cache."""
        raw = [w.encode() for w in words]
        whole = [i for i, b in enumerate(raw) if b in self.ranks]
        ids = [[self.ranks[raw[i]]] for i in whole]
        long = [i for i, b in enumerate(raw) if len(b) > self.long_word and b not in self.ranks]
        ids += self.by_pieces([raw[i] for i in long]) if long else []
        self.long += [words[i] for i in long]
        for i, n, b in zip(whole + long, ids, self.decode_many(ids), strict=True):
            self.ids_of[words[i]], self.bytes_for[words[i]] = ",".join(map(str, n)), b
        rest = [i for i, b in enumerate(raw) if len(b) <= self.long_word and b not in self.ranks]
        for lo, hi in self.runs([raw[i] for i in rest]):
            part = rest[lo:hi]
            got, pieces = self.by_query([raw[i] for i in part])
            names = [words[i] for i in part]
            self.ids_of.update(zip(names, got, strict=True))
            self.bytes_for.update(zip(names, pieces, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids joined by commas, and the bytes that they decode to."""
        split = [self.split(t) for t in texts]
        if len(self.ids_of) > CACHED:  # the words of the last texts stay a while; those that recur move on
            self.older = self.ids_of, self.bytes_for
            self.ids_of, self.bytes_for = {}, {}
        new = [w for w in set().union(*split) if w not in self.ids_of]
        if again := [w for w in new if w in self.older[0]]:
            for now, before in zip((self.ids_of, self.bytes_for), self.older, strict=True):
                now.update((w, before[w]) for w in again)
            new = [w for w in new if w not in self.older[0]]
        self.learn(new)
        ids, decoded = self.ids_of.__getitem__, self.bytes_for.__getitem__
        out = [(",".join(map(ids, words)), b"".join(map(decoded, words))) for words in split]
        for w in self.long:
            del self.ids_of[w], self.bytes_for[w]
        self.long = []
        return out


def as_ints(ids: str) -> list[int]:
    return [int(i) for i in ids.split(",")] if ids else []


_CODECS: dict[tuple[str, str], Codec] = {}
KEPT.append(_CODECS)


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(df: DataFrame, text: str, make, columns: str) -> DataFrame:
    """``id`` and what ``make`` gives for a list of texts, a list for each column."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, 2 << 20, keep=True):
                names, arrays = make(b.column(text).to_pylist())
                trim()
                yield pa.RecordBatch.from_arrays([b.column("id"), *arrays], names=["id", *names])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {columns}")


def _source(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Each row's id and ``ids``, an array of ints, as the tiktoken library encodes without special tokens.

    A null or empty text has an empty array. Repeated rows are encoded each;
    other columns are ignored. ``ranks`` is the path of a rank file that every
    worker can read; it defaults to a public one.
    """
    path = ranks or public_tokenizers.path(RANK_FILE)

    def make(texts):
        got = codec(path, pattern).encode([t or "" for t in texts])
        return ["ids"], [pa.array([as_ints(g[0]) for g in got], pa.list_(pa.int32()))]

    return _mapped(_source(documents, id_col, text_col), "text", make, "ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """Each row's id and ``decoded``, the bytes of its ids in order; null ids count as none. An unknown id is an error."""
    path = ranks or public_tokenizers.path(RANK_FILE)
    small_batches(encoded.sparkSession)
    df = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, public_tokenizers.PATTERN)
        for b in batches:
            ids = [x or [] for x in b.column("ids").to_pylist()]
            if unknown := {i for x in ids for i in x} - c.bytes_of.keys():
                raise ValueError(f"no token has the id {min(unknown)}")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c.decode_many(ids), pa.binary())], names=["id", "decoded"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text; the number of ids, and SHA-256 of the ids joined by commas and of the decoded bytes."""
    path = ranks or public_tokenizers.path(RANK_FILE)

    def make(texts):
        got = codec(path, pattern).encode([t or "" for t in texts])
        ids = [hashlib.sha256(g[0].encode()).hexdigest() for g in got]
        return ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.array([g[0].count(",") + bool(g[0]) for g in got], pa.int64()), pa.array(ids), pa.array([hashlib.sha256(g[1]).hexdigest() for g in got])]

    return _mapped(_source(documents, id_col, text_col), "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
