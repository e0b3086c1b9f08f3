"""Deduplication operators, against brute force."""

import hashlib
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash

from loam.llm import line_alignment, simhash_tiles, suffix_dedup
from loam.llm._shared import components


def docs(spark, texts, ids=None):
    df = spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.selectExpr("*", "1 as fp", "'x' as id", "2 as print", "3 as spans", "4 as n_lines", "5 as root")


def brute_windows(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = np.frombuffer(b, np.uint8)[gone == 0].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(0, 2000), (1, 2000), (2, 4), (3, 2), (4, 1), (5, 1)])
def test_suffix_dedup_against_brute_force(spark, seed, hot):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é"
    shared = ["".join(r.choice(letters) for _ in range(r.randint(20, 200))) for _ in range(6)]
    texts = [None, "", "a" * 300, "a" * 90, "ab" * 100]
    texts += ["".join(r.choice(shared)[r.randint(0, 30) :] if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 6))) for _ in range(50)]
    texts += texts[5:9]
    want = brute_windows(texts, 40)
    got = {x.doc_id: x for x in suffix_dedup.dedup(docs(spark, texts), length=40, anchor=20, hot=hot).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got.values())


def test_suffix_dedup_repeated_rows_null_ids_and_chunks(spark, monkeypatch):
    text = "".join(random.Random(5).choice("abcdefghij") for _ in range(3000))
    df = docs(spark, [text, text, text[:100]], [1, 1, None])
    assert [(x.n_removed, x.n_spans) for x in suffix_dedup.dedup(df, length=40, anchor=20).orderBy("n_bytes").collect()] == [(100, 1), (3000, 1), (3000, 1)]
    assert suffix_dedup.dedup(docs(spark, []), length=40, anchor=20).count() == 0
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    whole = [a for part in suffix_dedup.anchors_of(text.encode(), 40, 20) for a in zip(*(x.tolist() for x in part), strict=True)]
    assert sum(a[3] for a in whole) == len(text) - 39 and all(0 <= a[4] + a[3] - 1 for a in whole)


def test_suffix_dedup_retries_with_another_base_when_hashes_collide(spark):
    r = random.Random(11)
    a, b = "".join(r.choice("abcd") for _ in range(120)), "xyz" * 15
    mixed = a[:60] + "zy" + a[60:]
    a = a[:60] + "yz" + a[60:]  # a sum of bytes can't tell strings with both from those of mixed
    texts = [a, mixed, b + a[:60] + b, b + mixed[:60], a + b, "q" * 100, mixed + "!"]
    for hot in (1, 256):
        got = {x.doc_id: x for x in suffix_dedup.dedup(docs(spark, texts), length=40, anchor=20, hot=hot, bases=(1, suffix_dedup.BASE)).collect()}
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute_windows(texts, 40)
    with pytest.raises(RuntimeError):
        suffix_dedup.dedup(docs(spark, texts), length=40, anchor=20, bases=(1,))


def test_suffix_dedup_many_equal_rows_of_one_id(spark):
    text = "".join(random.Random(6).choice("abcdefghij ") for _ in range(2000))
    texts = [text] * 400 + [text[:900], "z" + text[500:1500]]
    got = suffix_dedup.dedup(docs(spark, texts, [1] * 400 + [2, 3]), length=40, anchor=20).collect()
    assert sorted((x.doc_id, x.n_removed, x.n_spans) for x in got) == [(1, 2000, 1)] * 400 + [(2, 900, 1), (3, 1000, 1)]


def test_suffix_dedup_very_many_copies_are_read_in_lots(spark, monkeypatch):
    r = random.Random(12)
    text, other = ("".join(r.choice("abcdefghij ") for _ in range(300)) for _ in range(2))
    texts = [text] * 1500 + [other, "z" + other, text[:200] + "!", text[100:] + other[:100]]
    parts = {}
    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: parts.setdefault(name, stored(df, name)))
    got = {x.doc_id: x for x in suffix_dedup.dedup(docs(spark, texts), length=40, anchor=20).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute_windows(texts, 40)
    asked = parts["stretches"].where("check = 2")
    place = [c for c in ("r_id", "r_print", "at", "lot") if c in asked.columns]
    most = max(x["count"] for x in asked.selectExpr("*", "to - from as size").groupBy(*place, "size").count().collect())
    assert asked.count() >= 1499 and most <= 150  # all in one place before


def test_suffix_dedup_very_long_and_periodic_texts(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh") for _ in range(300_000))
    texts = [long, "Retionly " * 20_000, "x" + "Retionly " * 3000, "\U0001f600" * 5000, long[100_000:200_000]]
    got = {x.doc_id: x for x in suffix_dedup.dedup(docs(spark, texts), length=40, anchor=20, keep_bytes=False).collect()}
    assert [got[i].n_removed for i in range(5)] == [100_000, 180_000, 27_000, 20_000, 100_000]
    assert [got[i].n_spans for i in range(5)] == [1] * 5


def test_stretches_join_what_is_in_step():
    own, other = (1, 10), (2, 20)
    entries = [(0, 5, other, 7), (5, 3, other, 12), (8, 9, own, 8), (17, 9, own, 8), (26, 9, own, 8), (40, 2, other, 12)]
    assert suffix_dedup.stretches(own, entries) == [(0, 8, 7, other), (8, 17, 8, None), (17, 35, 8, own), (40, 42, 5, own)]


def test_suffix_order_sorts():
    data = np.frombuffer(b"banana bandana banana ban", np.uint8)
    h = suffix_dedup.Hashes(data)
    h.data = data
    at = np.arange(len(data) - 5)
    order = suffix_dedup.suffix_order(h, at, np.zeros(len(at), int), 6)
    got = [data[i : i + 6].tobytes() for i in at[order]]
    assert got == sorted(got)


def test_windows_that_all_differ():
    assert not any(f.any() for f in suffix_dedup.repeated_windows([b"abcdef", b"ghijkl"], np.zeros(2, int), np.array([1, 2]), 4))


def test_hash_collision_is_verified(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Hashes.__init__, "__defaults__", (1,))  # sums alone: all orders of the same bytes collide
    extents = [b"abcdxy", b"badcxy", b"abcdzz"]
    found = suffix_dedup.repeated_windows(extents, np.zeros(3, int), np.zeros(3, int), 4)
    assert [f[0] for f in found] == [True, False, True]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(values, near):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash_against_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(r.choice(["alpha", "beta", "Gamma", "delta", "é", "x"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts = [None, "", "one", "one two", *base, *(b + " end" for b in base[:20]), base[0], base[0].upper()]
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {x.doc_id: x for x in simhash_tiles.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [4096, 7])
def test_simhash_links_in_large_groups(spark, block):
    r = np.random.default_rng(2)
    centre = int(r.integers(0, 2**62))
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 60, 7) for b in range(a)} | {int(x) for x in r.integers(0, 2**62, 200)}
    values = sorted(values)
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash_tiles.links(df, 2, block)
    assert all((x.a ^ x.b).bit_count() <= 2 for x in links.collect())
    roots = {x.node: x.root for x in components(links).collect()}
    assert [roots.get(v, v) for v in values] == [values[i] for i in want]


def test_keep_one(spark):
    kept = simhash_tiles.keep_one(docs(spark, ["a b c d", "a b c d", None, "", "q w e r t"], [5, 3, 9, None, 1]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]
    assert simhash_tiles.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (50, 51), (51, 50)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{k: 100 for k in range(100, 140)}, 50: 50, 51: 50}


def line(k):
    return f"line number {k} has seven words here"


def test_line_alignment(spark):
    shared, notice = [line(k) for k in range(6)], "a notice that stands in very many documents"
    texts = {
        0: "\n".join([line(90), *shared, line(91)]),
        1: "\n".join([line(80), "short", *shared[:3], line(81), *shared[3:], line(82)]),
        2: "\n".join([line(70), line(71)]),
        3: "\n".join([line(90), *shared, line(91)]),
        4: None,
        5: "",
        6: line(60) + "\n\n" + line(61) + "\n" + shared[0] + "\n" + shared[0],
    }
    texts |= {k: f"{line(1000 + k)}\n{notice}\n{line(2000 + k)}" for k in range(10, 50)}
    df = docs(spark, list(texts.values()), list(texts))
    got = {r.doc_id: r for r in line_alignment.align(df, rare=5).collect()}
    assert got.keys() == texts.keys()
    assert got[0].n_removed == 0 and got[0].text == texts[0]
    assert got[1].text == "\n".join([line(80), "short", line(81), line(82)]) and got[1].n_removed == 6
    assert got[3].text == "" and got[3].n_removed == 8
    assert (got[4].text, got[4].n_lines, got[5].text, got[5].n_lines) == (None, 0, "", 1)
    assert all(got[k].text == texts[k] for k in range(10, 50))  # a common line alone is no overlap
    assert got[6].text.startswith(line(60) + "\n\n" + line(61))
    assert line_alignment.align(docs(spark, [])).count() == 0


def test_near_copies_in_a_large_group(spark):
    body = [line(k) for k in range(8)]
    texts = ["\n".join([*body[:4], line(500 + k), *body[4:]]) for k in range(60)]
    got = {r.doc_id: r for r in line_alignment.align(docs(spark, texts), rare=5).collect()}
    assert got[0].n_removed == 0 and all(got[k].text == line(500 + k) for k in range(1, 60))


def test_repeated_rows_are_treated_alike(spark):
    text = "\n".join(line(k) for k in range(4))
    rows = line_alignment.align(docs(spark, [text, text, text], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 4)]


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_a_common_subsequence(seed):
    r = random.Random(seed)
    a, b = ([r.randint(0, 12) for _ in range(r.randint(0, 25))] for _ in range(2))
    found = line_alignment.patience(a, b)
    assert all(a[i] == b[j] != 0 for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
    once = list(range(1, 20))
    moved = [x for x in once if r.random() < 0.7]
    assert len(line_alignment.patience(once, moved)) == sum(m.size for m in SequenceMatcher(None, once, moved).get_matching_blocks())


def brute_alignment(texts, least=5):
    """Each text against all texts before it."""
    def parsed(t):
        bare = [x.strip(" \t\x0b\f\r") for x in t.split("\n")]
        return [xxhash.xxh64_intdigest(x) for x in bare], [min(len(x.split()), 2 * least) for x in bare]

    out, seen = [], []
    for t in texts:
        h, w = parsed(t)
        gone = set()
        for a, wa in seen:
            gone |= set(line_alignment.aligned(a, h, wa, w, least))
        seen.append((h, w))
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment_against_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = [line(k) for k in range(25)] + ["short", "", "two words", "a b c d"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += r.sample(texts, 15) + ["\n".join([line(900), t]) for t in r.sample(texts, 10)]
    got = {x.doc_id: x.text for x in line_alignment.align(docs(spark, texts), rare=100).collect()}
    assert [got[k] for k in range(len(texts))] == brute_alignment(texts)


def test_copies_are_aligned_with_their_like(spark):
    x, y = line(1), line(2)
    texts = [f"{x}\nshort\n{y}", f"{y}\nshort\n{x}", f"{y}\nshort\n{x}"]
    got = {r.doc_id: r.text for r in line_alignment.align(docs(spark, texts)).collect()}
    assert got[2] == "" and [got[k] for k in range(3)] == brute_alignment(texts)


def test_very_long_text_and_clashing_names(spark):
    body = [line(k) for k in range(20_000)]
    texts = ["\n".join(body), "\n".join(body[:9000] + ["own line with some words in it"] + body[9000:]), "word " * 200_000, None, "\n" * 50_000]
    df = docs(spark, texts).selectExpr("*", "1 as o", "2 as h", "'w' as w", "3 as later", "4 as first", "6 as n_removed")
    got = {r.doc_id: r for r in line_alignment.align(df).collect()}
    assert got[0].n_removed == 0 and got[1].text == "own line with some words in it" and got[2].text == texts[2] and got[4].n_removed == 0
    assert got[1].h == 2 and got[1].later == 3


def test_short_and_blank_lines_go_with_their_block(spark):
    page = "\n".join(["Title", "", line(1), "", "by me", "", line(2), "end", ""])
    menu = "\n".join(["Home", "About us", "", "Contact", "Imprint", "Top"])
    texts = {0: page, 1: page, 2: "Menu\n" + page + "\nBye", 3: menu, 4: menu, 5: "Hi there", 6: "Hi there", 7: "Title\n" + line(9)}
    got = {r.doc_id: r for r in line_alignment.align(docs(spark, list(texts.values()), list(texts))).collect()}
    assert [got[k].text for k in range(8)] == [page, "", "Menu\nBye", menu, "", "Hi there", "", texts[7]]
    assert got[1].n_removed == got[1].n_lines == 9


def test_common_passages_are_found_whatever_their_count(spark):
    para = [line(1), "", line(2)]
    long = " ".join(f"word{k}" for k in range(60))
    texts = ["\n".join([f"own {k} of the first kind", *para, f"own {k} of the first kind again"]) for k in range(30)]
    texts += [f"own {k} of the second kind\n{long}\nown {k} of the second kind again" for k in range(30)]
    texts += [line(3)] * 30
    got = {r.doc_id: r.text.split("\n") for r in line_alignment.align(docs(spark, texts), rare=5).collect()}
    assert all(line(1) not in got[k] and line(2) not in got[k] and len(got[k]) == 2 for k in range(1, 30))
    assert all(long not in got[k] and len(got[k]) == 2 for k in range(31, 60))
    assert got[60] == [line(3)] and all(got[k] == [""] for k in range(61, 90))
