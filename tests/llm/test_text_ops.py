"""Operators that judge, label or encode one text at a time."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loam.llm import bpe_duckdb, kernel_langid, license_templates, quality_divergence

ENGLISH = "the cat and the dog went to the house of a man who was in it and that was on the hill with "
FRENCH = "le chat et la souris sont dans une maison que le garde par la route et les autres sur un pont pour "


def docs(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as id", "1 as hist", "true as kept", "0 as n_words", "'q' as score", "'r' as labels", "'p' as print")


def brute_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    often = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if often[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def words(base, n, seed):
    r = random.Random(seed)
    vocabulary = base.split()
    return " ".join(r.choice(vocabulary) if r.random() < 0.5 else "".join(r.choice("abcdeéilnorst") for _ in range(6)) for _ in range(n))


def test_quality_counts_and_verdicts(spark):
    clean = [words(ENGLISH, 300, k) for k in range(20)] + [words(FRENCH, 300, k) for k in range(20)]
    junk = [" ".join(f"{w}###" for w in words(ENGLISH, 200, 90).split()), words(ENGLISH, 200, 91).upper()]
    odd = [None, "", " \n\t", "a b c " * 100, "x\nx\n \n\nx\x0b", "é ñ ### |\n" * 3, "long " * 40_000, clean[0]]
    langs = ["en"] * 20 + ["fr"] * 20 + [None] * (len(junk) + len(odd))
    texts = clean + junk + odd
    got = {r.doc_id: r for r in quality_divergence.judge(docs(spark, texts, langs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), i
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(40)) and got[len(texts) - 1].kept
    assert not got[40].kept and not got[41].kept


def test_quality_of_other_languages(spark):
    russian = "и в не на что он с как это по но они к у же вы за бы от то мы дом лес река город слово день ночь рука вода "

    def prose(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(russian.split()) if r.random() < 0.6 else "".join(r.choice("абвгдеиклмнопрст") for _ in range(6)) for _ in range(n))

    english = [words(ENGLISH, 200, k) for k in range(10)]
    junk = " ".join(f"{w}###|" for w in prose(200, 3).split())
    few = quality_divergence.judge(docs(spark, [*english, prose(200, 1), junk, prose(200, 2)], ["en"] * 10 + ["ru", "ru", None]))
    assert [r.kept for r in few.orderBy("doc_id").collect()] == [True] * 12 + [False]  # one document is no reference, so the method abstains
    texts = [*english, *(prose(200, k) for k in range(60)), junk, prose(200, 99)]
    many = quality_divergence.judge(docs(spark, texts, ["en"] * 10 + ["ru"] * 61 + [None]))
    assert [r.kept for r in many.orderBy("doc_id").collect()] == [True] * 70 + [False, True]
    assert set(quality_divergence.learned_words(docs(spark, texts, ["en"] * 10 + ["ru"] * 61 + [None]), "text", "lang")["ru"]) <= set(russian.split())


def test_quality_limit_follows_the_length(spark):
    r = random.Random(8)
    clean = [words(ENGLISH, n, n + k) for n in (55, 70, 90, 150, 600) for k in range(20)]
    # fragments of a table: none of its words is a common one, though its characters are those of prose
    table = [" ".join("".join(r.choice("abcdeéilnorst") for _ in range(6)) for _ in range(n)) for n in (65, 80, 99, 200, 900) for _ in range(20)]
    got = {x.doc_id: x.kept for x in quality_divergence.judge(docs(spark, clean + table, ["en"] * len(clean) + [None] * len(table))).collect()}
    assert sum(got[k] for k in range(len(clean))) >= len(clean) - 1
    assert not any(got[k] for k in range(len(clean), len(clean) + len(table)))


def test_quality_without_references_or_rows(spark):
    none = quality_divergence.judge(docs(spark, [words(ENGLISH, 100, 1)]))
    assert [r.kept for r in none.collect()] == [True]
    assert quality_divergence.judge(docs(spark, [])).count() == 0


def test_js_distance_against_definition():
    p, q = np.array([[3.0, 1, 0], [0, 0, 0]]), np.array([1.0, 1, 2])
    m = (p[0] / 4 + q / 4) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert quality_divergence.js_distance(p, q)[0] == pytest.approx(np.sqrt((kl(p[0] / 4) + kl(q / 4)) / 2))
    assert quality_divergence.js_distance(p, q)[1] == 1


def test_license_templates(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.",
        "It is under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
        "GNU General Public License, version 3",  # no grant: the phrase alone
        "Licensed under CC BY-NC 4.0 and released under the MIT License; MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so",
        None, "", "KELVIN K apache licensé", "apache license " * 3,
    ]
    got = {r.doc_id: r for r in license_templates.scan(docs(spark, texts)).collect()}
    assert (got[0].labels, got[0].base_labels, got[0].n_base, got[0].first_word, got[0].score) == ("apache,apache-2.0", "apache", 1, 3, 1.0)
    assert got[1].labels == "gpl,gpl-3.0" and got[2].labels == "gpl" and got[2].score == 0.5
    assert got[3].labels == "cc-by,cc-by-nc-4.0,mit,mit-notice" and got[3].n_base == 3
    assert got[4].labels == "mit-text" and got[4].n_base == 0
    for i in (5, 6):
        assert (got[i].n_words, got[i].labels, got[i].first_word, got[i].score) == (0, "", None, 0.0)
    assert (got[7].n_words, got[7].n_base) == (4, 0)
    assert (got[8].n_base, got[8].first_word, got[8].last_word) == (3, 0, 4)
    assert license_templates.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("text", "found"), [("a c", True), ("a b c", True), ("a b b c", False), ("x a c y", True), ("a", False)])
def test_optional_region(text, found):
    edges, accepting = license_templates.compiled("a <<beginOptional>>b<<endOptional>> c")
    assert license_templates.accepts(text.encode().split(), edges, accepting) is found


@pytest.mark.parametrize(("text", "found"), [("a c", False), ("a x c", True), ("a x y c", True), ("a x y z c", False)])
def test_replaceable_region(text, found):
    edges, accepting = license_templates.compiled("a <<var;name=n;match=1..2>> c")
    assert license_templates.accepts(text.encode().split(), edges, accepting) is found


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe_duckdb.RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, reference_encoding):
    r = random.Random(1)
    texts = [None, "", " ", "\n\n  x", "naïve café 👩‍👩‍👧 日本語", "a" * 5000, "".join(r.choice("etaoin") for _ in range(3000)), "it's 1234567 <|endoftext|>", "\u0000\x7f"]
    texts += ["".join(r.choice("abc éñ'12.\n\t中") for _ in range(r.randint(1, 80))) for _ in range(150)] + ["twice", "twice"]
    df = docs(spark, texts)
    encoded = bpe_duckdb.encode(df)
    for row in encoded.collect():
        assert row.ids == reference_encoding.encode_ordinary(texts[row.doc_id] or ""), row.doc_id
    for row in bpe_duckdb.decode(encoded).collect():
        assert bytes(row.decoded).decode() == (texts[row.doc_id] or "")
    for row in bpe_duckdb.digests(df).collect():
        ids = reference_encoding.encode_ordinary(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
    assert bpe_duckdb.digests(docs(spark, [])).count() == 0


def test_bpe_cache_turns_over(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe_duckdb, "CACHED", 5)
    monkeypatch.setattr(bpe_duckdb, "WORDS_AT_ONCE", 3)
    codec = bpe_duckdb.Codec(public_tokenizers.path(bpe_duckdb.RANK_FILE), public_tokenizers.PATTERN, long_word=8)
    for k in range(6):
        texts = [f"unbelievable {k} internationalization wording{k} the", "the the"]
        for t, (ids, decoded) in zip(texts, codec.encode(texts), strict=True):
            assert bpe_duckdb.as_ints(ids) == reference_encoding.encode_ordinary(t) and decoded == t.encode()


@pytest.mark.parametrize("long_word", [2, 5, 16, 256])
def test_long_words_equal_the_library(reference_encoding, long_word):
    r = random.Random(long_word)
    codec = bpe_duckdb.Codec(public_tokenizers.path(bpe_duckdb.RANK_FILE), public_tokenizers.PATTERN, long_word=long_word)
    words = [b"a" * n for n in (3, 257, 1000, 4001)] + [b"abc" * 700, b"xabcabd" * 300, ("中文字符没有空格" * 90).encode(), b"etaoin" * 211 + b"s" * 500]
    words += ["".join(r.choice(letters) for _ in range(r.randint(3, 700))).encode() for letters in ("ab", "etaoinsr", "abcdefghijklmnopqrstuvwxyz", "éàaeñ中文") for _ in range(6)]
    for w, ids in zip(words, codec.by_pieces(words), strict=True):
        assert ids == reference_encoding._core_bpe.encode_single_piece(w)
    for w, ids in zip(words, codec.by_query(words, bpe_duckdb.CONTRACT_ALL)[0], strict=True):
        assert bpe_duckdb.as_ints(ids) == reference_encoding._core_bpe.encode_single_piece(w)


def test_a_pass_takes_a_row_for_each_word(reference_encoding):
    r = random.Random(3)
    codec = bpe_duckdb.Codec(public_tokenizers.path(bpe_duckdb.RANK_FILE), public_tokenizers.PATTERN)
    words = ["".join(r.choice("etaoinsrh é") for _ in range(r.randint(2, 60))).encode() for _ in range(300)]
    words = [w for w in dict.fromkeys(words) if w not in codec.ranks]
    ids, pieces = codec.by_query(words)
    assert [bpe_duckdb.as_ints(x) for x in ids] == [reference_encoding._core_bpe.encode_single_piece(w) for w in words] and pieces == words
    passes = bpe_duckdb.CONTRACT.rpartition("select word, pos")[0] + "select count(*) from step"
    assert codec.con.execute(passes).fetchone()[0] == sum(len(w) - x.count(",") for w, x in zip(words, ids, strict=True))
    long = [bytes([97 + i % 20]) * 256 for i in range(1000)]
    runs = list(codec.runs(long))
    assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(1000)) and max(hi - lo for lo, hi in runs) == bpe_duckdb.STATE >> 16


def test_very_long_word_and_null_ids(spark, reference_encoding):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "x" * 300_000, "word " * 100_000]
    for row in bpe_duckdb.encode(docs(spark, texts)).collect():
        assert row.ids == reference_encoding.encode_ordinary(texts[row.doc_id])
    got = bpe_duckdb.decode(spark.createDataFrame([(1, None), (2, []), (2, [])], "doc_id long, ids array<int>")).collect()
    assert sorted((x.doc_id, bytes(x.decoded)) for x in got) == [(1, b""), (2, b""), (2, b"")]


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="no token has the id"):
        bpe_duckdb.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_langid_held_out_accuracy(spark):
    texts, langs = [], []
    for k in range(200):
        texts += [words(ENGLISH, 40, k), words(FRENCH, 40, 1000 + k)]
        langs += ["en", "fr"]
    texts += [None, "", "12 34 !?", words(FRENCH, 5000, 7)]
    langs += ["en", "en", None, None]
    rows = kernel_langid.identify(docs(spark, texts, langs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (400, 401, 402):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.doc_id: r.lang_pred for r in rows}[403] == "fr"


def test_langid_with_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in kernel_langid.identify(docs(spark, ["some text", "more"])).collect()} == {"und"}
    assert kernel_langid.identify(docs(spark, [])).count() == 0


def test_langid_sample_takes_one_row_of_a_repeated_id(spark):
    texts = [words(ENGLISH, 20, k) for k in range(60)] + [words(FRENCH, 20, k) for k in range(40)]
    ids = [1] * 30 + list(range(100, 130)) + list(range(200, 240))
    df = docs(spark, texts, ["en"] * 60 + ["fr"] * 40, ids)
    got = kernel_langid.sample(df, "doc_id", "text", "lang", 20, 2)
    assert len({r[0] for r in got}) == len(got) <= 40 and {r[2] for r in got} == {"en", "fr"}
    assert [r[1] for r in got if r[0] == 1] in ([], [min(texts[:30])])


def test_langid_learns_every_language(spark):
    r = random.Random(4)
    vocabulary = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(250)}
    rows = [(y, " ".join(r.choice(vocabulary[y]) for _ in range(30))) for y in vocabulary for _ in range(8)]
    df = docs(spark, [t for _, t in rows], [y for y, _ in rows])
    got = {x.doc_id: x for x in kernel_langid.identify(df, total=600).collect()}
    assert {x.lang_pred for x in got.values()} == set(vocabulary)
    held = [i for i, x in got.items() if x.held_out]
    assert len(held) > 300 and np.mean([got[i].lang_pred == rows[i][0] for i in held]) > 0.9


def test_langid_one_id_with_most_rows(spark):
    texts = [words(FRENCH, 20, 1)] * 3000 + [words(ENGLISH, 20, k) for k in range(20)]
    got = kernel_langid.sample(docs(spark, texts, ["fr"] * 3000 + ["en"] * 20, [3] * 3000 + list(range(100, 120))), "doc_id", "text", "lang", 5, 100)
    assert [x[0] for x in got if x[2] == "fr"] == [3] and sum(x[2] == "en" for x in got) == 5


def test_regression_against_dense_kernel_ridge():
    r, last = random.Random(3), np.zeros(kernel_langid.SIZE, np.int64)
    texts = [words(ENGLISH, r.randint(3, 30), k) for k in range(25)] + [words(FRENCH, r.randint(3, 30), k) for k in range(20)]
    sets = [kernel_langid.grams(t.encode(), last) for t in texts]
    labels = ["en"] * 25 + ["fr"] * 20
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.where(np.array(labels)[:, None] == np.array(["en", "fr"]), 1.0, -1.0)
    more = [kernel_langid.grams(words(base, 12, 99).encode(), last) for base in (ENGLISH, FRENCH)]
    dense = np.array([[kernel(a, b) for b in sets] for a in sets + more]) @ np.linalg.solve(k + 1e-2 * np.eye(len(k)), y - y.mean(0)) + y.mean(0)
    model = kernel_langid.fit(sets, labels, landmarks=45, ridge=1e-2)
    assert np.allclose(model.scores(sets + more), dense, atol=2e-3)
    tied = kernel_langid.fit([sets[0], sets[0]], ["b", "a"])
    assert tied.scores([sets[0]]).argmax() == 0 and tied.languages == ["a", "b"]


def test_presence_kernel_against_sets():
    last = np.zeros(kernel_langid.SIZE, np.int64)
    text = b"Abc  abc, abd"
    codes = kernel_langid.grams(text, last)
    plain = re.sub(r"[^a-z]+", " ", text.decode().lower())
    assert len(codes) == len(set(codes.tolist())) == len({plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)})


def test_whole_licenses_refuse_other_conditions(spark):
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    one = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    two = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    three = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: made by X.\n"
    end = (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    isc_end = (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER'
        " RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
        ", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,'
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )
    texts = [head + one + two + end, head + one + two + three + end, head + one + two + advert + three + end, head + one + two, isc + isc_end, isc, mit, mit.replace("shall be included", "may be left out"), head + one.replace("must", "may") + two + end]
    got = {r.doc_id: r.labels for r in license_templates.scan(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == ["bsd-2-clause", "bsd-3-clause", "", "", "isc-text", "", "mit-text,mit-whole", "mit-text", ""]


def as_pattern(parts):
    """A backtracking matcher of the same template, over words each led by a space."""
    out = ""
    for kind, *rest in parts:
        if kind == "word":
            out += " " + re.escape(rest[0])
        elif kind == "optional":
            out += f"(?:{as_pattern(rest[0])})?"
        else:
            out += "(?: [^ ]+){%s,%s}" % (rest[0], "" if rest[1] is None else rest[1])
    return out


def random_template(r, depth=0):
    parts, text = [], ""
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["word", "word", "optional", "var"]) if depth < 3 else "word"
        if kind == "word":
            w = r.choice("abc")
            parts.append(("word", w))
            text += f" {w} "
        elif kind == "optional":
            inner, marked = random_template(r, depth + 1)
            parts.append(("optional", inner))
            text += f"<<beginOptional>>{marked}<<endOptional>>"
        else:
            least, most = r.choice([(0, 1), (1, 1), (1, 2), (0, None), (1, None)])
            parts.append(("words", least, most))
            match = {None: ".*" if least == 0 else ".+"}.get(most, f"{least}..{most}")
            text += f'<<var;name="x";original="a <b>; c";match="{match}">>'
    return parts, text


@pytest.mark.parametrize("seed", range(60))
def test_nested_markup_against_a_backtracking_matcher(seed):
    r = random.Random(seed)
    parts, text = random_template(r)
    if not any(p[0] == "word" for p in parts):
        with pytest.raises(ValueError, match="mandatory"):
            license_templates.compiled(text)
        return
    states, accepting = license_templates.compiled(text)
    whole = re.compile(as_pattern(parts) + r"(?= |$)")
    for _ in range(60):
        words = [r.choice("abcd") for _ in range(r.randint(0, 9))]
        assert license_templates.accepts([w.encode() for w in words], states, accepting) is bool(whole.search("".join(f" {w}" for w in words))), (text, words)


@pytest.mark.parametrize(
    ("template", "text", "found"),
    [
        ("a <<beginOptional>>b <<var;name=n;match=1..2>> c<<endOptional>> d", "a b q c d", True),
        ("a <<beginOptional>>b <<var;name=n;match=1..2>> c<<endOptional>> d", "a d", True),
        ("a <<beginOptional>>b <<var;name=n;match=1..2>> c<<endOptional>> d", "a q d", False),
        ("a <<beginOptional;name=o>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a b d", True),
        ('a <<var;name="n";original="x";match="(foo|bar)( baz)?">> c', "a bar baz c", True),
        ('a <<var;name="n";original="x";match="(foo|bar)( baz)?">> c', "a baz c", False),
        ('a <<var;name="n";original="x";match=".{0,5}">> c', "a xx yy c", True),
        ('a <<var;name="n";original="x";match=".{0,5}">> c', "a xx yyy c", False),
        ('a <<var;name="n";original="x";match=".{1,5}">> c', "a c", False),
        ('a <<var;name="n";original="x";match=".{3,}">><<var;name="m";original="x";match=".*">> c', "a xy xy z c", True),
        ('<<var;name="n";original="Copyright (c) <year>";match=".{0,5000}">> a b', "so a b", True),
    ],
)
def test_public_markup(template, text, found):
    states, accepting = license_templates.compiled(template)
    assert license_templates.accepts(text.encode().split(), states, accepting) is found


@pytest.mark.parametrize("template", ["a <<beginOptional>>b", "a <<endOptional>> b", "a <<what>> b", "a <<var;name=n>> b", 'a <<var;match="(">> b', 'a <<var;match="x/y">> b', "a << b", "<<beginOptional>>a<<endOptional>>", "a <<var;match=3..1>>"])
def test_markup_that_is_not_understood_is_an_error(template):
    with pytest.raises(ValueError):
        license_templates.compiled(template)


def test_licenses_in_very_long_texts_and_repeated_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    zlib_text = license_templates.TEMPLATES["zlib"].split("<<")[0]
    texts = ["under " * 400_000 + notice, notice, notice, "under the " * 200_000, zlib_text, re.sub(r"<<(?:\"[^\"]*\"|[^\">])*>>", "authors", license_templates.TEMPLATES["zlib"])]
    got = {r.doc_id: r for r in license_templates.scan(docs(spark, texts, ids=[0, 1, 1, 3, 4, 5])).collect()}
    assert got[0].labels == got[1].labels == "apache,apache-2.0" and got[0].n_words == 400_008 and got[3].labels == got[4].labels == ""
