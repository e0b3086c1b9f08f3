"""Text functions and predicates on the golden cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from loam.functions import quality
from loam.functions import text as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, texts, column):
    return [r[0] for r in values(spark, texts, column)]


def test_cleaning(spark):
    given = ["Line 1\n\n\nLine 2\n\nLine 3", "Text with \r carriage return \t tab \n newline", " \n\t ", "a\rb", None]
    assert one(spark, given, X.one_line("text")) == ["Line 1 Line 2 Line 3", "Text with carriage return tab newline", "", "ab", None]
    assert one(spark, ["  Hello   World　  ", "\nNewLine\tTab "], X.collapsed("text")) == ["Hello World", "NewLine Tab"]


def test_fragments_and_lines(spark):
    assert one(spark, ["a b  c\td\n\n e ", "", "　x　"], X.fragments("text")) == [["a b", "c", "d", "e"], [], ["x"]]
    assert one(spark, ["a\r\nb\u0085c\n"], X.lines("text")) == [["a", "b", "c", ""]]


def test_shingles(spark):
    got = one(spark, ["abcdefghij", "ab", "", "abc", "a😀bc"], X.char_ngrams("text", 3))
    assert got == [["abc", "bcd", "cde", "def", "efg", "fgh", "ghi", "hij"], ["ab"], [], ["abc"], ["a😀b", "😀bc"]]


@pytest.mark.parametrize(("count", "yes", "no"), [
    (X.count_japanese, "ぁゖァヺ一龯", "぀゗゠・䷿鿰한😀a1"),
    (X.count_english, "azAZ", "áéñü1あ"),
    (X.count_numbers, "09", "１２一二a"),
])
def test_character_classes(spark, count, yes, no):
    assert one(spark, [yes, no, ""], count("text")) == [len(yes), 0, 0]


def test_symbol_or_number(spark):
    yes = ["123", "!@#$%^&*()_+-=[]{}|;':\",./<>?`~\\", "1!2", ""]
    no = ["a", "1a", " ", "\t", "\n", "\x7f", "€", "©", "１", "123 456"]
    assert one(spark, yes + no, X.is_symbol_or_number("text")) == [True] * len(yes) + [False] * len(no)


def test_names(spark):
    assert one(spark, ["John Smith", "Yuki/Sales", "山田 太郎", "a@b", "x_y"], X.is_name("text")) == [True, True, True, False, False]


def test_lengths(spark):
    assert values(spark, ["👩‍👩‍👧x", "é"], X.clusters("text"), F.length("text"), X.n_bytes("text")) == [(2, 6, 19), (1, 1, 2)]


def test_positional_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5], [1, 2, 6, 7, 5]), ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(X.positional_jaccard("a", "b")).collect()] == [1.0, 0.6, 0.0, 0.0]


def test_timestamps(spark):
    df = spark.createDataFrame([(763516800.5,), (-978307200.0,), (3124224000.0,)], "t double")
    got = df.select(X.from_reference_seconds("t").cast("string").alias("s"), X.to_reference_seconds(X.from_reference_seconds("t")).alias("b")).collect()
    assert [r.s for r in got] == ["2025-03-13 00:00:00.5", "1970-01-01 00:00:00", "2100-01-02 00:00:00"]
    assert [r.b for r in got] == [763516800.5, -978307200.0, 3124224000.0]


def test_file_names(spark):
    assert values(spark, ["sample.txt", "a.b.MD", "none"], X.app_of("text"), X.extension_of("text")) == [("sample", "txt"), ("a.b", "md"), ("none", "")]


QUALITY = [
    ("👍", "AXMessage", True), ("", "AXMessage", False), ("OK", "AXText", True), ("OK", "AXButton", True), ("Settings", "AXButton", True),
    ("John Smith", "AXButton", True), ("A", "AXButton", False), ("Short", "AXStaticText", True), ("A", "AXStaticText", True),
    ("Group content", "AXGroup", True), ("A", "AXGroup", True), ("A", "AXUnknown", True), ("AB", "AXUnknown", True), ("", "AXUnknown", False),
    ("aaaaaa", "AXText", False), ("   ", "AXText", False), ("https://example.com", "AXLink", True), ("#general", "AXLink", True), ("@channel", "AXLink", True),
    ("Cancel", "AXStaticText", False), ("Cancel", "AXMessage", True), ("http://x", "AXText", False), ("/usr/bin", "AXLink", False), ("a\\b", "AXText", False),
    ("x.exe", "AXText", False), ("12.5", "AXText", False), ("x" * 50 + "y", "AXText", False), ("あい" * 25 + "う", "AXText", True), ("Search...", "AXTextField", False),
    (None, "AXText", False), ("text", None, True), ("aa", "AXText", True),
]


def test_quality_by_role(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(QUALITY)], "i int, text string, role string")
    got = [r.q for r in df.select("i", quality.quality_content("text", "role").alias("q")).orderBy("i").collect()]
    assert got == [e for _, _, e in QUALITY]
