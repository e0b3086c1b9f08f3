"""Operators that link rows: quotations, redirects, benchmark items; and the pipeline."""

import random

import pytest

from loam.llm import latent_leaks, queries, quote_threads, redirect_blocks, simhash_tiles


def test_quote_threads(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt is long."),
        (1, 1, "assistant", "> how do I  sort a LIST?\nUse sorted."),
        (1, 2, "user", ">> How do I sort a list?\n> Use sorted.\nThanks"),
        (1, 3, "user", "Use sorted."),
        (1, 4, "user", "> Use sorted.\nagain"),
        (1, 5, "user", "> never said\nhm"),
        (2, 0, "user", "Other"),
        (2, 1, "user", "> Use sorted.\nnot from here"),
        (3, 0, "user", None),
        (None, 1, "user", "> Other"),
        (2, None, "user", "> Other"),
        (4, 0, "user", "para one\nwrapped over\n\npara two"),
        (4, 3000, "user", "> para one wrapped over\nyes"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as level", "3 as hash", "4 as parent", "'x' as lines")
    got = {(r.conv_id, r.turn): r for r in quote_threads.threads(df).collect()}
    assert len(got) == len(rows)
    links = {k: (r.parent_turn, r.root_turn, r.depth) for k, r in got.items()}
    assert links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2) and got[1, 2].max_level == 2 and got[1, 2].n_quoted == 2
    assert links[1, 4] == (3, 3, 1) and links[1, 5] == (None, 5, 0) and links[2, 1] == (None, 1, 0)
    assert links[4, 3000] == (0, 0, 1)
    assert got[1, 2].clean_text == "Thanks" and got[3, 0].clean_text == "" and got[1, 0].clean_text == rows[0][3]
    assert links[None, 1] == (None, 1, 0) and links[2, None] == (None, None, 0)
    assert quote_threads.threads(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_quotes_of_hot_lines_meet_the_last_saying(spark, block):
    r = random.Random(4)
    rows = [(1, k, "user", "> same words\nreply" if r.random() < 0.3 else r.choice(["same words", "else"])) for k in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for x in quote_threads.threads(df, block=block).collect():
        before = [k for _, k, _, t in rows[: x.turn] if t == "same words"]
        assert x.parent_turn == ((before[-1] if before else None) if rows[x.turn][3].startswith(">") else None)


def test_long_reply_chain(spark):
    rows = [(1, k, "u", f"> m{k - 1}\nm{k}" if k else "m0") for k in range(40)]
    got = quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.root_turn, r.depth) == (0, r.turn) for r in got)


def test_redirect_blocks(spark):
    link = "<html><link href='{}' rel='canonical'></html>"
    rows = [
        (1, "https://a.com/x", None),
        (2, "http://example.com/en/1", ""),
        (3, "http://www.example.com/en/1", ""),  # explicit allow beats the blocked alias
        (4, "https://x.net/ES/1", link.format("https://y.net/es/1")),
        (5, "https://z.org/p", "<META HTTP-EQUIV=refresh content='0; url=https://x.net/ES/1#top'>"),
        (6, "https://www.q.org/p/?utm_source=a&b=1", link.format("https://z.org/p")),
        (7, "http://q.org/p?b=1", ""),
        (8, "https://r.org/p", link.format("https://a.com/x")),
        (9, None, None),
        (10, "no scheme", "x"),
        (11, "https://A.COM", ""),
        (12, "https://notexample.org/en/", ""),
        (7, "http://q.org/p?b=1", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as key", "3 as root", "4 as rule", "5 as said")
    got = [tuple(r) for r in redirect_blocks.judge(df).collect()]
    assert len(got) == len(rows) and got.count((7, "q.org", "/p", None, "block")) == 2
    by = {r[0]: r[1:] for r in got}
    assert by[1] == ("a.com", "/x", "com/", "allow") and by[2][2:] == ("example.com/en/", "block") and by[3][2:] == ("www.example.com/en/", "allow")
    assert by[4] == ("x.net", "/ES/1", None, "block") and by[5][3] == "block" and by[6][3] == "block"
    assert by[8][3] == "allow" and by[9] == ("", "", None, "allow") and by[10] == ("", "", None, "allow")
    assert by[11] == ("a.com", "", None, "allow") and by[12][2:] == (None, "allow")
    assert redirect_blocks.judge(df.limit(0)).count() == 0


def test_reply_order_is_depth_first(spark):
    r = random.Random(3)
    parent, rows = {}, []
    for k in range(120):
        parent[k] = r.choice([None, *range(max(0, k - 25), k)]) if k else None
        rows.append((1, k, "u", (f"> m{parent[k]} says\n" if parent[k] is not None else "") + f"m{k} says"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1024, 4):
        got = {x.turn: x for x in quote_threads.threads(df, block=block).collect()}
        assert {k: x.parent_turn for k, x in got.items()} == parent

        def walk(k):
            return [k, *(x for c in sorted(c for c in parent if parent[c] == k) for x in walk(c))]

        for root in (k for k in parent if parent[k] is None):
            assert [got[k].position for k in walk(root)] == list(range(len(walk(root))))
            assert all(got[k].root_turn == root for k in walk(root))


def test_replies_a_and_b_with_their_own_replies(spark):
    rows = [(1, 0, "u", "root says"), (1, 1, "u", "> root says\na says"), (1, 2, "u", "> root says\nb says"), (1, 3, "u", "> a says\na1 says"), (1, 4, "u", "> b says\nb1 says"), (1, 3, "u", "> a says\nagain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as up", "3 as child")
    got = quote_threads.threads(df).orderBy("root_turn", "position").collect()
    assert [x.turn for x in got] == [0, 1, 3, 3, 2, 4]


def by_sql(name, table, rows, columns):
    """What the query's SQL gives for one table of these rows."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("given", pa.Table.from_pylist([dict(zip(columns, r, strict=True)) for r in rows]))
    con.execute(f"create table {table} as from given")
    got = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    return sorted((tuple(r[c] for c in sorted(r)) for r in got.to_pylist()), key=str)


def test_reply_order_equals_its_sql(spark):
    r = random.Random(5)
    rows = []
    for k in range(100):
        quoted = [f"{'>' * r.randint(1, 2)} m{r.randrange(k)} says" for _ in range(r.randint(0, 3))] if k else []
        rows.append((k % 2, k, "u", "\n".join([*quoted, f"m{k} says", "", "more of it"])))
    columns = ["conv_id", "turn", "role", "text"]
    got = quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((tuple(x[c] for c in sorted(x.asDict())) for x in got), key=str) == by_sql("op3_quote_threads", "conversations", rows, columns)
    assert max(x.depth for x in got) > 3


def test_quotes_in_a_very_long_text(spark):
    said = "\n".join(f"line {k} of it" for k in range(20_000))
    rows = [(1, 0, "u", said), (1, 1, "u", "\n".join("> " + x for x in said.split("\n")) + "\nyes"), (1, 2, "u", "> yes\n" + "word " * 200_000), (2, 0, "u", "")]
    got = {(x.conv_id, x.turn): x for x in quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1].parent_turn, got[1, 1].n_quoted, got[1, 1].clean_text, got[1, 2].position) == (0, 20_000, "yes", 2)


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    pages = ["http://a.org/x/y/z.html", "http://a.org/x/y/", "http://a.org", "http://a.org/", "http://a.org/x?q=1#f"]
    links = ["page2.html", "../up", "../../../top", "./same", "//b.net/es/1", "/abs/./a/../b", "https://c.de/p?x=1", "?q=2", "d/", "..", "a/b/../../c?x=/../y", "."]
    df = spark.createDataFrame([(u, x) for u in pages for x in links], "url string, link string")
    for r in df.select("url", "link", redirect_blocks.resolved(df.url, df.link).alias("to")).collect():
        want = urljoin(r.url, r.link)
        assert (r.to if r.to.count("/") > 2 else r.to + "/").removesuffix("#") == (want if want.count("/") > 2 else want + "/"), (r.url, r.link)
    odd = spark.createDataFrame([("http://a.org/x", x) for x in ("#top", "", "mailto:a@b.c", "javascript:go()", None)], "url string, link string")
    assert {r[0] for r in odd.select(redirect_blocks.resolved(odd.url, odd.link)).collect()} == {None}


def test_redirects_by_relative_links_and_rel_words(spark):
    rows = [
        (1, "http://blocked.net/es/1", ""),
        (2, "http://p.org/dir/a.html", "<link rel='alternate canonical' href='//blocked.net/es/1'>"),
        (3, "http://p.org/dir/b.html", '<LINK HREF="a.html" REL = "Canonical">'),
        (4, "http://p.org/c.html", "<meta content='0;URL = dir/b.html' http-equiv=Refresh>"),
        (5, "http://p.org/sub/d.html", "<meta http-equiv='refresh' content=\"5; url='../c.html'\">"),
        (6, "http://p.org/e.html", "<!-- <link rel=canonical href=c.html> --> <link rel=stylesheet href=c.html> <a rel=canonical href=c.html>"),
        (7, "http://p.org/f.html", "<link rel=canonical>" + "<p>text</p>" * 300_000 + "<link rel=canonical href=c.html>"),
        (8, "http://p.org/g.html", "<link data-rel=canonical href=c.html><link rel=canonicals href=c.html>"),
    ]
    got = {r.page_id: r.verdict for r in redirect_blocks.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "allow"}
    more = [(20 + k, u, f"<link rel=canonical href='{x}'>") for k, (u, x) in enumerate(zip(["http://a.net/x/y", "http://a.net", "https://www.example.com/en/1/2?q"], ["../es/1", "fr/./z/..", "../../../p"], strict=True))]
    rows += [*more, (30, "http://a.net/es/1", None), (31, "http://example.com/p", ""), (32, None, "<link rel=canonical href=x>"), (33, "plain", "<link rel=canonical href=/es/>")]
    got = redirect_blocks.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((tuple(x[c] for c in sorted(x.asDict())) for x in got), key=str) == by_sql("op5_redirect_blocks", "pages", rows, ["page_id", "url", "html"])


def test_redirects_by_base_ports_quoted_tags_and_scripts(spark):
    blocked = "http://foo.net/es/1"
    rows = [
        (1, "http://a.org/x/1.html", "<base href='http://foo.net/es/'><link rel=canonical href=one.html>"),
        (2, "http://b.org/2", "<link rel=canonical href='http://foo.net:80/es/two'>"),
        (3, "http://c.org/3", f"<link title=\"a>b\" rel=canonical href='{blocked}'>"),
        (4, "http://d.org/4", f"<script>var x = \"<link rel=canonical href='{blocked}'>\"; canonical()</script><title><link rel=canonical href={blocked}></title>"),
        (5, "http://e.org/5", "<base target=_top><base href=/es/><base href=http://other.org/><link rel=canonical href=//foo.net/es/x>"),
        (6, "http://f.net/in/6", "<base href='/es/'><meta http-equiv=refresh content='0; url=there'>"),
        (7, "http://g.org:443/7", ""),
        (8, "https://g.org/7", f"<link rel=canonical href={blocked}>"),
        (9, "http://foo.net:80/es/9", ""),
        (10, "http://h.org/10", f"<link rel=canonical href=http://foo.net:8080/es/1 title='x=\"'><style>/* <link rel=canonical href={blocked}> */</style>"),
        (11, "http://i.org/11", f"<!-- <script> --><link rel='canonical' href = \"{blocked}\"><!-- </script> -->"),
        (12, "http://j.org/12", f"<script>never ended <link rel=canonical href={blocked}>"),
        (13, "http://k.org/13", f"<meta name=refresh content='a > b'><meta content=\"0;url='{blocked}'\" http-equiv='REFRESH'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = redirect_blocks.judge(df).collect()
    got = {r.page_id: r.verdict for r in found}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "block", 12: "allow", 13: "block"}
    assert next(r for r in found if r.page_id == 9).rule is None  # the contract's host keeps its port
    assert sorted((tuple(x[c] for c in sorted(x.asDict())) for x in found), key=str) == by_sql("op5_redirect_blocks", "pages", rows, ["page_id", "url", "html"])


def test_links_of_a_very_long_page(spark):
    html = "<p title=\"a>b\" x='y' z=1>text</p>" * 50_000 + "<meta " + " ".join(f"a{k}='v>{k}'" for k in range(3000)) + "><link rel=canonical href=http://foo.net/es/1>" + "<script>" + "x < y; " * 100_000
    got = redirect_blocks.judge(spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")).first()
    assert got.verdict == "block"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) if r.random() < 0.7 else r.choice(["the", "of", "and"]) for _ in range(n))


def test_latent_leaks_against_containment(spark):
    r = random.Random(9)
    items = [sentence(r, r.randint(15, 55)) for _ in range(40)]
    texts, want = [], set()
    for d in range(300):
        words = sentence(r, r.randint(20, 300)).split()
        if d % 5 == 0:
            q = r.randrange(len(items))
            planted = items[q].split()
            if d % 10 == 0:  # a paraphrase: some words changed, the answer kept
                planted = [w if r.random() > 0.15 or k > len(planted) * 0.75 else "changed" for k, w in enumerate(planted)]
            at = r.randrange(len(words))
            words[at:at] = planted
            want.add((d, q))
        texts.append(" ".join(words).capitalize())
    texts += [None, "", "the", items[0].upper()]
    want.add((303, 0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as terms", "3 as cosine", "4 as item_id")
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, " ")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in latent_leaks.leaks(df, bench).collect()}
    assert got == want
    kept = {x.doc_id for x in latent_leaks.drop_leaks(df, bench).collect()}
    assert kept == set(range(304)) - {d for d, _ in want}
    assert latent_leaks.leaks(df, bench.limit(0)).count() == 0 and latent_leaks.leaks(df.limit(0), bench).count() == 0


def test_latent_leaks_against_all_passages_and_items(spark):
    r = random.Random(21)
    items = [sentence(r, r.randint(15, 50)) for _ in range(40)] + [sentence(r, 20)] * 2
    texts = []
    for d in range(200):
        text = sentence(r, r.randint(20, 200)).split()
        planted = items[r.randrange(len(items))].split()
        changed = r.choice([0.0, 0.1, 0.2, 0.3, 0.5])
        at = r.randrange(len(text))
        text[at:at] = [w if k > len(planted) * 0.75 or r.random() > changed else "changed" for k, w in enumerate(planted)]
        texts.append(" ".join(text))
    texts += [texts[0], "", None, " ".join(items)]
    terms = {w for i in items for w in i.encode().split()}
    half, want = latent_leaks.WINDOW // 2, set()
    for d, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        for q, item in enumerate(i.encode().split() for i in items):
            reach = max(latent_leaks.WINDOW, len(item) + half)
            for middle in range(half, max(half, len(own)) + half, half):
                region = [w for w in own[max(0, middle - reach) : middle + reach] if w in terms]
                if latent_leaks.verdict(item, region)[0]:
                    want.add((d, q))
                    break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = {(x.doc_id, x.item_id) for x in latent_leaks.leaks(df, bench).collect()}
    assert whole <= want and len(whole) >= 0.98 * len(want) > 100
    for settings in ({"most_items": 14}, {"most_items": 2}, {"most_terms": 300}):
        assert {(x.doc_id, x.item_id) for x in latent_leaks.leaks(df, bench, **settings).collect()} == whole


def test_latent_leaks_in_a_very_long_text_and_repeated_rows(spark):
    r = random.Random(22)
    items = [sentence(r, 30) for _ in range(5)]
    long = sentence(r, 60_000) + " " + items[3] + " " + sentence(r, 60_000)
    rows = [(0, long), (1, items[2]), (1, items[2]), (1, items[4]), (None, items[1])]
    got = latent_leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")).collect()
    assert sorted(((x.doc_id, x.item_id) for x in got), key=str) == sorted([(0, 3), (1, 2), (1, 4), (None, 1)], key=str)


def test_common_length():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent_leaks.common_length(a, b) == t[-1][-1]


def test_queries_and_sql_agree_on_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_pipeline(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, at).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert 0 < len(out) < len(docs) and len({r.doc_id for r in out}) == len(out) and {r.doc_id for r in out} <= docs.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_tokens"]


def test_latent_leaks_of_long_items(spark):
    r = random.Random(11)
    items = [sentence(r, n) for n in (40, 150, 300, 700)]
    texts = [sentence(r, 200) for _ in range(60)]
    for q, item in enumerate(items):
        texts[10 * q] = texts[10 * q] + " " + item + " " + sentence(r, 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in latent_leaks.leaks(df, bench).collect()} == {(10 * q, q) for q in range(4)}


def test_stages_drop_rows_by_id_and_text(spark):
    import corpus_pipeline

    r = random.Random(12)
    item, clean = sentence(r, 30), [sentence(r, 120) for _ in range(6)]
    rows = [(1, clean[0]), (7, clean[0]), (7, clean[1]), (None, clean[2]), (None, clean[3]), (8, clean[4] + " " + item), (8, clean[5]), (None, item + " " + clean[1]), (None, "too short"), (7, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'xx' as lang", "1 as id", "2 as print")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    clean_rows = [rows[k] for k in (0, 2, 3, 4, 6)]
    left = sorted(((x.doc_id, x.text) for x in simhash_tiles.keep_one(df.where("text <> 'too short'")).collect()), key=str)
    assert left == sorted([*clean_rows, rows[5], rows[7]], key=str)
    left = {(x.doc_id, x.text) for x in latent_leaks.drop_leaks(df, bench).collect()}
    assert left == set(rows) - {rows[5], rows[7]}
    left = {(x.doc_id, x.text) for x in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert left == set(rows[:8])
