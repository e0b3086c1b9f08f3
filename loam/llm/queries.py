"""The queries of the operators over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe_duckdb, fill_middle, kernel_langid, latent_leaks, license_templates, line_alignment, minhash_forest, prefix_trie, quality_divergence, quote_threads, redirect_blocks, simhash_tiles, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.judge(table(spark, sf_dir, "documents"))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan(table(spark, sf_dir, "documents"))


def op3_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.threads(table(spark, sf_dir, "conversations"))


def op4_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_redirect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect_blocks.judge(table(spark, sf_dir, "pages"))


def op6_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.digests(table(spark, sf_dir, "documents"))


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_alignment.align(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_aligned", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_bytes=False).drop("spans", "kept")


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op10_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_langid.identify(table(spark, sf_dir, "documents"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(prefix_trie.keyed(prefix_trie.rebuilt(prefix_trie.units(table(spark, sf_dir, "conversations")))))
    return nodes.drop("node", "parent", "turn")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_divergence, op2_license_templates, op3_quote_threads, op4_latent_leaks, op5_redirect_blocks, op6_bpe_duckdb, op7_line_alignment, op8_suffix_dedup, op9_simhash_tiles, op10_kernel_langid, op11_minhash_forest, op12_prefix_trie, op13_fill_middle)
}


def _op1_sql() -> str:
    q = quality_divergence
    listed = ", ".join(f"'{w}'" for w in q.WORDS)
    marks = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": "\\x09-\\x0D\\x20", "stop": ".,;:!?''\"()\\-", "symbol": "#*$%&|<>"}
    classes = [f"len(regexp_replace(text, '[^{m}]', '', 'g'))" for m in marks.values()]
    ascii_all, every = "len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))", "len(text)"
    classes += [f"{ascii_all} - ({' + '.join(classes)})", f"{every} - {ascii_all}"]
    bins = ", ".join(f"[{k}, {c}]" for k, c in enumerate(classes))
    limits = f"(n_words >= {q.MIN_WORDS} and js_chars > {q.MAX_CHARS_JS}) or (n_words >= {q.MIN_WORDS_COMMON} and js_words > greatest({q.MAX_WORDS_JS}, {q.WORDS_NOISE} / sqrt(n_words)))"
    return f"""
with docs as materialized (
    select row_number() over () as r, doc_id, lang, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
),
windows as (
    select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
    from (select r, words, unnest(range(1, len(words) - 1)) as i from docs)
),
repeated as (
    select r, count(distinct i + k) as n
    from (select r, i, count(*) over (partition by r, w) as times from windows), (select unnest([0, 1, 2]) as k)
    where times > 1 group by r
),
line_counts as (
    select r, count(*) - count(distinct line) as n
    from (select r, unnest(string_split(text, chr(10))) as line from docs)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
),
base as (
    select d.r, doc_id, lang, text, words, len(words) as n_words, len(array_to_string(words, '')) as word_chars,
           len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words
    from docs d left join repeated p using (r) left join line_counts l using (r)
),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
bins as (
    select r, 'c' as kind, b[1] as bin, b[2]::double as n from (select r, unnest([{bins}]) as b from judged)
    union all
    select r, 'w', bin, count(*)::double from (
        select r, coalesce(list_position([{listed}], translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 0) as bin
        from (select r, unnest(words) as w from judged)
    ) group by r, bin
),
ref as (
    select lang, kind, bin, sum(n) / sum(sum(n)) over (partition by lang, kind) as q
    from bins join judged using (r)
    where not base_failed and lang in ({", ".join(f"'{x}'" for x in q.COMMON)}) group by lang, kind, bin
),
p as (select r, kind, bin, n / nullif(sum(n) over (partition by r, kind), 0) as p from bins),
sides as (
    select r, l.lang, kind, bin, p, 0.0 as q from p, (select distinct lang from ref) l
    union all
    select j.r, ref.lang, kind, bin, 0.0, q from judged j, ref
),
merged as (select r, lang, kind, bin, sum(p) as p, sum(q) as q from sides group by r, lang, kind, bin),
js as (
    select r, lang, kind,
           sqrt(greatest(sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0 end) + (case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)), 0) / 2) as d
    from merged group by r, lang, kind
),
wide as (select r, lang, max(d) filter (kind = 'c') as js_chars, max(d) filter (kind = 'w') as js_words from js group by r, lang),
far as (select r, bool_and({limits}) as far from wide join judged using (r) group by r)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not coalesce(far, false) as kept
from judged left join far using (r)
"""


def _op2_sql() -> str:
    def places(phrase: str) -> str:
        ws = phrase.split()
        return "list_filter(range(0, len(w)), lambda i: " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws)) + ")"

    phrases = license_templates.PHRASES
    starts = " || ".join(places(p) for p in phrases)
    base = ", ".join(f"case when len({places(p)}) > 0 then '{label}' end" for p, label in phrases.items())
    free = "( as published by the free software foundation)?( either)?"
    grant = "granted free of charge to any person obtaining a copy of( [^ ]+){1,6} and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    patterns = {
        "apache-2.0": "licensed under the apache license( version)? 2 0",
        "cc-by-4.0": "licensed under( a)?( the)? cc by 4 0",
        "cc-by-nc-4.0": "licensed under( a)?( the)? cc by nc 4 0",
        "gpl-2.0": f"under( the terms of)? the gnu general public license{free} version 2",
        "gpl-3.0": f"under( the terms of)? the gnu general public license{free} version 3",
        "mit-notice": "[^ ]+ under the( terms of the)? mit license",
        "mit-text": f"permission is hereby {grant}",
        "isc-text": "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met( [^ ]+)? redistributions of source code must retain the above copyright notice",
    }
    more = ", ".join(f"case when regexp_matches(s, ' {p} ') then '{label}' end" for label, p in patterns.items())
    tidy = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x is not null))), ',')"
    return f"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
    from documents
),
found as (
    select doc_id, len(w) as n_words, {starts} as starts, [{base}] as base, [{more}] as more
    from (select *, ' ' || array_to_string(w, ' ') || ' ' as s from words)
)
select doc_id, n_words::bigint as n_words, len(starts)::bigint as n_base, list_min(starts)::bigint as first_word, list_max(starts)::bigint as last_word,
       {tidy.format("base")} as base_labels, {tidy.format("list_concat(base, more)")} as labels,
       (case when len(list_filter(more, lambda x: x is not null)) > 0 then 1.0 when len(starts) > 0 then 0.5 else 0.0 end)::double as score
from found
"""


_OP3_SQL = """
with recursive lines as materialized (
    select conv_id, turn, role, pos, level, regexp_replace(line, '^[ \\t]*(?:>[ \\t]?)+', '') as rest
    from (
        select *, len(regexp_replace(regexp_extract(line, '^[ \\t]*(?:>[ \\t]?)+'), '[^>]', '', 'g')) as level
        from (select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from conversations)
    )
),
levels as (select conv_id, turn, level, string_agg(rest, chr(10) order by pos) as said from lines group by conv_id, turn, level),
passages as materialized (
    select distinct conv_id, turn, level, passage from (
        select conv_id, turn, level, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as passage
        from (select conv_id, turn, level, unnest(list_concat(regexp_split_to_array(said, '\\n[ \\t\\r]*\\n\\s*'), string_split(said, chr(10)))) as part from levels)
    ) where passage <> ''
),
meant as (
    select q.conv_id, q.turn, q.level, q.passage, max(o.turn) as target
    from passages q join passages o on o.conv_id = q.conv_id and o.passage = q.passage and o.level = 0 and o.turn < q.turn
    where q.level > 0 group by all
),
votes as (select conv_id, turn, level, target, sum(len(passage)) as votes from meant group by all),
parents as (
    select conv_id, turn, target as parent from votes
    qualify row_number() over (partition by conv_id, turn order by level, votes desc, target desc) = 1
),
up as (
    select conv_id, turn, parent as root, 1 as depth, [turn] as path from parents
    union all
    select up.conv_id, up.turn, p.parent, depth + 1, list_prepend(up.root, path) from up join parents p on p.conv_id = up.conv_id and p.turn = up.root
),
roots as (
    select *, row_number() over (partition by conv_id, root order by path) as position
    from (select conv_id, turn, max_by(root, depth) as root, max(depth) as depth, max_by(path, depth) as path from up group by conv_id, turn)
),
own as (
    select conv_id, turn, role, coalesce(string_agg(rest, chr(10) order by pos) filter (level = 0), '') as clean_text,
           count(*) filter (level > 0) as n_quoted, max(level) as max_level
    from lines group by conv_id, turn, role
)
select conv_id, turn, role, clean_text, n_quoted::bigint as n_quoted, max_level::bigint as max_level, parent as parent_turn,
       coalesce(root, turn) as root_turn, coalesce(depth, 0)::bigint as depth, coalesce(position, 0)::bigint as position
from own left join parents using (conv_id, turn) left join roots using (conv_id, turn)
"""


def _op5_sql() -> str:
    rules = sorted(redirect_blocks.RULES, key=lambda r: -len(r[1]))

    def rule(host: str, path: str) -> str:
        cases = []
        for _, r in rules:
            h, _, rest = r.partition("/")
            cases.append(f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '/{rest}') then '{r}'")
        return f"(case {' '.join(cases)} end)"

    said, bare_said = ("(case " + " ".join(f"when {c} = '{r}' then '{v}'" for v, r in rules) + " end)" for c in ("rule", "bare_rule"))
    parts = "'(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    space = "[ \\t\\n\\f\\r]+"
    host, path = f"coalesce({lower.format(f'regexp_extract(url, {parts}, 1)')}, '')", f"coalesce(regexp_extract(url, {parts}, 2), '')"

    def attribute(tag: str, name: str) -> str:
        of = f"""'(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))'"""
        return " || ".join(f"regexp_extract({tag}, {of}, {k})" for k in (1, 2, 3))

    def without_dots(p: str) -> str:
        segments = f"string_split({p}, '/')"
        kept = f"list_reduce(list_transform({segments}, lambda x: [x]), lambda k, x: case when x[1] = '.' then k when x[1] = '..' then k[1:greatest(len(k) - 1, 1)] else list_concat(k, x) end)"
        return f"(case when array_to_string({kept}, '/') = '' then '/' else array_to_string({kept}, '/') || case when {segments}[-1] in ('.', '..') then '/' else '' end end)"

    def resolved(u: str, t: str) -> str:
        at, where = f"coalesce({lower.format(f'regexp_extract({u}, {parts}, 1)')}, '')", f"coalesce(regexp_extract({u}, {parts}, 2), '')"
        rest, before = f"regexp_extract({t}, '^[^?#]*(.*)$', 1)", f"regexp_extract({t}, '^([^?#]*)', 1)"
        folder = f"coalesce(nullif(regexp_extract({where}, '^(.*/)', 1), ''), '/')"
        return f"""case when regexp_matches({t}, '^(#|$)') then null when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {t}
        when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with({t}, '//') then 'http:' || {t} when not contains({u}, '://') then null
        when starts_with({t}, '?') then 'http://' || {at} || {where} || {t}
        when starts_with({t}, '/') then 'http://' || {at} || {without_dots(before)} || {rest}
        else 'http://' || {at} || {without_dots(f"({folder} || {before})")} || {rest} end"""

    def tidy(t: str) -> str:
        return f"replace(trim(regexp_replace({t}, '{space}', ' ', 'g'), ' '), '&amp;', '&')"

    unread = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{x}\\b.*?(?:</{x}\\s*>|\\z)" for x in ("script", "style", "textarea", "title", "xmp"))
    tag = """(?is)<{}\\b(?:[^>"''=]+|=\\s*"[^"]*"|=\\s*''[^'']*''|=|["''])*>"""
    return f"""
with recursive pages_seen as materialized (select *, regexp_replace(html, '{unread}', '', 'g') as h from pages),
links as (
    select page_id, url, {tidy("base")} as base, {tidy("t")} as t
    from (
        select page_id, url, {attribute(f"regexp_extract(h, '{tag.format('base')}')", "href")} as base, unnest(list_concat(
            list_transform(list_filter(regexp_extract_all(h, '{tag.format("link")}'), lambda x: list_contains(regexp_split_to_array(lower({attribute("x", "rel")}), '{space}'), 'canonical')), lambda x: {attribute("x", "href")}),
            list_transform(list_filter(regexp_extract_all(h, '{tag.format("meta")}'), lambda x: lower(trim({attribute("x", "http-equiv")}, ' ')) = 'refresh'), lambda x: regexp_extract({attribute("x", "content")}, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) as t
        from pages_seen where url is not null and h is not null
    )
),
based as (select page_id, t, case when base = '' then url else coalesce({resolved("url", "base")}, url) end as url from links),
targets as (select page_id, {resolved("url", "t")} as url from based),
seen as materialized (
    select page_id, url, false as target from pages
    union all
    select page_id, url, true from targets where url is not null
),
parsed as materialized (
    select *, {rule("host", "path")} as rule, {rule("regexp_replace(host, ':(80|443)?$', '')", "path")} as bare_rule,
           case when contains(url, '://') then regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end else url end as key
    from (
        select *, coalesce({lower.format(f"regexp_extract(url, {parts}, 1)")}, '') as host, coalesce(regexp_extract(url, {parts}, 2), '') as path,
               list_sort(list_filter(string_split(coalesce(regexp_extract(url, {parts}, 3), ''), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$'))) as q
        from seen
    )
),
edges as (select distinct a.key as a, b.key as b from parsed a join parsed b using (page_id) where not a.target and b.target and a.key <> b.key),
linked as (select a, b from edges union select b, a from edges),
reach as (select distinct key, key as met from parsed where key is not null union select r.key, e.b from reach r join linked e on e.a = r.met),
roots as (select key, min(met) as root from reach group by key),
decided as (select root, min({bare_said}) as said from parsed join roots using (key) group by root)
select page_id, host, path, rule, coalesce({said}, said, 'allow') as verdict
from parsed left join roots using (key) left join decided using (root)
where not target
"""


_OP11_SQL = r"""
with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
    select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from worded
),
classes as materialized (select min(doc_id) as id, s, len(s) as n from sets where len(s) > 0 group by s),
-- of two similar sets, each has one of its rarest fifth in common with the other
places as (select id, n, unnest(s) as g from classes),
known as (select g, count(*) as df from places group by g),
ranked as (select id, n, g, row_number() over (partition by id order by df, g) as place from places join known using (g)),
starts as (select id, n, g from ranked where place <= n - (80 * n + 99) // 100 + 1),
pairs as (select distinct a.id as a, b.id as b from starts a join starts b using (g) where a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links as materialized (
    select a, b from (select p.a, p.b, x.n + y.n as total, len(list_intersect(x.s, y.s)) as i from pairs p join classes x on x.id = p.a join classes y on y.id = p.b)
    where 100 * i >= 80 * (total - i)
),
both_ways as (select a, b from links union select b, a from links),
reach as (select id, id as met from classes union select r.id, e.b from reach r join both_ways e on e.a = r.met),
roots as (select id, min(met) as root from reach group by id)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(r.root, d.doc_id) as component_id, coalesce(r.root, d.doc_id) = d.doc_id as kept
from sets d left join classes c on c.s = d.s left join roots r on r.id = c.id
"""

_OP12_SQL = """
with tables as (select list(list_reduce(range(8)::ubigint[], lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, i::ubigint) order by i) as crc from range(256) t(i)),
own as (
    select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, '')) as turns
    from conversations where conv_id is not null group by conv_id
),
drawn as (
    select conv_id, turns, (xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint), lambda s, b: xor(s // 256, crc[(xor(s, b) % 256 + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint) % 6)::bigint as h
    from own, tables
),
seqs as (
    select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:len(a.turns)]) as s
    from drawn a left join own b on a.conv_id - a.conv_id % 100 = b.conv_id
),
steps as (select conv_id, s, unnest(range(0, len(s) + 1)) as depth from seqs),
found as (
    select depth, s[1:depth] as p, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(s) = depth), '') as ends
    from steps group by depth, s[1:depth]
),
linked as (
    select a.*, b.conv_id as parent_conv_id, coalesce(k.n, 0) as n_children, coalesce((a.n_convs - 1) * length(a.p[a.depth].text), 0) as saved
    from found a left join found b on b.depth = a.depth - 1 and b.p = a.p[1:a.depth - 1] left join (select depth - 1 as depth, p[1:depth - 1] as p, count(*) as n from found where depth > 0 group by all) k on k.depth = a.depth and k.p = a.p
),
under as (
    select up as depth, p[1:up] as p, sum((n_children = 0)::bigint) as n_leaves, sum(saved) as saved_tokens
    from (select *, unnest(range(0, depth + 1)) as up from linked) group by up, p[1:up]
)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(ends) as ends_sha256
from linked join under using (depth, p)
"""

_OP13_SQL = r"""
with units as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as x from (select doc_id, coalesce(text, '') as t from documents)),
drawn as (select *, len(u) as n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substring(x, k, 8))::bigint) as h from units),
cut as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form
    from drawn
),
parts as (select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:n], ''), '') as s from cut),
made as (select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as out from parts),
back as (
    select *, case form when 'plain' then out
        when 'psm' then regexp_extract(out, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 1) || regexp_extract(out, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 3) || regexp_extract(out, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 2)
        else regexp_extract(out, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 2) || regexp_extract(out, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 3) || regexp_extract(out, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 1) end as again
    from made
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(out) as output_sha256, sha256(again) as restored_sha256
from back
"""

#: DuckDB SQL over whole tables; the other operators are iterative or learn, and are tested against brute force.
ORACLE_SQL = {
    "op1_quality_divergence": _op1_sql(),
    "op2_license_templates": _op2_sql(),
    "op3_quote_threads": _OP3_SQL,
    "op5_redirect_blocks": _op5_sql(),
    "op11_minhash_forest": _OP11_SQL,
    "op12_prefix_trie": _OP12_SQL,
    "op13_fill_middle": _OP13_SQL,
}
