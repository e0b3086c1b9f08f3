"""License scans by template-markup matching.

A template is license wording with two kinds of marked region, as in the public
SPDX template syntax: ``<<beginOptional>>..<<endOptional>>`` may be absent, and may
have any regions within; ``<<var;name="..";original="..";match="..">>`` may be
replaced by any wording that ``match`` allows: a regular expression over the words,
lower-cased and joined by single spaces (``.+``, ``.*`` and ``.{a,b}``, with a and b
characters, among them), or ``m..n`` for m to n words. Markup that isn't understood
is an error. A template is compiled to an automaton over words; a text is accepted
if some run of its words follows the mandatory wording exactly. Matching is per
document, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._shared import as_bytes, slices, small_batches

#: The fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The BSD licenses; what stands between the conditions on copies and the disclaimer is left open.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " <<var;name=mark;match=0..1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<var;name=mark;match=0..1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution{}"
    " this software is provided by <<var;name=holder;match=1..12>> as is and any express or implied warranties including but not limited to"
    " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name=holder;match=1..12>> be liable"
    " for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
    " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort"
    " including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: Templates of license notices and of whole licenses, by the label that they add; mit-text is the grant of the MIT license alone.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0",
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-nc 4.0",
    "gpl-2.0": "under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "gpl-3.0": "under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "mit-notice": "<<var;name=verb;match=1..1>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of <<var;name=software;match=1..6>> and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    ),
    "mit-whole": (
        "permission is hereby granted free of charge to any person obtaining a copy of <<var;name=software;match=1..6>> and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall <<var;name=holder;match=1..10>> be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and <<var;name=holder;match=1..10>> all warranties with regard to this software including all implied warranties"
        " of merchantability and fitness in no event shall <<var;name=holder;match=1..10>> be liable for any special direct indirect or consequential damages"
        " or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
        " arising out of or in connection with the use or performance of this software"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the <<var;name=\"holder\";original=\"authors\";match=\".{1,60}\">> be held liable"
        " for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications"
        " and to alter it and redistribute it freely subject to the following restrictions <<var;name=mark;match=0..1>> the origin of this software must not be misrepresented"
        " you must not claim that you wrote the original software if you use this software in a product an acknowledgment"
        " <<beginOptional>>(see the following)<<endOptional>> in the product documentation would be appreciated but is not required"
        " <<var;name=mark;match=0..1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " <<var;name=mark;match=0..1>> this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
        " either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"
        " <<beginOptional>>in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment"
        " in perpetuity of all present and future rights to this software under copyright law<<endOptional>>"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-2-clause": _BSD.format(""),
    "bsd-3-clause": _BSD.format(
        " <<var;name=mark;match=0..1>> neither the name of <<var;name=holder;match=1..12>> nor the names of <<var;name=its;match=0..1>> contributors"
        " may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
}
_KEPT = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 0x7F else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, a-z (A-Z lower-cased) and code points from U+0080 on."""
    return text.lower().translate(_KEPT).split()


MARKUP = re.compile(r'<<((?:"[^"]*"|[^">])*)>>')
#: What a regular expression over words may have: no punctuation that words don't.
UNDERSTOOD = re.compile(r"(?:[A-Za-z0-9 |()?*+.\[\]{},^$-]|\\[dwsDWSb]|[^\x00-\x7F])*")
#: Whether words from one place to another may stand in a region: words, their code points counted up, the places.
Check = Callable[[list, list, int, int], bool]


def replaceable(match: str) -> tuple:
    """A region: ``("words", least, most)``, ``most`` None without a bound, or ``("check", Check, most code points)``."""
    if m := re.fullmatch(r"(\d+)\.\.(\d+)", match):
        least, most = int(m[1]), int(m[2])
        if least > most:
            raise ValueError(f"no number of words is in {match}")
        return "words", least, most
    if match in (".+", ".*"):
        return "words", int(match == ".+"), None
    if m := re.fullmatch(r"\.\{(\d*),(\d*)\}", match):
        least, most = int(m[1] or 0), int(m[2]) if m[2] else None
        return "check", lambda words, sizes, a, b: least <= points(sizes, a, b) <= (float("inf") if most is None else most), most
    if not UNDERSTOOD.fullmatch(match):
        raise ValueError(f"not a match over words: {match!r}")
    try:
        whole = re.compile(match, re.IGNORECASE).fullmatch
    except re.error as e:
        raise ValueError(f"not a regular expression: {match!r}") from e
    return "check", lambda words, sizes, a, b: whole(b" ".join(words[a:b]).decode()) is not None, None


def points(sizes: list[int], a: int, b: int) -> int:
    """Code points of words a to b, joined by spaces."""
    return sizes[b] - sizes[a] - (b > a)


def parsed(template: str) -> list[tuple]:
    """The template's parts: ``("word", w)``, ``("optional", parts)`` and regions. ValueError for markup that isn't understood."""
    open_parts: list[list[tuple]] = [[]]

    def plain(text: str) -> None:
        if "<<" in text or ">>" in text:
            raise ValueError(f"markup isn't closed: {text!r}")
        open_parts[-1].extend(("word", w) for w in words_of(text.encode()))

    at = 0
    for m in MARKUP.finditer(template):
        plain(template[at : m.start()])
        at = m.end()
        kind, _, rest = m[1].partition(";")
        if kind.strip() == "beginOptional":
            open_parts.append([])
        elif kind.strip() == "endOptional":
            if len(open_parts) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = open_parts.pop()
            open_parts[-1].append(("optional", inner))
        elif kind.strip() == "var":
            given = {k: v.strip().strip('"') for k, v in re.findall(r'(\w+)\s*=\s*("[^"]*"|[^;]*)', rest)}
            if "match" not in given:
                raise ValueError(f"a var needs a match: {m[0]}")
            open_parts[-1].append(replaceable(given["match"]))
        else:
            raise ValueError(f"unknown markup: {m[0]}")
    plain(template[at:])
    if len(open_parts) > 1:
        raise ValueError("beginOptional without endOptional")
    if not any(p[0] == "word" for p in open_parts[0]):
        raise ValueError("a template needs mandatory wording")
    return open_parts[0]


class State:
    """Edges that take a word (None: any), and moves that take none: free, into a region, or out of it if its check holds."""

    def __init__(self, most: int | None = None):
        self.takes: list[tuple[bytes | None, int]] = []
        self.free: list[int] = []
        self.enters: list[int] = []
        self.leaves: list[tuple[Check, int]] = []
        self.most = most  # code points that a region may have


def compiled(template: str) -> tuple[list[State], frozenset[int]]:
    """The automaton's states, the first one the start, and those that accept."""
    states = [State()]

    def new(most: int | None = None) -> int:
        states.append(State(most))
        return len(states) - 1

    def build(parts: list[tuple], at: int) -> int:
        for part in parts:
            if part[0] == "word":
                states[at].takes.append((part[1], end := new()))
            elif part[0] == "optional":
                states[at].free.append(begin := new())  # a state of its own, as a loop may stand before it
                states[at].free.append(end := new())
                states[build(part[1], begin)].free.append(end)
            elif part[0] == "check":
                states[at].enters.append(inside := new(part[2]))
                states[inside].takes.append((None, inside))
                states[inside].leaves.append((part[1], end := new()))
            else:
                _, least, most = part
                for _ in range(least):
                    states[at].takes.append((None, k := new()))
                    at = k
                states[at].free.append(end := new())
                if most is None:
                    states[end].takes.append((None, end))
                    states[end].free.append(beyond := new())
                    end = beyond
                else:
                    for _ in range(most - least):
                        states[at].takes.append((None, k := new()))
                        states[k].free.append(end)
                        at = k
            at = end
        return at

    return states, frozenset([build(parsed(template), 0)])


@lru_cache(maxsize=None)
def automata(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list, frozenset, frozenset]]:
    """Label, states, accepting states, and the words of which all must stand in a text that can match."""
    return [(label, *compiled(t), frozenset(p[1] for p in parsed(t) if p[0] == "word")) for label, t in templates]


def accepts(words: list[bytes], states: list[State], accepting: frozenset) -> bool:
    """Whether some run of ``words`` follows the automaton from its first state to an accepting one.

    A thread is a state and the place where it entered a region, or -1.
    """
    sizes = [0, *accumulate(len(w.decode()) + 1 for w in words)] if any(s.enters for s in states) else []
    active: set[tuple[int, int]] = set()
    for i in range(len(words) + 1):
        todo = [*active, (0, -1)]
        seen = set(todo)
        while todo:
            s, mark = todo.pop()
            state = states[s]
            moved = [(t, mark) for t in state.free] + [(t, i) for t in state.enters]
            moved += [(t, -1) for check, t in state.leaves if check(words, sizes, mark, i)]
            for thread in moved:
                if thread not in seen:
                    seen.add(thread)
                    todo.append(thread)
        if any(s in accepting for s, _ in seen):
            return True
        if i < len(words):
            w = words[i]
            active = {(t, mark) for s, mark in seen for x, t in states[s].takes if x is None or x == w}
            active = {(t, mark) for t, mark in active if states[t].most is None or points(sizes, mark, i + 1) <= states[t].most}
    return False


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                found.append((at, label))
    return found


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``documents``: counts of words and of phrase places, labels, score.

    ``labels`` has the phrases' labels and those of the accepted templates,
    distinct, sorted, joined by commas. ``score`` is 1 if a template was
    accepted, 0.5 if only phrases stand in the text, else 0. A null text counts
    as empty: no words, no labels (empty strings), null first and last word.
    Repeated rows are scanned each; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    automata(tuple(templates.items()))  # errors in a template show here
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(tuple(templates.items()))
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for t in as_bytes(b.column("text")):
                    words = words_of(t or b"")
                    places, present = phrase_places(words, phrases), None
                    base = {label for _, label in places}
                    more = set()
                    for label, states, accepting, must in machines:
                        present = set(words) if present is None else present
                        if must <= present and accepts(words, states, accepting):
                            more.add(label)
                    starts = [at for at, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    out = df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
