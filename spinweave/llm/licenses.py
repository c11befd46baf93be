"""License scans by matching template markup.

Markup, after the public SPDX template form: plain text is mandatory wording;
``<<beginOptional>> ... <<endOptional>>`` encloses wording that may be left
out (it may nest); ``<<var;match="...">>`` is a region that may be replaced:
``.+`` by one or more words, ``.*`` by any, ``.{a,b}`` by a to b words, and
``x y|z`` by one of the listed wordings. A template becomes an automaton over
words, made deterministic as texts are read; a place matches if the words from
there lead to acceptance, so mandatory wording matches exactly. The longest
match from each place counts. Markup and rules of another form are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import text as tx

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:;(?:[^;"<>]|"[^"]*")*)*)>>', re.S)

#: label: phrase whose words stand one after another
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: the two- and three-clause texts differ by their third clause
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
    in the documentation and or other materials provided with the distribution {third}
    this software is provided by <<var;match=".{{1,12}}">> as is and any express or implied warranties including but not limited to
    the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;match=".{{1,12}}">> be liable for any
    direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
    loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
    including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""

#: label: template. Wording of public license notices, and whole texts of the short licenses.
TEMPLATES = {
    "mit-notice": '<<var;match="released|licensed|distributed">> under the mit license',
    "apache-2.0-notice": 'licensed under <<beginOptional>>the terms of<<endOptional>> the apache license version 2 0 <<beginOptional>>the license<<endOptional>>',
    "cc-by-nc-notice": '<<beginOptional>><<var;match="this work is|released|licensed">><<endOptional>> <<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> <<var;match="cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial">> <<var;match="1 0|2 0|2 5|3 0|4 0">> <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>',
    "gpl-notice": 'licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>><<var;match="version|either version">> <<var;match="2|3">> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>><<endOptional>>',
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at <<var;match="http|https">> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at <<var;match="http|https">> mozilla org mpl 2 0""",
    "mit-text": """<<beginOptional>>the mit license <<beginOptional>>mit<<endOptional>><<endOptional>> <<beginOptional>>copyright <<var;match=".{0,20}">><<endOptional>>
        permission is hereby granted free of charge to any person obtaining a copy of <<var;match="this software and associated documentation files|this software">>
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
        and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies
        or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;match=".{1,10}">> be liable for any claim
        damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "bsd-2-text": _BSD.format(third=""),
    "bsd-3-text": _BSD.format(third="""<<beginOptional>>3<<endOptional>> neither the name of <<var;match=".{1,10}">> nor the names of <<var;match="its|their">> contributors
        may be used to endorse or promote products derived from this software without specific prior written permission"""),
    "isc-text": """permission to use copy modify <<var;match="and or|and">> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;match=".{1,10}">>
        disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
        <<var;match=".{1,10}">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "spdx-tag": 'spdx license identifier <<var;match="mit|apache 2 0|bsd 2 clause|bsd 3 clause|gpl 2 0 only|gpl 3 0 or later|isc|mpl 2 0">>',
}


def split_words(raw: bytes) -> list[bytes]:
    return _WORDS.findall(raw.lower())


def parse(template: str) -> list:
    """Nested items: a word, ("any", least, most or None), ("one", [words, ...]) or ("optional", items)."""
    stack: list[list] = [[]]

    def plain(text: str) -> list[bytes]:
        if "<<" in text or ">>" in text:
            raise ValueError(f"markup that isn't understood: {text.strip()!r}")
        return split_words(text.encode())

    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += plain(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            found = re.search(r';\s*match="([^"]*)"', m[2])
            rule = found[1] if found else ".+"
            if bounds := re.fullmatch(r"\.\{(\d+),(\d+)\}", rule):
                least, most = int(bounds[1]), int(bounds[2])
                if least > most:
                    raise ValueError(f"a rule that isn't understood: {rule!r}")
                stack[-1].append(("any", least, most))
            elif rule in (".+", ".*"):
                stack[-1].append(("any", int(rule == ".+"), None))
            else:
                wordings = [split_words(x.encode()) for x in rule.split("|")]
                if re.search(r"[][(){}*+?^$\\]", rule) or not all(wordings):
                    raise ValueError(f"a rule that isn't understood: {rule!r}")
                stack[-1].append(("one", wordings))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + plain(template[at:])


class Automaton:
    """Token automaton of a template; its deterministic states are made when first reached."""

    def __init__(self, template: str):
        self.items = parse(template)
        self.words: list[dict[bytes, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.end = self._build(self.items, 0)
        self.vocabulary = {w for d in self.words for w in d}
        self.required = max((w for w in self.items if isinstance(w, bytes)), key=len, default=b"")
        self.start = self._closed({0})
        if self.end in self.start:
            raise ValueError("a template must not accept the empty text")
        self.steps: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.first = None if any(self.any[s] for s in self.start) else {w for s in self.start for w in self.words[s]}

    def _state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def _build(self, items: list, at: int) -> int:
        for x in items:
            new = self._state()
            if isinstance(x, bytes):
                self.words[at].setdefault(x, []).append(new)
            elif x[0] == "optional":
                self.free[at].append(new)
                inner = self._state()
                self.free[at].append(inner)
                self.free[self._build(x[1], inner)].append(new)
            elif x[0] == "any":
                here = at
                if x[2] is None:
                    for _ in range(x[1] + 1):
                        there = self._state()
                        (self.free if here == at else self.any)[here].append(there)
                        here = there
                    self.any[here].append(here)
                    self.free[here].append(new)
                for k in range(0 if x[2] is None else x[2] + 1):
                    if k >= x[1]:
                        self.free[here].append(new)
                    if k < x[2]:
                        there = self._state()
                        self.any[here].append(there)
                        here = there
            else:
                for wording in x[1]:
                    inner = self._state()
                    self.free[at].append(inner)
                    self.free[self._build(wording, inner)].append(new)
            at = new
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.vocabulary else None)
        if key not in self.steps:
            self.steps[key] = self._closed({t for s in states for t in (*self.words[s].get(word, ()), *self.any[s])})
        return self.steps[key]

    def match_at(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match that begins at word ``at``."""
        states, end = self.start, None
        for k in range(at, len(words)):
            states = self.step(states, words[k])
            if not states:
                break
            if self.end in states:
                end = k + 1
        return end

    def search(self, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """(start, end) of the longest match from every place where one begins."""
        starts = range(len(words)) if self.first is None else sorted(p for w in self.first for p in places.get(w, ()))
        for at in starts:
            end = self.match_at(words, at)
            if end is not None:
                yield at, end


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, exact_labels string, n_matches long"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: word count, places of the base phrases, labels of phrases and templates.

    ``exact_labels``: templates that the text's words match from first to last.
    ``score``: share of the text's words inside any match. Null counts as
    empty: no words, no labels, score 0. Rows with equal ids are kept; other
    columns are ignored.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(k, Automaton(v)) for k, v in base.items()]
        others = [(k, Automaton(v)) for k, v in templates.items()]
        for b in batches:
            for part in tx.chunks(b, "text"):
                data, offs = tx.buffers(part.column(1))
                _, _, at = tx.word_table(data, offs)
                counts = np.diff(at)
                low = data.tobytes().lower()
                rows = []
                for k, key in enumerate(part.column(0).to_pylist()):
                    n = int(counts[k])
                    lo, hi = int(offs[k]), int(offs[k + 1])
                    live = [[(label, a) for label, a in group if low.find(a.required, lo, hi) >= 0] for group in (phrases, others)]
                    if not (live[0] or live[1]):
                        rows.append((key, n, 0, None, None, "", "", 0.0, "", 0))
                        continue
                    own = _WORDS.findall(low[lo:hi])
                    wanted = {w for g in live for _, a in g for w in (a.first or ())}
                    places: dict[bytes, list[int]] = {}
                    for i, w in enumerate(own):
                        if w in wanted:
                            places.setdefault(w, []).append(i)
                    found = [[(label, s, e) for label, a in g for s, e in a.search(own, places)] for g in live]
                    spots = [s for _, s, _ in found[0]]
                    inside = np.zeros(n + 1, np.int64)
                    for _, s, e in found[0] + found[1]:
                        inside[s] += 1
                        inside[e] -= 1
                    covered = int((np.cumsum(inside)[:n] > 0).sum())
                    label = lambda x: ",".join(sorted({y[0] for y in x}))
                    exact = [x for x in found[1] if x[1] == 0 and x[2] == n]
                    rows.append((key, n, len(spots), min(spots, default=None), max(spots, default=None), label(found[0]), label(found[0] + found[1]), covered / n if n else 0.0, label(exact), len(found[0]) + len(found[1])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, SCHEMA)


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and template labels of every document."""
    return scan(common.read_docs(spark, sf_dir))
