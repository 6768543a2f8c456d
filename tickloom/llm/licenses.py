"""License scans by template markup.

A template is wording with regions: `[[ ... ]]` may be missing, `<a-b>` stands for a to b words
of any kind. It is compiled into an automaton over words, whose accepting run must match all
other wording word for word. Holders' names are replaceable. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z
in lower case; an automaton is started where a template can begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm import license_texts
from tickloom.llm.common import buffer_of, plain, slices
from tickloom.llm.words import BYTES, byte_class, spans, word_hashes

WORD = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Bytes A-Z count as a-z.
FOLDED = BYTES.copy()
FOLDED[0x41:0x5B] = BYTES[0x61:0x7B]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Phrases and the labels they give.
PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Scores: a whole licence, a standard header of one, its opening or name alone.
WHOLE, HEADER, OPENING = 1.0, 0.8, 0.6

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files [[ the software ]] to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions"
)
_ISC = (
    "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee "
    "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met"
)
_BSD_TWO = (
    f"{_BSD} [[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution"
)
_BSD_THREE = (
    f"{_BSD_TWO} [[ 3 ]] neither the name of <1-12> nor the names of [[ its ]] [[ any ]] contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission"
)
_BSD_END = (
    "this software is provided by <1-12> as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "<1-12> be liable for any direct indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Labels, scores and wording of licences with markup. Names of holders are replaceable.
TEMPLATES: tuple[tuple[str, float, str], ...] = (
    ("mit", WHOLE,
     f"{_MIT} the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included "
     "in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
     "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
     "and noninfringement in no event shall <1-12> be liable for any claim damages or other liability whether in an "
     "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
     "dealings in the software"),
    ("mit", OPENING, _MIT),
    ("mit", OPENING, "under the [[ terms of the ]] mit license"),
    ("isc", WHOLE,
     f"{_ISC} the software is provided as is and <1-12> disclaims all warranties with regard to this software including "
     "all implied warranties of merchantability and fitness in no event shall <1-12> be liable for any special direct "
     "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in "
     "an action of contract negligence or other tortious action arising out of or in connection with the use or "
     "performance of this software"),
    ("isc", OPENING, _ISC),
    ("bsd-2", WHOLE, f"{_BSD_TWO} {_BSD_END}"),
    ("bsd-3", WHOLE, f"{_BSD_THREE} {_BSD_END}"),
    ("bsd", OPENING, _BSD),
    ("apache-2", HEADER,
     "licensed under the apache license version 2 0 [[ the license ]] you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at <1-10> unless required by applicable law or agreed to in "
     "writing software distributed under the license is distributed on an as is basis without warranties or conditions "
     "of any kind either express or implied see the license for the specific language governing permissions and "
     "limitations under the license"),
    ("apache-2", OPENING, "licensed under the apache license version 2 0"),
    ("gpl", HEADER,
     "is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version <1-2> of the license or at your option any later version"),
    ("lgpl", HEADER,
     "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
     "as published by the free software foundation either version <1-3> of the license or at your option any later version"),
    ("agpl", HEADER,
     "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
     "as published by the free software foundation either version <1-2> of the license or at your option any later version"),
    ("gpl", OPENING, "licensed under the gnu general public license [[ version <1-2> ]]"),
    ("gpl", OPENING, "under the terms of the gnu general public license"),
    ("lgpl", OPENING, "licensed under the gnu lesser general public license [[ version <1-2> ]]"),
    ("lgpl", OPENING, "under the terms of the gnu lesser general public license"),
    ("agpl", OPENING, "licensed under the gnu affero general public license [[ version <1-2> ]]"),
    ("agpl", OPENING, "under the terms of the gnu affero general public license"),
    ("mpl-2", HEADER,
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at <1-8>"),
    ("mpl-2", OPENING, "under the [[ terms of the ]] mozilla public license [[ v ]] [[ version ]] 2 0"),
    ("cc", OPENING, "licensed under [[ a ]] creative commons <1-6> license"),
    ("cc-by", OPENING, "licensed under cc by [[ sa ]] [[ nd ]] <1-1> 0"),
    ("cc-by-nc", OPENING, "licensed under cc by nc [[ sa ]] [[ nd ]] <1-1> 0"),
    ("public-domain", OPENING, "released into the public domain"),
    ("all-rights-reserved", OPENING, "all rights reserved"),
)


def parts(template: str) -> Iterator[tuple]:
    """("word", w), ("any", low, high) and ("maybe", parts) in order."""
    stack: list[list] = [[]]
    for token in template.split():
        if token == "[[":
            stack.append([])
        elif token == "]]":
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif found := re.fullmatch(r"<(\d+)-(\d+)>", token):
            stack[-1].append(("any", int(found[1]), int(found[2])))
        else:
            stack[-1].append(("word", token))
    (out,) = stack
    return iter(out)


@dataclass
class Automaton:
    """steps[state]: (word or None for any, next state), hashed: the same by hash; free[state]: states reached at once."""

    label: str
    score: float
    steps: list[list[tuple[bytes | None, int]]]
    free: list[list[int]]
    final: int

    def __post_init__(self) -> None:
        self.hashed = [[(w if w is None else word_hash(w.decode()), to) for w, to in s] for s in self.steps]

    def closed(self, states: set[int]) -> set[int]:
        out, new = set(states), list(states)
        while new:
            for other in self.free[new.pop()]:
                if other not in out:
                    out.add(other)
                    new.append(other)
        return out

    def first(self) -> set[int]:
        return {h for s in self.closed({0}) for h, _ in self.hashed[s] if h is not None}

    def accepts(self, words: list, steps: list | None = None) -> bool:
        """Whether some prefix of the words (or of their hashes, with `hashed`) is the template's wording."""
        steps = self.steps if steps is None else steps
        states = self.closed({0})
        for word in words:
            if self.final in states:
                return True
            states = self.closed({to for s in states for w, to in steps[s] if w is None or w == word})
            if not states:
                return False
        return self.final in states

    @property
    def longest(self) -> int:
        return len(self.steps)


def compiled(label: str, score: float, template: str) -> Automaton:
    steps: list[list] = [[]]
    free: list[list] = [[]]

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    def build(at: int, items) -> int:
        for kind, *rest in items:
            if kind == "word":
                new = state()
                steps[at].append((rest[0].encode(), new))
                at = new
            elif kind == "any":
                low, high = rest
                skips = []
                for i in range(high):
                    if i >= low:
                        skips.append(at)
                    new = state()
                    steps[at].append((None, new))
                    at = new
                for s in skips:
                    free[s].append(at)
            else:
                start = at
                at = build(at, rest[0])
                free[start].append(at)
        return at

    final = build(0, parts(template))
    return Automaton(label, score, steps, free, final)


@cache
def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]), FOLDED)[0])


def matches(data: np.ndarray, bounds: np.ndarray, phrases, automata: list[Automaton]):
    """Per text: words, phrase places, first and last place, labels of phrases and of templates, best score.

    Hashes find the places; each is then held against the words themselves.
    """
    starts, ends, counts = spans(data, bounds, WORD)
    words = word_hashes(data, starts, ends, FOLDED)
    edges = np.append(0, np.cumsum(counts))
    n = len(counts)
    text = np.repeat(np.arange(n), counts)

    def plain_words(at: int, stop: int) -> list[bytes]:
        return [data[a:b].tobytes().translate(LOWER) for a, b in zip(starts[at:stop].tolist(), ends[at:stop].tolist(), strict=True)]

    places, found, base = [np.empty(0, np.int64)], [], [set() for _ in range(n)]
    for phrase, label in phrases:
        wording = phrase.encode().split()
        want = [word_hash(w) for w in phrase.split()]
        at = np.flatnonzero(words == np.uint64(want[0]))
        at = at[at + len(want) <= edges[text[at] + 1]]
        for step, h in enumerate(want[1:], 1):
            at = at[words[at + step] == np.uint64(h)]
        at = np.array([k for k in at.tolist() if plain_words(k, k + len(want)) == wording], np.int64)
        places.append(at)
        for i in np.unique(text[at]).tolist():
            base[i].add(label)
    own: list[set[str]] = [set() for _ in range(n)]
    best = [0.0] * n
    for automaton in automata:
        firsts = np.array(sorted(automaton.first()), np.uint64)
        for at in np.flatnonzero(np.isin(words, firsts)).tolist():
            i = int(text[at])
            if automaton.label not in own[i] or automaton.score > best[i]:
                stop = min(int(edges[i + 1]), at + automaton.longest)
                if automaton.accepts(words[at:stop].tolist(), automaton.hashed) and automaton.accepts(plain_words(at, stop)):
                    own[i].add(automaton.label)
                    best[i] = max(best[i], automaton.score)
    where = np.sort(np.concatenate(places))
    per_text = np.bincount(text[where], minlength=n)
    low = np.searchsorted(text[where], np.arange(n)) if len(where) else np.zeros(n, np.int64)
    for i in range(n):
        k = int(per_text[i])
        span = where[low[i] : low[i] + k] - edges[i] if k else ()
        found.append((int(counts[i]), k, int(span[0]) if k else None, int(span[-1]) if k else None, base[i], own[i], best[i]))
    return found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row: words, places of phrases, labels by phrases, labels by phrases or templates, score.

    The score is the best of the accepting templates: 1 for a whole licence, less for a header or
    an opening, so a licence with a changed condition scores below 1; else 0.5 if a phrase occurs,
    else 0. Null and empty texts have no words and empty labels. Repeated rows are each scanned;
    very long texts stand alone in a batch; an empty table gives an empty result. No row needs
    another, so there is no shuffle.
    """

    def run(batches):
        automata = [compiled(*t) for t in templates]
        for batch in slices(batches, "text"):
            rows = matches(*buffer_of(batch.column("text")), phrases, automata)
            score = [best or (0.5 if base else 0.0) for *_, base, _, best in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)),
                    pa.array([",".join(sorted(r[4])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[4] | r[5])) for r in rows], pa.string()),
                    pa.array(score, pa.float64()),
                ],
                SCHEMA.replace(",", "").split()[::2],
            )

    return plain(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def sql() -> str:
    """The query op9 in SQL."""

    def places(phrase: str) -> str:
        words = phrase.split()
        test = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words))
        return f"list_filter(range(1, len(ws) + 1), lambda i: {test})"

    def listed(column: str, cases: list[tuple[str, str]]) -> str:
        whens = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in cases)
        return f"array_to_string(list_sort(list_distinct(list_filter([{whens}], lambda x: x IS NOT NULL))), ',') AS {column}"

    base = [(label, f"len(p{k}) > 0") for k, (_, label) in enumerate(PHRASES)]
    own = [(label, f"regexp_matches(joined, '{pattern}')") for label, _, pattern in license_texts.patterns()]
    scores: dict[float, list[str]] = {}
    for (_, test), (_, score, _) in zip(own, license_texts.patterns(), strict=True):
        scores.setdefault(score, []).append(test)
    graded = " ".join(f"WHEN {' OR '.join(tests)} THEN {score}" for score, tests in sorted(scores.items(), reverse=True))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return rf"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (
  SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS joined,
         {", ".join(f"{places(t)} AS p{k}" for k, (t, _) in enumerate(PHRASES))}
  FROM base)
SELECT doc_id, len(ws)::BIGINT AS n_words, len({every})::BIGINT AS n_base,
       (list_min({every}) - 1)::BIGINT AS first_word, (list_max({every}) - 1)::BIGINT AS last_word,
       {listed("base_labels", base)}, {listed("labels", base + own)},
       CASE {graded} WHEN {" OR ".join(t for _, t in base)} THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM p
"""
