"""License scans: markup templates compiled to token automata, and fixed phrases."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates: whole licence texts, and one-line references. ``<<optional>> .. <<end>>`` may be left out
#: as a whole; ``<<one of a|b>>`` stands for one of the words; ``<<up to 6>>`` stands for as many words
#: of any kind (names, bullets). All else is mandatory, to the last word. Fixed values.
_BSD_TOP = """redistribution and use in source and binary forms with or without modification are
    permitted provided that the following conditions are met <<up to 1>> redistributions of source code
    must retain the above copyright notice this list of conditions and the following disclaimer
    <<up to 1>> redistributions in binary form must reproduce the above copyright notice this list of
    conditions and the following disclaimer in the documentation and or other materials provided with
    the distribution"""
_BSD_NAMES = """<<up to 1>> neither the <<one of name|names>> of <<up to 12>> nor the names of
    <<one of its|their|his|her|other>> contributors may be used to endorse or promote products derived
    from this software without specific prior written permission"""
_BSD_END = """this software is provided by <<up to 12>> as is and any express or implied warranties
    including but not limited to the implied warranties of merchantability and fitness for a particular
    purpose are disclaimed in no event shall <<up to 12>> be liable for any direct indirect incidental
    special exemplary or consequential damages including but not limited to procurement of substitute
    goods or services loss of use data or profits or business interruption however caused and on any
    theory of liability whether in contract strict liability or tort including negligence or otherwise
    arising in any way out of the use of this software even if advised of the possibility of such damage"""
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this
        software <<optional>> and associated documentation files <<end>>
        <<optional>> the software <<end>> to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice
        <<optional>> including the next paragraph <<end>> shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness
        for a particular purpose and noninfringement in no event shall <<up to 12>> be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising
        from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-2-clause": f"{_BSD_TOP} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_TOP} {_BSD_NAMES} {_BSD_END}",
    "isc": """permission to use copy modify and <<optional>> or <<end>> distribute this software for
        any purpose with or without fee is hereby granted provided that the above copyright notice and
        this permission notice appear in all copies the software is provided as is and <<up to 8>>
        disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <<up to 8>> be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or
        profits whether in an action of contract negligence or other tortious action arising out of or
        in connection with the use or performance of this software""",
    "mit-reference": "<<one of under|with>> the mit license",
    "apache-2.0-reference": """<<one of under|with>> the apache license <<optional>> version <<end>>
        <<one of 2|v2>> <<optional>> 0 <<end>>""",
    "gpl-3.0-reference": """gnu general public license <<optional>> as published by the free software
        foundation <<end>> <<optional>> either <<end>> <<optional>> version <<end>>
        <<one of 3|v3>>""",
    "gpl-2.0-reference": """gnu general public license <<optional>> as published by the free software
        foundation <<end>> <<optional>> either <<end>> <<optional>> version <<end>>
        <<one of 2|v2>>""",
    "cc-by-nc-4.0-reference": "cc by nc <<optional>> license <<end>> <<optional>> version <<end>> 4 0",
    "cc-by-sa-4.0-reference": "cc by sa <<optional>> license <<end>> <<optional>> version <<end>> 4 0",
    "cc-by-4.0-reference": "cc by <<optional>> license <<end>> <<optional>> version <<end>> 4 0",
}

#: A-Z to a-z, and every byte that ends a word to a space; bytes from 0x80 on belong to words.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))

ANY = b"\x00any"


def license_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """Token automaton of one template: ``steps[state]`` lists ``(word, next, mandatory)``."""

    def __init__(self, template: str) -> None:
        self.steps: list[list[tuple[bytes, int, int]]] = [[]]
        skips: dict[int, list[int]] = {}
        opened, self.mandatory, state = None, 0, 0
        for part in re.findall(r"<<[^>]*>>|[^\s<>]+", template):
            if part == "<<optional>>":
                opened = state
                continue
            if part == "<<end>>":
                skips.setdefault(opened, []).append(state)
                opened = None
                continue
            fixed = opened is None and not part.startswith("<<up")
            if part.startswith("<<up to"):
                for _ in range(int(part[7:-2])):
                    self.steps[state].append((ANY, state + 1, 0))
                    self.steps.append([])
                    skips.setdefault(state, []).append(state + 1)
                    state += 1
                continue
            options = part[8:-2].split("|") if part.startswith("<<one of") else [part]
            self.steps += [[]]
            self.steps[state] += [(w.strip().encode(), state + 1, int(fixed)) for w in options]
            self.mandatory += fixed
            state += 1
        self.final = state
        self.skips = skips
        self.first = {w for s in self._closure({0: 0}) for w, _, _ in self.steps[s]}

    def _closure(self, states: dict[int, int]) -> dict[int, int]:
        queue = list(states)
        while queue:
            at = queue.pop()
            for to in self.skips.get(at, ()):
                if states.get(to, -1) < states[at]:
                    states[to] = states[at]
                    queue.append(to)
        return states

    def match(self, words: list[bytes], at: int) -> tuple[int, bool]:
        """Mandatory words met by the best path from ``at``, and whether it was accepted."""
        states, best = self._closure({0: 0}), 0
        for word in words[at:]:
            if self.final in states:
                return self.mandatory, True
            new: dict[int, int] = {}
            for state, met in states.items():
                for wanted, to, counts in self.steps[state]:
                    if wanted == word or wanted is ANY:
                        new[to] = max(new.get(to, 0), met + counts)
            if not new:
                return best, False
            states = self._closure(new)
            best = max(best, *states.values())
        return (self.mandatory, True) if self.final in states else (best, False)


@functools.cache
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[bytes, list[tuple[str, Automaton]]]:
    """Automata by the words they may begin with."""
    starters: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, text in templates:
        automaton = Automaton(text)
        for word in automaton.first:
            starters.setdefault(word, []).append((label, automaton))
    return starters


def _places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which ``phrase`` (with a space on both sides) stands in the spaced line."""
    at, seen, word = line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        yield word
        at = line.find(phrase, at + 1)


def scan_text(text: str | None, phrases: Iterable[tuple[str, str]],
              templates: tuple[tuple[str, str], ...]) -> tuple:
    words = license_words(text)
    line = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases:
        found = list(_places(line, b" " + phrase.encode() + b" "))
        if found:
            starts += found
            base.add(label)
    starters = compiled(templates)
    labels, score = set(base), 0.0
    for at, word in enumerate(words):
        for label, automaton in starters.get(word, ()):
            if label not in labels:
                met, accepted = automaton.match(words, at)
                score = max(score, met / automaton.mandatory)
                if accepted:
                    labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text",
                  phrases: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: places of fixed phrases, labels and a score.

    A template is accepted where all of its mandatory words, from the first to the last, stand in
    order with nothing between them but what its markup allows; a text that alters a later clause is
    not. ``score`` is the best share of a template's mandatory words met in order from where it
    begins, 1 if one is accepted. A narrow map over whole texts, without a shuffle. Null and empty texts have no
    words, no labels (empty strings), null places and score 0; repeated rows and null ids come back
    as they are; an empty table gives no rows. Other columns are not read.
    """
    fixed = tuple((PHRASES if phrases is None else phrases).items())
    marked = tuple((TEMPLATES if templates is None else templates).items())

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scan_text(t, fixed, marked) for t in texts]
        names = [part.split()[0] for part in RESULT.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64",
                             "n_base": "int64", "base_labels": "object", "labels": "object",
                             "score": "float64"})

    return (docs.select(F.col(id), scan(F.col(text)).alias("found"))
            .select(id, "found.*"))
