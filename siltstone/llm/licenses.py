"""Licence scans: templates with optional and replaceable regions, compiled into token automata.

A template is wording with markup. Outside of marked regions every word must stand where the template has it;
``<<beginOptional>>`` ... ``<<endOptional>>`` (nested at will) may be missing, and a ``<<var;...>>`` region takes what its ``match`` says:
``.{a,b}`` any a to b words, or one of several wordings divided by ``|`` (an empty one: nothing). Compiled,
a template is a non-deterministic automaton over words that is made deterministic as far as texts ask for
it: a set of its states and a word give the next set once, and all words that a set does not name share one way.
A phrase is a template without regions.

A template is looked for in the words of a whole text, wherever its first mandatory words stand; from each of these places
the automaton runs on for as long as a longer match may come, which the template bounds. So time grows with the text alone.
Regions that may be empty say nothing at the beginning of a template and are left out there; at its end they make a match longer.

Defined cases: a null, empty or wordless text has no words, no matches and a score of 0; every place of a repeated or overlapping phrase
counts; very long texts are scanned whole, from words of about 1 MiB of text at a time; repeated rows get equal results; a null key is a key
like any other; an empty table gives an empty result; other columns stay, but one named like the result is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.license_templates import PHRASES, TEMPLATES
from siltstone.llm.resample import FOLD, stretches
from siltstone.llm.resident import cleaned, enter
from siltstone.llm.textbytes import flat, pieces

_MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:;(?:name|original|match)="[^"]*")*)>>')
_COUNT = re.compile(r"\.\{(\d+),(\d+)\}")
_PLACE = T.StructType().add("label", T.StringType()).add("phrase", T.BooleanType()).add("first", T.LongType()).add("end", T.LongType())
RESULT = T.StructType().add("n_words", T.LongType()).add("places", T.ArrayType(_PLACE)).add("score", T.DoubleType())


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def parse(markup: str) -> list[tuple]:
    """The regions of a template: ("word", w), ("optional", regions), ("any", a, b) or ("one", wordings)."""
    stack: list[list[tuple]] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += [("word", w) for w in words_of(markup[at : m.start()])]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            said = dict(re.findall(r'(\w+)="([^"]*)"', m[2])).get("match")
            if said is None:
                raise ValueError("a replaceable region needs a match")
            count = _COUNT.fullmatch(said)
            stack[-1].append(("any", int(count[1]), int(count[2])) if count else ("one", [words_of(x) for x in said.split("|")]))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0] + [("word", w) for w in words_of(markup[at:])]


def _may_be_empty(region: tuple) -> bool:
    return region[0] == "optional" or region[0] == "any" and region[1] == 0 or region[0] == "one" and [] in region[1]


class Template:
    """A compiled template. ``lead``: its first mandatory words."""

    def __init__(self, label: str, markup: str, phrase: bool = False):
        self.label, self.phrase = label, phrase
        regions = parse(markup)
        while regions and _may_be_empty(regions[0]):
            regions.pop(0)
        if not regions or regions[0][0] != "word":
            raise ValueError(f"a template must begin with mandatory wording: {markup[:60]!r}")
        n = next((i for i, r in enumerate(regions) if r[0] != "word"), len(regions))
        self.lead = b" " + b" ".join(r[1] for r in regions[:n]) + b" "
        self._steps: list[tuple[dict, list, list]] = []  # by word, by any word, without one
        self._end = self._state()
        begin = self._chain(regions, self._end)
        self._sets: dict[frozenset, int] = {}
        self._members: list[frozenset] = []
        self._named: list[frozenset] = []
        self._next: list[dict] = []
        self.begin = self._set({begin})

    def _state(self) -> int:
        self._steps.append(({}, [], []))
        return len(self._steps) - 1

    def _chain(self, regions: list[tuple], to: int) -> int:
        for region in reversed(regions):
            to = self._region(region, to)
        return to

    def _region(self, region: tuple, to: int) -> int:
        """The state from which ``region`` leads to the state ``to``."""
        here = self._state()
        word, some, free = self._steps[here]
        if region[0] == "word":
            word[region[1]] = [to]
        elif region[0] == "optional":
            free += [self._chain(region[1], to), to]
        elif region[0] == "one":
            free += [self._chain([("word", w) for w in x], to) for x in region[1]]
        else:
            after = to
            for k in range(region[2], 0, -1):  # the k-th word of at most region[2]
                at = self._state()
                self._steps[at][1].append(after)
                if k - 1 >= region[1]:
                    self._steps[at][2].append(to)
                after = at
            free.append(after)
        return here

    def _set(self, states: set[int]) -> int:
        """The number of the set of what ``states`` reach without a word."""
        todo, found = list(states), set(states)
        while todo:
            for s in self._steps[todo.pop()][2]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        key = frozenset(found)
        if key not in self._sets:
            self._sets[key] = len(self._members)
            self._members.append(key)
            self._named.append(frozenset(w for s in key for w in self._steps[s][0]))
            self._next.append({})
        return self._sets[key]

    def step(self, at: int, word: bytes) -> int:
        """The set after ``word``, or -1."""
        word = word if word in self._named[at] else b""
        known = self._next[at]
        if word not in known:
            to = {x for s in self._members[at] for x in [*self._steps[s][0].get(word, ()), *self._steps[s][1]]}
            known[word] = self._set(to) if to else -1
        return known[word]

    def longest(self, text: bytes, start: int) -> int:
        """How many words of ``text`` (a blank before and after each, a line feed after the last) from the blank at ``start`` on match; 0: none."""
        at, n, found = self.begin, 0, 0
        while True:
            to = text.index(b" ", start + 1)
            word = text[start + 1 : to]
            if word == b"\n" or (at := self.step(at, word)) < 0:
                return found
            n, start = n + 1, to
            if self._end in self._members[at]:
                found = n


@lru_cache(maxsize=4)
def _compiled(templates: tuple, phrases: tuple) -> list[Template]:
    return [Template(label, x, True) for label, x in phrases] + [Template(label, x) for label, x in templates]


cleaned(_compiled.cache_clear)


def places(text: bytes, templates: list[Template]) -> list[tuple[int, Template, int]]:
    """(where, template, how many words) of all matches; ``where`` is the place of the blank before the first word."""
    found = []
    for t in templates:
        at = text.find(t.lead)
        while at >= 0:
            n = t.longest(text, at)
            if n:
                found.append((at, t, n))
            at = text.find(t.lead, at + 1)
    return sorted(found, key=lambda x: x[0])


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, text: str = "text", result: str = "licenses") -> DataFrame:
    """The columns of ``docs`` and the struct ``licenses``: n_words, places and score.

    A place is (label, phrase, first, end): whether it is one of a phrase or a template, and its words [first, end), in order. The score is the
    share of the text's words that lie in any place, 0 to 1.
    """
    kept = [c for c in docs.columns if c != result]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in kept]).add(result, RESULT)
    rules = tuple(map(tuple, templates)), tuple(map(tuple, phrases))
    _compiled(*rules)  # an error in the markup shows here

    def run(batches):
        enter("licenses")
        compiled = _compiled(*rules)
        for b in pieces(batches, "__text"):
            buf, offsets = flat(b.column(b.num_columns - 1))
            folded, ends = buf.tobytes().translate(FOLD), offsets.tolist()
            parts, n_words = [], []
            for row in range(b.num_rows):
                n = 0
                for piece in stretches(folded[ends[row] : ends[row + 1]]):
                    words = piece.split()
                    n += len(words)
                    parts += [b" ", b" ".join(words)] if words else []
                parts.append(b" \n")
                n_words.append(n)
            joined = b"".join(parts) + b" "
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _result(joined, places(joined, compiled), n_words)], schema.names)

    return source.mapInArrow(run, schema)


def _result(joined: bytes, found: list, n_words: list[int]) -> pa.Array:
    """The result column of a slice, from the matches in its joined texts: `` w1 w2 \\n w1 \\n `` and so on."""
    rows = np.array(n_words, np.int64)
    base = np.concatenate([[0], np.cumsum(rows + 1)])  # each text has a blank before every word and one before its line feed
    column: list[list[dict]] = [[] for _ in n_words]
    score = np.zeros(len(rows))
    if found:
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        word = np.searchsorted(blanks, [at for at, _, _ in found])
        row = np.searchsorted(base, word, side="right") - 1
        covered = np.zeros(int(base[-1]) + 1, np.int64)
        for (_, t, n), w, r in zip(found, word.tolist(), row.tolist()):
            first = w - int(base[r])
            column[r].append({"label": t.label, "phrase": t.phrase, "first": first, "end": first + n})
            covered[w] += 1
            covered[w + n] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
        score = (inside[base[1:]] - inside[base[:-1]]) / np.maximum(rows, 1)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(RESULT)
    return pa.StructArray.from_arrays([pa.array(rows), pa.array(column, kinds.field("places").type), pa.array(score)], names=["n_words", "places", "score"])


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, scanned for the base phrases and all templates."""
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "licenses.*")
    base = F.filter("places", lambda p: p["phrase"])
    starts = F.transform(base, lambda p: p["first"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")

    return docs.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")
