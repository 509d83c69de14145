"""Matches of pattern rules in page texts, with their places and what stands around them, all rules in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.functions import rules

FOUND = T.StructType().add("rule", T.StringType()).add("field", T.StringType()).add("said", T.StringType()).add("confidence", T.IntegerType()).add("start", T.IntegerType()).add("end", T.IntegerType())
FOUND = FOUND.add("fragment", T.StringType()).add("prefix", T.StringType()).add("suffix", T.StringType())


@dataclass(frozen=True)
class Rule:
    """``said`` is what a match states of ``field``; null: the match itself.

    Every pattern is matched by itself. Of ``nearby``, if there are any, one must match in the match's surroundings, and none of
    ``without``. ``page_types``, if there are any, are those that the rule is for. ``parts``, if there are any, are bits of
    small letters of which a text that matches has one: cheap to look for first.
    """

    name: str
    field: str
    said: str | None
    confidence: int
    patterns: tuple[str, ...]
    nearby: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    page_types: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()


BUSINESS = [Rule(f"{f}:{str(v).lower()}", f, str(v).lower(), c, tuple(ps), parts=tuple(rules.BUSINESS_PARTS[f])) for f, v, c, ps in rules.BUSINESS_RULES]
WORDING = [Rule(f"{f}:{v}", f, v, c, tuple(ps), parts=tuple(rules.WORDING_PARTS[f])) for f, v, c, ps in rules.WORDING_RULES]
GROWTH = [Rule(f, f, None, c, tuple(ps), nearby=(near,) if near else (), parts=tuple(rules.GROWTH_PARTS[f])) for f, c, ps, near in rules.GROWTH_RULES]


class Finder:
    """Rules, compiled."""

    def __init__(self, of: list[Rule]):
        compiled = lambda ps: [re.compile(p, re.I) for p in ps]
        self.rules = [(r, compiled(r.patterns), compiled(r.nearby), compiled(r.without)) for r in of]

    def find(self, text: str, page_type: str | None = None, around: int = 200) -> list[tuple]:
        """(rule, start, end, match, before, behind) by rule, pattern and place; up to ``around`` characters before and behind."""
        out, low = [], text.lower()
        for rule, patterns, nearby, without in self.rules:
            if rule.page_types and page_type is not None and page_type not in rule.page_types or rule.parts and not any(x in low for x in rule.parts):
                continue
            for pattern in patterns:
                for m in pattern.finditer(text):
                    before, behind = text[max(0, m.start() - around) : m.start()], text[m.end() : m.end() + around]
                    window = f"{before} {m[0]} {behind}"
                    if any(p.search(window) for p in without) or nearby and not any(p.search(window) for p in nearby):
                        continue
                    out.append((rule, m.start(), m.end(), m[0], before, behind))
        return out


def pattern_matches(pages: DataFrame, of: list[Rule], text: str = "text", around: int = 200) -> DataFrame:
    """The columns of ``pages`` but the text, and those of ``FOUND``: a row for each match of each pattern of each rule.

    ``start`` and ``end`` count characters of the text; ``fragment`` is the match, ``prefix`` and ``suffix`` up to ``around`` characters before and
    behind it. A null text matches nothing. The rules are compiled once for each task, and every text is read once.
    """
    kept = [c for c in pages.columns if c != text]
    schema = T.StructType([pages.schema[c] for c in kept] + FOUND.fields)

    def run(batches):
        finder = Finder(of)
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            kinds = b.column(kept.index("page_type")) if "page_type" in kept else None
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                at, made = [], []
                for i, page in enumerate(part.column(len(kept))):
                    kind = kinds[first + i].as_py() if kinds is not None else None
                    for rule, start, end, match, before, behind in finder.find(page.as_py() or "", kind, around):
                        at.append(i)
                        made.append((rule.name, rule.field, match if rule.said is None else rule.said, rule.confidence, start, end, match, before, behind))
                rows = [c.take(pa.array(at, pa.int64())) for c in part.columns[:-1]]
                columns = zip(*made, strict=True) if made else [()] * len(types)
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], schema.names)

    return pages.select(*kept, text).mapInArrow(run, schema)
