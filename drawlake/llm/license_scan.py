"""License scan by patience alignment of texts with license templates.

Text and template are sequences of lower-cased words of letters and digits.  Words that occur once in both
are anchors; their longest increasing subsequence is aligned, and the gaps between neighbouring
anchors are aligned the same way.  A gap without anchors aligns its common head and tail, and what is left
of it a word at a time in order.  Coverage is the share of the template's words that are aligned.

Every template has marks, words without which a place is not this license (``license_texts``).  Each place of a
template's first mark in the text is an anchor; the text before and behind it, as far as the template reaches
with as many foreign words on either side as it has words, is aligned with the template's.  A place counts if

* at least ``MIN_COVERAGE`` of the template's words are aligned, all of them if the template is not longer than ``SHORT``,
* all marks are aligned,
* no other word that names a license stands between its aligned words (in a long template, next to its marks).

So a notice is found wherever it stands and whatever up to its own length of foreign words is written into
it, and a license that no template describes gets no name.  Texts are read whole, of any length; a place costs
its template's length.

Defined results: null and word-less texts have no license; of overlapping places the one with most aligned
words is reported, then the better covered, shorter, earlier one, then by name; repeated rows are scanned
each; an empty table gives no rows; columns other than the text are never read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, ship
from drawlake.llm.license_texts import NAMES, TEMPLATES, Template

#: Least share of a long template's words that must be aligned, words of a template that must be aligned whole,
#: and how near to a mark another license's name counts in a long template.
MIN_COVERAGE, SHORT, NEAR = 0.8, 12, 2
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and their places in code points."""
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[at], pile[at] = v, i
        back[i] = pile[at - 1] if at else -1
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of text ``a`` and template ``b``."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in place]
        if not anchors:
            at = a0
            for j in range(b0, b1):
                if b[j] in in_a:
                    try:
                        at = a.index(b[j], at, a1)
                    except ValueError:
                        continue
                    out.append((at, j))
                    at += 1
            continue
        chosen = [anchors[i] for i in increasing([i for i, _ in anchors])]
        out += chosen
        edges = [(a0 - 1, b0 - 1), *chosen, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:]) if q[0] - p[0] > 1 and q[1] - p[1] > 1]
    return sorted(out)


class _Prepared:
    """A template's words, its marks, and the place of the first one."""

    def __init__(self, name: str, template: Template, coverage: float):
        self.name, self.license, self.kind = name, template.license, template.kind
        self.words = words(template.text)[0]
        self.counts = Counter(self.words)
        wrong = [m for m in template.marks if self.counts[m] != 1]
        if wrong or not template.marks:
            raise ValueError(f"marks of template {name} must stand in it once: {wrong}")
        self.marks = [self.words.index(m) for m in template.marks]
        self.need = len(self.words) if len(self.words) <= SHORT else math.ceil(coverage * len(self.words) - 1e-9)


class Templates:
    """Places of licenses in texts, for a set of templates."""

    def __init__(self, templates: dict[str, Template] = TEMPLATES, coverage: float = MIN_COVERAGE, names: frozenset[str] = NAMES):
        self.rows = [_Prepared(name, t, coverage) for name, t in templates.items()]
        self.marks = {row.words[m] for row in self.rows for m in row.marks}
        self.names = names

    def _place(self, own: list[str], at: int, row: _Prepared) -> list[tuple[int, int]] | None:
        """The alignment of a template whose first mark stands at ``at`` of the text, if it counts."""
        mark, size = row.marks[0], len(row.words)
        low, high = max(0, at - mark - size), min(len(own), at + size - mark + size)
        window = Counter(own[low:high])
        if sum(min(n, window[w]) for w, n in row.counts.items()) < row.need:
            return None
        before = [(low + i, j) for i, j in align(own[low:at], row.words[:mark])]
        behind = [(at + 1 + i, mark + 1 + j) for i, j in align(own[at + 1:high], row.words[mark + 1:])]
        pairs = [*before, (at, mark), *behind]
        if len(pairs) < row.need or not {j for _, j in pairs}.issuperset(row.marks):
            return None
        aligned = {i for i, _ in pairs}
        inside = range(pairs[0][0], pairs[-1][0])
        if size > SHORT:
            marked = [i for i, j in pairs if j in row.marks]
            inside = [i for m in marked for i in range(m - NEAR, m + NEAR + 1) if i in inside]
        return None if any(own[i] in self.names and i not in aligned for i in inside) else pairs

    def find(self, text: str | None) -> list[dict]:
        """Places of license notices: ``license, template, kind, coverage, start, end`` in code points."""
        if not text:
            return []
        own = _WORD.findall(text.lower())
        present = self.marks.intersection(own)
        if not present:
            return []
        own, places = words(text)
        present = self.marks.intersection(own)
        spots: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            if w in present:
                spots.setdefault(w, []).append(i)
        best = []
        for row in self.rows:
            needed = [row.words[m] for m in row.marks]
            if not present.issuperset(needed):
                continue
            for at in spots[needed[0]]:
                if pairs := self._place(own, at, row):
                    best.append((len(pairs), len(pairs) / len(row.words), pairs[0][0], pairs[-1][0] + 1, row))
        found, taken = [], []
        for _, share, a, b, row in sorted(best, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2], x[4].name)):
            at = bisect_left(taken, (a, b))
            if (at == len(taken) or b <= taken[at][0]) and (not at or taken[at - 1][1] <= a):
                taken.insert(at, (a, b))
                found.append({"license": row.license, "template": row.name, "kind": row.kind, "coverage": share, "start": places[a][0], "end": places[b - 1][1]})
        return sorted(found, key=lambda x: x["start"])


_RESULT = pa.list_(pa.struct([("license", pa.string()), ("template", pa.string()), ("kind", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def licenses(text: Column, templates: dict[str, Template] = TEMPLATES, coverage: float = MIN_COVERAGE) -> Column:
    """The license notices of a text column."""
    ship(SparkSession.active())

    scan = Templates(templates, coverage)

    @F.arrow_udf("array<struct<license:string,template:string,kind:string,coverage:double,start:bigint,end:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scan.find(t.as_py()) for t in texts], _RESULT)

    return run(text)


def op3_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its notices: their number, the best covered one and all places."""
    rows = documents(spark, sf_dir).select("doc_id", licenses(F.col("text")).alias("found"))
    best = F.element_at(F.array_sort("found", lambda a, b: F.when(a["coverage"] != b["coverage"], F.signum(b["coverage"] - a["coverage"])).otherwise(
        F.when(a["end"] - a["start"] != b["end"] - b["start"], F.signum(b["end"] - b["start"] - a["end"] + a["start"])).otherwise(F.signum(a["start"] - b["start"]))).cast("int")), 1)
    rows = rows.withColumn("best", F.when(F.size("found") > 0, best))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_notices"), F.col("best.license").alias("license"), F.col("best.kind").alias("kind"),
                       F.col("best.coverage").alias("coverage"), spans.alias("spans"))
