"""License scans by patience alignment.

A text is held against license templates word by word (lower case, without
punctuation at either end). Words that occur exactly once in the text and once in
the template are anchors; the longest increasing subsequence of their places is
aligned; what lies between two aligned words on both sides is aligned again in the
same way, where more words are unique. Coverage is the share of the template's
words that are aligned.

A template of n words is looked for in every window of `spread` * n words (rounded
up) of the text or fewer: its words may have that many foreign ones among them, but not
lie scattered over a long text. Windows that begin and end at words of the template
are all there are to look at, as foreign words at an end align with nothing. A window
that holds too few of the template's words, counted with their repeats, to reach the
limit or to beat the best one so far is skipped, and so are those inside it from the
same place; that bound is exact. The best window counts, the first of equals.

A window that holds a notice twice has few anchors or none. Where the alignment
finds fewer words than the window's bound allows, the window is also cut at repeated
words: around each occurrence of a word of the template, up to its neighbouring
occurrences, lies a span in which that word is unique. The word is taken as an anchor
and the span aligned on both sides of it; spans that can't give more are skipped.

Plan: one scan and one Arrow map, no shuffle; templates are a bounded table of
fixed texts. Memory is one piece of an Arrow batch plus the word table of one text.

Defined results: a null or empty text matches nothing; a text that matches no
template has no row in `license_matches`, and one row with n_licenses 0 in
`license_scan`; a template without a word matches nothing; templates are reported in
order of their names; rows that repeat an id are scanned one by one; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.llm.common import per_batch
from simvane.llm.license_texts import TEMPLATES

LIMIT = 0.85
SPREAD = 2.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>*#&|$%"


def folded(text: str) -> list[str]:
    """Words in lower case without punctuation at either end; words of punctuation alone are left out."""
    return [w for x in _WORD.findall(text) if (w := x.strip(_EDGE).lower())]


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    at: dict[str, int] = {}
    for i in range(lo, hi):
        at[words[i]] = -1 if words[i] in at else i
    return at


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ascending in the first place, that ascends in the second too."""
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = top[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            top.append(i)
        else:
            tails[k], top[k] = b, i
    out, i = [], top[-1] if top else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = _once(text, a, b), _once(template, c, d)
        anchors = sorted((i, theirs[w]) for w, i in mine.items() if i >= 0 and theirs.get(w, -1) >= 0)
        if not anchors:
            continue
        run = _increasing(anchors)
        out += run
        for (i, j), (x, y) in zip([(a - 1, c - 1), *run], [*run, (b, d)], strict=True):
            if i + 1 < x and j + 1 < y:
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def windows(words: list[str], places: list[int], counts: Mapping[str, int], width: int) -> Iterator[tuple[int, int, int]]:
    """(first, after last, bound) of the window of `width` words from each of places, those of template words; bound: how many words of the template the window holds."""
    held: Counter[str] = Counter()
    bound, k = 0, 0
    for i in places:
        while k < len(places) and places[k] < i + width:
            w = words[places[k]]
            held[w] += 1
            bound += held[w] <= counts[w]
            k += 1
        yield i, min(i + width, len(words)), bound
        bound -= held[words[i]] <= counts[words[i]]
        held[words[i]] -= 1


def spans(text: list[str], template: list[str], counts: Mapping[str, int]) -> Iterator[tuple[int, int, int, int]]:
    """(first, anchor, after last, anchor in the template) around each occurrence of a template word that stands in the text more often than in the template, cut at its neighbouring occurrences."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        if w in counts:
            at.setdefault(w, []).append(i)
    seen: Counter[str] = Counter()
    for j, w in enumerate(template):
        here, before = at.get(w, []), seen[w]
        seen[w] += 1
        if len(here) <= counts[w]:
            continue
        after = counts[w] - before - 1
        for k, i in enumerate(here):
            lo = here[k - before - 1] + 1 if k > before else 0
            hi = here[k + after + 1] if k + after + 1 < len(here) else len(text)
            yield lo, i, hi, j


def aligned(text: list[str], template: list[str], counts: Mapping[str, int], most: int, enough: float) -> list[tuple[int, int]]:
    """The alignment of the whole text or of one of its spans, whichever has the most words; `most` is its bound, and spans below `enough` are skipped."""
    best = patience(text, template)
    if len(best) >= most:
        return best
    n = len(template)
    for lo, i, hi, j in spans(text, template, counts):
        least = max(enough, len(best) + 1)
        if min(i - lo, j) + 1 + min(hi - i - 1, n - j - 1) < least:
            continue
        left, right = Counter(text[lo:i]), Counter(text[i + 1 : hi])
        if sum(min(c, left[w]) for w, c in Counter(template[:j]).items()) + 1 + sum(min(c, right[w]) for w, c in Counter(template[j + 1 :]).items()) < least:
            continue
        run = [(lo + x, y) for x, y in patience(text[lo:i], template[:j])] + [(i, j)] + [(i + 1 + x, j + 1 + y) for x, y in patience(text[i + 1 : hi], template[j + 1 :])]
        if len(run) > len(best):
            best = run
            if len(best) >= most:
                break
    return best


def scan_text(text: str, templates: Mapping[str, list[str]], limit: float, spread: float = SPREAD) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, aligned words, first word, after last word in the folded text) of each template that covers `limit` or more."""
    words = folded(text)
    out = []
    have = set(words)
    for name, template in templates.items():
        n = len(template)
        counts = Counter(template)
        if not n or sum(c for w, c in counts.items() if w in have) < limit * n:
            continue
        best = (0, 0, 0)
        places = [i for i, w in enumerate(words) if w in counts]
        for a, b, most in windows(words, places, counts, ceil(spread * n)):
            # shorter windows from the same place may have more unique words; each end at a template word is tried while its bound allows more
            held = Counter(w for w in words[a:b] if w in counts)
            last = bisect_left(places, b) - 1
            while most >= limit * n and most > best[0]:
                run = aligned(words[a : places[last] + 1], template, counts, most, limit * n)
                if len(run) > best[0]:
                    best = (len(run), a + run[0][0], a + run[-1][0] + 1)
                w = words[places[last]]
                most -= held[w] <= counts[w]
                held[w] -= 1
                last -= 1
            if best[0] == n:
                break
        if best[0] and best[0] >= limit * n:
            out.append((name, best[0] / n, *best))
    return out


MATCH = "struct<license:string,coverage:double,n_words:int,word_from:int,word_to:int>"
_FIELDS = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_words", pa.int32()), ("word_from", pa.int32()), ("word_to", pa.int32())])


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, limit: float = LIMIT, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_licenses, license (the first one by coverage, words, name), coverage, matches."""
    parsed = {name: folded(templates[name]) for name in sorted(templates)}

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        matches = [[dict(zip(("license", "coverage", "n_words", "word_from", "word_to"), m, strict=True)) for m in scan_text(x.as_py() or "", parsed, limit, spread)] for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(matches, pa.list_(_FIELDS))], names=["doc_id", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(per_batch(scan), f"doc_id {kind}, matches array<{MATCH}>")
    best = F.sort_array(F.transform("matches", lambda m: F.struct((-m["coverage"]).alias("c"), (-m["n_words"]).alias("n"), m["license"].alias("license"))))
    first = F.when(F.size("matches") > 0, best[0])
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), first["license"].alias("license"), (-first["c"]).alias("coverage"), "matches")


def license_matches(docs: DataFrame, **options) -> DataFrame:
    """One row for each match: doc_id, license, coverage, n_words, word_from, word_to."""
    return license_scan(docs, **options).select("doc_id", F.inline("matches"))
