"""Licence passages: windows of words that are close to a licence notice, header or body, wherever lines break.

A window's score is that of license_scan: the Dice coefficient of the distinct
word bigrams. A window that reaches `least` holds least / (2 - least) of a
template's bigrams at least, which few texts do; only those are searched. The
best window begins and ends with bigrams of its template, so for each such
start every end is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import license_scan
from postmill.llm.storage import bounded_batches, lean

WORD = re.compile(r"[^\W_]+")
#: Titles, which only whole lines are compared to: within a sentence so few words name a licence without granting it.
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3"],
    "Apache-2.0": ["Apache License Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU General Public License Version 2"],
    "GPL-3.0": ["GNU General Public License Version 3"],
    "ISC": ["ISC License", "The ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(text: str) -> frozenset[tuple[str, str]]:
    w = words_of(text)
    return frozenset(zip(w, w[1:]))


@cache
def texts() -> tuple[list[tuple[str, frozenset]], list[tuple[str, frozenset]]]:
    """(licence, bigrams) of the bodies and of the headers beside this module: NAME.txt and NAME.header.txt."""
    found: tuple[list, list] = [], []
    for p in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        name = p.name.removesuffix(".txt")
        found[name.endswith(".header")].append((name.removesuffix(".header"), _grams(p.read_text())))
    return found


def _without(free: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs `free` of bigrams without those that `taken` covers or shares a word with."""
    for x, y in taken:
        free = [r for low, high in free for r in ((low, min(high, x - 1)), (max(low, y + 1), high)) if r[0] < r[1]]
    return free


def _best_windows(of: np.ndarray, before: np.ndarray, hit: np.ndarray, low: int, high: int, b: int, least: float) -> list[tuple[float, int, int]]:
    """(-dice, start, end) for each start in [low, high) at which a window reaches `least`: its best, the shortest of equal ones."""
    out = []
    need, most = b * least / (2 - least), b * (2 - least) / least
    starts = low + np.flatnonzero(hit[low:high])
    if len(np.unique(of[starts])) < need:
        return out
    for s in starts:
        n = 2 * b
        while True:
            stop = min(high, s + n)
            new = before[s:stop] < s
            a = np.cumsum(new)
            if stop == high or a[-1] > most:
                break
            n *= 2
        both = np.cumsum(new & hit[s:stop])
        if both[-1] < need:
            continue
        dice = 2 * both / (a + b)
        e = int(np.argmax(dice))
        if round(float(dice[e]), 6) >= least:
            out.append((-float(dice[e]), int(s), int(s) + e + 1))
    return out


def _chosen(family: list[tuple[str, frozenset]], of: np.ndarray, before: np.ndarray, known: dict, free: list[tuple[int, int]], least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, dice) of windows that do not overlap, best first, within the runs `free` of bigrams."""
    present = [(name, t, np.array([g in t for g in known])[of]) for name, t in family if len(t & known.keys()) >= len(t) * least / (2 - least)]
    found = []
    while free and present:
        ranked = sorted((d, name, s, e) for low, high in free for name, t, hit in present for d, s, e in _best_windows(of, before, hit, low, high, len(t), least))
        taken: list[tuple[int, int]] = []
        for d, name, s, e in ranked:
            if all(e < x or s > y for x, y in taken):
                taken.append((s, e))
                found.append((s, e, name, -d))
        # What lies beside the windows just taken is searched again.
        touched = [r for r in free if any(r[0] <= s < r[1] for s, _ in taken)]
        free = _without(touched, taken)
    return found


def passages_of(text: str, templates: dict[str, str], least: float) -> list[tuple[int, str, float]]:
    """(line in which it begins, licence, dice) of each passage; see :func:`passages`."""
    lines = [words_of(x) for x in text.split("\n")]
    words = [w for x in lines for w in x]
    grams = list(zip(words, words[1:]))
    if not grams:
        return []
    line_of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    known: dict[tuple[str, str], int] = {}
    of = np.array([known.setdefault(g, len(known)) for g in grams])
    last, before = np.full(len(known), -1), np.empty(len(of), np.int64)
    for k, x in enumerate(of):
        before[k], last[x] = last[x], k
    dice = lambda own, t: round(2 * len(own & t) / (len(own) + len(t)), 6)
    notices = [(k, g) for k, v in sorted(templates.items()) if (g := _grams(v))]
    titles = [(name, _grams(t)) for name, all_ in sorted(TITLES.items()) for t in all_]

    out, named, at = [], [], 0  # named: lines that license_scan finds, and titles
    for k, x in enumerate(lines):
        own = frozenset(zip(x, x[1:]))
        best = max(((dice(own, t), name) for name, t in titles), key=lambda p: p[0]) if own else (0.0, "")
        if own and any(dice(own, t) >= least for _, t in notices):
            named.append((at, at + len(x) - 1))
        elif best[0] >= least:
            named.append((at, at + len(x) - 1))
            out.append((k + 1, best[1], best[0]))
        at += len(x)
    whole = len(lines) > 1 and any(dice(known.keys(), t) >= least for _, t in notices)
    free = [(0, len(grams))]
    for family in texts():
        found = _chosen(family, of, before, known, free, least)
        out += [(int(line_of[s]) + 1, name, round(d, 6)) for s, _, name, d in found]
        free = _without(free, [x[:2] for x in found])
    if not whole:
        out += [(int(line_of[s]) + 1, name, round(d, 6)) for s, _, name, d in _chosen(notices, of, before, known, _without(free, named), least)]
    return out


def _search(templates: dict[str, str], least: float):
    small = [g for v in templates.values() if (g := _grams(v))] + [_grams(t) for all_ in TITLES.values() for t in all_]
    every = small + [t for family in texts() for _, t in family]
    of: dict[tuple[str, str], list[int]] = {}
    for k, t in enumerate(every):
        for g in t:
            of.setdefault(g, []).append(k)
    need = [len(t) * least / (2 - least) for t in every]

    def possible(text: str) -> bool:
        w = words_of(text)
        count = [0] * len(need)
        for g in of.keys() & zip(w, w[1:]):
            for k in of[g]:
                count[k] += 1
        return any(c >= n for c, n in zip(count, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, t in enumerate(batch.column(1).to_pylist()) if t and possible(t) for x in passages_of(t, templates, least)]
            if rows:
                k, unit, name, dice = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(unit, pa.int32()), pa.array(name), pa.array(dice, pa.float64())], names=[batch.schema.names[0], "unit", "license", "dice"])

    return run


def passages(docs: DataFrame, templates: dict[str, str] = license_scan.TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", least: float = license_scan.LEAST_DICE) -> DataFrame:
    """(id, unit, license, dice) of what :func:`license_scan.scan` misses, with the line in which it begins as unit.

    Lines that are titles, and windows of words that do not overlap: close to
    the body of a licence, then to a header in what is left, then to one of
    `templates` outside lines and texts that the scan finds. Of one kind the
    best is taken first, equal ones by name.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(_search(templates, least)), f"`{id_col}` {kind}, unit int, license string, dice double")
