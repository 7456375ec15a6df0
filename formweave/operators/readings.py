"""Lines of pages read one after another: what each distinct line means is found once, and a page is a walk over its lines.

The rules are those of `pages`, `matching` and `text`, stated there for columns.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from formweave.functions.text import EDGE

# White space of any script, and how many distinct lines a worker remembers.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
REMEMBERED = 50_000
_ALNUM = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def normalize_label(s: str) -> str:
    return re.sub("[^a-z0-9]+", "", s.lower())


def clean_value(s: str | None) -> str:
    return BLANK.sub(" ", s or "").strip(" ")


def form_text(v: str, furniture: bool) -> bool:
    n = len(v.split(" ")) if v else 0
    if len(v) < 2 or v.endswith("?") or re.fullmatch("[0-9]{1,2}", v) or n >= 8 or (n >= 5 and v[-1] in ".:;") or furniture:
        return True
    bare = re.sub("^[0-9]{1,2} +", "", v)
    return len(bare.split(" ")) >= 3 and not any(c.isdecimal() for c in bare) and any(c.isalpha() for c in bare) and not any(unicodedata.category(c) == "Ll" for c in bare)


def has_context(haystack: str, needle: str, runs: list[str]) -> bool:
    return needle in haystack or any(r in haystack for r in runs)


def context_runs(needle: str, least: int = 8, share: int = 7) -> list[str]:
    """The runs of a phrase that stand for it."""
    k = math.ceil(len(needle) * share / 10)
    return [needle[i : i + k] for i in range(len(needle) - k + 1)] if len(needle) >= least else []


class Reader:
    """Reads pages with a dictionary of (alias_norm, keyword, ord), contextual rows (label_norm, keyword, ord, context_norm) and kinds by keyword."""

    def __init__(self, plain: list[tuple], contextual: list[tuple], kinds: dict[str, str], threshold: float, selection_kinds: tuple, selection_tokens: tuple, prefix_words: int, value_lines: int) -> None:
        self.aliases = sorted({a for a, *_ in plain if a is not None})
        self.entries: dict[str, list[tuple]] = {}
        for a, k, o, c in [(*r, None) for r in plain] + contextual:
            if a is not None:
                self.entries.setdefault(a, []).append((-o, k, c))
        self.phrases = [(p, context_runs(p)) for p in sorted({c for *_, c in contextual if c})]
        self.anchored = {k for _, k, _, _ in contextual}
        self.kinds, self.threshold, self.least = kinds, threshold, min(threshold, 0.88)
        self.selection_kinds, self.selection_tokens, self.prefix_words, self.value_lines = selection_kinds, selection_tokens, prefix_words, value_lines
        self.names = sorted(self.entries)
        self.length = np.array([len(a) for a in self.names], np.int64)
        self.letters = np.array([self._counts(a) for a in self.names], np.int64).reshape(-1, len(_ALNUM))
        self.met: dict[str, tuple | None] = {}
        self.read: dict[str | None, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"met": {}, "read": {}}

    @staticmethod
    def _counts(norm: str) -> list[int]:
        out = [0] * len(_ALNUM)
        for c in norm:
            if c in _ALNUM:
                out[_ALNUM[c]] += 1
        return out

    def _asked(self, alias: str) -> float:
        return self.threshold if len(alias) < 12 else min(self.threshold, max(0.88, 1 - 2.5 / len(alias)))

    def meaning(self, label: str) -> tuple | None:
        """The keyword without a context, and the contextual entries near the label, the best first; None if there is neither."""
        norm = normalize_label(label)
        if not norm or not self.names:
            return None
        if norm not in self.met:
            if len(self.met) >= 4 * REMEMBERED:
                self.met.clear()
            self.met[norm] = self._meaning(norm)
        return self.met[norm]

    def _meaning(self, norm: str) -> tuple | None:
        near = np.flatnonzero(2 * np.minimum(self.length, len(norm)) >= self.least * (self.length + len(norm)))
        if not len(near):
            return None
        shared = np.minimum(self.letters[near], np.array(self._counts(norm))).sum(axis=1)
        plain, contextual = [], []
        for i in near[2 * shared >= self.least * (self.length[near] + len(norm))]:
            alias = self.names[i]
            score = SequenceMatcher(None, norm, alias).ratio()
            if score >= self.least:
                for o, keyword, context in self.entries[alias]:
                    (plain if context is None else contextual).append((score, o, keyword, score >= self._asked(alias), context))
        best = max(plain, key=lambda e: e[:4], default=None)
        keyword = best[2] if best and best[3] else None
        return (keyword, sorted(contextual, reverse=True)) if keyword is not None or contextual else None

    @staticmethod
    def _keyword(meaning: tuple | None, held: tuple[str, ...]) -> str | None:
        if meaning is None:
            return None
        best = next((e for e in meaning[1] if e[4] in held), None)
        return best[2] if best and best[3] else meaning[0]

    def _furniture(self, v: str) -> bool:
        n = normalize_label(v)
        if not n:
            return False
        if len(v) > 1 and v[0] == "(" and v[-1] == ")":
            return True
        return any(a == n or (len(a) >= 6 and a in n and len(a) >= 0.5 * len(n)) or (len(n) >= 8 and n in a) for a in self.aliases)

    def line(self, raw: str | None) -> tuple:
        """What a line is if no context decides, the norm of its text, and its parts."""
        found = self.read.get(raw)
        if found is None:
            if len(self.read) >= REMEMBERED:
                self.read.clear()
            found = self.read[raw] = self._line(raw)
        return found

    def _line(self, raw: str | None) -> tuple:
        line = clean_value(raw)
        whole, words = line.strip(EDGE), line.split(" ") if line else []
        tries = []
        if ":" in line:
            before, after = line.split(":", 1)
            tries.append((before.strip(" "), after))
        for n in range(min(len(words), self.prefix_words), 0, -1):
            tries.append((" ".join(words[:n]), " ".join(words[n:])))
        means = self.meaning(whole)
        captions = [(m, rest.strip(EDGE)) for label, rest in tries if (m := self.meaning(label)) is not None]
        captions = [(m, rest, self.meaning(rest)) for m, rest in captions]
        asks = any(m is not None and m[1] for m in (means, *(x for c in captions for x in (c[0], c[2]))))
        parts = (whole, self._furniture(whole), means, captions)
        return (None if asks else self._resolved(parts, ())), normalize_label(line), parts

    def _resolved(self, parts: tuple, held: tuple[str, ...]) -> tuple:
        """The text that may continue a value, the keyword, the rest behind the caption and whether it is furniture or printed."""
        whole, furniture, means, captions = parts
        printed = form_text(whole, furniture or self._keyword(means, held) is not None)
        follows = whole if whole and not printed else None
        for m, rest, rest_means in captions:
            keyword = self._keyword(m, held)
            if keyword is not None:
                set_ = self._furniture(rest) or self._keyword(rest_means, held) is not None
                return follows, keyword, rest, set_, form_text(rest, set_)
        return follows, None, "", False, False

    def _held(self, norms: list[str], most: int = 4) -> tuple[str, ...]:
        """The phrases that the fewest of the lines before hold, of those that hold one."""
        near = ""
        for norm in norms[: -most - 1 : -1]:
            near = norm + near
            if held := tuple(p for p, runs in self.phrases if has_context(near, p, runs)):
                return held
        return ()

    def page(self, lines: list[tuple], numbers: list) -> dict[str, str]:
        """keyword and value of a page whose lines are read."""
        read = [x[0] or self._resolved(x[2], self._held([y[1] for y in lines[max(0, i - 4) : i]])) for i, x in enumerate(lines)]
        out: dict[str, str] = {}
        for i, (_, keyword, rest, furniture, printed) in enumerate(read):
            if keyword is None or numbers[i] is None:
                continue
            kind = self.kinds.get(keyword) or "text"
            if rest == "" or furniture:
                under = []
                for x in read[i + 1 : i + 1 + (self.value_lines if kind == "text" else 1)]:
                    if x[0] is None:
                        break
                    under.append(x[0])
                value = " ".join(under)
            else:
                value = "" if printed else rest
            if value and (kind not in self.selection_kinds or value.strip(" ").upper() in self.selection_tokens):
                if keyword not in self.anchored or keyword not in out:
                    out[keyword] = value
        return out

    def pages(self, batches: Iterator[pa.RecordBatch], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """page columns (the first `width`), keyword and value, of rows sorted by page and line_no; a page may run over batches."""
        held = None
        for batch in batches:
            if batch.num_rows:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                starts = self._starts(held, width)
                if len(starts) > 1:
                    yield self._fields(held.slice(0, int(starts[-1])), starts, width, names)
                    held = held.slice(int(starts[-1]))
        if held is not None:
            yield self._fields(held, np.array([0, held.num_rows]), width, names)

    @staticmethod
    def _starts(rows: pa.RecordBatch, width: int) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in range(width):
            code = rows.column(k).dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def _fields(self, rows: pa.RecordBatch, bounds: np.ndarray, width: int, names: list[str]) -> pa.RecordBatch:
        texts = rows.column(width + 1).dictionary_encode("encode")
        read = [self.line(t) for t in texts.dictionary.to_pylist()]
        lines, numbers = [read[c] for c in texts.indices.to_pylist()], rows.column(width).to_pylist()
        at, keywords, values = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for keyword, value in self.page(lines[a:b], numbers[a:b]).items():
                at.append(a)
                keywords.append(keyword)
                values.append(value)
        taken = [rows.column(k).take(pa.array(at, pa.int64())) for k in range(width)]
        return pa.RecordBatch.from_arrays([*taken, pa.array(keywords, pa.string()), pa.array(values, pa.string())], [*names, "keyword", "value"])
