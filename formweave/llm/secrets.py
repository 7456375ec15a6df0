"""Secret scans: fixed patterns, and credential-context values judged by the cost of guessing them.

The guess cost of a value is the cheapest way to cut it into dictionary words, dates, repeats,
keyboard walks and brute-force spans, in bits: log2 of the guesses each piece takes, plus one bit
for each piece after the first. It is found by dynamic programming over the value's positions, so
`summer2024` is cheap and `xK9v0qLz7TmB` is not. Values after a credential word that cost at least
`min_bits` are reported as kind `guess`; the fixed patterns are reported whatever they cost.

The dictionary ranks the words of the documents themselves, whatever their language, by the number of
documents that hold them: words of 3 to 24 letters in at least MIN_WORD_DOCS documents, the MOST_WORDS
most frequent of them. Values after credential words are left out of the count, so that a copied secret
does not make itself a word. Fixed lists come before them. Words rarer than that cost brute force.

Defined cases: a null text is empty and has no spans. Offsets are code points, ends exclusive. Spans
with one start are listed by kind, then end; spans of different kinds may overlap. A value that holds a
credential word of its own is reported with what follows that word, as two spans. Words held by equally
many documents rank by their letters, and come into the dictionary or stay out together. Repeated rows
are scanned each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
Whole texts and values are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, utf8

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: A credential word, also behind an underscore or before one, then a separator or "is", at will a scheme word, then the value.
CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer|login)(?![A-Za-z0-9])"
    r"(?:[_-][A-Za-z0-9_-]{0,64})?[\"']?(?:[ \t]*(?::|=>|=|->)[ \t]*|[ \t]+is[ \t]+)[\"']?(?:(?:bearer|basic|token)[ \t]+[\"']?)?([^\s\"',;<>|]{6,})",
    re.I | re.A,
)
_HINTS = (b"pass", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"pwd", b"credential", b"auth", b"bearer", b"login", b"pin", b"_key", b"-key", b"accesskey", b"privatekey")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: Of 8 random letters and digits 99 % cost as much or more.
MIN_BITS = 30.0
#: Frequent parts of passwords, most frequent first.
COMMON_WORDS = (
    "password pass admin root user guest test login welcome secret letmein master monkey dragon qwerty hello love "
    "sunshine princess football baseball shadow michael jordan hunter batman superman trustno ninja mustang access "
    "summer winter spring autumn monday friday january march april june july august october december change default "
    "example sample demo token apikey your here none null true false changeme company server system public private "
    "black white green blue orange purple silver gold tiger lion eagle flower cookie coffee money happy lucky star"
).split()
#: Plain words that often follow a credential word, for corpora too small to count words in.
PLAIN_WORDS = (
    "the not required unavailable available invalid incorrect missing optional mandatory expired correct wrong needed necessary "
    "recommended confidential important unfortunately understanding simple safe secure stored encrypted generated provided "
    "given shown displayed hidden visible changed updated reset rejected accepted disabled enabled protected compromised "
    "different unique identical case sensitive currently temporarily only always never usually sometimes also still "
    "notwendig erforderlich ungültig falsch richtig abgelaufen verfügbar vertraulich geheim leider möglich unbekannt gesperrt "
    "erfolgreich fehlgeschlagen empfohlen geschützt verschlüsselt gespeichert nötig wichtig sicher "
    "requerido obligatorio inválido incorrecto necesario disponible confidencial secreto caducado desconocido recomendado importante "
    "guardado cifrado seguro diferente temporalmente "
    "obligatoire invalide incorrect nécessaire indisponible disponible confidentiel expiré inconnu recommandé important "
    "enregistré chiffré sécurisé différent temporairement malheureusement"
).split()
FIXED_RANKS = {w: i for i, w in reversed(list(enumerate([*COMMON_WORDS, *PLAIN_WORDS], 1)))}
#: The corpus dictionary: documents that hold a word at least, words kept at most, words that a task counts before it passes them on.
MIN_WORD_DOCS, MOST_WORDS, FLUSH_WORDS = 3, 200_000, 300_000
LONGEST_WORD = 24
_LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("013457@$", "oleastas")
_NEXT = {(r[i], r[i + d]) for r in ROWS for i in range(len(r)) for d in (1, -1) if 0 <= i + d < len(r)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)?\d\d")


def _rate(c: str) -> float:
    """Bits that one brute-forced character takes."""
    return math.log2(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33)


def guess_bits(value: str, ranks: dict[str, int] | None = None, longest: int | None = None) -> float:
    """The least number of bits over all segmentations of `value`; 0 for an empty one.

    Time is linear in the length but for the bounded word and date windows: runs extend the best
    cost at their first character.
    """
    ranks = ranks if ranks is not None else FIXED_RANKS
    longest = longest or max(map(len, ranks), default=0)
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # cheapest with a brute-force span open at the end
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    run = walk = 0
    for i in range(n):
        piece = best[i] + (i > 0)
        # brute force: extend the open span or start one; a change of character class takes half a bit more
        extend = brute[i] + _rate(value[i]) + 0.5 * (i > 0 and classes[i] != classes[i - 1])
        brute[i + 1] = min(extend, piece + _rate(value[i]))
        best[i + 1] = min(best[i + 1], brute[i + 1])
        # repeats and keyboard walks end at i and start where their run began
        run = run if i and value[i] == value[i - 1] else i
        if i - run >= 2:
            best[i + 1] = min(best[i + 1], best[run] + (run > 0) + _rate(value[i]) + math.log2(i - run + 1))
        walk = walk if i and (low[i - 1], low[i]) in _NEXT else i
        if i - walk >= 2:
            best[i + 1] = min(best[i + 1], best[walk] + (walk > 0) + _rate(value[walk]) + 1 + math.log2(i - walk + 1))
        # words and dates start at i
        for size in range(3, min(longest, n - i) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)):
                if rank := ranks.get(form[i : i + size]):
                    raw = value[i : i + size]
                    case = 0.0 if raw == low[i : i + size] else 1.0 if raw[:1].isupper() and raw[1:].islower() or raw.isupper() else size / 2
                    best[i + size] = min(best[i + size], piece + math.log2(rank + 1) + extra + case)
        if value[i] in "0123456789" and (m := _DATE.match(value[i : i + 10])):
            best[i + m.end()] = min(best[i + m.end()], piece + (7 if m.end() <= 4 else 11 if m.end() <= 7 else 15))
    return best[n]


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Where values stand after credential words; a value is itself searched for a credential word and its value."""
    m = CONTEXT.search(text)
    while m:
        yield m.span(1)
        m = CONTEXT.search(text, m.start(1))


def scan(text: str, min_bits: float = MIN_BITS, ranks: dict[str, int] | None = None, longest: int | None = None) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of one text, sorted by start, then kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    found += [(3, a, b) for a, b in contexts(text) if guess_bits(text[a:b], ranks, longest) >= min_bits]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _hinted(low: bytes) -> bool:
    return any(h in low for h in _HINTS)


def _without_values(text: str) -> str:
    out, last = [], 0
    for a, b in contexts(text):
        out.append(text[last : max(a, last)])
        last = max(b, last)
    return " ".join([*out, text[last:]])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n, the documents that hold it; a word may come several times."""
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        data, off = utf8(batch.column(0))
        for a, b in zip(off[:-1], off[1:], strict=True):
            raw = data[a:b].tobytes()
            text = raw.decode("utf-8", "replace")
            if _hinted(raw.lower()):
                text = _without_values(text)
            seen.update({w for w in _LETTERS.findall(text.lower()) if len(w) <= LONGEST_WORD})
            if len(seen) >= FLUSH_WORDS:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_ranks(docs: DataFrame, min_docs: int = MIN_WORD_DOCS, most: int = MOST_WORDS) -> dict[str, int]:
    """The rank of each dictionary word: the fixed lists, and the words of all documents by falling document count."""
    counts = map_arrow(docs.selectExpr("cast(text as string) text"), _word_counts, "word string, n bigint")
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs), "words")
    # words of one count come in or stay out together
    least, total = min_docs, 0
    for n, words in sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True):
        total += words
        if total > most:
            least = n + 1
            break
    got = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    ranks = {w: i for i, w in enumerate(got["word"].to_pylist(), 1)}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in FIXED_RANKS.items()}


def scan_documents(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans, and all spans, for every document."""
    ranks = word_ranks(docs)
    longest = max(map(len, ranks))
    none = hashlib.sha256(b"").hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            counts, digests, all_spans = ([], [], []), [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                raw = data[a:b].tobytes()
                low = raw.lower()
                spans = []
                if _hinted(low) or b"AKIA" in raw or b"h" * 32 in raw.translate(_HEX_MAP):
                    spans = scan(raw.decode("utf-8", "replace"), min_bits, ranks, longest)
                base = [s for s in spans if s[0] < 3]
                for k in range(3):
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else none)
                all_spans.append(written(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), rows, schema)
