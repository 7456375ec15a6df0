"""Column functions on captions, values and lines. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of values and marks, characters at a value's edges, and words that no name needs.
MONTHS = (
    "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December"
)
NUMERIC_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
WORD_DATE = rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{2,4}}\b"
ANY_DATE = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
MARK = "[Xx/✓✔☑☒]"
EDGE = " \t:;-_.•%*─—–"
FILLERS = (
    "a", "an", "and", "or", "the", "to", "of", "for", "in", "on", "at", "by", "with", "your", "my", "our", "if", "is", "are", "be", "please", "from",
    "any", "am", "do", "not", "i", "we", "that", "this", "shall", "will",
)
SELECTIONS = ("YES", "NO", "TRUE", "FALSE", "SELECTED", "UNSELECTED")
SELECTION_MARKS = ("- [x]", "- [ ]", "- (●)", "- ( )")


def normalize_label(c: Column) -> Column:
    """Lower case, ASCII letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def clean_value(c: Column) -> Column:
    """White space of any script collapsed and stripped; null is empty."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return F.btrim(one, F.lit(" "))


def strip_edges(c: Column) -> Column:
    return F.btrim(clean_value(c), F.lit(EDGE))


def before_colon(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def after_colon(c: Column) -> Column:
    return F.when(F.instr(c, ":") > 0, c.substr(F.instr(c, ":") + 1, F.length(c))).otherwise("")


def percent(c: Column) -> Column:
    """The first percentage, without blanks before the sign; empty if there is none."""
    number = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.when(number != "", F.concat(number, F.lit("%"))).otherwise("")


def date(c: Column) -> Column:
    """A numeric date if there is one, else one with a month's name."""
    return F.coalesce(F.nullif(F.regexp_extract(c, NUMERIC_DATE, 0), F.lit("")), F.regexp_extract(c, WORD_DATE, 0))


def camel_name(c: Column, most: int = 6) -> Column:
    """Words capitalised and joined; above `most` words, fillers go if others are left, and the first `most` stay."""
    words = F.filter(F.split(F.regexp_replace(c, r"\([^)]*\)", ""), "[^A-Za-z0-9]+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*FILLERS))
    chosen = F.when(F.size(words) <= most, words).otherwise(F.slice(F.when(F.size(telling) > 0, telling).otherwise(words), 1, most))
    return F.array_join(F.transform(chosen, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def slash_aliases(c: Column) -> Column:
    """The text with its multi-word parts, or its parts alone if all are single words and the text is printed in three words at most."""
    text = clean_value(c)
    parts = F.filter(F.transform(F.split(text, "/"), lambda p: F.trim(p)), lambda p: p != "")
    multi = F.filter(parts, lambda p: p.contains(" "))
    return F.when(F.size(parts) < 2, F.array(text)).when(F.size(multi) > 0, F.concat(F.array(text), multi)).when(word_count(text) <= 3, parts).otherwise(F.array(text))


def label_variants(c: Column) -> Column:
    """The label, the label without leading bullets and bracket groups, and its part before a colon: distinct, in order."""
    base = clean_value(c)
    bare = clean_value(F.regexp_replace(base, r"^(?:[•*\-]\s*|\[[^\]]*\]\s*|\([^)]*\)\s*)+", ""))
    return F.array_distinct(F.filter(F.array(base, bare, clean_value(before_colon(bare))), lambda v: v != ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(clean_value(c), " "), lambda w: w != ""))


def informative(c: Column) -> Column:
    v = clean_value(c)
    return (v != "") & ~v.startswith("#") & ~normalize_label(v).isin("", "yesno")


def prose(c: Column) -> Column:
    """Eight words or more, or five that end a sentence."""
    n = word_count(c)
    return (n >= 8) | ((n >= 5) & clean_value(c).rlike(r"[.:;]$"))


def value_like(c: Column) -> Column:
    """Filled-in data and no caption: nothing, no letters, or an amount of money."""
    v = F.trim(F.btrim(clean_value(c), F.lit(":")))
    return (v == "") | ~v.rlike("[A-Za-z]") | v.rlike(r"(?i)^(?:RM|MYR|USD|SGD|\$)\s*[\d.,]+$")


def option_noise(c: Column) -> Column:
    v = F.btrim(clean_value(c), F.lit(" .:-"))
    rest = normalize_label(F.regexp_replace(v, r"(?i)\b(?:YES|NO)\b", ""))
    return (F.length(v) < 3) | (F.length(rest) < 3)


def selection_value(c: Column) -> Column:
    """The text stands for a tick mark and nothing else."""
    return clean_value(c).isin(":selected:", ":unselected:")


def text_type(c: Column) -> Column:
    """Kind of field that a caption announces; the first that fits."""
    up = F.upper(c)
    return (
        F.when(up.rlike(r"\bDATE\b|DD[-/]MM|MM[-/]YY|\bDOB\b|\bBIRTH\b"), "date")
        .when(up.rlike(r"\bSIGNATURE\b"), "signature")
        .when(up.rlike(r"\bNO\.|NUMBER\b|\bAMOUNT\b|\bRM\b|\bCODE\b|%"), "number")
        .otherwise("text")
    )


def checked_statement(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rf"^\s*[-*•]?\s*\[{MARK}\]")


def yes_no(c: Column) -> Column:
    """YES, NO, BOTH or nothing, by the mark before or after the words; NO also begins NOT."""
    up = F.upper(c)
    yes = up.rlike(rf"\[{MARK}\]\s*YES|YES\s*\[{MARK}\]")
    no = up.rlike(rf"\[{MARK}\]\s*NO|NO\s*\[{MARK}\]")
    return F.when(yes & no, "BOTH").when(yes, "YES").when(no, "NO").otherwise("")


def has_context(haystack: Column, needle: Column, least: int = 8, share: int = 7) -> Column:
    """The needle is inside, or, from `least` characters on, a run of 7 tenths of it is."""
    n = F.length(needle)
    k = F.ceil(n * share / 10).cast("int")
    run = F.exists(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: haystack.contains(F.substring(needle, i, k)))
    return (n > 0) & (haystack.contains(needle) | ((n >= least) & run))


def tolerant_threshold(length: Column, threshold: float) -> Column:
    """Similarity asked of an alias: as given below 12 characters, else eased for one wrong glyph or two."""
    return F.when(length < 12, F.lit(threshold)).otherwise(F.least(F.lit(threshold), F.greatest(F.lit(0.88), 1 - 2.5 / length)))


def _first(rules: list[tuple], otherwise: tuple[float, str]) -> Column:
    out = None
    for test, score, reason in rules:
        value = F.struct(F.lit(score).alias("confidence"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(otherwise[0]).alias("confidence"), F.lit(otherwise[1]).alias("reason")))


def assess_value(value: Column, kind: Column) -> Column:
    """Confidence and reason of a value by its field's kind; the first rule that fits. The numbers and reasons are fixed values."""
    v = clean_value(value)
    selection = kind.isin("yesno", "checkbox", "option")
    return _first(
        [
            (v == "", 0.0, "not found"),
            ((kind == "date") & v.rlike(ANY_DATE), 0.95, "valid date format"),
            (kind == "date", 0.3, "date format not recognized"),
            ((kind == "number") & v.rlike(r"\b\d+(?:[.,]\d+)?\b"), 0.9, "valid numeric format"),
            (kind == "number", 0.3, "numeric format not recognized"),
            (selection & F.upper(v).isin(*SELECTIONS), 0.9, "checkbox selection"),
            (selection & v.isin(*SELECTION_MARKS), 0.9, "checkbox symbol"),
            (selection, 0.5, "non-standard checkbox value"),
            ((kind == "signature") & (F.length(v) >= 2), 0.8, "signature present"),
            (kind == "signature", 0.2, "signature too short"),
            (F.length(v) >= 3, 0.8, "text value captured"),
        ],
        (0.4, "text value too short"),
    )


def score_value(value: Column, kind: Column) -> Column:
    """The confidence alone."""
    return assess_value(value, kind)["confidence"]


def normalize_lines(c: Column) -> Column:
    """Lines stripped, blank ones dropped, line ends unified."""
    stripped = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda x: x != ""), "\n")


# Box glyphs and their task-list tokens, in the order in which they are tried, and patterns inside a text.
GLYPHS = (
    ("☑", "- [x]"), ("☒", "- [x]"), ("✓", "- [x]"), ("✔", "- [x]"), ("[x]", "- [x]"), ("[X]", "- [x]"), ("[V]", "- [x]"), ("[v]", "- [x]"), ("[/]", "- [x]"), ("\\\\", "- [x]"),
    ("(x)", "- (x)"), ("(X)", "- (x)"),
    ("☐", "- [ ]"), ("□", "- [ ]"), ("[ ]", "- [ ]"),
    ("●", "- (●)"), ("◉", "- (●)"), ("(●)", "- (●)"), ("(•)", "- (●)"),
    ("○", "- ( )"), ("◯", "- ( )"), ("( )", "- ( )"), ("(○)", "- ( )"),
)
GLYPH_PATTERNS = ((r"\[(?:V|v|/|\\|✓|✔)\]", "[x]"), (r"\[\s{0,4}\]", "[ ]"), (r"\(\s*[●•◉]\s*\)", "(●)"), (r"\(\s*[○◯]\s*\)", "( )"))


def task_tokens(c: Column) -> Column:
    """A text that is a glyph, or begins with one and a blank, becomes a task-list item; in others marks in brackets are unified."""
    line = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    inside = c
    for pattern, token in GLYPH_PATTERNS:
        inside = F.regexp_replace(inside, pattern, token)
    out = None
    for glyph, token in GLYPHS:
        rest = F.regexp_replace(line.substr(F.lit(len(glyph) + 1), F.length(line)), r"(?U)^\s+", "")
        for test, value in ((line == glyph, F.lit(token)), (line.startswith(glyph + " "), F.concat(F.lit(token + " "), rest))):
            out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(inside)


def percent_coordinate(value: Column, total: Column) -> Column:
    """Share of the total in percent, within 0 and 100, with three decimals."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * value / F.nullif(total, F.lit(0.0))))
    return F.when(total <= 0, "0.000").otherwise(F.format_string("%.3f", share))


def around(words: Column, at: Column, before: int = 6, after: int = 8) -> Column:
    """The words before position `at` (from 0), at most `before`, and those behind it, at most `after`."""
    left = F.slice(words, F.greatest(at - before + 1, F.lit(1)), F.least(at, F.lit(before)))
    return F.array_join(F.concat(left, F.slice(words, at + 2, F.lit(after))), " ")


def assess_strict(value: Column, kind: Column, options: tuple[str, ...] = ()) -> Column:
    """Confidence and reason in the stricter profile: ambiguous answers are low, unknown kinds 0.75. The numbers and reasons are fixed values.

    `options` are upper-cased labels of a document's options: one is a value of kind `document` and no value of others.
    The percent pattern asks for a word character behind the sign, as the rule it reproduces does, so a plain 40% is low.
    """
    v = clean_value(value)
    up = F.upper(v)
    return _first(
        [
            (v == "", 0.0, "not found"),
            (up == "BOTH", 0.35, "ambiguous yes/no selection"),
            ((kind == "document") & up.isin(*options), 0.85, "selected document option"),
            (up.isin("DATE", "YES NO", *options), 0.2, "looks like a label/option instead of a value"),
            ((kind == "date") & (date(v) != ""), 0.95, "valid date format"),
            (kind == "date", 0.25, "date format not recognized"),
            ((kind == "percent") & v.rlike(r"\b\d+(?:\.\d+)?%\b"), 0.95, "valid percent format"),
            (kind == "percent", 0.2, "percent format not recognized"),
            ((kind == "identifier") & v.rlike(r"(?i)\b[A-Z0-9-]{6,}\b"), 0.9, "alphanumeric identifier pattern"),
            (kind == "identifier", 0.35, "identifier pattern weak"),
            ((kind == "yesno") & up.isin("YES", "NO"), 0.9, "checkbox selection"),
            (kind == "yesno", 0.35, "non-standard checkbox value"),
            ((kind == "text") & (F.length(v) >= 3), 0.8, "text value captured"),
            (kind == "text", 0.3, "text value too short"),
        ],
        (0.75, "captured from matched label"),
    )


def score_strict(value: Column, kind: Column, options: tuple[str, ...] = ()) -> Column:
    """The confidence alone."""
    return assess_strict(value, kind, options)["confidence"]


def form_text(c: Column, furniture: Column) -> Column:
    """Printed text of a form: too short, a question, a small number, prose, furniture, or three words in capitals."""
    v = clean_value(c)
    bare = F.regexp_replace(v, r"^\d{1,2}\s+", "")
    capitals = (word_count(bare) >= 3) & ~bare.rlike(r"\p{Nd}") & bare.rlike(r"\p{L}") & ~bare.rlike(r"\p{Ll}")
    return (F.length(v) < 2) | v.endswith("?") | v.rlike(r"^\d{1,2}$") | prose(c) | furniture | capitals
