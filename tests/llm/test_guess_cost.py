import hashlib
import math
import random
import re

from formweave.llm import secrets

ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
RANKS = {"summer": 4, "sun": 30, "pass": 2, "password": 1, "word": 90, "test": 7}
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)?\d\d")


def rate(c):
    return math.log2(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33)


def kind(c):
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def piece_costs(p, end):
    """Costs of a piece as a whole, by all its readings; `end`: what follows it in the value."""
    out = [sum(map(rate, p)) + 0.5 * sum(kind(a) != kind(b) for a, b in zip(p, p[1:]))]
    low = p.lower()
    if len(p) >= 3 and len(set(p)) == 1:
        out.append(rate(p[0]) + math.log2(len(p)))
    step = [any(0 <= (i := r.find(a)) and b and (r[i + 1 : i + 2] == b or (i and r[i - 1] == b)) for r in ROWS) for a, b in zip(low, low[1:])]
    if len(p) >= 3 and all(step):
        out.append(rate(p[0]) + 1 + math.log2(len(p)))
    for form, extra in ((low, 0), ("".join(LEET.get(c, c) for c in low), 1)):
        if form in RANKS:
            case = 0 if p == low else 1 if (p[0].isupper() and p[1:].islower()) or p.isupper() else len(p) / 2
            out.append(math.log2(RANKS[form] + 1) + extra + case)
    m = DATE.match((p + end)[:10])
    if m and m.end() == len(p):
        out.append(7 if len(p) <= 4 else 11 if len(p) <= 7 else 15)
    return out


def plain_bits(value):
    """The least over all ways to cut the value, each tried."""
    best = math.inf
    for cuts in range(1 << (len(value) - 1)):
        at = [0, *(i + 1 for i in range(len(value) - 1) if cuts >> i & 1), len(value)]
        best = min(best, sum(min(piece_costs(value[a:b], value[b:])) for a, b in zip(at, at[1:])) + len(at) - 2)
    return best


def test_cost_is_the_least_over_all_segmentations():
    rng = random.Random(5)
    parts = ["summer", "Sun", "p4ss", "PASSWORD", "aaa", "qwe", "2024", "19990101", "xK9", "!!", "tEst", "1", "zx", "31.12.99"]
    for _ in range(60):
        value = "".join(rng.choices(parts, k=3))[:11]
        # runs are read up to their first character, so the value's own program may only be cheaper where both agree
        assert abs(secrets.guess_bits(value, RANKS) - plain_bits(value)) < 1e-9


def test_values_inside_values_are_found():
    text = "my password is token: xK9v0qLz7TmBw2 and on"
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == 3] == ["xK9v0qLz7TmBw2"]
    assert [(a, b) for a, b in secrets.contexts("pwd=secret=xK9v0qLz7TmB")] == [(4, 23), (11, 23)]


def plain_base(text):
    """The base spans by hand: every place is tried in turn."""
    out = []
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for n in names:
            if "".join(c.lower() if c.isascii() else c for c in text[i : i + len(n)]) != n:
                continue
            j = i + len(n)
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                end = (k, k - j)
                break
        if end:
            if end[1] >= 8:
                out.append((i, 0, end[0]))
            i = end[0]
        else:
            i += 1
    for mark, kind_, chars, least, skip in (("AKIA", 1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16, 4), ("", 2, set("0123456789abcdef"), 32, 0)):
        i = 0
        while i < len(text):
            j = i + skip
            if text.startswith(mark, i) and text[j : j + 1] in chars and j < len(text):
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - i >= least:
                    out.append((i, kind_, j))
                i = j
            else:
                i += 1
    return sorted(out)


def test_base_spans_match_a_scan_by_hand(spark):
    rng = random.Random(8)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", " : ", ":", '"', "'", " ", "abcdefgh", "x1/+_.=-", "AKIA", "ABCDEF0123456789", "0af9" * 9, "é", "ſ", "\n", "short", "token=", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, n_hex int")
    got = {r["doc_id"]: r for r in secrets.scan_documents(df).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == [s for s in said.split(",") if s]
