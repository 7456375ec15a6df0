import random

import pytest

from formweave.llm import secrets


def guesses(text, **more):
    return [text[a:b] for k, a, b in secrets.scan(text, **more) if k == 3]


@pytest.mark.parametrize(
    "key", ["db_pwd=", "my_passphrase = ", "SSH_PASSPHRASE=", "aws_secret_access_key = ", "DB_PASSWORD=", "secret_key: ", "Authorization: Bearer ", "authorization: Basic ", '"Authorization": "Token ', "pwd="]
)
def test_keys_with_underscores_and_scheme_words(key):
    for value in ("xK9v0qLz7TmBw2!", "p#x9!qLz@7Tm"):
        assert guesses(f"x {key}{value} y") == [value]
    assert guesses("bypass: xK9v0qLz7TmBw2") == []


def test_eight_random_characters_are_reported():
    rng = random.Random(3)
    values = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8)) for _ in range(1000)]
    assert sum(guesses(f"pwd: {v}") == [v] for v in values) >= 975
    assert guesses("pwd: summer2024") == guesses("pwd: password1") == guesses("pwd: 19841984") == []


PROSE = [
    "the login is unfortunately unavailable today", "your secret is confidential. really", "the secret is understanding people", "login is unavailable", "the pin is recommended",
    "das Passwort: password is Selbstverständlichkeit", "el token: extraordinariamente largo", "le secret: particulièrement bien",
]


def test_plain_words_after_a_credential_word_give_no_span(spark):
    texts = [*PROSE, "password is xkqvzjwptgbf", "nobody said that password is xkqvzjwptgbf", "again password is xkqvzjwptgbf", "pwd: xK9v0qLz7TmBw2"]
    # each plain word stands in other documents as well, in other places
    texts += ["unfortunately confidential understanding unavailable recommended Selbstverständlichkeit extraordinariamente particulièrement"] * secrets.MIN_WORD_DOCS
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_documents(rows).collect()}
    n = len(PROSE)
    assert [d for d, s in got.items() if s and "guess" in s] == [n, n + 1, n + 2, n + 3]


def test_word_ranks_are_bounded_by_documents_and_number(spark):
    rows = spark.createDataFrame([(i, "alphaword " * 3 + ("betaword " if i < 4 else "") + ("gammaword" if i < 3 else "") + (" deltaword" if i < 2 else "")) for i in range(6)], "doc_id bigint, text string")
    words = lambda **k: [w for w in ("alphaword", "betaword", "gammaword", "deltaword") if w in secrets.word_ranks(rows, **k)]
    assert words() == ["alphaword", "betaword", "gammaword"] and words(most=2) == ["alphaword", "betaword"]
    ranks = secrets.word_ranks(rows)
    assert ranks["alphaword"] == 1 and ranks["password"] == 1 and secrets.word_ranks(rows.limit(0)) == secrets.FIXED_RANKS
