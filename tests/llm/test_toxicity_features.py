import numpy as np
import pyarrow as pa

from formweave.llm import toxicity
from formweave.llm.common import PUNCT, words


def hashes(texts):
    raw = " ".join(texts).encode()
    return words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, PUNCT).hash


def test_no_feature_loses_its_weight():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    h = np.append(h, h[:100] ^ np.uint64(1))  # two features that agree in their leading bits
    w = np.arange(1.0, len(h) + 1)
    assert (toxicity.Model.of(h, w, 0.0).weigh(h) == w).all()
    assert toxicity.Model.of(h, w, 0.0).weigh(np.array([5, h[0] + np.uint64(2)], np.uint64)).tolist() == [0, 0]


def test_feature_beside_a_frequent_neutral_one_is_learned():
    bad = "vilest"
    letters = np.random.default_rng(2).integers(97, 123, (1 << 23, 8), dtype=np.uint8)
    letters[:, -1] = 32
    raw = letters.tobytes()
    top = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, PUNCT).hash >> np.uint64(43)
    beside = np.flatnonzero(top == hashes([bad])[0] >> np.uint64(43))
    assert len(beside)
    neutral = letters[beside[0], :-1].tobytes().decode()
    texts = [f"{neutral} word{i % 7} more text. {bad if i % 4 == 0 else 'fine'} end." for i in range(200)]
    model = toxicity.fit(pa.array(texts), np.array([i % 4 == 0 for i in range(200)]))
    assert model.weigh(hashes([bad]))[0] > 0 and model.weigh(hashes([neutral]))[0] == 0


def loss(theta, bias, index, sents, doc, y, ridge):
    """Mean negative log likelihood, document by document."""
    total = 0.0
    for d, label in enumerate(y):
        none = 1.0
        for s in (s for s, own in enumerate(doc) if own == d):
            z = bias + sum(theta[f] for f, at in zip(index, sents, strict=True) if at == s)
            none *= 1 - 1 / (1 + np.exp(-z))
        total -= np.log(1 - none if label else none)
    return (total + ridge * (theta**2).sum() / 2) / len(y)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    doc = np.sort(rng.integers(0, 6, 20))
    index, sents = rng.integers(0, 5, 40), rng.integers(0, 20, 40)
    y = np.array([1.0, 0, 1, 0, 0, 1])
    theta, bias = rng.normal(0, 0.5, 5), -0.7
    got = toxicity._gradient(theta, bias, index, sents, doc, y, 0.1)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        up, down = (loss(theta + f * step[:5], bias + f * step[5], index, sents, doc, y, 0.1) for f in (1, -1))
        assert abs((up - down) / 2e-6 - got[k]) < 1e-5


def test_teaching_rows_are_bounded_by_bytes_and_one_for_each_id(spark):
    rows = [(i, f"text {i % 2} " * 10) for i in range(40) for _ in range(1 + (i == 5) * 30)] + [(5, "another text")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, _tx_id int, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    taught = [[r["text"] for r in toxicity.teaching_rows(df, labels, max_bytes=n).collect()] for n in (1 << 20, 400)]
    assert 20 < len(taught[0]) <= 40 and taught[0].count("another text") <= 1
    assert 0 < sum(map(len, taught[1])) <= 400
    assert toxicity.judge(df.limit(0), labels).count() == 0
