"""Plans that hold on large tables: what their static sizes understate must not be broadcast."""

import os
import random
from statistics import median

import numpy as np
import pytest

from formweave.operators import images, ink, words
from formweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_are_not_joined_with_the_fields_of_marks(spark):
    assert "Join" not in plan_of(QUERIES["blank_mark_fields"](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_are_not_joined_with_the_answers_of_marks(spark):
    assert "Join" not in plan_of(QUERIES["box_answers"](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_words_and_marks_of_answers_meet_once_and_are_not_sorted_again(spark):
    df = QUERIES["box_answers"](spark, SF)
    assert "Window" not in plan_of(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_answers_agree_with_a_plain_reading_of_random_pages(spark):
    r, held, marks = random.Random(5), [], []
    for d in range(40):
        for p in (1, 2, 3)[: r.randint(1, 3)]:
            said = r.choices(["YES", "NO", "mail", "form", "a", " ", None], k=r.choice([0, 1, 3, 30]))
            held += [(d, p, i, t, r.choice([0.02, 0.2, 0.2, r.random()]), r.choice([0.1, 0.12, 0.3, r.random()]), r.choice([0.0, 0.02, 0.03])) for i, t in enumerate(said)]
            marks += [(d, p, i, r.random() * 0.4, r.choice([0.11, 0.3, r.random(), None])) for i in range(r.choice([0, 1, 4]))]
    got = words.mark_answers(
        spark.createDataFrame(marks, "doc_id int, page_no int, mark_no int, cx double, cy double"),
        spark.createDataFrame([(d, p, i, t, x, y, x + 0.05, y + h) for d, p, i, t, x, y, h in held], "doc_id int, page_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"),
        [words.MarkRule("a", ("MAIL", "FORM")), words.MarkRule("b", ("MAIL",), "B"), words.MarkRule("b", ("FORM", "NO"), "N")], ["doc_id"], limit=0.05,
    )
    want = {}
    for d, p, m, cx, cy in sorted(marks, key=lambda x: x[:3]):
        page = sorted(((y + (y + h)) / 2, x, i, t) for e, q, i, t, x, y, h in held if (e, q) == (d, p) and (t or "").strip())
        if not page or cy is None:
            continue
        scale = max(0.01, 0.6 * max(0.001, median(max(0.001, (y + h) - y) for e, q, _, t, _, y, h in held if (e, q) == (d, p) and (t or "").strip())))
        lines, mean = [], 0.0
        for w in page:
            if lines and abs(w[0] - mean) <= scale:
                mean = (mean * len(lines[-1]) + w[0]) / (len(lines[-1]) + 1)
                lines[-1].append(w)
            else:
                mean = w[0]
                lines.append([w])
        far, at = min((abs(sum(w[0] for w in x) / len(x) - cy), i) for i, x in enumerate(lines))
        if far > 0.05:
            continue
        across = [sorted(x, key=lambda w: w[1]) for x in lines]
        around = " ".join(w[3] for x in across[max(0, at - 2) : at + 3] for w in x).upper()
        local = " ".join([w[3] for w in across[at] if w[1] < cx - 0.02][-6:] + [w[3] for w in across[at] if w[1] >= cx - 0.02][:8]).upper()
        if "MAIL" in around and "FORM" in around and ("YES" in local or "NO" in local):
            want[d, "a"] = "YES" if "YES" in local else "NO"
        if "MAIL" in around:
            want[d, "b"] = "B"
        if "FORM" in around and "NO" in around:
            want[d, "b"] = "N"
    assert {(x.doc_id, x.keyword): x.value for x in got.collect()} == want and set(want.values()) == {"YES", "NO", "B", "N"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_crops_are_cleaned_once(spark):
    plan = plan_of(QUERIES["signature_ink"](spark, SF))
    assert plan.count("MapInPandas") == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_of_few_labels_go_to_many_tasks(spark):
    assert QUERIES["page_box_ticks"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_areas_of_a_comb_and_a_spiral_are_one():
    m = np.zeros((9, 9), bool)
    m[:, ::2] = m[8] = True
    assert images.components(m).tolist() == [[0, 0, 9, 9]]
    s = np.array([list(r) for r in ("1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111")]) == "1"
    assert len(images.components(s)) == len(images.components(s, False)) == 1
    assert len(images.components(np.eye(5, dtype=bool))) == 1 and len(images.components(np.eye(5, dtype=bool), False)) == 5


def test_modes_with_equal_lines_are_cleaned_once(monkeypatch):
    g = np.full((60, 200, 3), 255, np.uint8)
    g[20:40, 60:64] = g[28:32, 60:90] = 0
    masks, searched, search = [ink.clean(g, m) for m in ink.MODES], [], ink.straight
    monkeypatch.setattr(ink, "straight", lambda *a: searched.append(a) or search(*a))
    name, mask = ink.best_clean(g)
    assert len(searched) == 2 and name == "preserve" and np.array_equal(mask, masks[0]) and mask.any()
