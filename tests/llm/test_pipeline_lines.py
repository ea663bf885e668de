import random

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_operators import prose


def _passage(rng, n=60):
    return prose(rng, n) + f" {rng.random()}"


def test_boilerplate_goes_from_rows_that_are_no_copies(spark):
    rng = random.Random(5)
    a, b, own = _passage(rng), _passage(rng), _passage(rng, 90)
    mixed = f"{a}\n{b}\n{own}"  # two of three lines are those of two other rows, and it is no copy of either
    rows = [(1, f"{a}\n{_passage(rng, 200)}"), (2, f"{b}\n{_passage(rng, 200)}"), (3, mixed)]
    out = corpus_pipeline.drop_lines(spark, docs(spark, rows), "")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
    assert got[3] == own


def test_a_line_is_not_lost_with_a_copy_that_goes(spark):
    rng = random.Random(6)
    lines, x = [_passage(rng, 80) for _ in range(5)], _passage(rng, 8)
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines, x])), (3, f"{x}\n{_passage(rng, 200)}")]
    out = corpus_pipeline.drop_copies(spark, corpus_pipeline.drop_lines(spark, docs(spark, rows), ""), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 3: rows[2][1]}


def test_near_copies_that_share_half_of_their_lines_stay_alike(spark):
    rng = random.Random(7)
    a = _passage(rng)
    lines = [_passage(rng, 40) for _ in range(6)]
    near = list(lines)
    for k in range(3):
        near[k] += " changed"  # half of the lines are the first copy's
    rows = [(1, f"{a}\n{_passage(rng, 200)}"), (10, "\n".join([a, *lines])), (11, "\n".join([a, *near]))]
    out = corpus_pipeline.drop_lines(spark, docs(spark, rows), "")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: rows[0][1], 10: "\n".join(lines), 11: "\n".join(near)}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, out, "").collect()) == [1, 10]
