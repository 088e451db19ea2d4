"""Snapshot collapse against comparing all conversations with each other."""

import random

from barsmith.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def by_hand(turns):
    """{conv_id: rendered} of rows (conv_id, turn, role, text) with ids."""
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    whole = {c: tuple(sorted({t[1:] for t in turns if t[0] == c}, key=key)) for c in {t[0] for t in turns}}
    whole = {c: tuple(x[1:] for x in turns) for c, turns in whole.items()}  # places order turns, no more
    out = {}
    for c, x in whole.items():
        if not any(y[: len(x)] == x and (len(y) > len(x) or d < c) for d, y in whole.items() if d != c):
            out[c] = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in x)
    return out


def test_random_logs(spark):
    rng = random.Random(6)
    turns = []
    for c in range(150):
        for k in range(rng.randint(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                turns.append((c, rng.choice([k, None]) if rng.random() < 0.05 else k,
                    rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ["user", "assistant"][k % 2], rng.choice(["a", "b", "", None])))
    got = chat.collapse(spark.createDataFrame([(*t, "x") for t in turns], SCHEMA)).collect()
    assert {r.conv_id: r.rendered for r in got} == by_hand(turns) and len(got) < 150
    assert all(r.n_turns == r.rendered.count("<|im_start|>") for r in got)


def test_nulls_ties_and_repeats(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None),
        (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "user", "a"), (6, 2, "assistant", "c")]
    turns += [(None, 0, None, "z"), (None, 0, None, "z"), (None, 0, "user", "a"), (None, 5, None, "y"), (7, 0, "user", "t2"), (7, 0, "user", "t1"),
        (8, 0, "user", "t1")]
    got = chat.collapse(spark.createDataFrame([(*t, None) for t in turns], SCHEMA)).collect()
    assert {r.conv_id for r in got} == {2, 4, 5, 6, 7, None}
    said = {r.conv_id: r.rendered for r in got}
    assert said[2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and said[7].index("t1") < said[7].index("t2")
    assert sorted(r.rendered for r in got if r.conv_id is None) == ["<|im_start|>\ny<|im_end|>\n", "<|im_start|>\nz<|im_end|>\n"]
    assert {r.conv_id: r.n_turns for r in got}[5] == 1


def test_a_long_conversation(spark):
    turns = [(1, k, "user", f"{k} " + "x" * 300) for k in range(5000)] + [(2, k, "user", f"{k} " + "x" * 300) for k in range(4999)]
    got = chat.collapse(spark.createDataFrame([(*t, None) for t in turns], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 5000)]


def test_empty_table(spark):
    assert chat.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
