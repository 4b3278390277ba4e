"""Operator 9 on runs of spaces, tabs and marks: the library's ids, in linear time."""

import random
import time

import numpy as np
import pytest

from proseloom.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(None)


def ids(model, text):
    return np.frombuffer(model.encode(text), "<u4").tolist()


def test_runs_of_every_length(model):
    for mark in " \t▁":
        for n in [*range(2, 70), 1000, 20_000]:
            for text in (mark * n, "a" + mark * n + "the x", mark * n + "zq", "é" + mark * n + "中"):
                assert ids(model, text) == model.library.encode(text)


def test_random_mixtures(model):
    r = random.Random(1)
    parts = [" ", "  ", "   ", "\t", "▁", "▁▁", "the", "x", "zq", "中", " a", "\n", "e", ".", "é", "　", " " * 17, " " * 33]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        assert ids(model, text) == model.library.encode(text)


def test_time_is_linear(model):
    began = time.time()
    assert len(ids(model, "a" + " " * 400_000 + "b")) > 25_000
    assert time.time() - began < 10


def test_one_rule_by_hand(model):
    size = {i: n for n, i in model.runs.items()}
    assert [[size[i] for i in model.run(n)] for n in (1, 14, 15, 16, 17, 33)] == [[1], [14], [14, 1], [16], [16, 1], [16, 16, 1]]
