from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").lower())


def thue_morse(size):
    """Two words of ``size`` letters that collide under any polynomial modulo 2^64, from 2^10 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


LONG = " ".join(f"w{n % 977}x{n}" for n in range(30_000))
#: Rows that every operator takes: nulls, empty, blank and long texts, repeats, ties, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!!! ???"), (5, LONG), (6, "The same text of more than five words."), (7, "The same text of more than five words."), (7, "The same text of more than five words."), (None, "A row without an id but with words"), (8, "é"), (9, "<|im_end|>"), (10, "日本語のテキスト と words")]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names the operators use for results."""
    rows = [(i, t, "x", 1, "y", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, n int, class_id string, score double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
