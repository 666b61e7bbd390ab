"""A clean part of any length doesn't hide a bad one."""

import base64
import random

import pytest
import zstandard
from millrace.llm import quality

KB = 1024


def prose(rnd, size):
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    out = ""
    while len(out) < size:
        out += rnd.choice(words) + " "
    return out[:size]


def noise(rnd, size):
    return "\n".join(base64.b64encode(rnd.randbytes(57)).decode() for _ in range(size // 76 + 1))[:size]


def kept(text):
    return quality.judge(text, quality.QualityPolicy(), zstandard.ZstdCompressor(level=3))["kept"]


@pytest.mark.parametrize(("before", "bad", "after"), [(4096, 4095, 0), (24 * KB + 512, 24 * KB + 512, 0), (45 * KB, 41 * KB, 0), (300 * KB, 7 * KB, 0), (0, 7 * KB, 300 * KB), (51 * KB + 700, 7 * KB, 50 * KB)])
def test_bad_part_is_found(before, bad, after):
    rnd = random.Random(before)
    assert not kept(prose(rnd, before) + noise(rnd, bad) + prose(rnd, after))


@pytest.mark.parametrize("size", [2000, 4095, 4096, 4097, 8191, 50 * KB])
def test_prose_is_kept(size):
    assert kept(prose(random.Random(size), size))
