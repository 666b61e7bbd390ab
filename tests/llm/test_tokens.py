"""The pair table against the tokenizer itself."""

import json
import random

import numpy as np
import pytest
from millrace.llm import packing
from tokenizers import Tokenizer

PATH = packing.tokenizer_path(packing.PackPolicy())


def random_texts(seed, n):
    rnd = random.Random(seed)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ABCdef", "éàüßñÀÉ", "0123456789", ".,;:!?()-\"/", "aA'tsre", "中é́Σσς😀İK×÷"]
    for _ in range(n):
        yield "".join(rnd.choice([" ", "\n", "\t ", ""]) + "".join(rnd.choice(rnd.choice(letters[: rnd.choice([2, 4, 6, 8])])) for _ in range(rnd.choice([1, 3, 9, 40]))) for _ in range(rnd.randint(0, 30)))


@pytest.mark.parametrize("policy", [packing.PackPolicy(), packing.PackPolicy(cache_bits=3, group_bytes=50), packing.PackPolicy(longest_merged=5)])
def test_ids_are_those_of_the_tokenizer(policy):
    texts = [None, "", " \n", "<|endoftext|> A<|startoftext|>b <|x", "aaaa aaaaaaaaa bbbb", "x" * 400, "a\x1cb c\x85d \x00", *random_texts(1, 400)]
    whole, mine = Tokenizer.from_file(PATH), packing.ChunkTokenizer(policy)
    for text, ids in zip(texts, mine.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_very_long_text():
    text = " ".join(random_texts(2, 2000))
    mine = packing.ChunkTokenizer(packing.PackPolicy(group_bytes=3000))
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_a_file_of_another_form_is_left_to_the_tokenizer(tmp_path):
    said = json.loads(open(PATH, encoding="utf-8").read())
    said["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    (tmp_path / "t.json").write_text(json.dumps(said), encoding="utf-8")
    path = str(tmp_path / "t.json")
    assert packing.pair_table(path) is None
    texts = list(random_texts(3, 20))
    mine = packing.ChunkTokenizer(packing.PackPolicy(tokenizer=path))
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(texts)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
