"""Words of many texts against splitting each of them."""

import random
import re

from lodestone.llm.words import SHORT, words_of


def test_words_equal_those_of_splitting():
    rng = random.Random(5)
    of: dict[bytes, int] = {}
    for _ in range(200):
        texts = [bytes(rng.choices(b"aAbB \t\n\x0b\x00\xc3z", k=rng.choice([0, 0, 3, 30, 300]))) for _ in range(rng.randrange(1, 9))]
        texts += [b"x" * k + b" " + b"X" * k + b"\x00" for k in range(SHORT - 2, SHORT + 3)] + [b"abcdefg abcdefgh abcdefg\x00 abcdefg\x1e", b"y" * rng.choice([1, 600_000])]
        rng.shuffle(texts)
        words, expected, lines = words_of(texts), [], 0
        for i, text in enumerate(texts):
            assert words.first_line[i] == lines
            for line in text.split(b"\n"):
                expected += [(w.lower(), i, lines) for w in re.findall(rb"[^\x20\x09-\x0D]+", line)]
                lines += 1
        assert [(i, line) for _, i, line in expected] == list(zip(words.text.tolist(), words.line.tolist(), strict=True))
        for (word, _, _), h in zip(expected, words.hashes.tolist(), strict=True):
            assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def test_no_words():
    for texts in ([b""], [b" \n ", b""]):
        assert len(words_of(texts).hashes) == 0
