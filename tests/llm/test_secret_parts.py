"""Random strings beside readable text in one run of characters."""

import random
import string

import pytest

from girthkit.llm import secrets
from girthkit.llm.queries import pattern, vocabulary


@pytest.fixture(scope="module")
def strings():
    return secrets.RandomStrings(vocabulary("byte_bpe_50k.tiktoken"), pattern())


def found(text, strings):
    return [text[a:b] for a, b, k in secrets.scan(text, strings) if k == "random"]


@pytest.mark.parametrize("before", ["com/services/documents/reference/", "deployment-service-production-", "a/readable/path/of/sixty/characters/that/goes/on/and/on/about/", "123e4567-e89b-12d3-a456-426614174000/", "0123456789abcdef0123456789abcdef01234567_"])
def test_readable_text_hides_nothing(strings, before):
    rng, letters = random.Random(5), string.ascii_letters + string.digits
    keys = ["".join(rng.choices(letters, k=24)) for _ in range(200)]
    hit = sum(any(k in x for x in found(f"see {before}{k} here", strings)) for k in keys)
    assert hit >= 196


def test_separators_within(strings):
    key = "aZ3/kQ9+Xw2/7Lp+vB8/tR4+Yc6"
    assert key in found(f"com/services/documents/reference/for/all/the/readers/{key}", strings)[0]


@pytest.mark.parametrize("text", ["com/services/documents/reference/2020/10/15/article", "some_long_identifier_name/InternationalizationOfThings", "x 123e4567-e89b-12d3-a456-426614174000/documents/reference", "0123456789ABCDEF0123456789ABCDEF"])
def test_readable_text_stays(strings, text):
    assert found(text, strings) == []
