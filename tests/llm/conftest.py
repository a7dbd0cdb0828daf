import os
import random

import pytest

# workers import the package by path
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])

SYLLABLES = "the of an er in on at ed re th ou es st or nt ea ha to en ti".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Documents with every kind of trouble: nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (60, 120, 300, 40, 8, 3, 1)]
    passage = sentence(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[1].upper()), (22, base[1].replace(" the", " that", 1)), (23, base[2] + " tail"), (24, "x " + passage + " y z"), (25, sentence(rng, 30) + " " + passage)]
    out += [(26, ""), (27, None), (28, "   \n"), (None, base[3]), (None, None), (29, "é" * 70 + " ü" * 90), (30, "ab " * 200), (31, "a" * 500), (32, base[0])]
    out += [(33, sentence(rng, 9000)), (33, "other text under one id"), (34, base[4]), (34, base[4]), (35, "<|endoftext|> it's 12,5! naïve—no")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Spread over partitions, with columns whose names clash with the operators' own."""
    schema = "doc_id bigint, text string, key string, mark int, n int, start int, votes int, sig int, size int"
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6) for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
