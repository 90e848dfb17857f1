"""Documents with every awkward case, shared by the tests of this folder."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, node string, shard string"


def _texts():
    rng = random.Random(7)
    words = [a + b for a in ("ka", "lo", "mi", "ré", "su", "TA") for b in ("b", "dor", "fen", "gli", "n", "öt", "zu9")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = say(120), say(60), "the very same line of a licence, in many documents"
    near = base.split()
    near[60] = "other"
    return [
        base, base.upper(), " ".join(near), base, passage, say(20) + "\n" + passage + "\n" + say(30), say(40) + " " + passage, f"{say(8)}\n{line}\n\t{line.upper()}  \n{say(5)}",
        f"{line}\nshort\n{say(9)}", f"{line}\r\n\n\n{line}", None, "", "   \n\t ", "!?... --", say(3), say(3) + " x", "word " * 400, "word " * 400 + "end", say(20_000), "é ü ñ " * 30,
        "password = hunter2hunter2 and Token: 'short' API_KEY=abcdefgh1 secret: token: abcdefgh1", "AKIA" + "A1" * 8 + " AKIASHORT " + "deadbeef" * 5 + "é" + "0a" * 20, "passwd=\"" + "x" * 9 + "\"" * 3,
        "K = Key apiſkey=abcdefghij apikey=abcdefghij", say(9), say(15), say(15),
    ]


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, empty and very long texts, copies, repeated rows, shared passages."""
    out = [(i, t, "xx" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, "clash", i, "clash", "clash") for i, t in enumerate(_texts())]
    return out + [out[3], out[3], (None, "text without an id of its own", None, None, None, None, None, None, None)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
