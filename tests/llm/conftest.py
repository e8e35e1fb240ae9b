import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, content string, shard int, h long, vertex long"


def texts() -> list[str | None]:
    """Short and long texts with copies, shared passages, odd white space and letters of several scripts."""
    r = random.Random(5)
    vocabulary = ["foo", "Bar", "bazé", "qüx", "the", "of", "zz" * 9, "naïve", "x", "0042", "don't"]
    some = lambda n: " ".join(r.choice(vocabulary) + str(r.randint(0, 60)) for _ in range(n))
    passage, line = some(70), some(9)
    out: list[str | None] = [None, "", "   \t\n", "a", "Only three words", some(34), some(35), some(36)]
    out += [f"{some(r.randint(0, 60))} {passage} {some(r.randint(0, 40))}" for _ in range(6)]
    out += [f"{line}\n{some(r.randint(1, 80))}" for _ in range(20)]
    base = some(150)
    out += [base, base, base.replace(" ", "\x0b "), base.upper()]
    out += [" ".join(w if i % 70 else "changed" + str(k) for i, w in enumerate(base.split(" "))) for k in range(5)]
    out += ["ab " * 200, "ab " * 77, "é" * 130, "é" * 131, "x" * 99, "x" * 100, "x" * 250]
    out += [some(6000), "中文字符 " * 60, "½ ²x <|endoftext|> q\xa0r"]
    return out


@pytest.fixture(scope="session")
def rows():
    """Rows of a documents table with clashing extra columns: repeats of rows, null ids, one id with two texts."""
    out = [(3 * i - 20, t, "en", "s", "c", 1, 2, 3) for i, t in enumerate(texts())]
    out += [out[9], out[9], out[30], (None, "no id here", None, None, None, None, None, None), (None, None, "en", "s", "c", 1, 2, 3)]
    out += [(out[12][0], "another text of the same id " * 30, "en", "s", "c", 1, 2, 3)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
