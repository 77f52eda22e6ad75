import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "of", "and", "quick", "Brown", "fox", "jumps", "über", "Straße", "été", "señor", "lorem", "ipsum", "dolor", "a.b", "x-y", "12", "#1"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    base = prose(120)
    edited = base.split(" ")
    edited[60] = "EDITED"
    near = " ".join(edited)
    texts = [base, base, base.upper(), near, near + " tail", None, "", " \n\t ", "one", "one two", "one two", "one two three", prose(9), prose(300), prose(15_000),
             "line a b c d e\n" * 30, "Reach me at joe.doe@mail.example.com, +1 (555) 010-2030 or 10.0.0.1; card 4111 1111 1111 1111.", "日本語 テキスト 𐍈 " * 20,
             "!!! ??? ### $$$ %%% " * 40, "  leading and   inner  spaces \r\n\x0b end ", prose(40) + "\n" + "Released under the MIT License.\n" + prose(40)]
    out = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None][i % 3], len(t) if t is not None else None, "clash", None) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, base, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows over a few partitions."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
