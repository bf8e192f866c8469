import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=False):
    return WORD.findall(((text or "").translate(LOW)) if lower else text or "")


def make_docs(seed=5):
    """Rows (doc_id, text, source): prose, near and exact copies, nulls, empties, odd white space, one very long text, ties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(("an", "er", "ti", "oü", "sh", "Le", "k")) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def prose(n):
        out = []
        for _ in range(n):
            out.append(rng.choice(vocab) + rng.choice(("", "", "", ".", ",")))
            out.append(rng.choice((" ", " ", " ", " ", "\n", "  ", "\t")))
        return "".join(out)

    rows = [(i, prose(rng.randint(1, 160)), f"s{i % 5}") for i in range(60)]
    long = prose(9000)
    rows += [(100, long, "s0"), (101, long.replace("an", "an", 1) + " tail", "s0"), (102, rows[3][1], "s1"), (103, rows[4][1] + " more", None),
             (104, None, "s2"), (105, "", "s2"), (106, " \n\t ", "s3"), (107, "ONE", "s3"), (108, "one two", None), (None, rows[5][1], "s4"),
             (None, None, None), (109, "é 日本  x 😀 y\x1cz \x85", "s4"), rows[6], rows[6], (110, "same line here now ok\n" * 40, "s1")]
    return rows


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Write rows as a table with extra columns whose names operators use themselves, in several files."""
    def write(rows, schema=SCHEMA, extra=("row", "size", "_row", "h", "key")):
        from pyspark.sql import functions as F
        path = str(tmp_path_factory.mktemp("table") / "t")
        df = spark.createDataFrame(rows, schema)
        df.select("*", *[F.lit("x").alias(c) for c in extra if c not in df.columns]).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def docs(table):
    return table(make_docs())


@pytest.fixture(scope="session")
def empty(table):
    return table([])
