import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def rows_of(texts, langs=None, sources=None, first=0):
    return [(first + i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def awkward(seed=1):
    """Null, empty, white-space-only, very long and repeated texts, null keys, repeated rows, ties."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "𝒳y", "naïve", "x" * 80]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    shared = say(50)
    texts = [None, "", " \t\n\x0b\x0c\r ", base, base, base.replace(" ", "  "), base + " tail", base[:-1], say(3), "one", "one two", "a b c d", say(6000), shared + " " + say(20), say(20) + "\n" + shared]
    # A pair of near copies, a text that repeats itself, one long token, line ends of every kind.
    own = say(40)
    texts += [own + " " + own, "z" * 9000, say(200), None, "ßİẞ İstanbul", "tab\tsep\rcr\x0bvt\x0cff"]
    rows = rows_of(texts, sources=[["a", "b", None, "a", "c"][i % 5] for i in range(len(texts))])
    rows += [rows[3], rows[3], rows[12]]  # repeated rows
    rows += [(None, "null id", "en", None, 7), (None, base, None, "b", 5), (3, "same id, other text", "fr", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def awkward_rows():
    return awkward()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as documents, over several partitions, with columns whose names the operators use themselves."""

    def make(rows, clash=False, parts=3):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        if clash:
            from pyspark.sql import functions as F

            for name in ("key", "bucket", "n", "fp", "size", "cell", "norm", "h1", "part", "doc", "score", "shard", "at", "word", "rank"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture
def folder(tmp_path, frame):
    """A data folder that holds only the given rows as documents."""

    def make(rows):
        frame(rows).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make
