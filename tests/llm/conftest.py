import pytest


@pytest.fixture(scope="session")
def small(spark):
    """Texts that every operator must take: null, empty, blank, repeated, long."""
    long = " ".join(f"word{i}" for i in range(30_000))
    prose = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(6))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose), (5, prose), (5, prose), (6, long),
            (7, "a b c"), (8, "a b c"), (None, "null id"), (None, None), (9, prose + "\ntail")]
    return spark.createDataFrame([(i, t, f"s{k}", "x", "y") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, id string, n string, shard string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
