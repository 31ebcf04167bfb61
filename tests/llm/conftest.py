import pytest
from texts import COLUMNS, rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def bench(spark):
    texts = [(r[0], r[1]) for r in rows()]
    base = texts[6][1].split()
    long = texts[13][1].split()
    items = [("a", " ".join(base[20:40])), ("b", " ".join(long[100:113])), ("c", "ONE two"), ("d", None), ("e", " .. "), (None, "one"), ("a", " ".join(long[3000:3020])), ("f", "nowhere to be found " * 5)]
    return spark.createDataFrame(items, "item_id string, text string")
