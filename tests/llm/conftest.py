import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Rows that every operator must take: nulls, empty texts, ties, repeats, a long text.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "One, two THREE!"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (8, "ünïcödé ñandú 漢字 emoji 😀 text with ordinary words besides"),
    (9, " ".join(f"word{i % 997} other{i % 31}" for i in range(30_000))),
    (None, "a row without a key that has some words in it"),
    (10, "\x00\x01 control \x7f characters \n\n\n and lines \r\n"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from errorlab.session import local_session

    s = local_session("*", shuffle_partitions=8, app="errorlab-llm-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns, some named like columns that operators make."""
    rows = [(d, t, None if i % 3 else "s", "en", i, "x", i) for i, (d, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, node long, "
                                       "kept string, bucket int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
