import random

import pytest

WORDS = "amber birch cedar delta ember frost grove hazel iris jade kelp lotus maple north olive pearl quartz river stone tulip umber violet willow xenon yarrow zephyr".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, copies, near copies, repeated rows, columns with clashing names."""
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "de", "src0"), (21, base[0], None, None), (22, base[1] + " amber", "en", "src1"), (23, base[1].replace(base[1].split()[30], "Onyx", 1), "en", "src1")]
    rows += [(30, None, None, "src2"), (31, "", "en", None), (32, " \t\n ", "fr", "src2"), (33, "One two", "en", "src9"), (34, "one  TWO", "en", "src9"), (35, "one", "en", "src9"), (40, prose(rng, 6000), "en", "src1"), (41, "ÄÖ ß 😀 naïve", "de", "src0")]
    rows += [(5, base[5], "en", "src2"), (None, base[2], "en", "src0"), (None, None, None, None)]
    extra = [(*r, len(r[1] or ""), 1, "x", 2.0, True) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, n int, hot string, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
