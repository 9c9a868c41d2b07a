import pytest

#: Two words that hashes by a polynomial modulo a power of two confuse, whatever its base.
THUE = "".join("ab"[i.bit_count() & 1] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))

#: Texts with nulls, empties, ties, repeats, very long ones and none of the usual characters.
ODD = [
    (1, "x a b C d", "en"), (2, None, "en"), (3, "", None), (None, "b c b c A B", "fr"), (5, "one Two", "en"), (5, "one Two", "en"),
    (6, "É b — 中文 😀 don't 'S  \n\t end ", "fr"), (7, "word " * 30_000, "en"), (8, "x" * 50_000, None), (9, "0123 ... !!", "de"),
    (10, THUE, "en"), (12, MORSE, "en"), (13, f"{THUE} {MORSE} end", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names clash with the operators' own."""
    rows = [(i, t, g, "s", 1, "r", 0.5, True, 7) for i, t, g in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, score double, accepted boolean, node bigint")


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark, odd):
    """A folder of tables of odd rows, and one of empty tables."""
    full, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    items = spark.createDataFrame([(1, "b c", "x"), (2, "A", "x"), (None, "b c", "x"), (4, None, "x"), (5, "", "x"), (1, "b c", "x")], "item_id bigint, text string, need string")
    pages = spark.createDataFrame([(1, "u", "x", 1), (2, None, None, 1), (3, "u\n v", "", 1), (None, "u", "x", 1), (1, "u", "x", 1), (9, "w", "y" * 100_000, 1)], "page_id bigint, url string, html string, records int")
    vectors = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (40, [1.0, 2.0, 3.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (8, []), (9, [float("inf"), 1.0])]
    vecs = spark.createDataFrame([(i, v, 1, "z") for i, v in vectors], "vec_id bigint, embedding array<float>, label int, cls string")
    for name, df in (("documents", odd), ("benchmark", items), ("pages", pages), ("embeddings", vecs)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty
