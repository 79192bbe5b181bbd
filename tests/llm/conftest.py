import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, h string, spans string, base int, fp long, tag string, score double, lang_pred string, row int, times int"


def rows():
    out = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, "b", 5), (4, "A single line of plain words, nothing else.", "en", None, 43),
        (5, "A single line of plain words, nothing else.", "en", None, 43), (5, "A single line of plain words, nothing else.", "en", None, 43),
        (None, "El perro come y la casa es grande", "es", "b", 33), (7, "漢字 and ñandú 😀 é́", None, "c", 18),
        (8, "line one is here\n" * 40, "en", "a", 680), (9, " ".join(f"w{i % 97}" for i in range(60_000)), "en", "hot", 0),
    ]
    return [(*r, 7, 0.5, "x", "y", 3, 11, "z", 0.1, "q", 1, 2) for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
