import pytest

#: Columns that clash with names the operators use themselves.
CLASHING = {"size": 1, "target": 2.0, "copies": 3, "d": 4, "h": 5, "rest": "r", "kept": "k", "next": "n", "_row": "w", "bucket": 6, "n_words": 7, "fp": 8, "root": 9}


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, lang, source); n_chars is added, and clashing columns if asked for."""

    def made(rows, clashing=False, parts=3):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame(full, schema).repartition(parts)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
        return df

    return made


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeats."""
    words = "the quick brown fox jumps over a lazy dog and runs to the old house by the river in summer with many other friends of the forest"
    return [
        (1, words, "en", "a"),
        (2, words, "en", "a"),
        (2, words, "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, " \t\n ", "fr", "b"),
        (6, LONG, "en", "a"),
        (7, "die kinder sind nicht mit dem hund im wald und das haus ist alt für uns", "de", ""),
        (None, words + " again", "en", "a"),
        (8, "12 34 !!", "en", None),
        (9, "le chat est dans la maison avec les enfants et il mange une pomme pour le dîner", "fr", "ä"),
    ]
