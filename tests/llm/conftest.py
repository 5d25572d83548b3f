import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

ODD = [None, "", " \t\n\x0b\x0c\r ", "a", "one two three four", "Ünï cödé — 日本語 \U0001f600 é", "x" * 30000, "na\x00\x01ul", "w " * 3000, "The Cat sat\non the mat\nThe Cat sat\non the mat", "<|endoftext|> and <|endoftext|>"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture
def odd(spark):
    """Odd texts twice, a null key, and columns whose names clash with those of results."""
    rows = [(i, t, "en", "s", len(t or ""), "extra", 1.5, [7]) for i, t in enumerate(ODD)]
    rows += rows[:3] + [(None, "no key here at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double, ids array<int>")


@pytest.fixture
def tables(spark, tmp_path):
    """Write documents as a table and return the folder."""

    def write(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint", name="documents"):
        df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
