import pytest
from pyspark.sql import Row

# Columns that an operator might use for itself, as strangers in its input.
STRANGE = ("id", "th", "h", "no", "chunk", "gone", "spans", "items", "n_words", "lang_pred", "score", "component", "node", "kept_id")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts (or (doc_id, text, lang)), with strange columns on demand."""

    def table(rows, strange=False):
        rows = [r if isinstance(r, tuple) else (i, r, None) for i, r in enumerate(rows)]
        out = [
            Row(doc_id=i, text=t, lang=lang, source="src0", n_chars=None if t is None else len(t))
            for i, t, lang in rows
        ]
        df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
        if strange:
            from pyspark.sql import functions as F

            df = df.withColumns({name: F.lit(f"my {name}") for name in STRANGE})
        return df

    return table
