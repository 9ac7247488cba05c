import pandas as pd
import pytest

EDGE = [
    (None, "a text without an id that has some words"),
    (9001, None),
    (9002, ""),
    (9003, " \t\n"),
    (9004, "... !!! ###"),
    (9005, "x"),
    (9006, "same words here again and again"),
    (9006, "same words here again and again"),
    (9007, "Same WORDS here\nagain and\tagain"),
    (9008, "word " * 30_000),
    (9009, "ÀÉ 你好 K Ünïcode \U0001f600 mit"),
]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The smallest documents and edge cases, with columns whose names clash with results."""
    frame = pd.read_parquet(f"{sf_dir}/documents.parquet")
    edge = pd.DataFrame(EDGE, columns=["doc_id", "text"]).assign(lang=[None, "en", "en", "de", None, "en", "en", "en", "fr", "en", None], source=[None, None, *["src0"] * 9], n_chars=0)
    all_ = pd.concat([frame, edge], ignore_index=True)
    all_["doc_id"] = all_["doc_id"].astype("Int64")
    return all_


@pytest.fixture(scope="session")
def table(spark, docs):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in row) for row in docs.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def clashing(table):
    from pyspark.sql import functions as F

    out = table
    for name in ("N_WORDS", "score", "Labels", "n_hit", "copies", "SIZE", "lang_pred", "kept", "entities", "n_tokens", "host", "verdict", "html"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def empty(table):
    return table.where("false")
