"""Every query of the corpus operators as it is registered, over the smallest tables; SQL where there is one."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

NAMES = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
COLUMNS = {
    "op1_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_html_text": "page_id url text n_chars",
    "op3_surrogates": "doc_id text n_entities types",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_url_rules": "page_id host path rule verdict",
    "op6_jaccard": "doc_id n_shingles component_id",
    "op7_language": "doc_id held_out lang_pred score",
    "op8_lm": "doc_id held_out n_tokens n_known train_tokens base_score score bits_per_byte",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "pipeline": "doc_id text lang source n_chars size source_size target copies taken",
}


def test_all_are_registered():
    assert sorted(NAMES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert got.columns == COLUMNS[name].split()
    rows = got.toPandas()
    if name != "pipeline":
        whole = pd.read_parquet(f"{sf_dir}/{'pages' if rows.columns[0] == 'page_id' else 'documents'}.parquet")
        assert sorted(rows.iloc[:, 0]) == sorted(whole.iloc[:, 0])
    else:
        assert rows.text.notna().all() and (rows.taken == rows.copies * rows["size"]).all() and rows.taken.sum() > 0
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(sql).df()[list(rows.columns)]
        key = rows.columns[0]
        pd.testing.assert_frame_equal(*(x.sort_values(key).reset_index(drop=True).astype(object).where(lambda y: y.notna(), None) for x in (rows, want)), check_dtype=False)
