import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and {r.label for r in rows} == {"A", "N", "R"}
    assert max(r.score_time for r in rows) == 100.0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_match_oracle_on_small_data(spark):
    import sys
    import os

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    import check_oracle as C

    con = C.duck(SF_SMALL)
    names = ["mean_by_label", "relative_scores", "empirical_cdf", "clean_answer", "split_exact", "counter_delta",
             "encode_fixed", "quantize_int8", "loss_series", "cdf_null_groups", "loss_series_null_run", "training_table",
             "runs_csv_mixed_headers", "latest_reading_stream", "cpu_usage_stream", "items_json_array", "read_frames"]
    for name in names:
        df = E.queries()[name](spark, SF_SMALL)
        rel = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in rel.description]
        assert sorted(df.columns) == sorted(dcols), name
        assert C._rows(df.columns, [tuple(r) for r in df.collect()]) == C._rows(dcols, rel.fetchall()), name
