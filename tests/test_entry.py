from shared import SF

import __spark_entry__ as entry_module


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "residual_risk" in df.columns


def test_every_checked_query_exists():
    names = set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= names
    library = {n for n in names if n != "pipeline" and not n.startswith("op")}
    assert library - set(entry_module.oracle_sql()) == {"leakage_audit"}


def test_some_queries_against_sql(spark):
    import duckdb

    import check
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("actor_windows", "zone_edges", "closure_watches", "kl_irreversibility", "route_formats", "log_type_counts"):
        ok, note, _ = check.compare(spark, con, SF, name, entry_module.oracle_sql()[name])
        assert ok, (name, note)
