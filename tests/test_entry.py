import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40


def test_entry_runs(spark):
    assert {r.rules_verdict for r in entry.entry(spark).collect()} <= {"BENIGN", "SUSPICIOUS", "HIGH_RISK"}
