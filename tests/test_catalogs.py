"""Queries over catalogs made from parts."""

from tracewright.plans import catalogs


def test_records_are_parsed_once(spark, small):
    """Documents and edges read records twice: they come from a table, not from the XML files again."""
    records, references = catalogs._weaknesses(spark, small)
    assert records.inputFiles() and all("/records-" in f for f in records.inputFiles())
    assert "from_xml" not in records._jdf.queryExecution().optimizedPlan().toString()
    assert records.count() == spark.read.parquet(f"{small}/part.parquet").count()
