"""Streams of queries over files that grow in number with the table, not in size."""

from __future__ import annotations

from patternmill import queries, session


def test_changed_files_are_written_part_by_part(spark, sf, tmp_path, monkeypatch):
    """Twelve parts of the documents give twelve Parquet files each time; no task has all of them. Counts are those of the table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs.repartition(12).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    homes = []
    monkeypatch.setattr(queries, "fresh_path", lambda *a, **k: homes.append(session.fresh_path(*a, **k)) or homes[-1])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        told = queries.sync_stream_changed_files(spark, f"file://{tmp_path}/sf").first()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert told["total_files"] == told["processed_files"] == 60
    assert len([n for n in session.names_in(spark, f"{homes[0]}/in") if n.endswith(".parquet")]) > 12
