"""Progress of streams as it goes, against counts of the data."""

from __future__ import annotations

from patternmill.config import BatchConfig, Config
from patternmill.operators.scanners import chunks_of
from patternmill.plans.api import PatternBank
from patternmill.streaming.progress import listening, steps

FILES = "repo string, file_path string, language string, content string, ingest_seq long"


def source(k, n):
    return "\n\n".join(f"class A{k}x{j}:\n" + "".join(f"    v{i} = {i * j}\n" for i in range(8)) for j in range(n)) + "\n"


def test_steps():
    assert steps(0, 49) == [] and steps(0, 50) == [50] and steps(49, 150) == [50, 100, 150] and steps(50, 99) == [] and steps(3, 9, 2) == [4, 6, 8]


def test_batches_and_steps_equal_the_data(spark, tmp_path):
    """Batches of two Parquet files, files with up to nine patterns, one that fails, and a second run that goes on counting."""
    rows = [("r", f"f{k}.py", "python", source(k, k % 10), k) for k in range(40)]
    for part in range(8):
        spark.createDataFrame([r for r in rows if r[4] % 8 == part], FILES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def bad(content, path, language):
        if path == "f9.py":
            raise ValueError("no good")
        return chunks_of(content, path, language)

    bank, told, seen = PatternBank(spark, f"file://{tmp_path}/bank", config=Config(batch=BatchConfig(batch_size=2, max_retries=1, retry_delay=0.0, min_quality=1))), [], []
    with listening(spark, lambda *row: seen.append(row)):
        bank.sync_stream(f"file://{tmp_path}/in", "r", chunker=bad, on_progress=told.append)
    ends = [p for p in told if p.patterns is None]
    want = sum(len(chunks_of(c, p, lang)) for _, p, lang, c, _ in rows if p != "f9.py")
    assert [p.batch for p in ends] == [0, 1, 2, 3] and sum(p.files for p in ends) == 40 and sum(p.chunks for p in ends) == want and sum(p.failed for p in ends) == 1
    assert sum(p.stored for p in ends) == bank.table.count() == ends[-1].total_stored and [p.patterns for p in told if p.patterns] == list(range(50, ends[-1].total_stored + 1, 50))
    totals = [p.total_stored for p in told]
    assert totals == sorted(totals) and bank.progress("r").first()["stored_patterns"] == ends[-1].total_stored
    assert [row[1] for row in seen if row[2]] == [0, 1, 2, 3] and seen[-1][1] is None and seen[-1][3] is None
    spark.createDataFrame([("r", "new.py", "python", source(99, 5), 99)], FILES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    before = ends[-1].total_stored
    bank.sync_stream(f"file://{tmp_path}/in", "r", chunker=bad, on_progress=told.append)
    assert told[-1].files == 1 and told[-1].total_stored == before + told[-1].stored


def test_listener_counts_rows_and_tells_of_failures(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10 + part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen: list = []
    with listening(spark, lambda *row: seen.append(row)):
        stream().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(row[2] for row in seen if row[1] is not None and row[2]) == [10, 11, 12] and seen[-1][1] is None and seen[-1][3] is None
    with listening(spark, lambda *row: seen.append(row)):
        query = stream().selectExpr("raise_error('stop here')").writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/check2").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001  what it says is told to the listener
            pass
    assert "stop here" in seen[-1][3]


def test_a_bank_outside_the_repository_folder(tmp_path):
    """Workers get the package wherever the job starts."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from patternmill.plans.api import PatternBank
        rows = [("r", "a.py", "python", "class A:\\n" + "".join(f"    def step_{{i}}(self):\\n        return {{i}}\\n" for i in range(6)), 1)]
        spark.createDataFrame(rows, {FILES!r}).write.parquet("file://{tmp_path}/in")
        told = PatternBank(spark, "file://{tmp_path}/bank").sync_stream("file://{tmp_path}/in", "r").first()
        print("DONE", told["processed_files"], told["stored_patterns"])
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "DONE 1 1" in out.stdout, out.stderr[-2000:]


def test_a_batch_leaves_what_earlier_ones_wrote(spark, tmp_path):
    """The folders that the first of two batches made are in the bank after the second one too, so rows are written once."""
    bank, held = PatternBank(spark, f"file://{tmp_path}/bank", config=Config(batch=BatchConfig(batch_size=1))), []
    for part in (0, 1):
        rows = [("r", f"{n}.py", "python", f"def work{n}():\n" + "".join(f"    a{k} = '{'x' * 60}'\n" for k in range(6)), n) for n in range(100 * part, 100 * part + 100)]
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        bank.sync_stream(f"file://{tmp_path}/in", "r")
        held.append(bank.table._folders())
    assert bank.table.count() == 200 and all(f in held[1][b].split(",") for b, f in held[0].items())
