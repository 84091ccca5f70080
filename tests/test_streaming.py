"""Incremental normalisation into the base table (file source -> Parquet sink)."""

from pyspark.sql import functions as F

from routeboard.operators.normalize import normalize
from routeboard.sources.envelope import events_fact
from routeboard.sources.schema import BASE_COLUMNS
from routeboard.streaming import start_base_stream
from tests.conftest import SF_SMALL


def test_stream_appends_each_batch_once(spark, tmp_path):
    raw = events_fact(spark, SF_SMALL)
    raw_dir, base_dir, ckpt = tmp_path / "raw", tmp_path / "base", tmp_path / "ckpt"
    raw.where(F.col("id") % 2 == 0).write.parquet(str(raw_dir / "batch=0"))

    def run_once():
        stream = spark.readStream.schema(raw.schema).parquet(f"{raw_dir}/*")
        q = start_base_stream(stream, str(base_dir), checkpoint=str(ckpt))
        q.awaitTermination(120)
        return spark.read.parquet(str(base_dir))

    first = run_once()
    want_even = normalize(raw.where(F.col("id") % 2 == 0), fold_case=False).select(*BASE_COLUMNS)
    assert first.count() == want_even.count()
    assert first.select(*BASE_COLUMNS).exceptAll(want_even).count() == 0

    raw.where(F.col("id") % 2 == 1).write.parquet(str(raw_dir / "batch=1"))
    second = run_once()
    want_all = normalize(raw, fold_case=False).select(*BASE_COLUMNS)
    assert second.count() == want_all.count()
    assert second.select(*BASE_COLUMNS).exceptAll(want_all).count() == 0


def test_first_seen_stream_matches_batch_and_feeds_reports(spark, tmp_path):
    from datetime import date

    from routeboard.operators import reports as R
    from routeboard.params import ReportParams
    from routeboard.streaming import first_seen_table, start_first_seen_stream

    raw = events_fact(spark, SF_SMALL)
    raw_dir, out, ckpt = tmp_path / "raw", tmp_path / "first", tmp_path / "ckpt"
    # later days first, then the earliest days: late rows must lower first dates
    raw.where(F.col("created_at") >= "2024-01-02").write.parquet(str(raw_dir / "batch=0"))

    def run_once():
        stream = spark.readStream.schema(raw.schema).parquet(f"{raw_dir}/*")
        q = start_first_seen_stream(stream, str(out), checkpoint=str(ckpt))
        q.awaitTermination(120)

    run_once()
    raw.where(F.col("created_at") < "2024-01-02").write.parquet(str(raw_dir / "batch=1"))
    run_once()

    base = normalize(raw, fold_case=False)
    got = first_seen_table(spark, str(out))
    want = R.first_seen(base)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0

    from routeboard.streaming import compact_first_seen
    compact = compact_first_seen(spark, str(out), str(tmp_path / "compact"))
    assert compact.count() == want.count() and compact.exceptAll(want).count() == 0

    p = ReportParams(date(2024, 1, 2), date(2024, 1, 20), "day")
    a = R.new_user_kpis(base, p, daily=R.daily_new_users(base, p, got)).collect()
    b = R.new_user_kpis(base, p).collect()
    assert a == b


RESTART = """
import sys
from pyspark.sql import SparkSession
from routeboard.streaming import start_base_stream, start_first_seen_stream
raw, base, first, ckpt = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", ckpt).config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate())
schema = spark.read.parquet(raw + "/batch=0").schema
stream = lambda: spark.readStream.schema(schema).parquet(raw + "/*")
start_base_stream(stream(), base).awaitTermination(120)
query = start_first_seen_stream(stream(), first)
query.awaitTermination(120)
print("READ", sum(p.numInputRows for p in query.recentProgress))
"""


def test_a_new_process_resumes_at_the_default_checkpoint(spark, tmp_path):
    """Two applications, no ``checkpoint=``: every row arrives once, and history is not read again."""
    import subprocess
    import sys
    from pathlib import Path

    raw = events_fact(spark, SF_SMALL)
    places = [str(tmp_path / x) for x in ("raw", "base", "first", "ckpt")]

    def run_once() -> int:
        done = subprocess.run([sys.executable, "-c", RESTART, *places], cwd=Path(__file__).resolve().parents[1],
                              capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-2000:]
        return int(done.stdout.rpartition("READ")[2])

    halves = [raw.where(F.col("id") % 2 == k) for k in (0, 1)]
    halves[0].write.parquet(f"{places[0]}/batch=0")
    assert run_once() == halves[0].count()
    halves[1].write.parquet(f"{places[0]}/batch=1")
    assert run_once() == halves[1].count()
    got = spark.read.parquet(places[1]).select(*BASE_COLUMNS)
    want = normalize(raw, fold_case=False).select(*BASE_COLUMNS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
