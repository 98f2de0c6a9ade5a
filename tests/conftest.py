import os
import sys

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.python.sql.dataFrameQueryContext.enabled", "false")  # else every column asks the JVM where it was made
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def explained_logs(spark, tmp_path_factory):
    """A folder of cases whose logs are those of the signals' tests, explained in one go: root, frame, and the rows by the logs' names."""
    from types import SimpleNamespace

    from logloom.operators import diagnose
    from logloom.plans.signal_logs import texts
    from logloom.sources.logs import read_log_lines

    from .signal_pairs import whole_logs

    root = tmp_path_factory.mktemp("corpus")
    names = dict(enumerate([*texts().items(), *whole_logs().items()]))
    for k, (_, log) in names.items():
        (root / "cases" / f"c{k}").mkdir(parents=True)
        (root / "cases" / f"c{k}" / "replay-verifier.log").write_text(log)
    frame = diagnose.explained(read_log_lines(spark, f"{root}/cases/*/*.log"))
    rows = {int(r.log_id.split("/")[-2][1:]): r for r in frame.collect()}
    return SimpleNamespace(root=root, frame=frame, cases={name: f"c{k}" for k, (name, _) in names.items()}, found={names[k][0]: r for k, r in rows.items()})
