"""Session helper: the configuration every formlake job expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on for correct results.
REQUIRED_CONF = {
    # Answer maps are merged with map_concat; later keys must win.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Stored timestamps are UTC.
    "spark.sql.session.timeZone": "UTC",
}

# Settings that matter for scale; applied when building a session here.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "formlake",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a SparkSession with the library's settings.

    On a cluster leave ``master`` unset and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in {**SCALE_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the correctness-relevant SQL confs on an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as is.
    Only a local-mode session without that setting (tests) gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="formlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise ``df`` in the reliable checkpoint folder (survives executor loss).

    (A Parquet table written there and read back was measured slower for the nested item
    rows this is used for.)
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed_once(column):
    """``column``, which the optimiser must not copy into the expressions that use it.

    A column that is long to compute and is used inside lambdas (once in the text, but evaluated for every
    element) would otherwise be computed for each of them, and a filter on it would be pushed
    below and compute it again. Materialising the rows would prevent that too, but takes disk.
    """
    from pyspark.sql import functions as F

    return F.when(F.monotonically_increasing_id() >= 0, column)


def let(value, body):
    """``body(value)`` with ``value`` computed once per evaluation, for expressions inside lambdas that use it repeatedly.

    A fold over nothing: unlike the lambda of ``transform`` or a round of a fold it copies neither value nor result.
    """
    from pyspark.sql import functions as F

    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)
