"""The progress stream reads a delivery in parts, however large it is."""

import glob
import os

from motionlake import catalog
from motionlake.session import scratch_folder


def test_deliveries_of_the_progress_stream_are_several_files(spark, sf_dir):
    scratch = scratch_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{scratch}/progress-*"))
    # tables of several files, each read by a task of its own
    settings = {"spark.sql.files.maxPartitionBytes": "8KB", "spark.sql.files.maxRecordsPerFile": "9"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = catalog.entries()["c17_progress_stream"].run(spark, sf_dir)
        (folder,) = set(glob.glob(f"{scratch}/progress-*")) - before
        tasks = {os.path.basename(f).split("-")[1] for f in glob.glob(f"{folder}/in/part-*.parquet")}
        assert len(tasks) > 1
        counts = lambda df: {tuple(r)[:4]: r.n for r in df.select("skill", "key_frame", "cohort", "state", "n").collect()}
        want = catalog.entries()["c17_annotation_progress"].run(spark, sf_dir)
        assert sum(counts(got).values()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        assert counts(want) == counts(got)
        # drafts and annotations are a batch each
        assert len(glob.glob(f"{folder}/state/commits/[0-9]*")) == 2
    finally:
        for name in settings:
            spark.conf.unset(name)
