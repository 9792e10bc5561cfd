"""Tables in the shared folder."""

import os

import pytest

from titrelake.llm import shared, substring


def test_written_tables_are_removed_on_request(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    substring.repeat_report(d).collect()
    shared.cut_table(d)
    shared.cut(d)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    os.makedirs(f"{folder}/corpus-stages")
    assert len(os.listdir(folder)) >= 4 and shared.clear(spark) >= 4 and not os.listdir(folder)
    assert shared.clear(spark) == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        shared.checkpoint_folder(Session)
