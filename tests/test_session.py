"""The shared scratch folder: what a block writes goes, what it keeps stays."""

import os

from millrace.session import scratch, scratch_folder, written


def test_scratch_is_removed_and_kept_frames_stay(spark):
    with scratch(spark):
        outer = written(spark.range(7), keep=True)
        with scratch(spark):
            gone = written(spark.range(5))
            middle = written(gone.filter("id > 1"), keep=True)
            path = gone.inputFiles()[0].removeprefix("file://")
            assert os.path.exists(path)
        assert not os.path.exists(path)
        assert middle.count() == 3
        inside = os.path.dirname(middle.inputFiles()[0].removeprefix("file://"))
    assert not os.path.exists(inside)
    assert outer.count() == 7
    assert os.path.dirname(scratch_folder(spark)) == os.path.dirname(os.path.dirname(outer.inputFiles()[0].removeprefix("file://")))
