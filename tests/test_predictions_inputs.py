"""What predictions read several times is written once."""

from scanfold.workload import baseline, predictions

SF = "/root/testdata/sf0.001"


def test_line_items_are_not_read_again(spark):
    """The tables behind predictions and changes are stored ones, so no line item is merged, or moved, a second time."""
    for rows in (predictions.predictions(spark, SF), baseline.diff(spark, SF)):
        files = rows.inputFiles()
        assert files and not any("lineitem" in f for f in files)
