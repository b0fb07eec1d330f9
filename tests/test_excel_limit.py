import pytest

from linkwright.sources import sinks


def test_excel_refuses_more_rows_than_a_sheet_holds(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 5 rows"):
        sinks.save_excel({"small": spark.range(2), "large": spark.range(6)}, str(tmp_path / "x.xlsx"), limit=5)
    assert not (tmp_path / "x.xlsx").exists()
