import os

import pytest

from flowweir.session import stage_path, stage_scope, stage_table


def test_scope_deletes_what_was_staged_inside(spark):
    outside = stage_table(spark.range(3), "outside")
    with stage_scope(spark) as folder:
        inside = stage_table(spark.range(5), "inside")
        assert inside.count() == 5
        with stage_scope(spark) as nested:
            assert stage_path(spark, "x").startswith(nested)
        assert stage_path(spark, "x").startswith(folder)
    assert not os.path.exists(folder.removeprefix("file:"))
    assert not stage_path(spark, "x").startswith(folder)
    assert outside.count() == 3


def test_scope_ends_with_an_error(spark):
    with pytest.raises(ValueError):
        with stage_scope(spark) as folder:
            raise ValueError
    assert not stage_path(spark, "x").startswith(folder)
