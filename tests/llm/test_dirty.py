import pytest

from lakewarden.llm import queries

from ..dirty import write


@pytest.mark.parametrize("kind", ["dirty", "empty"])
def test_all_end(spark, small, tmp_path, kind):
    root = write(spark, small, tmp_path / "t", kind == "empty")
    for name, run in queries.queries().items():
        n = run(spark, root).count()
        assert kind == "dirty" or n == 0, name
