import pytest

from orderlens.schema import RAW_SCHEMA
from orderlens.streaming.ingest import ingest
from tests.test_star import ROW, write_csv


def run(spark, tmp_path, checkpoint):
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / checkpoint))
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "table")).collect())


@pytest.mark.parametrize("replay", [False, True])
def test_files_load_once(spark, tmp_path, replay):
    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a.csv", ROW, ROW, "2" + ROW[1:])
    assert run(spark, tmp_path, "cp1") == [1, 2]
    write_csv(tmp_path / "in" / "b.csv", "2" + ROW[1:], "3" + ROW[1:])
    # A lost checkpoint replays every file; the stored keys keep it harmless.
    assert run(spark, tmp_path, "cp2" if replay else "cp1") == [1, 2, 3]


@pytest.mark.parametrize("header", ["City,State", "State"])
def test_another_header_stops_the_stream(spark, tmp_path, header):
    """Swapped or missing headings must not be read by place."""
    (tmp_path / "in").mkdir()
    names = ",".join(f.name for f in RAW_SCHEMA)
    changed = names.replace("City,State", "State,City" if "," in header else "State")
    write_csv(tmp_path / "in" / "a.csv", ROW, header=changed)
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="(?i)header|column"):
        query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 0
