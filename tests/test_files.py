"""Files read by what each of them holds, as a batch and as a stream."""

import datetime as dt
import json

import pytest

from quillmesh.sources import files
from quillmesh.sources import messages as src

NOW = dt.datetime(2024, 5, 1)


def fill(folder):
    """Nine rows of JSON in three forms, and what is beside them."""
    row = lambda i, **more: {"id": str(i), "text": f"text {i}", **more}
    (folder / "a.jsonl").write_text("\n".join(json.dumps(row(i)) for i in (1, 2, 3)) + "\nbroken {\n")
    (folder / "b.json").write_text(json.dumps([row(i, n=i, tags=["x", i]) for i in (4, 5, 6, 7)] + ["no row"], indent=2))
    (folder / "c.json").write_text(json.dumps({"logs": [], "data": [row(8), row(9)]}, indent=4))


def test_nine_rows(spark, tmp_path):
    fill(tmp_path)
    got = {r.external_id: r for r in src.read_storage(spark, str(tmp_path), NOW).collect()}
    assert sorted(got) == [str(i) for i in range(1, 10)]
    assert got["5"].meta == {"n": "5", "tags": '["x", 5]'} and got["8"].meta == {}


def test_other_forms(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": "1", "text": "a"}\n\nnonsense\n{"id": "2", "text": "b"}\n')
    (tmp_path / "one.json").write_text('{"id": "3", "text": "c"}')
    (tmp_path / "none.json").write_text('{"messages": []}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "scalar.json").write_text("17")
    (tmp_path / "x.csv").write_text('id,text\n4,"two\nlines"\n5,"quo""te",beyond\n')
    (tmp_path / "y.csv").write_text("spam,message,message_id\nspam,other header,6\n")
    (tmp_path / "z.txt").write_text("left alone")
    got = {r.external_id: (r.text, r.is_spam) for r in src.read_storage(spark, str(tmp_path), NOW).collect()}
    assert got == {"1": ("a", None), "2": ("b", None), "3": ("c", None), "4": ("two\nlines", None), "5": ('quo"te', None), "6": ("other header", True)}
    assert [r.external_id for r in src.read_storage(spark, str(tmp_path / "one.json"), NOW).collect()] == ["3"]
    assert [f.name for f in files.schema_of(files.read_file(spark, str(tmp_path / "y.csv")))] == ["message", "message_id", "spam"]
    with pytest.raises(ValueError, match="neither"):
        files.read_file(spark, str(tmp_path / "z.txt"))
    with pytest.raises(ValueError, match="no .json"):
        src.read_storage(spark, str(tmp_path / "nowhere"), NOW)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    fill(folder)
    (folder / "d.csv").write_text("id,text,date\n10,ten,2024-01-02T00:00:00\n")

    def run():
        q = src.read_storage(spark, str(folder), NOW, stream=True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == sorted(map(str, src.read_storage(spark, str(folder), NOW).collect()))
    (folder / "e.json").write_text('[{"id": "11", "text": "later"}]')
    assert len(run()) == 11  # the new file alone is read


def test_report_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r.csv").write_text('Report ID,Message Content,Is Spam\n1,"a, b",1\n2,,1\n3,x,0\n4,y,\n')
    q = src.read_reports(spark, str(folder), stream=True).writeStream.format("memory").queryName("reports_in").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("reports_in").collect())) == sorted(map(tuple, src.read_reports(spark, str(folder)).collect())) == [("1", "a, b", True), ("3", "x", False)]
