import pytest

from sluice.operators import audit, steps as batch_steps
from sluice.sources import files, sinks
from sluice.streaming import append


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_csv_marks_types_and_bad_cells(spark, tmp_path):
    body = "id,n,day,word\n" + "".join(f"{i},{i},2024-01-{i % 28 + 1:02d},w{i}\n" for i in range(10_050)) + "7,oops,no day,x\n"
    path = write(tmp_path / "a.csv", b"\xef\xbb\xbf" + body.encode())
    assert files.read_file(spark, path).dtypes == [("id", "int"), ("n", "string"), ("day", "string"), ("word", "string")]
    df = files.read_file(spark, path, spark.createDataFrame([], "id int, n int, day date, word string").schema)
    last = df.where("word = 'x'").first()
    assert (last["id"], last["n"], last["day"]) == (7, None, None)


def test_folder_of_csv_files_with_headers(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        write(folder / f"{k}.csv", f"a,b\n{k},x{k}\n".encode())
    df = files.read_file(spark, str(folder))
    assert df.dtypes[0] == ("a", "int")
    assert sorted(r["a"] for r in df.collect()) == [0, 1, 2]


def test_json_lines_and_array(spark, tmp_path):
    lines = files.read_file(spark, write(tmp_path / "a.jsonl", b'{"a":1}\n{"a":2}\n'))
    array = files.read_file(spark, write(tmp_path / "a.json", b'[\n {"a":1},\n {"a":2}\n]\n'))
    assert sorted(r["a"] for r in lines.collect()) == sorted(r["a"] for r in array.collect()) == [1, 2]


def test_unknown_formats(spark):
    for name in ("x.txt", "x", "x.xlsx"):
        with pytest.raises(ValueError, match="Unsupported file format"):
            files.read_file(spark, name)


def test_invalid_utf8_is_counted(spark, tmp_path):
    row = files.invalid_utf8(spark, write(tmp_path / "a.csv", b"a,b\n1,\xff\xfe\n2,ok\n")).first()
    assert (row["lines"], row["invalid_lines"]) == (3, 1)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "data")
    first = sinks.save_version(spark.range(3), root, "d.parquet")
    second = sinks.save_version(files.read_file(spark, first).where("id > 0"), root, "d.parquet")
    assert sinks.latest_version(spark, root, "d.parquet") == second != first
    assert files.read_file(spark, first).count() == 3


def test_streamed_log_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id AS id", "concat('al.', event_type) AS event_type")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    chain = [{"type": "filter", "config": {"column": "event_type", "operator": "contains", "value": "c"}}]
    append.append_events(append.run_steps(stream, chain), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    want = audit.categorized(batch_steps.run_steps(events, chain))
    got = spark.read.parquet(str(tmp_path / "log")).select(*want.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="whole table"):
        append.run_steps(stream, [{"type": "normalize", "config": {"column": "id"}}])


def test_csv_keeps_every_row_and_cell(spark, tmp_path):
    """Doubled quotes, separators, line breaks, blanks, and an empty text told from a missing one."""
    rows = [(1, 'say "hi", ok'), (2, "two\nlines\r\nand more"), (3, ""), (4, None), (5, "  blanks  "), (6, "é, ü"), (7, '"'), (8, "a\\b\\")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    back = files.read_file(spark, sinks.save_output(df, f"{tmp_path}/x.csv"))
    assert sorted((r["id"], r["text"]) for r in back.collect()) == rows


def test_csv_by_others(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿id,text,n\n1,"say ""hi"", ok",2\n2,"a\nb",x\n3,"",\n', "utf-8")
    got = files.read_file(spark, str(path))
    assert got.columns == ["id", "text", "n"] and [tuple(r) for r in got.collect()] == [(1, 'say "hi", ok', "2"), (2, "a\nb", "x"), (3, "", None)]
    kinds = spark.createDataFrame([], "id int, text string, n int").schema
    read = files.read_csv(spark, str(path), kinds, rejects="line").collect()
    assert [r["n"] for r in read] == [2, None, None] and [r["line"] is not None for r in read] == [False, True, False]


def test_types_come_from_all_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "1,2\n" * 10_050 + "x9,2.5\n")
    got = files.read_file(spark, str(path))
    assert dict(got.dtypes) == {"a": "string", "b": "double"} and got.where("a = 'x9' AND b = 2.5").count() == 1
