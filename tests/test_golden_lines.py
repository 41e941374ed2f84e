"""Golden sets are read by lines: large files in several tasks, and problems name the line of the file."""

import pytest

from folioforge.sources import files


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_a_large_file_is_read_in_several_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "g.jsonl"
    path.write_text("".join(f'{{"document_name":"d{k}.pdf","expected":{{"invoice_id":"{k}"}}}}\n\n' for k in range(1000)))
    rows = files.read_golden(spark, str(path))
    assert rows.rdd.getNumPartitions() > 3
    assert sorted((r.document_name, r.expected) for r in rows.collect()) == sorted((f"d{k}.pdf", f'{{"invoice_id":"{k}"}}') for k in range(1000))


@pytest.mark.parametrize("at", [3, 700, 1999])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_problems_of_large_files_name_the_line(spark, tmp_path, small_blocks, at, end):
    path = tmp_path / "g"
    path.mkdir()
    good = ['{"document_name":"a","expected":{}}', ""] * 1000
    (path / "1.jsonl").write_text(end.join(good), newline="")
    (path / "2.jsonl").write_text(end.join([*good[: at - 1], '{"document_name":"a","expected":[]}', *good[at:], '{"document_name":"a","expected":[]}']), newline="")
    with pytest.raises(ValueError, match=f"line {at} must hold"):
        files.read_golden(spark, str(path))
