"""Quoted CSV that is split over tasks against the one-task reader."""

import random

import pytest

from diurna.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, base = random.Random(2), tmp_path_factory.mktemp("csv")
    for k in range(3):
        lines = ["id,text,note"]
        for i in range(3000):
            text = rng.choice(['plain', '"two\nlines"', '"a ""quoted"" word"', '"comma, inside"', '"\n\nmany\nlines ""\n"" here\n"', "", '"é\n日本"'])
            lines.append(f'{k}-{i},{text},{rng.choice(["x", "", "yy"])}')
        # one record that is longer than a split
        lines.insert(1500, f'{k}-long,"' + "\n".join(f"line {i} of a long note" for i in range(3000)) + '",z')
        (base / f"part{k}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    (base / "other.csv").write_text('note,id\r\n"n\r\n1",a\r\nn2,b\r\n', encoding="utf-8", newline="")
    return str(base)


def test_split_files_give_the_records_of_whole_files(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        path = f"{folder}/part0.csv"
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 4
        df = files.read_csv_allowlist(spark, folder, ["id"], ["text", "note"])
        got = sorted(((r.id, r.text, r.note) for r in df.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv([f"{folder}/part{k}.csv" for k in range(3)])
    other = [("a", None, "n\r\n1"), ("b", None, "n2")]
    assert got == sorted([(r.id, r.text, r.note) for r in whole.collect()] + other, key=str)
    assert len(got) == 3 * 3001 + 2


def test_byte_order_mark_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,v\n1,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,v\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv_allowlist(spark, str(tmp_path), ["id", "v"]).collect()] == [("1", "2")]
    assert files.read_by_stem(spark, str(tmp_path), "a", ["id"], ["v"]).columns == ["source_name", "id", "v"]


def test_an_old_table_is_replaced_and_survives_a_failed_job(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        files.write_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(Exception):
        files.write_table(spark.range(2).selectExpr("raise_error('no') as x"), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".old")] == []
