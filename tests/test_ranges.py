"""One file read by many tasks: every cut gives what one task reads."""

import csv
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.operators.parse import segment_blocks
from caseloom.plans.run import parse_block_files
from caseloom.sources import blocks, quoted_csv, ranges, readers

TEXT = st.lists(st.sampled_from(["Answer 1:", '"Answer 1:', "Answer  1:", "Answer 11:", "\n", "\n", "x", "é", "Answer 2: b\n", " ", "\r\n"]), max_size=40).map("".join)
CELLS = st.lists(st.sampled_from(['"', '"', '""', ",", "\n", "\r\n", "\r", "a", "é", "b c", '"x\n,y"']), max_size=30).map("".join)
CUTS = st.tuples(st.sampled_from([1, 3, 7, 30, 1000]), st.sampled_from([1, 5, 50, 4096]))


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return str(tmp_path_factory.mktemp("cut") / "file")


def with_chunks(size, run):
    before, ranges.CHUNK = ranges.CHUNK, size
    try:
        return run()
    finally:
        ranges.CHUNK = before


@given(TEXT, CUTS)
@settings(max_examples=400, deadline=None)
def test_every_cut_finds_each_block_once(place, text, cut):
    data = text.encode()
    open(place, "wb").write(data)
    edges = sorted({0, *(m.start() for m in re.finditer(rb'(?m)^"?Answer 1:', data))}) + [len(data)]
    want = [(a, data[a:b]) for a, b in zip(edges, edges[1:]) if b > a]
    got = with_chunks(cut[1], lambda: [r for c in ranges.cut(place, cut[0]) for r in ranges.line_records(*c, blocks._START)])
    assert got == want


@given(CELLS, CUTS)
@settings(max_examples=400, deadline=None)
def test_every_cut_parses_cells_in_their_true_state(place, text, cut):
    open(place, "wb").write(text.encode())
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]

    def run():
        state, got = quoted_csv.RECORD, []
        for c in ranges.cut(place, cut[0]):
            got += [r for piece in quoted_csv.records(*c, state) for r in quoted_csv.rows_of(piece)]
            state = quoted_csv.transitions(*c)[state]
        return got

    assert with_chunks(cut[1], run) == want


def test_one_block_file_is_read_by_many_tasks(spark, tmp_path):
    file = tmp_path / "blocks.txt"
    file.write_text("preamble\n" + "".join(
        f'{["Answer 1: ", chr(34) + "Answer 1: ", "Answer  1: ", "Answer 1:"][i % 4]}v{i}\nAnswer 2: é {"x" * (i % 90)}\n{"" if i % 5 else "  loose"}\n' for i in range(400)), encoding="utf-8")
    whole = segment_blocks(spark.read.text(str(file), wholetext=True)).select("record_index", "response")
    want = sorted(map(tuple, whole.collect()))
    for size in (1, 700, 1 << 20):
        rows = readers.read_answer_blocks(spark, str(file), size if size > 1 else 97)
        if size == 700:
            assert rows.rdd.getNumPartitions() >= 8
            busy = rows.select(F.spark_partition_id().alias("p")).distinct().count()
            assert busy >= 8
        assert sorted((r.record_index, r.response) for r in blocks.responses(rows).collect()) == want
    records = parse_block_files(spark, str(file), 500)
    assert records.filter("answers['Q1'] = 'v7'").first().record_index == [t for _, t in want].index(next(t for _, t in want if "v7\n" in t))


def test_block_folders_and_empty_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(" \n Answer 1: indented first\nAnswer 1: b")
    (tmp_path / "in" / "deep" / "b.txt").write_text("")
    (tmp_path / "in" / "_SUCCESS").write_text("Answer 1: hidden")
    rows = blocks.responses(readers.read_answer_blocks(spark, str(tmp_path / "in"))).collect()
    assert sorted((r.record_index, r.response) for r in rows) == [(0, "Answer 1: indented first"), (1, "Answer 1: b")]
    assert readers.read_answer_blocks(spark, str(tmp_path / "in" / "deep")).count() == 0


def test_one_csv_is_read_by_many_tasks(spark, tmp_path):
    file = tmp_path / "master.csv"
    with file.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["note", "ID", "response"])
        for i in range(500):
            w.writerow(["n" * (i % 7), f"X{i}", f'Answer 1: a "{i}", c\n\n"é"\r\nAnswer 2: {"y" * (i % 300)}' if i % 9 else ""])
        f.write('short\n,"X900"\n,X901,plain 5" wide,more\n')
    with file.open(newline="", encoding="utf-8") as f:
        want = {r["ID"]: r["response"] or "" for r in csv.DictReader(f)}
    for size in (900, 1 << 20):
        rows = readers.read_master_csv(spark, str(file), size)
        got = {r.ID: r.response for r in rows.collect()}
        assert got == want
        assert got["X901"] == 'plain 5" wide' and got["X900"] == "" and got[None] == "" and len(got) == 503
    tasks = quoted_csv.read(spark, str(file), ["ID"], 900).select("ID", F.spark_partition_id().alias("p"))
    assert tasks.select("p").distinct().count() >= 8 and tasks.count() == 503


def test_headers_by_name_and_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ID,response\n1,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("response,other,ID\ny,,2\n")
    (tmp_path / "c.csv").write_text("ID,response\n")
    (tmp_path / "d.csv").write_text("")
    assert sorted(map(tuple, readers.read_master_csv(spark, str(tmp_path)).collect())) == [("1", "x"), ("2", "y")]


def test_short_ranges_are_read_together(spark, tmp_path):
    """Tasks grow with the bytes, not with the ranges; each block keeps the range and the place it had."""
    file = tmp_path / "blocks.txt"
    file.write_text("loose\n" + "".join(f"Answer 1: v{i}\nAnswer 2: {'y' * (i * 37 % 400)}\n" for i in range(20_000)))
    size = file.stat().st_size
    rows = readers.read_answer_blocks(spark, str(file), 1000)
    assert size // 1000 > 2000 and blocks.TASKS <= rows.rdd.getNumPartitions() <= 2 * blocks.TASKS
    apart = []
    for path, start, end in ranges.cut(str(file), 1000):
        texts = [d.decode() for _, d in ranges.line_records(path, start, end, blocks._START) if d.startswith(b"Answer 1:")]
        apart += [(start, n, t) for n, t in enumerate(texts)]
    assert sorted((r.range_start, r.position, r.value) for r in rows.collect()) == apart
    assert len(ranges.cut_together(str(file), 1000, 50_000, 1)) == -(-size // 50_000)
