"""Records of JSON files in splits against the json module."""

import json
import random

import pytest

from spanlake.sources import corpus as S
from spanlake.sources.json_records import read_record_texts

STRINGS = ['}', '{"', '\\', '\\"', '"data": [', 'plain', '[1, {', 'é}\n', '', ' ', '},{']


def value(r, depth=0):
    kind = r.randint(0, 5) if depth < 4 else r.randint(3, 5)
    if kind < 2:
        return {r.choice(STRINGS) + str(k): value(r, depth + 1) for k in range(r.randint(0, 3))}
    if kind == 2:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([r.choice(STRINGS), r.randint(-5, 5), None, True, 1.5])


def record(r):
    return {"title": r.choice(STRINGS), "paragraphs": [{"context": "".join(r.choice(STRINGS) for _ in range(r.randint(0, 9))), "qas": []} for _ in range(r.randint(0, 3))], "more": value(r)}


def write(r, path):
    """A file of one layout or of several values, and its records in order."""
    indent = r.choice([None, None, 1])
    say = lambda x: json.dumps(x, indent=indent, ensure_ascii=r.random() < 0.5)
    parts, expected = [], []
    for _ in range(r.choice([1, 1, 3])):
        own = [record(r) for _ in range(r.choice([0, 1, 4, 20]))]
        layout = r.choice(["data", "list", "single", "data with more"])
        if layout == "single":
            parts += [say(x) for x in own]
        elif layout == "list":
            parts.append(say(own))
        else:
            parts.append(say({"version": "a[1]{", "data": own} if layout == "data" else {"x": 1, "data": own, "y": [{"z": {}}, {"z": [1, {}]}], "v": "w"}))
        expected += own
    path.write_text("\n".join(parts) + r.choice(["", "\n", " \n\n"]), encoding="utf-8")
    return expected


@pytest.mark.parametrize("split_bytes", [3001, 1 << 27])
def test_records_of_any_layout_in_any_splits(spark, tmp_path, split_bytes):
    r = random.Random(split_bytes)
    expected = {f"f{k}.json": write(r, tmp_path / f"f{k}.json") for k in range(12)}
    (tmp_path / "empty.json").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_record_texts(spark, str(tmp_path)).orderBy("file_path", "record_no").collect()
        got = {}
        for row in rows:
            got.setdefault(row.file_path.rsplit("/", 1)[1], []).append(json.loads(row.text))
        assert got == {k: v for k, v in expected.items() if v}
        assert all([x.record_no for x in rows if x.file_path.endswith(f"/{k}")] == list(range(len(v))) for k, v in expected.items())
        read = S.read_corpus(spark, str(tmp_path)).orderBy("record_pos").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    in_order = [x for k in sorted(expected) for x in expected[k]]
    assert [x.title for x in read] == [x["title"] for x in in_order] and [x.record_pos for x in read] == list(range(len(in_order)))
    assert [[p.context for p in x.paragraphs] for x in read] == [[p["context"] for p in x["paragraphs"]] for x in in_order]


def test_mixed_folder_loses_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"title": "a1", "paragraphs": []}, {"title": "a2", "paragraphs": []}]}, indent=1))
    (tmp_path / "b.json").write_text('{"title": "b1", "paragraphs": []}\n{"title": "b2", "paragraphs": []}\n')
    (tmp_path / "c.json").write_text('{"meta": {"k": [{}]}, "data": [{"title": "c1", "paragraphs": []}]}')
    assert [x.title for x in S.read_corpus(spark, str(tmp_path)).orderBy("record_pos").collect()] == ["a1", "a2", "b1", "b2", "c1"]


@pytest.mark.parametrize("text", ['[{"title": "a"},', '{"data": [{"title": "a"}', '[{"title": "a"}', '{"title": "a', '{"title": "a"}]'])
def test_unfinished_files_are_errors(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="unfinished"):
        read_record_texts(spark, str(tmp_path))
