"""Large JSON arrays read by byte ranges, against a JSON parser."""

from __future__ import annotations

import json
import random
import re

import pytest

from recallgrid.sources.arrays import array_objects

ODD = ['"', "\\", "}", "{", "[", "]", '\\"', "}]", ',"', "\n", "é", " ", "\U0001f600", "a", ":", "\\\\"]


def value(rng: random.Random, depth: int):
    kind = rng.randrange(6 if depth else 3)
    if kind < 2:
        return "".join(rng.choices(ODD, k=rng.randrange(12)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3, "", "}"])
    if kind == 3:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(ODD, k=3)) + str(k): value(rng, depth - 1) for k in range(rng.randrange(4))}


def found(spark, path):
    rows = array_objects(spark, path).collect()
    files = {r["path"] for r in rows}
    return {f.rsplit("/", 1)[1]: [json.loads(r["value"]) for r in sorted((r for r in rows if r["path"] == f), key=lambda r: r["element"])] for f in files}


@pytest.fixture
def short_ranges(spark):
    """Byte ranges far shorter than an object."""
    conf = {"spark.sql.files.maxPartitionBytes": "41", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_objects_of_ranges_are_those_of_the_parser(spark, tmp_path, short_ranges):
    rng, want = random.Random(7), {}
    forms = [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {"indent": 1, "ensure_ascii": False}]
    for k, form in enumerate(forms):
        objects = [{"k": j, "v": value(rng, 4)} for j in range(rng.randrange(5, 15))]
        (tmp_path / f"f{k}.json").write_text(("﻿ \n" if k == 1 else "") + json.dumps(objects, **form) + "\n" * (k % 2), encoding="utf-8")
        want[f"f{k}.json"] = objects
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "bare.json").write_text("[{}, {},{}]")
    assert found(spark, str(tmp_path)) == want | {"bare.json": [{}, {}, {}]}


def test_many_tasks_read_one_file(spark, tmp_path, short_ranges):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    objects = [{"k": k, "text": '"}{' * (k % 50)} for k in range(2000)]
    (tmp_path / "one.json").write_text(json.dumps(objects))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert found(spark, str(tmp_path)) == {"one.json": objects}


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": 2', '[{"a": 1}', '[{"a": "x', '{"a": 1}', '[{"a": [1, 2}]', "[", '[{"a": 1}]]'])
def test_what_is_not_one_whole_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match=re.escape("bad.json")):
        array_objects(spark, str(tmp_path / "bad.json"))
