"""JSON read member by member, next to the json module."""
import io
import json
import random

import pytest

from tabscout.sources import folders, json_events


class Slow(io.StringIO):
    """Gives less than it is asked for."""

    def read(self, n=-1):
        return super().read(min(n, self.most)) if n >= 0 else super().read()


def told(text, most=7):
    stream = Slow(text)
    stream.most = most
    return [(k, i, json.loads(v)) for k, i, v in json_events.read_object(stream, "TABLES")]


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_members_one_by_one(most):
    data = {"INFO": {"db": "x", "n": [1, -2.5e3, None]}, "TABLES": {"a": {"c": ["é", "\"}{,:"]}, "b": 12, "": [], "d": True}, "n": 123456, "t": "x"}
    for text in (json.dumps(data), json.dumps(data, indent=2), " \n" + json.dumps(data, ensure_ascii=False) + "\t"):
        assert told(text, most) == [("INFO", None, data["INFO"]), *[("TABLES", k, v) for k, v in data["TABLES"].items()],
                                    ("n", None, 123456), ("t", None, "x")]
    assert told("{}", most) == [] and told('{"TABLES": {}}', most) == [] and told('{"TABLES": 5}', most) == [("TABLES", None, 5)]


@pytest.mark.parametrize("text", ["", "[1]", "{", '{"a"', '{"a": }', '{"a": 1,}', '{"a": 1} x', '{"TABLES": {"t": {}', '{"TABLES": {"t" {}}}', "{1: 2}", '{"a": nul}'])
def test_broken(text):
    with pytest.raises(ValueError):
        told(text, 3)


def test_memory_is_bounded_by_one_entry():
    entry = json.dumps({"COLUMNS": ["c"] * 20, "FILEPATH": "x.csv"})

    class Many:
        def __init__(self):
            self.parts = iter(['{"TABLES": {', *[f'{"," if i else ""}"t{i}": {entry}' for i in range(100_000)], "}}"])

        def read(self, n):
            return next(self.parts, "")

    events, n = json_events.Events(Many()), 0
    for key in events.members():
        for _ in events.members():
            n += len(events.value()) == 2
    assert n == 100_000 and events.largest < 4 * json_events.CHUNK


def test_catalogue_of_many_tables(spark, tmp_path):
    tables = {f"t{i}": {"FILEPATH": f"t{i}.csv", "COLUMNS": ["a", "b"], "COLUMN_DATATYPES": ["x", "y"], "NUM_ROWS": i,
                        "FOREIGN_KEYS": [{"FOREIGN_KEY": ["P1", "a"], "REFERENCE_TABLE": "t0"}]} for i in range(20_000)}
    for folder, text in (("big", json.dumps({"TABLES": tables, "INFO": {"db_folder_name": "Big"}})), ("cut", json.dumps({"TABLES": tables})[:-9]),
                         ("odd", '{"TABLES": {"x": {"NUM_ROWS": "many"}}}'), ("none", '{"INFO": {}}')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / folders.CATALOGUE).write_text(text)
    got = folders.catalogue_tables(spark, str(tmp_path))
    assert {(r.folder, r.database, r.n) for r in got.groupBy("folder", "database").count().withColumnRenamed("count", "n").collect()} == {("big", "Big", 20_000)}
    assert folders.read_folders(spark, str(tmp_path)).count() == 20_000
    assert folders.fk_catalogue(spark, str(tmp_path)).groupBy("database", "destination_table").count().first()[2] == 20_000
