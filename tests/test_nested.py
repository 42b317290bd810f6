import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import criteria
from tallyspark.sources import json_documents
from tallyspark.streaming.unseen import unseen


def structure(rng, depth=0):
    out = {}
    for i in range(rng.randint(0, 4)):
        key = rng.choice(["A", "b ", "Größe", "weight", "description", f"k{i}", "x y"])
        kind = rng.randint(0, 8)
        out[key] = rng.choice([3, 2.5, "7%", "", True, None, [1, 2], '{"no": 1}', " text "]) if kind > 3 or depth == 4 else {"weight": rng.choice([1, "5", "none", None]), **({"description": rng.choice([" d ", "", 4])} if kind == 1 else {}), **({"in": {}} if kind == 2 else {})} if kind < 3 else structure(rng, depth + 1)
    return out


def plain_outline(obj, depth=0):
    lines = []
    for key, val in obj.items():
        pad = "  " * depth
        if isinstance(val, dict):
            if "weight" in val and not any(isinstance(v, dict) for k, v in val.items() if k not in ("weight", "description")):
                lines.append(f"{pad}- {key}")
                if isinstance(val.get("description"), str) and val["description"].strip():
                    lines.append(f"{pad}  {val['description'].strip()}")
            else:
                lines += [f"{pad}{'Category' if depth else 'Scope'}: {key}", *plain_outline(val, depth + 1)]
        elif isinstance(val, (int, float, str)):
            lines.append(f"{pad}- {key}")
    return lines


def plain_criteria(obj, coerce, out):
    for key, val in obj.items():
        name = key.strip().lower()
        if isinstance(val, dict) and not ("weight" in val or "description" in val):
            plain_criteria(val, coerce, out)
        elif isinstance(val, (dict, int, float, str)):
            weight = coerce(val.get("weight") if isinstance(val, dict) else val)
            if weight is not None:
                told = val.get("description") if isinstance(val, dict) else None
                before = out.get(name, (None, None, None))
                out[name] = (key, weight, told.strip() if isinstance(told, str) and told.strip() else before[2])
    return out


def number(x):
    try:
        return float(x) if x is not None and not isinstance(x, bool) else None
    except (ValueError, TypeError):
        return None


def test_criteria_against_plain_walks(spark):
    rng = random.Random(3)
    given = [structure(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x, indent=rng.choice([None, 2]), ensure_ascii=False)) for i, x in enumerate(given)] + [(900, None), (901, "[1]"), (902, "5"), (903, "{"), (904, "")], "id int, text string").repartition(5)
    got = {r.id: r.outline for r in criteria.outline(df).collect()}
    assert got == {i: "\n".join([criteria.HEAD, *lines]) for i, x in enumerate(given) if (lines := plain_outline(x))}
    weights = {}
    for r in criteria.criteria(df, F.col("raw").try_cast("double")).collect():
        weights.setdefault(r.id, {})[r.name] = (r.shown, r.weight, r.description)
    assert weights == {i: c for i, x in enumerate(given) if (c := plain_criteria(x, number, {}))}


def test_deep_structures_are_an_error(spark):
    text = '{"a": ' * 7 + "1" + "}" * 7
    df = spark.createDataFrame([(1, text)], "id int, text string")
    with pytest.raises(Exception, match="more than 6 levels: a/a"):
        criteria.outline(df).collect()
    assert criteria.outline(df.select("id", F.lit(text[6:-1]).alias("text"))).count() == 1


def test_outline_is_made_in_its_row(spark):
    """Each level is opened once, and no lines are gathered again."""
    plan = criteria.outline(spark.createDataFrame([(1, "{}")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == criteria.DEPTH + 1 and "Aggregate" not in plan


def test_strings_that_look_like_other_values(spark):
    text = json.dumps({"a\\": '{"weight": 3}', "it's": "[1]", 'q"': "null", "s": {"s": {"weight": "s 7", "description": "it's \"s\" {}"}}, "d": {"weight": 1, "description": 5}, "l": [{"s": "s"}], "n": {"weight": {"s": ['s"', 2]}}})
    single = """{'a"b': {'weight': '5', "description": 'c"d'}, "it's": 'e\\'f'}"""
    df = spark.createDataFrame([(1, text), (2, single), (3, '{"a": "' + "\\\\n" * 100_000 + '"}')], "id int, text string")
    lines = {r.id: r.outline.split("\n")[1:] for r in criteria.outline(df).collect()}
    assert lines == {1: ["- a\\", "- it's", '- q"', "Scope: s", "  - s", "    it's \"s\" {}", "- d", "- n"], 2: ['- a"b', '  c"d', "- it's"], 3: ["- a"]}
    got = {(r.id, r.name): (r.weight, r.description) for r in criteria.criteria(df.filter("id < 3"), F.col("raw")).collect()}
    assert got == {(1, "a\\"): ('{"weight": 3}', None), (1, "it's"): ("[1]", None), (1, 'q"'): ("null", None), (1, "s"): ("s 7", "it's \"s\" {}"), (1, "d"): ("1", None), (1, "n"): ('{"s":["s\\"",2]}', None), (2, 'a"b'): ("5", 'c"d'), (2, "it's"): ("e'f", None)}


def test_equal_keys_within_an_object_lose_nothing(spark):
    df = spark.createDataFrame([(1, '{"s": {"a": 1, "a": 2, "b": "x"}, "c": 3}')], "id int, text string")
    assert criteria.outline(df).first().outline.split("\n")[1:] == ["Scope: s", "  - a", "  - a", "  - b", "- c"]
    assert {(r.name, r.weight) for r in criteria.criteria(df, F.col("raw").try_cast("double")).collect()} == {("a", 2.0), ("c", 3.0)}


def test_criteria_open_each_level_once(spark):
    plan = criteria.criteria(spark.createDataFrame([(1, "{}")], "id int, text string"), F.col("raw"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == criteria.DEPTH + 1


def test_written_damaged_and_read_again(spark, tmp_path):
    path = str(tmp_path / "reports")
    items = [(d, g, f"t{k}\n\"q\" é", float(k) if k % 3 else None) for d in ("A", "B/x", "C") for g in ("g1", "g2") for k in range(5)]
    rows = spark.createDataFrame(items, "division string, grouping string, text string, amount double")
    nested = rows.groupBy("division", "grouping").agg(F.sort_array(F.collect_list(F.struct("text", "amount"))).alias("items"))
    json_documents.write_documents(nested, path, "division", most=1)
    schema = "grouping string, items array<struct<text:string,amount:double>>"
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if p.is_dir()) == ["division=A", "division=B%2Fx", "division=C"]
    back = json_documents.parsed(json_documents.read_texts(spark, path), schema)
    assert back.filter("problem IS NOT NULL").count() == 0
    order = ["division", "grouping"]
    assert back.select(*order, "items").orderBy(*order).collect() == nested.select(*order, "items").orderBy(*order).collect()
    files = sorted((tmp_path / "reports" / "division=A").glob("part-*"))
    for file, text in zip(files, (files[0].read_text()[:-20], '{\n "grouping": "g9",\n "items": []\n}\n')):
        (file.parent / f".{file.name}.crc").unlink()
        file.write_text(text)
    spark.catalog.refreshByPath(path)
    again = json_documents.parsed(json_documents.read_texts(spark, path), schema)
    assert [(r.division, r.grouping, r.items, r.file.rsplit("/", 1)[1]) for r in again.filter("problem = 'not JSON'").collect()] == [("A", None, None, files[0].name)]
    assert again.filter("problem IS NULL").count() == 5 and again.filter("grouping = 'g9'").first().items == []
    lines = json_documents.read_texts(spark, str(files[1]), whole=False)
    assert lines.count() == 4


def test_problems(spark):
    rows = [(1, '{"k": 1, "more": [1]}'), (2, '{"k": "x"}'), (3, '{"k": 1}}'), (4, "[1]"), (5, " "), (6, None), (7, "{}"), (8, '\n{\n"k":\n2}\n')]
    got = {r.id: (r.k, r.problem) for r in json_documents.parsed(spark.createDataFrame(rows, "id int, text string"), "k int").collect()}
    assert got == {1: (1, None), 2: (None, "not of the schema"), 3: (None, "not JSON"), 4: (None, "not JSON"), 5: (None, "empty"), 6: (None, "empty"), 7: (None, None), 8: (2, None)}


def test_parts_and_what_failed(spark):
    metas = spark.createDataFrame([("s", "a", "f1"), ("s", "b", "f2"), ("s", "c", None), ("t", "d", "f9"), ("t", "e", "f3")], "source_key string, name string, file string")
    texts = spark.createDataFrame([("f1", '{"parts": [{"kind": "text", "text": "x"}, {"kind": "uri", "text": null}]}'), ("f2", "{"), ("f3", '{"parts": [], "submitted_but_not_processed_files": ["z", " ", null]}')], "file string, text string")
    payloads = json_documents.parsed(texts, json_documents.PARTS_SCHEMA)
    assert [tuple(r) for r in json_documents.parts_of(metas, payloads).orderBy("ord").collect()] == [("s", "a", 0, "text", "x"), ("s", "a", 1, "uri", None)]
    assert {r.source_key: r.names for r in json_documents.not_processed(metas, payloads).collect()} == {"s": ["b"], "t": ["d", "z"]}


SEEN = "conversation string, source_key string, at timestamp"


def test_unseen_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    batch = lambda n: spark.createDataFrame([(rng.choice("abc"), rng.choice(["k1", "k2", "k3", "k4", "", None]), i) for i in range(n)], "conversation string, source_key string, s int").select("conversation", "source_key", F.timestamp_seconds("s").alias("at"))
    seen = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("b", "k2")], "conversation string, source_key string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = unseen(spark.readStream.schema(SEEN).parquet(folder), seen)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return [(r.conversation, r.source_key) for r in spark.read.schema(SEEN).parquet(out).collect()]

    batch(9).write.mode("append").parquet(folder)
    first = run()
    batch(60).write.mode("append").parquet(folder)
    second = run()
    whole = unseen(spark.read.schema(SEEN).parquet(folder), seen).collect()
    assert len(second) == len(set(second)) and set(first) <= set(second)
    assert set(second) == {(r.conversation, r.source_key) for r in whole}
    assert run() == second


def test_unseen_in_batch(spark):
    rows = spark.createDataFrame([("a", "k", 5, "late"), ("a", "k", 3, "first"), ("a", "", 1, "x"), (None, "k", 1, "x"), ("b", "k", 1, "y")], "conversation string, source_key string, at int, text string")
    assert sorted(tuple(r) for r in unseen(rows).collect()) == [("a", "k", 3, "first"), ("b", "k", 1, "y")]
    assert unseen(rows.limit(0)).collect() == []
