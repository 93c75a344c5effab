import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldrin.operators import arranging as A
from veldrin.functions import strict_json
from veldrin.operators import audits, summaries
from veldrin.operators.shred import children, entities, entity_table, json_nodes, shred
from veldrin.sources import exports, jsonl
from veldrin.streaming import progress

NESTED = "raw_id long, q struct<state:string, criteria:array<struct<key:string>>>, r struct<p:map<string,double>>, node string, _id int"


def nested_rows():
    deep = {"a": [{"x": 1}, 5, {"b": [{"c": None}]}], "e": {}}
    return [
        (1, (json.dumps(deep), [("k",), None, (None,)]), ({"yes": 0.5, "no": None},), "clash", 9),
        (2, ("[{\"z\": [true]}, NaN]", []), None, None, None), (3, None, ({},), None, None), (4, ("[[{}], {}]", None), (None,), None, None),
        (5, ("plain", None), None, None, None), (6, ("", None), None, None, None), (7, ('{"a": 1, "a": [{}]}', None), None, None, None), (8, ('"text"', None), None, None, None),
    ]


def test_shredding_finds_every_child(spark):
    df = spark.createDataFrame(nested_rows(), NESTED)
    nodes = shred(df, "raw_id", ["q", "r"], ["q.state"])
    got = {tuple(r) for r in children(nodes, "raw_id", ["q.criteria", "r.p"], ["q.state"]).collect()}
    assert got == {
        (1, "q.criteria", "0"), (1, "q.criteria", "2"), (1, "r.p", "yes"), (1, "r.p", "no"), (1, "q.state", "a.0"), (1, "q.state", "a.2"), (1, "q.state", "a.2.b.0"),
        (4, "q.state", "0.0"), (4, "q.state", "1"), (7, "q.state", "a.0"),
    }
    every = nodes.collect()
    names = {(r["raw_id"], r["node"]) for r in every}
    assert len(names) == len(every)
    assert all(r["parent"] is None or (r["raw_id"], r["parent"]) in names for r in every)  # links hold
    assert {r["kind"] for r in every if r["node"] == "q.state" and r["raw_id"] in (2, 5, 8)} == {"string"}


def test_entities_join_objects_and_scalars(spark):
    nodes = shred(spark.createDataFrame(nested_rows(), NESTED), "raw_id", ["q", "r"], ["q.state"])
    fields = {(r["raw_id"], r["node"]): r["fields"] for r in entities(nodes, "raw_id").collect()}
    assert fields[1, "q.state.a.0"] == {"x": "1"} and fields[1, "q.state.a.2.b.0"] == {"c": None} and fields[1, "q.state.e"] == {} and fields[1, "r.p"] == {"yes": "0.5", "no": None}
    rows = {r["node"]: r["key"] for r in entity_table(nodes, "raw_id", "q.criteria.[]", {"key": "string"}).where("raw_id = 1").collect()}
    assert rows == {"q.criteria.0": "k", "q.criteria.2": None}
    empty = shred(spark.createDataFrame([], NESTED), "raw_id", ["q", "r"], ["q.state"])
    assert empty.count() == 0 and entities(empty, "raw_id").count() == 0


def test_json_nodes_of_long_and_deep_texts():
    assert len(json_nodes(json.dumps([{"i": i} for i in range(5000)]))) == 10001
    assert len(json_nodes("[" * 500 + "]" * 500)) == 500
    assert json_nodes("[" * 1_000_000) is None and json_nodes(None) is None and json_nodes("[1,]") is None and json_nodes("[Infinity]") is None
    assert [n[0] for n in json_nodes('{"": [{}], "1.5e3": 1.5e3}')][0] == "" and json_nodes('{"n": 1.50}')[1][-1] == "1.50"


def test_intervals_against_brute_force(spark):
    rows = [("a", i, s, s + d) for i, (s, d) in enumerate([(0, 10), (10, 5), (9, 1), (3, 100), (50, 0), (99, 7), (104, 1)])] + [("b", 20, 0, 10), (None, 21, 0, 10)]
    df = spark.createDataFrame(rows, "key string, id int, start long, end long")
    got = {(r["left_id"], r["right_id"], r["start"], r["end"]) for r in A.overlapping_intervals(df, df, "key", 8).collect()}
    want = {(x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in rows for y in rows if x[0] and x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and max(x[2], y[2]) < min(x[3], y[3])}
    assert got == want and len(got) == A.overlapping_intervals(df, df, "key", 8).count()
    most = {(r["key"], r["cell"]): r["most"] for r in A.most_at_once(df, "key", 1000).collect()}
    assert most == {("a", 0): 3, ("b", 0): 1, (None, 0): 1}
    longer = [*rows, ("a", 22, 7, 400), ("c", 23, 30, 40), ("c", 24, 90, 91), ("c", 25, 91, 95)]
    for width in (3, 10, 64):
        want = {}
        for key, _, start, end in longer:
            for t in range(start, end):
                at = sum(k == key and a <= t < b for k, _, a, b in longer)
                want[key, t // width] = max(want.get((key, t // width), 0), at)
        got = A.most_at_once(spark.createDataFrame(longer, df.schema).repartition(5), "key", width).collect()
        assert {(r["key"], r["cell"]): r["most"] for r in got} == want and len(got) == len(want)
    assert A.most_at_once(df.limit(0), "key", 10).count() == 0


def test_arranging(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 4, True), ("b", 5, None), (None, 6, True)]
    df = spark.createDataFrame(rows, "k string, i int, ok boolean")
    assert {r["k"]: r["run"] for r in A.leading_run(df, ["k"], "i", F.col("ok")).collect()} == {"a": 1, "b": 1, None: 1}
    assert {r["k"]: r["i"] for r in A.latest(df, ["k"], ["i"], ["i", "ok"]).collect()} == {"a": 3, "b": 5, None: 6}
    one, two = (A.sampled(df.repartition(n), "i", ["k"], 2, "s").select("i", "place").collect() for n in (1, 5))
    assert sorted(one) == sorted(two) and len(one) == 5
    texts = spark.createDataFrame([("x", 2, "bb"), ("x", 1, "aa"), ("x", 3, None), ("x", 4, "longest")], "k string, i int, t string")
    r = A.extremes(texts, "k", F.length("t"), "i").first()
    assert (r["shortest"], r["longest"], r["most"]) == (1, 4, 7)
    robin = A.round_robin(spark.range(10).select(F.lit("s").alias("s"), "id", F.lit(4).alias("n")), ["s"], "id", "n")
    b = audits.balance(robin, ["s"], "position", "n").first()
    assert b["largest"] - b["smallest"] == 1
    hot = [("s" if i % 3 else None, f"{i:04d}", 3 + (i % 7 == 0), "kept") for i in range(600)]
    turns = A.round_robin(spark.createDataFrame(hot, "s string, id string, n int, other string").repartition(8), ["s"], "id", "n")
    places, want = {}, set()
    for k, i, n, other in hot:
        places[k, n] = places.get((k, n), -1) + 1
        want.add((k, i, n, other, places[k, n] % n))
    assert {tuple(r) for r in turns.collect()} == want and turns.count() == len(hot)
    assert A.round_robin(turns.drop("position").limit(0), ["s"], "id", "n").count() == 0
    doubled = A.with_reversed(spark.createDataFrame([("1", ["a", "b"], "choice"), ("2", ["c"], "noul")], "id string, keys array<string>, kind string"), "id", "keys", F.col("kind") == "choice")
    assert {(r["id"], tuple(r["keys"])) for r in doubled.collect()} == {("1", ("a", "b")), ("2", ("c",)), ("1_reverse", ("b", "a"))}


def test_audits(spark):
    df = spark.createDataFrame([("g", "train", "x  y"), ("g", "test", "x y "), ("h", "train", "z"), (None, "train", None), (None, "test", None)], "g string, split string, t string")
    assert [tuple(r) for r in audits.crossing(df, "g").collect()] == [("g", 2, "test,train")]
    signed = df.withColumn("sig", audits.signature(audits.collapsed(F.col("t"))))
    assert audits.crossing(signed, "sig").count() == 2  # equal texts, and the missing ones, which are equal too
    assert {tuple(r) for r in audits.repeated(df, ["g"]).collect()} == {("g", 2)}
    a = spark.createDataFrame([("1", "abcd12"), ("2", None), ("3", "ab")], "id string, t string")
    b = spark.createDataFrame([("p", "abcd99"), ("q", "zzzz")], "pid string, u string")
    assert [tuple(r) for r in audits.nearest_protected(a, "id", "t", b, "pid", "u").collect()] == [("1", "p", 1.0)]
    secrets = audits.secret_counts(spark.createDataFrame([("s", "a@b.co and c@d.org https://x.y"), ("s", None)], "k string, t string"), "t", ["k"]).first()
    assert (secrets["rows"], secrets["email"], secrets["url"]) == (2, 2, 1)


def test_strict_lines(spark, tmp_path):
    good = {"id": "1", "n": 2}
    lines = ["﻿" + json.dumps(good), "", "  ", '{"id": "2", "id": "3", "n": 1}', '{"id": "4", "n": NaN}', '{"id": "5"}', '{"id": "6", "n": 1, "x": 0}', "[1]", "{", json.dumps({"id": "é" * 600_000, "n": 1}), '{"id": "7", "n": 3, "o": "y"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines), encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("o", T.StringType())])
    rows, rejected = jsonl.read_cases(spark, str(tmp_path / "in.jsonl"), schema, ["o"])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", 2, None), ("7", 3, "y")]
    assert sorted(r["error"] for r in rejected.collect()) == ["missing field", "not an object", "not valid JSON", "not valid JSON", "not valid JSON", "too long", "unknown field"]
    (tmp_path / "one.json").write_text('{"id": "x", "n": 5}')
    plain = T.StructType([T.StructField("n", T.LongType())])
    assert [tuple(r) for r in jsonl.unlabelled(spark, str(tmp_path / "one.json"), plain).collect()] == [("prediction-0", 5)]
    (tmp_path / "many.json").write_text('[{"n": 5}, {"n": 6, "label": "a"}]')
    with pytest.raises(Exception, match="must not carry a label"):
        jsonl.unlabelled(spark, str(tmp_path / "many.json"), plain).collect()


def test_exports_come_back(spark, tmp_path):
    rows = [("1", 'a "quoted", \r\nline', ["x"]), ("2", None, None), ("3", "  blank ends ", []), ("4", "", ["é"])]
    df = spark.createDataFrame(rows, "id string, t string, a array<string>")
    exports.export(df, str(tmp_path / "out"), ["id", "t", "a"])
    assert exports.round_trip_differences(df, str(tmp_path / "out"), ["id", "t", "a"]).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        exports.export(df, str(tmp_path / "out"), ["id", "t", "a"])
    assert exports.round_trip_differences(df.where("id <> '1'"), str(tmp_path / "out"), ["id", "t", "a"]).count() == 2


def test_inventory(spark, tmp_path):
    for n, text in (("a.txt", "1"), ("b.txt", "2")):
        (tmp_path / n).write_text(text)
    before = spark.createDataFrame(jsonl.inventory(spark, str(tmp_path), "*.txt").collect())
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("3")
    found = {r["path"][-5:]: r["state"] for r in jsonl.manifest_differences(jsonl.inventory(spark, str(tmp_path), "*.txt"), before).collect()}
    assert found == {"a.txt": "changed", "c.txt": "new"}


def test_streams_equal_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2025, 1, 1)
    rows = [(i // 2, "e" if i % 3 else None, True, i % 4 > 0, start + timedelta(hours=5 * i), start + timedelta(hours=6 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "run_no long, engine string, valid boolean, correct boolean, started_at timestamp, received_at timestamp")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    got = progress.drained(progress.daily_progress(progress.answer_stream(spark, str(tmp_path / "in"), 2)), ["day", "engine"])
    want = df.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day"), "engine").agg(F.count("*").alias("n"), F.count_if(F.col("valid") & F.col("correct")).alias("correct"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    first = progress.first_deliveries(progress.answer_stream(spark, str(tmp_path / "in"), 2))
    q = first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n, count(DISTINCT run_no) AS d FROM firsts").first() == (20, 20)


def test_stream_counts_late_files(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, "e", True, True, datetime(2025, 1, 1) + timedelta(hours=i * 7919 % 2160), datetime(2025, 4, 1)) for i in range(1200)]
    df = spark.createDataFrame(rows, "run_no long, engine string, valid boolean, correct boolean, started_at timestamp, received_at timestamp")
    df.repartition(12).write.parquet(str(tmp_path / "in"))
    got = progress.drained(progress.daily_progress(progress.answer_stream(spark, str(tmp_path / "in"), 4)), ["day", "engine"])
    want = df.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day"), "engine").agg(F.count("*").alias("n"), F.count_if(F.col("valid") & F.col("correct")).alias("correct"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dotted_keys_keep_their_links(spark):
    rows = [(1, json.dumps({"a": {"b": {"x": 1}}, "a.b": {"y": 2}, "~1": [{"c.d": [{"z": 3}]}], "": {"": 4}}), {"p.q": ("one",), "p": ("two",)})]
    df = spark.createDataFrame(rows, "i int, s string, m map<string,struct<`q.r`:string>>").select("i", F.struct("s").alias("q"), "m")
    nodes = shred(df, "i", ["q", "m"], ["q.s"])
    every = nodes.collect()
    names = {r["node"] for r in every}
    assert len(names) == len(every) and all(r["parent"] is None or r["parent"] in names for r in every)
    fields = {r["node"]: r["fields"] for r in entities(nodes, "i").collect()}
    assert fields["q.s.a.b"] == {"x": "1"} and fields["q.s.a~1b"] == {"y": "2"} and fields["q.s."] == {"": "4"} and fields["m.p~1q"] == {"q.r": "one"}
    assert {r["child_key"] for r in children(nodes, "i", ["m"], ["q.s"]).collect()} == {"~1.0", "~1.0.c.d.0", "p.q", "p"}


@pytest.mark.parametrize("depth", [600, 5000, 50_000])
def test_json_of_any_depth(depth):
    nodes = json_nodes("[" * depth + '{"a": 1}' + "]" * depth)
    assert len(nodes) == depth + 2 and nodes[depth][6] == ".".join("0" * depth) and nodes[-1][-1] == "1"
    assert len({n[0] for n in nodes}) == len(nodes) and max(len(n[0]) for n in nodes) <= 520


@pytest.mark.parametrize("text", ["[1,]", "[1 2]", '{"a" 1}', '{"a": 1,}', "[", "]", "{]", "[NaN]", "[01]", '["\n"]', "[1] x", "", "nul", '{1: 2}', "[,]"])
def test_the_reader_with_a_stack_refuses_what_the_library_does(text):
    with pytest.raises(ValueError):
        strict_json._stacked(text, dict, strict_json.Number)
    with pytest.raises(ValueError):
        strict_json.read(text)


def test_the_reader_with_a_stack_reads_what_the_library_does():
    texts = ["[]", "{}", " [1, -2.50e3, true, null, \"x\\u00e9\\\"\"] ", '{"a": {"b": [[], {}]}, "a": 2}', "7", '"s"']
    for t in texts:
        want = json.loads(t)
        assert strict_json._stacked(t, dict, json.loads) == want == strict_json.read(t, dict, json.loads)
        assert strict_json.sorted_text(want) == json.dumps(want, sort_keys=True, ensure_ascii=False)


def test_guarded_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "あ"), (2, None, None)], "i int, x double, t string")
    exports.write_json(df, f"{tmp_path}/a")
    exports.write_json(df, f"{tmp_path}/a")
    assert sorted(r["i"] for r in spark.read.json(f"{tmp_path}/a").collect()) == [1, 2]
    with pytest.raises(Exception, match="finite"):
        exports.attempted(spark, f"{tmp_path}/b", lambda: exports.write_json(df.withColumn("x", F.lit(float("nan"))), f"{tmp_path}/b/rows"))
    assert "finite" in json.loads(spark.read.text(f"{tmp_path}/b/failure").first()[0])["message"]
    exports.export(df, f"{tmp_path}/c", ["i", "t"])
    listed = {r["path"]: r["sha256"] for r in exports.manifest(spark, f"{tmp_path}/c").collect()}
    assert {p.split("/")[0] for p in listed} == {"jsonl", "csv"}
    assert all(hashlib.sha256((tmp_path / "c" / p).read_bytes()).hexdigest() == h for p, h in listed.items())


def test_summaries(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], [1.0]), ("b", [], []), ("c", None, None)], "i string, k array<string>, z array<double>")
    assert {tuple(r) for r in summaries.positional(rows, ["i"], key="k", logit="z").collect()} == {("a", 0, "x", 1.0), ("a", 1, "y", None)}
    kinds = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert {tuple(r) for r in summaries.unexpected_counts(kinds, "k", {"a": 2, "b": 2, "c": 1}).collect()} == {(None, 1, 0), ("b", 1, 2), ("c", 0, 1)}
    one = spark.range(1).select(summaries.order_free(F.array(F.lit("q"), F.lit("p"), F.lit(None), F.lit("q"))).alias("a"), summaries.order_free(F.array(F.lit("p"), F.lit("q"))).alias("b")).first()
    assert one["a"] == one["b"]
    new = spark.createDataFrame([("1", "s", "g"), ("2", "s", "g"), ("3", "t", "g"), ("4", "u", None), ("5", None, "g")], "i string, key string, g string")
    got = summaries.balanced_new(new, spark.createDataFrame([("t",), (None,)], "key string"), "key", "i", ["g"], 2, "s")
    assert {r["i"] for r in got.collect()} == {"1", "4"}
    shapes = spark.createDataFrame([("a" * 40,), ("a" * 64,), ("A" * 40,), (None,)], "t string").select(summaries.is_commit(F.col("t")), summaries.is_sha256(F.col("t")))
    assert [tuple(r) for r in shapes.collect()] == [(True, False), (False, True), (False, False), (False, False)]
    empty = spark.createDataFrame([], "engine string, valid boolean, correct boolean, error string, wall_ms double, input_tokens int, output_tokens int, reverse struct<same_label boolean>")
    assert summaries.run_summary(empty, [["engine"]]).count() == 0
