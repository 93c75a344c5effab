import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrin.functions import decision as D
from veldrin.operators import answers as ans
from veldrin.operators.learning import Head
from veldrin.sources import checkpoints as ck
from veldrin.sources.jsonl import inventory


def test_typed_answers(spark):
    rows = [("choice", ["a", "b"], [0.0, math.log(3)]), ("noul", ["false", "true"], [0.0, math.log(3)]), ("score", ["0", "1", "2"], [0.0, 0.0, 0.0]), ("score", ["0"], None)]
    got = [r["answer"] for r in ans.typed_answer(spark.createDataFrame(rows, "kind string, keys array<string>, z array<double>").coalesce(1)).collect()]
    assert got[0]["choice"] == "b" and got[1]["noul"] == pytest.approx(0.75) and got[2]["score"] == pytest.approx(1) and got[2]["confidence"] == pytest.approx(0) and got[3] is None
    assert got[2]["label"] == "0" and not got[0]["calibrated"]


def test_permuted_choices_and_temperatures_keep_the_label(spark):
    df = spark.range(200).select("id", F.array(*(F.rand(s) * 9 for s in range(5))).alias("z"))
    keys = F.array(*map(F.lit, "abcde"))
    back = D.at(F.reverse(keys), D.argmax(D.softmax(F.reverse("z"))))
    hot = D.at(keys, D.argmax(D.softmax(F.col("z"), 7.0)))
    wrong = df.where((D.at(keys, D.argmax(F.col("z"))) != back) | (back != hot) | (F.abs(D.total(D.softmax(F.col("z"))) - 1) > 1e-9))
    assert wrong.count() == 0


def test_errors_of_answers(spark):
    good = ("a", ["a", "b"], {"a": 0.75, "b": 0.25}, [1.0, 0.0], 0.2, 5, 1.0)
    bad = [good, ("z", ["a", "b"], {"a": 0.2, "c": 0.9}, [1.0], 2.0, 0, -1.0), (None, ["a"], None, None, None, None, None), ("b", *good[1:]), ("a", ["a", "b"], {"a": 1.0, "b": None}, [1.0, float("nan")], float("nan"), 1, 0.0)]
    df = spark.createDataFrame(bad, "label string, keys array<string>, p map<string,double>, z array<double>, c double, t int, l double").coalesce(1)
    got = [r["e"] for r in df.select(ans.answer_errors(*(F.col(x) for x in ("label", "keys", "p", "z", "c", "t", "l"))).alias("e")).collect()]
    assert got[0] == [] and got[3] == ["label is not the likeliest"]
    assert set(got[1]) == {"label is no candidate", "other keys", "sum is not one", "logits missing", "confidence out of range", "no tokens", "no latency"}
    assert set(got[2]) == {"no label", "no probabilities", "logits missing", "confidence out of range", "no tokens", "no latency"}
    assert set(got[4]) == {"probability missing", "logit not finite", "confidence out of range"}


def test_prompts_show_no_label(spark):
    options = F.array(F.struct(F.lit("k").alias("key"), F.lit("first").alias("description")), F.struct(F.lit("l").alias("key"), F.lit(None).cast("string").alias("description")))
    text = spark.range(1).select(ans.prompt(F.lit("S"), F.lit("Q?"), options, F.array(F.lit("A"), F.lit("B")), 2).alias("t")).first()["t"]
    once = "[state]\nS\n[question]\nQ?\n[options]\nA) first\nB) l"
    assert text == once + "\n\n" + once


def test_projection_equals_full_product(spark):
    rng = np.random.default_rng(1)
    h, w = rng.normal(size=4).tolist(), rng.normal(size=(6, 4)).tolist()
    df = spark.createDataFrame([(h, w)], "h array<double>, w array<array<double>>")
    full = ans.projected(F.col("h"), F.col("w"))
    r = df.select(full.alias("f"), ans.projected(F.col("h"), ans.gathered(F.col("w"), F.array(F.lit(4), F.lit(1)))).alias("s"), ans.candidate_mass(full, full).alias("m"), ans.residual_logits(full, F.col("h"), F.col("w"), F.array_repeat(F.lit(1.0), 6)).alias("r")).first()
    assert r["f"] == pytest.approx((np.array(w) @ h).tolist()) and r["s"] == pytest.approx([r["f"][4], r["f"][1]]) and r["m"] == pytest.approx(1)
    assert r["r"] == pytest.approx((np.array(w) @ h + np.array(w) @ (np.array(h) / np.sqrt(np.mean(np.square(h)))) + 1).tolist())


def test_comparisons_and_limits(spark):
    df = spark.createDataFrame([(("a", 0.5), ("a", 0.5 + 1e-9), 3), (("a", None), ("b", None), None)], "x struct<label:string,p:double>, y struct<label:string,p:double>, n int").coalesce(1)
    got = df.select(ans.same_decision(F.col("x"), F.col("y"), ["label", "p"]).alias("e"), ans.same_decision(F.col("x"), F.col("y"), ["label", "p"], 1e-6).alias("t")).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, False)]
    fit, rest = ans.within_limit(df, "n", 3)
    assert (fit.count(), rest.count()) == (1, 1)
    a, b = spark.createDataFrame([("k",), ("k",), (None,)], "k string"), spark.createDataFrame([("k",), (None,)], "k string")
    assert [tuple(r) for r in ans.count_differences(a, b, ["k"]).collect()] == [("k", 2, 1)] and ans.count_differences(a, a, ["k"]).count() == 0


def test_checkpoints(spark, tmp_path):
    head = Head(np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([0.5, -0.5]), 0.3, 0.1, 0.001, 5)
    folder = str(tmp_path / "head")
    ck.save_head(spark, head, folder, 1.5, {"b": 1, "a": 2})
    loaded, t = ck.load_head(spark, folder, {"a": 2, "b": 1})
    assert (loaded.weights == head.weights).all() and (loaded.bias == head.bias).all() and t == 1.5 and loaded.epoch == 5
    with pytest.raises(ValueError, match="identity"):
        ck.load_head(spark, folder, {"a": 3})
    with pytest.raises(Exception, match="(?i)exists"):
        ck.save_head(spark, head, folder, 1.5, {})
    spark.createDataFrame([(0, [1.0, 9.0], 0.5), (1, [3.0, 4.0], -0.5)], "slot int, weight array<double>, bias double").write.mode("overwrite").parquet(f"{folder}/weights")
    with pytest.raises(ValueError, match="weights"):
        ck.load_head(spark, folder, {"a": 2, "b": 1})
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert ck.cached(spark, str(tmp_path / "cache"), {"v": 1}, make).count() == 3
    assert len(made) == 1 and ck.provenance(spark).first()["spark"] == spark.version


def test_file_rules_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("a.txt", 5), ("b.env", 5), ("c.txt", 50)):
        (tmp_path / "in" / name).write_text("x" * size)
    files = inventory(spark, str(tmp_path / "in"))
    got = {(r["path"].rpartition("/")[2], r["rule"]) for r in ck.file_rule_breaks(files, 20, required=("a.txt", "LICENSE")).collect()}
    assert got == {("b.env", "not for publication"), ("c.txt", "too large"), ("LICENSE", "missing")}
    text = ck.markdown(spark.createDataFrame([("a|b", None)], "k string, v int"), str(tmp_path / "r.md"))
    assert text == "| k | v |\n| --- | --- |\n| a\\|b |  |\n" == (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="rows"):
        ck.markdown(spark.range(5), str(tmp_path / "s.md"), 4)
