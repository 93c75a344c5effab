import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrin.functions import decision as D
from veldrin.functions.scorer import HashScorer, with_logits
from veldrin.operators import calibration, metrics
from veldrin.operators.candidates import first_error, option_rows
from veldrin.operators.learning import train_head, train_heads


def one(spark, expr, **values):
    from pyspark.sql import types as T

    kinds = {"z": "array<double>", "p": "array<double>", "q": "array<double>", "keys": "array<string>", "order": "array<string>", "gold": "int", "kind": "string", "n": "int", "h": "array<double>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))
    assert isinstance(df.schema, T.StructType)
    return df.select(expr.alias("x")).first()["x"]


def test_known_answers(spark):
    assert one(spark, D.softmax(F.col("z")), z=[0.0, math.log(3)]) == pytest.approx([0.25, 0.75])
    assert one(spark, D.brier(F.col("p"), F.col("gold")), p=[0.25, 0.75], gold=1) == pytest.approx(0.125)
    assert one(spark, D.nll(D.at(F.col("p"), F.col("gold"))), p=[0.25, 0.75], gold=1) == pytest.approx(-math.log(0.75))
    assert one(spark, D.expectation(F.col("p")), p=[0.25, 0.75]) == pytest.approx(0.75)
    assert one(spark, D.confidence(F.col("p")), p=[0.5, 0.5]) == pytest.approx(0) and one(spark, D.confidence(F.col("p")), p=[1.0, 0.0]) == 1
    assert one(spark, D.argmax(F.col("p")), p=[0.4, 0.4, 0.2]) == 0  # the first of equals
    assert one(spark, D.total_variation(F.col("p"), F.col("q")), p=[0.25, 0.75], q=[0.5, 0.5]) == pytest.approx(0.25)
    assert one(spark, D.aligned(F.col("p"), F.col("keys"), F.col("order")), p=[0.1, 0.9], keys=["b", "a"], order=["a", "b", "c"]) == [0.9, 0.1, None]


def test_extreme_logits_and_nulls(spark):
    p = one(spark, D.softmax(F.col("z"), 0.1), z=[1000.0, -1000.0])
    assert p == pytest.approx([1, 0]) and sum(p) == pytest.approx(1)
    assert one(spark, D.log_sum_exp(F.col("z")), z=[1000.0, 1000.0]) == pytest.approx(1000 + math.log(2))
    assert one(spark, D.softmax(F.col("z")), z=None) is None and one(spark, D.softmax(F.col("z")), z=[]) is None
    assert one(spark, D.nll(D.at(F.col("p"), F.col("gold"))), p=[0.0, 1.0], gold=0) == pytest.approx(-math.log(1e-300))


@pytest.mark.parametrize(("kind", "n", "want"), [("score", 2, list("01")), ("score", 10, list("0123456789")), ("score", 11, list("ABCDEFGHIJK")), ("choice", 3, list("ABC")), ("noul", 2, list("AB")), ("choice", 0, [])])
def test_symbols_switch_after_ten_stages(spark, kind, n, want):
    assert one(spark, D.symbols(F.col("kind"), F.col("n")), kind=kind, n=n) == want


def test_options_and_first_errors(spark):
    rows = [("1", "Choice ", "s", "i", '{"b": "B", "a": "A"}', "a"), ("2", "noul", "s", "i", None, "true"), ("3", "score", "s", "i", '["x", "y"]', "2"), ("4", "odd", "s", "i", None, "a"), ("5", "choice", " ", "i", '{"a": "A", "b": "B"}', "a"), ("6", "choice", "s", "i", "{broken", "a"), ("7", "score", "s", "i", '["x"]', "0"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, type string, state string, instructions string, criteria string, label string")
    got = {(r["id"], r["ord"]): r["key"] for r in option_rows(df).collect()}
    assert [got[k] for k in (("1", 0), ("1", 1), ("2", 0), ("2", 1), ("3", 1))] == ["a", "b", "false", "true", "1"]
    errors = {r["id"]: r["error"] for r in first_error(df).select("id", "error").collect()}
    assert errors == {"1": None, "2": None, "3": "label is no candidate", "4": "unknown type", "5": "no state", "6": "criteria unreadable", "7": "too few candidates", None: "no id"}


def test_metrics_and_reliability(spark):
    scored = spark.createDataFrame([([0.25, 0.75], 1)], "p array<double>, gold int")
    r = metrics.losses(scored).first()
    assert (r["n"], r["correct"], r["nll"], r["brier"], r["mae"]) == (1, 1, round(-math.log(0.75), 6), 0.125, 0.25)
    rows = spark.createDataFrame([(0.75, True), (None, True), (1.0, None)], "c double, ok boolean")
    table = metrics.reliability(rows, "c", "ok")
    assert {x["bin"]: x["n"] for x in table.collect()} == {b: int(b in (7, 9)) for b in range(10)}
    assert metrics.calibration_error(table).first()["ece"] == round((0.25 + 1) / 2, 4)
    assert metrics.calibration_error(metrics.reliability(rows.where("false"), "c", "ok")).first()["ece"] is None


def test_exact_percentiles(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0), (None, 5.0), ("b", None), ("c", float("nan"))], "k string, v double")
    got = {r["k"]: r["percentile"] for r in metrics.exact_percentiles(rows, ["k"], "v", [0.95]).collect()}
    assert got == {"a": pytest.approx(29), None: 5.0}
    many = spark.range(20001).select(F.lit("x").alias("k"), (F.col("id") % 10007).cast("double").alias("v"))
    got = {r["share"]: r["percentile"] for r in metrics.exact_percentiles(many, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    exact = {r["s"]: r["p"] for r in many.select(F.explode(F.array(*map(F.lit, (0.0, 0.5, 0.9, 1.0)))).alias("s"), "v").groupBy("s").agg(F.expr("percentile(v, array(0.0, 0.5, 0.9, 1.0))").alias("all")).selectExpr("s", "all[cast(array_position(array(0.0D, 0.5D, 0.9D, 1.0D), s) - 1 as int)] as p").collect()}
    assert got == pytest.approx(exact)


def test_temperature_search(spark):
    rows = [([2.0, 0.0], 0)] * 8 + [([2.0, 0.0], 1)] * 2 + [(None, 0), ([1.0, 1.0], None)]
    table = calibration.grid_nll(spark.createDataFrame(rows, "z array<double>, gold int"), calibration.grid(201))
    r = calibration.best(table).first()
    assert r["n"] == 10 and not r["at_boundary"] and r["temperature"] == pytest.approx(2 / math.log(4), rel=0.02)
    flat = calibration.grid_nll(spark.createDataFrame([([1.0, 1.0], 0)], "z array<double>, gold int"), calibration.grid(3))
    assert calibration.best(flat).first()["temperature"] == 1.0  # of equals the one nearest 1
    assert calibration.grid_nll(spark.createDataFrame([], "z array<double>, gold int"), [1.0]).count() == 0


def test_head_learns_and_is_never_worse(spark):
    rows = spark.range(200).select(F.array((F.col("id") % 2 * 2 - 1).cast("double"), F.lit(1.0)).alias("x"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"), (F.col("id") % 2).cast("int").alias("gold"), (F.col("id") % 5 == 0).alias("dev"))
    head = train_head(rows, 2, 2, epochs=10)
    assert head.dev_nll < math.log(2) - 0.2 and head.epoch == 10
    none = train_head(rows.withColumn("gold", F.lit(0)).where("dev"), 2, 2, epochs=2)
    assert none.dev_nll == pytest.approx(math.log(2)) and none.epoch == 0


def test_scorer_does_not_depend_on_batches(spark):
    rows = [(str(i), f"prompt {i}", ["yes", "no"] if i % 3 else None) for i in range(50)] + [("e", None, []), ("n", "x", ["", None])]
    df = spark.createDataFrame(rows, "id string, prompt string, shown array<string>")
    a = {r["id"]: r["logits"] for r in with_logits(df.repartition(7), HashScorer(), "prompt", "shown").collect()}
    b = {r["id"]: r["logits"] for r in with_logits(df.coalesce(1), HashScorer(), "prompt", "shown").collect()}
    assert a == b and a["0"] is None and a["e"] is None and len(a["n"]) == 2


def test_training_equals_a_plain_run(spark):
    rng = np.random.default_rng(3)
    x, count, dev = rng.normal(size=(60, 3)), rng.integers(2, 5, 60), rng.random(60) < 0.3
    z, gold = rng.normal(size=(60, 4)), rng.integers(0, count)
    rows = spark.createDataFrame([(x[i].tolist(), z[i, : count[i]].tolist(), int(gold[i]), bool(dev[i])) for i in range(60)], "x array<double>, z array<double>, gold int, dev boolean").repartition(3)
    history = []
    train_heads(rows, 4, 3, rates=(0.05,), penalties=(0.1,), epochs=12, every=4, controls=("bias", "residual"), history=history)
    want = []
    for control in ("bias", "residual"):
        theta, m, v = np.zeros((4, 4)), np.zeros((4, 4)), np.zeros((4, 4))
        xs, there = np.concatenate([x, np.ones((60, 1))], axis=1), np.arange(4) < count[:, None]
        for epoch in range(13):
            delta = xs @ theta.T
            logits = np.where(there, z + delta, -np.inf)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            if epoch % 4 == 0:
                want.append((control, 0.05, 0.1, epoch, -np.log(p[np.arange(60), gold])[dev].mean()))
            own, t = p - np.eye(4)[gold], ~dev
            g = own[t].T @ xs[t] / t.sum() + 0.1 * 2 * np.where(there, delta, 0)[t].T @ xs[t] / there[t].sum()
            if control == "bias":
                g[:, :-1] = 0
            g *= min(1.0, 5.0 / (np.sqrt((g * g).sum()) + 1e-6))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.05 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    assert [h[:4] for h in sorted(history)] == [w[:4] for w in sorted(want)]
    assert max(abs(h[4] - w[4]) for h, w in zip(sorted(history), sorted(want))) < 1e-9
