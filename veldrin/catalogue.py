"""Registered queries of the core library and the SQL that each is compared with."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decision as D
from .functions.scorer import HashScorer, with_logits
from .operators import arranging as A
from .operators import answers as ANS
from .operators import audits, calibration, metrics
from .operators.candidates import first_error, kind_of, option_rows, with_options
from .operators.learning import train_heads
from .operators.shred import children, entities, entity_table, shred
from .plans.staging import shared_dir, stage, table
from .sources import exports
from .sources.jsonl import checked
from .streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Decisions: audit records with candidate logits beside the labelled case


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(raw_id, id, run_key, kind, keys, z, gold, result)`` of records with as many logits as keys; gold is null for unknown labels."""
    raw = table(spark, sf_dir, "raw").where("result IS NOT NULL").select("raw_id", "id", "run_key", "result")
    gold = table(spark, sf_dir, "eval_ja").select("id", "label")
    whole = raw.join(gold, "id").where((F.size("result.candidate_logits") > 0) & (F.size("result.candidate_logits") == F.size("result.candidate_keys")))
    place = F.array_position("result.candidate_keys", F.col("label"))
    return whole.select("raw_id", "id", "run_key", kind_of(F.col("result.type")).alias("kind"), F.col("result.candidate_keys").alias("keys"), F.col("result.candidate_logits").alias("z"), F.when(place > 0, place - 1).cast("int").alias("gold"), "result")


DECISIONS = """
    decisions AS (
        SELECT r.raw_id, r.id, r.run_key, lower(trim(r.result.type)) AS kind, r.result.candidate_keys AS keys, r.result.candidate_logits AS z, r.result AS result,
            CASE WHEN list_contains(r.result.candidate_keys, e.label) THEN CAST(list_position(r.result.candidate_keys, e.label) AS INTEGER) - 1 END AS gold
        FROM raw r JOIN eval_ja e ON e.id = r.id
        WHERE r.result IS NOT NULL AND len(r.result.candidate_logits) > 0 AND len(r.result.candidate_logits) = len(r.result.candidate_keys)
    )"""


def _softmax_sql(source: str, t: str = "1.0") -> str:
    """Rows of ``source`` with ``p``, the softmax of ``z``."""
    return f"SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT *, list_transform(z, lambda x: exp((x - list_max(z)) / {t})) AS e FROM {source})"


ENTROPY = "list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * ln(x)))"
MEAN = "list_sum(list_transform(p, lambda x, i: x * (i - 1)))"
BRIER = "list_sum(list_transform(p, lambda x, i: pow(x - CASE WHEN i - 1 = gold THEN 1 ELSE 0 END, 2)))"

#: Logits made of the first ten components of an embedding; its label is the gold class.
EMBEDDED = "embedded AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS z, label AS gold FROM embeddings)"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"), F.col("label").alias("gold"))


@query(f"""
    WITH {EMBEDDED}, soft AS ({_softmax_sql("embedded")})
    SELECT count(*) AS n, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = gold) AS correct, round(avg(-ln(greatest(p[gold + 1], 1e-300))), 6) AS nll,
        round(avg({BRIER}), 6) AS brier, round(avg(abs(least(len(p) - 1, greatest(0, {MEAN})) - gold)), 6) AS mae
    FROM soft
""")
def decision_choice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.losses(embedded(spark, sf_dir).withColumn("p", D.softmax(F.col("z"))))


@query(f"""
    WITH {DECISIONS}, soft AS ({_softmax_sql("decisions", "1.349")})
    SELECT raw_id, kind, keys[list_position(p, list_max(p))] AS label, round(greatest(0, least(1, 1 + {ENTROPY} / ln(len(p)))), 6) AS confidence,
        CASE WHEN kind = 'noul' THEN round(p[2], 6) END AS noul, CASE WHEN kind = 'score' THEN round(greatest(0, least(len(p) - 1, {MEAN})), 6) END AS score
    FROM soft
""")
def decision_typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = decisions(spark, sf_dir).withColumn("p", D.softmax(F.col("z"), 1.349))
    p = F.col("p")
    return soft.select(
        "raw_id", "kind", D.at(F.col("keys"), D.argmax(p)).alias("label"), F.round(D.confidence(p), 6).alias("confidence"),
        F.when(F.col("kind") == "noul", F.round(D.at(p, F.lit(1)), 6)).alias("noul"), F.when(F.col("kind") == "score", F.round(D.expectation(p), 6)).alias("score"),
    )


@query(f"""
    WITH {DECISIONS}, soft AS ({_softmax_sql("decisions")})
    SELECT kind, count(*) AS n, count(gold) AS labelled, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = gold) AS correct,
        round(avg(-ln(greatest(p[gold + 1], 1e-15))), 6) AS nll, round(avg(CASE WHEN kind = 'score' THEN abs({MEAN} - gold) END), 6) AS mae,
        round(avg(CASE WHEN kind = 'score' THEN abs({MEAN} - gold) / (len(p) - 1) END), 6) AS normalised_mae
    FROM soft GROUP BY kind
""")
def decision_metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = decisions(spark, sf_dir).withColumn("p", D.softmax(F.col("z")))
    p, gold, score = F.col("p"), F.col("gold"), F.col("kind") == "score"
    off = F.abs(D.expectation(p) - gold)
    return soft.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("gold").alias("labelled"), F.count_if(D.argmax(p) == gold).alias("correct"), F.round(F.avg(D.nll(D.at(p, gold), 1e-15)), 6).alias("nll"),
        F.round(F.avg(F.when(score, off)), 6).alias("mae"), F.round(F.avg(F.when(score, off / (F.size(p) - 1))), 6).alias("normalised_mae"),
    )


@query(f"""
    WITH {DECISIONS}, soft AS ({_softmax_sql("decisions")}), told AS (SELECT *, list_transform(keys, lambda k: result.probabilities[k]) AS q FROM soft)
    SELECT kind, count(*) AS n, count(*) FILTER (WHERE cardinality(result.probabilities) IS DISTINCT FROM len(keys)) AS other_keys,
        count(*) FILTER (WHERE result.label IS DISTINCT FROM keys[list_position(z, list_max(z))]) AS other_label,
        count(*) FILTER (WHERE abs(list_sum(map_values(result.probabilities)) - 1) > 1e-5) AS sum_off, count(*) FILTER (WHERE result.confidence < 0 OR result.confidence > 1) AS confidence_off,
        count(*) FILTER (WHERE result.calibrated) AS calibrated
    FROM told GROUP BY kind
""")
def answer_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, z, keys = F.col("result"), F.col("z"), F.col("keys")
    label = D.at(keys, D.argmax(z))
    count = lambda broken, name: F.count_if(F.coalesce(broken, F.lit(False))).alias(name)
    values = F.filter(F.map_values(r["probabilities"]), lambda x: x.isNotNull())
    off = F.when(F.size(values) > 0, F.abs(D.total(values) - 1) > 1e-5)
    return decisions(spark, sf_dir).groupBy("kind").agg(
        F.count("*").alias("n"), count(~F.when(r["probabilities"].isNotNull(), F.size(r["probabilities"])).eqNullSafe(F.size(keys)), "other_keys"),
        count(~r["label"].eqNullSafe(label), "other_label"), count(off, "sum_off"), count((r["confidence"] < 0) | (r["confidence"] > 1), "confidence_off"), count(r["calibrated"], "calibrated"),
    )


@query(f"""
    WITH {DECISIONS}, p AS ({_softmax_sql("decisions")}), q AS ({_softmax_sql("decisions", "2.0")})
    SELECT p.kind, count(*) AS n, round(max(list_max(list_transform(list_zip(p.p, q.p), lambda x: abs(x[1] - x[2])))), 6) AS largest,
        round(avg(0.5 * list_sum(list_transform(list_zip(p.p, q.p), lambda x: abs(x[1] - x[2])))), 6) AS total_variation
    FROM p JOIN q ON p.raw_id = q.raw_id GROUP BY p.kind
""")
def projection_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(spark, sf_dir).select("kind", D.softmax(F.col("z")).alias("p"), D.softmax(F.col("z"), 2.0).alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.max(D.largest_difference(p, q)), 6).alias("largest"), F.round(F.avg(D.total_variation(p, q)), 6).alias("total_variation"))


@query(f"""
    WITH {DECISIONS}, soft AS ({_softmax_sql("decisions")}), back AS (SELECT raw_id, list_reverse(keys) AS rk, list_reverse(p) AS rp FROM soft)
    SELECT soft.raw_id, round(rp[list_position(rk, keys[1])], 6) AS first_p, round(rp[list_position(rk, keys[len(keys)])], 6) AS last_p, keys[list_position(p, list_max(p))] = rk[list_position(rp, list_max(rp))] AS same_label
    FROM soft JOIN back USING (raw_id) WHERE kind = 'choice'
""")
def reversed_choice_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices shown in reverse order, with the probabilities laid side by side by key again."""
    rows = decisions(spark, sf_dir).where("kind = 'choice'").select("raw_id", "keys", D.softmax(F.col("z")).alias("p"))
    back = rows.select("raw_id", F.reverse("keys").alias("rk"), F.reverse("p").alias("rp"))
    same = D.at(F.col("keys"), D.argmax(F.col("p"))) == D.at(F.col("rk"), D.argmax(F.col("rp")))
    laid = rows.join(back, "raw_id").withColumn("q", D.aligned(F.col("rp"), F.col("rk"), F.col("keys")))
    return laid.select("raw_id", F.round(F.element_at("q", 1), 6).alias("first_p"), F.round(F.element_at("q", -1), 6).alias("last_p"), same.alias("same_label"))


@query(f"""
    WITH {EMBEDDED}, h AS (SELECT vec_id, z, sqrt(list_sum(list_transform(z, lambda x: x * x)) / len(z)) AS scale FROM embedded)
    SELECT vec_id, round(list_sum(list_transform(z, lambda x: abs(x / greatest(scale, 1e-6)))), 5) AS size, round(list_max(list_transform(z, lambda x: x / greatest(scale, 1e-6))), 5) AS top FROM h
""")
def rms_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir).select("vec_id", D.rms_normalised(F.col("z")).alias("h"))
    return rows.select("vec_id", F.round(D.total(F.transform("h", F.abs)), 5).alias("size"), F.round(F.array_max("h"), 5).alias("top"))


# Calibration

GRID = calibration.grid()


@query(f"""
    WITH {EMBEDDED}, t AS (SELECT unnest(range(201)) AS idx), g AS (SELECT CAST(idx AS INTEGER) AS idx, round(pow(10, -1 + 2.0 * idx / 200), 9) AS temperature FROM t),
        s AS (SELECT idx, temperature, gold, list_transform(z, lambda x: x / temperature) AS y FROM embedded, g)
    SELECT idx, temperature, count(*) AS n, round(avg(list_max(y) + ln(list_sum(list_transform(y, lambda x: exp(x - list_max(y))))) - y[gold + 1]), 6) AS nll FROM s GROUP BY idx, temperature
""")
def temperature_grid_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.grid_nll(embedded(spark, sf_dir), GRID, floor=0).withColumn("nll", F.round("nll", 6))


@query(f"""
    WITH {EMBEDDED}, t AS (SELECT unnest(range(201)) AS idx), g AS (SELECT CAST(idx AS INTEGER) AS idx, round(pow(10, -1 + 2.0 * idx / 200), 9) AS temperature FROM t),
        s AS (SELECT idx, temperature, gold, list_transform(z, lambda x: x / temperature) AS y FROM embedded, g),
        l AS (SELECT idx, temperature, count(*) AS n, avg(list_max(y) + ln(list_sum(list_transform(y, lambda x: exp(x - list_max(y))))) - y[gold + 1]) AS nll FROM s GROUP BY idx, temperature)
    SELECT idx, temperature, n, round(nll, 6) AS nll, idx IN (0, 200) AS at_boundary FROM l ORDER BY round(nll, 9), abs(ln(temperature)), temperature LIMIT 1
""")
def temperature_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.best(calibration.grid_nll(embedded(spark, sf_dir), GRID, floor=0))


@query(f"""
    WITH {EMBEDDED}, c AS (SELECT CAST(unnest([1.0, 3.162277660]) AS DOUBLE) AS temperature), s AS (SELECT * FROM embedded, c),
        soft AS ({_softmax_sql("s", "temperature")})
    SELECT temperature, count(*) AS n, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = gold) AS correct, round(avg(-ln(greatest(p[gold + 1], 1e-300))), 6) AS nll,
        round(avg({BRIER}), 6) AS brier, round(avg(abs(least(len(p) - 1, greatest(0, {MEAN})) - gold)), 6) AS mae
    FROM soft GROUP BY temperature
""")
def condition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under several temperatures."""
    conditions = F.explode(F.array(F.lit(1.0), F.lit(3.162277660))).alias("temperature")
    rows = embedded(spark, sf_dir).select("*", conditions)
    return metrics.losses(rows.withColumn("p", D.softmax(F.col("z"), F.col("temperature"))), ["temperature"])


# Answers of runs

RIGHT = "coalesce(valid, false) AND coalesce(correct, false)"
ACCURACY = f"count(*) AS n, count(*) FILTER (WHERE {RIGHT}) AS correct, count(*) FILTER (WHERE coalesce(valid, false)) AS valid, round(count(*) FILTER (WHERE {RIGHT}) / count(*), 6) AS accuracy"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_acceptance")


@query(f"""
    SELECT type, source, family, {ACCURACY}, CAST(grouping_id(type, source, family) AS INTEGER) AS level
    FROM run_acceptance GROUP BY GROUPING SETS ((), (type), (source), (source, family), (type, source))
""")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_sets(answers(spark, sf_dir).select("type", "source", "family", "valid", "correct"), [[], ["type"], ["source"], ["source", "family"], ["type", "source"]]).select("type", "source", "family", "n", "correct", "valid", "accuracy", "level")


@query(f"SELECT count(*) AS families, round(avg(a), 6) AS macro_accuracy FROM (SELECT count(*) FILTER (WHERE {RIGHT}) / count(*) AS a FROM run_acceptance GROUP BY source, family)")
def family_macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_accuracy(answers(spark, sf_dir), ["source", "family"])


RELIABILITY = """
    SELECT CAST(b.bin AS INTEGER) AS bin, round(b.bin / 10, 6) AS lower, round((b.bin + 1) / 10, 6) AS upper, count(c) AS n, round(avg(c), 6) AS mean_confidence, round(avg(CASE WHEN c IS NOT NULL THEN CAST(coalesce(correct, false) AS INTEGER) END), 6) AS accuracy
    FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT CAST(confidence AS DOUBLE) AS c, correct FROM run_acceptance WHERE confidence IS NOT NULL AND coalesce(valid, false)) r ON least(9, floor(r.c * 10)) = b.bin
    GROUP BY b.bin
"""


@query(RELIABILITY)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(answers(spark, sf_dir).where(metrics.flag("valid")), "confidence", "correct")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 4) AS ece FROM ({RELIABILITY})")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(metrics.reliability(answers(spark, sf_dir).where(metrics.flag("valid")), "confidence", "correct"))


LATENCY = "count(wall_ms) AS n, round(quantile_cont(wall_ms, 0.5), 6) AS p50, round(quantile_cont(wall_ms, 0.95), 6) AS p95, round(avg(wall_ms), 6) AS mean, min(wall_ms) AS shortest, max(wall_ms) AS longest"


def _distribution(rows: DataFrame, by: str) -> DataFrame:
    shares = metrics.exact_percentiles(rows, [by], "wall_ms", [0.5, 0.95])
    wide = shares.groupBy(by).agg(F.max("n").alias("n"), *(F.round(F.max(F.when(F.col("share") == s, F.col("percentile"))), 6).alias(name) for s, name in ((0.5, "p50"), (0.95, "p95"))))
    most = rows.groupBy(F.col(by).alias("k")).agg(F.round(F.avg("wall_ms"), 6).alias("mean"), F.min("wall_ms").alias("shortest"), F.max("wall_ms").alias("longest"))
    return wide.join(most, F.col(by).eqNullSafe(F.col("k"))).drop("k")


@query(f"SELECT engine, {LATENCY} FROM run_acceptance GROUP BY engine HAVING count(wall_ms) > 0")
def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(answers(spark, sf_dir).select("engine", "wall_ms"), "engine")


@query(f"SELECT input_tokens <= 512 AS short, {LATENCY} FROM run_acceptance WHERE input_tokens IS NOT NULL AND wall_ms IS NOT NULL GROUP BY short")
def latency_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).where("input_tokens IS NOT NULL AND wall_ms IS NOT NULL").select((F.col("input_tokens") <= 512).alias("short"), "wall_ms")
    return _distribution(rows, "short")


@query("""
    SELECT source, count(*) AS n, count(*) FILTER (WHERE reverse.same_label) AS same, count(*) FILTER (WHERE reverse.correct) AS reversed_correct,
        count(*) FILTER (WHERE reverse.valid) AS reversed_valid, round(count(*) FILTER (WHERE reverse.same_label) / count(*), 6) AS consistency
    FROM run_acceptance WHERE reverse IS NOT NULL GROUP BY source
""")
def choice_order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.order_audit(answers(spark, sf_dir).select("source", "reverse"), ["source"])


GATES = ("counts", "overall", "every_type", "manual", "manual_every_type", "order_kept", "all_valid", "fast_enough", "on_target", "calls_counted")


@query(f"""
    WITH r AS (SELECT *, {RIGHT} AS ok FROM run_acceptance WHERE row_id = run_no AND source IS DISTINCT FROM 'warmup'),
        k AS (SELECT count(*) = 3 AND max(n) = min(n) AS counts, min(a) >= 0.85 AS every_type FROM (SELECT count(*) AS n, count(*) FILTER (WHERE ok) / count(*) AS a FROM r GROUP BY type)),
        m AS (SELECT count(*) = 3 AND min(a) >= 0.85 AS manual_every_type FROM (SELECT count(*) FILTER (WHERE ok) / count(*) AS a FROM r WHERE source = 'manual_desk' GROUP BY type)),
        t AS (SELECT count(*) FILTER (WHERE ok) / count(*) >= 0.9 AS overall, count(*) FILTER (WHERE ok AND source = 'manual_desk') / count(*) FILTER (WHERE source = 'manual_desk') >= 0.9 AS manual,
            count(*) FILTER (WHERE reverse.same_label) / count(reverse) >= 0.9 AS order_kept, bool_and(coalesce(valid, false) AND (reverse IS NULL OR coalesce(reverse.valid, false))) AS all_valid,
            quantile_cont(wall_ms, 0.95) FILTER (WHERE input_tokens <= 512) <= 500 AS fast_enough, bool_and(coalesce(engine = 'native_q4', false)) AS on_target FROM r),
        c AS (SELECT (SELECT count(*) + count(reverse) FROM r) + count(*) FILTER (WHERE source = 'warmup') = count(*) + count(reverse) FILTER (WHERE source IS DISTINCT FROM 'warmup') AS calls_counted FROM run_acceptance WHERE row_id = run_no)
    SELECT {", ".join(GATES)}, {" AND ".join(GATES)} AS passed FROM k, m, t, c
""")
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten criteria of an acceptance run, at the reference's bars, and whether all hold."""
    every = answers(spark, sf_dir).where("row_id = run_no")
    warm = F.col("source").eqNullSafe("warmup")
    rows = every.where(~warm).withColumn("ok", metrics.flag("valid") & metrics.flag("correct"))
    manual = F.col("source").eqNullSafe("manual_desk")
    share = lambda c: F.try_divide(F.count_if(c), F.count("*"))
    per = rows.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("right"), share(F.col("ok")).alias("a"), F.count_if(manual).alias("mn"), F.count_if(manual & F.col("ok")).alias("mr"), F.count("reverse").alias("turned"),
        F.count_if("reverse.same_label").alias("same"), F.bool_and(metrics.flag("valid") & (F.col("reverse").isNull() | F.coalesce("reverse.valid", F.lit(False)))).alias("valid"), F.bool_and(F.coalesce(F.col("engine") == "native_q4", F.lit(False))).alias("target"),
    )
    manual_share = F.when(F.col("mn") > 0, F.col("mr") / F.col("mn"))
    summed = per.agg(
        ((F.count("*") == 3) & (F.max("n") == F.min("n"))).alias("counts"), (F.sum("right") / F.sum("n") >= 0.9).alias("overall"), (F.min("a") >= 0.85).alias("every_type"), (F.try_divide(F.sum("mr"), F.sum("mn")) >= 0.9).alias("manual"),
        ((F.count(manual_share) == 3) & (F.min(manual_share) >= 0.85)).alias("manual_every_type"), (F.try_divide(F.sum("same"), F.sum("turned")) >= 0.9).alias("order_kept"), F.bool_and("valid").alias("all_valid"), F.bool_and("target").alias("on_target"),
        (F.sum("n") + F.sum("turned")).alias("measured"),
    )
    fast = metrics.exact_percentiles(rows.where("input_tokens <= 512").select(F.lit(1).alias("one"), "wall_ms"), ["one"], "wall_ms", [0.95]).select((F.col("percentile") <= 500).alias("fast_enough"))
    calls = every.agg(F.count_if(warm).alias("warm"), (F.count("*") + F.count_if(F.col("reverse").isNotNull() & ~warm)).alias("all"))
    whole = summed.join(F.broadcast(fast)).join(F.broadcast(calls)).withColumn("calls_counted", F.col("measured") + F.col("warm") == F.col("all"))  # one row each
    return whole.select(*GATES, functools.reduce(lambda x, y: x & y, map(F.col, GATES)).alias("passed"))


@query("""
    SELECT engine, count(*) FILTER (WHERE source IS DISTINCT FROM 'warmup') AS answers, count(*) FILTER (WHERE reverse IS NOT NULL AND source IS DISTINCT FROM 'warmup') AS turned,
        count(*) FILTER (WHERE source = 'warmup') AS warm_up, count(*) + count(*) FILTER (WHERE reverse IS NOT NULL AND source IS DISTINCT FROM 'warmup') AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens
    FROM run_acceptance WHERE row_id = run_no GROUP BY engine
""")
def decode_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the answers took: one each, one more for a reversed choice, and those of the warm-up; runs count once."""
    warm = F.col("source").eqNullSafe("warmup")
    turned = F.count_if(F.col("reverse").isNotNull() & ~warm)
    return answers(spark, sf_dir).where("row_id = run_no").groupBy("engine").agg(F.count_if(~warm).alias("answers"), turned.alias("turned"), F.count_if(warm).alias("warm_up"), (F.count("*") + turned).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"))


@query("""
    WITH c AS (SELECT run_no, count(*) AS n, min(received_at) AS a, max(received_at) AS b FROM run_acceptance GROUP BY run_no)
    SELECT CAST(n AS BIGINT) AS deliveries, count(*) AS runs, count(*) FILTER (WHERE b - a > INTERVAL 7 DAY) AS far_apart FROM c GROUP BY n
""")
def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = answers(spark, sf_dir).groupBy("run_no").agg(F.count("*").alias("deliveries"), F.min("received_at").alias("a"), F.max("received_at").alias("b"))
    return per.groupBy("deliveries").agg(F.count("*").alias("runs"), F.count_if(F.expr("b - a > INTERVAL 7 DAY")).alias("far_apart"))


@query("""
    SELECT id, last.row_id AS row_id, last.engine AS engine, last.correct AS correct
    FROM (SELECT id, arg_max(struct_pack(row_id := row_id, engine := engine, correct := correct), struct_pack(s := started_at, r := row_id)) AS last FROM run_acceptance WHERE started_at IS NOT NULL GROUP BY id)
""")
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(answers(spark, sf_dir).where("started_at IS NOT NULL"), ["id"], ["started_at", "row_id"], ["row_id", "engine", "correct"])


@query("""
    WITH f AS (SELECT id, min(row_id) FILTER (WHERE NOT coalesce(correct, false)) AS bad FROM run_acceptance GROUP BY id)
    SELECT r.id, count(*) FILTER (WHERE bad IS NULL OR row_id < bad) AS run FROM run_acceptance r JOIN f ON r.id IS NOT DISTINCT FROM f.id GROUP BY r.id
""")
def leading_correct_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.leading_run(answers(spark, sf_dir).select("id", "row_id", "correct"), ["id"], "row_id", F.col("correct"))


@query(f"SELECT strftime(started_at, '%Y-%m-%d') AS day, engine, {ACCURACY}, CAST(grouping_id(day, engine) AS INTEGER) AS level FROM run_acceptance GROUP BY ROLLUP (day, engine)")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select(F.date_format("started_at", "yyyy-MM-dd").alias("day"), "engine", "valid", "correct")
    return metrics.accuracy_sets(rows, [[], ["day"], ["day", "engine"]]).select("day", "engine", "n", "correct", "valid", "accuracy", "level")


@query("""
    WITH c AS (SELECT engine, epoch_us(started_at) AS s, epoch_us(started_at) + CAST(ceil(wall_ms * 1000) AS BIGINT) AS e FROM run_acceptance WHERE row_id = run_no AND wall_ms > 0 AND started_at IS NOT NULL),
        h AS (SELECT engine, hour, greatest(s, hour * 3600000000) AS s, least(e, (hour + 1) * 3600000000) AS e FROM (SELECT *, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS hour FROM c)),
        m AS (SELECT engine, hour, s AS t, 1 AS d FROM h UNION ALL SELECT engine, hour, e, -1 FROM h),
        r AS (SELECT engine, hour, sum(d) OVER (PARTITION BY engine, hour ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM m)
    SELECT engine, hour, CAST(max(running) AS BIGINT) AS most FROM r GROUP BY engine, hour
""")
def busiest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of an engine were under way at once, at most, in each hour; calls that touch don't overlap."""
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    calls = answers(spark, sf_dir).where("row_id = run_no AND wall_ms > 0 AND started_at IS NOT NULL").select("engine", start.alias("start"), (start + F.ceil(F.col("wall_ms") * 1000)).alias("end"))
    return A.most_at_once(calls, "engine", 3_600_000_000).select("engine", F.col("cell").alias("hour"), "most")


@query("SELECT run_key, count(*) AS records, count(result) AS answers, CAST(coalesce(sum(result.input_tokens), 0) AS BIGINT) AS input_tokens, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM raw GROUP BY run_key")
def usage_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw").groupBy("run_key").agg(F.count("*").alias("records"), F.count("result").alias("answers"), F.coalesce(F.sum("result.input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


# Labelled cases


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_ja")


KINDS = "k AS (SELECT *, lower(trim(type)) AS kind FROM eval_ja)"
OPTIONS = f"""
    {KINDS}, pairs AS (
        SELECT id, kind, key, json_extract_string(criteria, '$."' || key || '"') AS description, row_number() OVER (PARTITION BY id ORDER BY key) - 1 AS ord
        FROM (SELECT id, kind, criteria, unnest(json_keys(criteria)) AS key FROM k WHERE kind = 'choice' AND criteria IS NOT NULL)
        UNION ALL
        SELECT id, kind, key, coalesce(json_extract_string(criteria, '$.' || key), key), ord FROM k, (VALUES ('false', 0), ('true', 1)) o(key, ord) WHERE kind = 'noul' AND (criteria IS NULL OR list_sort(json_keys(criteria)) = ['false', 'true'])
        UNION ALL
        SELECT id, kind, CAST(i AS VARCHAR), json_extract_string(criteria, '$[' || i || ']'), i FROM (SELECT id, kind, criteria, unnest(range(CAST(json_array_length(criteria) AS BIGINT))) AS i FROM k WHERE kind = 'score' AND criteria IS NOT NULL)
    )"""


@query(f"WITH {OPTIONS} SELECT id, kind, CAST(ord AS INTEGER) AS ord, key, description FROM pairs")
def candidate_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return option_rows(cases(spark, sf_dir))


@query(f"""
    WITH {OPTIONS}, n AS (SELECT id, kind, count(*) AS n FROM pairs GROUP BY id, kind)
    SELECT id, kind, array_to_string(CASE WHEN kind = 'score' AND n <= 10 THEN list_transform(range(n), lambda i: CAST(i AS VARCHAR)) ELSE list_transform(range(n), lambda i: chr(CAST(65 + i AS INTEGER))) END, '') AS symbols FROM n
""")
def candidate_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_options(cases(spark, sf_dir)).where(F.size("options") > 0)
    return rows.select("id", "kind", F.array_join(D.symbols(F.col("kind"), F.size("options")), "").alias("symbols"))


@query(f"""
    WITH {OPTIONS}, o AS (SELECT id, list(key) AS keys FROM pairs GROUP BY id), e AS (
        SELECT CASE WHEN trim(coalesce(k.id, '')) = '' THEN 'no id' WHEN NOT coalesce(kind IN ('choice', 'noul', 'score'), false) THEN 'unknown type' WHEN trim(coalesce(state, '')) = '' THEN 'no state'
            WHEN trim(coalesce(instructions, '')) = '' THEN 'no instructions' WHEN o.keys IS NULL THEN 'criteria unreadable' WHEN len(o.keys) < 2 THEN 'too few candidates' WHEN len(o.keys) > 26 THEN 'too many candidates'
            WHEN trim(coalesce(label, '')) = '' THEN 'no label' WHEN NOT list_contains(o.keys, trim(label)) THEN 'label is no candidate' END AS error, split
        FROM k LEFT JOIN o ON o.id = k.id)
    SELECT split, error, count(*) AS n FROM e GROUP BY split, error
""")
def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_error(cases(spark, sf_dir)).groupBy("split", "error").agg(F.count("*").alias("n"))


STRICT = "CASE WHEN trim(state) = '' THEN 'blank' WHEN NOT json_valid(state) THEN 'not valid JSON' WHEN json_type(state) <> 'OBJECT' THEN 'not an object' ELSE 'object' END"


@query(f"SELECT {STRICT} AS form, count(*) AS n FROM eval_ja WHERE state IS NOT NULL GROUP BY form")
def strict_json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict reader makes of states: objects are read, anything else is rejected with a reason."""
    states = cases(spark, sf_dir).where("state IS NOT NULL").select("state")
    read = checked(states, [], [], "state").withColumn("form", F.when(F.col("error").isNull() | (F.col("error") == "unknown field"), "object").otherwise(F.col("error")))
    blank = states.where(F.trim("state") == "").select(F.lit("blank").alias("form"))
    return read.select("form").unionByName(blank).groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT split, source, lower(trim(type)) AS kind, count(*) AS n, count(label) AS labelled, count(DISTINCT case_group) AS groups FROM eval_ja GROUP BY split, source, kind")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("split", "source", kind_of(F.col("type")).alias("kind")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_distinct("case_group").alias("groups"))


@query("SELECT case_group, count(*) AS rows, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM eval_ja WHERE case_group IS NOT NULL GROUP BY case_group HAVING count(DISTINCT split) > 1")
def split_leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.crossing(cases(spark, sf_dir), "case_group")


SIGNED = """signed AS (SELECT split, id, sha256(concat_ws(chr(31), coalesce('=' || lower(trim(type)), '!'), coalesce('=' || trim(regexp_replace(state, '[ \\t\\r\\n]+', ' ', 'g')), '!'),
    coalesce('=' || trim(regexp_replace(instructions, '[ \\t\\r\\n]+', ' ', 'g')), '!'), coalesce('=' || criteria, '!'))) AS signature FROM eval_ja)"""


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = kind_of(F.col("type")), audits.collapsed(F.col("state")), audits.collapsed(F.col("instructions")), F.col("criteria")
    return cases(spark, sf_dir).select("split", "id", audits.signature(*fields).alias("signature"))


@query(f"WITH {SIGNED} SELECT signature, count(*) AS rows, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM signed GROUP BY signature HAVING count(DISTINCT split) > 1")
def split_leakage_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.crossing(signed(spark, sf_dir), "signature")


@query(f"WITH {SIGNED} SELECT signature, count(*) AS n FROM signed GROUP BY signature HAVING count(*) > 1")
def repeated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.repeated(signed(spark, sf_dir), ["signature"])


@query("""
    SELECT e.id, array_to_string(list_filter([CASE WHEN e.instructions IN (SELECT instructions FROM warmup_case) THEN 'instructions' END, CASE WHEN e.criteria IN (SELECT criteria FROM warmup_case) THEN 'criteria' END], lambda x: x IS NOT NULL), ',') AS shared
    FROM eval_ja e WHERE e.instructions IN (SELECT instructions FROM warmup_case) OR e.criteria IN (SELECT criteria FROM warmup_case)
""")
def protected_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that share instructions or criteria with a warm-up case."""
    return audits.protected_overlap(cases(spark, sf_dir).select("id", "instructions", "criteria"), table(spark, sf_dir, "warmup_case"), ["instructions", "criteria"]).select("id", F.array_join("shared", ",").alias("shared"))


@query("""
    WITH m AS (SELECT id, regexp_replace(state, '[0-9０-９]+', 'N', 'g') AS t FROM eval_ja), w AS (SELECT id, regexp_replace(state, '[0-9０-９]+', 'N', 'g') AS t FROM warmup_case),
        a AS (SELECT DISTINCT id, substr(t, CAST(i AS INTEGER), 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM m WHERE length(t) >= 3)),
        b AS (SELECT DISTINCT id, substr(t, CAST(i AS INTEGER), 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM w WHERE length(t) >= 3)),
        na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
        s AS (SELECT a.id AS x, b.id AS y, count(*) AS s FROM a JOIN b USING (g) GROUP BY 1, 2),
        j AS (SELECT x, y, s / (na.n + nb.n - s) AS l FROM s JOIN na ON na.id = x JOIN nb ON nb.id = y)
    SELECT x AS id, arg_max(y, l) AS warm_id, round(max(l), 6) AS likeness FROM (SELECT x, y, l FROM j ORDER BY x, l DESC, y) GROUP BY x
""")
def nearest_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case the warm-up case whose state shares most trigrams."""
    return audits.nearest_protected(cases(spark, sf_dir), "id", "state", table(spark, sf_dir, "warmup_case").withColumnRenamed("id", "warm_id"), "warm_id", "state")


@query("""
    WITH s AS (SELECT lower(trim(type)) AS kind, id, length(state) AS s FROM eval_ja WHERE state IS NOT NULL)
    SELECT kind, (SELECT id FROM s x WHERE x.kind = s.kind ORDER BY x.s, x.id LIMIT 1) AS shortest, min(s) AS least, (SELECT id FROM s x WHERE x.kind = s.kind ORDER BY x.s DESC, x.id LIMIT 1) AS longest, max(s) AS most FROM s GROUP BY kind
""")
def extremes_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extremes(cases(spark, sf_dir).withColumn("kind", kind_of(F.col("type"))), "kind", F.length("state").cast("long"), "id")


@query("SELECT kind, id, CAST(place AS INTEGER) AS place FROM (SELECT lower(trim(type)) AS kind, id, row_number() OVER (PARTITION BY lower(trim(type)) ORDER BY md5(id || ':20260713'), id) AS place FROM eval_ja) WHERE place <= 12")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sampled(cases(spark, sf_dir).withColumn("kind", kind_of(F.col("type"))), "id", ["kind"], 12, "20260713").select("kind", "id", "place")


ROBIN = f"WITH {OPTIONS}, n AS (SELECT id, kind, count(*) AS candidates FROM pairs GROUP BY id, kind), r AS (SELECT split, kind, CAST(candidates AS INTEGER) AS candidates, id, (row_number() OVER (PARTITION BY split, kind, candidates ORDER BY id) - 1) % candidates AS position FROM n JOIN eval_ja USING (id))"


def _robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_options(cases(spark, sf_dir)).where(F.size("options") > 0).select("split", "kind", F.size("options").alias("candidates"), "id")
    return A.round_robin(rows, ["split", "kind"], "id", "candidates")


@query(f"{ROBIN} SELECT split, kind, candidates, id, CAST(position AS INTEGER) AS position FROM r")
def round_robin_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robin(spark, sf_dir).select("split", "kind", "candidates", "id", "position")


@query(f"""
    {ROBIN}, c AS (SELECT split, kind, candidates, position, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT DISTINCT split, kind, candidates FROM c),
        f AS (SELECT s.*, coalesce(c.n, 0) AS n FROM (SELECT *, unnest(range(candidates)) AS position FROM s) s LEFT JOIN c ON c.split = s.split AND c.kind = s.kind AND c.candidates = s.candidates AND c.position = s.position)
    SELECT split, kind, candidates, max(n) AS largest, min(n) AS smallest FROM f GROUP BY split, kind, candidates
""")
def position_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.balance(_robin(spark, sf_dir), ["split", "kind"], "position", "candidates")


@query(f"""
    WITH {OPTIONS}, o AS (SELECT id, kind, list(key ORDER BY ord) AS keys FROM pairs GROUP BY id, kind)
    SELECT id, kind, array_to_string(keys, ',') AS keys FROM o UNION ALL SELECT id || '_reverse', kind, array_to_string(list_reverse(keys), ',') FROM o WHERE kind = 'choice'
""")
def augmented_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_options(cases(spark, sf_dir)).where(F.size("options") > 0).select("id", "kind", F.col("options.key").alias("keys"))
    return A.with_reversed(rows, "id", "keys", F.col("kind") == "choice").withColumn("keys", F.array_join("keys", ","))


@query(f"WITH {KINDS} SELECT k.id, h.item_id FROM k JOIN heldout_item h ON h.instructions = k.instructions AND lower(trim(h.type)) = k.kind WHERE k.split = 'train'")
def training_shares_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training cases whose question and type are those of a protected item."""
    items = table(spark, sf_dir, "heldout_item").select("item_id", F.col("instructions").alias("asked"), kind_of(F.col("type")).alias("item_kind"))
    train = cases(spark, sf_dir).where("split = 'train'").withColumn("kind", kind_of(F.col("type")))
    return train.join(items, (F.col("instructions") == F.col("asked")) & (F.col("kind") == F.col("item_kind"))).select("id", "item_id")


@query(f"""
    WITH {OPTIONS}, n AS (SELECT id, kind, count(*) AS n, list(coalesce(description, key) ORDER BY ord) AS d FROM pairs GROUP BY id, kind),
        s AS (SELECT id, d, CASE WHEN kind = 'score' AND n <= 10 THEN list_transform(range(n), lambda i: CAST(i AS VARCHAR)) ELSE list_transform(range(n), lambda i: chr(CAST(65 + i AS INTEGER))) END AS symbols FROM n)
    SELECT e.id, md5(concat_ws(chr(10), '[state]', e.state, '[question]', e.instructions, '[options]', array_to_string(list_transform(list_zip(symbols, d), lambda x: x[1] || ') ' || x[2]), chr(10)))) AS prompt
    FROM s JOIN eval_ja e USING (id)
""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the prompts of all cases with options; the label plays no part in them."""
    rows = with_options(cases(spark, sf_dir).drop("label")).where(F.size("options") > 0)
    text = ANS.prompt(F.col("state"), F.col("instructions"), F.col("options"), D.symbols(F.col("kind"), F.size("options")))
    return rows.select("id", F.md5(text).alias("prompt"))


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(f[1:10], lambda x: exp(x - list_max(f)))) / list_sum(list_transform(f, lambda x: exp(x - list_max(f)))), 6) AS mass FROM v
""")
def candidate_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the probability of all components the first ten have."""
    full = D.doubles(F.col("embedding"))
    mass = ANS.candidate_mass(ANS.gathered(full, F.sequence(F.lit(0), F.lit(9))), full)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(mass, 6).alias("mass"))


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
        h AS (SELECT vec_id, f[1:4] AS z, list_transform(f[5:8], lambda x: x / greatest(sqrt(list_sum(list_transform(f[5:8], lambda y: y * y)) / 4), 1e-6)) AS h FROM v)
    SELECT vec_id, round(z[1] + 0.5 * h[1] + 0.1, 6) AS a, round(z[2] + 0.5 * h[2] - 0.1, 6) AS b, round(z[3] + h[1] - h[4], 6) AS c FROM h
""")
def residual_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three base logits, corrected by a fixed head over four features."""
    f = F.col("f")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", D.doubles(F.col("embedding")).alias("f"))
    weights = F.array(*(F.array(*map(F.lit, w)) for w in ([0.5, 0.0, 0.0, 0.0], [0.0, 0.5, 0.0, 0.0], [1.0, 0.0, 0.0, -1.0])))
    logits = ANS.residual_logits(F.slice(f, 1, 3), F.slice(f, 5, 4), weights, F.array(F.lit(0.1), F.lit(-0.1), F.lit(0.0)))
    return rows.select("vec_id", logits.alias("z")).select("vec_id", *(F.round(F.col("z")[i], 6).alias(n) for i, n in enumerate("abc")))


@query("""
    WITH a AS (SELECT result AS r, list_filter(map_values(result.probabilities), lambda x: x IS NOT NULL) AS v FROM raw WHERE result IS NOT NULL AND result.candidate_keys IS NOT NULL),
        e AS (SELECT unnest(list_filter([
            CASE WHEN r.label IS NULL THEN 'no label' END, CASE WHEN NOT list_contains(r.candidate_keys, r.label) THEN 'label is no candidate' END,
            CASE WHEN r.probabilities IS NULL OR cardinality(r.probabilities) = 0 THEN 'no probabilities' END,
            CASE WHEN cardinality(r.probabilities) <> len(r.candidate_keys) OR len(list_filter(r.candidate_keys, lambda k: NOT list_contains(map_keys(r.probabilities), k))) > 0 THEN 'other keys' END,
            CASE WHEN len(v) < cardinality(r.probabilities) THEN 'probability missing' END, CASE WHEN len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 THEN 'probability out of range' END,
            CASE WHEN len(v) > 0 AND abs(list_sum(v) - 1) > 1e-5 THEN 'sum is not one' END, CASE WHEN r.probabilities[r.label] < list_max(v) - 1e-7 THEN 'label is not the likeliest' END,
            CASE WHEN r.candidate_logits IS NULL OR len(r.candidate_logits) <> len(r.candidate_keys) THEN 'logits missing' END,
            CASE WHEN len(list_filter(r.candidate_logits, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'logit not finite' END,
            CASE WHEN r.confidence IS NULL OR r.confidence < 0 OR r.confidence > 1 THEN 'confidence out of range' END, CASE WHEN r.input_tokens IS NULL OR r.input_tokens <= 0 THEN 'no tokens' END,
            CASE WHEN r.latency_ms IS NULL OR r.latency_ms < 0 THEN 'no latency' END], lambda x: x IS NOT NULL)) AS error FROM a)
    SELECT error, count(*) AS n FROM e GROUP BY error
""")
def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recorded answers break each rule of an answer."""
    r = F.col("result")
    rows = table(spark, sf_dir, "raw").where("result IS NOT NULL AND result.candidate_keys IS NOT NULL").select("result")
    errors = ANS.answer_errors(r["label"], r["candidate_keys"], r["probabilities"], r["candidate_logits"], r["confidence"], r["input_tokens"], r["latency_ms"])
    return rows.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT label, CAST(sum(l) AS BIGINT) AS \"left\", CAST(sum(r) AS BIGINT) AS \"right\" FROM (SELECT label, CASE WHEN split = 'dev' THEN 1 ELSE 0 END AS l, CASE WHEN split = 'calibration' THEN 1 ELSE 0 END AS r FROM eval_ja WHERE split IN ('dev', 'calibration')) GROUP BY label HAVING sum(l) <> sum(r)")
def label_count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the dev and the calibration split don't have equally often."""
    rows = cases(spark, sf_dir)
    return ANS.count_differences(rows.where("split = 'dev'"), rows.where("split = 'calibration'"), ["label"])


@query("""
    WITH m AS (SELECT engine, quantile_cont(wall_ms, 0.5) AS p50 FROM run_acceptance WHERE wall_ms > 0 GROUP BY engine)
    SELECT a.engine, b.engine AS base, round(a.p50 / b.p50, 6) AS ratio FROM m a, m b WHERE b.engine = 'native_q4'
""")
def latency_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median times of each engine against one of them."""
    medians = metrics.exact_percentiles(answers(spark, sf_dir).where("wall_ms > 0"), ["engine"], "wall_ms", [0.5])
    base = F.max(F.when(F.col("engine") == "native_q4", F.col("percentile"))).over(Window.partitionBy(F.lit(0)))  # one row for each engine
    return medians.withColumn("of", base).where("of IS NOT NULL").select("engine", F.lit("native_q4").alias("base"), F.round(F.col("percentile") / F.col("of"), 6).alias("ratio"))


@query(f"""
    WITH d AS (SELECT engine, strftime(started_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE {RIGHT}) AS correct FROM run_acceptance WHERE started_at IS NOT NULL GROUP BY engine, day)
    SELECT engine, day, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, CAST(sum(correct) OVER w AS BIGINT) AS correct_so_far, n - lag(n) OVER w AS change FROM d WINDOW w AS (PARTITION BY engine ORDER BY day)
""")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts up to each day, by engine: days are summed first, so that the windows run over few rows."""
    daily = metrics.accuracy_sets(answers(spark, sf_dir).where("started_at IS NOT NULL").select("engine", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "valid", "correct"), [["engine", "day"]])
    by = Window.partitionBy("engine").orderBy("day")
    return daily.select("engine", "day", F.sum("n").over(by).alias("n_so_far"), F.sum("correct").over(by).alias("correct_so_far"), (F.col("n") - F.lag("n").over(by)).alias("change"))


@query("SELECT CAST(date_diff('day', CAST(started_at AS DATE), CAST(received_at AS DATE)) AS INTEGER) AS days, count(*) AS n FROM run_acceptance WHERE started_at IS NOT NULL AND received_at IS NOT NULL GROUP BY days")
def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days after its start a run was received."""
    rows = answers(spark, sf_dir).where("started_at IS NOT NULL AND received_at IS NOT NULL")
    return rows.groupBy(F.datediff(F.to_date("received_at"), F.to_date("started_at")).alias("days")).agg(F.count("*").alias("n"))


# Documents


@query(f"SELECT source, count(*) AS rows, {', '.join(f'''CAST(sum(coalesce(len(regexp_extract_all(text, '{p}')), 0)) AS BIGINT) AS {n}''' for n, p in audits.SECRETS.items())} FROM documents GROUP BY source")
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.secret_counts(table(spark, sf_dir, "documents"), "text", ["source"])


@query("""
    SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE trim(text, ' \t\r\n') = '') AS blank, count(*) FILTER (WHERE n_chars <> length(text)) AS size_differs,
        count(*) FILTER (WHERE contains(text, chr(65533))) AS broken, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY source
""")
def document_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    t = F.col("text")
    blank = F.regexp_replace(t, "[ \\t\\r\\n]+", "") == ""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), count(t.isNull(), "missing"), count(blank, "blank"), count(F.col("n_chars") != F.length(t), "size_differs"), count(F.contains(t, F.lit("�")), "broken"), F.max(F.length(t)).alias("longest"))


@query("SELECT digest, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL) GROUP BY digest HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# Audit records: the adjacency table and what comes of it


def raw_nodes(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """The adjacency table of the audit records, or what of it leads to and lies below some paths."""
    return shred(table(spark, sf_dir, "raw"), "raw_id", ["question", "request", "result"], ["question.state"], only)


@query("""
    SELECT raw_id, 'question.criteria' AS child_path, CAST(i AS VARCHAR) AS child_key FROM (SELECT raw_id, unnest(question.criteria) AS x, generate_subscripts(question.criteria, 1) - 1 AS i FROM raw) WHERE x IS NOT NULL
    UNION ALL
    SELECT raw_id, 'request.messages', CAST(i AS VARCHAR) FROM (SELECT raw_id, unnest(request.messages) AS x, generate_subscripts(request.messages, 1) - 1 AS i FROM raw) WHERE x IS NOT NULL
    UNION ALL
    SELECT raw_id, 'result.probabilities', unnest(map_keys(result.probabilities)) FROM raw
    UNION ALL
    SELECT raw_id, 'question.state', ltrim(regexp_replace(substr(fullkey, 2), '\\[([0-9]+)\\]', '.\\1', 'g'), '.')
    FROM (SELECT raw_id, CASE WHEN json_valid(question.state) AND json_type(question.state) IN ('OBJECT', 'ARRAY') THEN question.state END AS s FROM raw) r, LATERAL (SELECT * FROM json_tree(r.s)) t
    WHERE s IS NOT NULL AND t.type = 'OBJECT' AND fullkey LIKE '%]'
""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["question.criteria.[]", "request.messages.[]", "result.probabilities.[]", "question.state"]
    return children(raw_nodes(spark, sf_dir, asked), "raw_id", ["question.criteria", "request.messages", "result.probabilities"], ["question.state"])


@query()
def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_nodes(spark, sf_dir)


@query()
def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(raw_nodes(spark, sf_dir), "raw_id")


@query("""
    SELECT raw_id, 'request.messages.' || i AS node, 'request.messages' AS parent, CAST(i AS INTEGER) AS ordinal, x.role AS role, x.content AS content
    FROM (SELECT raw_id, unnest(request.messages) AS x, generate_subscripts(request.messages, 1) - 1 AS i FROM raw) WHERE x IS NOT NULL
""")
def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_table(raw_nodes(spark, sf_dir, ["request.messages.[]"]), "raw_id", "request.messages.[]", {"role": "string", "content": "string"})


@query("SELECT raw_id, 'result' AS node, CAST(NULL AS VARCHAR) AS parent, 2 AS ordinal, result.type AS type, result.label AS label, result.confidence AS confidence, result.input_tokens AS input_tokens, result.latency_ms AS latency_ms FROM raw WHERE result IS NOT NULL")
def p4_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"type": "string", "label": "string", "confidence": "double", "input_tokens": "int", "latency_ms": "double"}
    return entity_table(raw_nodes(spark, sf_dir, [f"result.{c}" for c in columns]), "raw_id", "result", columns)


# Plain relational shapes


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT l_returnflag, CAST(least(4, floor(l_quantity / 11)) AS INTEGER) AS band, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, band")
def quantity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.least(F.lit(4), F.floor(F.col("l_quantity") / 11)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
    WITH e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    SELECT user_id, event_type AS first_type, event_id FROM e WHERE rn = 1
""")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    top = F.min(F.struct("ts", "event_id", "event_type"))
    return rows.groupBy("user_id").agg(top.alias("t")).select("user_id", F.col("t.event_type").alias("first_type"), F.col("t.event_id").alias("event_id"))


# Learning, scoring, exports and streams: no SQL


@query()
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads trained on half of the embeddings and chosen on a quarter: the losses of no head, biases alone and the
    residual head, with no temperature and with the one fitted to the chosen rows, on each part."""
    part = F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("dev"), F.lit("test")), (F.pmod(F.xxhash64("vec_id"), F.lit(4)) + 1).cast("int"))
    columns = ["vec_id", D.doubles(F.col("embedding")).alias("x"), F.array_repeat(F.lit(0.0), 10).alias("z"), F.col("label").alias("gold"), part.alias("part")]
    rows = stage(table(spark, sf_dir, "embeddings").select(*columns), "features")
    heads = train_heads(rows.where("part <> 'test'").withColumn("dev", F.col("part") == "dev"), 10, 64)
    none = rows.select("part", "gold", F.lit("baseline").alias("control"), "z")
    every = none
    for control, head in heads.items():
        w, bias = F.array(*(F.array(*map(F.lit, r)) for r in head.weights.tolist())), F.array(*map(F.lit, head.bias.tolist()))
        delta = F.zip_with(F.transform(w, lambda r: D.dot(r, F.col("x"))), bias, lambda a, b: a + b)
        every = every.unionByName(rows.select("part", "gold", F.lit(control).alias("control"), F.zip_with("z", delta, lambda a, b: a + b).alias("z")))
    every = stage(every, "head-logits")
    fitted = [calibration.best(calibration.grid_nll(every.where((F.col("part") == "dev") & (F.col("control") == c)), calibration.grid(301))).select(F.lit(c).alias("control"), "temperature") for c in ("baseline", *heads)]
    conditions = functools.reduce(DataFrame.unionByName, fitted).withColumn("fitted", F.lit(True))
    conditions = conditions.unionByName(conditions.select("control", F.lit(1.0).alias("temperature"), F.lit(False).alias("fitted")))
    scored = every.join(F.broadcast(conditions), "control")  # six rows
    return metrics.losses(scored.withColumn("p", D.softmax(F.col("z"), F.col("temperature"))), ["part", "control", "fitted"])


@query()
def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases scored by a batch scorer, then decided."""
    rows = with_options(cases(spark, sf_dir)).select("id", F.concat_ws("\n", "state", "instructions").alias("prompt"), F.col("options.description").alias("shown"), F.col("options.key").alias("keys"))
    scored = with_logits(rows, HashScorer(), "prompt", "shown").join(rows.select("id", "keys"), "id")
    p = D.softmax(F.col("logits"))
    return scored.select("id", D.at(F.col("keys"), D.argmax(F.col("logits"))).alias("label"), F.round(D.confidence(p), 6).alias("confidence"))


@query()
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of an export come back otherwise, by where; no row means none."""
    columns = ["id", "type", "source", "family", "state", "instructions", "criteria", "label"]
    folder = f"{shared_dir(spark)}/export-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    exports.export(cases(spark, sf_dir), folder, columns)
    return exports.round_trip_differences(cases(spark, sf_dir), folder, columns).groupBy("only_in").agg(F.count("*").alias("n"))


@query(f"SELECT strftime(started_at, '%Y-%m-%d') AS day, engine, count(*) AS n, count(*) FILTER (WHERE {RIGHT}) AS correct FROM run_acceptance WHERE started_at IS NOT NULL GROUP BY day, engine")
def stream_daily_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the delivered files, drained."""
    return progress.drained(progress.daily_progress(progress.answer_stream(spark, f"{sf_dir}/run_acceptance.parquet")), ["day", "engine"])

