"""More registered queries: contracts, canonical inputs, pairs of records, intervals, and what else the core offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C
from .catalogue import query
from .functions import decision as D
from .functions.canonical import input_signature
from .operators import answers as ANS
from .operators import arranging as A
from .operators import audits, contracts
from .operators.candidates import kind_of
from .plans.staging import own_path, table
from .sources import exports
from .streaming import progress


def _names(rules: dict[str, str]) -> str:
    """SQL: names of the rules that are broken or can't be judged."""
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL)"


REQUEST = {
    "no id": "r.id IS NULL", "no messages": "len(r.messages) < 1", "unknown role": "len(list_filter(r.messages, lambda m: NOT coalesce(m.role IN ('system', 'user', 'assistant'), false))) > 0",
    "no content": "len(list_filter(r.messages, lambda m: coalesce(trim(m.content) = '', true))) > 0", "number of candidates": "len(r.candidates) NOT BETWEEN 2 AND 26",
    "blank candidate": "len(list_filter(r.candidates, lambda c: coalesce(trim(c) = '', true))) > 0", "repeated candidate": "len(list_distinct(r.candidates)) + CAST(len(list_filter(r.candidates, lambda c: c IS NULL)) > 0 AS INTEGER) < len(r.candidates)",
    "token limit": "r.max_input_tokens NOT BETWEEN 1 AND 32768",
}


@query(f"SELECT error, count(*) AS n FROM (SELECT unnest({_names(REQUEST)}) AS error FROM (SELECT request AS r FROM raw WHERE request IS NOT NULL)) GROUP BY error")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests break each rule of a request."""
    rows = table(spark, sf_dir, "raw").where("request IS NOT NULL")
    return rows.select(F.explode(contracts.request_errors(F.col("request"))).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


FEATURES = {
    "number of features": "len(x) <> 64", "feature not finite": "len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0", "number of candidates": "len(z) NOT BETWEEN 2 AND 26",
    "logit not finite": "len(list_filter(z, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0", "gold out of range": "gold NOT BETWEEN 0 AND len(z) - 1",
}


@query(f"SELECT len(e) AS broken, count(*) AS n FROM (SELECT {_names(FEATURES)} AS e FROM (SELECT embedding AS x, list_transform(embedding, lambda v: CAST(v AS DOUBLE))[1:(5 + vec_id % 6)] AS z, label AS gold FROM embeddings)) GROUP BY broken")
def feature_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to train on by how many rules they break; their candidates are five to ten, so that some labels are out of range."""
    z = F.slice(D.doubles(F.col("embedding")), F.lit(1), (F.col("vec_id") % 6 + 5).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(D.doubles(F.col("embedding")).alias("x"), z.alias("z"), F.col("label").alias("gold"))
    errors = contracts.feature_errors(F.col("x"), F.col("z"), F.col("gold"), 64, 26)
    return rows.select(F.size(errors).cast("long").alias("broken")).groupBy("broken").agg(F.count("*").alias("n"))


@query(f"""
    WITH a AS (SELECT raw_id, lower(trim(result.type)) AS kind, result.candidate_keys AS keys, result AS r, list_transform(result.candidate_keys, lambda k: result.probabilities[k]) AS p FROM raw WHERE result IS NOT NULL),
        w AS (SELECT *, {C.ENTROPY} AS h FROM a WHERE len(keys) > 0 AND r.probabilities IS NOT NULL AND len(list_filter(p, lambda x: x IS NULL)) = 0)
    SELECT raw_id, kind, keys[list_position(p, list_max(p))] AS label, coalesce(r.probabilities[r.label] = list_max(p), false) AS label_holds,
        round(CASE WHEN kind = 'score' THEN greatest(0, least(len(p) - 1, {C.MEAN})) WHEN kind = 'noul' THEN r.probabilities['true'] END, 6) AS value,
        coalesce(abs(r.confidence - CASE WHEN len(p) > 1 THEN greatest(0, least(1, 1 + coalesce(h, 0) / ln(len(p)))) END) <= 1e-5, false) AS confidence_holds
    FROM w
""")
def rederived_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers derived again from their probabilities, and whether the recorded label and confidence hold."""
    r = F.col("result")
    rows = table(spark, sf_dir, "raw").where("result IS NOT NULL").select("raw_id", "result", kind_of(r["type"]).alias("kind"))
    own = rows.withColumn("d", contracts.rederived(F.col("kind"), r["candidate_keys"], r["probabilities"])).where("d IS NOT NULL")
    label = F.coalesce(F.try_element_at(r["probabilities"], r["label"]) == F.col("d.top"), F.lit(False))
    confidence = F.coalesce(F.abs(r["confidence"] - F.col("d.confidence")) <= 1e-5, F.lit(False))
    return own.select("raw_id", "kind", "d.label", label.alias("label_holds"), F.round("d.value", 6).alias("value"), confidence.alias("confidence_holds"))


@query("""
    WITH g AS (SELECT run_key, actual AS t, [expected_label, 'true', 'false', '0', '1', '2'] AS keys FROM raw WHERE actual IS NOT NULL)
    SELECT run_key, count(*) AS n, count(*) FILTER (WHERE list_contains(keys, trim(t)) OR (json_valid(t) AND list_contains(keys, json_extract_string(t, '$.label')))) AS named FROM g GROUP BY run_key
""")
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recorded texts of a run name a candidate, plainly or as JSON."""
    rows = table(spark, sf_dir, "raw").where("actual IS NOT NULL").select("run_key", "actual", "expected_label")
    keys = F.array_compact(F.array("expected_label", *map(F.lit, ("true", "false", "0", "1", "2"))))
    return rows.groupBy("run_key").agg(F.count("*").alias("n"), F.count(contracts.parsed_label(F.col("actual"), keys)).alias("named"))


@query("""
    WITH c AS (SELECT split, unnest([{'field': 'case_group', 'value': case_group}, {'field': 'family', 'value': family}]) AS t FROM eval_ja),
        x AS (SELECT t.field AS field, t.value AS value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM c WHERE t.value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1)
    SELECT policy, field, value, splits FROM x, (VALUES ('group', 'case_group'), ('family', 'family'), ('both', 'case_group'), ('both', 'family')) p(policy, f) WHERE f = field
""")
def split_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What crosses the splits under each policy of keeping groups or families apart."""
    rows = C.cases(spark, sf_dir).select("split", "case_group", "family")
    parts = [contracts.crossing_fields(rows, ["case_group", "family"], p).withColumn("policy", F.lit(p)) for p in ("none", "group", "family", "both")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("policy", "field", "value", "splits")


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cases(spark, sf_dir).select("id", "split", input_signature(F.col("type"), F.col("state"), F.col("instructions"), F.col("criteria")).alias("signature"))


@query()
def canonical_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical inputs that stand in several splits; NFKC has no SQL form."""
    return audits.crossing(_canonical(spark, sf_dir), "signature")


@query()
def canonical_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical inputs that stand more than once."""
    return audits.repeated(_canonical(spark, sf_dir), ["signature"])


@query(f"WITH {C.SIGNED} SELECT split, count(*) AS n FROM signed WHERE split <> 'train' AND signature NOT IN (SELECT signature FROM signed WHERE split = 'train') GROUP BY split")
def excluded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases of each other split are left without those whose input stands in training."""
    rows = C.signed(spark, sf_dir)
    return rows.where("split <> 'train'").join(rows.where("split = 'train'").select("signature"), "signature", "left_anti").groupBy("split").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last recorded answer of each case and type, with probabilities by key."""
    rows = C.decisions(spark, sf_dir).select("id", "kind", "raw_id", "keys", "z", "result")
    cols = lambda x: [F.col("raw_id").alias(f"{x}_id"), F.col("keys").alias(f"{x}_keys"), D.softmax(F.col("z")).alias(f"{x}_p"), F.col("result.label").alias(f"{x}_label"), F.col("result.confidence").alias(f"{x}_confidence")]
    span = rows.groupBy("id", "kind").agg(F.min("raw_id").alias("first"), F.max("raw_id").alias("last")).where("first < last")
    a = rows.select("id", "kind", *cols("a")).join(span.select("id", "kind", F.col("first").alias("a_id"), "last"), ["id", "kind", "a_id"])
    return a.join(rows.select(F.col("raw_id").alias("last"), *cols("b")), "last")


PAIRS = f"""{C.DECISIONS}, soft AS ({C._softmax_sql("decisions")}),
    span AS (SELECT id, kind, min(raw_id) AS a, max(raw_id) AS b FROM soft GROUP BY id, kind HAVING min(raw_id) < max(raw_id)),
    pairs AS (SELECT s.id, s.kind, x.raw_id AS a_id, y.raw_id AS b_id, x.keys AS a_keys, y.keys AS b_keys, x.p AS a_p, y.p AS b_p, x.result.label AS a_label, y.result.label AS b_label, x.result.confidence AS a_confidence, y.result.confidence AS b_confidence
        FROM span s JOIN soft x ON x.raw_id = s.a AND x.id = s.id JOIN soft y ON y.raw_id = s.b AND y.id = s.id),
    laid AS (SELECT *, list_transform(a_keys, lambda k: b_p[list_position(b_keys, k)]) AS q FROM pairs WHERE list_sort(a_keys) = list_sort(b_keys))"""


@query(f"""
    WITH {PAIRS}
    SELECT kind, count(*) AS n, count(*) FILTER (WHERE a_keys[list_position(a_p, list_max(a_p))] = b_keys[list_position(b_p, list_max(b_p))]) AS same_label,
        round(max(list_max(list_transform(list_zip(a_p, q), lambda x: abs(x[1] - x[2])))), 6) AS largest, round(avg(0.5 * list_sum(list_transform(list_zip(a_p, q), lambda x: abs(x[1] - x[2])))), 6) AS total_variation
    FROM laid GROUP BY kind
""")
def repeated_answers_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two separate answers to one case, their probabilities laid side by side by key, whatever order they came in."""
    rows = _pairs(spark, sf_dir).where(F.array_sort("a_keys") == F.array_sort("b_keys")).withColumn("q", D.aligned(F.col("b_p"), F.col("b_keys"), F.col("a_keys")))
    same = D.at(F.col("a_keys"), D.argmax(F.col("a_p"))) == D.at(F.col("b_keys"), D.argmax(F.col("b_p")))
    p, q = F.col("a_p"), F.col("q")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(same).alias("same_label"), F.round(F.max(D.largest_difference(p, q)), 6).alias("largest"), F.round(F.avg(D.total_variation(p, q)), 6).alias("total_variation"))


@query(f"WITH {PAIRS} SELECT id, a_id, b_id, a_label IS NOT DISTINCT FROM b_label AND (a_confidence IS NOT DISTINCT FROM b_confidence OR coalesce(abs(a_confidence - b_confidence) <= 1e-4, false)) AS same FROM pairs")
def same_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two separate answers to one case are the same decision."""
    side = lambda x: F.struct(F.col(f"{x}_label").alias("label"), F.col(f"{x}_confidence").alias("confidence"))
    rows = _pairs(spark, sf_dir).select("id", "a_id", F.col("last").alias("b_id"), side("a").alias("a"), side("b").alias("b"))
    same = ANS.same_decision(F.col("a"), F.col("b"), ["label"]) & ANS.same_decision(F.col("a"), F.col("b"), ["confidence"], 1e-4)
    return rows.select("id", "a_id", "b_id", same.alias("same"))


@query(f"""
    WITH {C.DECISIONS}, soft AS ({C._softmax_sql("decisions")})
    SELECT raw_id, keys[list_position(p, list_max(p))] AS label, CASE WHEN kind = 'choice' THEN keys[list_position(p, list_max(p))] END AS choice, round(CASE WHEN kind = 'noul' THEN p[list_position(keys, 'true')] END, 6) AS noul,
        round(CASE WHEN kind = 'score' THEN greatest(0, least(len(p) - 1, {C.MEAN})) END, 6) AS score, false AS calibrated FROM soft
""")
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ANS.typed_answer(C.decisions(spark, sf_dir))
    return rows.select("raw_id", "answer.label", "answer.choice", F.round("answer.noul", 6).alias("noul"), F.round("answer.score", 6).alias("score"), "answer.calibrated")


@query("SELECT engine, count(*) AS n, count(*) FILTER (WHERE coalesce(input_tokens <= 512, false)) AS fits, count(*) FILTER (WHERE NOT coalesce(input_tokens <= 512, false)) AS refused FROM run_acceptance GROUP BY engine")
def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that fit the token limit, and those that are refused; nothing is cut to fit."""
    fits, refused = ANS.within_limit(C.answers(spark, sf_dir), "input_tokens", 512)
    both = fits.select("engine", F.lit(1).alias("f")).unionByName(refused.select("engine", F.lit(0).alias("f")))
    return both.groupBy("engine").agg(F.count("*").alias("n"), F.sum("f").alias("fits"), (F.count("*") - F.sum("f")).alias("refused"))


CALLS = "c AS (SELECT engine, source, row_id AS id, epoch_us(started_at) AS s, epoch_us(started_at) + CAST(ceil(wall_ms * 1000) AS BIGINT) AS e FROM run_acceptance WHERE row_id = run_no AND wall_ms > 0 AND wall_ms < 600000 AND started_at IS NOT NULL AND engine IS NOT NULL)"


@query(f"""
    WITH {CALLS}
    SELECT w.engine, w.id AS warm_id, r.id AS run_id, greatest(w.s, r.s) AS "start", least(w.e, r.e) AS "end"
    FROM c w JOIN c r ON w.engine = r.engine AND greatest(w.s, r.s) < least(w.e, r.e) WHERE w.source = 'warmup' AND r.source = 'generated_rules'
""")
def warm_up_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of generated cases that were under way together with a warm-up call of their engine."""
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    calls = C.answers(spark, sf_dir).where("row_id = run_no AND wall_ms > 0 AND wall_ms < 600000 AND started_at IS NOT NULL AND engine IS NOT NULL").select("engine", "source", F.col("row_id").alias("id"), start.alias("start"), (start + F.ceil(F.col("wall_ms") * 1000)).alias("end"))
    pairs = A.overlapping_intervals(calls.where("source = 'warmup'").drop("source"), calls.where("source = 'generated_rules'").drop("source"), "engine", 60_000_000)
    return pairs.select("engine", F.col("left_id").alias("warm_id"), F.col("right_id").alias("run_id"), "start", "end")


@query("SELECT id, row_number() OVER (ORDER BY id) AS position FROM (SELECT DISTINCT id FROM eval_ja ORDER BY id LIMIT 12)")
def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve cases by id, for timing; a top-k report."""
    top = C.cases(spark, sf_dir).select("id").distinct().orderBy("id").limit(12).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return top.select(F.posexplode("ids").alias("position", "id")).select("id", (F.col("position") + 1).cast("long").alias("position"))


@query("SELECT id, array_to_string(list_transform(list_sort(list_transform(['full', 'json', 'selected', 'token'], lambda m: md5(id || ':' || m || ':7') || m)), lambda x: substr(x, 33)), ',') AS methods FROM eval_ja")
def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which each case is given to the methods: seeded, and the same in every run."""
    keyed = F.transform(F.array(*map(F.lit, ("full", "json", "selected", "token"))), lambda m: F.struct(F.md5(F.concat(F.col("id"), F.lit(":"), m, F.lit(":7"))).alias("k"), m.alias("m")))
    return C.cases(spark, sf_dir).select("id", F.array_join(F.array_sort(keyed)["m"], ",").alias("methods"))


@query("SELECT count(*) AS runs, count(DISTINCT run_no) AS distinct_runs FROM (SELECT DISTINCT run_no FROM run_acceptance)")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs once each, however often they are delivered, by a stream over the delivered files, drained."""
    stream = progress.first_deliveries(progress.answer_stream(spark, f"{sf_dir}/run_acceptance.parquet"), "400 days").select("run_no", "row_id")
    return progress.drained(stream, ["run_no"], mode="append").agg(F.count("*").alias("runs"), F.count_distinct("run_no").alias("distinct_runs"))


@query("SELECT form, CAST(count(*) AS BIGINT) AS n FROM eval_ja, (VALUES ('csv'), ('data'), ('jsonl')) f(form) GROUP BY form")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table and of both of its exports, read back."""
    columns = ["id", "type", "source", "family", "state", "instructions", "criteria", "label"]
    folder, rows = own_path(spark, "export"), C.cases(spark, sf_dir)
    exports.export(rows, folder, columns)
    parts = [rows.select(F.lit("data").alias("form")), spark.read.text(f"{folder}/jsonl").select(F.lit("jsonl").alias("form")), exports.read_csv(spark, f"{folder}/csv", columns).select(F.lit("csv").alias("form"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("form").agg(F.count("*").alias("n"))
