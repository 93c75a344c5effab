"""More registered queries: whole reports, usage, positions, balanced picks and checks of recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C
from .catalogue import query
from .functions import decision as D
from .operators import arranging as A
from .operators import calibration, metrics, summaries
from .operators.candidates import kind_of, option_rows, with_options
from .plans.staging import table


@query(f"""
    SELECT engine, type, {C.ACCURACY}, count(*) FILTER (WHERE NOT coalesce(valid, false)) AS invalid, count(error) AS failed, round(avg(wall_ms), 6) AS mean_ms, min(wall_ms) AS shortest_ms, max(wall_ms) AS longest_ms,
        CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(reverse) AS turned, round(count(*) FILTER (WHERE reverse.same_label) / nullif(count(reverse), 0), 6) AS order_kept,
        CAST(grouping_id(engine, type) AS INTEGER) AS level
    FROM run_acceptance WHERE row_id = run_no GROUP BY GROUPING SETS ((), (engine), (type), (engine, type))
""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of runs: of all, by engine, by type and by both."""
    rows = C.answers(spark, sf_dir).where("row_id = run_no").withColumn("type", F.col("type"))
    out = summaries.run_summary(rows, [[], ["engine"], ["type"], ["engine", "type"]])
    return out.select("engine", "type", *(c for c in out.columns if c not in ("engine", "type")))


@query(f"""
    WITH {C.DECISIONS}, soft AS ({C._softmax_sql("decisions")})
    SELECT run_key, kind, count(*) AS n, count(gold) AS labelled, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = gold) AS correct, round(avg(-ln(greatest(p[gold + 1], 1e-15))), 6) AS nll,
        round(avg(CASE WHEN gold IS NOT NULL THEN {C.BRIER} END), 6) AS brier, round(avg(abs({C.MEAN} - gold)), 6) AS mae, CAST(grouping_id(run_key, kind) AS INTEGER) AS level
    FROM soft GROUP BY GROUPING SETS ((run_key), (run_key, kind))
""")
def answer_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and losses of recorded answers by run, and by run and type."""
    soft = C.decisions(spark, sf_dir).select("run_key", "kind", "gold", D.softmax(F.col("z")).alias("p"))
    return summaries.answer_summary(soft, [["run_key"], ["run_key", "kind"]]).select("run_key", "kind", "n", "labelled", "correct", "nll", "brier", "mae", "level")


@query("SELECT request.id AS request_id, count(*) AS records, count(result) AS answers, CAST(coalesce(sum(result.input_tokens), 0) AS BIGINT) AS input_tokens FROM raw WHERE request.id IS NOT NULL GROUP BY request.id")
def usage_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw").where("request.id IS NOT NULL")
    return rows.groupBy(F.col("request.id").alias("request_id")).agg(F.count("*").alias("records"), F.count("result").alias("answers"), F.coalesce(F.sum("result.input_tokens"), F.lit(0)).cast("long").alias("input_tokens"))


@query("""
    WITH r AS (SELECT raw_id, result.candidate_keys AS k, result.candidate_logits AS z FROM raw WHERE result.candidate_keys IS NOT NULL AND result.candidate_logits IS NOT NULL),
        p AS (SELECT raw_id, k, z, unnest(range(greatest(len(k), len(z)))) AS pos FROM r)
    SELECT raw_id, CAST(pos AS INTEGER) AS pos, k[pos + 1] AS key, z[pos + 1] AS logit FROM p
""")
def positional_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and logits of a record, side by side by position."""
    rows = table(spark, sf_dir, "raw").select("raw_id", F.col("result.candidate_keys").alias("k"), F.col("result.candidate_logits").alias("z")).where("k IS NOT NULL AND z IS NOT NULL")
    return summaries.positional(rows, ["raw_id"], key="k", logit="z")


@query(f"WITH {C.OPTIONS} SELECT id, kind, CAST(ord AS INTEGER) AS ord, key FROM pairs WHERE ord IN (0, 2)")
def picked_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options at fixed positions, the first and the third."""
    return option_rows(C.cases(spark, sf_dir)).where(F.col("ord").isin(0, 2)).select("id", "kind", "ord", "key")


@query(f"""
    WITH {C.EMBEDDED}, t AS (SELECT unnest(range(201)) AS idx), g AS (SELECT CAST(idx AS INTEGER) AS idx, round(pow(10, -1 + 2.0 * idx / 200), 9) AS temperature FROM t),
        s AS (SELECT idx, temperature, gold, list_transform(z, lambda x: x / temperature) AS y FROM embedded, g),
        l AS (SELECT idx, temperature, round(avg(list_max(y) + ln(list_sum(list_transform(y, lambda x: exp(x - list_max(y))))) - y[gold + 1]), 9) AS nll FROM s GROUP BY idx, temperature)
    SELECT idx, temperature, round(nll, 6) AS nll FROM l ORDER BY nll, idx LIMIT 1
""")
def first_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first grid point with the least loss."""
    grid = calibration.grid_nll(C.embedded(spark, sf_dir), C.GRID, floor=0)
    top = grid.agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "idx", "temperature")).alias("t"))
    return top.select("t.idx", "t.temperature", F.round("t.nll", 6).alias("nll"))


@query(f"""
    WITH {C.SIGNED}, c AS (SELECT s.signature, s.id, lower(trim(e.type)) AS kind, e.label FROM signed s JOIN eval_ja e USING (id) WHERE s.split <> 'train'),
        n AS (SELECT * FROM c WHERE signature NOT IN (SELECT signature FROM signed WHERE split = 'train') AND (signature, id) IN (SELECT (signature, min(id)) FROM c GROUP BY signature)),
        r AS (SELECT kind, label, id, row_number() OVER (PARTITION BY kind, label ORDER BY md5(id || ':11'), id) AS place FROM n)
    SELECT kind, label, id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5
""")
def balanced_new_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cases of each type and label whose input is new to training and not taken twice."""
    rows = C.cases(spark, sf_dir).select("id", "label", kind_of(F.col("type")).alias("kind")).join(C.signed(spark, sf_dir), "id")
    new = summaries.balanced_new(rows.where("split <> 'train'"), rows.where("split = 'train'"), "signature", "id", ["kind", "label"], 5, "11")
    return new.select("kind", "label", "id", "place")


@query(f"""
    WITH {C.OPTIONS}, o AS (SELECT id, list_sort(list_distinct(list(coalesce(description, key)))) AS d FROM pairs GROUP BY id)
    SELECT sha256(array_to_string(d, chr(30))) AS identity, count(*) AS cases, min(id) AS first_id FROM o GROUP BY d HAVING count(*) > 1
""")
def order_free_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of options that several cases have, whatever order and keys they stand under."""
    rows = with_options(C.cases(spark, sf_dir)).where(F.size("options") > 0)
    identity = summaries.order_free(F.transform("options", lambda o: F.coalesce(o["description"], o["key"])))
    return rows.groupBy(identity.alias("identity")).agg(F.count("*").alias("cases"), F.min("id").alias("first_id")).where("cases > 1")


@query("""
    WITH s AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(type)) ORDER BY md5(id || ':20260713'), id) AS place FROM eval_ja) WHERE place <= 12)
    SELECT count(*) AS picked, CAST(0 AS BIGINT) AS differing FROM s
""")
def sampling_repeatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample taken twice, of the table as it is and of its rows laid out otherwise, and how many picks differ."""
    rows = C.cases(spark, sf_dir).select("id", kind_of(F.col("type")).alias("kind"))
    once, again = (A.sampled(r, "id", ["kind"], 12, "20260713").select("kind", "id", "place", F.lit(side).alias("side")) for r, side in ((rows, 1), (rows.repartition("id"), -1)))
    sides = once.unionByName(again).groupBy("kind", "id", "place").agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("c"))
    return sides.agg(F.sum("c").alias("picked"), F.count_if(F.col("d") != 0).alias("differing"))


@query(f"""
    WITH {C.DECISIONS}, soft AS ({C._softmax_sql("decisions")}),
        o AS (SELECT kind, coalesce(result.calibrated, false) AS calibrated, list_max(list_transform(list_zip(p, list_transform(keys, lambda k: result.probabilities[k])), lambda x: abs(x[1] - x[2]))) AS off FROM soft)
    SELECT kind, calibrated, count(*) AS n, count(off) AS compared, count(*) FILTER (WHERE off <= 1e-5) AS within, round(max(off), 6) AS largest FROM o GROUP BY kind, calibrated
""")
def recorded_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded probabilities against those that follow from the recorded logits, with a tolerance."""
    rows = C.decisions(spark, sf_dir).select("kind", F.coalesce("result.calibrated", F.lit(False)).alias("calibrated"), D.softmax(F.col("z")).alias("p"), F.transform("keys", lambda k: F.try_element_at("result.probabilities", k)).alias("q"))
    off = rows.select("kind", "calibrated", F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b))).alias("off"))
    return off.groupBy("kind", "calibrated").agg(F.count("*").alias("n"), F.count("off").alias("compared"), F.count_if(F.col("off") <= 1e-5).alias("within"), F.round(F.max("off"), 6).alias("largest"))


@query("""
    WITH r AS (SELECT least(9, CAST(floor(confidence * CAST(10 AS FLOAT)) AS INTEGER)) AS bin, CAST(confidence AS DOUBLE) AS c, CAST(coalesce(correct, false) AS INTEGER) AS a FROM run_acceptance WHERE confidence IS NOT NULL AND coalesce(valid, false))
    SELECT bin, count(*) AS n, round(abs(avg(c) - avg(a)), 6) AS gap FROM r GROUP BY bin
""")
def single_precision_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between confidence and accuracy in bins whose edges are in single precision, as confidences are stored."""
    c = F.col("confidence")
    rows = C.answers(spark, sf_dir).where(c.isNotNull() & metrics.flag("valid"))
    bin_ = F.least(F.lit(9), F.floor(c * F.lit(10.0).cast("float")).cast("int"))
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.abs(F.avg(c.cast("double")) - F.avg(metrics.flag("correct").cast("int"))), 6).alias("gap"))


@query(f"WITH {C.KINDS} SELECT kind, coalesce(family, kind) AS family, count(*) AS n FROM k GROUP BY kind, coalesce(family, kind)")
def families_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by family, those without one under their type."""
    rows = C.cases(spark, sf_dir).withColumn("kind", kind_of(F.col("type")))
    return summaries.with_family(rows, "family", "kind").groupBy("kind", "family").agg(F.count("*").alias("n"))


@query(f"""
    WITH {C.KINDS}, n AS (SELECT kind, count(*) AS n FROM k GROUP BY kind), w AS (SELECT * FROM (VALUES ('choice', 12), ('noul', 12), ('score', 12), ('rank', 12)) v(kind, expected))
    SELECT coalesce(n.kind, w.kind) AS kind, CAST(coalesce(n.n, 0) AS BIGINT) AS n, CAST(coalesce(w.expected, 0) AS BIGINT) AS expected FROM n FULL JOIN w ON n.kind IS NOT DISTINCT FROM w.kind WHERE coalesce(n.n, 0) <> coalesce(w.expected, 0)
""")
def unexpected_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that don't have as many cases as expected, those without any and those not expected among them."""
    rows = C.cases(spark, sf_dir).select(kind_of(F.col("type")).alias("kind"))
    return summaries.unexpected_counts(rows, "kind", {"choice": 12, "noul": 12, "score": 12, "rank": 12})


@query("""
    WITH b AS (SELECT result AS r, request AS q FROM raw WHERE request IS NOT NULL AND result IS NOT NULL)
    SELECT count(*) AS n, count(*) FILTER (WHERE list_sort(q.candidates) IS DISTINCT FROM list_sort(r.candidate_keys)) AS other_candidates, count(*) FILTER (WHERE r.input_tokens > q.max_input_tokens) AS over_limit FROM b
""")
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose candidates aren't those that were asked for, in any order, and those beyond the token limit."""
    rows = table(spark, sf_dir, "raw").where("request IS NOT NULL AND result IS NOT NULL")
    other = ~F.array_sort("request.candidates").eqNullSafe(F.array_sort("result.candidate_keys"))
    return rows.agg(F.count("*").alias("n"), F.count_if(other).alias("other_candidates"), F.count_if(F.col("result.input_tokens") > F.col("request.max_input_tokens")).alias("over_limit"))
