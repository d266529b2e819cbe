"""Sources, sinks, export records, validation and streaming progress.

The files are texts that Spark derives from the given tables, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import ids, samples as sample_fields, scores
from evalframe.operators import export, leaderboard, validate
from evalframe.plans import views
from evalframe.plans.aggregate_queries import REQUESTS, _GROUPED, sample_cells
from evalframe.plans.registry import query, table
from evalframe.plans.sample_queries import HARNESS, _HASHED, _REVIEWS, _review_files, converted, harness_line_fields
from evalframe.session import cut_lineage, shared_dir
from evalframe.sources import dimensions, files, records, sinks
from evalframe.streaming import progress

# --- sources ------------------------------------------------------------------------------------------------------------


@query("s1_read_harness_results", """
SELECT model, part, task, key, round(coalesce(TRY_CAST(raw AS DOUBLE), -1), 6) AS number, kind FROM v_raw""", views.RAW)
def read_harness_results(spark, sf):
    docs = views.result_files(spark, sf)
    rows = records.harness_results(docs.select("path", "value"))
    kind = F.when(F.col("json_type") == "STRING", "text").when(F.col("json_type") == "BOOLEAN", "flag").otherwise("number")
    path = F.col("path")
    return rows.select(
        F.regexp_extract(path, "/logs/(.*)/harness", 1).alias("model"),
        F.regexp_extract(path, r"eval_(\d)", 1).cast("int").alias("part"), "task", "key",
        F.round(F.coalesce(F.col("raw").try_cast("double"), F.lit(-1.0)), 6).alias("number"), kind.alias("kind"))


@query("s1_wrong_result_counts", """
SELECT 'dir' || o_custkey AS dir, count(*) FILTER (o_orderkey % 2 = 0) AS n_files FROM orders GROUP BY ALL
HAVING count(*) FILTER (o_orderkey % 2 = 0) <> 1""")
def wrong_result_counts(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("dir"), F.col("o_custkey").cast("string")).alias("dir"),
        F.concat(F.lit("/x/"), F.when(F.col("o_orderkey") % 2 == 0, "results_").otherwise("samples_"), "o_orderkey", F.lit(".json")).alias("path"))
    return files.wrong_result_counts(rows, rows.select("dir"))


def _sample_text(spark, sf):
    """Sample lines as files hold them: metric values beside the fields, some lines blank or cut off."""
    fields = harness_line_fields(spark, sf)
    body = F.to_json(F.struct("doc_id", "target", "arguments", "resps", "filtered_resps", "metrics", "filter"))
    extra = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat(F.lit(', "'), e["key"], F.lit('": '), e["value"])), "")
    whole = F.concat(F.expr("substring(_body, 1, length(_body) - 1)"), extra, F.lit("}"))
    line = F.when(F.col("doc_id") % 77 == 5, "  ").when(F.col("doc_id") % 50 == 7, F.left(whole, F.lit(30))).otherwise(whole)
    path = F.concat(F.lit("/x/samples_task"), (F.col("o_custkey") % 4).cast("string"), F.lit("_2025-01-01T00-00-00.jsonl"))
    return fields.withColumn("_body", body).select("doc_id", path.alias("path"), line.alias("value"))


@query("s2_read_sample_lines", """
SELECT o_orderkey AS doc_id, target, CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'strict' ELSE 'none' END AS filter,
  CASE kind WHEN 0 THEN (['F', 'O', 'P'][1 + (o_custkey % 3)::INT] = o_orderstatus)::INT WHEN 1 THEN 1 - odd END::DOUBLE AS value,
  CASE kind WHEN 2 THEN '' WHEN 1 THEN 'exact_match' ELSE 'acc' END AS metrics
FROM v_harness WHERE o_orderkey % 77 <> 5 AND o_orderkey % 50 <> 7""", HARNESS)
def read_sample_lines(spark, sf):
    rows = records.sample_lines(_sample_text(spark, sf).select("path", "value"))
    values = records.attempt_values(F.col("scores"))
    return rows.select(
        "doc_id", "target", "filter", F.coalesce(F.try_element_at(values, F.lit("acc")), F.try_element_at(values, F.lit("exact_match")))[0].alias("value"),
        F.array_join("metrics", ",").alias("metrics"))


@query("s2_bad_sample_lines", """
SELECT '/x/samples_task' || (o_custkey % 4) || '_2025-01-01T00-00-00.jsonl' AS path, count(*) AS n FROM orders
WHERE o_orderkey % 50 = 7 AND o_orderkey % 77 <> 5 GROUP BY ALL""")
def bad_sample_lines(spark, sf):
    return records.bad_sample_lines(_sample_text(spark, sf).select("path", "value")).groupBy("path").agg(F.count("*").alias("n"))


_LISTED = """v_listed AS (
  SELECT p_brand AS run, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE lower(p_type) || '_b' END AS task,
    '/w/' || p_brand || '/samples_' || CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE lower(p_type) || '_b' END || '_2025-0' || (1 + p_partkey % 9) || '-01T00-00-0' || (p_size % 10) || '.jsonl' AS path
  FROM part)"""


def _listed(spark, sf):
    task = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "").otherwise("_b"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("run"), F.concat(
        F.lit("/w/"), "p_brand", F.lit("/samples_"), task, F.lit("_2025-0"), (F.col("p_partkey") % 9 + 1).cast("string"),
        F.lit("-01T00-00-0"), (F.col("p_size") % 10).cast("string"), F.lit(".jsonl")).alias("path"))


@query("s3_latest_sample_file", "SELECT run, task, max(path) AS path FROM v_listed GROUP BY ALL", _LISTED)
def latest_sample_file(spark, sf):
    return files.latest_sample_files(_listed(spark, sf), ["run"])


@query("s4_discover_runs", """
SELECT DISTINCT 'm' || o_custkey AS model, 'eval_' || year(o_orderdate) || '_' || (o_orderkey % 5) AS run,
  (dense_rank() OVER (PARTITION BY o_custkey ORDER BY 'eval_' || year(o_orderdate) || '_' || (o_orderkey % 5)) - 1)::INT AS run_ord
FROM orders WHERE o_orderkey % 7 > 0""")
def discover_runs(spark, sf):
    path = F.concat(
        F.lit("/logs/m"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 7 > 0, "/harness/eval_").otherwise("/other/eval_"),
        F.year("o_orderdate").cast("string"), F.lit("_"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/results_x.json"))
    return files.discover_runs(table(spark, sf, "orders").select(path.alias("path")))


@query("s5_read_trials", """
SELECT benchmark, task_name, trial_name, reward, strict, exception_type, epoch_us(ts) // 1000000 AS started FROM v_trials""", views.TRIALS)
def read_trials(spark, sf):
    t = views.trials(spark, sf)
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    body = F.struct(
        "task_name", "trial_name", F.struct("rewards").alias("verifier_result"), F.struct("exception_type", "exception_message").alias("exception_info"),
        F.struct("n_input_tokens", "n_output_tokens").alias("agent_result"), when("started_at"), when("finished_at"))
    path = F.concat(F.lit("/w/jobs/"), "benchmark", F.lit("/"), "trial_name", F.lit("/result.json"))
    read = records.trials(t.select(path.alias("path"), F.to_json(body).alias("value")))
    return read.select(
        "benchmark", "task_name", "trial_name", F.try_element_at("rewards", F.lit("reward")).alias("reward"),
        F.try_element_at("rewards", F.lit("strict")).alias("strict"), "exception_type", F.unix_seconds("started_at").alias("started"))


@query("s6_read_reviews", """
SELECT model, file, instance, CASE WHEN event_type = 'signup' THEN 'error' ELSE 'success' END AS status,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END::DOUBLE AS acc, first_event FROM v_reviews""", _REVIEWS)
def read_reviews(spark, sf):
    return records.reviews(_review_files(spark, sf)).select(
        "model", "file", "instance", "status", F.try_element_at("value", F.lit("acc")).alias("acc"), "first_event")


@query("s7_read_reports", """
SELECT 'm' || p_partkey AS model, lower(p_type) AS dataset, round(p_retailprice / 10000, 6) AS score, u.m AS metric, u.n::BIGINT AS num FROM part,
  LATERAL (SELECT unnest([{'m': 'mean_acc', 'n': p_size}, {'m': 'f1', 'n': p_size + 1}]) AS u) WHERE p_partkey % 6 > 0""")
def read_reports(spark, sf):
    metric = lambda name, n: F.struct(F.struct(F.lit(name).alias("name")).alias("identity"), F.lit(0.5).alias("score"), n.alias("num"))
    body = F.to_json(F.struct(
        F.lower("p_type").alias("dataset_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_name"),
        (F.col("p_retailprice") / 10000).alias("score"), F.array(metric("mean_acc", F.col("p_size")), metric("f1", F.col("p_size") + 1)).alias("metrics")))
    value = F.when(F.col("p_partkey") % 6 == 0, F.left(body, F.lit(40))).otherwise(body)
    rows = table(spark, sf, "part").select(F.concat(F.lit("/w/reports/"), "p_brand").alias("path"), value.alias("value"))
    return records.reports(rows).select("model", "dataset", F.round("score", 6).alias("score"), "metric", "num")


@query("s8_read_simulations", "SELECT domain, task_id, reward, epoch_us(started_at) // 1000000 AS started FROM v_sims", views.SIMS)
def read_simulations(spark, sf):
    s = views.simulations(spark, sf)
    when = lambda c, name: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
    sim = F.struct(
        "task_id", "termination_reason", F.struct("reward").alias("reward_info"), F.struct("error", "error_type", "error_traceback").alias("info"),
        when("started_at", "start_time"), when("ended_at", "end_time"))
    body = F.to_json(F.struct(
        F.struct(F.struct(F.col("domain").alias("domain_name")).alias("environment_info")).alias("info"), F.array(sim).alias("simulations")))
    docs = s.select(F.concat(F.lit("/w/"), F.col("event_id").cast("string")).alias("path"), body.alias("value"))
    return records.simulations(docs).select("domain", "task_id", "reward", F.unix_seconds("started_at").alias("started"))


@query("s9_read_category_scores", """
SELECT '/w/score/' || model AS dir, category, round(accuracy, 6) AS accuracy, correct, total FROM v_categories""", views.CATEGORY_VIEW)
def read_category_scores(spark, sf):
    rows = views.categories(spark, sf)
    path = F.concat(F.lit("/w/score/"), "model", F.lit("/BFCL_v3_"), "category", F.lit("_score.json"))
    header = F.to_json(F.struct("accuracy", F.col("correct").alias("correct_count"), F.col("total").alias("total_count")))
    lines = rows.select(path.alias("path"), F.explode(F.array(header, F.lit('{"id": "x", "valid": false}'))).alias("value"))
    return records.category_scores(lines).withColumn("accuracy", F.round("accuracy", 6))


@query("s10_read_group_csv", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(l / 10000.0, 6) END::DOUBLE AS score
FROM (SELECT o_orderkey, o_custkey % 10000 AS l FROM orders)""")
def read_group_csv(spark, sf):
    hundredths = F.col("o_custkey") % 10000
    cell = F.concat(F.expr("(o_custkey % 10000) div 100").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%"))
    value = F.when(F.col("o_orderkey") % 4 == 0, "N/A").otherwise(cell)
    return table(spark, sf, "orders").select("o_orderkey", F.round(records.percent_cell(value), 6).alias("score"))


@query("s11_read_qa_tsv", """
SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS prop, 2 AS n_aliases, o_orderstatus AS first_alias, o_custkey AS s_pop FROM orders""")
def read_qa_tsv(spark, sf):
    """Writes the orders as a tab-separated file and reads them back as questions."""
    path = shared_dir(spark, "questions")
    table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit('What is "it"?').alias("question"), F.col("o_orderpriority").alias("prop"),
        F.to_json(F.array("o_orderstatus", F.lit("tab\tquote\""))).alias("possible_answers"), F.col("o_custkey").alias("s_pop"), F.lit(1).alias("o_pop"),
    ).write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    return records.read_questions(spark, path).select(
        "id", "prop", F.size("aliases").alias("n_aliases"), F.col("aliases")[0].alias("first_alias"), "s_pop")


_LINES = """v_lines AS (
  SELECT p_partkey // 100 AS file, p_partkey AS line_no, CASE p_partkey % 10 WHEN 3 THEN '# Group ' || p_partkey WHEN 5 THEN ''
    WHEN 7 THEN '  ' || replace(p_name, ' ', '_') || '/acc,none ' ELSE replace(p_name, ' ', '_') || '/' || lower(p_type) END AS text FROM part)"""


def _request_lines(spark, sf):
    key, name = F.col("p_partkey"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    text = (
        F.when(key % 10 == 3, F.concat(F.lit("# Group "), key.cast("string"))).when(key % 10 == 5, "")
        .when(key % 10 == 7, F.concat(F.lit("  "), name, F.lit("/acc,none "))).otherwise(F.concat(name, F.lit("/"), F.lower("p_type"))))
    return table(spark, sf, "part").select(F.expr("p_partkey div 100").alias("file"), key.alias("line_no"), text.alias("text"), key.alias("ord"))


@query("s12_metric_requests", """
SELECT file, line_no, 'Group ' || h AS "group", trim(text) AS request, split_part(trim(text), '/', 1) AS display FROM (
  SELECT *, max(CASE WHEN text LIKE '#%' THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS h FROM v_lines)
WHERE h IS NOT NULL AND text NOT LIKE '#%' AND trim(text) <> ''""", _LINES)
def metric_requests(spark, sf):
    return dimensions.request_rows(_request_lines(spark, sf))


@query("s12_flat_requests", """
SELECT trim(text) AS request, min(line_no) AS ord FROM v_lines WHERE text NOT LIKE '#%' AND trim(text) <> '' GROUP BY ALL""", _LINES)
def flat_requests(spark, sf):
    return dimensions.flat_requests(_request_lines(spark, sf))


@query("s12_task_names", """
SELECT task, min(line_no) AS ord FROM (SELECT trim(split_part(split_part(text, '#', 1), '/', 1)) AS task, line_no FROM v_lines) WHERE task <> '' GROUP BY ALL""", _LINES)
def task_names(spark, sf):
    return dimensions.task_names(_request_lines(spark, sf))


@query("s14_include", """
SELECT DISTINCT trim(text) AS request FROM v_lines WHERE text NOT LIKE '#%' AND (lower(text) LIKE '%ring%' OR lower(text) LIKE '%red%')""", _LINES)
def include(spark, sf):
    return dimensions.include_exclude(dimensions.flat_requests(_request_lines(spark, sf)), ["RING", "Red"], ["ring"]).select("request")


@query("s14_exclude", """
SELECT DISTINCT trim(text) AS request FROM v_lines WHERE text NOT LIKE '#%' AND trim(text) <> '' AND lower(text) NOT LIKE '%ring%'""", _LINES)
def exclude(spark, sf):
    return dimensions.include_exclude(dimensions.flat_requests(_request_lines(spark, sf)), exclude=["RING"]).select("request")


# --- sinks ----------------------------------------------------------------------------------------------------------------


@query("w1_write_csv_table", "SELECT model, request, round(score, 6) AS score FROM v_cells", _GROUPED)
def write_csv_table(spark, sf):
    path = shared_dir(spark, "table")
    sinks.write_csv_table(sample_cells(spark, sf).withColumn("score", F.round("score", 6)), path)
    return spark.read.option("header", "true").schema("model STRING, request STRING, score DOUBLE").csv(path)


@query("w2_write_grouped_json", """
SELECT r.grp AS "group", r.request, c.model, round(c.score, 6) AS score, round(a.average, 6) AS average
FROM (VALUES """ + ", ".join(str(r) for r in REQUESTS) + """) r(ord, grp, request, display) JOIN v_cells c ON c.request = r.request
JOIN (SELECT r.grp, c.model, avg(c.score) AS average FROM (VALUES """ + ", ".join(str(r) for r in REQUESTS) + """) r(ord, grp, request, display)
  JOIN v_cells c ON c.request = r.request GROUP BY ALL) a ON a.grp = r.grp AND a.model = c.model""", _GROUPED)
def write_grouped_json(spark, sf):
    """Writes the grouped document and reads it back."""
    path = shared_dir(spark, "grouped")
    sinks.write_lines(sinks.grouped_json(sample_cells(spark, sf), leaderboard.request_table(spark, REQUESTS)).select("value"), path)
    read = spark.read.schema(
        "name STRING, average MAP<STRING, DOUBLE>, metrics ARRAY<STRUCT<key STRING, display STRING, scores MAP<STRING, DOUBLE>>>").json(path)
    rows = read.select(F.col("name").alias("group"), "average", F.explode("metrics").alias("m")).select(
        "group", "average", F.col("m.key").alias("request"), F.explode("m.scores").alias("model", "score"))
    return rows.select("group", "request", "model", F.round("score", 6).alias("score"),
                       F.round(F.try_element_at("average", F.col("model")), 6).alias("average"))


_SHA = "sha256('run' || p)"
_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1))::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


def _export(spark, sf):
    """Scores of the supplier models as record entries, and orders as instances of the same collections."""
    collection = lambda n: F.concat(F.lit("bench"), n.cast("string"))
    rows = views.summary(spark, sf).select(
        F.col("model").alias("model_id"), collection(F.col("model_no") % 3).alias("collection"),
        F.substring_index("key", "/", 1).alias("task"), F.substring_index("key", "/", -1).alias("key"), "score",
        F.sha2(F.col("model"), 256).alias("source_sha"), F.lit("1700000000.0").alias("evaluation_timestamp"),
        F.concat(F.lit("fam."), F.substring_index("key", "/", 1), F.lit(".overall")).alias("evaluation_name"),
        F.lit("bench").alias("benchmark"), F.lit(True).alias("higher_is_better"), F.lit(None).cast("double").alias("standard_error"),
        F.lit(10).cast("long").alias("num_samples"), F.lit("acme/data").alias("dataset_id"), F.lit("acme/data").alias("dataset_name"),
        F.lit("hf_dataset").alias("source_type"))
    results = export.evaluation_results(rows)
    number = F.col("ord") % 10
    lines = converted(spark, sf).select(
        F.concat(F.lit("acme/model-"), number.cast("string")).alias("model_id"), collection(number % 3).alias("collection"), "instance")
    return results, lines


def _written_export(spark, sf):
    path = shared_dir(spark, "export")
    sinks.write_export(*_export(spark, sf), path, "harness run", "1700000001.0")
    return sinks.read_small_files(spark, f"{path}/records"), sinks.read_export_lines(spark, f"{path}/instances")


_RECORDS = views.SUMMARY + f""", v_records AS (
  SELECT model, collection, {_UUID} AS uuid, n_results FROM (
    SELECT model, 'bench' || (model_no % 3) AS collection, sha256(sha256(model) || chr(0) || 'bench' || (model_no % 3) || chr(0) || model) AS h,
      count(*) AS n_results FROM v_summary GROUP BY ALL)),
v_instances AS (SELECT 'acme/model-' || (o_orderkey % 10) AS model, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL)"""


@query("w3_write_export_records", """
SELECT collection, 'acme' AS developer, split_part(r.model, '/', 2) AS model, uuid, n_results, coalesce(i.n, 0) AS n_instances
FROM v_records r LEFT JOIN v_instances i ON i.model = r.model""", _RECORDS)
def write_export_records(spark, sf):
    """Writes records and instances below collection/developer/model/uuid and counts what can be read back."""
    recs, lines = _written_export(spark, sf)
    keys = list(sinks.EXPORT_KEYS)
    read = recs.select(*keys, F.from_json("value", validate.RECORD)["evaluation_results"].alias("e")).select(
        *keys, F.size("e").cast("long").alias("n_results"))
    counts = lines.groupBy(*keys).agg(F.count("*").alias("n_instances"))
    return read.join(counts, keys, "left").withColumn("n_instances", F.coalesce("n_instances", F.lit(0)))


@query("w4_write_manifest", """
SELECT split_part(r.model, '/', 2) AS model, count(*)::BIGINT AS n_records, min(uuid) AS first_uuid, CASE WHEN min(model_no) % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_warnings
FROM v_records r JOIN (SELECT DISTINCT model, model_no FROM v_summary) n USING (model) GROUP BY ALL""", _RECORDS)
def write_manifest(spark, sf):
    results, _ = _export(spark, sf)
    none = export.record_ids(results).select("uuid", F.lit(0).alias("total_rows"), F.lit("").alias("checksum"))
    recs = export.export_records(results, none, "harness run", "1700000001.0")
    warnings = views.summary(spark, sf).where("model_no % 2 = 0").select(
        F.substring_index("model", "/", -1).alias("model"), F.lit("temperature is not logged").alias("warning"))
    manifest = export.manifest(recs, warnings).select("model", F.from_json(
        "value", "n_records BIGINT, records ARRAY<STRUCT<collection STRING, uuid STRING>>, warnings ARRAY<STRING>").alias("m"))
    return manifest.select("model", "m.n_records", F.col("m.records")[0]["uuid"].alias("first_uuid"), F.size("m.warnings").cast("long").alias("n_warnings"))


@query("w5_write_hub_entries", """
SELECT p_brand AS benchmark, '- dataset:' || chr(10) || '    id: "acme/' || p_type || '"' || chr(10) || '    task_id: "' || p_name || '"' || chr(10) || '  value: ' || p_size
  || chr(10) || '  date: "2025-01-01"' || chr(10) || '  source:' || chr(10) || '    url: "http://x"' || chr(10) || '    name: "Results"' || chr(10) || '  notes: "part=' || p_partkey || '"' || chr(10) AS entry
FROM part""")
def write_hub_entries(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("benchmark"), export.hub_entry(
        F.concat(F.lit("acme/"), "p_type"), F.col("p_name"), F.col("p_size"), F.lit("2025-01-01"), F.lit("http://x"), "Results",
        F.concat(F.lit("part="), F.col("p_partkey").cast("string"))).alias("entry"))


@query("w6_sample_table", """
SELECT 'task' || (o_custkey % 4) AS task, count(*) AS n, sum(o_orderkey)::BIGINT AS ids, max(sha1(o_orderkey::VARCHAR)) AS last_hash
FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL""")
def sample_table(spark, sf):
    """Writes flattened samples per task and reads the table back."""
    path = shared_dir(spark, "samples")
    rows = converted(spark, sf).select("task", "instance.*")
    sinks.write_sample_table(rows.select(*sinks.flatten_struct(rows.schema)), path)
    return spark.read.parquet(path).groupBy("task").agg(
        F.count("*").alias("n"), F.sum(F.col("sample_id").cast("long")).alias("ids"), F.max("`metadata/doc_hash`").alias("last_hash"))


# --- validation -------------------------------------------------------------------------------------------------------------


def _record_texts(spark, sf):
    """Records of customers with one defect or none, by key."""
    key = F.col("c_custkey")
    bad = lambda n: key % 12 == n
    pick = lambda n, broken, good: F.when(bad(n), broken).otherwise(good)
    result = F.struct(
        pick(1, "only.two", "fam.bench.overall").alias("evaluation_name"),
        F.struct(F.lit("hf_dataset").alias("source_type"), pick(2, "no-owner", "acme/d").alias("hf_repo"), pick(3, "other", "acme/d").alias("dataset_name"),
                 F.struct(pick(4, "http://x", "https://huggingface.co/datasets/acme/d").alias("hf_dataset_url")).alias("additional_details")).alias("source_data"),
        F.struct(F.when(~bad(5), F.lit(False)).alias("lower_is_better"), F.lit(0.0).alias("min_score"), F.lit(1.0).alias("max_score")).alias("metric_config"),
        F.struct(F.when(bad(6), 2.5).when(bad(7), -1.0).when(~bad(8), 0.5).alias("score")).alias("score_details"))
    record = F.struct(
        pick(9, "0.1", "0.2.2").alias("schema_version"), F.lit("e").alias("evaluation_id"), F.when(~bad(10), "1.0").alias("retrieved_timestamp"),
        F.struct(F.lit("s").alias("source_name")).alias("source_metadata"), F.struct(F.lit("m").alias("name"), pick(11, "nobody", "acme/m").alias("id")).alias("model_info"),
        F.struct(F.lit("l").alias("name")).alias("eval_library"), F.array(result).alias("evaluation_results"))
    return table(spark, sf, "customer").select(key.alias("id"), F.to_json(record).alias("value"))


@query("v1_validate_records", """
SELECT id, message FROM (SELECT c_custkey AS id, CASE c_custkey % 12
    WHEN 1 THEN ['evaluation_results[0]: evaluation_name must use [composite.]family.benchmark.split']
    WHEN 2 THEN ['evaluation_results[0]: hf_repo must use owner/dataset format'] WHEN 3 THEN ['evaluation_results[0]: dataset_name must match the dataset id']
    WHEN 4 THEN ['evaluation_results[0]: source_data requires the direct dataset URL']
    WHEN 5 THEN ['evaluation_results[0]: metric_config.lower_is_better is required'] WHEN 6 THEN ['evaluation_results[0]: score exceeds metric_config.max_score']
    WHEN 7 THEN ['evaluation_results[0]: score is below metric_config.min_score'] WHEN 8 THEN ['evaluation_results[0]: score must be numeric']
    WHEN 9 THEN ['expected schema_version 0.2.2'] WHEN 10 THEN ['missing top-level fields: retrieved_timestamp']
    WHEN 11 THEN ['model_info.id must use owner/model format'] ELSE [] END AS messages FROM customer), LATERAL (SELECT unnest(messages) AS message)""")
def validate_records(spark, sf):
    return validate.validate_records(_record_texts(spark, sf), ["id"])


def _instance_texts(spark, sf):
    key = F.col("o_orderkey")
    text = export.instance_lines(converted(spark, sf)).withColumn("id", F.get_json_object("value", "$.sample_id").cast("long"))
    broken = (
        F.when(F.col("id") % 10 == 0, F.replace(F.col("value"), F.lit('"single_turn"'), F.lit('"multi"')))
        .when(F.col("id") % 10 == 4, F.regexp_replace("value", '"is_correct":(true|false)', '"is_correct":"yes"'))
        .when(F.col("id") % 10 == 7, F.replace(F.col("value"), F.lit('"model_id":"acme/m",'), F.lit("")))
        .otherwise(F.col("value")))
    return text.select("id", broken.alias("value"))


@query("v2_validate_instances", """
SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'instances must be single_turn' WHEN 4 THEN 'evaluation.is_correct must be boolean'
  ELSE 'missing instance fields: model_id' END AS message FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 IN (0, 4, 7)""")
def validate_instances(spark, sf):
    return validate.validate_instances(_instance_texts(spark, sf), ["id"])


@query("v3_validate_export", """
SELECT 'bench' || (m % 3) AS collection, 'model-' || m AS model, message FROM (SELECT unnest([
  {'m': 1, 'message': 'missing instance results'}, {'m': 2, 'message': 'checksum mismatch'}, {'m': 2, 'message': 'row-count mismatch'},
  {'m': 3, 'message': 'checksum mismatch'}]) AS u), LATERAL (SELECT u.m AS m, u.message AS message)
WHERE EXISTS (SELECT 1 FROM orders) AND EXISTS (SELECT 1 FROM v_records r WHERE r.model = 'acme/model-' || m)""", _RECORDS)
def validate_export(spark, sf):
    """A written export checked against its lines with a record's instances removed, one line lost and one changed."""
    recs, lines = _written_export(spark, sf)
    recs = cut_lineage(recs, "records")  # the checks read them several times, their files are opened once
    number = F.get_json_object("value", "$.sample_id")
    damaged = lines.where((F.col("model") != "model-1") & ~((F.col("model") == "model-2") & (number == "12"))).withColumn(
        "value", F.when((F.col("model") == "model-3") & (number == "3"), F.replace(F.col("value"), F.lit('"acme/m"'), F.lit('"acme/x"'))).otherwise(F.col("value")))
    found = validate.validate_export(recs, damaged, list(sinks.EXPORT_KEYS))
    return found.where(~F.startswith("message", F.lit("evaluation_results["))).select("collection", "model", "message")


# --- streaming ----------------------------------------------------------------------------------------------------------------


@query("t1_review_progress", """
SELECT model || '/' || file AS key, count(*) AS done, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type = 'signup') AS failed
FROM v_reviews WHERE event_id % 20 <> 3 GROUP BY ALL""", _REVIEWS)
def review_progress(spark, sf):
    """Writes review lines as closed, zipped segments per file, follows them as a stream and reads the progress table."""
    root = shared_dir(spark, "reviews")
    key = progress.file_key(F.col("path"))
    lines = _review_files(spark, sf).select(
        F.substring_index(key, "/", 1).alias("m"), F.concat(F.substring_index(key, "/", -1), F.lit(".jsonl")).alias("f"),
        F.when(F.col("event_id") % 20 == 3, F.left("value", F.lit(60))).otherwise(F.col("value")).alias("value"))
    sinks.write_lines(lines, f"{root}/in/reviews", ["m", "f"], compression="gzip")
    stream = progress.start_progress(spark, f"{root}/in", f"{root}/progress", f"{root}/state", once=True)
    stream.awaitTermination()
    return progress.latest_progress(spark, f"{root}/progress").withColumn(
        "key", F.regexp_replace("key", "(m|f)=", ""))
