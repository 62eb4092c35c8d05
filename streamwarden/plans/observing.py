"""Registered queries: features and forest, views, diagnosis, catalog, cached answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.functions import json_values as J
from streamwarden.operators import answers as A, catalog as K, context as X, features as Q, forest as I, views as V
from streamwarden.plans import order_feed as O
from streamwarden.sources.tables import events, orders, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    feed = O.order_feed(spark, folder)
    return feed.select("offset", "timestamp", J.parse_json(F.col("value")).alias("document"))


def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.with_features(_documents(spark, folder))
    return rows.select(
        F.col("offset").alias("o_orderkey"), *[F.col("features")[i].alias(n) for i, n in enumerate(Q.FEATURE_NAMES)]
    )


def _order_features(spark, folder):
    spike = F.when(F.col("o_orderkey") % 97 == 0, 40.0).otherwise(1.0)
    return orders(spark, folder).select(
        "o_orderkey",
        "o_orderdate",
        F.array(
            F.col("o_totalprice") * spike,
            F.lit(12.0),
            (F.col("o_custkey") % 9).cast("double"),
            (F.col("o_totalprice") / 7) * spike,
            F.lit(0.05),
            F.lit(4.0),
        ).alias("features"),
    )


def train_window(spark: SparkSession, folder: str) -> DataFrame:
    newest = Q.training_window(_order_features(spark, folder), "o_orderdate", "o_orderkey")
    return newest.select("o_orderkey", F.size("features").alias("width"))


def _scored(spark, folder):
    rows = _order_features(spark, folder)
    window = Q.training_window(rows, "o_orderdate", "o_orderkey")
    return I.score(rows, I.load(I.fit(window, "o_orderkey")))


def forest_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder)
    return scored.select("o_orderkey", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


def forest_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Size and depth of every tree of the fitted forest, and the rows its leaves hold."""
    nodes = I.fit(Q.training_window(_order_features(spark, folder), "o_orderdate", "o_orderkey"), "o_orderkey")
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.sum(F.when(leaf, F.col("rows"))).alias("leaf_rows"),
        F.floor(F.log2(F.max("node"))).alias("depth"),
        F.round(F.sum("threshold"), 4).alias("thresholds"),
    )


def anomaly_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert messages, read back from their JSON."""
    told = I.anomaly_messages(_scored(spark, folder), F.col("o_orderkey").cast("string"), F.col("o_orderdate"))
    doc = J.parse_json(F.col("value"))
    return told.select(
        "topic",
        J.as_string(J.member(doc, "order_id")).alias("order_id"),
        J.as_string(J.member(doc, "event_type")).alias("event_type"),
        J.as_string(J.member(doc, "monitor_name")).alias("monitor_name"),
        F.length(J.as_string(J.member(doc, "report_id"))).alias("report_id_chars"),
        F.try_variant_get(doc, "$.features.order_total", "double").alias("order_total"),
        F.try_variant_get(doc, "$.features.item_count", "double").alias("item_count"),
        F.round(F.try_variant_get(doc, "$.anomaly_score", "double"), 6).alias("anomaly_score"),
    )


def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder)
    log = ev.select(
        "ts",
        F.col("event_id").alias("row_key"),
        F.col("value").alias("order_total"),
        (F.lit(20.0) - F.col("value")).alias("anomaly_score"),
        F.when(F.col("event_type") != "view", F.col("value") > 20).alias("is_anomaly"),
    )
    s = V.score_statistics(log, "ts")
    return s.select(
        "processed_records",
        "anomaly_records",
        F.date_format("last_scored_at", "yyyy-MM-dd HH:mm:ss").alias("last_scored_at"),
        F.col("latest.order_total").alias("order_total"),
        F.col("latest.anomaly_score").alias("anomaly_score"),
        F.col("latest.is_anomaly").alias("is_anomaly"),
    )


def _messages(spark, folder):
    ev = events(spark, folder)
    topic = F.when(F.col("event_type") == "click", "raw-data").when(F.col("event_type") == "view", "validated-data").when(
        F.col("event_type") == "error", "anomaly-alerts"
    ).when(F.col("event_type") == "signup", "schema-events").otherwise("elsewhere")
    healed = F.when(F.col("value") > 15, F.lit('{"_schema_healer": {"success": true}}')).otherwise(F.col("props"))
    return ev.select(
        topic.alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        healed.alias("value"),
    )


def last_n_per_topic(spark: SparkSession, folder: str) -> DataFrame:
    return V.last_per_topic(_messages(spark, folder), 25).select("topic", F.col("offset").alias("event_id"), "rank")


def topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = V.topic_counts(_messages(spark, folder))
    return counted.select("topic", "events", F.date_format("last_event_at", "yyyy-MM-dd HH:mm:ss").alias("last_event_at"))


def card_routing(spark: SparkSession, folder: str) -> DataFrame:
    return V.cards(_messages(spark, folder)).select("id", "card")


def recent_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The newest log rows of one monitor."""
    log = events(spark, folder).select("event_id", "ts", F.col("event_type").alias("monitor_name"), "value")
    return V.recent(log, ["ts", "event_id"], 10, F.col("monitor_name") == "error").select("event_id", "monitor_name", "value")


def _diagnosis(spark, folder):
    ev = events(spark, folder)
    requests = ev.where(F.col("event_type") == "error").select(
        F.when(F.col("value") > 1, F.concat(F.lit("m"), F.col("user_id"))).alias("monitor_name"),
        F.concat(F.lit("r"), F.col("event_id") * 2).alias("report_id"),
        F.when(F.col("value") > 30, F.lit(None)).when(
            F.col("value") > 10,
            F.concat(F.lit('{"event_type":"anomaly_detected","order_id":"'), F.col("event_id"), F.lit('","source_topic":"anomaly-alerts"}')),
        ).otherwise(F.col("props")).alias("incident"),
        "event_id",
    )
    reports = ev.where(F.col("event_type") != "view").select(
        F.concat(F.lit("r"), F.col("event_id")).alias("report_id"),
        (F.col("value") > 5).alias("dataset_drift_detected"),
        F.col("user_id").alias("drift_share"),
        *[F.lit(n).alias(n) for n in ("reference_start", "reference_end", "current_start", "current_end")],
        F.repeat("props", 300).alias("column_results"),
    )
    history = ev.where(F.col("event_type") != "error").select(
        F.concat(F.lit("m"), F.col("user_id")).alias("monitor_name"),
        F.col("ts").alias("created_at"),
        "event_id",
        "event_type",
        F.lit("CLOSED").alias("from_state"),
        F.when(F.col("value") > 10, "OPEN").otherwise("CLOSED").alias("to_state"),
    )
    return X.with_context(requests, reports, history)


def context_join(spark: SparkSession, folder: str) -> DataFrame:
    d = _diagnosis(spark, folder)
    return d.select(
        "event_id",
        "monitor_name",
        F.coalesce(F.col("drift_report.drift_share"), F.lit(-1)).alias("drift_share"),
        F.size(F.coalesce("breaker_history", F.array())).alias("history"),
        F.coalesce(F.col("breaker_history")[0]["event_type"], F.lit("-")).alias("newest"),
    )


def context_text(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnosis(spark, folder).select("event_id", X.summary().alias("context"))


def outcome_policy(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder)
    severity = F.when(F.col("event_type") == "click", "low").when(F.col("event_type") == "view", "medium").when(
        F.col("event_type") == "error", "high"
    ).otherwise("odd")
    results = ev.select("event_id", severity.alias("severity"), (F.col("user_id") % 4 / 4.0).alias("confidence"))
    return X.decide(results).select("event_id", "outcome_success", "outcome_reason")


def _catalog_messages(spark, folder):
    """Schema and lineage messages written from the place tables and the documents."""
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(
        F.lit('{"eventType":"'), F.when(F.col("n_nationkey") % 6 == 5, "START").otherwise("COMPLETE"),
        F.lit('","inputs":[{"name":" '), F.col("n_name"), F.lit(' "},{"name":7},{"name":""},{"name":"'), F.col("n_name"),
        F.lit('"}],"outputs":[{"name":"'), F.col("r_name"), F.lit('"}]}'),
    )
    suppliers = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    more = F.concat(
        F.lit('{"eventType":"COMPLETE","inputs":[{"name":"'), F.col("s_name"), F.lit('"}],"outputs":[{"name":"'), F.col("n_name"), F.lit('"}]}')
    )
    docs = table(spark, folder, "documents")
    told = (
        F.when(F.col("lang") == "de", F.lit("{oops"))
        .when(F.col("lang") == "fr", F.lit("[1, 2]"))
        .when(F.col("lang") == "es", F.concat(F.lit('{"dataset_name":"'), F.col("source"), F.lit('","schema":{}}')))
        .otherwise(F.concat(F.lit('{"dataset_name":"'), F.col("source"), F.lit('","schema":{"text":"string","n'), F.length("source"), F.lit('":"int"}}')))
    )
    topic, value = F.lit(K.LINEAGE_TOPIC).alias("topic"), "value"
    lineage = nation.select(topic, body.alias(value)).unionByName(suppliers.select(topic, more.alias(value)))
    empty = docs.select(topic, F.lit('{"eventType":"COMPLETE","inputs":[],"outputs":"x"}').alias(value))
    return lineage.unionByName(empty).unionByName(docs.select(F.lit(K.SCHEMA_TOPIC).alias("topic"), told.alias(value)))


def catalog_classify(spark: SparkSession, folder: str) -> DataFrame:
    c = K.classify(_catalog_messages(spark, folder))
    return c.groupBy("topic", "branch", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("messages"))


def lineage_sets(spark: SparkSession, folder: str) -> DataFrame:
    c = K.classify(_catalog_messages(spark, folder)).where(F.col("branch") == "lineage")
    sets = K.lineage_sets(K.neighbours(K.incidence(c)))
    return sets.select(
        "dataset_name",
        F.array_join("lineage_upstream", ",").alias("upstream"),
        F.array_join("lineage_downstream", ",").alias("downstream"),
    )


def catalog_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Schema messages as catalog entries with the lineage of known datasets."""
    c = K.classify(_catalog_messages(spark, folder))
    entries = c.where(F.col("branch") == "schema").groupBy("dataset_name", K.fingerprint_of(F.col("schema")).alias("schema_fingerprint")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    known = table(spark, folder, "region").select(F.col("r_name").alias("dataset_name"), F.lit("-").alias("schema_fingerprint"), F.lit(0).cast("long").alias("messages"))
    full = K.with_lineage(entries.unionByName(known), K.neighbours(K.incidence(c.where(F.col("branch") == "lineage"))))
    return full.select("dataset_name", "schema_fingerprint", "messages", F.size("lineage_upstream").alias("upstream"), F.size("lineage_downstream").alias("downstream"))


def _entries(docs, when):
    return docs.select(
        F.col("source").alias("dataset_name"),
        F.concat(F.lit("f"), F.col("lang")).alias("schema_fingerprint"),
        F.lit("{}").alias("schema_json"),
        F.when(F.col("n_chars") % 3 == 0, F.lit(None)).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).otherwise(
            F.lit(f"{K.PENDING_PREFIX} review)")
        ).alias("description"),
        F.when(F.col("n_chars") % 3 != 0, F.array(F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        (F.col("doc_id") + when).alias("updated_at"),
    )


def catalog_upsert(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    stored = K.latest_entries(_entries(docs.where("doc_id % 2 = 0"), 0), "updated_at")
    new = K.latest_entries(_entries(docs.where("doc_id % 2 = 1"), 100000).withColumn(
        "description", F.when(F.col("schema_fingerprint") != "fde", F.col("description"))), "updated_at")
    return K.upsert(new, stored).select(
        "dataset_name", "schema_fingerprint", "description", F.array_join("tags", ",").alias("tags"), "updated_at"
    )


def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    entries = docs.groupBy(F.concat_ws("/", "source", "lang").alias("dataset_name")).agg(F.max("doc_id").alias("updated_at"))
    return V.catalog_listing(entries)


def tag_lines(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    text = F.concat(F.lit("  "), F.col("text"), F.lit("\n\n"), F.when(F.col("turn") % 2 == 0, "Tags: ").otherwise(""), F.col("role"), F.lit(", b,, c "))
    description, tags = K.parse_answer(text)
    return talk.select("conv_id", "turn", description.alias("description"), F.array_join(tags, "|").alias("tags"))


def hedge_gate(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    said = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" But I'm Not Sure."))).when(
        F.col("turn") % 5 == 4, F.lit("")
    ).otherwise(F.col("text"))
    return talk.select("conv_id", "turn", A.is_confident(said).alias("confident"))


def _prompts_and_cache(spark, folder):
    v = table(spark, folder, "embeddings")
    cache = v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), "embedding")
    near = cache.select(
        (F.col("id") - 1).alias("near_id"),
        F.transform("embedding", lambda x, i: (x * 2 + (i % 7) * F.lit(0.004)).cast("float")).alias("near"),
    )
    prompts = v.where("vec_id % 5 = 0").join(near, (F.col("near_id") == F.col("vec_id")) & (F.col("vec_id") % 3 == 0), "left")
    return prompts.select(F.col("vec_id").alias("id"), F.coalesce("near", "embedding").alias("embedding")), cache


def cosine_top1(spark: SparkSession, folder: str) -> DataFrame:
    prompts, cache = _prompts_and_cache(spark, folder)
    return A.nearest(prompts, cache).select("prompt_id", "cache_id", F.round("similarity", 4).alias("similarity"))


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    prompts, cache = _prompts_and_cache(spark, folder)
    matches = A.nearest(prompts, cache)
    stored = cache.select("id", F.concat(F.lit("cached "), F.col("id")).alias("response_text"), F.lit("given").alias("model_used"))
    asked = prompts.select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit("It is unclear to me")).otherwise(F.lit("yes")).alias("cheap"),
        F.lit("certainly").alias("strong"),
    )
    return A.answer(asked, matches, stored)


def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    prompts, cache = _prompts_and_cache(spark, folder)
    stored = cache.select("id", (F.col("id") % 4).alias("hit_count"), F.lit(None).cast("long").alias("last_hit_at"))
    return A.cache_hits(stored, A.nearest(prompts, cache), F.col("prompt_id"))


_TOPIC = """CASE event_type WHEN 'click' THEN 'raw-data' WHEN 'view' THEN 'validated-data' WHEN 'error' THEN 'anomaly-alerts'
  WHEN 'signup' THEN 'schema-events' ELSE 'elsewhere' END"""
_CONTEXT = """
WITH req AS (SELECT *, 'm' || user_id AS m, 'r' || (event_id * 2) AS rid FROM events WHERE event_type = 'error' AND value > 1),
rep AS (SELECT 'r' || event_id AS rid, value > 5 AS dd, user_id AS share, props AS p FROM events WHERE event_type <> 'view'),
his AS (SELECT user_id, event_type AS et, value > 10 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events WHERE event_type <> 'error' QUALIFY rk <= 10),
h AS (SELECT user_id, count(*) AS n, max(CASE WHEN rk = 1 THEN et END) AS newest,
  string_agg(et || ' CLOSED > ' || CASE WHEN o THEN 'OPEN' ELSE 'CLOSED' END, ', ' ORDER BY rk) FILTER (rk <= 5) AS steps
  FROM his GROUP BY user_id)"""
_LINEAGE = """
WITH edge AS (SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5
  UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_NEAR = """
WITH cache AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 <> 0),
prompts AS (SELECT p.vec_id AS id, CASE WHEN p.vec_id % 3 = 0 AND n.vec_id IS NOT NULL
    THEN list_transform(range(1, len(n.embedding) + 1), lambda i: CAST(n.embedding[i] * 2 + ((i - 1) % 7) * 0.004::DOUBLE AS FLOAT)::DOUBLE)
    ELSE p.embedding::DOUBLE[] END AS e
  FROM embeddings p LEFT JOIN embeddings n ON n.vec_id = p.vec_id + 1 AND n.vec_id % 5 <> 0 WHERE p.vec_id % 5 = 0),
best AS (SELECT prompt_id, cache_id, sim FROM (
  SELECT p.id AS prompt_id, c.id AS cache_id, list_cosine_similarity(p.e, c.e) AS sim,
    row_number() OVER (PARTITION BY p.id ORDER BY list_cosine_similarity(p.e, c.e) DESC, c.id) AS rk
  FROM prompts p CROSS JOIN cache c) WHERE rk = 1 AND sim >= 0.94)"""
_ENTRY = """
e AS (SELECT source AS d, 'f' || lang AS f, doc_id AS i,
    CASE n_chars % 3 WHEN 0 THEN NULL WHEN 1 THEN 'about ' || doc_id ELSE '(description pending review)' END AS descr,
    CASE n_chars % 3 WHEN 0 THEN '' ELSE lang END AS tags, lang FROM documents),
o AS (SELECT d, f, arg_max(descr, i) FILTER (descr IS NOT NULL) AS descr, coalesce(arg_max(tags, i) FILTER (descr IS NOT NULL), '') AS tags,
    max(i) AS u FROM e WHERE i % 2 = 0 GROUP BY 1, 2),
n AS (SELECT d, f, arg_max(descr, i) FILTER (descr IS NOT NULL) AS descr, coalesce(arg_max(tags, i) FILTER (descr IS NOT NULL), '') AS tags,
    max(i) + 100000 AS u FROM (SELECT * REPLACE (CASE WHEN lang <> 'de' THEN descr END AS descr) FROM e) WHERE i % 2 = 1 GROUP BY 1, 2)"""

def _forest_sql() -> str:
    """The forest grown level by level, and every order walked down all its trees."""
    draw = lambda what: f"CAST('0x' || substr(md5('{I.SEED}|' || tree || '|' || node || '|{what}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    ends = lambda agg: ", ".join(f"{agg}(f[{i}])" for i in range(1, 7))
    levels = max(1, math.ceil(math.log2(I.SAMPLE)))
    parts = [
        f"""WITH feats AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 97 = 0 THEN 40.0::DOUBLE ELSE 1.0::DOUBLE END AS spike,
  [o_totalprice * spike, 12.0::DOUBLE, (o_custkey % 9)::DOUBLE, (o_totalprice / 7) * spike, 0.05::DOUBLE, 4.0::DOUBLE] AS f FROM orders),
win AS (SELECT * FROM feats ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {I.WINDOW}),
p0 AS (SELECT tree, 1 AS node, f FROM (SELECT t AS tree, f,
    row_number() OVER (PARTITION BY t ORDER BY md5('{I.SEED}|' || t || '|' || o_orderkey), o_orderkey::VARCHAR) AS rk
  FROM win, range({I.TREES}) r(t)) WHERE rk <= {I.SAMPLE})"""
    ]
    for k in range(levels + 1):
        may = "n > 1 AND len(varied) > 0" if k < levels else "false"
        parts.append(f"""d{k} AS (SELECT tree, node, n, feat, lo[feat] + ({draw('threshold')}) * (hi[feat] - lo[feat]) AS bound
  FROM (SELECT *, CASE WHEN {may} THEN varied[1 + CAST(floor(({draw('feature')}) * len(varied)) AS INTEGER)] END AS feat
    FROM (SELECT *, list_filter([1, 2, 3, 4, 5, 6], lambda i: hi[i] > lo[i]) AS varied
      FROM (SELECT tree, node, count(*) AS n, [{ends('min')}] AS lo, [{ends('max')}] AS hi FROM p{k} GROUP BY tree, node))))""")
        parts.append(f"""p{k + 1} AS (SELECT tree, 2 * node + CASE WHEN f[feat] > bound THEN 1 ELSE 0 END AS node, f
  FROM p{k} JOIN d{k} USING (tree, node) WHERE feat IS NOT NULL)""")
    parts.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(levels + 1)) + ")")
    parts.append(f"w0 AS (SELECT o_orderkey, t AS tree, 1 AS node, f FROM feats, range({I.TREES}) r(t))")
    for k in range(levels):
        parts.append(f"""w{k + 1} AS (SELECT o_orderkey, tree, CASE WHEN feat IS NULL THEN node WHEN f[feat] > bound THEN 2 * node + 1 ELSE 2 * node END AS node, f
  FROM w{k} JOIN nodes USING (tree, node))""")
    path = lambda n: f"CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    parts.append(f"""scored AS (SELECT o_orderkey, 0.5::DOUBLE - pow(2.0::DOUBLE, -avg(floor(log2(node)) + {path('n')})
    / (SELECT {path('n')} FROM d0 WHERE tree = 0)) AS score FROM w{levels} JOIN nodes USING (tree, node) GROUP BY o_orderkey)""")
    return ",\n".join(parts)


_FOREST = _forest_sql()

QUERIES = {
    f.__name__: f
    for f in (
        feature_projection, train_window, forest_score, forest_shape, anomaly_alerts, score_stats, last_n_per_topic, topic_counts,
        card_routing, recent_reports, context_join, context_text, outcome_policy, catalog_classify, lineage_sets,
        catalog_entries, catalog_upsert, catalog_listing, tag_lines, hedge_gate, cosine_top1, cached_answers, cache_hits,
    )
}

ORACLE = {
    "feature_projection": f"""WITH {O.FEED_SQL}
SELECT o_orderkey, order_total, written_hour::DOUBLE AS hour_of_day,
  CASE WHEN bend = {O.TRUE_COUNT} THEN 1.0 ELSE coalesce(item_count, 0) END::DOUBLE AS item_count,
  coalesce(unit_price, 0) AS unit_price, coalesce(discount_pct, 0) AS discount_pct, coalesce(shipping_cost, 0) AS shipping_cost
FROM feed WHERE bend NOT IN ({O.RENAMED}, {O.CUT_OFF}, {O.ARRAY})""",
    "train_window": "SELECT o_orderkey, 6 AS width FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000",
    "forest_score": _FOREST + " SELECT o_orderkey, round(score, 6) AS anomaly_score, score < 0 AS is_anomaly FROM scored",
    "forest_shape": _FOREST
    + """ SELECT tree::INTEGER AS tree, count(*) AS nodes, count(*) FILTER (feat IS NULL) AS leaves,
  (sum(n) FILTER (feat IS NULL))::BIGINT AS leaf_rows, floor(log2(max(node)))::BIGINT AS depth,
  round(coalesce(sum(bound), 0), 4) AS thresholds FROM nodes GROUP BY tree""",
    "anomaly_alerts": _FOREST
    + """ SELECT 'anomaly-alerts' AS topic, o_orderkey::VARCHAR AS order_id, 'anomaly_detected' AS event_type,
  'isolation_forest_anomaly' AS monitor_name, 36 AS report_id_chars, f[1] AS order_total, f[3] AS item_count,
  round(score, 6) AS anomaly_score FROM scored JOIN feats USING (o_orderkey) WHERE score < 0""",
    "score_stats": """
WITH s AS (SELECT *, value > 20 AS a FROM events WHERE event_type <> 'view')
SELECT count(*) AS processed_records, count(*) FILTER (a) AS anomaly_records,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_scored_at, arg_max(value, ts) AS order_total,
  arg_max(20.0::DOUBLE - value, ts) AS anomaly_score, arg_max(a, ts) AS is_anomaly FROM s""",
    "last_n_per_topic": f"""
SELECT topic, event_id, rank FROM (SELECT {_TOPIC} AS topic, event_id,
  row_number() OVER (PARTITION BY {_TOPIC} ORDER BY ts DESC, user_id % 3 DESC, event_id DESC) AS rank FROM events) WHERE rank <= 25""",
    "topic_counts": f"""
SELECT {_TOPIC} AS topic, count(*) AS events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event_at FROM events GROUP BY 1""",
    "card_routing": f"""
SELECT {_TOPIC} || ':' || (user_id % 3) || ':' || event_id AS id, CASE event_type WHEN 'click' THEN 'kafka'
  WHEN 'view' THEN CASE WHEN value > 15 THEN 'schema' ELSE 'sidecar' END WHEN 'error' THEN 'isoforest'
  WHEN 'signup' THEN 'catalog' ELSE 'kafka' END AS card FROM events""",
    "recent_reports": """
SELECT event_id, event_type AS monitor_name, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10""",
    "context_join": _CONTEXT
    + """ SELECT req.event_id, m AS monitor_name, coalesce(share, -1) AS drift_share, coalesce(n, 0) AS history,
  coalesce(newest, '-') AS newest FROM req LEFT JOIN rep ON rep.rid = req.rid LEFT JOIN h ON h.user_id = req.user_id""",
    "context_text": _CONTEXT
    + r""" SELECT event_id, concat_ws(chr(10), 'monitor = ' || m, 'report = ' || req.rid, 'newest transitions = ' || steps,
  CASE WHEN value > 30 THEN NULL WHEN value > 10 THEN 'incident from = anomaly-alerts' ELSE 'incident from = ?' END,
  CASE WHEN value > 10 AND value <= 30 THEN 'odd order = ' || event_id END,
  CASE WHEN value <= 10 THEN 'incident = ' || props END,
  CASE WHEN rep.rid IS NULL THEN 'drift report = none stored'
  ELSE concat_ws(chr(10), 'drift = ' || dd, 'share of drifted columns = ' || share,
    'old window = reference_start to reference_end', 'new window = current_start to current_end',
    'columns = ' || left(repeat(p, 300), 2000)) END) AS context
FROM req LEFT JOIN rep ON rep.rid = req.rid LEFT JOIN h ON h.user_id = req.user_id""",
    "outcome_policy": """
SELECT event_id, c >= 0.5 AND s IN ('low', 'medium') AS outcome_success,
  CASE WHEN c < 0.5 THEN 'confidence ' || printf('%.2f', c) || ' below 0.5: treated as high'
    WHEN s IN ('low', 'medium') THEN 'severity=''' || s || ''' resets automatically, confidence=' || printf('%.2f', c)
    ELSE 'severity=''' || s || ''' requires human review' END AS outcome_reason
FROM (SELECT event_id, (user_id % 4) / 4.0::DOUBLE AS c,
  CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'high' ELSE 'odd' END AS s FROM events)""",
    "catalog_classify": """
SELECT topic, branch, reason, count(*) AS messages FROM (
  SELECT 'openlineage-events' AS topic, CASE WHEN n_nationkey % 6 = 5 THEN 'ignore' ELSE 'lineage' END AS branch, '-' AS reason FROM nation
  UNION ALL SELECT 'openlineage-events', 'lineage', '-' FROM supplier
  UNION ALL SELECT 'openlineage-events', 'dead_letter', 'lineage names no dataset'
    FROM documents
  UNION ALL SELECT 'schema-events', CASE lang WHEN 'en' THEN 'schema' ELSE 'dead_letter' END,
    CASE lang WHEN 'en' THEN '-' WHEN 'de' THEN 'not JSON' WHEN 'fr' THEN 'schema message is no object'
      ELSE 'schema message lists no columns' END FROM documents) GROUP BY 1, 2, 3""",
    "lineage_sets": _LINEAGE
    + """ SELECT d AS dataset_name, coalesce(string_agg(DISTINCT up, ',' ORDER BY up), '') AS upstream,
  coalesce(string_agg(DISTINCT down, ',' ORDER BY down), '') AS downstream
FROM (SELECT t AS d, s AS up, NULL AS down FROM edge UNION ALL SELECT s, NULL, t FROM edge) GROUP BY d""",
    "catalog_entries": _LINEAGE
    + """ SELECT d AS dataset_name, f AS schema_fingerprint, n AS messages,
  (SELECT count(DISTINCT s) FROM edge WHERE t = d)::INTEGER AS upstream, (SELECT count(DISTINCT t) FROM edge WHERE s = d)::INTEGER AS downstream
FROM (SELECT source AS d, substr(sha256('{"n' || length(source) || '": "int", "text": "string"}'), 1, 16) AS f, count(*) AS n
  FROM documents WHERE lang = 'en' GROUP BY 1, 2 UNION ALL SELECT r_name, '-', 0 FROM region)""",
    "catalog_upsert": "WITH " + _ENTRY.strip()
    + """ SELECT coalesce(n.d, o.d) AS dataset_name, coalesce(n.f, o.f) AS schema_fingerprint,
  CASE WHEN n.descr IS NOT NULL THEN n.descr WHEN n.u IS NOT NULL AND o.descr LIKE '(description pending%' THEN NULL ELSE o.descr END AS description,
  CASE WHEN n.descr IS NOT NULL THEN n.tags WHEN n.u IS NOT NULL AND o.descr LIKE '(description pending%' THEN '' ELSE coalesce(o.tags, n.tags) END AS tags,
  coalesce(n.u, o.u) AS updated_at FROM n FULL JOIN o ON n.d = o.d AND n.f = o.f""",
    "catalog_listing": """
SELECT source || '/' || lang AS dataset_name, max(doc_id) AS updated_at FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 100""",
    "tag_lines": """
WITH said AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Tags: ' ELSE '' END || role || ', b,, c' AS written, role,
  [trim(x) FOR x IN regexp_split_to_array(text, '\r\n|\r|\n') IF trim(x) <> ''] AS lines FROM conversations)
SELECT conv_id, turn, CASE WHEN len(lines) > 0 THEN lines[1] ELSE written END AS description,
  CASE WHEN len(lines) > 0 THEN role || '|b|c' ELSE '' END AS tags FROM said""",
    "hedge_gate": """
SELECT conv_id, turn, turn % 3 <> 1 AND turn % 5 <> 4 AND length(text) > 0 AND
  NOT regexp_matches(lower(text), 'i''m not sure|i am not sure|unclear|cannot determine|insufficient information') AS confident
FROM conversations""",
    "cosine_top1": _NEAR + " SELECT prompt_id, cache_id, round(sim, 4) AS similarity FROM best",
    "cached_answers": _NEAR
    + """ SELECT id AS prompt_id, CASE WHEN cache_id IS NOT NULL THEN 'cached ' || cache_id WHEN id % 2 = 0 THEN 'certainly' ELSE 'yes' END AS response,
  CASE WHEN cache_id IS NOT NULL THEN 'given' WHEN id % 2 = 0 THEN 'strong' ELSE 'cheap' END AS model_used,
  cache_id IS NOT NULL AS cache_hit FROM prompts LEFT JOIN best ON prompt_id = id""",
    "cache_hits": _NEAR
    + """ SELECT id, id % 4 + count(prompt_id) AS hit_count, max(prompt_id) AS last_hit_at
FROM cache LEFT JOIN best ON cache_id = id GROUP BY id""",
}
