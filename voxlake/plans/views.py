"""The driver's tables as the domain's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "users_v": "SELECT c_custkey AS id, c_name AS display_name, (c_custkey % 256)::INT AS level, c_mktsegment AS plan, c_nationkey AS home FROM customer",
    "cards_v": "SELECT p_partkey AS id, p_name AS chinese, p_brand AS subject, p_type AS category, p_size AS \"week\", p_size % 3 AS class_num FROM part",
    "records_v": "SELECT event_id AS id, json_extract_string(props, '$.k')::INT AS card_id, user_id, floor(value)::INT AS score, event_type = 'signup' AS is_starred, ts AS created_at FROM events",
    "feedback_v": "SELECT json_extract_string(props, '$.k')::INT AS checkpoint_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS score, ts AS created_at FROM events",
    "results_v": "SELECT o_orderkey AS id, o_custkey AS voice_id, o_orderpriority AS input_text, o_orderdate AS created_at FROM orders",
    "folders_v": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS owner_id FROM nation",
    "members_v": "SELECT c_nationkey AS folder_id, c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'edit' ELSE 'admin' END AS permission FROM customer",
    "voices_v": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS shared_folder_id, CASE WHEN s_acctbal > 0 THEN 'shared' ELSE 'personal' END AS folder_type FROM supplier",
    "reviews_v": "SELECT o_orderkey AS id, o_orderkey % 200 AS voice_id, o_custkey AS requested_by, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'approved' END AS status, o_orderkey % 30 AS shared_folder_id FROM orders",
    "segments_v": "SELECT event_id, user_id AS speaker, epoch(ts) / 3600 AS start, epoch(ts) / 3600 + value / 100 AS \"end\", value AS energy FROM events",
    "series_v": "SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events",
    "lines_v": "SELECT doc_id AS page, source AS pdf, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)",
}


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front."""
    used = ",\n".join(f"{name} AS ({body})" for name, body in SQL.items() if name in sql)
    if not used:
        return sql
    return f"WITH {used}{', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else ' ' + sql}"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = lambda n: _t(spark, d, n)
    c = F.col
    hours = F.unix_micros(c("ts").cast("timestamp")) / 1e6 / 3600
    make = {
        "users_v": lambda: t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("display_name"), (c("c_custkey") % 256).cast("int").alias("level"), c("c_mktsegment").alias("plan"), c("c_nationkey").alias("home")),
        "cards_v": lambda: t("part").select(c("p_partkey").alias("id"), c("p_name").alias("chinese"), c("p_brand").alias("subject"), c("p_type").alias("category"), c("p_size").alias("week"), (c("p_size") % 3).alias("class_num")),
        "records_v": lambda: t("events").select(c("event_id").alias("id"), _k().alias("card_id"), "user_id", F.floor("value").cast("int").alias("score"), (c("event_type") == "signup").alias("is_starred"), c("ts").alias("created_at")),
        "feedback_v": lambda: t("events").select(_k().alias("checkpoint_id"), F.when(c("event_type") == "error", -1).otherwise(1).alias("score"), c("ts").alias("created_at")),
        "results_v": lambda: t("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("voice_id"), c("o_orderpriority").alias("input_text"), c("o_orderdate").alias("created_at")),
        "folders_v": lambda: t("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), c("n_regionkey").alias("owner_id")),
        "members_v": lambda: t("customer").select(c("c_nationkey").alias("folder_id"), c("c_custkey").alias("user_id"), F.when(c("c_custkey") % 3 == 0, "view").when(c("c_custkey") % 3 == 1, "edit").otherwise("admin").alias("permission")),
        "voices_v": lambda: t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_nationkey").alias("shared_folder_id"), F.when(c("s_acctbal") > 0, "shared").otherwise("personal").alias("folder_type")),
        "reviews_v": lambda: t("orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 200).alias("voice_id"), c("o_custkey").alias("requested_by"), F.when(c("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"), (c("o_orderkey") % 30).alias("shared_folder_id")),
        "segments_v": lambda: t("events").select("event_id", c("user_id").alias("speaker"), hours.alias("start"), (hours + c("value") / 100).alias("end"), c("value").alias("energy")),
        "series_v": lambda: t("events").select(c("user_id").alias("series_id"), (F.row_number().over(_window("user_id", "ts", "event_id")) - 1).cast("long").alias("idx"), "value"),
        "lines_v": lambda: t("documents").select(c("doc_id").alias("page"), c("source").alias("pdf"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")),
    }
    return make[name]() if name in make else t(name)


def _window(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)
