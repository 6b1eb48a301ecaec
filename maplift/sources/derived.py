"""Inputs derived from the driver tables (FIXTURES.md part 3).

Every derivation is a narrow projection of a driver table, so the work of
each query grows with that table.  NULLs and quirks are injected with key
arithmetic; no rows are dropped except where a fixture defines a "before"
state of a target table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.sources.tables import read_table


def _s(c: Column) -> Column:
    return c.cast("string")


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(_s(c), n, "0")


# ---------------------------------------------------------------------------
# 3.1 patients (from customer)
# ---------------------------------------------------------------------------
def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    created = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), k.cast("int"), F.lit(0))
    return read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P-"), _lpad(k, 9)).alias("patient_id"),
        F.when(k % 13 == 0, None).otherwise(F.concat(F.lit("First"), _s(k % 100))).alias("first_name"),
        F.when(k % 17 == 0, None).otherwise(F.concat(F.lit("Last"), _s(k % 90))).alias("last_name"),
        F.when(k % 10 == 3, None).otherwise(
            F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Mail.com "))).alias("cust_email_01"),
        F.when(k % 11 == 0, None).otherwise(F.concat(
            F.lit("19"), _s(F.lit(50) + k % 50), F.lit("-"), _lpad(F.lit(1) + k % 12, 2),
            F.lit("-"), _lpad(F.lit(1) + k % 28, 2))).alias("dob"),
        F.when(k % 9 == 0, None).otherwise(
            (k % 100).cast("double") + (k % 4).cast("double") / 2).alias("weight_kg"),
        F.when(k % 19 == 0, None).otherwise(_lpad(k % 4 + 1, 2)).alias("site_code"),
        F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").alias("enrolled_flag"),
        created.alias("created_at"),
        F.when(k % 7 == 0, "INACTIVE").otherwise("ACTIVE").alias("record_status"),
        (F.lit(150.0) + (k % 400).cast("double") / 10).alias("height_cm"),
        F.when(k % 23 == 0, "abc").otherwise(_s(k % 100)).alias("risk_score"),
        F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("PR"), _s(k % 40))).alias("primary_provider_id"),
        F.when(k % 4 == 0, "  joHN   smITH ").when(k % 4 == 1, "   ")
         .when(k % 4 == 3, "a  b").alias("raw_note"),
        (created - F.make_dt_interval(F.lit(0), (k % 72).cast("int"), F.lit(0), F.lit(0))).alias("admitted_at"),
        F.col("c_nationkey").alias("nation_key"),
    )


def nation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 lookup: code -> name, without nations where key % 5 = 0."""
    return (read_table(spark, sf_dir, "nation")
            .where(F.col("n_nationkey") % 5 != 0)
            .select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")))


# ---------------------------------------------------------------------------
# 3.2 mapping_rows (from part).  A sheet is a bounded upload, so the number of
# sheets grows with the table and the rows of a sheet do not.  Driver part keys are dense
# from 0, so the sheet row number `row_number() over (sheet order by key) + 1`
# is the closed form `key % 40 + 2` -- no window, no shuffle.
# ---------------------------------------------------------------------------
ROWS_PER_SHEET = 40


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.col("p_size")
    sheet = F.floor(k / ROWS_PER_SHEET).cast("bigint")
    status = (F.when(k % 7 == 0, "In Progress").when(k % 7 == 1, "")
              .when(k % 7 == 2, " approved").when(k % 7 == 3, "VALID").otherwise("Validated"))
    return read_table(spark, sf_dir, "part").select(
        sheet.alias("sheet_id"),
        (k % ROWS_PER_SHEET + 2).cast("bigint").alias("row_no"),
        F.concat(F.lit("raw.src_"), _s(sheet)).alias("source_table"),
        F.concat(F.lit("s"), _s(size)).alias("source_field"),
        F.lit("").alias("source_type"),
        F.when(k % 3 == 0, "YES").when(k % 3 == 1, "NO").otherwise("").alias("nullable"),
        F.concat(F.lit("x"), _s(k)).alias("sample_data"),
        F.lit("").alias("transformation_rule"),
        F.when(k % 5 == 0, "LOWER(x)").otherwise("").alias("sql_logic"),
        F.when(k % 11 == 0, "site_lookup").otherwise("").alias("lookup_table"),
        F.when(k % 4 == 0, "Unknown").otherwise("").alias("default_value"),
        F.concat(F.lit("analytics.tgt_"), _s(sheet)).alias("target_table"),
        F.concat(F.lit("t"), _s(size * 3 % 41)).alias("target_field"),
        F.lit("").alias("target_type"),
        status.alias("mapping_status"),
    )


# ---------------------------------------------------------------------------
# 3.3 schema_columns, generated per sheet of mapping_rows
# ---------------------------------------------------------------------------
SOURCE_TYPES = ["VARCHAR", "FLOAT", "TIMESTAMP", "INTEGER", "NUMERIC(10,2)", "INT64"]
TARGET_TYPES = ["VARCHAR", "INTEGER", "DATE", "BOOLEAN", "DOUBLE"]
N_SOURCE_COLS = 45
N_TARGET_COLS = 36


def _pick(arr: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (i % len(arr) + 1).cast("int"))


def schema_columns(spark: SparkSession, sf_dir: str, sheets: DataFrame | None = None) -> DataFrame:
    """Declared schemas of every sheet of `sheets` (default: mapping_rows).
    The distinct sheet ids are a partial aggregate (a few rows per task)."""
    if sheets is None:
        sheets = mapping_rows(spark, sf_dir)
    ids = sheets.select("sheet_id").distinct()
    i = F.col("i")
    sides = F.concat(F.transform(F.sequence(F.lit(1), F.lit(N_SOURCE_COLS)), lambda x: F.struct(F.lit("source").alias("side"), x.alias("i"))),
                     F.transform(F.sequence(F.lit(0), F.lit(N_TARGET_COLS - 1)), lambda x: F.struct(F.lit("target").alias("side"), x.alias("i"))))
    is_src = F.col("side") == "source"

    def by_side(src: Column, tgt: Column) -> Column:
        return F.when(is_src, src).otherwise(tgt)
    cols = ids.select("sheet_id", F.explode(sides).alias("c")).select("sheet_id", "c.side", "c.i")
    return cols.select(
        "sheet_id", "side",
        F.concat(by_side(F.lit("raw.src_"), F.lit("analytics.tgt_")), _s(F.col("sheet_id"))).alias("table_name"),
        by_side(i, i + 1).cast("int").alias("ordinal"),
        F.concat(by_side(F.lit("s"), F.lit("t")), _s(i)).alias("column_name"),
        by_side(_pick(SOURCE_TYPES, i), _pick(TARGET_TYPES, i)).alias("type"),
        by_side(i % 2 == 1, i % 4 != 0).alias("nullable"),
        F.concat(by_side(F.lit("source column "), F.lit("target column ")), _s(i)).alias("description"))


def live_source_columns(schema_cols: DataFrame) -> DataFrame:
    """D6 live catalog: the declared source minus columns s<i> with i % 15 = 0."""
    return (schema_cols.where((F.col("side") == "source") & (F.col("ordinal") % 15 != 0))
            .select("sheet_id", "table_name", "ordinal", "column_name",
                    F.upper("type").alias("type"), "nullable"))


# The kinds of feed entries.
FEED_KINDS = ["thought", "tool_call", "tool_result", "tool_error"]


# ---------------------------------------------------------------------------
# 3.4 runs (from orders)
# ---------------------------------------------------------------------------
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs derived from orders."""
    k = F.col("o_orderkey")
    status = (F.when(k % 10 == 0, "running").when(k % 10 == 1, "awaiting_review")
              .when(k % 10 == 2, "rejected").when(k % 10 <= 4, "failed").otherwise("succeeded"))
    st = F.col("status")
    files = F.when(k % 2 == 0, F.array(*[F.lit(x) for x in
                   ["source_schema.md", "target_schema.md", "sttm.csv", "repo_structure.md", "udf_definitions.md"]])
                   ).otherwise(F.array(*[F.lit(x) for x in
                               ["source_schema.md", "target_schema.md", "sttm.csv", "repo_structure.md"]]))
    orders = read_table(spark, sf_dir, "orders")
    base = orders.select(k, "o_custkey", "o_orderdate", "o_totalprice", status.alias("status"))
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    feed = F.array(*[F.struct(F.lit(f"f{i}").alias("id"), (started + 1000 * i).alias("ts"), F.lit(FEED_KINDS[i]).alias("kind"),
                              F.concat(F.lit(f'step {i} of "'), _s(k), F.lit('"')).alias("text")) for i in range(3)])
    findings = F.array(*[F.struct(F.lit(f"v{i}").alias("id"), F.lit(sev).alias("severity"), _s(k % 40 + i).alias("rows"),
                                  F.lit(f"finding {i}").alias("message")) for i, sev in enumerate(["info", "warning"])])
    return base.select(
        F.concat(F.lit("run_"), _s(k)).alias("run_id"),
        F.concat(F.lit("analytics.t"), _s(F.col("o_custkey") % 100)).alias("target_table"),
        st,
        F.when(st == "succeeded", 7).when(st.isin("awaiting_review", "rejected"), 4)
         .otherwise(k % 8).cast("int").alias("current_step"),
        (st == "failed").alias("step_failed"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.when(st.isin("running", "awaiting_review"), None).otherwise(k % 1300).cast("bigint").alias("duration_sec"),
        F.when(k % 6 == 0, k % 3 + 1).cast("int").alias("attempt_current"),
        F.when(k % 6 == 0, 3).cast("int").alias("attempt_max"),
        F.when(st == "succeeded", F.floor("o_totalprice")).cast("bigint").alias("audit_rows_written"),
        F.when(st == "succeeded", F.lit(True)).alias("audit_counts_match"),
        F.when(st == "succeeded", k % 9 != 0).alias("audit_nulls_check"),
        F.when((st == "succeeded") & (k % 9 == 0),
               F.lit('nulls found in required column "_loaded_at"')).alias("audit_failed_check"),
        F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("user"), _s(F.col("o_custkey") % 10))).alias("created_by"),
        F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("approver"), _s(k % 5))).alias("approved_by"),
        F.when(k % 2 == 0, None).otherwise(F.concat(F.lit("wf_"), _s(k))).alias("workflow_id"),
        (k % 40).cast("int").alias("mappings_validated"),
        (k % 3).cast("int").alias("mappings_excluded"),
        ((k % 1000).cast("double") / 100).alias("cost_gb"),
        F.lit(0.0).alias("cost_usd"),
        files.alias("file_names"),
        (k % 3 + 1).cast("int").alias("llm_attempts"),
        (k % 5000).alias("llm_prompt_tokens"),
        (k % 900).alias("llm_completion_tokens"),
        ((k % 100).cast("double") / 100).alias("llm_cost_usd"),
        F.when(k % 5 != 0, F.slice(feed, F.lit(1), (k % 4).cast("int"))).alias("feed"),
        F.when(k % 5 != 0, F.slice(findings, F.lit(1), (k % 3).cast("int"))).alias("findings"),
        F.when(k % 4 != 0, F.concat(F.lit("SELECT\n  "), _s(k), F.lit(' AS "id"\n'))).alias("sqlx_code"),
        F.when(k % 4 != 0, F.concat(F.lit("definitions/marts/t"), _s(F.col("o_custkey") % 100), F.lit(".sqlx"))).alias("sqlx_path"),
    )


# ---------------------------------------------------------------------------
# 3.5 run_feed and attempts (from events)
# ---------------------------------------------------------------------------

def run_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        e.alias("seq"),
        F.col("ts"),
        _pick(FEED_KINDS, e).alias("kind"),
        F.col("event_type").alias("text"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generation attempt; `attempt` is numbered later."""
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id"),
        F.to_date("ts").alias("day"),
        e.alias("seq"),
        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.lit("")).alias("error"),
        (e % 5000).alias("prompt_units"),
        (e % 900).alias("completion_units"),
    )


def run_state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 input: (run_id, field, value, seq) writes to run records."""
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), _s(F.col("user_id"))).alias("run_id"),
        F.col("event_type").alias("field"),
        F.col("value"),
        F.col("event_id").alias("seq"),
    )


# ---------------------------------------------------------------------------
# 3.6 loads
# ---------------------------------------------------------------------------
def scd1_target_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") % 10 != 0).withColumn("version", F.lit(0).cast("bigint"))


def scd1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    new = (c.where(F.col("c_custkey") % 3 == 0)
           .withColumn("c_acctbal", F.col("c_acctbal") + 1000)
           .withColumn("version", F.lit(2).cast("bigint")))
    old = (c.where(F.col("c_custkey") % 6 == 0)
           .withColumn("c_acctbal", F.col("c_acctbal") + 500)
           .withColumn("version", F.lit(1).cast("bigint")))
    return new.unionByName(old)


LATE_CUTOFF = "2024-01-20 00:00:00"


def fact_target_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.where((F.col("ts") < F.lit(LATE_CUTOFF).cast("timestamp_ntz")) & (F.col("event_id") % 50 != 0))


def audit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return (o.where(k % 500 != 0)
            .withColumn("o_orderpriority", F.when(k % 97 == 0, None).otherwise(F.col("o_orderpriority"))))


AUDIT_REQUIRED = ["o_orderkey", "o_orderpriority", "o_orderstatus"]


# ---------------------------------------------------------------------------
# 3.7 text inputs
# ---------------------------------------------------------------------------
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = _s(F.col("p_size"))
    config = F.concat(
        F.lit('config {\n  type: "table",\n  schema: "analytics",\n  tags: ["daily"],\n'
              '  assertions: { nonNull: ["id"], rowConditions: { ok: ["id > 0"] } },\n  labels: '),
        # nested 1 to 12 levels deep, with a word that starts a query inside
        F.expr("repeat('{ a: ', cast(p_partkey % 12 + 1 as int))"), F.lit("'select'"),
        F.expr("repeat(' }', cast(p_partkey % 12 + 1 as int))"), F.lit("\n}\n"))
    js = F.lit("js { const src = 'x'; }\n")
    second = F.when(k % 3 == 0, F.concat(
        F.lit('\nJOIN ${ ref("staging.dim_'), _s(k % 7), F.lit('") } d ON d.id = p.id')))
    body = F.concat(
        F.lit("SELECT\n  p.id AS \"id\",\n  '"), F.col("p_brand"), F.lit("' AS brand\nFROM ${ref(\"t"), size,
        F.lit("\")} p"), F.coalesce(second, F.lit("")), F.lit(";\n"))
    # shapes the text rule handles badly (flagged by L1): a comment naming
    # select, a WITH clause, post operations after the query
    comment = F.when(k % 13 == 0, F.lit("-- select the rows of t\n")).otherwise(F.lit(""))
    cte = F.when(k % 17 == 0, F.lit("WITH src AS (SELECT 1 AS id)\n")).otherwise(F.lit(""))
    post = F.when(k % 19 == 0, F.lit("post_operations {\n  GRANT SELECT ON ${self()} TO reader\n}\n")
                  ).otherwise(F.lit(""))
    text = F.when(k % 40 == 0, F.concat(config, F.lit("-- nothing generated\n"))).otherwise(
        F.concat(config, js, comment, cte, body, post))
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("models/m"), _s(k)).alias("path"), text.alias("text"))


def fenced_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    wrapped = F.concat(F.lit("Here is the model:\n```sqlx\n"), F.col("text"), F.lit("\n```\nDone."))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, wrapped)
                    .otherwise(F.col("text")).alias("text"))


# Conventions documents for B22 (fixed text; picked by order key % 3).
CONVENTIONS_DOCS = [
    "# Repo\n- definitions/staging/ — raw source models\n- definitions/marts/ — final tables\n",
    "# Repo\nModels go under definitions/marts/finance/ by domain.\n",
    "# Repo\nNo folder rules.\n",
]


def model_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("run_id", "target_table",
                                   F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint").alias("k"))
    doc = F.element_at(F.array(*[F.lit(d) for d in CONVENTIONS_DOCS]), (F.col("k") % 3 + 1).cast("int"))
    return r.select("run_id", "target_table", doc.alias("conventions"))
