"""Model-file text jobs (L1, L2, L3) over tables of texts.

All regex work runs in the JVM (`regexp_replace` / `regexp_extract[_all]`),
one row per file or message, whole texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.functions.text import PY_WS, py_strip  # noqa: F401  (PY_WS re-exported)
from maplift.model import DEFAULT_SOURCE_SCHEMA, MSG_NO_SELECT
from maplift.sources.tables import REF_PATTERN

# The texts that start a block, a reference, a query or a fenced block.
CONFIG_START = r"config\s*\{"
JS_BLOCK = r"js\s*\{[^}]*\}"
DOTTED_REF = r"""\$\{\s*ref\(\s*['"]([\w]*\.[\w.]*)['"]\s*\)\s*\}"""
BARE_REF = r"""\$\{\s*ref\(\s*['"](\w+)['"]\s*\)\s*\}"""
SELECT_TAIL = r"(?is)(\bselect\b.*)"
FENCED = r"(?s)```(?:sqlx|sql)?\s*\n(.*?)```"


def without_config_block(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Remove the first `config {...}` block of `text_col`, nested to any depth, when its
    braces balance; otherwise keep the text unchanged.

    The text is split once at the block's start; the rest is cut into runs that each end
    with a brace, and one fold over them counts the depth up to the closing brace.  Each step
    is a projection of its own, which Catalyst keeps apart because it is not cheap to recompute."""
    parts = df.withColumn("_cfg", F.split(F.col(text_col), CONFIG_START, 2))
    after = F.get(F.col("_cfg"), 1)  # NULL when the text has no block start
    runs = F.split(after, r"(?<=[{}])")  # linear, also over a long rest without braces
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, run: Column) -> Column:
        depth = s["depth"] + F.when(run.endswith("{"), 1).when(run.endswith("}"), -1).otherwise(0)
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), (s["end"] + F.length(run)).alias("end")))
    folded = parts.withColumn("_fold", F.aggregate(runs, state, step))
    rest = F.substring(after, F.col("_fold.end") + 1, F.length(after))
    cut = F.concat(F.get(F.col("_cfg"), 0), rest)
    return (folded.withColumn(out_col, py_strip(F.when(F.col("_fold.depth") == 0, cut).otherwise(F.col(text_col))))
            .drop("_cfg", "_fold"))


def resolve_refs(sql: Column, default_schema: str = DEFAULT_SOURCE_SCHEMA) -> Column:
    """`${ref("a.b")}` -> a.b ; `${ref("t")}` -> <default schema>.t"""
    return F.regexp_replace(F.regexp_replace(sql, DOTTED_REF, "$1"), BARE_REF, f"{default_schema}.$1")


def model_bodies(files: DataFrame) -> DataFrame:
    """L1: (path, body, error, flag): the runnable SELECT of each model file
    (the text from its first word `select` on), or an error.  `flag` names
    shapes this rule handles badly: a leading WITH clause (cut off), a
    `select` inside a comment (taken as the start), post operations (kept)."""
    t = without_config_block(files.select("path", "text"), "text", "_t0")
    t = t.select("path", F.regexp_replace(py_strip(resolve_refs(F.regexp_replace("_t0", JS_BLOCK, ""))), ";+$", "")
                 .alias("_t"))
    t = t.select("path", "_t", F.regexp_extract("_t", SELECT_TAIL, 1).alias("_body"))
    has_select = F.length("_body") > 0
    # the text before the first select, and its last line
    head = F.substring(F.col("_t"), F.lit(1), F.length("_t") - F.length("_body"))
    head_line = F.substring_index(head, "\n", -1)
    flag = F.when(has_select, F.concat_ws(
        ",",
        F.when(F.col("_t").rlike(r"(?is)^\s*with\b"), F.lit("with_clause")),
        F.when(head_line.contains("--"), F.lit("select_in_comment")),
        F.when(F.col("_body").rlike(r"post_operations\s*\{"), F.lit("post_operations"))))
    return t.select("path", F.when(has_select, F.col("_body")).alias("body"),
                    F.when(~has_select, F.lit(MSG_NO_SELECT)).alias("error"), flag.alias("flag"))


def model_ref_edges(files: DataFrame, default_schema: str = DEFAULT_SOURCE_SCHEMA) -> DataFrame:
    """L2: distinct (model path, referenced table) edges, schema-qualified."""
    refs = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(REF_PATTERN), 1)).alias("ref"))
    qualified = F.when(F.col("ref").contains("."), F.col("ref")).otherwise(
        F.concat(F.lit(default_schema + "."), F.col("ref")))
    return refs.select("path", qualified.alias("ref_table")).distinct()


def fenced_blocks(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """L3: the first ```/```sqlx/```sql fenced block of each text, else the
    whole text; stripped."""
    t = F.col(text_col)
    body = F.when(t.rlike(FENCED), F.regexp_extract(t, FENCED, 1)).otherwise(t)
    return messages.withColumn("body", py_strip(body)).drop(text_col)
