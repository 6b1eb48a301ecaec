"""Model files: texts with the bodies worked out by hand, and config blocks built to any depth."""
from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.sources.model_files import fenced_blocks, model_bodies

BODIES = [
    ("SELECT 1", "SELECT 1"),
    ("config { a: 1 } select a from ${ref(\"t\")};;", "select a from raw.t"),
    ("config {\n b: { c: [1] }\n}\n-- x\nSelect 2 ; ", "Select 2 "),
    ("config{x:{y:{z:{u:{v:{w:1}}}}}}SELECT 3", "SELECT 3"),
    ("config { a: 'select 9' }\nSELECT 4", "SELECT 4"),
    ("config { open SELECT 5", "SELECT 5"),
    ("config { a: { b } SELECT 6", "SELECT 6"),
    ("pre config { a } mid config { b } SELECT 7", "SELECT 7"),
    ("js { const a = 1; } SELECT ${ ref('s.u') }.x", "SELECT s.u.x"),
    ("WITH w AS (select 1) SELECT 8", "select 1) SELECT 8"),
    ("selection of nothing", None), ("", None), ("config { SELECT 1 }", None), ("} { SELECT 10", "SELECT 10"),
]
FENCES = [
    ("a\n```sql\nSELECT 9\n```\nb", "SELECT 9"), ("```\nx\n```", "x"), ("```sqlx\n one \n```\n```\ntwo\n```", "one"),
    ("  plain  ", "plain"), ("```sql open", "```sql open"), ("``` \n y\n\n```", "y"), ("```python\nz\n```", "```python\nz\n```"),
]


def test_bodies(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(BODIES)], "path string, text string")
    got = {r.path: (r.body, r.error) for r in model_bodies(df).collect()}
    for i, (text, want) in enumerate(BODIES):
        assert got[str(i)][0] == want, text
        assert (got[str(i)][1] is None) == (want is not None)


def test_fences(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(FENCES)], "path string, text string")
    got = {r.path: r.body for r in fenced_blocks(df).collect()}
    assert [got[str(i)] for i in range(len(FENCES))] == [w for _, w in FENCES]


NEST = st.recursive(st.sampled_from(["a: 1", "select", "'x'", ""]),
                    lambda inner: st.lists(inner, max_size=3).map(lambda xs: "k: {" + ", ".join(xs) + "}"), max_leaves=25)


@settings(max_examples=5, deadline=None)
@given(st.lists(NEST, min_size=1, max_size=20))
def test_balanced_blocks_of_any_depth_are_removed(spark, blocks):
    df = spark.createDataFrame([(str(i), "config {" + b + "}\nSELECT " + str(i)) for i, b in enumerate(blocks)]
                               + [("deep", "config " + "{" * 500 + "}" * 500 + " SELECT deep")], "path string, text string")
    got = {r.path: r.body for r in model_bodies(df).collect()}
    assert got == {**{str(i): f"SELECT {i}" for i in range(len(blocks))}, "deep": "SELECT deep"}


def test_long_texts(spark):
    text = "config { " + "{ a } " * 50_000 + "} " + "-- filler\n" * 100_000 + "SELECT 1"
    assert model_bodies(spark.createDataFrame([("p", text)], "path string, text string")).first().body == "SELECT 1"
