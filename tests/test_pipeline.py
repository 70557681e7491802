import pytest
from pyspark.sql import functions as F

import golden as g
from siftmill.operators import reduce as r
from siftmill.plans import pipeline as p
from siftmill.schemas import OBS9, ORD

# The kinds and the names of their settings, which make up the file format.
CONFIG = """
[project]
project = "depot"
stdlib_path = "/opt/python/lib"
proj_path = "/srv/depot"
venv_path = "/srv/venvs/depot"

[[unifier]]
name = "common"
kind = "drop_min_threshold"
min_threshold = 0.4

[[unifier]]
name = "one_of_each"
kind = "dedup"

[[unifier]]
name = "joined"
kind = "union"

[[unifier]]
name = "to_a_seen_base"
kind = "unify_subty"
only_unify_if_base_was_traced = true

[[unifier]]
name = "to_any_base"
kind = "unify_subty"

[[unifier]]
name = "fewer_than_four"
kind = "drop_mult_var"
min_amount_types_to_drop = 4

[[unifier]]
name = "certain"
kind = "drop_mult_var"

[[unifier]]
name = "earliest"
kind = "keep_only_first"

[[unifier]]
name = "no_checks"
kind = "drop_test"
test_name_pat = "check_|test_"
"""


def test_configuration():
    config = p.Configuration.from_toml(CONFIG)
    assert config.settings.project == "depot" and config.settings.benchmark_performance is False
    steps = {name: (step.kind, step.effective()) for name, step in config.unifiers.items()}
    assert list(steps) == [
        "common", "one_of_each", "joined", "to_a_seen_base", "to_any_base", "fewer_than_four", "certain", "earliest", "no_checks",
    ]
    # what is not set has the kind's default
    assert steps["certain"] == ("drop_mult_var", {**steps["fewer_than_four"][1], "min_amount_types_to_drop": 2})
    assert steps["fewer_than_four"][1]["min_amount_types_to_drop"] == 4
    assert [steps[n][1]["only_unify_if_base_was_traced"] for n in ("to_a_seen_base", "to_any_base")] == [True, False]
    assert steps["common"][1]["min_threshold"] == 0.4
    assert steps["no_checks"][1]["test_name_pat"] == "check_|test_"


def test_no_unifiers():
    assert p.Configuration.from_toml("").unifiers == {}


@pytest.mark.parametrize(
    "text",
    [
        '[[unifier]]\nname = "a"\nkind = "dedup"\nextra = 1',
        '[[unifier]]\nname = "a"\nkind = "drop_test"',
        '[[unifier]]\nname = "a"\nkind = "drop_mult_var"\nmin_amount_types_to_drop = "2"',
        '[[unifier]]\nname = "a"\nkind = "drop_mult_var"\nmin_amount_types_to_drop = true',
        '[[unifier]]\nkind = "dedup"',
        "[other]\na = 1",
        '[project]\nproject = "a"',
        '[project]\nproject = "a"\nproj_path = "/p"\nstdlib_path = "/s"\nvenv_path = "/p/venv"',
        '[project]\nproject = "a"\nproj_path = "/p"\nstdlib_path = "/p/s"\nvenv_path = "/venv"',
    ],
)
def test_strict_configuration(text):
    with pytest.raises(ValueError):
        p.Configuration.from_toml(text)


def test_unknown_names():
    with pytest.raises(LookupError):
        p.Configuration.from_toml('[[unifier]]\nname = "a"\nkind = "nothing"')
    with pytest.raises(LookupError):
        p.Configuration.from_toml(CONFIG).chain(["nobody"])
    with pytest.raises(LookupError):
        p.lookup("nothing")


def test_chains_do_not_share_steps():
    p.Chain().append("dedup")
    assert p.Chain().steps == []


def test_own_unifier(spark):
    @p.unifier("upper_names")
    def upper(df, *, column: str = "VarName"):
        return df.withColumn(column, F.upper(column))

    rows = p.Chain().append("upper_names").append("dedup")(g.depot(spark)).collect()
    assert {row["VarName"] for row in rows} == {"VEHICLE", "SPARE", "FLEET", "QUEUE", "DUMMY"}


CHAINS = [
    ["common"],
    ["one_of_each", "common", "earliest"],
    ["common", "one_of_each"],
    ["no_checks", "common", "certain", "earliest"],
    ["common", "joined", "one_of_each"],
    ["joined", "earliest"],
    ["to_any_base", "one_of_each", "joined", "one_of_each"],
    ["fewer_than_four", "to_a_seen_base", "joined"],
]


@pytest.mark.parametrize("names", CHAINS)
def test_compacting_changes_nothing(spark, names):
    rows, bases = g.depot(spark), g.hierarchy(spark)
    chain = p.Configuration.from_toml(CONFIG).chain(names)
    columns = [*OBS9, ORD]
    assert g.values(chain(rows, bases), columns) == g.values(chain(rows, bases, compacted=False), columns)


def test_hierarchy_is_needed(spark):
    with pytest.raises(ValueError):
        p.Chain().append("unify_subty")(g.depot(spark))


def test_subset_of_columns(spark):
    """Operators take other tables by naming their columns."""
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 2)], "k long, v string, _ord long")
    found = r.keep_only_first(df, sites=["k"], types=["v"]).collect()
    assert sorted((row.k, row.v) for row in found) == [(1, "a"), (2, "a")]
