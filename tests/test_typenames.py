import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from siftmill.functions.typenames import normalize_text, normalize_type, split_outside_brackets, split_top_level

PAIRS = [
    ("bytes", "bytes"),
    ("Union[Optional[date], list[Union[str, bytes]]]", "None | date | list[bytes | str]"),
    ("Any | typing.Optional[set[int | None]] | int", "Any | None | int | set[None | int]"),
    ("Mapping[Union[b, a], Optional[tuple[x | x, ...]]]", "Mapping[a | b, None | tuple[x, ...]]"),
    ("Union[int]", "int"),
    ("Callable[[], int | bool]", "Callable[[], bool | int]"),
    ("tuple[int, ...]", "tuple[int, ...]"),
    ("b | a | b", "a | b"),
]


@pytest.mark.parametrize(("name", "normal"), PAIRS)
def test_normal_forms(name, normal):
    assert normalize_text(name) == normal
    assert normalize_text(normal) == normal


def test_column(spark):
    df = spark.createDataFrame([(n, w) for n, w in PAIRS] + [(None, None), ("a]", None), ("Union[a", None)], "n string, w string")
    assert all(row.w == row.x for row in df.withColumn("x", normalize_type(F.col("n"))).collect())


names = st.sampled_from(["int", "str", "None", "a.B", "Any"])
hints = st.recursive(
    names,
    lambda inner: st.one_of(
        st.lists(inner, min_size=2, max_size=3).map(" | ".join),
        st.lists(inner, min_size=1, max_size=3).map(lambda x: f"Union[{', '.join(x)}]"),
        inner.map(lambda x: f"typing.Optional[{x}]"),
        st.lists(inner, min_size=1, max_size=3).map(lambda x: f"dict[{', '.join(x)}]"),
    ),
    max_leaves=8,
)


@given(hints)
def test_idempotent_and_free_of_unions(name):
    normal = normalize_text(name)
    assert normalize_text(normal) == normal
    assert "Union[" not in normal and "Optional[" not in normal


def test_split():
    assert split_outside_brackets("a[b|c]|d", "|") == ["a[b|c]", "d"]
    with pytest.raises(ValueError):
        split_outside_brackets("a]|b", "|")


def test_split_column(spark):
    df = spark.createDataFrame([("a[b, c],d",), ("a]",), (None,)], "n string")
    rows = df.select(split_top_level(F.col("n"), ",").alias("x")).collect()
    assert [r.x for r in rows] == [["a[b, c]", "d"], None, None]


def test_deep_names(spark):
    """Thousands of levels: no stack is needed."""
    deep = "list[" * 3000 + "b | a" + "]" * 3000
    assert normalize_text(deep) == "list[" * 3000 + "a | b" + "]" * 3000
    assert normalize_text("Optional[" * 3000 + "a" + "]" * 3000) == "None | a"
    assert normalize_text("[" * 5000) is None
