import pytest

import golden as g
from siftmill.operators import hints as h, placement as pl
from siftmill.plans import jobs
from siftmill.schemas import SOURCES, Category
from siftmill.sources.python_code import fact_errors, file_facts, source_facts

def hints_of(spark, text, path="pkg/a.py"):
    facts = source_facts(spark.createDataFrame([(None, path, text)], SOURCES)).cache()
    rows = h.source_hints(facts).collect()
    found = sorted(rows, key=lambda r: r["_ord"].place)
    return [(r.Class, r.FunctionName, r.ColumnOffset, r.Category, r.VarName, r.Type) for r in found], fact_errors(facts).collect()


# One small program for each rule of reading hints, with the rows it gives:
# class, function, offset, category, name, type.
RULES = {
    "alias of a module": (
        "import xml.dom as dom\ntree: dom.Node = None\n",
        [(None, None, 0, 5, "tree", "xml.dom.Node")],
    ),
    "a class of the file wins over an import": (
        "from shelf import Crate\nclass Crate: pass\nfrom attic import Crate\nbox: Crate = 1\n",
        [(None, None, 0, 5, "box", "Crate")],
    ),
    "the first import of a name wins": (
        "from press import Record\nfrom shelf import Record\nr: Record = 1\n",
        [(None, None, 0, 5, "r", "press.Record")],
    ),
    "a dotted name is looked up among the imports": (
        "from attic import Crate\nclass Crate: pass\nlid: Crate.Lid = 1\n",
        [(None, None, 0, 5, "lid", "attic.Crate.Lid")],
    ),
    "every kind of parameter": (
        "class Deck:\n    def spin(self, speed: float, *tracks: str, loop: bool = False, **tags: int) -> None: ...\n",
        [
            ("Deck", "spin", 0, 2, "speed", "float"), ("Deck", "spin", 0, 2, "tracks", "str"), ("Deck", "spin", 0, 2, "loop", "bool"),
            ("Deck", "spin", 0, 2, "tags", "int"), ("Deck", "spin", 0, 3, "spin", "None"),
        ],
    ),
    "hints of a line share the first offset, in characters": (
        "def f():\n    é = 2; near: int = 1; far: str = ''\n",
        [(None, "f", 0, 3, "f", None), (None, "f", 11, 1, "near", "int"), (None, "f", 11, 1, "far", "str")],
    ),
    "an item is no variable, but counts for the offset": (
        "def f():\n    box[0]: int = 1; note: str = ''\n",
        [(None, "f", 0, 3, "f", None), (None, "f", 4, 1, "note", "str")],
    ),
    "hints of a global come together": (
        "from typing import Optional\nVOLUME: Optional[int] = 3\nVOLUME: float | int = 4\n",
        [(None, None, 0, 5, "VOLUME", "None | float | int")],
    ),
    "functions within functions": (
        "class Deck:\n    def outer(self):\n        def inner() -> int:\n            x: list[int] = []\n",
        [("Deck", "outer", 0, 3, "outer", None), ("Deck", "inner", 0, 3, "inner", "int"), ("Deck", "inner", 12, 1, "x", "list[int]")],
    ),
    "coroutines are functions, lambdas are not": (
        "async def run(go: bool):\n    f = lambda q: q\n",
        [(None, "run", 0, 2, "go", "bool"), (None, "run", 0, 3, "run", None)],
    ),
    "members and class variables": (
        "class Deck:\n    size: int = 1\n    def __init__(self):\n        self.arm: float = 0.5\n",
        [("Deck", None, 4, 1, "size", "int"), ("Deck", "__init__", 0, 3, "__init__", None), ("Deck", "__init__", 8, 4, "arm", "float")],
    ),
    "unions in any spelling": (
        "import typing\ndef f(a: typing.Union[list[bytes | int], typing.Optional[str]]): ...\n",
        [(None, "f", 0, 2, "a", "None | list[bytes | int] | str"), (None, "f", 0, 3, "f", None)],
    ),
}


@pytest.mark.parametrize("rule", RULES)
def test_hints(spark, rule):
    program, expected = RULES[rule]
    found, errors = hints_of(spark, program)
    assert found == expected and not errors


def test_a_hint_that_is_no_type_is_an_error(spark):
    found, errors = hints_of(spark, 'def play(deck: "Deck"): ...\n')
    assert found == [(None, "play", 0, 3, "play", None)]
    assert [e.error for e in errors] == ["no type: Constant in line 1"]


def test_names_depend_on_what_came_before(spark):
    text = "x: Thing = 1\nfrom m import Thing\ny: Thing = 1\nclass Thing: pass\nz: Thing = 1\nimport long as m\nu: m.T = 1\nimport other as m\nv: m.T = 1\n"
    found, _ = hints_of(spark, text)
    assert [(f[4], f[5]) for f in found] == [
        ("x", "Thing"), ("y", "m.Thing"), ("z", "Thing"), ("u", "long.T"), ("v", "other.T"),
    ]


def test_import_of_imported_module(spark):
    found, _ = hints_of(spark, "from a import b\nfrom b import C\nx: C = 1\ny: b.D = 1\n")
    assert [(f[4], f[5]) for f in found] == [("x", "a.b.C"), ("y", "a.b.D")]


def test_errors(spark):
    sources = spark.createDataFrame([(None, "a.py", "def f(:"), (None, "b.py", "from . import x\ny: int = 1\n"), (None, "c.py", None)], SOURCES)
    facts = source_facts(sources)
    assert {(e.Filename, e.error.split(":")[0]) for e in fact_errors(facts).collect()} == {
        ("a.py", "SyntaxError"), ("b.py", "import without module in line 1"),
    }
    assert h.source_hints(facts).count() == 1


TILL = '''class Till:
    def __init__(self):
        self.total = 0

    def take(till, coin):
        till.last, count = coin, 1
        return count

def closing(till):
    def tally(factor):
        return till.total * factor
    return tally(2)
'''


def observations(spark, path, *rows):
    """Rows of (class, function, line, category, variable, type)."""
    module = path.removesuffix(".py").replace("/", ".")
    return spark.createDataFrame(
        [(path, module if c else None, c, f, n, k, v, None, t, i) for i, (c, f, n, k, v, t) in enumerate(rows)], g.ORDERED
    )


def actions(spark, text, seen, strategy="inline"):
    sources = spark.createDataFrame([(None, "pkg/a.py", text)], SOURCES)
    rows = jobs.place(sources, seen, strategy)["sites"].orderBy("SiteNo").collect()
    return [(r.LineNo, r.VarName, r.Hint, r.Action) for r in rows]


def test_callables(spark):
    seen = observations(
        spark, "pkg/a.py",
        ("Till", None, 0, 4, "total", "int"), ("Till", None, 0, 4, "last", "Coin"), ("Till", "take", 5, 2, "coin", "Coin"),
        ("Till", "", 6, 1, "count", "int"), ("Till", "take", 0, 3, "take", "int"), (None, "closing", 9, 2, "till", "Till"),
        (None, "closing", 0, 3, "closing", "int"), (None, "tally", 10, 2, "factor", "int"), (None, "tally", 0, 3, "tally", "NoneType"),
    )
    assert [x for x in actions(spark, TILL, seen) if x[3] != "none"] == [
        (3, "total", "int", "annotate"),
        (5, "coin", "Coin", "annotate"), (5, "take", "int", "annotate"),
        # two targets: no hint fits into the assignment
        (6, "last", "Coin", "declare"), (6, "count", "int", "declare"),
        (9, "till", "Till", "annotate"), (9, "closing", "int", "annotate"),
        (10, "factor", "int", "annotate"), (10, "tally", "None", "annotate"),
    ]


PRICES = '''price = net = 3
(low, high), label = (1, 2.5), "x"
price -= 1
tax = 0.2
'''


def test_assignments(spark):
    names = {"price": "int", "net": "int", "low": "int", "high": "float", "label": "str", "tax": "float"}
    seen = observations(spark, "pkg/a.py", *[(None, None, 0, 5, n, t) for n, t in names.items()])
    assert actions(spark, PRICES, seen) == [
        (1, "price", "int", "declare"), (1, "net", "int", "declare"),
        (2, "low", "int", "declare"), (2, "high", "float", "declare"), (2, "label", "str", "declare"),
        (3, "price", "int", "declare"),
        (4, "tax", "float", "annotate"),
    ]


AREA = '''def area(side: float) -> float:
    unit: str = "m"
    height: int
    height, depth = 2, 3
    return side

class Box:
    def fill(self, amount) -> None:
        self.level = amount
'''


@pytest.mark.parametrize(
    ("strategy", "done"),
    [
        ("inline", ["keep", "keep", "keep"]),
        ("eval_inline", ["strip", "strip", "strip"]),
    ],
)
def test_unobserved_files(spark, strategy, done):
    elsewhere = observations(spark, "pkg/b.py", (None, None, 0, 5, "q", "int"))
    found = [(n, v, a) for n, v, _, a in actions(spark, AREA, elsewhere, strategy) if a != "none"]
    assert found == [
        (1, "side", done[0]), (1, "area", done[1]), (2, "unit", "strip"), (3, "height", "remove"), (8, "fill", done[2]),
    ]


LAMP = '''class Lamp:
    def dim(self, level: int, step) -> bool:
        self.glow: float = level
        return step > 1
'''


@pytest.mark.parametrize(("strategy", "hinted"), [("inline", "keep"), ("eval_inline", "replace")])
def test_existing_hints(spark, strategy, hinted):
    seen = observations(
        spark, "pkg/a.py",
        ("Lamp", None, 0, 4, "glow", "Decimal"), ("Lamp", "dim", 2, 2, "level", "float"),
        ("Lamp", "dim", 2, 2, "step", "int"), ("Lamp", "dim", 0, 3, "dim", "int"),
    )
    found = {(n, v): a for n, v, _, a in actions(spark, LAMP, seen, strategy) if a != "none"}
    assert found == {(2, "level"): hinted, (2, "step"): "annotate", (2, "dim"): hinted, (3, "glow"): "replace"}


SWITCH = '''mode = "off"

def switch():
    global hidden
    mode = 3
    hidden = mode
    shown = 1
'''


def test_globals_in_functions_are_left_alone(spark):
    seen = observations(
        spark, "pkg/a.py",
        (None, None, 0, 5, "mode", "str"), (None, None, 0, 5, "hidden", "int"), (None, "switch", 5, 1, "mode", "int"),
        (None, "switch", 6, 1, "hidden", "int"), (None, "switch", 7, 1, "shown", "int"),
    )
    assert [x for x in actions(spark, SWITCH, seen) if x[3] != "none"] == [
        (1, "mode", "str", "annotate"), (5, "mode", "int", "annotate"), (7, "shown", "int", "annotate"),
    ]


def test_members_need_their_class(spark):
    text = "class A:\n    def __init__(self, a):\n        self.x = a\n\ndef f(a):\n    a.x = 1\n"
    seen = observations(spark, "pkg/a.py", ("A", None, 0, 4, "x", "int"), ("B", None, 0, 4, "x", "str"))
    assert [(n, a) for n, v, _, a in actions(spark, text, seen) if v == "x"] == [(3, "annotate"), (6, "none")]


def test_conflicts(spark):
    seen = observations(spark, "pkg/a.py", (None, None, 0, 5, "z", "int"), (None, None, 0, 5, "z", "str"))
    sources = spark.createDataFrame([(None, "pkg/a.py", "z = 1\n")], SOURCES)
    with pytest.raises(Exception, match="more than one hint"):
        jobs.place(sources, seen)["sites"].collect()
    loose = jobs.place(sources, seen, strict=False)["sites"]
    assert [r.HintCount for r in pl.hint_conflicts(loose).collect()] == [2]


def test_unknown_strategy(spark):
    with pytest.raises(LookupError):
        pl.with_action(spark.createDataFrame([("a", None)], "Kind string, Hint string"), "other")


def test_import_plan(spark):
    types = [
        ("vendor", "Widget"), ("deep.er", "Shell.Core"), ("pkg.a", "Own"), (None, "int"), (",,vendor", "int | str | Bolt"),
        ("vendor", "Widget"), ("modülé", "Größe"), ("not a module", "Thing"), ("", "Nothing"), ("trailing.", "X"),
    ]
    rows = [("pkg/a.py", None, None, f"f{i}", 0, 3, f"f{i}", module, name, i) for i, (module, name) in enumerate(types)]
    plan = pl.import_plan(spark.createDataFrame(rows, g.ORDERED))
    assert {tuple(r)[1:] for r in plan.collect()} == {
        ("vendor", "Widget"), ("vendor", "Bolt"), ("deep.er", "Shell"), ("modülé", "Größe"),
    }
    assert {r.Statement for r in pl.import_statements(plan).collect()} == {
        "from vendor import Bolt, Widget", "from deep.er import Shell", "from modülé import Größe",
    }


def test_evaluate_job(spark):
    before = [(None, "a.py", "def f(x: int) -> str: ...\n"), (None, "b.py", "y: int = 1\n"), (None, "c.py", "z: int = 1\n")]
    after = [(None, "a.py", "def f(x: str) -> str: ...\n"), (None, "b.py", "y: int = 1\n"), (None, "c.py", "z = 1\n")]
    seen = observations(spark, "a.py", (None, None, 0, 5, "q", "int")).unionByName(
        observations(spark, "b.py", (None, None, 0, 5, "q", "int"))
    )
    result = jobs.evaluate(spark.createDataFrame(before, SOURCES), spark.createDataFrame(after, SOURCES), seen)
    assert {(r.VarName, r.OriginalType, r.GeneratedType, r.Correctness) for r in result["metrics"].collect()} == {
        ("x", "int", "str", False), ("f", "str", "str", True),
    }
    assert tuple(result["totals"].first()) == (1.0, 0.5)
    assert result["errors"].count() == 0
    missing = spark.createDataFrame([(None, "b.py", "y: int = 1\n")], SOURCES)
    with pytest.raises(Exception, match="missing in the other tree"):
        jobs.evaluate(spark.createDataFrame(before, SOURCES), missing, seen)


def test_projects_are_evaluated_apart(spark):
    """Files of the same name: one changes in both projects, one in the first only."""
    before = [("p", "m.py", "def f(x: int): ...\n"), ("q", "m.py", "def f(x: str): ...\n"), ("p", "n.py", "a: int = 1\n"), ("q", "n.py", "a: int = 1\n")]
    after = [("p", "m.py", "def f(x: int): pass\n"), ("q", "m.py", "def f(x: bytes): ...\n"), ("p", "n.py", "a: str = 1\n"), ("q", "n.py", "a: int = 1\n")]
    seen = observations(spark, "m.py", (None, None, 0, 5, "z", "int")).unionByName(observations(spark, "n.py", (None, None, 0, 5, "z", "int")))
    result = jobs.evaluate(spark.createDataFrame(before, SOURCES), spark.createDataFrame(after, SOURCES), seen)
    rows = {(r.project, r.Filename, r.VarName, r.OriginalType, r.GeneratedType, r.Correctness) for r in result["metrics"].collect()}
    assert rows == {
        ("p", "m.py", "x", "int", "int", True), ("p", "m.py", "f", None, None, True), ("p", "n.py", "a", "int", "str", False),
        ("q", "m.py", "x", "str", "bytes", False), ("q", "m.py", "f", None, None, True),
    }
    assert {tuple(r)[:2] for r in result["files"].collect()} == {("p", "m.py"), ("p", "n.py"), ("q", "m.py")}
    only = jobs.evaluate(
        spark.createDataFrame(before, SOURCES), spark.createDataFrame(after, SOURCES), seen.selectExpr("*", "'q' AS project")
    )
    assert {(r.project, r.Filename) for r in only["metrics"].collect()} == {("q", "m.py")}


def test_facts_are_rows_not_trees():
    facts = file_facts("x: int = 1\n")
    assert [f["kind"] for f in facts] == ["hint", "site:annassign"]
    assert facts[0]["category"] == Category.GLOBAL_VARIABLE
