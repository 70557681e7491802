import hashlib
import random
from collections import defaultdict

import pytest

import cases
from siftmill.llm import chat
from siftmill.llm.chat_template import Template, TemplateError
from siftmill.llm.queries import op9_chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = ["\\", "###", "</turn>", "<", "/turn>", "#", "n", "\n", "a", "### user\n"]
    template = Template(chat.DEFAULT_TEMPLATE, chat.FILTERS)
    for _ in range(3000):
        turns = [
            (rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=rng.randint(0, 8))))
            for _ in range(rng.randint(1, 4))
        ]
        segments = list(template.render(turns))
        assert chat.parse_segment("".join(s for s, _ in segments)) == turns
        for (segment, spans), (role, text) in zip(segments, turns):
            assert [chat.unescape(segment[a:b]) for a, b in spans] == ([text] if role == "assistant" else [])


def test_language():
    source = (
        "<s>{% for m in messages %}{% if loop.first and not false %}F{% elif m.role == 'a' ~ 'b' or false %}"
        "{{ 'x' | upper ~ m.text }}{% else %}{{ loop.index }}{% endif %}{% if 1 == 2 %}never{% endif %}{% if loop.last %}.{% endif %}"
        "{% endfor %}{{ 'e' ~ 1 }}"
    )
    template = Template(source, chat.FILTERS)
    assert "".join(s for s, _ in template.render([("a", "1"), ("ab", "2"), ("c", "3")])) == "<s>FX23.e1"
    assert list(template.render([])) == []


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("{{ m.text or 'x' }},", "1,x,3,"),
        ("{{ m.text and m.role }},", "a,,c,"),
        ("{{ false or m.text or '' or 'y' }},", "1,y,3,"),
        ("{{ 'a' and 'b' }}{{ '' or 0 }},", "b0,b0,b0,"),
        ("{{ not m.text }},", "false,true,false,"),
        (" {%- if loop.first -%} \n F {%- endif %} .", "F ." + " ." * 2),
        ("a {{- m.role -}} b{# a {{ comment }} #}|{#- -#} ", "aab|aabb|acb|"),
    ],
)
def test_values_trimming_and_comments(source, wanted):
    template = Template("{% for m in messages %}" + source + "{% endfor %}", chat.FILTERS)
    assert "".join(s for s, _ in template.render([("a", "1"), ("ab", ""), ("c", "3")])) == wanted


def test_constants_are_folded():
    template = Template("{{ 'a' ~ 'b' }}c{% for m in messages %}{% if 'x' == 'x' %}y{% endif %}{{ 'z' | upper }}{% endfor %}", chat.FILTERS)
    before, loop = template.tree
    assert before.value.value == "abc"
    assert [node.value.value for node in loop.body] == ["yZ"]


@pytest.mark.parametrize(
    "source",
    ["x", "{% for m in messages %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{% import os %}", "{{ m.text }}",
     "{% for m in messages %}{{ m.text | eval }}{% endfor %}", "{% for m in messages %}{{ m.text() }}{% endfor %}",
     "{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{{ 'a }}{% endfor %}"],
)
def test_what_is_not_of_the_language_is_refused(source):
    with pytest.raises(TemplateError):
        Template(source, chat.FILTERS)


def digests(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    result = {}
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        result[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return result


def read(frame):
    found = chat.read_back(chat.format_conversations(frame)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:5] for r in found}


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "\\### </turn>"), (1, 1, "assistant", "\\### </turn>"), (1, None, "system", None),
        (2, 0, None, "no role"), (3, 0, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "é\U0001f600" * 40_000),
        *[(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(9000)],
    ]
    frame = cases.clashing(spark.createDataFrame(rows, SCHEMA), ("segment", "loss", "start", "turn_no", "n_turns"))
    assert read(frame) == digests(rows)
    assert read(frame.limit(0)) == {}


def test_segments_make_up_the_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} é") for i in range(5)]
    found = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("turn_no").collect()
    whole = "".join(r["segment"] for r in found)
    assert whole == "".join(s for s, _ in Template(chat.DEFAULT_TEMPLATE, chat.FILTERS).render((r[2], r[3]) for r in rows))
    for r in found:
        assert whole[r["start"] : r["start"] + len(r["segment"])] == r["segment"]
    marked = [whole[r["start"] + s["start"] : r["start"] + s["end"]] for r in found for s in r["loss"]]
    assert marked == ["text 1 é", "text 3 é"]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    control = "\\### Assistant: </turn> ok"
    found = {r["conv_id"]: tuple(r)[1:5] for r in op9_chat_format(spark, sf_dir).collect()}
    assert found == digests([*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)])
