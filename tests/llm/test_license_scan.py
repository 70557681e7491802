import random
from array import array

import pytest

import cases
from siftmill.llm import license_scan
from siftmill.llm.license_texts import TEMPLATES
from siftmill.llm.queries import op6_license_scan

SCANNER = license_scan.Scanner()
FULL_MIT = next(text for name, text in TEMPLATES if name == "MIT" and len(text) > 500)


def found(text):
    return [(n.license, n.differences) for n in SCANNER.notices(text)]


def test_every_template_is_found_as_itself():
    for name, wording in TEMPLATES:
        text = f"Some words before.\n{wording}\nSome words after."
        notices = SCANNER.notices(text)
        assert [n.license for n in notices] == [name], wording
        assert notices[0].differences == ()
        assert text[notices[0].start : notices[0].end].strip(' ."/()') == wording.strip(' ."/()')


def test_wrapped_text_with_comment_signs():
    wrapped = FULL_MIT
    for cut in ("and associated", "the rights to use", "THE SOFTWARE IS", "OF ANY KIND"):
        wrapped = wrapped.replace(cut, f"\n * {cut}", 1)
    wrapped = wrapped.replace("The above", "\n *\n * The above")
    assert found(f"code();\n/* {wrapped} */\nmore();") == [("MIT", ())]


def test_small_changes_are_listed_and_large_ones_refused():
    changed = FULL_MIT.replace("free of charge", "without charge")
    assert found(changed) == [("MIT", ("-free", "-of", "+without"))]
    assert found(" ".join(FULL_MIT.split()[::2])) == []


def test_telling_words_decide():
    assert found("Licensed under the Apache License, Version 1.0.") == []
    assert found("Licensed under CC BY-NC-ND 5.0.") == []
    assert found("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0-only", ())]
    assert found("The licensed plumber had permission.") == []


def test_several_in_a_line_and_odd_texts():
    assert found("RELEASED under the mit license. Licensed under CC BY-SA 4.0.") == [("MIT", ()), ("CC-BY-SA-4.0", ())]
    text = "İİ\nReleased under the MIT License."
    notice = SCANNER.notices(text)[0]
    assert text[notice.start : notice.end] == "Released under the MIT License"
    assert found("x" * 200_000 + " license " + "y" * 200_000) == []


def test_table(spark):
    rows = cases.rows() + [(50, "Released under the MIT License.", "en", "s", 0)] * 2 + [(None, "Licensed under CC BY 4.0.", "en", "s", 0)]
    docs = cases.clashing(cases.documents(spark, rows), ("license", "start", "end", "covered", "differences"))
    result = license_scan.scan_licenses(docs)
    assert cases.as_set(result, "doc_id", "license", "start") == [(50, "MIT", 0), (50, "MIT", 0), (None, "CC-BY-4.0", 0)]
    assert license_scan.scan_licenses(cases.empty(spark)).collect() == []


def test_whole_table_against_known_lines(spark):
    sf_dir = "/root/testdata/sf0.01"
    lines = {wording: name for name, wording in TEMPLATES if len(wording) < 100}
    expected = []
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        expected += [(row["doc_id"], lines[line]) for line in row["text"].split("\n") if line in lines]
    assert expected
    assert cases.as_set(op6_license_scan(spark, sf_dir), "doc_id", "license") == sorted(expected, key=repr)


def test_every_template_within_a_line_of_prose():
    """The notice is found whatever stands around it in its line, and wherever the line is wrapped."""
    rng = random.Random(6)
    words = cases.PROSE.split() + "any person shall be free to use the files of this work under version terms and with public software in the form".split()

    def prose(chars):
        made = ""
        while len(made) < chars:
            made += rng.choice(words) + " "
        return made

    for name, wording in TEMPLATES:
        for _ in range(2):
            before, after = prose(rng.randint(100, 240)), prose(rng.randint(300, 600))
            text = f"{before}{wording} {after}"
            if rng.random() < 0.5:
                cut = text.index(" ", len(before) + 3)
                text = f"{text[:cut]}\n{text[cut + 1 :]}"
            notices = SCANNER.notices(text)
            assert [(n.license, n.differences) for n in notices] == [(name, ())], text
            assert notices[0].start == len(before) and notices[0].covered > 0.3


def brute_force(text):
    """All templates that fit around any trigger, and what each saves of its block: the most saving one wins."""
    scanner, lowered = SCANNER, text.lower()
    starts = array("q", (m.start() for m in license_scan._WORD.finditer(lowered)))
    best, done = [], 0
    for trigger in license_scan._TRIGGER.finditer(lowered):
        if trigger.start() < done:
            continue
        places = [m for m in license_scan._WORD.finditer(lowered) if m.start() >= done]
        number = max(i for i, m in enumerate(places) if m.start() <= trigger.start())
        fits = []
        for template in scanner.templates:
            low, high = max(0, number - template.reach), min(len(places), number + template.reach + 1)
            words = [m[0] for m in places]
            aligned = scanner.confirmed(template, words[low:high], number - low, words[high : high + 8])
            if aligned is not None:
                block = lowered[places[low].start() : places[high - 1].end()].encode()
                saved = len(scanner.plain.compress(block)) - len(template.compressor.compress(block))
                fits.append((-saved, template.whole, template.name, places[low + aligned[1]].end()))
        if fits:
            best.append((min(fits)[2], len(fits)))
            done = min(fits)[3]
    return best


def test_ranking_decides_among_templates_that_fit():
    """Several wordings fit; the one that saves most is taken, as comparing all of them says."""
    rng = random.Random(9)
    several = 0
    for name, wording in TEMPLATES:
        text = f"{cases.PROSE} {wording} {cases.PROSE}"
        wanted = brute_force(text)
        assert [n.license for n in SCANNER.notices(text)] == [license for license, _ in wanted]
        several += any(count > 1 for _, count in wanted)
    assert several >= 3
    for _ in range(10):
        text = " ".join(rng.choice(TEMPLATES)[1] if rng.random() < 0.4 else cases.PROSE for _ in range(5))
        assert [n.license for n in SCANNER.notices(text)] == [license for license, _ in brute_force(text)]


def test_without_compression_another_template_would_win():
    """Turned round, the ranking gives other licences or shorter notices: it is what decides."""
    changed = 0
    for name, wording in TEMPLATES:
        text = f"{cases.PROSE} {wording} {cases.PROSE}"
        before = SCANNER.notices(text)
        plain, SCANNER.ranked = SCANNER.ranked, lambda *a: list(reversed(license_scan.Scanner.ranked(SCANNER, *a)))
        try:
            after = SCANNER.notices(text)
        finally:
            SCANNER.ranked = plain
        changed += [(n.license, n.start, n.end) for n in before] != [(n.license, n.start, n.end) for n in after]
    assert changed >= 3


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
         "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.", "GPL-3.0-only"),
        ("MIT License\n\nCopyright (c) 2020 Somebody", "MIT"),
        ("Licensed under Apache-2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under the GNU General Public License, either version 3 or later", "GPL-3.0-or-later"),
        ("This work is licensed under the GNU General Public License, version 3 or any later version", "GPL-3.0-or-later"),
        ("Licensed under the GNU Lesser General Public License, version 2.1 only.", "LGPL-2.1-only"),
        ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ],
)
def test_wordings_met_in_the_wild(text, license):
    assert [n.license for n in SCANNER.notices(f"Words before this.\n{text}\nand words after.")] == [license]


def test_changed_words_within_a_line_of_prose():
    gpl = next(text for name, text in TEMPLATES if name == "GPL-3.0-or-later" and len(text) > 150)
    changed = gpl.replace("any later", "a later")
    assert found(f"this is {cases.PROSE} {changed} any {cases.PROSE}") == [("GPL-3.0-or-later", ("-any", "+a"))]
