import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from siftmill.llm import queries, spelling


def brute_counts(rows, drop_every=97):
    counts = Counter()
    for i, text, *_ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % drop_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one letter inserted, deleted or replaced, letter by letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=2):
    forms, numbers = {}, {}
    for word, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(word, o))
        numbers[word] = len(others)
        if others and -others[0][0] >= ratio * n:
            forms[word] = others[0][1]
    found = []
    for word, n in counts.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        found.append((word, form, root, n, numbers[word], counts.get(form)))
    return sorted(found, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
OWN = ("word", "n", "near", "form", "root", "run", "id", "h", "shard", "block")


def vocabulary(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n bigint")


def variants(letters, words, seed):
    rnd = random.Random(seed)
    counts = Counter()
    for _ in range(words):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
        for _ in range(rnd.randint(0, 3)):
            place = rnd.randint(0, len(word))
            counts[word[:place] + rnd.choice(letters) + word[place + rnd.randint(0, 1) :]] += rnd.choice([1, 1, 2, 5, 40])
        counts[word] += rnd.choice([1, 3, 100])
    return dict(counts)


def test_cases_against_brute_force(spark):
    docs = cases.clashing(cases.documents(spark), OWN)
    words = spelling.word_counts(docs, drop_every=2, least_count=1)
    counts = brute_counts(cases.rows() * 3, drop_every=2)
    assert {r.word: 3 * r.n for r in words.collect()} == counts
    assert cases.as_set(spelling.spelling_variants(words), *COLUMNS) == brute({w: n // 3 for w, n in counts.items()})


@pytest.mark.parametrize("letters", ["ab", "abcé", "aé日\U0001f600", "abcdefghijklmnop"])
def test_variants_against_all_pairs(spark, letters):
    counts = variants(letters, 120, 3)
    assert cases.as_set(spelling.spelling_variants(vocabulary(spark, counts)), *COLUMNS) == brute(counts)


def test_long_words_and_ties(spark):
    long = "x" * 300
    counts = {long: 9, long + "x": 9, long[:-1]: 20, "y" + long[1:]: 4, "tie": 10, "tia": 10, "ti": 5, "z" * 60: 1, "z" * 59 + "a": 7, "": 3, "q": 1}
    assert cases.as_set(spelling.spelling_variants(vocabulary(spark, counts)), *COLUMNS) == brute(counts)


def test_long_chains_of_forms(spark):
    """Each word is the form of the next: one root for a chain of 40."""
    chain = ["a" * (40 - k) + "b" * k for k in range(40)]
    counts = {word: 1 << (41 - k) for k, word in enumerate(chain)}
    found = spelling.spelling_variants(vocabulary(spark, counts))
    assert cases.as_set(found, *COLUMNS) == brute(counts)
    assert {r.root for r in found.collect()} == {chain[0]}


def test_rounds_of_filters_change_nothing(spark, monkeypatch):
    counts = variants("abcdef", 400, 5)
    expected = brute(counts)
    monkeypatch.setattr(spelling, "BITS_PER_WORD", 256)
    assert cases.as_set(spelling.spelling_variants(vocabulary(spark, counts), max_blocks=100), *COLUMNS) == expected


def test_full_filters_change_nothing(spark, monkeypatch):
    """With one bit for a word nearly every edit is known: the join drops the rest."""
    monkeypatch.setattr(spelling, "BITS_PER_WORD", 1)
    counts = variants("abcd", 100, 7)
    assert cases.as_set(spelling.spelling_variants(vocabulary(spark, counts)), *COLUMNS) == brute(counts)


def test_only_known_edits_become_rows():
    """The filter drops nearly all edits that are no words, and no word."""
    words = sorted({"".join(random.Random(i).choices("abcdefghij", k=8)) for i in range(3000)})
    sharding = spelling.Sharding({8: len(words)})
    filters = spelling.BlockRange.empty(sharding, 0, spelling.MAX_BLOCKS)
    for _, letters in spelling.by_length(words):
        filters.add(8, spelling.word_hashes(letters))
    for _, letters in spelling.by_length(words):
        assert len(filters.known(8, spelling.word_hashes(letters))) == len(words)
    alphabet = np.array(sorted(map(ord, "abcdefghij")), np.uint32)
    numbers, edited = spelling.candidates(words, filters, alphabet)
    pairs = {(words[n], e) for n, e in zip(numbers.tolist(), edited)}
    known = set(words)
    assert {(w, e) for w, e in pairs if e in known} == {(w, o) for w in words for i in range(8) for c in "abcdefghij" if c > w[i] and (o := w[:i] + c + w[i + 1 :]) in known}
    assert len(pairs) < len(words) * 36 * 0.05  # of some 36 edits a word


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé\U0001f600", min_size=1, max_size=6), min_size=1, max_size=8))
def test_edit_hashes_are_those_of_the_edited_words(words):
    alphabet = np.array(sorted(map(ord, "abé\U0001f600")), np.uint32)

    def of(text):
        return spelling.word_hashes(np.array([[ord(c) for c in text]], np.uint32))[0] if text else np.uint64(0)

    for numbers, letters in spelling.by_length(words):
        whole = spelling.word_hashes(letters)
        assert [of(words[n]) for n in numbers] == whole.tolist()
        row, place, hashes = spelling.deletions(letters)
        made = [words[numbers[r]][:p] + words[numbers[r]][p + 1 :] for r, p in zip(row, place)]
        assert list(map(of, made)) == hashes.tolist()
        assert {(int(numbers[r]), m) for r, m in zip(row, made)} == {(int(n), words[n][:p] + words[n][p + 1 :]) for n in numbers for p in range(len(words[n]))}
        assert len({(int(r), m) for r, m in zip(row, made)}) == len(made)
        for at in range(letters.shape[1]):
            row, letter, hashes = spelling.replacements(letters, whole, alphabet, at)
            made = [words[numbers[r]][:at] + chr(alphabet[k]) + words[numbers[r]][at + 1 :] for r, k in zip(row, letter)]
            assert list(map(of, made)) == hashes.tolist()


def test_repeated_and_missing_words(spark):
    given_rows = [("house", 3), ("house", 4), ("hause", 2), (None, 5), ("horse", None)]
    found = spelling.spelling_variants(spark.createDataFrame(given_rows, "word string, n bigint"))
    assert cases.as_set(found, *COLUMNS) == brute({"house": 7, "hause": 2})


def test_empty_tables(spark):
    assert spelling.spelling_variants(spelling.word_counts(cases.empty(spark), drop_every=97)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(vocabulary(spark, {"a": 1}), ratio=1)


def test_query_on_a_table(spark, tmp_path):
    rnd = random.Random(2)
    words = ["house", "houses", "mouse", "Straße", "strasse", "häuser", "hauser", "Éclair", "eclair"]
    rows = [(i, " ".join(rnd.choices(words, k=60)), "en", "s", 0) for i in range(80)]
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert cases.as_set(queries.op12_spelling(spark, str(tmp_path)), *COLUMNS) == brute(brute_counts(rows))
