"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from taxonaut.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least_count=2, ratio=10):
    words = {w: n for w, n in counts.items() if n >= least_count}
    rows = {}
    for w, n in words.items():
        found = sorted((-words[x], x) for x in words if x != w and near(w, x))
        form = found[0][1] if found and -found[0][0] >= ratio * n else None
        rows[w] = [form, None, n, len(found), words[form] if form else None]
    for w, row in rows.items():
        end = w
        while rows[end][0]:
            end = rows[end][0]
        row[1] = end
    return {w: tuple(r) for w, r in rows.items()}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    random.seed(seed)
    alphabet = "abé÷ÿ" if seed else "ab"
    counts = {}
    for _ in range(150):
        counts["".join(random.choice(alphabet) for _ in range(random.randint(1, 6)))] = random.choice([1, 2, 3, 30, 300, 4000])
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, prefix string").repartition(3)
    found = got(spelling.variants(rows))
    assert found == brute(counts)
    assert any(r[3] > 2 for r in found.values())


def test_runs_of_equal_letters_meet_once(spark):
    counts = {"aaaa": 5, "aaa": 50, "aaaaa": 2, "aabaa": 2, "aab": 7}
    found = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and found["aaaa"][3] == 3 and found["aaaa"][0] == "aaa"


def test_chains_are_followed_to_their_end(spark):
    word = "abcdefghij"
    counts = {"z" * i + word[i:]: 2 * 10 ** (9 - i) for i in range(10)}
    found = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in found.values()} == {word} and found == brute(counts)


def test_odd_rows(spark):
    """Nulls, empty words, repeats, the terminator, ties and empty tables."""
    rows = [(None, 3), ("", 3), ("word", None), ("abc", 1), ("abc", 1), ("abd", 40), ("abe", 40), ("a\x00b", 2), ("a\x00c", 2)]
    found = got(spelling.variants(spark.createDataFrame(rows, "word string, n long")))
    assert found["abc"] == ("abd", "abd", 2, 2, 40)
    assert found["a\x00b"] == (None, "a\x00b", 2, 0, None)
    assert set(found) == {"abc", "abd", "abe", "a\x00b", "a\x00c"}
    assert got(spelling.variants(spark.createDataFrame([], "word string, n long"))) == {}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def brute_occurrences(rows):
    out = []
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out.append(run)
    return sorted(out)


def test_occurrences(spark):
    random.seed(5)
    rows = [(i, " ".join("".join(random.choice("abcXYZàÀ÷ßÿŸ1_") for _ in range(random.randint(1, 40))) for _ in range(30))) for i in range(60)]
    rows += [(None, "Repeated Repeated repeated"), (7, None), (8, ""), (9, "elephant " * 60_000), (9, "elephant"), (10, "ÀÉÎõüabc \U0001f600twelvefold")]
    found = spelling.occurrences(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"))
    assert sorted(r["word"] for r in found.collect()) == brute_occurrences(rows)
    assert found.agg(F.sum("n")).first()[0] == found.count()
