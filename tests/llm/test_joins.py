"""Joins, searches, archives and the pipeline against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonaut.llm import jaccard, metric_join, neighbours, warc
from taxonaut.llm.common import components, words_of

DOCS = "doc_id long, text string"


def labels(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random.seed(0)
    for n, m in ((60, 40), (60, 90), (300, 0)):
        pairs = [(random.randrange(n), random.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2, n - 1)]
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        expected = labels(n, pairs)
        assert got == {i: expected[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def sets_of(rows, k):
    out = {}
    for doc_id, text in rows:
        w = words_of(text, lower=True)
        out[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_jaccard(rows, k, num, den):
    sets = sets_of(rows, k)
    ids = sorted(sets)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if sets[ids[i]] and sets[ids[j]] and den * len(sets[ids[i]] & sets[ids[j]]) >= num * len(sets[ids[i]] | sets[ids[j]])]
    return {ids[i]: (len(sets[ids[i]]), ids[c]) for i, c in enumerate(labels(len(ids), pairs))}


def mutated(n, seed, hot=0):
    random.seed(seed)
    word = lambda: random.choice("abcdefghijklmnop") * random.randint(1, 3)
    bases = [[word() for _ in range(60)] for _ in range(8)]
    passage = " ".join(word() for _ in range(hot))
    rows = []
    for i in range(n):
        w = list(random.choice(bases)) if i % 2 else [word() for _ in range(60)]
        for _ in range(random.randint(0, 4)):
            w[random.randrange(60)] = f"z{random.randint(0, 9)}"
        rows.append((i, None if i % 40 == 0 else (" ".join(w[: random.choice([0, 1, 3, 30, 60, 60, 60])]) + (" " + passage if hot and i % 3 else ""))))
    return rows


@pytest.mark.parametrize(("k", "num", "hot"), [(4, 85, 0), (5, 80, 60), (1, 60, 0)])
def test_jaccard(spark, k, num, hot):
    rows = mutated(260, k, hot) + [(1000, "A b C d E"), (1001, "a B c D e"), (1002, "")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"f": F.lit(1), "n": F.lit(2), "key": F.lit(3)}).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, k, num, 100).collect()}
    assert got == brute_jaccard(rows, k, num, 100)


def test_jaccard_of_one_large_group(spark):
    """One group of near copies, larger than a small group may be, linked through others."""
    random.seed(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in range(i // 15):
            w[(7 * j) % 100] = f"v{i // 30}x{j}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert got == brute_jaccard(rows, 4, 85, 100)


@pytest.mark.parametrize(("small", "rows_a_block"), [(2, 8), (4, 40)])
def test_jaccard_in_small_blocks(spark, monkeypatch, small, rows_a_block):
    """Groups of many blocks and components of any size give what brute force gives."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(jaccard, "TILE", 8)
    random.seed(rows_a_block)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(60)] = f"v{random.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in mutated(100, 3, 60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), 2, 85, 100).collect()}
    assert got == brute_jaccard(rows, 2, 85, 100)


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).isEmpty()
    got = jaccard.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (5, "q r s t u v"), (7, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or 99, r["n_shingles"], r["component_id"] or 99) for r in got) == [(3, 2, 3), (3, 2, 3), (5, 2, 3), (7, 0, 7), (99, 2, 99)]


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(0, n, 3):
        x[i] = x[i % 30] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.2, 0.0])
    return x.astype(np.float32)


VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("block", [64, 8192])
def test_metric_join(spark, monkeypatch, block):
    x = vectors(400, 1)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + BAD + [(8000, [1.0, 2.0], 0), (8001, [1.0, 2.0], 0)]
    kinds = metric_join.links
    monkeypatch.setattr(metric_join, "links", lambda v, c: kinds(v, c, block))
    got = {r["vec_id"]: r for r in metric_join.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    d = x.astype(float)
    cosine = (d @ d.T) / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    expected = labels(len(x), np.argwhere(linked).tolist())
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == expected and all(got[i]["kept"] == (expected[i] == i) for i in range(len(x)))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in BAD)
    assert (got[8001]["n_links"], got[8001]["component_id"]) == (1, 8000)


def test_metric_join_edges(spark):
    assert metric_join.near_duplicates(spark.createDataFrame([], VECTORS)).isEmpty()
    got = metric_join.near_duplicates(spark.createDataFrame(BAD + [(None, [1.0] * 16, 0)], VECTORS)).collect()
    assert len(got) == 7 and all(r["n_links"] == 0 for r in got)


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = neighbours.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    x = vectors(3000, 2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD + [(7000 + i, x[50].tolist(), 0) for i in range(20)]
    got = neighbours.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, k=5).toPandas()
    ids = np.array([r[0] for r in rows if r[0] not in {b[0] for b in BAD}])
    d = np.array([r[1] for r in rows if r[0] in set(ids.tolist())], np.float32).astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hits = total = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and ids[q] not in own.vec_id.tolist()
        assert np.allclose(own.score, [d[q] @ d[np.nonzero(ids == v)[0][0]] for v in own.vec_id]) and own.score.is_monotonic_decreasing
        s = d @ d[q]
        s[q] = -9
        hits += int((own.score >= np.sort(s)[-5] - 1e-9).sum())  # scaled copies tie but for rounding
        total += 5
    assert hits / total >= 0.9
    first = got[got.query_id == 50].sort_values("rank")
    assert first.vec_id.tolist()[:5] == sorted(first.vec_id.tolist()[:5])  # copies: ties to the smaller id
    assert neighbours.search(spark.createDataFrame([], VECTORS), F.lit(True)).isEmpty()
    shares = [neighbours.window_rows(n) / n for n in (10**4, 10**6, 10**8)]
    assert shares == sorted(shares, reverse=True) and neighbours.CURVES * shares[1] < 0.36  # windows overlap: 0.29 of different rows
    few = neighbours.search(spark.createDataFrame(rows[:3], VECTORS), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    rows = [(1, "a", "x\r\n\r\nWARC/1.1\r\n"), (2, "b", None), (3, None, ""), (4, "u\r\nX: y", "hé"), (5, "u", "hé"), (6, "z", ""), (7, "z", "long " * 50_000)]
    got = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(rows, PAGES).withColumn("answer", F.lit(0))).collect()}
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page_id == max(same) else ("revisit", max(same)))
    assert all(r["record_type"] == "response" for r in warc.archive(spark.createDataFrame(rows, PAGES), at_least=10**9).collect())
    assert warc.archive(spark.createDataFrame([], PAGES)).isEmpty()
    twice = warc.archive(spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (None, "a", "p"), (0, "a", "p")], PAGES)).collect()
    assert sorted((r["page_id"] if r["page_id"] is not None else 9, r["record_type"]) for r in twice) == [(0, "revisit"), (1, "response"), (1, "response"), (9, "response")]


def test_archives_are_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.archive(spark.createDataFrame([(1, "http://a", "x"), (2, "http://a", "x")], PAGES), path=path)
    got = {r["headers"]["WARC-Type"]: r for r in warc.read(spark, path).collect()}
    assert bytes(got["response"]["block"]) == b"x" and got["revisit"]["headers"]["WARC-Refers-To"] == got["response"]["headers"]["WARC-Record-ID"]
    assert got["revisit"]["headers"]["WARC-Profile"].endswith("identical-payload-digest")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from taxonaut.llm import secrets

    random.seed(11)
    word = lambda: "".join(random.choice(["ba", "lo", "ke", "ti", "mu"]) for _ in range(random.randint(2, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(80):
        text = " ".join(word() for _ in range(random.randint(150, 400)))
        if i % 10 == 1:
            text += " " + passage + " " + word()
        if i % 20 == 2:
            text += ' token = "' + "".join(random.choice("0123456789abcdef") for _ in range(40)) + '" ' + word()
        rows.append((i, text, "xx", "s", len(text)))
    rows += [(100, rows[5][1], "xx", "s", 1), (101, rows[6][1] + " extra", "xx", "s", 1), (102, "123 456 --", "xx", "s", 1), (103, None, "xx", "s", None), (104, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    assert set(kept[0]) == {*range(80), 100, 101}
    assert set(kept[1]) == set(range(80))
    assert set(kept[2]) == set(range(80))
    assert [i for i in range(80) if passage in kept[2][i]["text"]] == [1]
    assert all(kept[2][i]["text"] == rows[i][1] for i in range(80) if i % 10 != 1)
    assert all("[REDACTED]" in kept[3][i]["text"] and not secrets.base_spans(kept[3][i]["text"]) for i in range(2, 80, 20))
    assert all(kept[3][i]["text"] == kept[2][i]["text"] for i in range(80) if i % 20 != 2)
    assert set(kept[4]) == set(range(80))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
