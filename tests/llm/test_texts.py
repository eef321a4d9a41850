"""Text operators against brute force, libraries and round trips, with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from taxonaut.llm import langid, packing, pieces, pitman_yor, secrets, substrings
from taxonaut.llm.common import hash_words, held_out, words_of

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "a", "x" * 5000, "the\x0bend\x1f here\x85", "  two  gaps ", "日本語 ①é\tﬁ 😀", "</s> <|endoftext|> it's", "a " * 3000, "tail ", "line\nline\n end", "AKIA" * 9]


def test_hash_words_follows_the_contract():
    texts = [*ODD, "A b", "a B"]
    for lower in (False, True):
        h, n = hash_words(texts, lower)
        words = [w for t in texts for w in words_of(t, lower)]
        assert n.tolist() == [len(words_of(t, lower)) for t in texts]
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(seen.values())) == len(seen)
    assert words_of("a\x0bb\x85c d") == re.findall(rb"[^\x20\x09-\x0D]+", "a\x0bb\x85c d".encode())


def test_packing(spark):
    from tokenizers import Tokenizer

    random.seed(0)
    texts = ODD + [" ".join(random.choice(["alpha", "beta,", "It's", "x1", "été"]) for _ in range(random.randint(0, 900))) for _ in range(300)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5), path).toPandas()
    reference = Tokenizer.from_file(path)
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.array([*reference.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert (len(ids) > 1024) or len(own) == 1
        assert own.length.tolist()[1:] == [1024] * (len(own) - 1)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    assert rows.doc_id.nunique() == len(texts)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= 1.02 * math.ceil(rows.length.sum() / 1024) + 1
    assert packing.pack(spark.createDataFrame([], DOCS), path).isEmpty()


def test_packing_plan_places_everything():
    rng = np.random.default_rng(1)
    for histogram in (np.bincount([1023] * 50 + [1] * 60, minlength=1025), np.bincount(rng.integers(1, 1024, 5000), minlength=1025), np.bincount([600] * 100, minlength=1025), np.zeros(1025, int)):
        runs = packing.plan(histogram)
        assert np.bincount(runs[:, 0], weights=runs[:, 2] - runs[:, 1], minlength=1025).astype(int).tolist() == histogram.tolist()


def test_sentencepiece(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    random.seed(1)
    parts = [" ", "  ", "▁", "\n", "é", "ﬁ", "①", "梦", "😀", "\x00", "</s>", "<0x41>", "the", "ing", "ab", "...", "11", "ا", "e,"]
    texts = ODD + ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(500)] + ["ab" * 400]
    library = pieces.model(model).library
    rows = pieces.encode_and_decode(spark.createDataFrame(list(enumerate(texts)), DOCS), model, keep_ids=True).collect()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_and_decode(spark.createDataFrame([], DOCS), model).isEmpty()
    own = pieces.model(model)
    for chunk in ("▁hello", "▁▁▁x", "▁" + "ab" * 60):
        assert own.agenda(chunk) == library.encode(chunk[1:])


def brute_repeats(rows, window):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = words_of(text)
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (doc_id, i)) != (doc_id, i):
                covered[i : i + window] = [True] * window
        kept = [w for w, c in zip(words, covered) if not c]
        out[doc_id] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substrings(spark, monkeypatch):
    random.seed(2)
    rows = [(i, None if i % 17 == 0 else " ".join(random.choice("abc") for _ in range(random.choice([0, 5, 19, 20, 21, 60, 300])))) for i in range(200)]
    rows += [(300 + i, "x " * 100) for i in range(40)] + [(500, ODD[5])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit(1), "n_words": F.lit("z"), "ord": F.lit(0)}).repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert got == brute_repeats(rows, 20)
    assert "ord" in substrings.deduplicate(df).columns
    assert substrings.digest(spark.createDataFrame([], DOCS)).isEmpty()
    long = " ".join(f"w{i}" for i in range(30))
    twice = substrings.digest(spark.createDataFrame([(1, long), (1, long), (None, long), (2, "q " + long)], DOCS)).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in twice) == [(1, 0), (1, 0), (2, 30), (99, 30)]


def test_equal_halves_of_a_hash_remove_nothing():
    """Windows around one anchor are told apart by 64 bits and more: equal upper or lower halves are no repeat."""
    import pyarrow as pa

    base = np.uint64(0x123456789ABCDEF0)
    for other in (base ^ np.uint64(1), base ^ np.uint64(1 << 63), base):
        leaves = [bytes([3]) + np.array([x], "<u8").tobytes() for x in (base, other)]
        batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([1, 2]), pa.array([0, 0]), pa.array(leaves, pa.binary())], names=["g", "ord", "at", "leaves"])
        removed = sum(out.num_rows for out in substrings._read_groups([batch]))
        assert removed == (other == base)


def test_hot_anchors_spread(spark, monkeypatch):
    """A phrase in many documents, with different words around it, is not one group, and results stay the same."""
    import pyarrow as pa

    random.seed(8)
    phrase = min((f"the same six words stand here{i}" for i in range(300)), key=lambda p: substrings._rolled(hash_words([p])[0], 6, 1)[0])
    texts = [" ".join([*(f"w{random.randrange(10**9)}" for _ in range(25)), phrase, *(f"w{random.randrange(10**9)}" for _ in range(25))]) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    hot = substrings.hot_slots(df, 20, 6, 200)

    def groups(hot):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["ord", "text"])
        sizes = Counter()
        for out in substrings._file(20, 6, hot)([batch]):
            for g, leaves in zip(out.column(0).to_pylist(), out.column(3).to_pylist()):
                sizes[g] += max(0, len(leaves) - 1) // 8
        return max(sizes.values())

    assert len(hot) and groups(np.zeros(0, np.int64)) > 200 >= groups(hot)
    monkeypatch.setattr(substrings, "HOT_SUFFIXES", 200)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert got == brute_repeats(rows, 20)
    monkeypatch.setattr(substrings, "HOT_SUFFIXES", 0)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert got == brute_repeats(rows, 20)


def test_suffix_records_in_small_blocks():
    """Blocks and batches of any size give what one block gives."""
    import pyarrow as pa

    random.seed(3)
    rows = [(i, " ".join(random.choice("ab") for _ in range(60))) for i in range(60)]
    before = substrings.BLOCK_WORDS
    substrings.BLOCK_WORDS = 200
    try:
        batches = list(substrings._file(20, 6)(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["ord", "text"])])))
    finally:
        substrings.BLOCK_WORDS = before
    table = pa.Table.from_batches(batches).sort_by([("g", "ascending"), ("ord", "ascending"), ("at", "ascending")]).combine_chunks()
    starts = set()
    for b in substrings._read_groups(table.to_batches(max_chunksize=37)):
        for order, at, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            starts |= {(order, (at & 0xFFFFFFFF) + j) for j in range(n)}
    seen, expected = {}, set()
    for doc_id, text in rows:
        words = text.split()
        for i in range(41):
            if seen.setdefault(tuple(words[i : i + 20]), (doc_id, i)) != (doc_id, i):
                expected.add((doc_id, i))
    assert starts == expected


def brute_secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets(spark):
    random.seed(4)
    parts = ["token", "SECRET", "api_key", "apikey", "passwd", '"', "'", ":", "=", " ", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "é", "\n", "ſecret", "K"]
    texts = ODD + ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(800)]
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        base = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("novel")] == base
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    novel = spark.createDataFrame([(1, "my credential is Zk3v9Qx7Lm2Tr8Wy5Bn4Hd6 ok"), (2, "credential configuration_settings_environment_production1 and more")], DOCS)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(novel).collect()}
    assert got[1] == "novel:17:40" and got[2] == ""
    clean = spark.createDataFrame([(1, 'x token = "0123456789abcdef0123456789abcdef" y', 9), (2, None, 0)], "doc_id long, text string, n_chars int")
    assert [(r["text"], r["n_chars"]) for r in secrets.redact(clean).orderBy("doc_id").collect()] == [('x [REDACTED]" y', 15), (None, None)]


def test_language_id(spark):
    random.seed(5)
    kinds = {"aa": ["bala", "lam", "abal"], "bb": ["ikit", "tiki", "tik"], "cc": ["ñoñu", "uñó"]}
    rows = [(i, " ".join(random.choice(kinds[k]) for _ in range(30)), k) for i in range(120) for k in [random.choice(list(kinds))]]
    rows += [(900, None, "aa"), (901, "123 --", "aa"), (902, "bala", None), (903, "", "bb"), (904, "漢字", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    trees = langid.fit(df, ~held_out("doc_id", 3))
    got = {r["doc_id"]: r for r in langid.predict(df, trees).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3 and got[902]["lang_pred"] == "aa" and got[904]["lang_pred"] in kinds
    nothing = langid.fit(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), trees).isEmpty()
    long = langid.predict(spark.createDataFrame([(1, "bala lam " * 100_000), (1, "bala")], DOCS), trees).collect()
    assert [r["lang_pred"] for r in long] == ["aa", "aa"]


def brute_code(samples, text):
    """Bits of a text by a plain context tree: counts in dictionaries, method C."""
    counts = [{} for _ in range(4)]
    for sample in samples:
        data = bytes(3) + sample
        for i in range(3, len(data)):
            for order in range(4):
                own = counts[order].setdefault(data[i - order : i], Counter())
                own[data[i]] += 1

    def p(order, context, byte):
        if order < 0:
            return 1 / 256
        lower = p(order - 1, context[1:], byte)
        own = counts[order].get(context)
        return (own[byte] + len(own) * lower) / (own.total() + len(own)) if own else lower

    data = bytes(3) + text
    return -sum(math.log2(p(3, data[i - 3 : i], data[i])) for i in range(3, len(data)))


def test_language_codes_are_those_of_a_plain_tree():
    random.seed(8)
    samples = {"aa": [b"bala lam abal", b"lam\x00 la", b""], "bb": ["ñoñu uñó".encode(), b"tik tiki"]}
    texts = [b"", b"b", b"bala", "lam ñoñ".encode(), bytes(range(256)), *(bytes(random.choice(b"balm tiko") for _ in range(90)) for _ in range(20))]
    trees = langid.grow(samples)
    for block in (7, 1 << 18):
        got = trees.many(texts, block)
        assert np.allclose(got, [[brute_code(samples[x], t) for x in trees.languages] for t in texts], rtol=1e-4)


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(6)
    rows = [(i, " ".join(random.choice(["la", "lo", "li"] if i % 2 else ["ka", "ko", "Ki"]) for _ in range(40)) + (f" rare{i}" if i % 3 else "")) for i in range(200)] + [(500, None), (501, ""), (502, "la")]
    df = spark.createDataFrame(rows, DOCS)
    return rows, pitman_yor.score(df, held_out("doc_id", 5)).toPandas().set_index("doc_id")


def test_lm_scores_do_not_depend_on_settings(spark, scored, monkeypatch):
    """Neither shuffle partitions nor the parts in which requests are dealt change a score."""
    rows, expected = scored
    monkeypatch.setattr(pitman_yor, "PART_TEXT", 1 << 13)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = pitman_yor.score(spark.createDataFrame(rows, DOCS), held_out("doc_id", 5)).toPandas().set_index("doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(got.score.sort_index(), expected.score.sort_index(), rtol=1e-6)


def test_lm_base(scored):
    rows, got = scored
    tokens = {i: [*words_of(t, lower=True), b"\n"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i in tokens if not out[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, words in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
    held = got[got.held_out]
    assert (held.score > held.base_score).mean() > 0.95 and (got.score < 0).all()


def test_lm_is_a_distribution():
    """After any context, known words and the unknown class sum to one."""
    rng = np.random.default_rng(0)
    own = pitman_yor.Shard([pitman_yor._pack(np.cumsum(rng.integers(1, 9, 50)).astype("u8"), np.full(50, 4, np.uint16), np.tile(np.array([3, 70, 71, 900], np.uint16), 50), rng.integers(0, 30, 200).astype(np.uint32))])
    t2, c1, t1, c0, t0 = next(own.seatings(1, 1.0))
    assert (t2 <= own.c2).all() and (t2[own.c2 > 0] > 0).all() and c1.sum() == t2.sum() and c0.sum() == t1.sum()
    d, s = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    root = np.append((c0 - d[0] * t0) / (s[0] + c0.sum()), (s[0] + d[0] * t0.sum()) / (s[0] + c0.sum()))
    assert math.isclose(root.sum(), 1)
    for rest in (3, 70):
        last = rest // pitman_yor.PAIR_SLOTS
        p1 = root * (s[1] + d[1] * t1[own.rest1 == last].sum()) / (s[1] + c1[own.rest1 == last].sum())
        np.add.at(p1, own.up0[own.rest1 == last], ((c1 - d[1] * t1) / (s[1] + c1[own.rest1 == last].sum()))[own.rest1 == last])
        assert math.isclose(p1.sum(), 1)


def test_lm_gibberish_is_unlikely(spark):
    """Words that training never saw score far below text of its kind, a token, and below the known words of any order."""
    random.seed(7)
    words = ["la", "lo", "li", "ka", "ko", "ki", *(f"w{i}" for i in range(200))]
    rows = [(i, " ".join(random.choices(words, [1 / (k + 1) for k in range(len(words))], k=60))) for i in range(300)] + [(1000, " ".join(f"zz{i}qx" for i in range(60)))]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in pitman_yor.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") >= 290).where("held_out").collect()}
    assert got[1000] < min(s for i, s in got.items() if i < 1000) - 0.5


def test_seating_follows_its_process():
    """The number of tables has the distribution of seating customers one by one, below and above the switch of the sampler."""
    rng = np.random.default_rng(3)
    for n, d, w in ((10, 0.8, 0.7), (60, 0.8, 2.5), (400, 0.75, 0.2)):
        p = {1: 1.0}  # exact: tables after each customer
        for seated in range(1, n):
            new: dict = {}
            for t, q in p.items():
                o = w / (w + seated - d * t)
                new[t + 1] = new.get(t + 1, 0) + q * o
                new[t] = new.get(t, 0) + q * (1 - o)
            p = new
        mean = sum(t * q for t, q in p.items())
        sd = math.sqrt(sum((t - mean) ** 2 * q for t, q in p.items()))
        got = pitman_yor._seat(rng, np.full(20000, n), d, np.full(20000, w))
        assert abs(got.mean() - mean) < 5 * sd / math.sqrt(20000) and abs(got.std() - sd) < 0.05 * sd + 0.01
        assert abs((got == 1).mean() - p[1]) < 0.02


def test_lm_without_training(spark):
    assert pitman_yor.score(spark.createDataFrame([], DOCS), held_out("doc_id", 5)).isEmpty()
    got = pitman_yor.score(spark.createDataFrame([(1, "a b")], DOCS), F.lit(True)).first()
    assert (got["n_known"], got["train_tokens"]) == (0, 0) and abs(got["score"]) < 1e-6


def test_lm_contexts_are_words(spark):
    """Words with the same two last letters are contexts of their own, and so are any number of them."""
    rows = [(i, f"{'xq' if i % 2 else 'yq'}{i // 2 % 50}aba {'left' if i % 2 else 'right'}") for i in range(4000)] + [(5000, "xq7aba left"), (5001, "xq7aba right"), (5002, "yq7aba right")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") >= 5000).where("held_out").collect()}
    assert got[5000] > got[5001] + 0.5 and got[5002] > got[5001] + 0.5


def test_lm_words_are_a_distribution():
    """After any word, known words and the unknown class sum to one."""
    rng = np.random.default_rng(0)
    contexts = pitman_yor._context_ids(rng.integers(0, 1 << 63, 6).astype(np.uint64), np.array([3, 3, 70, 71, 900, 3]))
    count = rng.integers(0, 30, 300).astype(np.uint32)
    own = pitman_yor.WordShard([pitman_yor._pack(np.cumsum(rng.integers(1, 9, 50)).astype("u8"), np.full(50, 6, np.uint32), *pitman_yor._planes(np.tile(contexts, 50)), count)] * 2)
    assert own.c3.sum() == 2 * count.sum() and len(own.contexts) == 6 and own.count.sum() == own.c3.sum()
    kinds = own.by_context(np.ones(len(own.c3)))
    samples = list(own.word_seatings(1, 1.0, kinds))
    assert len(samples) == pitman_yor.SAMPLES
    d, s = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    for t3, c2, t2, c1, t1, c0, t0 in samples:
        assert (t3 <= own.c3).all() and (t3 > 0).all() and c2.sum() == t3.sum() and c1.sum() == t2.sum() and c0.sum() == t1.sum()
        p = np.append((c0 - d[0] * t0) / (s[0] + c0.sum()), (s[0] + d[0] * t0.sum()) / (s[0] + c0.sum()))
        context = 0
        rest = int(own.contexts[context]) % pitman_yor.RESTAURANTS
        one, two, three = own.rest1 == rest // pitman_yor.PAIR_SLOTS, own.rest2 == rest, own.context3 == context
        for v, at, c, t, word in ((1, one, c1, t1, own.up0), (2, two, c2, t2, own.up0[own.up1]), (3, three, own.c3, t3, own.up0[own.up1[own.up2]])):
            p = p * (s[v] + d[v] * t[at].sum()) / (s[v] + c[at].sum())
            np.add.at(p, word[at], ((c - d[v] * t) / (s[v] + c[at].sum()))[at])
            assert math.isclose(p.sum(), 1)
