"""Words that polynomial hashes cannot tell apart."""

from taxonaut.llm import jaccard, substrings
from taxonaut.llm.common import hash_words

DOCS = "doc_id long, text string"


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def twins(n):
    return thue_morse(n), thue_morse(n, "ba")


def test_words_of_thue_and_morse_have_hashes_of_their_own():
    words = [w for n in (512, 1024, 2048, 4096, 8192) for w in twins(n)] + ["a" * 64, "a" * 65, "a" * 63 + "b", "a" * 64 + "b", "a" * 64 + "c"]
    for lower in (False, True):
        assert len(set(hash_words([" ".join(words)], lower)[0].tolist())) == len(words)
    assert hash_words(["A" * 70 + "É"], True)[0] == hash_words(["a" * 70 + "É"], True)[0]


def test_different_words_neither_repeat_nor_link(spark):
    head = " ".join(f"w{i}" for i in range(19))
    for n in (1024, 2048):
        one, two = twins(n)
        rows = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")], DOCS)
        assert {r["doc_id"]: r["n_removed"] for r in substrings.digest(rows).collect()} == {1: 0, 2: 0, 3: 20}
        rows = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], DOCS)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(rows, k=4, num=85, den=100).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_block_is_encoded_in_little_memory():
    """Peak of the arrays beside a block, at most 15 times 4 bytes a token (measured: 7; 20 before)."""
    import tracemalloc

    import numpy as np

    from taxonaut.llm import pitman_yor

    random, words = np.random.default_rng(3), pitman_yor.Vocabulary()
    for i in range(1000):
        words[b"w%d" % i]
    block = [(d, d % 5 != 1, random.integers(0, 1000, 500).astype(np.int32)) for d in range(600)]
    tracemalloc.start()
    try:
        for _ in pitman_yor._encode_block(block, words, 4, 0):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * 4 * 300_000
