"""Spelling variants by permuterm rotations.

A word is marked by a terminator and rotated: w[i:] + mark + w[:i]. All words that a single edit
at one place leads to stand together in the sorted rotations: what replaces or
drops w[i] shares the prefix w[i+1:] + mark + w[:i], which is the rotation after w[i] without its last character, and
for a word of one character less it is a whole rotation. So rotations are grouped by the prefix that skips the edited
character. Members of a group that skip a character differ in that character alone (replacements), and the one member
that is whole lacks it (insertion or deletion). A group has as many members as the alphabet has characters, plus one.
A run of equal characters gives one word by each deletion; only the first of a run counts, so every pair of near words
meets once as replacement or once as insertion, and counts are sums.

Groups emit one row a member (how many neighbours, the best of them), never pairs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.llm.common import cut

# Fixed values of the contract: what a run of letters is, and how runs are damaged.
LETTERS = r"A-Za-zÀ-ÿ"
DAMAGE = 31
MARK = "\x00"


def occurrences(docs: DataFrame, least_length: int = 7, damage: int = DAMAGE) -> DataFrame:
    """(word, n = 1) for each maximal run of letters of the whole texts of (doc_id, text), A-Z as small letters.

    Where `damage` divides h, the crc32 of "doc_id:run", the run loses its code point h % length. Results
    of fewer than `least_length` code points are left out. Null texts have no runs; a null doc_id stands as an empty string.
    """
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    run = found.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = run.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"), F.length("run").alias("length"))
    at = (F.col("h") % F.col("length")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length")))
    return hashed.select(F.when(F.col("h") % damage == 0, damaged).otherwise(F.col("run")).alias("word"), F.lit(1).cast("long").alias("n")).where(F.length("word") >= least_length)


def _rotations(word: Column) -> Column:
    """(prefix, skips, first): skips is false for whole rotations; first tells whether the skipped character begins a run of its like."""
    size = F.length(word)
    after = lambda i: F.substring(word, i + 1, size)
    before = lambda i: F.substring(word, F.lit(1), i)
    part = lambda prefix, skips, first: F.struct(prefix.alias("prefix"), skips.alias("skips"), first.alias("first"))
    letter = lambda i: F.substring(word, i + 1, F.lit(1))
    skipping = F.transform(F.sequence(F.lit(0), size - 1), lambda i: part(F.concat(after(i + 1), F.lit(MARK), before(i)), F.lit(True), (i == 0) | (letter(i) != letter(i - 1))))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: part(F.concat(after(i), F.lit(MARK), before(i)), F.lit(False), F.lit(False)))
    return F.concat(skipping, whole)


def near(words: DataFrame) -> DataFrame:
    """Of unique (word, n): (word, n_near, best) for words with a near word; best (minus, word) is that of largest n, of equal ones the smallest in code-point order."""
    turned = words.select("word", "n", F.explode(_rotations(F.col("word"))).alias("r")).select("r.*", F.struct((-F.col("n")).alias("minus"), "word").alias("own"))
    groups = turned.groupBy("prefix").agg(
        F.array_sort(F.collect_list(F.when(F.col("skips"), F.struct("own.minus", "own.word", "first")))).alias("skipping"),
        F.min(F.when(~F.col("skips"), F.col("own"))).alias("whole"),
        F.count("*").alias("members"),
    ).where("members > 1")
    bare = lambda m: F.struct(m["minus"].alias("minus"), m["word"].alias("word"))
    whole, skipping = F.col("whole"), F.col("skipping")
    other = lambda k: F.get(skipping, F.when(k == 0, 1).otherwise(0))
    none = F.lit(None).cast("struct<minus:bigint,word:string>")

    def member(m: Column, k: Column) -> Column:
        meets = m["first"] & whole.isNotNull()
        replaced = F.when(F.size(skipping) > 1, bare(other(k))).otherwise(none)
        return F.struct(m["word"].alias("word"), (F.size(skipping) - 1 + meets.cast("int")).cast("long").alias("n"), F.least(replaced, F.when(meets, whole).otherwise(none)).alias("best"))

    longer = F.filter(skipping, lambda m: m["first"])
    shorter = F.struct(whole["word"].alias("word"), F.size(longer).cast("long").alias("n"), F.when(F.size(longer) > 0, bare(F.get(longer, F.lit(0)))).otherwise(none).alias("best"))
    members = F.concat(F.transform(skipping, member), F.when(whole.isNotNull(), F.array(shorter)).otherwise(F.array().cast("array<struct<word:string,n:bigint,best:struct<minus:bigint,word:string>>>")))
    return groups.select(F.explode(members).alias("m")).where("m.n > 0").groupBy("m.word").agg(F.sum("m.n").alias("n_near"), F.min("m.best").alias("best"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root): the end of the chain word -> form -> ... that starts at each word of (word, form). Chains double their step each round; only a count a round reaches the driver."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def variants(rows: DataFrame, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n) rows; repeated words add up.

    Words are kept from `least_count` occurrences on. form is the near word (one code point inserted, deleted or
    replaced) of largest n, ties to the smallest in code-point order, if its n is at least `ratio` times the word's,
    else null; root follows forms to the last and is the word itself without a form. Null and empty words are left out;
    words that hold the terminator U+0000 have no near words. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms may go round")
    words = cut(rows.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    found = words.join(near(words.where(~F.contains("word", F.lit(MARK)))), "word", "left")
    best_n = -F.col("best.minus")
    takes = best_n >= F.col("n") * ratio
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, best_n).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
