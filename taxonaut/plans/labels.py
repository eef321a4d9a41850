"""Queries: normalisation, preprocessing, resolution, standards, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxonaut.functions import arrays, ids, text
from taxonaut.operators import corpus, ordered, preprocess, profile, ranges, resolve, scoring, splits, standards
from taxonaut.plans.tables import CONFIG, RECORDS, REGISTRY, RESOLVED, query, records, registry, sql_clean, sql_compact, table

CODE = r"[A-Za-z]+\p{Nd}*(?:-\p{Nd}+)*"
TRAIL = rf"\s*[\(\[（【]\s*({CODE})\s*[\)\]）】]\s*$"


def _resolved(spark, sf_dir):
    return resolve.canonical(records(spark, sf_dir), CONFIG, registry(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT resolution_status, CAST(count(*) AS BIGINT) AS n FROM resolved GROUP BY 1")
def resolution_status_counts(spark, sf_dir):
    return resolve.status_counts(_resolved(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT id, level_4 AS leaf_name, category_id, level_1 || '>' || level_2 || '>' || level_4 AS path FROM resolved WHERE resolution_status = 'resolved'")
def resolved_targets(spark, sf_dir):
    t = F.col("target")
    return _resolved(spark, sf_dir).where(t.isNotNull()).select("id", t["leaf_name"].alias("leaf_name"), t["category_id"].alias("category_id"), F.array_join(t["category_path"], ">").alias("path"))


@query(f"WITH {RESOLVED} SELECT level_4 AS leaf, CAST(count(*) AS BIGINT) AS n FROM resolved WHERE resolution_status = 'missing_leaf' GROUP BY 1")
def missing_leaf_by_name(spark, sf_dir):
    return _resolved(spark, sf_dir).where("resolution_status = 'missing_leaf'").groupBy("leaf").agg(F.count("*").alias("n"))


@query(f"WITH {RESOLVED} SELECT category_id, CAST(count(*) AS BIGINT) AS n FROM resolved WHERE resolution_status = 'path_mismatch' GROUP BY 1")
def path_mismatch_by_id(spark, sf_dir):
    return _resolved(spark, sf_dir).where("resolution_status = 'path_mismatch'").groupBy("category_id").agg(F.count("*").alias("n"))


@query(f"""WITH {RESOLVED}, c AS (SELECT count(*) FILTER (resolution_status = 'resolved') AS covered,
  count(*) FILTER (resolution_status IN ('missing_leaf', 'path_mismatch')) AS uncovered,
  count(*) FILTER (resolution_status IN ('unlabeled', 'placeholder', 'invalid_record')) AS skipped FROM resolved)
  SELECT *, CAST(covered AS DOUBLE) / CAST(covered + uncovered AS DOUBLE) AS rate FROM c""")
def id_coverage(spark, sf_dir):
    return resolve.coverage(_resolved(spark, sf_dir))


def _code_map(spark, sf_dir):
    label = F.concat("n_name", F.lit("（A"), F.col("n_nationkey").cast("string"), F.lit("-1）"))
    return table(spark, sf_dir, "nation").where(F.col("n_regionkey") < 4).select(text.strip_code(label).alias("name"), text.extract_code(label).alias("code"))


@query("""SELECT CASE WHEN n_regionkey < 4 THEN 'A' || n_nationkey || '-1' END AS category_id, CASE WHEN n_regionkey < 4 THEN 'resolved' ELSE 'code_unresolved' END AS resolution_status,
  CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def code_lookup(spark, sf_dir):
    config = resolve.DatasetConfig("customer", path_fields=("level_4",), id_strategy="code")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("labeled").alias("label_status"), F.col("n_name").alias("level_4"))
    return resolve.resolve(rows, config, _code_map(spark, sf_dir)).groupBy("category_id", "resolution_status").agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, CAST(count(DISTINCT p_brand) AS BIGINT) AS n_codes FROM part WHERE p_size > 45 GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ambiguous_codes(spark, sf_dir):
    return resolve.ambiguous_codes(table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_name").alias("name"), F.col("p_brand").alias("code")))


_SPACES = ("", "\u3000", "\u00a0", "\t", "\n", "\u2028")


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'unlabeled' WHEN 1 THEN 'invalid_record' WHEN 2 THEN 'placeholder' ELSE 'resolved' END AS resolution_status,
  CASE WHEN p_partkey % 7 = 1 THEN p_brand ELSE p_brand || '>' || CASE WHEN p_partkey % 7 = 2 THEN 'none' ELSE p_name END END AS path FROM part""")
def white_space_of_labels(spark, sf_dir):
    """Leaves, placeholders, flags and paths between white space of every kind."""
    space = F.get(F.array(*[F.lit(x) for x in _SPACES]), F.col("p_partkey") % len(_SPACES))
    around = lambda x: F.concat(space, x, space)
    kind = F.col("p_partkey") % 7
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind == 0, around(F.lit("Unlabeled"))).otherwise("labeled").alias("label_status"), around(F.col("p_brand")).alias("level_1"),
        F.when(kind == 1, space).when(kind == 2, around(F.lit("none"))).otherwise(around(F.col("p_name"))).alias("level_2"),
    )
    config = resolve.DatasetConfig("d", path_fields=("level_1", "level_2"), leaf_level="level_2", placeholders=("none",))
    found = resolve.resolve(rows, config)
    return found.select("p_partkey", "resolution_status", F.array_join(arrays.dedupe_path(F.concat("category_path", F.array("level_2"))), ">").alias("path"))


@query(f"SELECT doc_id, CAST(length({sql_clean('text')}) AS BIGINT) AS n_chars, sha256({sql_clean('text')}) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    x = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("n_chars"), F.sha2(x, 256).alias("cleaned"))


@query(f"SELECT doc_id, CAST(length({sql_compact('text')}) AS BIGINT) AS n_chars, sha256({sql_compact('text')}) AS compacted FROM documents")
def compact_text(spark, sf_dir):
    x = text.compact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("n_chars"), F.sha2(x, 256).alias("compacted"))


_BRACKETS = (("（", "）"), ("(", ")"), ("[", "]"), ("【", "】"), (" （ ", " ） "))


def _coded(spark, sf_dir):
    """Supplier names with a code in one of several brackets."""
    pick = F.col("s_suppkey") % len(_BRACKETS)
    label = F.lit(None).cast("string")
    for i, (a, b) in enumerate(_BRACKETS):
        label = F.when(pick == i, F.concat("s_name", F.lit(a + "B"), F.col("s_nationkey").cast("string"), F.lit("-2" + b))).otherwise(label)
    return table(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"))


_CODED = "coded AS (SELECT s_suppkey, s_name, s_nationkey, CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN s_name || '{a}B' || s_nationkey || '-2{b}'" for i, (a, b) in enumerate(_BRACKETS)) + " END AS label FROM supplier)"


@query(f"WITH {_CODED} SELECT s_suppkey, trim(regexp_replace(label, '{TRAIL}', '')) AS name, regexp_extract(label, '{TRAIL}', 1) AS code FROM coded")
def strip_and_extract_code(spark, sf_dir):
    return _coded(spark, sf_dir).select("s_suppkey", text.strip_code(F.col("label")).alias("name"), text.extract_code(F.col("label")).alias("code"))


@query(f"WITH {_CODED} SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN s_name ELSE label END AS name FROM (SELECT s_suppkey, s_nationkey, s_name, 'C' || s_nationkey AS label FROM coded)")
def split_code(spark, sf_dir):
    name, key = F.col("s_name"), F.col("s_nationkey").cast("string")
    raw = F.when(F.col("s_nationkey") < 10, F.concat(F.lit(" A1-1: "), name)).otherwise(F.concat(F.lit("C"), key, F.lit(" (D"), key, F.lit(")")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.split_code(raw)["name"].alias("name"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("name"))


_TYPES = (("VARCHAR2(32)", "STRING"), ("bigint unsigned", "INTEGER"), (" Number (10,2)", "DECIMAL"), ("geometry(point)", "GEOMETRY(POINT)"), ("", ""), ("DateTime", "DATETIME"), ("double precision", "FLOAT"), ("json", "JSON"))


@query("SELECT p_partkey, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_TYPES)) + " END AS family FROM part")
def normalize_type(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(a) for a, _ in _TYPES]), F.col("p_size") % 8)
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_type(raw).alias("family"))


_LEVELS = (("1", "L1", "1"), ("level2", "L2", "level2"), (" l3 ", "L3", "l3"), ("", None, ""), ("4级", "L4", "4级"), ("3 4", None, "3 4"), ("L4", "L4", "L4"))


@query("SELECT p_partkey, CASE p_size % 7 " + " ".join(f"WHEN {i} THEN {repr(b) if b else 'NULL'}" for i, (_, b, _) in enumerate(_LEVELS)) + " END AS level, CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, c) in enumerate(_LEVELS)) + " END AS raw FROM part")
def standard_level(spark, sf_dir):
    found = text.standard_level(F.get(F.array(*[F.lit(a) for a, _, _ in _LEVELS]), F.col("p_size") % 7))
    return table(spark, sf_dir, "part").select("p_partkey", found["level"].alias("level"), found["raw"].alias("raw"))


@query(f"WITH {RECORDS} SELECT id, data_level AS level FROM records")
def normalize_level(spark, sf_dir):
    return records(spark, sf_dir).select("id", text.normalize_level(F.concat(F.lit(" level"), F.substring("data_level", 2, 1))).alias("level"))


@query("""WITH s AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('part.csv' || chr(31) || p_brand || chr(31) || p_type || chr(31) || p_partkey)) AS h FROM part)
  SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS record_id FROM s""")
def record_id_uuid5(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.record_id(F.lit("Part.CSV"), F.col("p_brand"), F.col("p_type"), F.col("p_partkey")).alias("record_id"))


@query("SELECT doc_id, source || '-' || substr(sha256(source || chr(31) || lang || chr(31) || text), 1, 24) AS document_id FROM documents")
def document_id_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.document_id(F.col("source"), F.col("lang"), F.col("text")).alias("document_id"))


_MAPPING = {"p_brand": "table_name", "p_name": "field_name", "p_type": "level_1", "p_partkey": "field_description"}


@query("SELECT '' AS database_name, '' AS database_description, p_brand AS table_name, '' AS table_description, p_name AS field_name, CAST(p_partkey AS VARCHAR) AS field_description, '' AS field_type, p_type AS level_1, '' AS level_2, '' AS level_3, '' AS level_4, '' AS data_level FROM part")
def convert_schema(spark, sf_dir):
    return preprocess.normalize(preprocess.convert_schema(table(spark, sf_dir, "part"), _MAPPING))


@query("SELECT p_brand, p_name, CAST(count(DISTINCT p_type) AS BIGINT) AS n_labels, CAST(count(*) AS BIGINT) AS n_rows FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1")
def label_conflicts(spark, sf_dir):
    return preprocess.conflicts(table(spark, sf_dir, "part"), ["p_brand", "p_name"], ["p_type"])


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, first(n_chars ORDER BY doc_id) AS n_chars FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "n_chars")
    return preprocess.keep_first(keyed, ["digest"], "doc_id")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand, p_name ORDER BY p_partkey) AS rn FROM part)
  SELECT p_type, p_brand, p_name, p_partkey FROM f WHERE rn = 1""")
def first_labelled_part(spark, sf_dir):
    return preprocess.keep_first(table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", "p_partkey"), ["p_type", "p_brand", "p_name"], "p_partkey")


@query("SELECT p_brand, p_name, first(p_type ORDER BY p_partkey) AS description, array_to_string(list(p_type ORDER BY p_partkey)[2:], ',') AS descriptions, CAST(count(*) - 1 AS BIGINT) AS extra FROM part GROUP BY 1, 2")
def aggregate_categories(spark, sf_dir):
    """One row a category, as its result asks for: texts of chunks put together in order."""
    found = corpus.aggregate_categories(table(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_partkey", "p_type").withColumn("said", F.array_join("descriptions", ","))
    whole = found.groupBy("p_brand", "p_name").agg(F.max("description").alias("description"), F.array_sort(F.collect_list(F.when(F.size("descriptions") > 0, F.struct("chunk", "said")))).alias("said"), F.max("extra").alias("extra"))
    return whole.select("p_brand", "p_name", "description", F.array_join(F.transform("said", lambda x: x["said"]), ",").alias("descriptions"), "extra")


HOT_CHUNK = 50


@query(f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'hot' WHEN p_partkey % 31 = 1 THEN NULL ELSE p_brand END AS category, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS said FROM part),
  n AS (SELECT category, said, row_number() OVER (PARTITION BY category ORDER BY p_partkey) - 1 AS spot, count(*) OVER (PARTITION BY category) - 1 AS extra FROM p)
  SELECT category, (spot // {HOT_CHUNK})::INT AS chunk, max(said) FILTER (spot = 0) AS description, coalesce(string_agg(said, ',' ORDER BY spot) FILTER (spot > 0 AND said <> ''), '') AS descriptions, CAST(max(extra) AS BIGINT) AS extra FROM n GROUP BY 1, 2""")
def hot_category_chunks(spark, sf_dir):
    """Categories of which one holds half of the rows, in rows of at most HOT_CHUNK descriptions."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, F.when(key % 2 == 0, "hot").when(key % 31 == 1, F.lit(None)).otherwise(F.col("p_brand")).alias("category"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("said"))
    return corpus.aggregate_categories(rows, ["category"], "p_partkey", "said", HOT_CHUNK).withColumn("descriptions", F.array_join("descriptions", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey % 3 = 0, l_returnflag ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice) - 1 AS BIGINT) AS position, CAST(count(*) OVER (PARTITION BY l_orderkey % 3 = 0, l_returnflag) AS BIGINT) AS total FROM lineitem")
def positions_within_hot_keys(spark, sf_dir):
    """Places of all lines within six keys of any size."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_orderkey") % 3 == 0).alias("third"), "l_returnflag")
    placed = ordered.numbered(lines, ["third", "l_returnflag"], ["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"])
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "position", "total")


@query(f"""WITH g AS (SELECT doc_id, source AS label, {sql_clean('text')} AS content FROM documents WHERE {sql_clean('text')} <> '')
  SELECT doc_id, label, 'guide-' || substr(sha256('guide' || chr(31) || label || chr(31) || content), 1, 24) AS document_id, min(doc_id) OVER (PARTITION BY label, content) AS first_row FROM g""")
def corpus_documents(spark, sf_dir):
    return corpus.documents(table(spark, sf_dir, "documents"), "guide", "doc_id", "source", "text")


@query("""WITH l AS (SELECT source, count(*) AS n, min(length(text)) AS lo, max(length(text)) AS hi, sum(length(text)) AS c FROM documents GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS labels, CAST(count(*) FILTER (n > 1) AS BIGINT) AS multi_document_labels, CAST(min(lo) AS BIGINT) AS shortest, CAST(max(hi) AS BIGINT) AS longest, CAST(sum(c) AS DOUBLE) / sum(n) AS mean_length FROM l""")
def corpus_statistics(spark, sf_dir):
    return corpus.statistics(table(spark, sf_dir, "documents"), "source", "text").withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")})


@query("SELECT CAST(count(*) FILTER (l.doc_id IS NOT NULL) AS BIGINT) AS in_both, CAST(count(*) FILTER (l.doc_id IS NULL) AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def label_coverage(spark, sf_dir):
    return corpus.label_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT field, source, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'lang' AS field, source, lang AS label FROM documents UNION ALL SELECT 'long', source, CAST(n_chars > 2000 AS VARCHAR) FROM documents) GROUP BY ALL")
def split_group_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", (F.col("n_chars") > 2000).cast("string").alias("long"))
    return splits.label_report(docs, "source", ["lang", "long"])


# Of a split of whole groups: rows, groups, groups in two splits, splits in use, and whether train has between half and all of the rows.
@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT source) AS BIGINT) AS n_groups, CAST(0 AS BIGINT) AS torn, CAST(3 AS BIGINT) AS n_splits, true AS train_largest FROM documents")
def split_assignment(spark, sf_dir):
    parts = splits.split_groups(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", ["lang"])
    groups = parts.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.min("split").alias("split"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("splits") > 1).alias("torn"), F.count_distinct("split").alias("n_splits"),
        (F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0)) * 2 > F.sum("n")).alias("train_largest"),
    )


# Groups of a few lines: whole, and sizes within two groups for each label line of their share.
@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_groups, CAST(0 AS BIGINT) AS torn, CAST(3 AS BIGINT) AS n_splits, true AS in_shares FROM lineitem")
def split_small_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    groups = splits.split_groups(lines, "l_orderkey", ["l_returnflag"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.min("split").alias("split"))
    held = lambda split: F.sum(F.when(F.col("split") == split, F.col("n")).otherwise(0))
    off = [F.abs(held(s) - F.sum("n") * r) <= 8 * F.max("n") for s, r in zip(splits.SPLITS, (0.8, 0.1, 0.1))]
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("splits") > 1).alias("torn"), F.count_distinct("split").alias("n_splits"), (off[0] & off[1] & off[2]).alias("in_shares"))


# Tenths by largest remainder: what is left over goes to train first if eight tenths leave the largest remainder, to val before test on ties.
@query("""WITH n AS (SELECT count(*) AS n, count(*) * 8 % 10 AS a, count(*) % 10 AS b FROM labels),
  s AS (SELECT n, n // 10 + CASE WHEN (n - 8 * n // 10 - 2 * (n // 10)) > CASE WHEN a >= b THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS v, n // 10 + CASE WHEN (n - 8 * n // 10 - 2 * (n // 10)) > CASE WHEN a >= b THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS t FROM n),
  p AS (SELECT quality, toxic, row_number() OVER (ORDER BY CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)) - 1 AS p FROM labels),
  q AS (SELECT quality, toxic, p - p * v // n AS r, (p + 1) * v // n > p * v // n AS val, n, v, t FROM p, s)
  SELECT CASE WHEN val THEN 'val' WHEN (r + 1) * t // (n - v) > r * t // (n - v) THEN 'test' ELSE 'train' END AS split, quality, toxic, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1, 2, 3""")
def split_random(spark, sf_dir):
    return splits.split_random(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"]).groupBy("split", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT text, source FROM documents) SELECT a.source AS split_a, b.source AS split_b, CAST(count(*) AS BIGINT) AS n
  FROM t a JOIN t b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2""")
def split_overlap(spark, sf_dir):
    return splits.overlap(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "source"), "digest", "source")


@query("""SELECT 'joined' AS kind, CAST(count(*) AS BIGINT) AS n FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'outside', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def split_join_canonical(spark, sf_dir):
    parts = splits.join_canonical(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    counts = [p.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, p in zip(("joined", "orphan", "outside"), parts)]
    return counts[0].union(counts[1]).union(counts[2])


_STANDARD = f"{REGISTRY}, standard AS (SELECT category_id, level_4 AS name, list(DISTINCT 'L' || CAST((p_size + row_no) % 4 + 1 AS VARCHAR)) AS levels FROM records WHERE p_size > 10 GROUP BY 1, 2)"


def _standard(spark, sf_dir):
    rows = records(spark, sf_dir).where("p_size > 10").withColumn("grade", F.concat(F.lit("level"), ((F.col("p_size") + F.col("row_no")) % 4 + 1).cast("string")))
    entries = standards.build_entries(rows, "part", ["level_1", "level_2", "level_3", "level_4"], ["level_1", "level_2", "level_4"], "row_no", "grade")
    return standards.projection(entries.where("issue is null"))


def _samples(spark, sf_dir):
    status = resolve.resolve(records(spark, sf_dir), CONFIG)
    return status.withColumn("category_id", F.when(F.col("resolution_status") == "resolved", F.col("category_id"))).withColumnRenamed("level_4", "name")


@query(f"""WITH {_STANDARD}, b AS (SELECT CASE WHEN label_status = 'unlabeled' OR level_4 = 'red widget' THEN 'unresolved' WHEN s.category_id IS NULL THEN 'missing'
  WHEN list_contains(levels, data_level) THEN 'matched' ELSE 'mismatched' END AS bucket FROM records r LEFT JOIN standard s ON r.category_id = s.category_id) SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def align_standard(spark, sf_dir):
    return standards.align(_samples(spark, sf_dir), _standard(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_STANDARD} SELECT DISTINCT category_id FROM standard WHERE category_id NOT IN (SELECT category_id FROM records WHERE label_status = 'labeled' AND level_4 <> 'red widget' AND p_size <= 40)")
def standard_unobserved(spark, sf_dir):
    seen = _samples(spark, sf_dir).where("p_size <= 40 and category_id is not null")
    return standards.unobserved(_standard(spark, sf_dir), seen)


@query(f"""WITH {_STANDARD}, w AS (SELECT DISTINCT category_id, level_4 AS name FROM records WHERE p_size <= 10)
  SELECT w.category_id, w.name, array_to_string(list(DISTINCT s.category_id ORDER BY s.category_id), '|') AS candidates FROM w JOIN standard s ON w.name = s.name AND w.category_id <> s.category_id GROUP BY 1, 2""")
def near_by_name(spark, sf_dir):
    rows = records(spark, sf_dir).where("p_size <= 10").select(CONFIG.category_id().alias("category_id"), F.col("level_4").alias("name"))
    return standards.near_by_name(rows, _standard(spark, sf_dir)).withColumn("candidates", F.array_join("candidates", "|"))


@query(f"WITH {_STANDARD} SELECT category_id, name, array_to_string(list_sort(levels), ',') AS levels, CAST(1 AS BIGINT) AS n_entries FROM standard")
def training_projection(spark, sf_dir):
    return _standard(spark, sf_dir).select("category_id", "name", F.array_join("levels", ",").alias("levels"), F.size("entry_ids").cast("long").alias("n_entries"))


@query(f"WITH {REGISTRY}, a AS (SELECT DISTINCT category_id FROM registry), b AS (SELECT DISTINCT category_id FROM records WHERE p_size <= 40) SELECT 'left' AS side, category_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', category_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def registry_difference(spark, sf_dir):
    return standards.registry_difference(registry(spark, sf_dir), records(spark, sf_dir).where("p_size <= 40").select(CONFIG.category_id().alias("category_id")))


_CELLS = "cells AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), ranges AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


def _cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ranges = lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))
    return standards.merged_cells(lines.select("l_orderkey", "l_linenumber").distinct(), ranges, ["l_orderkey"], "l_linenumber")


@query(f"WITH {_CELLS} SELECT c.l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN a AND b THEN a ELSE l_linenumber END AS anchor, coalesce(l_linenumber BETWEEN a AND b AND a <> l_linenumber, false) AS inherited FROM cells c LEFT JOIN ranges r ON c.l_orderkey = r.l_orderkey")
def merged_range_lookup(spark, sf_dir):
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", "anchor", "inherited")


@query("""WITH d AS (SELECT l_partkey, l_quantity, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem),
  b AS (SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN -500000 ELSE 9131 + 2 * s_suppkey END AS d1, CASE WHEN s_suppkey = 7 THEN 500000 ELSE 9131 + 2 * s_suppkey + s_suppkey % 40 END AS d2,
    s_suppkey * 19 % 2000 AS p1, s_suppkey * 19 % 2000 + CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 7 - 3 ELSE 1000 END AS p2 FROM supplier)
  SELECT s_suppkey, CAST(count(*) AS BIGINT) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(min(day) AS BIGINT) AS first_day, CAST(max(l_partkey) AS BIGINT) AS last_part FROM d JOIN b ON day BETWEEN d1 AND d2 AND l_partkey BETWEEN p1 AND p2 GROUP BY 1""")
def lines_in_boxes(spark, sf_dir):
    """Lines inside each supplier's span of days and parts; one span is a million days wide, some are a single part, some end before they start."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day"))
    k = F.col("s_suppkey")
    start, part = F.lit(9131) + k * 2, k * 19 % 2000
    boxes = table(spark, sf_dir, "supplier").select(
        k, F.when(k == 7, -500_000).otherwise(start).alias("d1"), F.when(k == 7, 500_000).otherwise(start + k % 40).alias("d2"), part.alias("p1"), (part + F.when(k % 5 == 0, k % 7 - 3).otherwise(1000)).alias("p2")
    )
    found = ranges.within(lines, boxes, [("day", "d1", "d2"), ("l_partkey", "p1", "p2")])
    return found.groupBy("s_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.min("day").alias("first_day"), F.max("l_partkey").alias("last_part"))


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber) AS start_row, max(l_linenumber) AS end_row, first(l_partkey ORDER BY l_linenumber, l_partkey) AS first_member, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS members FROM lineitem GROUP BY 1, 2")
def scoped_annotations(spark, sf_dir):
    found = standards.annotations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber", "l_partkey")
    return found.drop("chunk").withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


def _holey(spark, sf_dir):
    return records(spark, sf_dir).withColumns({"level_2": F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("level_2")), "level_4": F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("level_4"))})


_HOLEY = "holey AS (SELECT level_1, CASE WHEN p_size % 5 = 0 THEN '' ELSE level_2 END AS level_2, '' AS level_3, CASE WHEN p_size % 7 = 0 THEN '' ELSE level_4 END AS level_4 FROM records)"
_FIELDS = ["level_1", "level_2", "level_3", "level_4"]


@query(f"WITH {RECORDS}, {_HOLEY} " + " UNION ALL ".join(f"SELECT '{f}' AS level, CAST(count(*) FILTER ({f} <> '') AS BIGINT) AS filled, CAST(count(*) FILTER ({f} <> '') AS DOUBLE) / count(*) AS rate, CAST(count(DISTINCT nullif({f}, '')) AS BIGINT) AS labels FROM holey" for f in _FIELDS))
def profile_levels(spark, sf_dir):
    return profile.levels(_holey(spark, sf_dir), _FIELDS)


@query(f"WITH {RECORDS}, {_HOLEY} SELECT CAST((level_1 <> '')::INT AS VARCHAR) || (level_2 <> '')::INT || (level_3 <> '')::INT || (level_4 <> '')::INT AS pattern, CASE WHEN level_4 <> '' THEN 3 WHEN level_2 <> '' THEN 1 ELSE 0 END AS deepest, CAST(count(*) AS BIGINT) AS n FROM holey GROUP BY 1, 2")
def population_patterns(spark, sf_dir):
    return profile.patterns(_holey(spark, sf_dir), _FIELDS)


@query("SELECT p_name AS label, CAST(count(DISTINCT p_type || '>' || p_brand) AS BIGINT) AS n_parents, min(p_type || '>' || p_brand) AS first_parent FROM part GROUP BY 1 HAVING count(DISTINCT p_type || '>' || p_brand) > 1")
def leaf_collisions(spark, sf_dir):
    return profile.collisions(records(spark, sf_dir), "level_4", ["level_1", "level_2"])


@query("SELECT p_type || '>' || p_brand || '>' || p_name AS path, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def top_paths(spark, sf_dir):
    return profile.top_paths(records(spark, sf_dir), ["level_1", "level_2", "level_4"], "row_no")


@query("SELECT replace(p_name, ' ', '') AS compacted, CAST(count(DISTINCT CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '  ') WHEN 1 THEN p_name ELSE replace(p_name, ' ', chr(12288)) END) AS BIGINT) AS n_forms FROM part GROUP BY 1 HAVING n_forms > 1")
def whitespace_variants(spark, sf_dir):
    name = F.col("p_name")
    form = F.when(F.col("p_size") % 3 == 0, F.replace(name, F.lit(" "), F.lit("  "))).when(F.col("p_size") % 3 == 1, name).otherwise(F.replace(name, F.lit(" "), F.lit("　")))
    return profile.whitespace_variants(table(spark, sf_dir, "part").select(form.alias("label")), "label")


def _corpora(spark, sf_dir):
    """Three corpora of part sizes: entries of small sizes have no path."""
    part = table(spark, sf_dir, "part")
    band = F.when(F.col("p_size") <= 5, "small").when(F.col("p_size") <= 20, "middle").otherwise("large")
    path = F.when(F.col("p_size") > 5, F.concat_ws(">", text.compact(F.col("p_type")), text.compact(F.col("p_brand"))))
    return part.select(band.alias("corpus"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("leaf"), path.alias("ancestors"))


_MATCH = f"""{RECORDS}, entries AS (SELECT CASE WHEN p_size <= 5 THEN 'small' WHEN p_size <= 20 THEN 'middle' ELSE 'large' END AS corpus, {sql_compact('level_4')} AS key,
    CASE WHEN p_size > 5 THEN level_1 || '>' || level_2 END AS entry_path FROM records),
  size AS (SELECT corpus, key, count(*) AS n_entries FROM entries GROUP BY 1, 2), corpora AS (SELECT DISTINCT corpus FROM entries),
  hit AS (SELECT c.corpus, r.id, {sql_compact('r.level_4')} AS key, n_entries, EXISTS (SELECT 1 FROM entries e WHERE e.corpus = c.corpus AND e.key = {sql_compact('r.level_4')} AND (entry_path IS NULL OR entry_path = r.level_1 || '>' || r.level_2)) AS agrees
    FROM records r CROSS JOIN corpora c LEFT JOIN size s ON s.corpus = c.corpus AND s.key = {sql_compact('r.level_4')}),
  matches AS (SELECT corpus, CAST(count(*) AS BIGINT) AS samples, CAST(count(n_entries) AS BIGINT) AS matched, CAST(count(*) FILTER (n_entries > 1) AS BIGINT) AS ambiguous, CAST(count(*) FILTER (agrees) AS BIGINT) AS path_agrees,
    CAST(count(DISTINCT key) AS BIGINT) AS leaves, CAST(count(DISTINCT CASE WHEN n_entries IS NOT NULL THEN key END) AS BIGINT) AS matched_leaves, CAST(count(n_entries) AS DOUBLE) / count(*) AS rate FROM hit GROUP BY 1)"""


@query(f"WITH {_MATCH} SELECT * FROM matches")
def match_leaf(spark, sf_dir):
    return profile.match_corpora(records(spark, sf_dir), _corpora(spark, sf_dir), "level_4", ["level_1", "level_2"])


@query(f"WITH {_MATCH} SELECT * FROM matches ORDER BY matched DESC, rate DESC, corpus LIMIT 1")
def best_corpus(spark, sf_dir):
    return profile.best_corpus(match_leaf(spark, sf_dir))


@query("""WITH e AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS names, CAST(count(*) FILTER (n > 1) AS BIGINT) AS repeated_kinds,
  CAST(sum(n - 1) AS BIGINT) AS extra_instances, CAST(sum(n) AS BIGINT) AS coded, CAST(sum(n) AS BIGINT) AS multi_part, CAST(0 AS BIGINT) AS long, CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS ambiguous FROM e""")
def dictionary_profile(spark, sf_dir):
    key = F.col("s_nationkey").cast("string")
    return profile.dictionary(table(spark, sf_dir, "supplier").select(F.concat(F.lit("类"), key, F.lit("-子"), key, F.lit("（A"), key, F.lit("-1）")).alias("raw")), "raw")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = o_orderpriority THEN o_orderstatus ELSE o_orderstatus || '>' || o_orderpriority END AS path FROM orders")
def dedupe_path(spark, sf_dir):
    raw = F.array("o_orderstatus", F.lit(" "), F.concat(F.col("o_orderstatus"), F.lit(" ")), "o_orderpriority", "o_orderpriority", F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(arrays.dedupe_path(raw), ">").alias("path"))


@query("SELECT sha256(string_agg('{\"s_name\":\"' || s_name || '\",\"s_suppkey\":' || s_suppkey || '}', ',' ORDER BY s_suppkey)) AS fingerprint FROM supplier")
def fingerprint_rows(spark, sf_dir):
    return ids.fingerprint(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("SELECT 'stage1' AS stage, CAST(o_custkey AS VARCHAR) AS source_id, arg_max(o_orderpriority, o_orderkey) AS completion FROM orders GROUP BY 1, 2")
def last_write_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.lit("stage1").alias("stage"), F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderpriority").alias("completion"), "o_orderkey")
    return scoring.join_completions(orders.select("stage", "source_id").distinct(), orders, "o_orderkey")


# `part` as a dictionary: names with a code, paths, and entries that name nothing.
_ENTRY = "CASE WHEN p_partkey % 11 = 0 THEN 'NaN' WHEN p_partkey % 11 = 1 THEN '' WHEN p_partkey % 11 < 4 THEN p_name ELSE p_name || '（A' || (p_partkey % 9) || '-1）' END"
_DASHED = "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 < 4 THEN p_name WHEN p_partkey % 11 = 4 THEN p_type || '--' || p_name ELSE p_type || ' - ' || p_name END"


def _dictionary(spark, sf_dir):
    k = F.col("p_partkey") % 11
    coded = F.concat("p_name", F.lit("（A"), (F.col("p_partkey") % 9).cast("string"), F.lit("-1）"))
    dashed = F.when(k == 0, "").when(k < 4, F.col("p_name")).when(k == 4, F.concat("p_type", F.lit("--"), "p_name")).otherwise(F.concat("p_type", F.lit(" - "), "p_name"))
    return table(spark, sf_dir, "part").withColumns({"coded": F.when(k == 0, "NaN").when(k == 1, "").when(k < 4, F.col("p_name")).otherwise(coded), "dashed": dashed})


def _flat(built):
    """One row a category of any size, with arrays as texts; descriptions as a digest over all chunks."""
    flat = built.withColumns({"path": F.array_join("path", ">"), "code": F.coalesce("code", F.lit(""))})
    whole = ordered.digested(flat, ["category_id"], ["name", "description", "path", "code", "extra"], items="descriptions")
    return whole.select("category_id", "name", "description", "path", "code", F.col("digest").alias("descriptions"), "extra")


_FLAT = "first(name ORDER BY p_partkey) AS name, first(p_brand ORDER BY p_partkey) AS description, first(path ORDER BY p_partkey) AS path, first(code ORDER BY p_partkey) AS code, sha256(coalesce(array_to_string(list(p_brand ORDER BY p_partkey)[2:], ','), '')) AS descriptions, CAST(count(*) - 1 AS BIGINT) AS extra"


@query(f"""WITH e AS (SELECT *, {_ENTRY} AS raw FROM part), p AS (SELECT p_partkey, p_brand, p_name AS name, '' AS path, CASE WHEN p_partkey % 11 < 4 THEN '' ELSE 'A' || (p_partkey % 9) || '-1' END AS code FROM e WHERE p_partkey % 11 > 1)
  SELECT CASE WHEN code = '' THEN 'guide:' || {sql_compact('name')} ELSE code END AS category_id, {_FLAT} FROM p GROUP BY 1""")
def corpus_code_build(spark, sf_dir):
    return _flat(corpus.build_corpus(corpus.code_dictionary(_dictionary(spark, sf_dir), "guide", "p_partkey", "p_brand", "coded")))


@query(f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 4 THEN p_type || '--' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 11 > 4 THEN p_type || '>' || p_name ELSE '' END AS path, '' AS code,
    'bank:' || {sql_compact(f"replace({_DASHED}, ' - ', '.')")} AS category_id FROM part WHERE p_partkey % 11 > 0)
  SELECT category_id, {_FLAT} FROM p GROUP BY 1""")
def corpus_path_build(spark, sf_dir):
    return _flat(corpus.build_corpus(corpus.path_dictionary(_dictionary(spark, sf_dir), "bank", "p_partkey", "p_brand", "dashed")))


@query(f"SELECT DISTINCT 'people:' || {sql_compact('p_name')} AS category_id, p_name AS name, p_name AS path FROM part")
def corpus_universe(spark, sf_dir):
    return corpus.build_corpus(corpus.universe(table(spark, sf_dir, "part"), "people", "p_name")).select("category_id", "name", F.array_join("path", ">").alias("path"))


@query(f"""WITH c AS (SELECT CASE WHEN p_partkey % 11 < 2 THEN NULL WHEN p_partkey % 11 < 4 THEN 'guide:' || {sql_compact('p_name')} ELSE 'A' || (p_partkey % 9) || '-1' END AS id, p_partkey % 11 AS k FROM part),
  g AS (SELECT id, count(*) AS n FROM c WHERE id IS NOT NULL GROUP BY 1)
  SELECT CAST((SELECT count(*) FROM c) AS BIGINT) AS entries, CAST(count(*) AS BIGINT) AS categories, CAST(count(*) FILTER (n > 1) AS BIGINT) AS kinds, CAST(sum(n - 1) AS BIGINT) AS instances,
    CAST((SELECT count(*) FROM c WHERE k < 2) AS BIGINT) AS malformed_skipped, CAST((SELECT count(*) FROM c WHERE k IN (2, 3)) AS BIGINT) AS no_code, CAST(0 AS BIGINT) AS unexpected_format FROM g""")
def corpus_build_report(spark, sf_dir):
    return corpus.build_report(corpus.code_dictionary(_dictionary(spark, sf_dir), "guide", "p_partkey", "p_brand", "coded"))


@query(f"WITH {RECORDS} SELECT CASE WHEN p_size % 5 = 0 THEN '' ELSE data_level END AS level, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT category_id) AS BIGINT) AS categories FROM records GROUP BY 1")
def level_distribution(spark, sf_dir):
    graded = records(spark, sf_dir).withColumn("grade", F.when(F.col("p_size") % 5 != 0, F.col("data_level")))
    return standards.level_distribution(standards.build_entries(graded, "part", ["level_1", "level_2", "level_3", "level_4"], ["level_1", "level_2", "level_4"], "row_no", "grade"))


@query(f"""WITH {RESOLVED} SELECT level_2, CAST(count(*) FILTER (resolution_status = 'resolved') AS BIGINT) AS covered, CAST(count(*) FILTER (resolution_status IN ('missing_leaf', 'path_mismatch')) AS BIGINT) AS uncovered,
  CAST(count(*) FILTER (resolution_status IN ('unlabeled', 'placeholder')) AS BIGINT) AS skipped, coalesce(CAST(count(*) FILTER (resolution_status = 'resolved') AS DOUBLE) / nullif(count(*) FILTER (resolution_status IN ('resolved', 'missing_leaf', 'path_mismatch')), 0), 0.0) AS rate FROM resolved GROUP BY 1""")
def coverage_by_level(spark, sf_dir):
    return resolve.coverage(_resolved(spark, sf_dir), "level_2")


@query(f"WITH {RESOLVED} SELECT id, CASE WHEN resolution_status = 'resolved' THEN category_id END AS truth FROM resolved")
def training_targets(spark, sf_dir):
    return resolve.training_target(_resolved(spark, sf_dir), registry(spark, sf_dir)).select("id", "truth")


@query(f"""WITH {_STANDARD}, s AS (SELECT resolution_status, level_4, count(*) AS n FROM (SELECT *, CASE WHEN label_status = 'unlabeled' THEN 'unlabeled' WHEN level_4 = 'red widget' THEN 'placeholder' END AS resolution_status FROM records) WHERE resolution_status IS NOT NULL GROUP BY 1, 2)
  SELECT resolution_status, level_4 AS leaf, CAST(n AS BIGINT) AS n, coalesce((SELECT array_to_string(list(category_id ORDER BY category_id), '|') FROM standard WHERE name = level_4), '') AS candidates FROM s""")
def unresolved_evidence(spark, sf_dir):
    open_ = resolve.resolve(records(spark, sf_dir), CONFIG).where("resolution_status <> 'resolved'")
    return standards.unresolved_evidence(open_, _standard(spark, sf_dir)).withColumn("candidates", F.array_join("candidates", "|"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '类' || s_suppkey % 25 || '>子' || s_suppkey % 25 END AS path, CASE s_suppkey % 3 WHEN 0 THEN '子' || s_suppkey % 25 WHEN 1 THEN '外' || s_suppkey % 25 || '-子' || s_suppkey % 25 ELSE '单' || s_suppkey % 25 END AS leaf FROM supplier")
def entry_paths(spark, sf_dir):
    """Supplier entries of one part, and of two whose first one the nations know or do not know."""
    n = (F.col("s_suppkey") % 25).cast("string")
    kind = F.col("s_suppkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("类"), n, F.lit("-子"), n)).when(kind == 1, F.concat(F.lit("外"), n, F.lit("-子"), n)).otherwise(F.concat(F.lit("单"), n))
    words = profile.vocabulary(table(spark, sf_dir, "nation").select(F.concat(F.lit("类"), F.col("n_nationkey").cast("string")).alias("a"), F.lit("").alias("b")), ["a", "b"])
    found = profile.entry_paths(table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")), "s_suppkey", "raw", words)
    return found.select("s_suppkey", F.array_join("path", ">").alias("path"), "leaf")


@query(f"""WITH {RESOLVED} SELECT 'status' AS section, resolution_status AS name, CAST(count(*) AS BIGINT) AS n FROM resolved GROUP BY 2
  UNION ALL SELECT 'missing_leaf', level_4, count(*) FROM resolved WHERE resolution_status = 'missing_leaf' GROUP BY 2
  UNION ALL SELECT 'path_mismatch', category_id, count(*) FROM resolved WHERE resolution_status = 'path_mismatch' GROUP BY 2""")
def canonical_report(spark, sf_dir):
    return resolve.canonical_report(_resolved(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey, p_partkey // 2 AS k, p_name, p_size FROM part WHERE p_partkey // 2 % 11 <> 0)
  SELECT '.T' || (k % 3) || '.f' || k AS key, CASE WHEN k % 7 = 0 THEN 'unlabeled' ELSE 'labeled' END AS label_status, 'f' || k AS field_name, 'STRING' AS field_type, first(p_name ORDER BY p_partkey) AS description,
    CASE WHEN k % 7 = 0 THEN '' ELSE 'top' || (k % 5) END AS level_1, CASE WHEN k % 7 = 0 THEN '' ELSE '叶' || (k % 9) END AS level_4, CASE WHEN k % 7 = 0 THEN '' ELSE 'L' || (k % 4 + 1) END AS data_level FROM p GROUP BY k""")
def preprocessed_records(spark, sf_dir):
    """Two raw rows a field, written differently but labelled alike; every eleventh field without a name, every seventh without a label."""
    k, odd = F.floor(F.col("p_partkey") / 2), F.col("p_partkey") % 2 == 1
    text_of = lambda x: x.cast("string")
    labelled = lambda x: F.when(k % 7 != 0, x)
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("T"), text_of(k % 3), F.when(odd, " ").otherwise("")).alias("t"), F.when(k % 11 != 0, F.concat(F.when(odd, "\u3000").otherwise(""), F.lit("f"), text_of(k))).alias("f"), F.when(odd, "VARCHAR2(8)").otherwise("char").alias("ty"),
        F.col("p_name").alias("d"), labelled(F.concat(F.lit("top"), text_of(k % 5))).alias("l1"), labelled(F.concat(F.lit("叶"), text_of(k % 9), F.when(odd, "（A1-1）").otherwise(""))).alias("l4"), labelled(F.concat(F.when(odd, "level").otherwise("L"), text_of(k % 4 + 1))).alias("g"),
    )
    mapping = {"t": "table_name", "f": "field_name", "ty": "field_type", "d": "field_description", "l1": "level_1", "l4": "level_4", "g": "data_level"}
    found = preprocess.preprocess(raw, mapping, "part.csv", "p_partkey")
    return found.select("key", "label_status", "metadata.field_name", "metadata.field_type", F.col("metadata.field_description").alias("description"), "classification.level_1", "classification.level_4", "data_level")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B' || p_size WHEN 2 THEN 'A7-2' END AS category_id, CASE p_partkey % 4 WHEN 0 THEN 'g:B' || p_size WHEN 2 THEN 'g:A7-2' END AS standard_entry_id,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 3 THEN '' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 1 THEN 'no_code' WHEN 3 THEN 'empty_leaf' END AS issue FROM part""")
def catalogue_entries(spark, sf_dir):
    """A code catalogue whose leaves are blank, without a code, coded, or at the level above."""
    k = F.col("p_partkey") % 4
    leaf = F.when(k == 1, F.col("p_name")).when(k == 2, F.concat("p_name", F.lit(" [A7-2]"))).otherwise(" ")
    higher = F.when(k == 0, F.concat("p_type", F.lit("（B"), F.col("p_size").cast("string"), F.lit("）"))).otherwise("")
    return standards.build_catalog(table(spark, sf_dir, "part").select("p_partkey", leaf.alias("leaf"), higher.alias("up")), "g", "leaf", "up", "p_partkey")


@query(f"""WITH {_STANDARD}, b AS (SELECT CASE WHEN label_status = 'unlabeled' OR level_4 = 'red widget' THEN 'unresolved' WHEN s.category_id IS NULL THEN 'missing'
  WHEN list_contains(levels, data_level) THEN 'matched' ELSE 'mismatched' END AS bucket FROM records r LEFT JOIN standard s ON r.category_id = s.category_id),
  n AS (SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (bucket = 'matched') AS BIGINT) AS matched, CAST(count(*) FILTER (bucket = 'mismatched') AS BIGINT) AS mismatched, CAST(count(*) FILTER (bucket = 'missing') AS BIGINT) AS missing,
    CAST(0 AS BIGINT) AS unavailable, CAST(count(*) FILTER (bucket = 'unresolved') AS BIGINT) AS unresolved FROM b)
  SELECT *, round_even(matched::DOUBLE / (samples - unresolved)::DOUBLE, 4) AS match_rate FROM n""")
def alignment_summary(spark, sf_dir):
    return standards.alignment_report(standards.align(_samples(spark, sf_dir), _standard(spark, sf_dir)))


@query("""WITH d AS (SELECT CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, lang, CASE WHEN doc_id % 10 > 7 AND doc_id % 3 = 0 THEN 'kept ' || (doc_id % 10) ELSE source END AS source FROM documents),
  l AS (SELECT 'lang' AS field, split, coalesce(lang, '') AS label FROM d UNION ALL SELECT 'source', split, source FROM d)
  SELECT field, split, label, CAST(count(*) AS BIGINT) AS n FROM l WHERE split <> 'train' AND (field, label) NOT IN (SELECT (field, label) FROM l WHERE split = 'train') GROUP BY ALL""")
def labels_outside_training(spark, sf_dir):
    key = F.col("doc_id") % 10
    docs = table(spark, sf_dir, "documents").select(
        F.when(key == 8, "val").when(key == 9, "test").otherwise("train").alias("split"), "lang", F.when((key > 7) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("kept "), key.cast("string"))).otherwise(F.col("source")).alias("source")
    )
    return splits.missing_labels(docs, "split", ["lang", "source"])


@query("""WITH s AS (SELECT p_brand || '.' || p_name AS id, min(p_size) AS size FROM part WHERE p_size > 10 GROUP BY 1), r AS (SELECT DISTINCT p_brand || '.' || p_name AS id FROM part WHERE p_size < 40)
  SELECT CAST(count(s.id) AS BIGINT) AS standard_categories, CAST(count(r.id) AS BIGINT) AS registry_ids, CAST(count(*) FILTER (r.id IS NULL) AS BIGINT) AS standard_only, CAST(count(*) FILTER (s.id IS NULL) AS BIGINT) AS registry_only,
    CAST(count(*) FILTER (size % 3 = 2) AS BIGINT) AS deeper, CAST(count(*) FILTER (size % 3 < 2) AS BIGINT) AS at_depth, CAST(count(*) FILTER (size % 3 > 0) AS BIGINT) AS with_path, CAST(count(*) FILTER (size % 2 = 0) AS BIGINT) AS with_level FROM s FULL JOIN r ON s.id = r.id""")
def information_loss(spark, sf_dir):
    """What a registry with paths of one part lost of a standard whose paths have none to two."""
    part = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_name").alias("category_id"), "p_size")
    size = F.min("p_size")
    categories = part.where("p_size > 10").groupBy("category_id").agg(F.array_repeat(F.lit("x"), (size % 3).cast("int")).alias("path"), F.when(size % 2 == 0, "L1").alias("level"))
    return standards.information_loss(categories, part.where("p_size < 40"), 1)
