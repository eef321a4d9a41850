"""Queries: choices, bundles, prompts, parsing, evaluation, rewards, metrics, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from taxonaut.functions import nested
from taxonaut.operators import census, choices, contract, conversations, datasets, export, rft, scoring
from taxonaut.plans.tables import REGISTRY, query, records, registry, spread, table
from taxonaut.sources import writers

NATIONS = 25  # fixed size of the nation table: the registry of the order queries


def _nation_ids():
    return [f"N{i}" for i in range(NATIONS)]


@query(f"WITH {REGISTRY} SELECT category_id, CAST(row_number() OVER (ORDER BY category_id) AS VARCHAR) AS choice_id FROM registry")
def choice_ids(spark, sf_dir):
    return choices.choice_ids(registry(spark, sf_dir).select("category_id"), "category_id")


@query(f"""WITH {REGISTRY}, c AS (SELECT category_id, name, level_2, level_1, count(*) OVER (PARTITION BY name) AS n1, count(*) OVER (PARTITION BY level_2, name) AS n2 FROM registry)
  SELECT category_id, CASE WHEN n1 = 1 THEN name WHEN n2 = 1 THEN level_2 || ' / ' || name ELSE level_1 || ' / ' || level_2 || ' / ' || name END AS display_name FROM c""")
def display_names(spark, sf_dir):
    return choices.display_names(registry(spark, sf_dir)).select("category_id", "display_name")


def _orders(spark, sf_dir):
    """Orders as samples: the truth is the customer's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("truth"))
    return spread(rows).withColumn("candidates", choices.candidate_bundle(F.col("truth"), _nation_ids(), F.col("source_id")))


def _swap(i: int) -> str:
    """SQL of one exchange of Fisher-Yates: item i with the one at byte i modulo i + 1."""
    pick = f"CASE j{i} " + " ".join(f"WHEN {k} THEN a{k}" for k in range(i + 1)) + " END"
    items = [f"{pick} AS a{k}" if k == i else (f"CASE WHEN j{i} = {k} THEN a{i} ELSE a{k} END AS a{k}" if k < i else f"a{k}") for k in range(5)]
    return ", ".join(items)


_BYTES = ", ".join(f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) % {i + 1} AS j{i}" for i in range(1, 5))
_KEEP = "o_orderkey, o_custkey, truth, j1, j2, j3, j4"
ORDERS = f"""o0 AS (SELECT o_orderkey, o_custkey, c_nationkey AS k, 'N' || c_nationkey AS truth, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders JOIN customer ON o_custkey = c_custkey),
  s4 AS (SELECT o_orderkey, o_custkey, truth, {_BYTES}, truth AS a0, {", ".join(f"'N' || CASE WHEN k < {i} THEN {i} WHEN k > {i - 1} THEN {i - 1} ELSE {i} END AS a{i}" for i in range(1, 5))} FROM o0),
  s3 AS (SELECT {_KEEP}, {_swap(4)} FROM s4), s2 AS (SELECT {_KEEP}, {_swap(3)} FROM s3), s1 AS (SELECT {_KEEP}, {_swap(2)} FROM s2), samples AS (SELECT {_KEEP}, {_swap(1)} FROM s1)"""


@query(f"WITH {ORDERS} SELECT o_orderkey, truth, concat_ws(',', a0, a1, a2, a3, a4) AS candidates FROM samples")
def candidate_bundle(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "truth", F.array_join("candidates", ",").alias("candidates"))


def _corpus(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("category_id"), F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"))


def _sql_item(i: int) -> str:
    return f"""'{{"id":"{i + 1}","name":"NATION_' || substr(a{i}, 2) || '","description":"region ' || (SELECT n_regionkey FROM nation WHERE n_nationkey = CAST(substr(a{i}, 2) AS INT)) || '"}}'"""


@query(f"WITH {ORDERS} SELECT o_orderkey, '[' || {' || \',\' || '.join(_sql_item(i) for i in range(5))} || ']' AS bundle FROM samples")
def stage2_bundle(spark, sf_dir):
    return choices.bundle_rows(_orders(spark, sf_dir), _corpus(spark, sf_dir), "o_orderkey")


_STAGE1 = "[' || " + " || ',' || ".join(f"'\"' || (CAST(substr(a{i}, 2) AS INT) + 1) || '\"'" for i in range(5)) + " || ']"


@query(f"""WITH {ORDERS} SELECT o_orderkey, 'stage1' AS stage, '{{"candidates":{_STAGE1}}}' AS answer FROM samples
  UNION ALL SELECT o_orderkey, 'stage2', '{{"answer":"' || CASE truth WHEN a0 THEN 1 WHEN a1 THEN 2 WHEN a2 THEN 3 WHEN a3 THEN 4 ELSE 5 END || '"}}' FROM samples""")
def stage_answers(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    names = [f"NATION_{i}" for i in range(NATIONS)]
    staged = export.stage_rows(rows, _nation_ids(), names, _corpus(spark, sf_dir), {"order": F.col("source_id"), "customer": F.col("o_custkey")})
    return staged.select(F.col("source_id").cast("long").alias("o_orderkey"), "stage", "answer")


_CATALOGUE = "[' || (SELECT string_agg('[\"' || (n_nationkey + 1) || '\", \"' || n_name || '\"]', ', ' ORDER BY n_nationkey) FROM nation) || ']"


@query(f"""WITH {ORDERS} SELECT o_orderkey, sha256('{choices.STAGE1_HEAD}{_CATALOGUE}{choices.METADATA_HEAD}' || '{{"order":"' || o_orderkey || '","customer":"' || o_custkey || '"}}') AS prompt FROM samples""")
def stage1_prompts(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    catalogue = choices.stage1_catalogue([(str(i + 1), f"NATION_{i}") for i in range(NATIONS)])
    user = choices.stage1_prompt(catalogue, choices.metadata_json({"order": F.col("source_id"), "customer": F.col("o_custkey")}))
    return rows.select("o_orderkey", F.sha2(user, 256).alias("prompt"))


def _staged(spark, sf_dir):
    names = [f"NATION_{i}" for i in range(NATIONS)]
    return export.stage_rows(_orders(spark, sf_dir), _nation_ids(), names, _corpus(spark, sf_dir), {"order": F.col("source_id")})


# Faults planted by order key, and what the check says of them.
_FAULTS = (
    "ground truth is not in the registry; candidates lack the ground truth; candidate order is not the reproducible one; ground truth is not the sample''s",
    "roles must be system, user, assistant; blank message; system prompt differs; user prompt differs; answer differs",
    "user prompt differs",
    "answer differs",
    "candidate order is not the reproducible one",
)


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, stage, CASE o_orderkey % 20 " + " ".join(f"WHEN {i} THEN '{said}'" for i, said in enumerate(_FAULTS)) + " END AS errors FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(['stage1', 'stage2']) AS stage) WHERE o_orderkey % 20 < 5"
)
def sft_contract(spark, sf_dir):
    """Rows of an export of which some are broken."""
    staged = _staged(spark, sf_dir)
    kind = F.col("source_id").cast("long") % 20
    altered = lambda i: F.transform("messages", lambda m, k: F.struct(m["role"].alias("role"), F.when(k == i, F.concat(m["content"], F.lit(" x"))).otherwise(m["content"]).alias("content")))
    broken = export.sft_rows(staged).withColumns({
        "ground_truth": F.when(kind == 0, "ZZ").otherwise(F.col("ground_truth")),
        "messages": F.when(kind == 1, F.lit(None)).when(kind == 2, altered(1)).when(kind == 3, altered(2)).otherwise(F.col("messages")),
        "candidates": F.when(kind == 4, F.reverse("candidates")).otherwise(F.col("candidates")),
    })
    return export.check_sft(broken, _nation_ids(), staged).withColumn("errors", F.array_join("errors", "; "))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, stage, CASE o_orderkey % 20 WHEN 0 THEN 'unknown ability' WHEN 1 THEN 'user prompt differs' WHEN 2 THEN 'unknown data source' ELSE CASE stage WHEN 'stage1' THEN 'stage1 shows candidates' ELSE 'five different candidates are needed; candidate order is not the reproducible one' END END AS errors FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(['stage1', 'stage2']) AS stage) WHERE o_orderkey % 20 < 4"
)
def rl_contract(spark, sf_dir):
    """Reinforcement rows of which some are broken."""
    staged = _staged(spark, sf_dir)
    kind = F.col("extra_info.source_id").cast("long") % 20
    altered = F.transform("prompt", lambda m, k: F.struct(m["role"].alias("role"), F.when(k == 1, F.concat(m["content"], F.lit(" x"))).otherwise(m["content"]).alias("content")))
    shown = F.when(F.col("extra_info.stage") == "stage1", F.array(F.lit("N0"))).otherwise(F.concat("extra_info.candidates", F.slice("extra_info.candidates", 1, 1)))
    broken = export.rl_rows(staged, "orders").withColumns({
        "ability": F.when(kind == 0, "x").otherwise(F.col("ability")),
        "prompt": F.when(kind == 1, altered).otherwise(F.col("prompt")),
        "data_source": F.when(kind == 2, "y").otherwise(F.col("data_source")),
        "extra_info": F.when(kind == 3, F.col("extra_info").withField("candidates", shown)).otherwise(F.col("extra_info")),
    })
    return export.check_rl(broken, _nation_ids(), "orders", staged).withColumn("errors", F.array_join("errors", "; "))


# Outputs of a model, by key: good, wrong type, trailing text, unknown id, another key, single quotes, repeated key.
_OUTPUTS = ('{"answer":"1"}', '{"answer": 3}', '{"answer":"1"} done', '{"answer":"9"}', '{"answer":"2","x":1}', "{'answer':'1'}", '{"answer":"1","answer":"4"}', '  {"answer" : "5"}  ', "", "[]")
_FORMAT = (True, False, False, True, False, False, True, True, False, False)
_ANSWERS = ("1", None, None, "9", None, None, "4", "5", None, None)


@query("SELECT event_id, " + "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {str(f).lower()}" for i, f in enumerate(_FORMAT)) + " END AS format_valid, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {str(f and a != '9').lower()}" for i, (f, a) in enumerate(zip(_FORMAT, _ANSWERS))) + " END AS contract_valid, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {repr(a) if a else 'NULL'}" for i, a in enumerate(_ANSWERS)) + " END AS answer FROM events")
def parse_stage2(spark, sf_dir):
    outputs = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*[F.lit(x) for x in _OUTPUTS]), (F.col("event_id") % 10).cast("int")).alias("completion"))
    return scoring.parse_stage2(outputs, "completion").select("event_id", "format_valid", "contract_valid", "answer")


def _stage1(spark, sf_dir):
    """A fake retriever: five choices in a row from a place that depends on the order; every tenth repeats itself."""
    start = (F.col("o_orderkey") % 21).cast("int")
    ids_ = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (start + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(i)).cast("string"))
    outputs = _orders(spark, sf_dir).withColumn("completion", choices.stage1_answer(ids_))
    parsed = scoring.parse_stage1(outputs, "completion", [str(i) for i in range(1, NATIONS + 1)])
    decoded = parsed.withColumn("predicted", F.transform("predicted", lambda c: F.concat(F.lit("N"), (c.cast("int") - 1).cast("string"))))
    return decoded.withColumn("recalled", F.col("contract_valid") & F.array_contains("predicted", F.col("truth")))


def _stage2(spark, sf_dir):
    """A fake reranker: the customer's number decides, and every sixth answer is no local id."""
    outputs = _orders(spark, sf_dir).withColumn("completion", F.to_json(F.struct((F.col("o_custkey") % 6 + 1).cast("string").alias("answer"))))
    parsed = scoring.parse_stage2(outputs, "completion", "candidates")
    return parsed.withColumn("correct", F.coalesce(F.col("decoded") == F.col("truth"), F.lit(False)))


_S1 = f"""{ORDERS}, one AS (SELECT *, o_orderkey % 10 <> 0 AS valid1, CAST(substr(truth, 2) AS INT) BETWEEN o_orderkey % 21 AND o_orderkey % 21 + 4 AS inside FROM samples),
  two AS (SELECT *, o_custkey % 6 < 5 AS valid2, coalesce(CASE o_custkey % 6 WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 WHEN 4 THEN a4 END = truth, false) AS correct FROM one)"""


@query(f"WITH {_S1} SELECT o_orderkey, true AS format_valid, valid1 AS contract_valid, valid1 AND inside AS recalled, CASE WHEN NOT valid1 THEN 0.0 WHEN inside THEN 1.0 ELSE 0.3 END::DOUBLE AS reward FROM two")
def evaluate_stage1(spark, sf_dir):
    reward = scoring.reward_stage1(F.col("format_valid"), F.col("contract_valid"), F.col("recalled"))
    return _stage1(spark, sf_dir).select("o_orderkey", "format_valid", "contract_valid", "recalled", reward.alias("reward"))


@query(f"WITH {_S1} SELECT o_orderkey, true AS format_valid, valid2 AS contract_valid, correct, CASE WHEN NOT valid2 THEN 0.0 WHEN correct THEN 1.0 ELSE 0.5 END::DOUBLE AS reward FROM two")
def evaluate_stage2(spark, sf_dir):
    reward = scoring.reward_stage2(F.col("format_valid"), F.col("contract_valid"), F.col("correct"))
    return _stage2(spark, sf_dir).select("o_orderkey", "format_valid", "contract_valid", "correct", reward.alias("reward"))


@query(f"WITH {_S1} SELECT CASE WHEN NOT valid1 THEN 0.0 WHEN inside THEN 1.0 ELSE 0.3 END::DOUBLE AS reward1, CASE WHEN NOT valid2 THEN 0.0 WHEN correct THEN 1.0 ELSE 0.5 END::DOUBLE AS reward2, CAST(count(*) AS BIGINT) AS n FROM two GROUP BY 1, 2")
def reward_table(spark, sf_dir):
    one, two = evaluate_stage1(spark, sf_dir), evaluate_stage2(spark, sf_dir)
    both = one.select("o_orderkey", F.col("reward").alias("reward1")).join(two.select("o_orderkey", F.col("reward").alias("reward2")), "o_orderkey")
    return both.groupBy("reward1", "reward2").agg(F.count("*").alias("n"))


@query(f"""WITH {_S1} SELECT CAST(count(*) AS BIGINT) AS n_stage1, 1.0::DOUBLE AS stage1_format, avg(valid1::INT) AS stage1_contract, avg((valid1 AND inside)::INT) AS recall_at_5, CAST(count(*) AS BIGINT) AS n_stage2, 1.0::DOUBLE AS stage2_format,
  avg(valid2::INT) AS stage2_contract, avg(correct::INT) AS accuracy, avg(correct::INT) AS accuracy_given_truth, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS pairs, CAST(count(*) FILTER (valid1 AND inside AND correct) AS BIGINT) AS e2e_correct FROM two""")
def baseline_metrics(spark, sf_dir):
    one = _stage1(spark, sf_dir).select("source_id", "format_valid", "contract_valid", "recalled")
    two = _stage2(spark, sf_dir).select("source_id", "format_valid", "contract_valid", "correct", F.array_contains("candidates", F.col("truth")).alias("truth_in_candidates"))
    return scoring.baseline_metrics(one, two)


@query(f"""WITH {_S1}, f AS (SELECT valid1, inside, CASE WHEN valid1 THEN 'N' || (o_orderkey % 21 + o_custkey % 5) END AS final, truth FROM two)
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(final) AS BIGINT) AS answered, CAST(count(*) FILTER (valid1 AND inside) AS BIGINT) AS recalled, CAST(count(*) FILTER (final = truth) AS BIGINT) AS e2e_correct FROM f""")
def true_e2e_metrics(spark, sf_dir):
    rows = _stage1(spark, sf_dir).withColumns({"contract_valid1": F.col("contract_valid"), "local": (F.col("o_custkey") % 5 + 1).cast("int")})
    return scoring.true_e2e(rows).agg(F.count("*").alias("n"), F.count("final").alias("answered"), F.count_if("recalled").alias("recalled"), F.count_if("e2e_correct").alias("e2e_correct"))


@query("SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_first, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_second, count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AS paired FROM conversations GROUP BY 1")
def stage_pairs(spark, sf_dir):
    return scoring.stage_pairs(table(spark, sf_dir, "conversations"), "conv_id", "role", "user", "assistant")


@query("""WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (trim(coalesce(text, '')) = '') AS BIGINT) AS blank,
  CAST(count(*) FILTER (role = before) AS BIGINT) AS repeated, first(role ORDER BY turn) IN ('system', 'user') AS opens_well FROM t GROUP BY 1""")
def message_contract(spark, sf_dir):
    return export.message_errors(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH l AS (SELECT role, length(text) AS v FROM conversations), r AS (SELECT role, v, row_number() OVER (PARTITION BY role ORDER BY v) AS k, count(*) OVER (PARTITION BY role) AS n FROM l)
  SELECT role, CAST(count(*) AS BIGINT) AS rows, CAST(max(v) AS BIGINT) AS max, CAST(min(v) FILTER (k = greatest(1, CAST(floor(n::DOUBLE * 0.95::DOUBLE) AS BIGINT))) AS BIGINT) AS p95, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM r GROUP BY 1""")
def prompt_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("chars"))
    return scoring.legacy_p95(rows, "role", "chars")


@query("""WITH c AS (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS t FROM conversations GROUP BY 1)
  SELECT CAST(max(t) AS BIGINT) AS max_tokens, (SELECT conv_id FROM c ORDER BY t DESC, conv_id LIMIT 1) AS longest, CAST(count(*) FILTER (t > 500) AS BIGINT) AS over_limit FROM c""")
def token_budget(spark, sf_dir):
    counted = scoring.token_counts(table(spark, sf_dir, "conversations").select("conv_id", "text"), "text", lambda t: len(t.split()))
    return scoring.token_budget(counted.groupBy("conv_id").agg(F.sum("tokens").alias("tokens")), "conv_id", "tokens", 500)


@query(f"""WITH {REGISTRY} SELECT id, sha256('{export.USER_HEAD}' || chr(10) || '表名称：' || level_2 || chr(10) || '字段名称：' || level_4) AS user_content,
  '{{"classification":{{"level_1":"' || level_1 || '","level_2":"' || level_2 || '","level_3":"","level_4":"' || level_4 || '"}},"data_level":"' || data_level || '"}}' AS answer FROM records""")
def rft_messages(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"table_name": F.col("level_2"), "field_name": F.col("level_4"), "field_description": F.lit("  ")})
    answer = export.reference_answer([F.col(f"level_{i}") for i in range(1, 5)], F.col("data_level"))
    return export.rft_messages(rows).select("id", F.sha2("user_content", 256).alias("user_content"), answer.alias("answer"))


# Outputs of both stages by order key, with what is said of them; then (reward, reason) by choice id.
_S1_OUTPUTS = (
    ('{"candidates":["1","2","3","4","5"]}', ""),
    ('{"candidates":["1","2","3","4"]}', "stage1 prediction must contain exactly 5 candidates"),
    ('{"candidates":["1","1","3","4","77"]}', "stage1 candidates must be unique; choice id ''77'' is not in the prompt catalog"),
    ('{"candidates":[1,2,3,4,5]}', "stage1 candidates must be an array of strings"),
    ('{"candidates":[],"x":1}', "stage1 prediction must contain only candidates"),
    ("[]", "prediction must be a JSON object"),
)
_S1_INVALID = "stage1 output violates candidate constraints: "


def _said_of_stage1(alias: str) -> str:
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{said}'" for i, (_, said) in enumerate(_S1_OUTPUTS)) + f" END AS {alias}"


@query(f"""WITH {ORDERS}, x AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(substr(truth, 2) AS INT) < 5 AS inside, {_said_of_stage1("errors")} FROM samples)
  SELECT o_orderkey, k < 3 AS format_valid, k = 0 AS contract_valid, k = 0 AND inside AS task_correct, errors, CASE WHEN k > 0 THEN 0.0 WHEN inside THEN 1.0 ELSE 0.3 END::DOUBLE AS reward,
    CASE WHEN k > 2 THEN 'stage1 output is not a valid JSON object with schema candidates' WHEN k > 0 THEN '{_S1_INVALID}' || errors WHEN inside THEN 'stage1 candidates contain the ground truth' ELSE 'stage1 output is valid but misses the ground truth' END AS reason FROM x""")
def reward_stage1_choices(spark, sf_dir):
    said = F.get(F.array(*[F.lit(o) for o, _ in _S1_OUTPUTS]), (F.col("o_orderkey") % 6).cast("int"))
    choice_of = {str(i + 1): c for i, c in enumerate(_nation_ids())}
    judged = scoring.rewarded(scoring.evaluate_stage1(_orders(spark, sf_dir).withColumn("completion", said), "completion", "truth", choice_of), "stage1")
    return judged.select("o_orderkey", "format_valid", "contract_valid", "task_correct", F.array_join("errors", "; ").alias("errors"), "reward", "reason")


@query(f"""WITH {ORDERS}, x AS (SELECT o_orderkey, o_orderkey % 3 AS k, CAST(substr(truth, 2) AS INT) < 5 AS inside FROM samples) SELECT o_orderkey, true AS format_valid, k < 2 AS contract_valid, k < 2 AND (k = 1 OR inside) AS task_correct, CASE k WHEN 2 THEN 'stage1 candidates must belong to the leaf registry' ELSE '' END AS errors,
    CASE WHEN k = 2 THEN 0.0 WHEN k = 1 OR inside THEN 1.0 ELSE 0.3 END::DOUBLE AS reward FROM x""")
def reward_stage1_ids(spark, sf_dir):
    """By category ids: the first five of the registry, the sample's own candidates, or choice ids, which are no categories."""
    kind = F.col("o_orderkey") % 3
    first = F.array(*[F.lit(c) for c in _nation_ids()[:5]])
    said = choices.stage1_answer(F.when(kind == 0, first).when(kind == 1, F.col("candidates")).otherwise(F.array(*[F.lit(str(i)) for i in range(1, 6)])))
    judged = scoring.rewarded(scoring.evaluate_stage1(_orders(spark, sf_dir).withColumn("completion", said), "completion", "truth", _nation_ids()), "stage1")
    return judged.select("o_orderkey", "format_valid", "contract_valid", "task_correct", F.array_join("errors", "; ").alias("errors"), "reward")


@query(f"""WITH {ORDERS}, x AS (SELECT o_orderkey, o_orderkey % 4 AS k, truth, a0 FROM samples) SELECT o_orderkey, k < 3 AS format_valid, k < 2 AS contract_valid, k = 0 OR k = 1 AND a0 = truth AS task_correct,
    CASE k WHEN 2 THEN 'stage2 answer must be one of the candidates' WHEN 3 THEN 'stage2 answer must be a string' ELSE '' END AS errors, CASE WHEN k > 1 THEN 0.0 WHEN k = 0 OR a0 = truth THEN 1.0 ELSE 0.25 END::DOUBLE AS reward,
    CASE WHEN k = 3 THEN 'stage2 output is not a valid JSON object with schema answer' WHEN k = 2 THEN 'stage2 answer is not one of the candidates' WHEN k = 0 OR a0 = truth THEN 'stage2 answer is correct' ELSE 'stage2 answer is valid but wrong' END AS reason FROM x""")
def reward_stage2_ids(spark, sf_dir):
    """By category ids: the truth, the first candidate, a local id, or a number; a partial reward of a quarter."""
    kind = F.col("o_orderkey") % 4
    answer = F.when(kind == 0, F.col("truth")).when(kind == 1, F.get("candidates", F.lit(0))).otherwise(F.lit("1"))
    said = F.when(kind == 3, '{"answer":1}').otherwise(F.to_json(F.struct(answer.alias("answer"))))
    judged = scoring.rewarded(scoring.evaluate_stage2(_orders(spark, sf_dir).withColumn("completion", said), "completion", "truth", "candidates", _nation_ids(), local=False), "stage2", 0.25)
    return judged.select("o_orderkey", "format_valid", "contract_valid", "task_correct", F.array_join("errors", "; ").alias("errors"), "reward", "reason")


@query(f"""WITH {ORDERS} SELECT o_orderkey, 'stage1' AS stage, true AS format_valid, true AS contract_valid, CAST(substr(truth, 2) AS INT) < 5 AS task_correct, 'N0,N1,N2,N3,N4' AS predicted, '' AS errors FROM samples
  UNION ALL SELECT o_orderkey, 'stage2', true, o_orderkey % 2 = 0, o_orderkey % 2 = 0 AND a2 = truth, CASE o_orderkey % 2 WHEN 0 THEN a2 END, CASE o_orderkey % 2 WHEN 1 THEN 'stage2 answer ''6'' must be one of 1..5' ELSE '' END FROM samples""")
def row_evaluation(spark, sf_dir):
    two = F.when(F.col("o_orderkey") % 2 == 0, '{"answer":"3"}').otherwise('{"answer":"6"}')
    said = F.struct(F.lit("stage1").alias("stage"), F.lit('{"candidates":["1","2","3","4","5"]}').alias("completion")), F.struct(F.lit("stage2").alias("stage"), two.alias("completion"))
    rows = _orders(spark, sf_dir).select("source_id", "truth", "candidates", F.explode(F.array(*said)).alias("s")).select("source_id", "truth", "candidates", "s.*")
    judged = scoring.evaluate_rows(rows, {str(i + 1): c for i, c in enumerate(_nation_ids())})
    return judged.select(F.col("source_id").cast("long").alias("o_orderkey"), "stage", "format_valid", "contract_valid", "task_correct", F.array_join("predicted", ",").alias("predicted"), F.array_join("errors", "; ").alias("errors"))


def _fake_model(system: str, user: str) -> str:
    """Answers from the order and customer in the metadata: five choices in a row, every tenth too few; then a local id of 1 to 6."""
    import json

    from taxonaut.operators.choices import METADATA_HEAD, STAGE1_SYSTEM

    metadata = json.loads(user.rsplit(METADATA_HEAD, 1)[1])
    order, customer = int(metadata["order"]), int(metadata["customer"])
    if system == STAGE1_SYSTEM:
        return json.dumps({"candidates": [str(order % 21 + i) for i in range(1, 5 if order % 10 == 0 else 6)]})
    return json.dumps({"answer": str(customer % 6 + 1)})


_TWO = f"""{ORDERS}, x AS (SELECT o_orderkey, truth, o_orderkey % 10 <> 0 AS ok1, CAST(substr(truth, 2) AS INT) BETWEEN o_orderkey % 21 AND o_orderkey % 21 + 4 AS inside, o_orderkey % 21 < 20 AS built, o_custkey % 6 AS a FROM samples),
  y AS (SELECT o_orderkey, truth, ok1, ok1 AND inside AS recalled, ok1 AND built AS attempted, ok1 AND built AND a < 5 AS valid2, CASE WHEN ok1 AND built AND a < 5 THEN 'N' || (o_orderkey % 21 + a) END AS final,
    CASE WHEN NOT ok1 THEN 'stage1 prediction must contain exactly 5 candidates' WHEN NOT built THEN 'stage2 build: a predicted category is not in the corpus' WHEN a = 5 THEN 'stage2 answer ''6'' must be one of 1..5' ELSE '' END AS failures FROM x)"""


def _outcomes(spark, sf_dir):
    """The last nation is not in the corpus."""
    rows = _orders(spark, sf_dir).withColumn("metadata", choices.metadata_json({"order": F.col("source_id"), "customer": F.col("o_custkey")}))
    choice_of = {str(i + 1): c for i, c in enumerate(_nation_ids())}
    corpus = _corpus(spark, sf_dir).where(f"category_id <> 'N{NATIONS - 1}'")
    return scoring.two_step(rows, choice_of, [f"NATION_{i}" for i in range(NATIONS)], corpus, _fake_model)


@query(f"WITH {_TWO} SELECT o_orderkey, true AS stage1_format, ok1 AS stage1_contract, recalled, attempted, attempted AS stage2_format, valid2 AS stage2_contract, final, coalesce(final = truth, false) AS correct, failures FROM y")
def two_step_e2e(spark, sf_dir):
    kept = ["stage1_format", "stage1_contract", "recalled", "attempted", "stage2_format", "stage2_contract", "final", "correct"]
    return _outcomes(spark, sf_dir).select(F.col("source_id").cast("long").alias("o_orderkey"), *kept, F.array_join("failures", "; ").alias("failures"))


@query(f"""WITH {_TWO} SELECT CAST(count(*) AS BIGINT) AS sources, 1.0::DOUBLE AS stage1_format, avg(ok1::INT) AS stage1_contract, avg(recalled::INT) AS recall_at_5, CAST(count(*) FILTER (recalled) AS BIGINT) AS recalled, CAST(count(*) FILTER (attempted) AS BIGINT) AS attempted,
  0.0::DOUBLE AS stage2_format_failures, CAST(count(*) FILTER (attempted AND NOT valid2) AS DOUBLE) / count(*) FILTER (attempted) AS stage2_contract_failures, CAST(count(*) FILTER (final = truth) AS DOUBLE) / count(*) FILTER (recalled) AS conditional_accuracy,
  CAST(count(*) FILTER (final = truth) AS DOUBLE) / count(*) AS e2e_accuracy, CAST(count(*) FILTER (final = truth) AS BIGINT) AS e2e_correct FROM y""")
def two_step_metrics(spark, sf_dir):
    return scoring.two_step_metrics(_outcomes(spark, sf_dir))


def _nation_catalogue(spark, sf_dir) -> datasets.Catalogue:
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("category_id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("path"), "n_nationkey")
    return datasets.Catalogue.of(named, _corpus(spark, sf_dir), "n_nationkey")


def _canonical_orders(spark, sf_dir):
    """Orders as canonical rows: those of status P are not resolved, and every fiftieth of them has no id."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    open_ = F.col("o_orderstatus") == "P"
    nation = F.col("c_nationkey").cast("string")
    target = F.struct(F.lit("level_4").alias("leaf_level"), F.concat(F.lit("NATION_"), nation).alias("leaf_name"), F.concat(F.lit("N"), nation).alias("category_id"), F.array().cast("array<string>").alias("category_path"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", F.when(open_ & (F.col("o_orderkey") % 50 == 0), " ").otherwise(F.col("o_orderkey").cast("string")).alias("id"),
        F.when(open_, "missing_leaf").otherwise("resolved").alias("resolution_status"), F.when(~open_, target).alias("target"),
    )


def _split_of(key):
    return F.when(key % 10 == 8, "val").when(key % 10 == 9, "test").otherwise("train")


def _exported(spark, sf_dir, name, make_rows):
    """The report of an export, and the rows that its files hold."""
    canonical = _canonical_orders(spark, sf_dir)
    members = canonical.where("o_orderkey % 13 <> 0 and trim(id) <> ''").select("id", _split_of(F.col("o_orderkey")).alias("split"))
    path = f"{writers.scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    report = datasets.export_dataset(canonical, members, _nation_catalogue(spark, sf_dir), {"order": F.col("source_id"), "customer": F.col("o_custkey")}, path, make_rows)
    written = spark.read.parquet(path)
    return datasets.report_rows(spark, report).union(written.groupBy("split").agg(F.lit("rows_in_files").alias("metric"), F.count("*").alias("n")))


_EXPORT = """WITH c AS (
    SELECT o_orderkey AS k, o_orderstatus <> 'P' AS resolved, o_orderstatus = 'P' AND o_orderkey % 50 = 0 AS nameless, CASE o_orderkey % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split
    FROM orders JOIN customer ON o_custkey = c_custkey),
  m AS (SELECT * FROM c WHERE k % 13 <> 0 AND NOT nameless),
  s AS (SELECT split, count(*) AS split_records, 2 * count(*) FILTER (resolved) AS exported_rows, count(*) FILTER (NOT resolved) AS skipped_not_resolved, 2 * count(*) FILTER (resolved) AS rows_in_files FROM m GROUP BY 1)
  SELECT split, metric, CAST(n AS BIGINT) AS n FROM (UNPIVOT s ON split_records, exported_rows, skipped_not_resolved, rows_in_files INTO NAME metric VALUE n)
  UNION ALL SELECT NULL, 'registry_size', count(*) FROM nation
  UNION ALL SELECT NULL, 'canonical_resolved', count(*) FILTER (resolved) FROM c
  UNION ALL SELECT NULL, 'idless_non_resolved_records', count(*) FILTER (nameless) FROM c
  UNION ALL SELECT NULL, 'trainable_resolved', count(*) FILTER (resolved) FROM m
  UNION ALL SELECT NULL, 'resolved_outside_splits', count(*) FILTER (resolved AND k % 13 = 0) FROM c"""


@query(_EXPORT)
def sft_export(spark, sf_dir):
    return _exported(spark, sf_dir, "sft", datasets.sft)


@query(_EXPORT)
def rl_export(spark, sf_dir):
    return _exported(spark, sf_dir, "rl", datasets.rl("orders"))


def _task(spark, sf_dir) -> contract.Task:
    catalogue = _nation_catalogue(spark, sf_dir)
    return contract.Task(catalogue.ids, catalogue.displays, choices.corpus_map(catalogue.corpus, catalogue.ids), ["order"])


def _clean_export(spark, sf_dir):
    key = F.col("source_id").cast("long")
    return _staged(spark, sf_dir).withColumns({"split": _split_of(key), "kind": F.floor(key / 10) % 40})


def _fault(name, where, n="1", split="split", key="CAST(o_orderkey AS VARCHAR)"):
    return f"SELECT '{name}' AS \"check\", {split} AS split, {key} AS key, {n} AS n FROM s WHERE {where}"


def _contract_sql(faults):
    return f"""WITH {ORDERS}, s AS (SELECT *, o_orderkey // 10 % 40 AS kind, CASE o_orderkey % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM samples),
  f AS ({' UNION ALL '.join(faults)}), k AS (SELECT "check", split, key, row_number() OVER (PARTITION BY "check", split ORDER BY key) AS place, sum(n) OVER (PARTITION BY "check", split) AS n FROM (SELECT "check", split, key, sum(n) AS n FROM f GROUP BY ALL))
  SELECT "check", split, CAST(max(n) AS BIGINT) AS n, string_agg(key, ',' ORDER BY key) AS samples FROM k WHERE place <= {contract.SAMPLES} GROUP BY 1, 2"""


_NEXT = "CASE split WHEN 'train' THEN 'train, val' WHEN 'val' THEN 'val, test' ELSE 'train, test' END"


def _twice(rows):
    """Rows of kind 0 have their first stage twice, those of kind 1 lack the second, those of kind 6 stand in the next split, too, those of kind 8 in one of no name."""
    stage1 = F.col("stage") == "stage1" if "stage" in rows.columns else F.col("extra_info.stage") == "stage1"
    kept = rows.where(~((F.col("kind") == 1) & ~stage1)).withColumn("split", F.when(F.col("kind") == 8, "dev").otherwise(F.col("split")))
    after = F.when(F.col("split") == "train", "val").when(F.col("split") == "val", "test").otherwise("train")
    return kept.withColumn("split", F.explode(F.when((F.col("kind") == 0) & stage1, F.array("split", "split")).when(F.col("kind") == 6, F.array(F.col("split"), after)).otherwise(F.array("split"))))


_SFT_ROLES, _RL_ROLES = "messages are not system, user, assistant", "messages are not system, user"
_TWICE = [_fault("one row a stage is needed", "kind < 2"), _fault("key in two splits", "kind = 6", split=_NEXT), _fault("unknown split", "kind = 8", "2", "'dev'")]
_SFT_FAULTS = [
    *_TWICE,
    *[_fault(name, "kind = 2", "2") for name in (_SFT_ROLES, "message without text", "chat template written into a message", "prompt is not that of registry and task", "answer is not that of the stage")],
    _fault("ground truth is not in the registry", "kind = 3", "2"), _fault("answer is not that of the stage", "kind = 3"),
    _fault("candidates are not in the reproducible order", "kind = 4"), _fault("prompt is not that of registry and task", "kind = 4"),
    _fault("answer is not that of the stage", "kind = 4 AND a2 <> truth"), _fault("stages differ", "kind = 4"),
    _fault("metadata fields are not those of the task", "kind = 5", "2"), _fault("prompt is not that of registry and task", "kind = 5", "2"),
    _fault("chat template written into a message", "kind = 7"), _fault("prompt is not that of registry and task", "kind = 7"),
    _fault("blank source id", "kind = 9", "2", key="''"), _fault("candidates are not in the reproducible order", "kind = 9", "2", key="''"),
]


@query(_contract_sql(_SFT_FAULTS))
def dataset_contract(spark, sf_dir):
    """An export of fine-tuning rows with a fault of every kind, judged in one scan."""
    kind, second = F.col("kind"), F.col("stage") == "stage2"
    marked = F.transform("messages", lambda m, k: F.struct(m["role"].alias("role"), F.when(k == 1, F.concat(m["content"], F.lit("<|im_end|>"))).otherwise(m["content"]).alias("content")))
    rows = export.sft_rows(_clean_export(spark, sf_dir), "split", "kind").withColumns({
        "messages": F.when(kind == 2, F.lit(None)).when((kind == 7) & ~second, marked).otherwise(F.col("messages")),
        "ground_truth": F.when(kind == 3, "ZZ").otherwise(F.col("ground_truth")),
        "candidates": F.when((kind == 4) & second, F.reverse("candidates")).otherwise(F.col("candidates")),
        "metadata": F.when(kind == 5, F.replace("metadata", F.lit('"order"'), F.lit('"other"'))).otherwise(F.col("metadata")),
        "source_id": F.when(kind != 9, F.col("source_id")),
    })
    found = contract.run(_twice(rows), contract.sft_contract(_task(spark, sf_dir)))
    return found.withColumn("samples", F.array_join("samples", ","))


_RL_FAULTS = [
    *_TWICE,
    *[_fault(name, "kind = 2", "2") for name in (_RL_ROLES, "message without text", "chat template written into a message", "prompt is not that of registry and task")],
    _fault("ground truth is not in the registry", "kind = 3"), _fault("stages differ", "kind = 3"),
    _fault("stage1 shows candidates", "kind = 4"), _fault("unknown ability", "kind = 5", "2"), _fault("unknown reward style", "kind = 7", "2"),
    _fault("data source is not dataset and stage", "kind = 10"), _fault("unknown dataset", "kind = 11", "2"),
]


@query(_contract_sql(_RL_FAULTS))
def rl_dataset_contract(spark, sf_dir):
    """An export of reinforcement rows with a fault of every kind, judged in one scan."""
    kind, first, info = F.col("kind"), F.col("extra_info.stage") == "stage1", F.col("extra_info")
    model = F.col("reward_model")
    rows = datasets.rl("orders")(_clean_export(spark, sf_dir).withColumn("split", F.struct("split", "kind"))).select("*", "split.kind").withColumn("split", F.col("split.split")).withColumns({
        "prompt": F.when(kind == 2, F.lit(None)).otherwise(F.col("prompt")),
        "reward_model": F.when((kind == 3) & first, model.withField("ground_truth", F.lit("ZZ"))).when(kind == 7, model.withField("style", F.lit("x"))).otherwise(model),
        "extra_info": F.when((kind == 4) & first, info.withField("candidates", F.array(F.lit("N0")))).when(kind == 11, info.withField("dataset", F.lit("x"))).otherwise(info),
        "ability": F.when(kind == 5, "x").otherwise(F.col("ability")),
        "data_source": F.when((kind == 10) & first, "orders/stage2").otherwise(F.col("data_source")),
    })
    found = contract.run(_twice(rows), contract.rl_contract(_task(spark, sf_dir), "orders"))
    return found.withColumn("samples", F.array_join("samples", ","))


def _items(spark, sf_dir):
    """Parts as nested items: some fields null, every ninth without a label."""
    p = spread(records(spark, sf_dir))
    bare = F.col("row_no") % 9 == 0
    level = lambda c: F.when(bare, "").otherwise(F.col(c))
    metadata = [F.col("level_2").alias("table_name"), F.col("level_4").alias("field_name"), F.when(F.col("row_no") % 4 == 0, F.col("level_1")).alias("field_description")]
    metadata += [F.lit(" ").alias(c) for c in export.METADATA_LABELS if c not in ("table_name", "field_name", "field_description")]
    item = F.struct("id", F.struct(*metadata).alias("metadata"), F.struct(*[level(f"level_{i}").alias(f"level_{i}") for i in range(1, 5)]).alias("classification"), F.when(bare, "unlabeled").otherwise("labeled").alias("label_status"), F.when(~bare, F.col("data_level")).alias("data_level"))
    return p.select("row_no", _split_of(F.col("row_no")).alias("split"), F.parse_json(F.to_json(item, {"ignoreNullFields": "false"})).alias("item"))


def _escaped(x):
    return json.dumps(x, ensure_ascii=False)[1:-1].replace("'", "''")


@query(f"""WITH {REGISTRY}, r AS (SELECT *, CASE row_no % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM records),
  u AS (SELECT *, '{_escaped(export.USER_HEAD)}\\n表名称：' || level_2 || '\\n字段名称：' || level_4 || CASE WHEN row_no % 4 = 0 THEN '\\n字段描述：' || level_1 ELSE '' END AS said,
    '{{"classification":{{"level_1":"' || level_1 || '","level_2":"' || level_2 || '","level_3":"","level_4":"' || level_4 || '"}},"data_level":"' || data_level || '"}}' AS answer FROM r WHERE row_no % 9 <> 0),
  l AS (SELECT split, '{{"messages":[{{"role":"developer","content":"{_escaped(rft.DEVELOPER_PROMPT)}"}},{{"role":"user","content":"' || said || '"}}],"reference_answer":' || answer || ',"reference_answer_json":"' || replace(answer, '"', '\\"') || '","source_id":"' || id || '"}}' AS line FROM u)
  SELECT split, 'input_records' AS metric, CAST(count(*) AS BIGINT) AS n, '' AS digest FROM r GROUP BY 1 UNION ALL SELECT split, 'exported_records', count(*), '' FROM u GROUP BY 1
  UNION ALL SELECT split, 'skipped_unlabeled', count(*) FILTER (row_no % 9 = 0), '' FROM r GROUP BY 1
  UNION ALL SELECT split, 'lines', count(*), min(sha256(line)) FROM l GROUP BY 1""")
def rft_export(spark, sf_dir):
    """The report of an export as JSON lines, and the lines that its files hold."""
    path = f"{writers.scratch_folder(spark)}/rft-{uuid.uuid4().hex}"
    report = rft.export_rft(_items(spark, sf_dir).drop("row_no"), path)
    rows = spark.createDataFrame([(s, name, n, "") for s, found in report["splits"].items() for name, n in found.items()], "split string, metric string, n long, digest string")
    lines = spark.read.text(path).groupBy("split").agg(F.lit("lines").alias("metric"), F.count("*").alias("n"), F.min(F.sha2("value", 256)).alias("digest"))
    return rows.union(lines)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' WHEN 4 THEN 'missing' ELSE 'present' END AS state, CASE p_partkey % 5 WHEN 2 THEN p_brand WHEN 3 THEN CAST(p_size AS VARCHAR) END AS value,
  CASE p_partkey % 5 WHEN 2 THEN p_brand WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS label FROM part""")
def nested_fields(spark, sf_dir):
    """A field that is absent, null, a text, a number, or behind something that is no object."""
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, '{"a":{}}').when(k == 1, '{"a":{"b":null}}').when(k == 2, F.concat(F.lit('{"a":{"b":"'), "p_brand", F.lit('"}}'))).when(k == 3, F.concat(F.lit('{"a":{"b":'), F.col("p_size").cast("string"), F.lit("}}"))).otherwise('{"a":["b"]}')
    document = F.parse_json(said)
    found = nested.get(document, "a.b")
    return table(spark, sf_dir, "part").select("p_partkey", found["state"].alias("state"), found["value"].alias("value"), nested.label(document, "a.b").alias("label"))


@query("""WITH k AS (SELECT p_partkey, p_partkey % 3 AS kind, p_size % 4 AS items FROM part),
  c AS (SELECT '$' AS path, 'object' AS kinds, count(*) AS n, 0 AS nulls FROM k
    UNION ALL SELECT '$.key', 'integer', count(*), 0 FROM k
    UNION ALL SELECT '$.size', 'integer,null', count(*), count(*) FILTER (kind = 1) FROM k
    UNION ALL SELECT '$.tags', 'array', count(*), 0 FROM k
    UNION ALL SELECT '$.tags[]', 'string', sum(items), 0 FROM k
    UNION ALL SELECT '$.more', 'object,string', count(*) FILTER (kind > 0), 0 FROM k
    UNION ALL SELECT '$.more.price', 'number', count(*) FILTER (kind = 2), 0 FROM k
    UNION ALL SELECT '$.more.at', 'array', count(*) FILTER (kind = 2), 0 FROM k
    UNION ALL SELECT '$.more.at[]', 'object', count(*) FILTER (kind = 2), 0 FROM k
    UNION ALL SELECT '$.more.at[].ok', 'boolean', count(*) FILTER (kind = 2), 0 FROM k)
  SELECT path, kinds, CAST(n AS BIGINT) AS n, CAST(nulls AS BIGINT) AS nulls FROM c""")
def dictionary_census(spark, sf_dir):
    """Keys and types of nested documents of parts, whose fields differ by part."""
    kind = F.col("p_partkey") % 3
    more = F.when(kind == 1, F.lit(',"more":"none"')).when(kind == 2, F.lit(',"more":{"price":1.5,"at":[{"ok":true}]}')).otherwise("")
    size = F.when(kind == 1, "null").otherwise(F.col("p_size").cast("string"))
    tags = F.array_join(F.array_repeat(F.lit('"x"'), (F.col("p_size") % 4).cast("int")), ",")
    text_ = F.concat(F.lit('{"key":'), F.col("p_partkey").cast("string"), F.lit(',"size":'), size, F.lit(',"tags":['), tags, F.lit("]"), more, F.lit("}"))
    return census.census(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.parse_json(text_).alias("v")), "v").withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size % 3 + 1 END AS INT) AS depth, CAST(count(*) AS BIGINT) AS n, min(CASE p_size % 3 WHEN 0 THEN 'A' || p_size WHEN 1 THEN 'A' || p_size || '-1' ELSE 'A' || p_size || '-1-2' END) AS first FROM part WHERE p_size % 10 <> 0 GROUP BY 1")
def code_depths(spark, sf_dir):
    head = F.concat(F.lit("A"), F.col("p_size").cast("string"))
    code = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 3 == 0, head).when(F.col("p_size") % 3 == 1, F.concat(head, F.lit("-1"))).otherwise(F.concat(head, F.lit("-1-2")))
    return census.code_depths(table(spark, sf_dir, "part").select(code.alias("code")), "code")


_RENDERED = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"


@query(f"""WITH c AS (SELECT conv_id, count(*) AS turns, sum(length(coalesce(text, ''))) AS chars, sum(len(list_filter(regexp_split_to_array({_RENDERED}, '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS tokens FROM conversations GROUP BY 1),
  s AS (SELECT *, CASE conv_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM c)
  SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(max(tokens) AS BIGINT) AS max_tokens, first(conv_id ORDER BY tokens DESC, conv_id) AS longest, CAST(count(*) FILTER (tokens > 300) AS BIGINT) AS over_limit FROM s GROUP BY 1""")
def conversation_budget(spark, sf_dir):
    """Conversations under a chat template by split, against a limit of tokens."""
    counted = conversations.conversation_tokens(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", lambda t: len(t.split()))
    return conversations.budget(counted.withColumn("split", _split_of(F.col("conv_id"))), "split", "conv_id", "tokens", 300)


@query(f"""WITH c AS (SELECT conv_id, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1), r AS (SELECT conv_id % 3 AS part, chars, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY chars) AS k, count(*) OVER (PARTITION BY conv_id % 3) AS n FROM c)
  SELECT part, CAST(count(*) AS BIGINT) AS rows, CAST(max(chars) AS BIGINT) AS max, CAST(min(chars) FILTER (k = greatest(1, CAST(floor(n::DOUBLE * 0.95::DOUBLE) AS BIGINT))) AS BIGINT) AS p95, CAST(sum(chars) AS DOUBLE) / count(*) AS mean FROM r GROUP BY 1""")
def conversation_lengths(spark, sf_dir):
    """Characters of whole conversations, by a third of them."""
    turns = table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long")).alias("chars")).withColumn("part", F.col("conv_id") % 3)
    return scoring.legacy_p95(whole, "part", "chars")
