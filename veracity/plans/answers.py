"""Queries over texts, steps and samples, with their expected results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import steps as step_functions
from ..functions import text as tx
from ..operators import samples as sm
from ..operators import folds, recorder, records, spans, tokens
from ..operators.reports import cost_by_tier, shown
from ..sources import adapters as ad
from . import oracle
from .oracle import shown as sql_shown


def _md5(c: str, name: str):
    return F.md5(F.col(c)).alias(name)


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ad.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_answer(F.coalesce("text", F.lit(""))).alias("a"))
    return found.select("doc_id", F.length("a").cast("long").alias("length"), _md5("a", "normalized_md5"))


def extract_short_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.extract_short_answer(F.col("text")).alias("short_answer"))


def alias_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.alias_text(spark, sf_dir).select("id", tx.score_alias(F.col("generation"), F.col("aliases")).alias("correct"), tx.canonical_answer(F.lit("nq_open"), F.col("generation")).alias("canonical"))


def extract_final_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.number_text(spark, sf_dir).select("id", shown(tx.extract_final_number(F.col("generation"))).alias("number"))


def score_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.number_text(spark, sf_dir)
    return rows.select("id", tx.score_generation(F.lit("gsm8k"), F.col("generation"), F.array("gold")).alias("correct"))


def canonical_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.number_text(spark, sf_dir).withColumn("canonical", tx.canonical_answer(F.lit("gsm8k"), F.col("generation")))
    return rows.select("id", "canonical", tx.score_canonical(F.lit("gsm8k"), F.col("canonical"), F.array("gold")).alias("correct"))


def verbalized_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "events").select("event_id", shown(tx.verbalized_confidence(F.col("props"))).alias("confidence"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "conversations").where("role = 'user'")
    task = F.when(F.col("conv_id") % 2 == 0, "nq_open").otherwise("gsm8k")
    first, asked = tx.chat_messages(task, F.col("text")), tx.confidence_messages(task, F.col("text"), F.lit("42"))
    return rows.select("conv_id", "turn", F.size(asked).cast("long").alias("n_messages"), F.md5(tx.render_prompt(first)).alias("prompt_md5"), F.md5(tx.render_prompt(asked)).alias("confidence_md5"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.snippet(F.col("text")).alias("snippet"))


def answer_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One character a token."""
    rows = ad.number_text(spark, sf_dir).withColumn("span", step_functions.answer_span(F.split("generation", "")))
    return rows.select("id", F.col("span.start").cast("long").alias("span_start"), F.col("span.end").cast("long").alias("span_end"))


def decoded_answer_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans through a decoder of token ids; a token is a character here."""

    def decode(generations: list[list[int]]) -> list[str]:
        return ["".join(map(chr, ids)) for ids in generations]

    rows = ad.number_text(spark, sf_dir).select("id", F.transform(F.split("generation", ""), lambda c: F.ascii(c)).alias("token_ids"))
    found = spans.with_answer_span(rows, decode)
    return found.select("id", F.col("answer_span.start").cast("long").alias("span_start"), F.col("answer_span.end").cast("long").alias("span_end"))


def recorded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embeddings stand for the logits of a sequence's steps; the token drawn from one is told by the next, the last one's only in every other sequence."""
    v = F.col("vec_id")
    token = F.pmod(v * 7, F.lit(64)).cast("int")
    blocks = ad.table(spark, sf_dir, "embeddings").select(
        F.floor(v / 8).alias("seq_id"), (v % 8).cast("int").alias("step"), F.col("embedding").alias("logits"), F.when(v % 8 > 0, token).alias("input_token"), F.when((v % 8 == 7) & (v % 16 == 7), F.col("label")).alias("final_token"),
    )
    found = recorder.record_steps(blocks, ends=[63])
    return found.select("seq_id", F.col("step").cast("long").alias("step"), F.col("token").cast("long").alias("token"), *[shown(F.col(c)).alias(c) for c in ("entropy", "max_probability", "margin", "chosen_log_probability")])


def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = step_functions.step_statistics(F.col("logits"))
    found = ad.logits(spark, sf_dir).withColumn("s", s)
    return found.select("seq_id", shown(F.col("s.entropy")).alias("entropy"), shown(F.col("s.max_probability")).alias("max_probability"), shown(F.col("s.margin")).alias("margin"), shown(step_functions.normalized_entropy(F.col("s.entropy"), F.lit(64))).alias("normalized_entropy"))


def chosen_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.logits(spark, sf_dir).select("seq_id", shown(step_functions.chosen_log_probability(F.col("logits"), F.col("chosen"))).alias("log_probability"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.order_steps(spark, sf_dir).withColumn("s", step_functions.step_statistics(F.col("logits")))
    return rows.select("seq_id", "step", "span_start", "span_end", "s.*", step_functions.chosen_log_probability(F.col("logits"), F.col("chosen")).alias("chosen_log_probability"))


_NINE = ("mean_entropy", "max_entropy", "log_perplexity", "mean_max_prob", "min_max_prob", "mean_margin", "min_margin", "seq_log_prob", "seq_prob")


def token_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_uncertainty(_steps(spark, sf_dir)).select("seq_id", *[shown(F.col(c)).alias(c) for c in _NINE], "num_tokens")


def answer_span_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.span_uncertainty(_steps(spark, sf_dir))
    return found.select("seq_id", shown(F.col("mean_entropy")).alias("mean_entropy"), *[shown(F.col(f"answer_{c}")).alias(f"answer_{c}") for c in _NINE], "answer_num_tokens")


def lexical_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sm.entropy_of_counts(ad.order_samples(spark, sf_dir), "answer")
    return found.select("prompt_id", shown(F.col("entropy")).alias("lexical_entropy"), shown(F.col("consistency")).alias("self_consistency"), F.col("distinct").alias("num_distinct_answers"))


def user_lexical_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty answers count as answers here."""
    found = sm.entropy_of_counts(ad.user_samples(spark, sf_dir), "answer")
    return found.select("prompt_id", shown(F.col("entropy")).alias("lexical_entropy"), shown(F.col("consistency")).alias("self_consistency"), F.col("distinct").alias("num_distinct_answers"))


def majority_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.majority_answer(ad.order_samples(spark, sf_dir, "o_orderstatus"))


def user_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty answers don't vote."""
    return sm.majority_answer(ad.user_samples(spark, sf_dir))


def sample_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_agreement(ad.order_samples(spark, sf_dir)).select("prompt_id", shown(F.col("agreement")).alias("agreement"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities whose first digits differ by at most one mean the same: not a transitive relation, so the order decides."""
    digit = lambda c: F.substring(c, 1, 1).cast("int")
    return sm.semantic_clusters(ad.order_samples(spark, sf_dir), lambda a, b: F.abs(digit(a) - digit(b)) <= 1)


def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("prompt_id", "sample_idx", "answer", F.col("label").cast("long").alias("label"))


def sentence_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sm.sentence_uncertainty(_labelled(spark, sf_dir))
    floats = ("semantic_entropy", "weighted_semantic_entropy", "lexical_entropy", "self_consistency", "semantic_self_consistency")
    return found.select("prompt_id", *[shown(F.col(c)).alias(c) for c in floats], "num_semantic_clusters", "num_distinct_answers")


def model_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters as semantic_clusters, folded in one pass; a function as a model's, which sees question and answer, decides in batches of pairs of many prompts."""

    def near(pairs: list[tuple[str, str]]) -> list[bool]:
        digit = lambda said: int(said.rpartition("? ")[2][0])
        return [abs(digit(a) - digit(b)) <= 1 for a, b in pairs]

    rows = ad.order_samples(spark, sf_dir).withColumn("question", F.concat(F.lit("How urgent is "), F.col("prompt_id").cast("string"), F.lit("?")))
    found = folds.fold_clusters(rows, folds.both_ways(near))
    return found.select("prompt_id", "sample_idx", "answer", F.col("label").cast("long").alias("label"))


def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of stand-in generations, flat: texts as digests, some of the signals."""
    made = records.assemble(*ad.part_generations(spark, sf_dir), same=lambda a, b: F.length(a) == F.length(b))
    some = ("mean_entropy", "seq_log_prob", "answer_min_margin", "semantic_entropy", "weighted_semantic_entropy", "num_semantic_clusters", "verbalized_confidence")
    return made.select(
        "example_id", "task", "greedy_num_tokens", "greedy_correct", "greedy_canonical", F.array_join("answer_span", "-").alias("span"), F.md5(F.array_join("sample_texts", "|")).alias("samples_md5"),
        F.array_join("sample_canonical", "|").alias("sample_canonical"), "majority_answer", "majority_correct", F.array_join("sample_correct", "|").alias("sample_correct"), *[shown(F.element_at("signals", s)).alias(s) for s in some],
    )


def weighted_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood-weighted entropy of event kinds."""
    return sm.weighted_entropy(ad.user_samples(spark, sf_dir), "answer").select("prompt_id", shown(F.col("weighted_entropy")).alias("weighted_entropy"))


def tier_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_by_tier(ad.timings(spark, sf_dir)).select("task", "cost_tier", shown(F.col("mean_seconds")).alias("mean_seconds"))


QUERIES = {f.__name__: f for f in (normalize_answer, extract_short_answer, alias_exact_match, extract_final_number, score_numeric, canonical_number, verbalized_confidence, chat_messages, snippets, answer_span, decoded_answer_span, recorded_steps, step_statistics, chosen_logprob, token_uncertainty, answer_span_uncertainty, lexical_entropy, user_lexical_entropy, majority_answer, user_majority, sample_agreement, semantic_clusters, sentence_uncertainty, weighted_entropy, model_clusters, record_assembly)} | {"cost_by_tier": tier_costs}

_WS = r"[\s\x0B]"
_NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '[\s\x0B]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_STRIP = r"regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_SHORT = _STRIP.format(r"regexp_replace(" + _STRIP.format(r"regexp_replace(split_part(" + _STRIP.format("{}") + r", chr(10), 1), '^[\s\x0B]*(the[\s\x0B]+answer[\s\x0B]+is|answer[\s\x0B]*:|a[\s\x0B]*:)[\s\x0B]*', '', 'i')") + r", '\.+$', '')")
_PRICE = "format('{:,.2f}', p_retailprice)"
_NUMBER_TEXT = f"""number_text AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'So ' || p_name || 's cost ' || price || '.' || chr(10) || '#### ' || price
  WHEN 1 THEN 'It is ' || p_size || ' and then ' || price || '.' WHEN 2 THEN 'It is ' || p_size || ' ####' WHEN 3 THEN '#### 1 and again #### -' || p_size || '.0' WHEN 4 THEN 'no idea'
  ELSE '#####' || price || ' (that is ' || p_size || ' times)' END AS generation, '#### ' || CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) ELSE price END AS gold FROM (SELECT *, {_PRICE} AS price FROM part))"""
_RE = r"'-?\d[\d,]*(?:\.\d+)?'"
_FINAL = f"TRY_CAST(replace(coalesce(CASE WHEN contains({{0}}, '####') THEN regexp_extract_all(list_last(string_split({{0}}, '####')), {_RE})[1] END, list_last(regexp_extract_all({{0}}, {_RE}))), ',', '') AS DOUBLE)"
_FORMAT = "CASE WHEN v IS NULL THEN '' WHEN abs(v - round_even(v, 0)) <= 1e-4 THEN CAST(CAST(round_even(v, 0) AS DECIMAL(38, 0)) AS VARCHAR) ELSE printf('%.6g', v) END"
_SYSTEM = "CASE WHEN conv_id % 2 = 0 THEN '" + tx.SYSTEM_PROMPTS["nq_open"].replace("'", "''") + "' ELSE '" + tx.SYSTEM_PROMPTS["gsm8k"].replace("'", "''") + "' END"
_CHAT = f"'<|system|>' || chr(10) || {_SYSTEM} || chr(10) || '<|user|>' || chr(10) || text || chr(10)"
_SOFT = "WITH z AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), l AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS t FROM z)"


def _summary(prefix: str, inside: str | None) -> list[str]:
    pick = lambda c: c if inside is None else f"CASE WHEN {inside} THEN {c} END"
    made = [f"avg({pick('entropy')})", f"max({pick('entropy')})", f"-sum({pick('chosen_log_probability')}) / count({pick('entropy')})", f"avg({pick('max_probability')})", f"min({pick('max_probability')})", f"avg({pick('margin')})", f"min({pick('margin')})", f"sum({pick('chosen_log_probability')})", f"exp(sum({pick('chosen_log_probability')}))"]
    return [f"{sql_shown(x)} AS {prefix}{n}" for x, n in zip(made, _NINE, strict=True)]


_INSIDE = "span_start IS NULL OR step >= span_start AND step < span_end"
_ENTROPY = "SELECT prompt_id, {0} AS lexical_entropy, {1} AS self_consistency, count(*) AS num_distinct_answers FROM (SELECT prompt_id, answer, CAST(count(*) AS DOUBLE) AS n FROM samples GROUP BY ALL) GROUP BY prompt_id".format(sql_shown("greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0e0)"), sql_shown("max(n) / sum(n)"))
_MAJORITY = "counts AS (SELECT prompt_id, answer, count(*) AS n, min(sample_idx) AS first FROM samples GROUP BY ALL), won AS (SELECT prompt_id, answer, n FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, first) AS r FROM counts WHERE answer <> '') WHERE r = 1)"
_VOTES = "SELECT prompt_id, coalesce(answer, '') AS majority_answer, CAST(coalesce(n, 0) AS BIGINT) AS votes FROM (SELECT DISTINCT prompt_id FROM samples) LEFT JOIN won USING (prompt_id)"
#: Greedy clusters: one step of the recursion is one answer of each prompt in first-seen order.
_CLUSTERS = """seen AS (SELECT prompt_id, answer, CAST(substr(answer, 1, 1) AS INT) AS d, row_number() OVER (PARTITION BY prompt_id ORDER BY min(sample_idx)) AS k FROM samples GROUP BY prompt_id, answer),
  fold(prompt_id, k, reps, label) AS (SELECT prompt_id, k, [d], 0 FROM seen WHERE k = 1 UNION ALL
    SELECT f.prompt_id, s.k, CASE WHEN hit > 0 THEN reps ELSE list_append(reps, d) END, CAST(CASE WHEN hit > 0 THEN hit - 1 ELSE len(reps) END AS INT) FROM
      (SELECT f.prompt_id, s.k, f.reps, s.d, coalesce(list_position(list_transform(f.reps, lambda r: abs(s.d - r) <= 1), true), 0) AS hit FROM fold f JOIN seen s ON s.prompt_id = f.prompt_id AND s.k = f.k + 1) AS s, LATERAL (SELECT s.prompt_id) AS f(prompt_id)),
  labelled AS MATERIALIZED (SELECT x.prompt_id, x.sample_idx, x.answer, x.logp, f.label FROM samples x JOIN seen s USING (prompt_id, answer) JOIN fold f ON f.prompt_id = s.prompt_id AND f.k = s.k)"""
_ORDERS = oracle.SAMPLES.format(answer="o_orderpriority")


def _entropy_of(label: str) -> str:
    return f"SELECT prompt_id, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0e0) AS h, max(n) / sum(n) AS c, count(*) AS d FROM (SELECT prompt_id, {label}, CAST(count(*) AS DOUBLE) AS n FROM labelled GROUP BY ALL) GROUP BY prompt_id"


def _weighted(label: str, rows: str) -> str:
    return f"SELECT prompt_id, greatest(ln(sum(m)) - sum(CASE WHEN m > 0 THEN m * ln(m) ELSE 0 END) / sum(m), 0e0) AS w FROM (SELECT prompt_id, {label}, sum(exp(logp - top)) AS m FROM (SELECT *, max(logp) OVER (PARTITION BY prompt_id) AS top FROM {rows}) GROUP BY ALL) GROUP BY prompt_id"


_SPANS = f"""WITH {_NUMBER_TEXT}, p AS (SELECT id, generation AS t, list_filter(range(1, length(generation) + 1), lambda i: substr(generation, i, 4) = '####') AS places FROM number_text),
  q AS (SELECT *, list_max(list_filter(range(1, len(places) + 1), lambda j: regexp_matches(substr(t, places[j] + 4), '\\d'))) AS needed FROM p),
  r AS (SELECT *, list_min(list_filter(range(1, length(t) + 1), lambda k: len(string_split(substr(t, 1, k), '####')) - 1 >= needed)) AS s FROM q)
  SELECT id, CAST(CASE WHEN needed IS NOT NULL THEN s END AS BIGINT) AS span_start, CAST(CASE WHEN needed IS NOT NULL AND s IS NOT NULL THEN length(t) END AS BIGINT) AS span_end FROM r"""

#: Records of the stand-in generations. Answers mean the same if they are equally long, so a length is a cluster.
_RECORDS = f"""WITH {_NUMBER_TEXT}, spans AS ({_SPANS}), base AS (SELECT id, generation, {_FINAL.format("gold")} AS gold FROM number_text),
  said AS (SELECT *, {_FINAL.format("text")} AS v FROM (SELECT id, gold, k, CASE k WHEN 0 THEN generation WHEN 1 THEN '#### ' || (id % 4) ELSE 'It is ' || (id % 3 + 1) END AS text, (-(id % 13) / 1e1 - k / 1e1) / 2 AS logp FROM base, range(0, 3) AS t(k))),
  canon AS (SELECT *, {_FORMAT} AS a FROM said), judged AS (SELECT *, a <> '' AND coalesce(abs({_FINAL.format("('#### ' || a)")} - gold) <= 1e-4, false) AS ok FROM canon),
  votes AS (SELECT id, a, count(*) AS n, min(k) AS first, bool_or(ok) AS ok FROM judged WHERE a <> '' GROUP BY id, a), won AS (SELECT id, a, ok FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1),
  kinds AS (SELECT id, length(a) AS label, CAST(count(*) AS DOUBLE) AS n, sum(exp(logp)) AS m FROM judged GROUP BY ALL), meant AS (SELECT id, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0e0) AS h, greatest(ln(sum(m)) - sum(m * ln(m)) / sum(m), 0e0) AS w, CAST(count(*) AS DOUBLE) AS d FROM kinds GROUP BY id),
  listed AS (SELECT id, md5(string_agg(text, '|' ORDER BY k)) AS samples_md5, string_agg(a, '|' ORDER BY k) AS sample_canonical, string_agg(CAST(ok AS VARCHAR), '|' ORDER BY k) AS sample_correct FROM judged GROUP BY id),
  one AS (SELECT id, a AS greedy_canonical, coalesce(abs(v - gold) <= 1e-4, false) AS greedy_correct FROM judged WHERE k = 0),
  steps AS (SELECT id, avg((i % 7) / 7e0) AS h, -sum(i % 11) / 5e1 AS p FROM base, LATERAL (SELECT unnest(range(1, length(generation) + 1)) AS i) GROUP BY id),
  within AS (SELECT id, min(i % 3) / 4e0 AS margin FROM spans, LATERAL (SELECT unnest(range(span_start + 1, span_end + 1)) AS i) GROUP BY id)
SELECT format('gsm8k-{{:06d}}', b.id) AS example_id, 'gsm8k' AS task, CAST(length(generation) AS INT) AS greedy_num_tokens, greedy_correct, greedy_canonical, span_start || '-' || span_end AS span, samples_md5, sample_canonical,
  coalesce(won.a, '') AS majority_answer, coalesce(won.ok, false) AS majority_correct, sample_correct, {sql_shown("steps.h")} AS mean_entropy, {sql_shown("steps.p")} AS seq_log_prob, {sql_shown("within.margin")} AS answer_min_margin, {sql_shown("meant.h")} AS semantic_entropy,
  {sql_shown("meant.w")} AS weighted_semantic_entropy, meant.d AS num_semantic_clusters, {sql_shown("CASE WHEN b.id % 5 <> 0 AND b.id % 120 <= 100 THEN (b.id % 120) / 1e2 END")} AS verbalized_confidence
FROM base b JOIN listed USING (id) JOIN one USING (id) JOIN meant USING (id) JOIN steps USING (id) JOIN spans USING (id) LEFT JOIN won USING (id) LEFT JOIN within USING (id)"""

ORACLE_SQL = {
    "record_assembly": _RECORDS,
    "normalize_answer": f"SELECT doc_id, CAST(length(a) AS BIGINT) AS length, md5(a) AS normalized_md5 FROM (SELECT doc_id, {_NORM.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS a FROM documents)",
    "extract_short_answer": f"SELECT conv_id, turn, {_SHORT.format('text')} AS short_answer FROM conversations",
    "alias_exact_match": f"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'The answer is The ' || p_name || '!' WHEN 1 THEN ' Answer: ' || upper(p_name) || '..' || chr(10) || 'more' WHEN 2 THEN 'A: ' || p_brand ELSE '...' END AS generation,
  lower(p_name) AS one, regexp_replace(p_brand, '#1$', '#2') AS two FROM part), c AS (SELECT *, {_NORM.format(_SHORT.format('generation'))} AS canonical FROM t)
  SELECT id, canonical <> '' AND (canonical = {_NORM.format('one')} OR canonical = {_NORM.format('two')}) AS correct, canonical FROM c""",
    "extract_final_number": f"WITH {_NUMBER_TEXT} SELECT id, {sql_shown('v')} AS number FROM (SELECT id, {_FINAL.format('generation')} AS v FROM number_text)",
    "score_numeric": f"WITH {_NUMBER_TEXT} SELECT id, coalesce(abs(v - g) <= 1e-4, false) AS correct FROM (SELECT id, {_FINAL.format('generation')} AS v, {_FINAL.format('gold')} AS g FROM number_text)",
    "canonical_number": f"WITH {_NUMBER_TEXT}, c AS (SELECT id, g, {_FORMAT} AS canonical FROM (SELECT id, {_FINAL.format('generation')} AS v, {_FINAL.format('gold')} AS g FROM number_text)) SELECT id, canonical, coalesce(abs(TRY_CAST(canonical AS DOUBLE) - g) <= 1e-4, false) AS correct FROM c",
    "verbalized_confidence": f"SELECT event_id, {sql_shown('CASE WHEN v <= 100 THEN v / 1e2 END')} AS confidence FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '\\d{{1,3}}'), '') AS DOUBLE) AS v FROM events)",
    "chat_messages": f"""SELECT conv_id, turn, CAST(4 AS BIGINT) AS n_messages, md5({_CHAT} || '<|assistant|>' || chr(10)) AS prompt_md5,
  md5({_CHAT} || '<|assistant|>' || chr(10) || '42' || chr(10) || '<|user|>' || chr(10) || '{tx.CONFIDENCE_PROMPT}' || chr(10) || '<|assistant|>' || chr(10)) AS confidence_md5 FROM conversations WHERE role = 'user'""",
    "snippets": f"SELECT conv_id, turn, CASE WHEN length(s) > 70 THEN substr(s, 1, 69) || '…' ELSE s END AS snippet FROM (SELECT conv_id, turn, {_STRIP.format(f'regexp_replace(text, {chr(39)}{_WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} AS s FROM conversations)",
    "answer_span": _SPANS,
    "decoded_answer_span": _SPANS,
    "recorded_steps": f"""{_SOFT}, p AS (SELECT vec_id, label, z, t, list_sum(list_transform(z, lambda x: -exp(x - t) * (x - t))) AS h, list_reverse_sort(list_transform(z, lambda x: exp(x - t))) AS p FROM l),
  n AS (SELECT p.*, CASE WHEN q.vec_id IS NOT NULL THEN q.vec_id * 7 % 64 WHEN p.vec_id % 16 = 7 THEN p.label END AS token FROM p LEFT JOIN (SELECT vec_id FROM embeddings) q ON q.vec_id = p.vec_id + 1 AND q.vec_id % 8 > 0),
  e AS (SELECT *, coalesce(max(CASE WHEN token = 63 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n WHERE token IS NOT NULL)
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS step, CAST(token AS BIGINT) AS token, {sql_shown('h')} AS entropy, {sql_shown('p[1]')} AS max_probability, {sql_shown('p[1] - p[2]')} AS margin, {sql_shown('z[token + 1] - t')} AS chosen_log_probability FROM e WHERE ended = 0""",
    "step_statistics": f"""{_SOFT}, p AS (SELECT vec_id, list_sum(list_transform(z, lambda x: -exp(x - t) * (x - t))) AS h, list_reverse_sort(list_transform(z, lambda x: exp(x - t))) AS p FROM l)
  SELECT vec_id AS seq_id, {sql_shown('h')} AS entropy, {sql_shown('p[1]')} AS max_probability, {sql_shown('p[1] - p[2]')} AS margin, {sql_shown('h / (ln(64) + 1e-12)')} AS normalized_entropy FROM p""",
    "chosen_logprob": f"{_SOFT} SELECT vec_id AS seq_id, {sql_shown('z[label + 1] - t')} AS log_probability FROM l",
    "token_uncertainty": f"WITH {oracle.STEPS} SELECT seq_id, {', '.join(_summary('', None))}, count(*) AS num_tokens FROM steps GROUP BY seq_id",
    "answer_span_uncertainty": f"WITH {oracle.STEPS} SELECT seq_id, {_summary('', None)[0]}, {', '.join(_summary('answer_', _INSIDE))}, count(CASE WHEN {_INSIDE} THEN 1 END) AS answer_num_tokens FROM steps GROUP BY seq_id",
    "lexical_entropy": f"WITH {_ORDERS} {_ENTROPY}",
    "user_lexical_entropy": f"WITH {oracle.USERS} {_ENTROPY}",
    "majority_answer": f"WITH {oracle.SAMPLES.format(answer='o_orderstatus')}, {_MAJORITY} {_VOTES}",
    "user_majority": f"WITH {oracle.USERS}, {_MAJORITY} {_VOTES}",
    "sample_agreement": f"WITH {_ORDERS}, {_MAJORITY} SELECT s.prompt_id, {sql_shown('avg(CASE WHEN s.answer = w.answer THEN 1e0 ELSE 0e0 END)')} AS agreement FROM samples s JOIN won w USING (prompt_id) GROUP BY s.prompt_id",
    "model_clusters": f"WITH RECURSIVE {_ORDERS}, {_CLUSTERS} SELECT prompt_id, sample_idx, answer, CAST(label AS BIGINT) AS label FROM labelled",
    "semantic_clusters": f"WITH RECURSIVE {_ORDERS}, {_CLUSTERS} SELECT prompt_id, sample_idx, answer, CAST(label AS BIGINT) AS label FROM labelled",
    "sentence_uncertainty": f"""WITH RECURSIVE {_ORDERS}, {_CLUSTERS}, t AS ({_entropy_of('answer')}), m AS ({_entropy_of('label')}), w AS ({_weighted('label', 'labelled')})
  SELECT prompt_id, {sql_shown('m.h')} AS semantic_entropy, {sql_shown('w.w')} AS weighted_semantic_entropy, {sql_shown('t.h')} AS lexical_entropy, {sql_shown('t.c')} AS self_consistency, {sql_shown('m.c')} AS semantic_self_consistency,
    m.d AS num_semantic_clusters, t.d AS num_distinct_answers FROM t JOIN m USING (prompt_id) JOIN w USING (prompt_id)""",
    "weighted_entropy": f"WITH {oracle.USERS}, w AS ({_weighted('answer', 'samples')}) SELECT prompt_id, {sql_shown('w')} AS weighted_entropy FROM w",
    "cost_by_tier": f"""SELECT task, cost_tier, {sql_shown('avg(s)')} AS mean_seconds FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'nq_open' ELSE 'gsm8k' END AS task, cost_tier,
  CASE WHEN cost_tier = 'single_pass' AND event_type = 'view' OR cost_tier = 'extra_call' AND event_type = 'signup' OR cost_tier = 'multi_sample' AND event_type IN ('click', 'purchase') THEN value ELSE 0e0 END AS s
  FROM events, (VALUES ('single_pass'), ('extra_call'), ('multi_sample')) AS t(cost_tier)) GROUP BY ALL""",
}
