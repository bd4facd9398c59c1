"""Queries over answers, replies, logs and names as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import phrases as P
from ..functions import text as T
from ..operators import compare, inventory, loaders, select
from ..operators import sentences as S
from . import binding as B
from .binding import RESPONSES, table
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fields(df, value):
    """(doc_id, the fields of a struct), the struct made once for all of them."""
    return df.select("doc_id", F.inline(F.array(value)))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _any(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(v)})" for v in values) + ")"


_LOW = f"lower({_strip('response')})"
_EARLIEST = "least(" + ", ".join(f"nullif(instr(low, {_q(p)}), 0)" for p in P.MERGED) + ")"
_MERGED = f"m AS (SELECT doc_id, response, {_LOW} AS low FROM r), a AS (SELECT doc_id, response, low, CASE WHEN coalesce(response, '') = '' THEN 1 ELSE {_EARLIEST} END AS pos FROM m)"
_NA = "regexp_matches(low, '(^|[^a-z0-9])n/a([^a-z0-9]|$)')"
_SHORT = f"(low = '' OR {_NA} OR {_any('low', P.SHORT)})"


@query(f"WITH {RESPONSES}, {_MERGED} SELECT doc_id, coalesce(pos <= {P.MERGED_CUTOFF}, false) AS is_abstained, (pos - 1)::INT AS position FROM a")
def abstention(spark, sf_dir):
    """T1, T2."""
    return _fields(B.responses(spark, sf_dir), T.abstention_hit(F.col("response"))).select("doc_id", "is_abstained", "position")


@query(f"WITH {RESPONSES}, {_MERGED} SELECT doc_id, (pos - 1)::INT AS position FROM a WHERE pos > {P.MERGED_CUTOFF}")
def abstention_late(spark, sf_dir):
    """Phrases too late to count."""
    return _fields(B.responses(spark, sf_dir), T.abstention_hit(F.col("response"))).where(f"position >= {P.MERGED_CUTOFF}").select("doc_id", "position")


@query(f"WITH {RESPONSES}, {_MERGED} SELECT doc_id, md5(response) AS response_md5 FROM a WHERE NOT coalesce(pos <= {P.MERGED_CUTOFF}, false)")
def keep_answered(spark, sf_dir):
    """F6, O2."""
    return select.keep_answered(B.responses(spark, sf_dir), "response").select("doc_id", F.md5(F.col("response").cast("binary")).alias("response_md5"))


@query(f"WITH {RESPONSES}, {_MERGED} SELECT doc_id, md5(CASE WHEN coalesce(pos <= {P.MERGED_CUTOFF}, false) THEN '' ELSE response END) AS response_md5 FROM a")
def blank_abstained(spark, sf_dir):
    """F7."""
    r = B.responses(spark, sf_dir).withColumn("flag", T.is_abstained(F.col("response")))
    return select.blank_abstained(r, "flag", "response").select("doc_id", F.md5(F.col("response").cast("binary")).alias("response_md5"))


_FIRST_PHRASE = "CASE " + " ".join(f"WHEN instr(low, {_q(p)}) > 0 THEN {_q(p)}" for p in P.PHRASES) + " END"


@query(f"WITH {RESPONSES}, m AS (SELECT doc_id, response, {_LOW} AS low FROM r) SELECT doc_id, response = '' OR ({_FIRST_PHRASE}) IS NOT NULL AS is_non_answer, CASE WHEN response = '' THEN '<empty>' ELSE {_FIRST_PHRASE} END AS phrase FROM m")
def phrase_rule(spark, sf_dir):
    """T4."""
    return _fields(B.responses(spark, sf_dir), T.phrase_rule(F.col("response"))).select("doc_id", "is_non_answer", "phrase")


_NARROW = f"(regexp_matches(response, '{P.NARROW}', 'i') AND length(regexp_extract(response, '^(.*?)({P.NARROW})', 1, 'is')) < greatest({P.NARROW_CUTOFF}, floor({P.NARROW_SHARE} * length(response))))"


@query(f"WITH {RESPONSES} SELECT doc_id, {_NARROW} AS is_abstained FROM r")
def narrow_rule(spark, sf_dir):
    """T5, A20."""
    return B.responses(spark, sf_dir).select("doc_id", T.narrow_rule(F.col("response")).alias("is_abstained"))


@query(f"WITH {RESPONSES}, m AS (SELECT doc_id, response, {_LOW} AS low FROM r), x AS (SELECT response = '' OR ({_FIRST_PHRASE}) IS NOT NULL AS a, {_NARROW} AS b FROM m) "
       "SELECT sum(a::INT)::BIGINT AS n_a, sum(b::INT)::BIGINT AS n_b, sum((a AND b)::INT)::BIGINT AS both, sum((a AND NOT b)::INT)::BIGINT AS only_a, sum((b AND NOT a)::INT)::BIGINT AS only_b, sum((a <> b)::INT)::BIGINT AS differ FROM x")  # fmt: skip
def rule_comparison(spark, sf_dir):
    """T6."""
    r = B.responses(spark, sf_dir).select(T.phrase_rule(F.col("response"))["is_non_answer"].alias("a"), T.narrow_rule(F.col("response")).alias("b"))
    return compare.rule_comparison(r, "a", "b")


@query(f"WITH {RESPONSES}, m AS (SELECT doc_id, response, {_LOW} AS low FROM r), w AS (SELECT doc_id, unnest(string_split(response, '. ')) AS response FROM r), w2 AS (SELECT doc_id, {_LOW} AS low FROM w), "
       f"n AS (SELECT doc_id, sum({_SHORT}::INT)::INT AS n_array FROM w2 GROUP BY 1) SELECT doc_id, ({_SHORT})::INT AS n_scalar, n_array, md5(CASE WHEN {_SHORT} THEN 'Unknown' ELSE response END) AS response_md5 FROM m JOIN n USING (doc_id)")  # fmt: skip
def canonicalise(spark, sf_dir):
    """An answer and the array of its sentences."""
    r = B.responses(spark, sf_dir).withColumn("parts", F.split("response", r"\. "))
    return select.canonicalise(r, "response", "parts").select("doc_id", "n_scalar", "n_array", F.md5(F.col("response").cast("binary")).alias("response_md5"))


_HINT = f"regexp_matches(question, '\\b({P.NUMERIC})\\b', 'i')"


@query(f"WITH {RESPONSES}, x AS (SELECT doc_id, response, CASE WHEN doc_id % 2 = 0 THEN 'What is the population?' ELSE 'Who was it?' END AS question FROM r) "
       f"SELECT doc_id, {_HINT} AS numeric, regexp_matches(response, '{P.EMOJI}') OR (NOT {_HINT} AND regexp_matches(response, '{P.HEX}', 'i')) OR length(response) > {P.FIELD_MOST} AS with_question, regexp_matches(response, '{P.EMOJI}') OR regexp_matches(response, '{P.HEX}', 'i') OR length(response) > {P.FIELD_MOST} AS alone FROM x")  # fmt: skip
def corruption(spark, sf_dir):
    """T9, T10, T26."""
    q = F.when(F.col("doc_id") % 2 == 0, "What is the population?").otherwise("Who was it?")
    r, c = B.responses(spark, sf_dir), F.col("response")
    return r.select("doc_id", T.numeric_hint(q).alias("numeric"), T.is_corrupt(c, q).alias("with_question"), T.is_corrupt(c).alias("alone"))


@query(f"WITH {RESPONSES}, x AS (SELECT doc_id, unnest(string_split(response, '. ')) AS t FROM r), y AS (SELECT doc_id, count(*) AS n, sum((regexp_matches(t, '{P.EMOJI}') OR regexp_matches(t, '{P.HEX}', 'i') OR length(t) > {P.FIELD_MOST})::INT) AS bad FROM x GROUP BY 1) "
       f"SELECT sum(n)::BIGINT AS n_fields, sum(bad)::BIGINT AS n_bad, round(sum(bad) / sum(n), 6) AS field_rate, round(avg((bad >= {P.BAD_FIELDS})::INT), 6) AS record_rate FROM y")  # fmt: skip
def corruption_rates(spark, sf_dir):
    """Of fields and of records with two bad fields."""
    r = B.responses(spark, sf_dir).select(F.split("response", r"\. ").alias("raw"))
    x = r.select(F.size("raw").alias("n"), F.size(F.filter("raw", lambda t: T.is_corrupt(t))).alias("bad"), T.record_is_corrupt(F.col("raw")).alias("record"))
    return x.agg(F.sum("n").alias("n_fields"), F.sum("bad").alias("n_bad"), F.round(F.sum("bad") / F.sum("n"), 6).alias("field_rate"), F.round(F.avg(F.col("record").cast("int")), 6).alias("record_rate"))


_SCAN = (
    f"f AS (SELECT doc_id, regexp_matches(response, '{P.SCAN_EMOJI}') AS emoji, regexp_matches(response, '{P.FRAGMENT}') AS uuid_fragment, "
    + _any("lower(response)", P.INSTRUCTIONS)
    + f" AS instructional, length(response) > {P.SCAN_MOST} AS anomalously_long FROM r)"
)


@query(f"WITH {RESPONSES}, {_SCAN} SELECT *, emoji OR uuid_fragment OR instructional OR anomalously_long AS any FROM f")
def corruption_flags(spark, sf_dir):
    """T12."""
    return _fields(B.responses(spark, sf_dir), T.corruption_flags(F.col("response")))


@query(f"WITH {RESPONSES}, {_SCAN} SELECT sum(emoji::INT)::BIGINT AS emoji, sum(uuid_fragment::INT)::BIGINT AS uuid_fragment, sum(instructional::INT)::BIGINT AS instructional, sum(anomalously_long::INT)::BIGINT AS anomalously_long, round(avg((emoji OR uuid_fragment OR instructional OR anomalously_long)::INT), 6) AS any_rate FROM f")
def corruption_counts(spark, sf_dir):
    """A7."""
    f = _fields(B.responses(spark, sf_dir), T.corruption_flags(F.col("response")))
    return f.agg(*[F.count_if(c).alias(c) for c in ("emoji", "uuid_fragment", "instructional", "anomalously_long")], F.round(F.avg(F.col("any").cast("int")), 6).alias("any_rate"))


# Without backreferences: for each unit length the characters on from each place that equal those a unit further,
# then matches from the left, the shortest unit first, none inside another.
_UNITS = range(1, 7)
_ENDS = "chr(10), chr(13), chr(133), chr(8232), chr(8233)"
_DEGENERATE = f"""WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS ch FROM a),
q AS (SELECT doc_id, p, {', '.join(f"CASE WHEN ch NOT IN ({_ENDS}) AND ch = lead(ch, {n}) OVER w THEN NULL ELSE p END AS b{n}" for n in _UNITS)} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, {', '.join(f"min(b{n}) OVER w - p AS r{n}" for n in _UNITS)} FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
m AS (SELECT doc_id, p, CASE {' '.join(f"WHEN r{n} >= {3 * n} THEN {n} + r{n} // {n} * {n}" for n in _UNITS)} END AS size FROM r WHERE {' OR '.join(f"r{n} >= {3 * n}" for n in _UNITS)}),
c AS (SELECT doc_id, list({{'p': p, 'e': p + size, 's': array_to_string(a[p:p + size - 1], '')}} ORDER BY p) AS cs FROM m JOIN a USING (doc_id) GROUP BY doc_id),
f AS (SELECT doc_id, cs, 1::BIGINT AS pos, NULL::VARCHAR AS hit FROM c
  UNION ALL SELECT doc_id, cs, x.e, CASE WHEN length(x.s) >= {P.DEGENERATE_LEAST} AND NOT regexp_matches(x.s, '{P.NUMBER_RUN}') THEN x.s END FROM (SELECT doc_id, cs, list_filter(cs, lambda y: y.p >= pos)[1] AS x FROM f WHERE hit IS NULL) WHERE x IS NOT NULL)
SELECT doc_id, hit AS unit FROM f WHERE hit IS NOT NULL"""


@query(_DEGENERATE)
def degenerate(spark, sf_dir):
    """The first unit that repeats, of texts that have one."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.degenerate(F.col("text")).alias("unit"))
    return d.where("unit is not null")


@query("SELECT doc_id, array_to_string(list_transform(parts, lambda x, i: CASE WHEN (doc_id + i - 1) % 3 = 0 THEN 'patched' ELSE x END), '|') AS patched FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)")
def patch_positions(spark, sf_dir):
    """Listed places of an array replaced."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\. ").alias("parts"))
    return d.select("doc_id", F.array_join(F.transform("parts", lambda x, i: F.when((F.col("doc_id") + i) % 3 == 0, "patched").otherwise(x)), "|").alias("patched"))


_WORDS = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))"
_FORMAT = (
    f"x AS (SELECT doc_id, {_strip('response')} AS t, {_LOW} AS low FROM r), f AS (SELECT doc_id, {_WORDS}::INT AS word_count, {_WORDS} > 6 AS too_long, {_any('low', P.HEDGES)} AS has_hedge, {_any('low', P.EXPLANATIONS)} AS has_explanation, "
    + "(" + " OR ".join(f"starts_with(low, {_q(s)})" for s in P.STARTERS) + ") AS has_bad_starter, "
    + f"{_any('low', P.FORMAT_REFUSALS)} AS has_refusal, ends_with(t, '.') AND {_WORDS} > 1 AS looks_like_sentence FROM x), g AS (SELECT *, NOT (too_long OR has_hedge OR has_explanation OR has_bad_starter OR has_refusal OR looks_like_sentence) AS compliant FROM f)"
)


@query(f"WITH {RESPONSES}, {_FORMAT} SELECT * FROM g")
def compliance(spark, sf_dir):
    """T16."""
    return _fields(B.responses(spark, sf_dir), T.compliance(F.col("response")))


_RATES = ["too_long", "has_hedge", "has_explanation", "has_bad_starter", "has_refusal", "looks_like_sentence", "compliant"]


@query(f"WITH {RESPONSES}, {_FORMAT} SELECT count(*) AS n, " + ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in _RATES) + ", round(avg(word_count), 6) AS avg_words FROM g")
def compliance_summary(spark, sf_dir):
    """A11."""
    f = B.responses(spark, sf_dir).select(T.compliance(F.col("response")).alias("f"))
    return compare.compliance_summary(f).withColumns({c: F.round(c, 6) for c in [*_RATES, "avg_words"]})


_REPLY = "CASE doc_id % 8 WHEN 0 THEN ' a ' WHEN 1 THEN 'The grade is B.' WHEN 2 THEN 'not_attempted' WHEN 3 THEN 'Incorrect!' WHEN 4 THEN 'correct' WHEN 5 THEN 'It is C' WHEN 6 THEN 'NOT ATTEMPTED' ELSE 'Entailment, no contradiction' END"
_UPPER = f"upper({_strip('reply')})"


@query(f"WITH x AS (SELECT doc_id, {_REPLY} AS reply FROM documents), y AS (SELECT doc_id, reply, {_UPPER} AS u, regexp_extract({_UPPER}, '\\b([ABC])\\b', 1) AS l FROM x) "
       "SELECT doc_id, CASE WHEN l = 'A' THEN 'CORRECT' WHEN l = 'B' THEN 'INCORRECT' WHEN l = 'C' THEN 'NOT_ATTEMPTED' WHEN contains(u, 'NOT_ATTEMPTED') THEN 'NOT_ATTEMPTED' WHEN contains(u, 'INCORRECT') THEN 'INCORRECT' WHEN contains(u, 'CORRECT') THEN 'CORRECT' ELSE 'NOT_ATTEMPTED' END AS grade, "
       "CASE WHEN contains(lower(reply), 'entailment') THEN 2 WHEN contains(lower(reply), 'contradiction') THEN 0 ELSE 1 END AS verdict FROM y")  # fmt: skip
def reply_labels(spark, sf_dir):
    """T17, T18."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.expr(_REPLY).alias("reply"))
    return x.select("doc_id", T.grade_letter(F.col("reply")).alias("grade"), T.entailment_label(F.col("reply")).alias("verdict"))


_STOPPED = "CASE doc_id % 3 WHEN 0 THEN concat(text, ' Question:') WHEN 1 THEN concat(text, ' Context: ') ELSE text END"


@query(f"WITH x AS (SELECT doc_id, {_strip(_STOPPED)} AS t FROM documents) SELECT doc_id, CASE WHEN ends_with(t, 'Question:') THEN {_strip('substring(t, 1, length(t) - 9)')} WHEN ends_with(t, 'Context:') THEN {_strip('substring(t, 1, length(t) - 8)')} ELSE t END AS trimmed FROM x")
def trim_stops(spark, sf_dir):
    """T19."""
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_stop(F.expr(_STOPPED)).alias("trimmed"))


_CHOICE = "CASE doc_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN ' B. it' WHEN 2 THEN 'Carbon' WHEN 3 THEN 'D)' ELSE '' END"


@query(f"SELECT doc_id, nullif(regexp_extract(trim({_CHOICE}), '^([A-D])\\b', 1), '') AS label FROM documents")
def match_labels(spark, sf_dir):
    """T20."""
    return table(spark, sf_dir, "documents").select("doc_id", T.match_label(F.expr(_CHOICE), F.array(*map(F.lit, "ABCD"))).alias("label"))


_WHOLE_CHOICE = "CASE doc_id % 5 WHEN 0 THEN concat('B. ', text) WHEN 1 THEN concat('  A) ', text) WHEN 2 THEN concat('Carbon ', text) WHEN 3 THEN concat('C', chr(10), text) ELSE text END"


@query(f"SELECT doc_id, nullif(regexp_extract({_strip(_WHOLE_CHOICE)}, '^([A-D])(?:[^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)', 1), '') AS label FROM documents")
def match_whole_replies(spark, sf_dir):
    """T20 on replies that go on with the whole text, or are the text."""
    reply = F.expr(_WHOLE_CHOICE.replace("chr(10)", "char(10)"))
    return table(spark, sf_dir, "documents").select("doc_id", T.match_label(reply, F.array(*map(F.lit, "ABCD"))).alias("label"))


_RAW_CLAIMS = "concat('- ', text, ' one. [True] (source)', chr(10), 'stray words', chr(10), '* second claim [false]', chr(10), '- no verdict')"


@query(f"WITH x AS (SELECT doc_id, unnest(string_split({_RAW_CLAIMS}, chr(10))) AS l FROM documents), y AS (SELECT doc_id, {_strip('l')} AS l FROM x), z AS (SELECT doc_id, regexp_extract(l, '^[-*]\\s*(.+?)\\s*\\[(True|False)\\]', ['c', 't'], 'i') AS m FROM y WHERE regexp_matches(l, '^[-*]\\s*(.+?)\\s*\\[(True|False)\\]', 'i')) SELECT doc_id, m.c AS claim, lower(m.t) = 'true' AS is_true FROM z")
def parse_claims(spark, sf_dir):
    """T21, B5."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.parse_claims(F.expr(_RAW_CLAIMS.replace("chr(10)", "char(10)")))).alias("c")).select("doc_id", "c.claim", "c.is_true")


_SENTENCE = r"regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')"


@query(rf"WITH a AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '. '), lambda x: {_SENTENCE}) AS a FROM documents), "
       "f AS (SELECT doc_id, a, list_position(list_transform(a, lambda x: x <> ''), true) AS f FROM a), "
       "e AS (SELECT doc_id, a, f, list_position(list_transform(a, lambda x, i: i > f AND x = ''), true) AS e FROM f) "
       "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN f IS NULL THEN '' ELSE array_to_string(a[f:coalesce(e - 1, len(a))], '|') END AS facts FROM e JOIN documents USING (doc_id)")  # fmt: skip
def parse_facts(spark, sf_dir):
    """Every sentence of a text as a bulleted line, up to one that has none."""
    raw = F.concat(F.lit("- "), F.array_join(F.split(F.regexp_replace("text", r"\s+", " "), r"\. "), "\n- "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.parse_facts(raw), "|").alias("facts"))


@query("SELECT doc_id, concat('Who is ', doc_id, '?') AS question, concat('name ', doc_id, ' -- x') AS answer FROM documents UNION ALL SELECT doc_id, '4. Where?', 'there' FROM documents")
def parse_questions(spark, sf_dir):
    """T23."""
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("1. Who is "), i, F.lit("? -- name "), i, F.lit(" -- x\nno pair\n 4. Where? -- there "))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.parse_questions(raw)).alias("p")).select("doc_id", "p.question", "p.answer")


_MD = "concat('# Title', {nl}, '- **', text, '**', {nl}, '1) `code` ', text, {nl}, '---', {nl}, 'plain *it*')"
_MD_SQL = _MD.format(nl="chr(10)")


@query(f"WITH x AS (SELECT doc_id, list_filter(string_split({_MD_SQL}, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*#{{1,6}}\\s*.*$') AND NOT regexp_matches(l, '^\\s*(-{{3,}}|\\*{{3,}})\\s*$')) AS ls FROM documents), "
       "y AS (SELECT doc_id, array_to_string(list_transform(ls, lambda l: regexp_replace(regexp_replace(l, '^\\s*[-*]\\s+', ''), '^\\s*\\d+[.)]\\s+', '')), chr(10)) AS t FROM x) SELECT doc_id, regexp_replace(regexp_replace(t, '\\*{1,3}([^*]+)\\*{1,3}', '\\1', 'g'), '`([^`]+)`', '\\1', 'g') AS cleaned FROM y")  # fmt: skip
def clean_markdown(spark, sf_dir):
    """T24."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(F.expr(_MD.format(nl="char(10)"))).alias("cleaned"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) >= 2))::INT AS n_sentences FROM documents")
def sentences(spark, sf_dir):
    """An approximation of a statistical splitter."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


_FIRST = P.SEE_SENTENCE.replace("{instruction}", P.ASK_QUESTIONS).split("{claim}")
_AFTER = P.SEE_SENTENCE_AFTER.replace("{instruction}", P.ASK_QUESTIONS).replace("{context}", "{claim}").split("{claim}")


@query(f"SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN concat({_q(_FIRST[0])}, text, {_q(_FIRST[1])}) ELSE concat({_q(_AFTER[0])}, 'Before.', {_q(_AFTER[1])}, text, {_q(_AFTER[2])}) END) AS prompt_md5 FROM benchmark")
def claim_prompts(spark, sf_dir):
    """T27."""
    context = F.when(F.col("item_id") % 2 == 1, "Before.")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.ask_questions(F.col("text"), context).cast("binary")).alias("prompt_md5"))


_STRICT = P.STRICT_PROMPT.split("{question}")


@query(f"SELECT item_id, md5(concat({_q(_STRICT[0])}, text, {_q(_STRICT[1])})) AS prompt_md5 FROM benchmark")
def strict_prompts(spark, sf_dir):
    """S16."""
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")
    return loaders.prompts(b, "strict", key="item_id").select("item_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(f"WITH t AS (SELECT item_id, text, text AS answer FROM benchmark), l AS (SELECT * FROM t ORDER BY item_id DESC LIMIT 5), p AS (SELECT concat({_q(P.FEWSHOT_HEAD)}, string_agg(concat('Question: ', text, chr(10), 'Answer: ', answer, chr(10), chr(10)), '' ORDER BY item_id)) AS prefix FROM l) "
       "SELECT item_id, md5(concat(prefix, 'Question: ', text, chr(10), 'Answer:')) AS prompt_md5 FROM t, p WHERE item_id NOT IN (SELECT item_id FROM l)")  # fmt: skip
def fewshot_prompts(spark, sf_dir):
    """The last five rows are examples and not asked."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.col("text").alias("answer"))
    return loaders.prompts(b, "fewshot", key="item_id").select("item_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("SELECT p_partkey, md5(concat('Question: ', p_name, chr(10), 'A. ', p_brand, chr(10), 'B. ', p_type, chr(10), 'Answer with only the option letter (A, B), no explanation.', chr(10), 'Answer:')) AS prompt_md5, 'A,B' AS choices, 'A' AS answer FROM part")
def choice_prompts(spark, sf_dir):
    """Options without the N/A that pads them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_type").alias("category"), F.array("p_brand", "p_type", F.lit("N/A")).alias("options"))
    p = loaders.with_options(loaders.of_category(p, None), "p_name", "options")
    return p.select("p_partkey", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.array_join("choices", ",").alias("choices"), "answer")


_MODEL = "CASE p_partkey % 4 WHEN 0 THEN concat('Org/Qwen3-', p_size, 'B') WHEN 1 THEN concat('/scratch/models/', p_brand, '/') WHEN 2 THEN concat('meta/Llama-', p_size, '.5B') ELSE p_name END"
_SHORT_NAME = f"CASE p_partkey % 4 WHEN 0 THEN concat('Qwen3-', p_size, 'B') WHEN 1 THEN p_brand WHEN 2 THEN concat('Llama-', p_size, '.5B') ELSE p_name END"


@query(f"SELECT p_partkey, {_SHORT_NAME} AS short, CASE WHEN p_partkey % 4 = 0 THEN concat(p_size, 'Bto4B') ELSE concat({_SHORT_NAME}, 'toQwen3-4B') END AS pair, CASE p_partkey % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 2 THEN 0.9 END AS top_p, CASE WHEN p_partkey % 4 = 0 THEN 20 END AS top_k FROM part")
def model_names(spark, sf_dir):
    """F14, F15, F18."""
    m = table(spark, sf_dir, "part").select("p_partkey", F.expr(_MODEL).alias("m"))
    s = m.select("p_partkey", "m", N.sampling_parameters(F.col("m")).alias("s"))
    return s.select("p_partkey", N.short_model_name(F.col("m")).alias("short"), N.pair_name(F.col("m"), F.lit("Org/Qwen3-4B")).alias("pair"), "s.top_p", "s.top_k")


_FILE = "CASE p_partkey % 3 WHEN 0 THEN concat('/d/gen_simpleqa_x_seed44_', p_size, '.jsonl') WHEN 1 THEN concat('/d/judged_simpleqa_simpleqa_', p_brand, '.jsonl') ELSE concat('/d/gen_simpleqa_', p_size, '_strict.jsonl') END"


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_brand ELSE concat(p_size, '_strict') END AS tag, CASE p_partkey % 3 WHEN 0 THEN concat('judged_simpleqa_x_seed44_', p_size, '.jsonl') WHEN 1 THEN concat('judged_judged_simpleqa_simpleqa_', p_brand, '.jsonl') ELSE concat('judged_simpleqa_', p_size, '_strict.jsonl') END AS judged FROM part")
def file_tags(spark, sf_dir):
    """F16, F17."""
    f = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILE).alias("f"))
    return f.select("p_partkey", N.tag_of(F.col("f")).alias("tag"), N.judged_name(F.col("f")).alias("judged"))


@query("SELECT s_suppkey AS id, concat('j', s_suppkey) AS label, 'local' AS backend, CASE WHEN s_suppkey % 3 = 2 THEN 'org/m:1' END AS model FROM supplier")
def judge_specs(spark, sf_dir):
    """T29."""
    spec = F.concat(F.lit("j"), F.col("s_suppkey").cast("string"), F.lit(":local"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, ":").otherwise(":org/m:1"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.judge_spec(spec).alias("j")).select("id", "j.*")


@query("WITH f AS (SELECT o_orderkey, o_orderstatus, concat('x_', o_custkey) AS tag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(l_orderkey) = 4) SELECT tag, o_orderkey FROM f WHERE o_orderstatus <> 'O' AND tag NOT IN (SELECT tag FROM f WHERE o_orderstatus = 'O')")
def pending_work(spark, sf_dir):
    """Orders as files, their items as lines, four are complete; by the tag that both file names give. Open orders stand for judgements here."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    path = lambda kind: F.concat(F.lit(f"/{kind}/{kind}_simpleqa_seed44_x_"), F.col("o_custkey").cast("string"), F.lit(".jsonl")).alias("path")
    gen = o.where("o_orderstatus <> 'O'").select(path("gen"), "n", "o_orderkey")
    done = o.where("o_orderstatus = 'O'").select(path("judged"), "n")
    return inventory.pending(gen, done, complete=4).select("tag", "o_orderkey")


@query("SELECT doc_id, regexp_replace(concat(text, chr(10), 'x'), '\\n', '', 'g') AS printable, CASE WHEN length(text) > 12 THEN concat(substring(text, 1, 12), '...') ELSE text END AS label FROM documents")
def labels_for_charts(spark, sf_dir):
    """A label's twelve characters are its feature."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.printable(F.concat("text", F.lit("\nx"))).alias("printable"), T.shorten_label(F.col("text"), 12).alias("label"))


@query("SELECT turn, count(*) AS n, sum((role = 'user')::INT)::BIGINT AS n_user FROM conversations GROUP BY turn")
def role_columns(spark, sf_dir):
    """F9, F10."""
    c = table(spark, sf_dir, "conversations").select(F.col("turn").alias("question_idx"), F.col("role").alias("teacher_response"))
    return select.role_column(c, "teacher").groupBy(F.col("question_idx").alias("turn")).agg(F.count("*").alias("n"), F.count_if(F.col("response") == "user").alias("n_user"))


#: Documents with abbreviations put in front of some, so that there is something to learn. Valid in both engines.
_TOLD = "CASE WHEN doc_id % 5 = 0 THEN concat('Mr. Smith told Dr. Wood, e.g. by letter, what follows. ', text) ELSE text END"


def _told(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TOLD).alias("text"))


def _likely(k, p):
    return f"({k}) * ln(greatest({p}, 1e-300::DOUBLE))"


_SPACE = r"[ \t\n\x0B\f\r]+"
_CORE = r"regexp_replace(regexp_replace({}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.!?]+$', '')"
_FREE, _INNER = "(n - dots)", "(length(word) - length(replace(word, '.', '')))"
_SHARE = "least(stops / tokens, 0.98::DOUBLE)"
_RATIO = f"-2 * ({_likely('dots', _SHARE)} + {_likely(_FREE, f'1 - {_SHARE}')} - {_likely('dots', '0.99::DOUBLE')} - {_likely(_FREE, '0.01::DOUBLE')})"
_SIZE = "length(replace(word, '.', ''))"
_GAIN = " + ".join([_likely("k", "k / ends"), _likely("ends - k", "1 - k / ends"), _likely("n - k", "(n - k) / (tokens - ends)"), _likely("tokens - ends - n + k", "1 - (n - k) / (tokens - ends)")])
_LEARNT = (
    f"d AS (SELECT doc_id, {_TOLD} AS text FROM documents), "
    f"c AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda t: t <> ''), lambda t: {_CORE.format('t')}) AS c FROM d), "
    "t AS (SELECT unnest(c) AS core, unnest(list_concat([''], c[:-2])) AS before FROM c WHERE len(c) > 0), "
    r"w AS (SELECT lower(rtrim(core, '.!?')) AS word, core, before, lower(rtrim(before, '.!?')) AS last, regexp_matches(core, '^\p{Lu}') AS upper, regexp_matches(before, '[.!?]$') AS stop FROM t), "
    r"s AS (SELECT word, count(*) AS n, count(*) FILTER (core LIKE '%.') AS dots, count(*) FILTER (regexp_matches(core, '^\p{Ll}')) AS low, count(*) FILTER (upper AND before <> '' AND NOT stop) AS high FROM w GROUP BY 1 HAVING regexp_matches(word, '\p{L}')), "
    rf"a AS (SELECT *, regexp_matches(word, '^\p{{L}}[\p{{L}}.]*$') AND dots >= 3 AND ({_RATIO}) * exp(-{_SIZE}) * ({_INNER} + 1) * pow({_SIZE}::DOUBLE, -{_FREE}) >= 0.3 AS abbreviation FROM s, (SELECT sum(n)::DOUBLE AS tokens, sum(dots)::DOUBLE AS stops FROM s)), "
    r"f AS (SELECT w.word, coalesce(sum((NOT coalesce(before LIKE '%.' AND (regexp_matches(last, '^\p{L}$') OR x.abbreviation), FALSE))::INT), 0) AS k, coalesce(sum((before LIKE '%.' AND x.abbreviation AND upper)::INT), 0) AS named FROM w LEFT JOIN a x ON x.word = w.last WHERE stop GROUP BY 1), "
    f"m AS (SELECT word, abbreviation, 2 * ({_GAIN} - ({_likely('n', 'n / tokens')}) - ({_likely('tokens - n', '1 - n / tokens')})) >= 30 AND k / ends > n / tokens AS starter, low > 0 AND high = 0 AND named = 0 AS capital FROM "
    "(SELECT a.*, coalesce(k, 0)::DOUBLE AS k, coalesce(named, 0) AS named, ends FROM a LEFT JOIN f USING (word), (SELECT sum(k)::DOUBLE AS ends FROM f)))"
)
_PIECES = rf"string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '([.!?][''\")\]”’»]?){_SPACE}', '\1' || chr(1), 'g'), chr(1))"


@query(f"WITH {_LEARNT} SELECT word, abbreviation, starter, capital FROM m WHERE abbreviation OR starter OR capital")
def learnt_words(spark, sf_dir):
    """Abbreviations, sentence starters and words whose capital tells, learnt from all documents."""
    return S.learn(_told(spark, sf_dir))


@query(f"WITH {_LEARNT}, p AS (SELECT doc_id, {_PIECES} AS p FROM d), "
       "q AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece, unnest(list_concat(p[2:], [''])) AS next FROM p), "
       f"r AS (SELECT doc_id, i, piece, {_CORE.format(f"regexp_split_to_array(piece, '{_SPACE}')[-1]")} AS last, {_CORE.format(f"regexp_split_to_array(next, '{_SPACE}')[1]")} AS nxt FROM q), "
       r"h AS (SELECT doc_id, i, piece, last LIKE '%.' AND (regexp_matches(rtrim(last, '.!?'), '^\p{L}$') OR coalesce(x.abbreviation, FALSE)) AS held, "
       r"regexp_matches(nxt, '^\p{Lu}') AND (coalesce(y.starter, FALSE) OR coalesce(y.capital, FALSE) AND NOT regexp_matches(rtrim(last, '.!?'), '^\p{L}$')) AS begins "
       "FROM r LEFT JOIN m x ON x.word = lower(rtrim(last, '.!?')) LEFT JOIN m y ON y.word = lower(rtrim(nxt, '.!?'))), "
       "j AS (SELECT doc_id, string_split(string_agg(piece || CASE WHEN NOT held OR begins THEN chr(1) ELSE ' ' END, '' ORDER BY i), chr(1)) AS s FROM h GROUP BY 1) "
       r"SELECT doc_id, len(list_filter(s, lambda x: len(regexp_extract_all(x, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) >= 2))::INT AS n_sentences FROM j")  # fmt: skip
def learnt_sentences(spark, sf_dir):
    """Sentences of all documents by what was learnt from them."""
    docs = _told(spark, sf_dir)
    return S.split(docs, S.learn(docs), "doc_id").select("doc_id", F.size("sentences").alias("n_sentences"))
