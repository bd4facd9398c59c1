"""Queries of this subpackage for the driver: name -> (session, folder) -> rows, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import alignment, crossentropy, decontaminate, flac, grammar, mixing, pieces, quality, rlz, simhash, suffixes, toxicity, vectors

#: Vocabulary files are read on the driver and broadcast; they are never copied into the repository.
TOKENIZERS = os.environ.get("DUBITO_TOKENIZERS", "/opt/tokenizers")
BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return str(public_tokenizers.path(name))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(column):
    """start:n of each span, with blanks between."""
    return F.array_join(F.transform(column, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["n"].cast("string"))), " ")


def op1_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_crossentropy(spark, sf_dir):
    """The target are the documents that labels mark as good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    scored = crossentropy.score_documents(table(spark, sf_dir, "documents"), good)
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op3_suffixes(spark, sf_dir):
    return suffixes.find_passages(table(spark, sf_dir, "documents")).withColumn("spans", _spans("spans"))


def op4_rlz(spark, sf_dir):
    return rlz.digest_substrings(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark, sf_dir):
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("items", lambda i: i.cast("string")), " ")
    return found.withColumns({"items": items, "spans": _spans("spans")})


def op6_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_pieces(spark, sf_dir):
    return pieces.encode_digests(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op8_grammar(spark, sf_dir):
    return grammar.round_trip(table(spark, sf_dir, "documents"), vocabulary(WORDS))


def op9_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_flac(spark, sf_dir):
    return flac.round_trip(table(spark, sf_dir, "documents"))


def op11_vectors(spark, sf_dir):
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(BYTES), vocabulary(PIECES))


def queries():
    own = (op1_toxicity, op2_crossentropy, op3_suffixes, op4_rlz, op5_spaced_seeds, op6_simhash, op7_pieces, op8_grammar, op9_quality, op10_flac, op11_vectors, op12_mixing, op13_alignment)
    return {f.__name__: f for f in own}


_WINDOWS = """d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {n}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n} + 1)) AS i FROM d)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
j AS (SELECT doc_id, j, max((r > 1)::INT) AS later FROM (SELECT doc_id, unnest(range(i, i + {n})) AS j, r FROM g WHERE c > 1) GROUP BY ALL)"""

_LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, n, i, w[i + 1:i + 12] AS t FROM (SELECT doc_id, len(w) AS n, w, unnest(range(0, len(w) - 11)) AS i FROM d)),
bw AS (SELECT DISTINCT item_id, w[i + 1:i + 12] AS u FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS i FROM b)),
p AS (SELECT unnest([1, 4, 7, 10]) AS p),
x AS (SELECT *, array_to_string(t[p:p + 2], ' ') AS g FROM dw, p),
y AS (SELECT *, array_to_string(u[p:p + 2], ' ') AS g FROM bw, p),
m AS (SELECT DISTINCT doc_id, n, i, item_id FROM x JOIN y USING (p, g) WHERE list_sum([(t[k] = u[k])::INT FOR k IN range(1, 13)]) >= {decontaminate.SPAN - decontaminate.MISSES}),
j AS (SELECT DISTINCT doc_id, unnest(range(i, i + 12)) AS j FROM m),
s AS (SELECT doc_id, min(j) AS start, count(*) AS n FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM j) GROUP BY doc_id, island),
l AS (SELECT doc_id, sum(n)::BIGINT AS n_leaked, string_agg(concat(start, ':', n), ' ' ORDER BY start) AS spans FROM s GROUP BY doc_id),
o AS (SELECT doc_id, max(n) AS n_tokens, array_to_string(list_sort(list(DISTINCT item_id)), ' ') AS items FROM m GROUP BY doc_id)
SELECT doc_id, items, n_tokens, n_leaked, spans FROM o JOIN l USING (doc_id)"""

_D, _S = crossentropy.DISCOUNT, crossentropy.SMOOTH
_LOSS = f"-ln(greatest(c{{0}} - {_D} * least(c{{0}}, 1), 0) / greatest(n{{0}}, 1e-12) + CASE WHEN n{{0}} > 0 THEN greatest(off{{0}} / n{{0}}, 1e-9) ELSE 1.0 END * (w{{0}} + {_S}) / (nt + {_S} * v))"
_CROSSENTROPY = f"""WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
d AS (SELECT doc_id, good.doc_id IS NOT NULL AS t, coalesce(regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM documents LEFT JOIN good USING (doc_id)),
x AS (SELECT doc_id, t, unnest(list_concat([''], w[1:len(w) - 1])) AS a, unnest(w) AS b FROM d WHERE len(w) > 0),
p AS (SELECT a, b, sum(t::INT)::DOUBLE AS cb, count(*)::DOUBLE AS c FROM x GROUP BY ALL),
k AS (SELECT sum(cb) AS nt, sum(cb) / greatest(sum(c), 1) AS k FROM p),
q AS (SELECT a, b, cb AS ct, c * k AS cg, nt FROM p, k),
ctx AS (SELECT a, sum(ct) AS n_t, sum(cg) AS n_g, sum({_D} * least(ct, 1)) AS off_t, sum({_D} * least(cg, 1)) AS off_g FROM q GROUP BY a),
wd AS (SELECT b, sum(ct) AS w_t, sum(cg) AS w_g, count(*) OVER () AS v FROM q GROUP BY b),
l AS (SELECT a, b, {_LOSS.format('_t').replace('c_t', 'ct')} AS lt, {_LOSS.format('_g').replace('c_g', 'cg')} AS lg FROM q JOIN ctx USING (a) JOIN wd USING (b)),
s AS (SELECT doc_id, avg(lt) AS lt, avg(lg) AS lg FROM x JOIN l USING (a, b) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_tokens, round(lt, 6) AS target_loss, round(lg, 6) AS background_loss, round(lt - lg, 6) AS score FROM d LEFT JOIN s USING (doc_id)"""



def _vector_rounds(rounds: int = vectors.ROUNDS, parts: int = vectors.PARTS, width: int = 8) -> str:
    """Rounds of the codebooks, unrolled, over vectors of parts times width components."""
    far = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    down = ", ".join(f"((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, width + 1))
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor({vectors.SCALE} * y::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1:p * {width} + {width}] AS x FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {vectors.ENTRIES}) USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': {far}, 'e': e}}) AS m FROM p JOIN c{r} USING (p) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n, c) AS c FROM c{r} LEFT JOIN (SELECT p, m.e AS e, [{down}] AS n FROM a{r} GROUP BY ALL) USING (p, e))")
    return ",\n".join(steps) + f""",
r AS (SELECT vec_id, label, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


def _mixing() -> str:
    """Targets by the level of a filled vessel, then the order of rank, filled range by range."""
    weights, share, most = mixing.WEIGHTS, mixing.SHARE, mixing.MOST
    steps = f"""i AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size, (('0x' || substr(md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}.0::DOUBLE AS u FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, count(DISTINCT {{'i': doc_id, 's': size, 'u': u}}) AS n FROM i GROUP BY 1),
w AS (SELECT *, [{', '.join(f'{x}.0::DOUBLE' for x in weights)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS w, {most} * source_size::DOUBLE AS cap, sum(source_size) OVER () * {share}::DOUBLE AS total FROM b),
l AS (SELECT *, sum(cap) OVER o AS filled, sum(w) OVER () - sum(w) OVER o AS later FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT arg_min((total - filled + cap) / (later + w), {{'c': cap / w, 'f': filled}}) AS level FROM l WHERE filled + cap / w * later >= total),
t AS (SELECT source, source_size, n, least(cap, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM w, v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least({most}, floor(target / source_size)) ELSE 0 END::BIGINT AS whole, ceil(n / {mixing.EACH}.0) AS parts FROM t),
x AS (SELECT *, CASE WHEN whole < {most} THEN greatest(0.0::DOUBLE, target - whole * source_size) ELSE 0.0::DOUBLE END AS open FROM g),
r AS (SELECT doc_id, i.source, size, source_size, target, whole, open, floor((u / (1 - u)) / (1 + u / (1 - u)) * parts)::BIGINT AS part, u / (1 - u) / CASE WHEN open > 0 THEN (open / source_size) / (1 - open / source_size) ELSE 1.0::DOUBLE END AS rank FROM i JOIN x ON i.source IS NOT DISTINCT FROM x.source),
s AS (SELECT source, part, open, sum(sum(size)) OVER (PARTITION BY source ORDER BY part) AS upto, sum(size) AS words FROM r GROUP BY source, part, open),
e AS (SELECT source, part AS border, open - upto + words AS gap FROM s WHERE open >= upto - words AND open < upto),
p0 AS MATERIALIZED (SELECT r.*, coalesce(border, -1) AS border, gap, 0::BIGINT AS k FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source)"""
    last = "p0"
    for i in range(1, mixing.PASSES + 1):
        steps += f""",
f{i} AS (SELECT *, CASE WHEN part = border AND size > 0 AND size <= gap THEN 1 - k ELSE 0 END AS free FROM {last}),
h{i} AS (SELECT *, coalesce(sum(free * size) OVER (PARTITION BY source, part ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM f{i}),
m{i} AS (SELECT *, CASE WHEN free > 0 AND gap - ahead >= size THEN 1 ELSE 0 END AS more FROM h{i}),
p{i} AS MATERIALIZED (SELECT doc_id, source, size, source_size, target, whole, part, rank, border, gap - sum(more * size) OVER (PARTITION BY source, part) AS gap, k + more AS k FROM m{i})"""
        last = f"p{i}"
    return steps + f""",
z AS (SELECT *, k < 1 AND size > 0 AND part = border AS o, row_number() OVER (PARTITION BY source, part ORDER BY CASE WHEN k < 1 AND size > 0 THEN size END NULLS LAST, rank, doc_id) AS rn FROM {last}),
q AS (SELECT *, whole + CASE WHEN part < border THEN 1 WHEN part = border THEN k + (o AND rn = 1 AND size - gap < gap)::INT ELSE 0 END AS copies FROM z)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM q"""


_SQL = {
    "op12_mixing": "WITH " + _mixing(),
    "op11_vectors": "WITH " + _vector_rounds(),
    "op2_crossentropy": _CROSSENTROPY,
    "op5_spaced_seeds": _LEAKS,
    "op3_suffixes": "WITH "
    + _WINDOWS.format(n=suffixes.WINDOW)
    + """, x AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM j),
s AS (SELECT doc_id, island, min(j) AS start, count(*) AS n, sum(later) AS later FROM x GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_spans, sum(n)::BIGINT AS n_repeated, sum(later)::BIGINT AS n_later, string_agg(concat(start, ':', n), ' ' ORDER BY start) AS spans FROM s GROUP BY doc_id""",
    "op4_rlz": "WITH "
    + _WINDOWS.format(n=rlz.WINDOW)
    + """, gone AS (SELECT doc_id, list(j) AS js FROM j GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(js, p - 1)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
}


def oracle_sql():
    """SQL for the queries that it can express; the tests hold the others to brute force or a library."""
    return dict(_SQL)
