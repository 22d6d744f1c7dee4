"""The registered queries, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import codes, decontamination, fm_index, jaccard, knn, langid, mixing, packing, periodic, pitman_yor, preference, suffix_array, toxicity
from tickloom.llm.common import GAP, held
from tickloom.llm.registry import query, table

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
m AS (SELECT *, CASE WHEN size > 0 THEN floor(sqrt(size::DOUBLE))::BIGINT ELSE 0 END AS measure FROM d),
g AS (SELECT source, measure, sum(size)::BIGINT AS words FROM m GROUP BY ALL),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM g GROUP BY 1),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s0),
s2 AS (SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS before,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft, sum(source_size) OVER () AS total
  FROM s1 WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
s3 AS (SELECT *, (total - before) * weight < 3 * source_size * lft AS opened, total - before AS rest FROM s2),
s4 AS (SELECT *, max(CASE WHEN opened THEN rest END) OVER () AS r, max(CASE WHEN opened THEN lft END) OVER () AS ws FROM s3),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce((weight * r)::DOUBLE / ws::DOUBLE, (source_size * 3)::DOUBLE)) AS target FROM s4),
c0 AS (SELECT g.source, g.measure, g.words, t.target, t.source_size,
  coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
  sum(measure * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS mass
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY g.source ORDER BY measure DESC)),
c1 AS (SELECT *, CASE WHEN mass > 0 AND (target - 3 * above) / mass * measure < 3 THEN measure END AS ok, (target - 3 * above) / mass AS rate FROM c0),
c2 AS (SELECT *, max(ok) OVER (PARTITION BY source) AS top FROM c1),
c3 AS (SELECT *, max(CASE WHEN measure = top THEN rate END) OVER (PARTITION BY source) AS r FROM c2),
c4 AS (SELECT *, least(3.0::DOUBLE, coalesce(r * measure, 3.0::DOUBLE)) AS e FROM c3),
c AS (SELECT source, measure, words, target, source_size, floor(e)::BIGINT AS whole, e - floor(e) AS odds FROM c4),
miss AS (SELECT source, max(target) - sum(whole * words)::BIGINT AS missing FROM c GROUP BY 1),
u AS (SELECT m.*, c.target, c.source_size, c.whole, c.odds, (('0x' || substr(md5('7:' || coalesce(m.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM m JOIN c ON m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure),
q AS (SELECT *, CASE WHEN odds > 0 THEN (u * (1 - odds)) / ((1 - u) * odds) END AS rnk FROM u),
p AS (SELECT q.*, miss.missing, sum(CASE WHEN odds > 0 THEN size ELSE 0 END) OVER (PARTITION BY q.source ORDER BY rnk NULLS LAST) AS upto,
  sum(CASE WHEN odds > 0 THEN size ELSE 0 END) OVER (PARTITION BY q.source, rnk) AS peers FROM q JOIN miss ON q.source IS NOT DISTINCT FROM miss.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN odds > 0 AND 2 * upto - peers <= missing * 2 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _spans(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(name)


PREFERENCE_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT conv_id, turn, max(text) AS text FROM r WHERE role = 'assistant' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM a),
l AS (SELECT x.conv_id AS pair_id, x.turn, x.text AS good, y.text AS bad FROM n x JOIN n y ON x.conv_id = y.conv_id AND x.k = 1 AND y.k = 2),
s AS (SELECT pair_id, count(*)::INTEGER AS n_before, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(r.text, '') || '<|end|>' || chr(10), '' ORDER BY r.turn, role, r.text) AS prompt
  FROM l JOIN r ON r.conv_id = l.pair_id AND r.turn < l.turn GROUP BY 1)
SELECT l.pair_id, (n_before + CASE WHEN good IS NOT DISTINCT FROM bad THEN 1 ELSE 0 END)::INTEGER AS n_shared,
  prompt || CASE WHEN good IS NOT DISTINCT FROM bad THEN '<|assistant|>' || chr(10) || coalesce(good, '') || '<|end|>' || chr(10) ELSE '' END AS prompt,
  CASE WHEN good IS NOT DISTINCT FROM bad THEN '' ELSE '<|assistant|>' || chr(10) || coalesce(good, '') || '<|end|>' || chr(10) END AS chosen,
  CASE WHEN good IS NOT DISTINCT FROM bad THEN '' ELSE '<|assistant|>' || chr(10) || coalesce(bad, '') || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN good IS NOT DISTINCT FROM bad THEN '' ELSE '14-' || (14 + length(coalesce(good, '')) + 7) END AS chosen_spans,
  CASE WHEN good IS NOT DISTINCT FROM bad THEN '' ELSE '14-' || (14 + length(coalesce(bad, '')) + 7) END AS rejected_spans
FROM l JOIN s USING (pair_id)
"""


@query("op4_preference", PREFERENCE_SQL)
def op4_preference(spark, sf_dir):
    pairs = preference.pairs_from_answers(table(spark, sf_dir, "conversations"))
    return preference.format_pairs(pairs).select("pair_id", "n_shared", "prompt", "chosen", "rejected", _spans("chosen_spans"), _spans("rejected_spans"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(t) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    out = suffix_array.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    out = fm_index.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


KNN_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


@query("op5_voronoi_knn", KNN_SQL)
def op5_voronoi_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(3) != 1))
    return langid.identify(docs, model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def grades(labels):
    """Severity from the two labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", (F.col("toxic") + F.when(F.col("quality") == 0, F.col("toxic")).otherwise(0)).alias("grade"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, grades(table(spark, sf_dir, "labels"))))


DECONTAMINATION_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i0 AS (SELECT item_id, len(w) AS n, unnest(range(0, (len(w) - 4)::BIGINT)) AS q, w FROM iw WHERE len(w) >= 5),
i AS MATERIALIZED (SELECT item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') AS s FROM i0),
d0 AS (SELECT doc_id, len(w) AS m, unnest(range(0, (len(w) - 4)::BIGINT)) AS p, w FROM dw WHERE len(w) >= 5),
d AS MATERIALIZED (SELECT doc_id, m, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM d0),
h AS MATERIALIZED (SELECT DISTINCT d.doc_id, i.item_id, greatest(0, least(d.p - i.q, d.m - i.n)) AS start, i.n FROM d JOIN i ON d.s = i.s),
l AS (SELECT h.*, d.s, count(*) AS c FROM h JOIN d ON d.doc_id = h.doc_id AND d.p >= h.start AND d.p <= h.start + h.n - 5 GROUP BY ALL),
r AS (SELECT item_id, s, count(*) AS c FROM i GROUP BY ALL),
b AS (SELECT l.doc_id, l.item_id, l.start, l.n, sum(CASE WHEN r.c IS NULL THEN 0 ELSE least(l.c, r.c) END) AS shared, sum(l.c) AS here FROM l LEFT JOIN r ON r.item_id = l.item_id AND r.s = l.s GROUP BY ALL),
x AS (SELECT b.*, b.here + t.there - b.shared AS every FROM b JOIN (SELECT item_id, sum(c) AS there FROM r GROUP BY 1) t USING (item_id)),
y AS (SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, shared::DOUBLE / every::DOUBLE AS similarity FROM x WHERE shared * 100 >= every * 80)
SELECT doc_id, item_id, start, n_words, similarity FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@query("op2_decontamination", DECONTAMINATION_SQL)
def op2_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_pitman_yor")
def op6_pitman_yor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.score_texts(docs.select("doc_id", "text", (_fold(7) == 2).alias("held_out")))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds one after another; ``b0`` are the first codebooks, ``b6`` the last."""
    steps = [f"""WITH v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v1 AS (SELECT vec_id, label, v, len(v) // {parts} AS d, unnest(range(len(v))) AS i FROM v0),
v AS MATERIALIZED (SELECT vec_id, i // d AS p, i % d AS j, v[i + 1] AS x FROM v1),
b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v0 ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, e, dist FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS dist FROM v JOIN b{r} USING (p, j) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id, p) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c FROM b{r} b LEFT JOIN m{r} USING (p, e, j))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY 1) JOIN (SELECT vec_id, label FROM v0) USING (vec_id)
"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    coded = held(codes.encode(vectors, books, keep=("label",)))
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


@query("op12_packing")
def op12_packing(spark, sf_dir):
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


PERIODIC_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM t)),
j AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM j),
l AS (SELECT doc_id, q, min(i) AS lo, max(i) + 16 + q AS hi FROM k GROUP BY doc_id, q, k.k HAVING max(i) + 16 + q - min(i) >= greatest(24, 3 * q)),
r AS MATERIALIZED (SELECT doc_id, lo, hi - lo AS len, min(q) AS q FROM l GROUP BY ALL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, lo, q) = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(lo || ',' || len || ',' || q || chr(10), '' ORDER BY lo, q) AS runs FROM r GROUP BY 1),
u AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM t)),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo + q, lo + len)) AS i FROM r),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, lo AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def made_periodic(docs):
    """``docs`` with a periodic end in each text whose crc32(doc_id) ends in 0, as the contract of op13 has it; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split(F.coalesce("text", F.lit("")), GAP), lambda x: x != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("w"))
    d = d.withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")).withColumn("a", F.col("a").cast("int")).withColumn("rest", F.expr("cast(n as int) - a"))
    whole = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast(rest div p as int)")))
    new = F.concat(F.slice("w", F.lit(1), F.col("a")), whole, F.slice("w", F.col("a") + 1, F.col("rest") % F.col("p")))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", PERIODIC_SQL)
def op13_periodic_runs(spark, sf_dir):
    found = periodic.collapse(made_periodic(table(spark, sf_dir, "documents")))
    longer = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(longer(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("collapsed_sha256"))
