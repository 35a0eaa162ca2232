"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, infill, language_id, mixing, near_dup, quality, repeats, sharding, syncmers, url_filter, vector_codes, warc
from .common import table, utf8, written


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffled(table(spark, sf_dir, "documents"), shards=40)
    return shards.select(
        "doc_id", sharding.size_of("text").alias("size"), F.crc32(utf8("text")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"), of=5, part=0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~out)
    got = docs.select("doc_id", out.alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learn=~language_id.held_out(F.col("doc_id")))
    got = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), language_id.predict(model, F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.resolve(warc.read_warc(spark, warc.archive(pages, min_revisit_bytes=1000), payload=False))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS s FROM p),
l AS (SELECT s, max(page_id) AS leader FROM d GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> leader THEN leader END AS refers_to
FROM d JOIN l ON d.s = l.s
"""

def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return got.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", F.col("_found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_found.items").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0),
ph AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS p FROM bi),
di AS (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM ph)),
occ AS (SELECT k, i, di.l AS l, item_id FROM di JOIN ph ON di.l = ph.l AND array_to_string(list_slice(w, i, i + di.l - 1), ' ') = p),
hits AS (SELECT k, count(DISTINCT x) AS n FROM (SELECT k, unnest(range(i, i + l)) AS x FROM occ) GROUP BY k),
its AS (SELECT k, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT k, item_id FROM occ) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits ON dw.k = hits.k LEFT JOIN its ON dw.k = its.k
"""


#: The tree of the mix: domains by the number in a source's name, then languages, then sources of equal weight.
DOMAINS = ["web", "books", "code", "forum"]
WEIGHTS = {"domain": {"web": 0.5, "books": 0.2, "code": 0.2, "forum": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def domain_of(source: Column) -> Column:
    number = F.try_to_number(F.regexp_extract(source, "[0-9]+", 0), F.lit("999999999")).cast("long")
    return F.coalesce(F.get(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS)).cast("int")), F.lit("other"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(table(spark, sf_dir, "documents"), levels, WEIGHTS, share=0.9, max_epochs=2).drop("key")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(['web', 'books', 'code', 'forum'][TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4 + 1], 'other') AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS held, 2 * sum(tokens)::DOUBLE AS c FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(c) AS c, coalesce(map {'web': 0.5::DOUBLE, 'books': 0.2, 'code': 0.2, 'forum': 0.1}[domain], 1) AS w, floor((SELECT sum(held) FROM leaf) * 0.9::DOUBLE) AS b FROM leaf GROUP BY domain),
f1 AS (SELECT *, coalesce(sum(c) OVER (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c * sum(w) OVER (ORDER BY c / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / w <= b AS f FROM n1),
a1 AS (SELECT domain, CASE WHEN f THEN c ELSE greatest(b - sum(CASE WHEN f THEN c ELSE 0 END) OVER (), 0) * w / sum(CASE WHEN f THEN 0 ELSE w END) OVER () END AS b FROM f1),
n2 AS (SELECT domain, lang, sum(c) AS c, coalesce(map {'en': 0.5::DOUBLE, 'de': 0.2, 'fr': 0.2, 'es': 0.1}[lang], 1) AS w, any_value(b) AS b FROM leaf JOIN a1 USING (domain) GROUP BY domain, lang),
f2 AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c * sum(w) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / w <= b AS f FROM n2),
a2 AS (SELECT domain, lang, CASE WHEN f THEN c ELSE greatest(b - sum(CASE WHEN f THEN c ELSE 0 END) OVER (PARTITION BY domain), 0) * w / sum(CASE WHEN f THEN 0 ELSE w END) OVER (PARTITION BY domain) END AS b FROM f2),
n3 AS (SELECT domain, lang, source, held, c, 1::DOUBLE AS w, b FROM leaf JOIN a2 USING (domain, lang)),
f3 AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c * sum(w) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / w <= b AS f FROM n3),
a3 AS (SELECT domain, lang, source, held, floor(1e-6 + CASE WHEN f THEN c ELSE greatest(b - sum(CASE WHEN f THEN c ELSE 0 END) OVER (PARTITION BY domain, lang), 0) * w / sum(CASE WHEN f THEN 0 ELSE w END) OVER (PARTITION BY domain, lang) END)::BIGINT AS b FROM f3),
p AS (SELECT d.*, CASE WHEN held > 0 THEN b // held::BIGINT ELSE 0 END AS whole, CASE WHEN held > 0 THEN b % held::BIGINT ELSE 0 END AS rest FROM d JOIN a3 USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('13:' || whole || ':' || doc_id), 1, 15))::BIGINT, CAST(doc_id AS VARCHAR), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens, CAST(tokens AS BIGINT) AS taken FROM (SELECT *, unnest(range(0, whole)) AS epoch FROM p)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole AS INTEGER), CAST(tokens AS BIGINT), CAST(least(tokens, rest - before) AS BIGINT) FROM o WHERE before < rest
"""


#: The contract's rules: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
r AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT k, rh || rp AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC) AS nth
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN f ON h.k = f.k AND f.nth = 1
"""


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=5, per_cent=75)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = vector_codes.compressed(vectors, parts=8, entries=16, rounds=6, scale=4096)
    rows = vector_codes.with_sums(coded, "label")
    digest = books.sha256() if books else None
    return rows.select("vec_id", F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"), F.lit(digest).cast("string").alias("codebooks_sha256"))


def _op11_sql(rounds: int = 6) -> str:
    """The rounds one after another: ``c0`` has the first codebooks by part, entry and place, ``c6`` the last ones."""
    steps = ["""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "v AS MATERIALIZED (SELECT vec_id, label, p, list_slice(w, p * (len(w) // 8) + 1, (p + 1) * (len(w) // 8)) AS x FROM k, range(8) t(p))",
        "c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))"]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT vec_id, label, v.p AS p, min_by(e, (s, e)) AS e, min(s) AS s, any_value(x) AS x FROM (SELECT v.vec_id, v.label, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM v JOIN c{i} c ON v.p = c.p) v GROUP BY vec_id, label, v.p)")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS y FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM d{i}) GROUP BY p, e, i),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM m{i} GROUP BY p, e) n ON c.p = n.p AND c.e = n.e)""")
    last = f"d{rounds}"
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM {last} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, b"""


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], given.schema)
    ranks = chat.vocabulary(spark)
    return chat.digests(written(chat.formatted(given.unionByName(more), ranks), "chats"), ranks)


OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|/?ROLE\]|TEXT\])')) AS n, length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?INST\]|/?ROLE\]|TEXT\])')) AS m FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN length('[INST][/INST]') WHEN 'assistant' THEN length('<s></s>') ELSE length('[ROLE][TEXT][/ROLE]') + m END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", rate=100, spm=50, seed=7)
    f = F.col("_fim")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select("doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), digest(f["output"]).alias("output_sha256"), digest(infill.restored(f["output"], f["form"])).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


QUERIES = {"op1_sharding": op1_sharding, "op2_quality": op2_quality, "op3_language_id": op3_language_id, "op4_warc": op4_warc, "op5_repeats": op5_repeats, "op6_decontaminate": op6_decontaminate, "op7_mixing": op7_mixing, "op8_url_filter": op8_url_filter, "op9_syncmers": op9_syncmers, "op10_minhash": op10_minhash, "op11_vector_codes": op11_vector_codes, "op12_chat": op12_chat, "op13_infill": op13_infill}
ORACLE_SQL = {"op4_warc": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_mixing": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_vector_codes": _op11_sql(), "op12_chat": OP12_SQL, "op13_infill": OP13_SQL}
