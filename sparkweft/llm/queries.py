"""The registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import ann, balltree, bpe, chat, decontam, fim, htmltext, langid, linededup, mixing, simhash, tokenbin, warc
from sparkweft.llm.common import fresh_path

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to, true AS verified FROM m"""


@query
def op2_main_text(spark, sf_dir):
    return htmltext.extract(_read(spark, sf_dir, "pages"))


@query
def op3_nearest(spark, sf_dir):
    return ann.search(_read(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20)


@query
def op4_chat(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


# An escaped text is longer by one for each backslash, each # before ##, and each < that begins </turn> or <|.
ORACLES["op4_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'role=' || role END AS name, length(t) + length(t) - length(replace(t, '\', ''))
 + len(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, 3) = '###')) + (length(t) - length(replace(t, '</turn>', ''))) // 7 + (length(t) - length(replace(t, '<|', ''))) // 2 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(15 + length(name) + n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


@query
def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query
def op6_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model, ["doc_id", langid.held_out().alias("held_out")])


@query
def op7_bpe(spark, sf_dir):
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_simhash(spark, sf_dir):
    prints = simhash.fingerprints(_read(spark, sf_dir, "documents"), width=3)
    out = simhash.components(prints, blocks=4, most=2)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op9_line_dedup(spark, sf_dir):
    kept = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.last, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


@query
def op10_token_ids(spark, sf_dir):
    path = fresh_path(spark, "token-ids")
    tokenbin.write_shards(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, path)
    return tokenbin.read_documents(spark, path)


@query
def op11_centroids(spark, sf_dir):
    return balltree.cluster(_read(spark, sf_dir, "embeddings"))


def _centroid_sql(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    floor_mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        "p AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM s)",
    ]
    for n in range(rounds + 1):
        parts += [
            f"d{n} AS (SELECT p.vec_id, c{n}.c, sum((p.x - c{n}.x) * (p.x - c{n}.x)) AS d FROM p JOIN c{n} ON p.i = c{n}.i GROUP BY ALL)",
            f"a{n} AS (SELECT vec_id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)",
            f"m{n} AS (SELECT a{n}.c, p.i, {floor_mean} AS x FROM p JOIN a{n} ON p.vec_id = a{n}.vec_id GROUP BY ALL)",
            f"c{n + 1} AS (SELECT c{n}.c, c{n}.i, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c AND c{n}.i = m{n}.i)",
        ]
    return f"""WITH {", ".join(parts)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
 FROM a{rounds} a JOIN h ON a.c = h.c"""


ORACLES["op11_centroids"] = _centroid_sql()


@query
def op12_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark, sf_dir):
    cut = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    whole = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS rate, ('0x' || h[25:32])::BIGINT % 100 AS spm FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR rate >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
