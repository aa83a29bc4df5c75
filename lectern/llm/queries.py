"""The registered queries of the corpus operators: thin contracts over the operators' general interfaces."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, idcodec, langid, minhash, packing, spelling, suffix_dedup, tokencount, toxicity, veccode
from .common import shared_folder, table


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(~held_out()))
    found = langid.predict(docs, dictionaries, narrow=langid.NARROW)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def document_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): three edits of every document, placed by its id: an insertion, a deletion, and a replacement by the
    source's name."""
    size = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1)
    edit = lambda k, n, added: F.struct(at(k).cast("long").alias("start"), (at(k) + n).cast("long").alias("end"), added.alias("added"))
    edits = F.array(edit(1, 0, F.lit("see also: ")), edit(2, 12, F.lit("")), edit(3, 4, F.coalesce("source", F.lit("?"))))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_edits(table(spark, sf_dir, "documents"))
    return tokencount.counts_under_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))


TOOLS = {
    "search": {"query": {"type": "string", "required": True}, "limit": {"type": "integer", "required": True}, "after": {"type": "string"}},
    "open": {"query": {"type": "string", "required": True}, "limit": {"type": "integer", "required": True}},
}


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every assistant turn calls a tool with its text; it refers to the call two turns before, and the next turn answers."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda t: F.concat(F.lit("c"), t.cast("string"))
    ref = F.when(F.col("turn") >= 2, F.struct(call_id(F.col("turn") - 2).alias("$ref")))
    limit = F.when(F.length("text") % 5 == 0, F.lit("many")).otherwise((F.length("text") % 7).cast("string"))
    arguments = F.concat(
        F.lit('{"query": '), F.to_json(F.struct(F.col("text").alias("q"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("q")))) - 6),
        F.lit(', "limit": '), F.when(limit == "many", F.lit('"many"')).otherwise(limit),
        F.coalesce(F.concat(F.lit(', "after": '), F.to_json(ref)), F.lit("")), F.lit("}"))
    name = F.when(F.col("turn") % 4 == 3, F.lit("open")).otherwise(F.lit("search"))
    calls = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    results = turns.where("role <> 'assistant' and turn > 0").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(spark, sf_dir)
    return chat.link_calls(calls, results, TOOLS)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/lectern-ids-{uuid.uuid4().hex}"
    idcodec.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return idcodec.read_ids(spark, path)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("_row")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = veccode.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(veccode.fingerprint(codebooks)).alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def vector_codes_sql(width: int = 64, parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> str:
    """The twin of op12, a step after the other; every vector has ``width`` components, which ``parts`` divides."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x
            FROM v, range({parts}) r(part))""",
             f"""f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})""",
             "c0 AS MATERIALIZED (SELECT part, entry, x AS y FROM p JOIN f USING (vec_id))"]
    near = """a{i} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry, any_value(x) AS x FROM (
            SELECT p.vec_id, p.part, entry, x, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM p JOIN c{i} c ON p.part = c.part) GROUP BY vec_id, part)"""
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"""m{i} AS (SELECT part, entry, list(y ORDER BY pos) AS y FROM (SELECT part, entry, pos, {floor} AS y FROM (
            SELECT part, entry, pos, sum(x[pos]) AS s, count(*) AS n FROM a{i}, range(1, {width // parts} + 1) q(pos) GROUP BY ALL)) GROUP BY part, entry)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN m{i} m USING (part, entry))")
    steps.append(near.format(i=rounds))
    steps.append(f"""k AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(entry AS INT))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id)""")
    steps.append("e AS (SELECT v.vec_id, label, code, error FROM v JOIN k USING (vec_id))")
    return "WITH " + ",\n        ".join(steps) + f"""
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e"""


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_suffix_dedup, op4_chat_format, op5_byte_bpe, op6_minhash, op7_nearest, op8_best_fit_packing, op9_token_ids,
    op10_exact_dedup, op11_spelling_variants, op12_vector_codes, op13_toxicity)}

ORACLE = {
    "op12_vector_codes": vector_codes_sql(),
    "op4_chat_format": """
        WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        c AS (SELECT conv_id, turn, 'c' || turn AS call_id, text, length(text) % 5 = 0 AS bad, turn % 4 = 3 AS opens FROM t WHERE role = 'assistant'),
        r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM t WHERE role <> 'assistant' AND turn > 0),
        v AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
              UNION ALL SELECT c.conv_id, c.turn, v.level + 1 FROM v JOIN c ON c.conv_id = v.conv_id AND c.turn = v.turn + 2),
        l AS (SELECT c.*, level FROM c JOIN v USING (conv_id, turn))
        SELECT l.conv_id, l.call_id, CAST(row_number() OVER (PARTITION BY l.conv_id ORDER BY level, turn, l.call_id) - 1 AS BIGINT) AS position,
            CAST(level AS BIGINT) AS level, false AS cyclic, content IS NOT NULL AS linked,
            NOT (bad OR (opens AND turn >= 2)) AS valid,
            CASE WHEN opens AND turn >= 2 THEN 'unexpected after' WHEN bad THEN 'limit is no integer' END AS error,
            '{"call":{"arguments":{' || CASE WHEN turn >= 2 THEN '"after":{"$ref":"c' || (turn - 2) || '"},' ELSE '' END ||
            '"limit":' || CASE WHEN bad THEN '"many"' ELSE CAST(length(text) % 7 AS VARCHAR) END || ',"query":' || to_json(text) ||
            '},"id":"' || l.call_id || '","name":"' || CASE WHEN opens THEN 'open' ELSE 'search' END || '"}' ||
            CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}' AS message
        FROM l LEFT JOIN r ON l.conv_id = r.conv_id AND l.call_id = r.call_id""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}
