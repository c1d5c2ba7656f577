"""The operators bound to the shared tables, one query each, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcord.functions.durable import materialise, new_path

from . import (
    bpe,
    chat,
    cotraining,
    decontaminate,
    fixity,
    forest,
    language,
    lexical,
    pseudonyms,
    sharding,
    simhash,
    token_files,
    vector_codes,
)
from .frames import table

#: Key of the registered query; a real run passes its own, kept secret.
DEMO_KEY = b"tabcord demonstration key"

#: Replica damage of the fixity query, by the first two digits of the MD5 of the page id.
ALTERED = ("00", "01", "02", "03")
SHORTENED = ("04", "05", "06", "07")
LOST = ("08", "09", "0a", "0b")


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark, sf_dir):
    """Documents that hold passages of the benchmark, and which."""
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "n_items", "item_ids", "first_word", "end_word")


def op2_token_files(spark, sf_dir):
    """Token ids written as Parquet list columns, and digests of what is read back."""
    target = new_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), target, vocabulary("word_bpe_49k.json")
    )
    return token_files.digests(spark, target)


def op3_bpe(spark, sf_dir):
    """Byte-level BPE ids of every document, and their decoded text."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_cotraining(spark, sf_dir):
    """Quality of every document from two co-trained views."""
    found = cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("accepted", "kept")


def op5_fixity(spark, sf_dir):
    """State of every WARC record in a replica with known damage."""
    records = fixity.archive(table(spark, sf_dir, "pages"))
    index = materialise(fixity.manifest(records), "manifest")
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("null"))), 1, 2)
    record = F.col("record")
    damaged = (
        F.when(mark.isin(*ALTERED), F.concat(F.lit("w"), F.substr(record, F.lit(2))))
        .when(mark.isin(*SHORTENED), F.substr(record, F.lit(1), F.length(record) - 8))
        .otherwise(record)
    )
    replica = materialise(
        fixity.laid_out(records)
        .where(~mark.isin(*LOST))
        .select("page_id", "file", "seq", "offset", damaged.alias("record")),
        "replica",
    )
    return fixity.audit(index, fixity.stored_manifest(replica))


def op6_shards(spark, sf_dir):
    """Shard of every document in a tree of 24 shards, and with one more."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign(docs, sharding.layout(24), sharding.layout(25))


def op7_pseudonyms(spark, sf_dir):
    """Every document with pseudonyms for the personal data in its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, DEMO_KEY).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("new_text").alias("text"),
        F.size("spans").cast("long").alias("n_replaced"),
        F.col("spans.kind").alias("kinds"),
    )


def op8_simhash(spark, sf_dir):
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_rules(spark, sf_dir):
    """Rule statistics of every document and the isolation forest's verdict."""
    return forest.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_search(spark, sf_dir):
    """The twenty best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: What both turns of the added conversation say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op12_chat(spark, sf_dir):
    """Every conversation, and one that speaks in control strings, formatted and read back."""
    planted = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(given.unionByName(planted)))


def op13_vector_codes(spark, sf_dir):
    """Product code of every usable vector, with errors and the digest of the codebooks."""
    return vector_codes.with_label_errors(
        vector_codes.encode(table(spark, sf_dir, "embeddings"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_token_files,
        op3_bpe,
        op4_cotraining,
        op5_fixity,
        op6_shards,
        op7_pseudonyms,
        op8_simhash,
        op9_language,
        op10_rules,
        op11_search,
        op12_chat,
        op13_vector_codes,
    )
}


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _codes_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks and codes of 64 components, round after round."""
    distance = " + ".join(f"(x[{i}] - e[{i}]) * (x[{i}] - e[{i}])" for i in range(1, width + 1))
    mean = ", ".join(
        f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*) + count(*)) % count(*))) // count(*)"
        for i in range(1, width + 1)
    )
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT k, part, any_value(x) AS x, min(({distance}) * {entries} + entry) AS best
  FROM p JOIN b{r} USING (part) GROUP BY k, part
)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM b{r} b LEFT JOIN (
    SELECT part, CAST(best % {entries} AS BIGINT) AS entry,
           CAST([{mean}] AS BIGINT[]) AS e
    FROM a{r} GROUP BY part, best % {entries}) n ON n.part = b.part AND n.entry = b.entry
)""")
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding,
        lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT k, vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS x
  FROM q, (SELECT unnest(range({parts})) AS part)
), b0 AS MATERIALIZED (
  SELECT part, entry, x AS e FROM (
    SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p)
  WHERE entry < {entries}
), {", ".join(steps)}, c AS (
  SELECT k, string_agg(format('{{:02x}}', CAST(best % {entries} AS INTEGER)), ''
                       ORDER BY part) AS code,
         CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY k
), s AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS digest
  FROM b{rounds}
)
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       digest AS codebooks_sha256
FROM c JOIN q USING (k), s
"""


#: A maximal run of letters and digits, or of any characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    f"'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term"
)

ORACLE = {
    "op11_search": f"""
WITH t AS MATERIALIZED (
  SELECT k, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS k, * FROM documents)
), d AS (
  SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY k
), c AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), v AS (
  SELECT k, term, count(*) AS tf FROM t GROUP BY k, term
), i AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, {_TERMS} FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, text, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM v, c GROUP BY term
), s AS (
  SELECT item_id, text, doc_id, k,
         CAST(sum(times * w * ((1000000000 * tf)
              // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN v USING (term) JOIN d USING (k), c
  GROUP BY item_id, text, doc_id, k
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank
  FROM s WHERE score > 0)
WHERE rank <= 20
""",
    "op13_vector_codes": _codes_sql(),
    "op5_fixity": f"""
WITH n AS (
  SELECT greatest(1, (count(*) + 2047) // 2048) AS files FROM pages
), r AS (
  SELECT page_id,
         substr(md5(coalesce(CAST(page_id AS VARCHAR), 'null')), 1, 2) AS mark,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), 'null') || ' '
              || coalesce(url, '') || ' ' || md5(coalesce(html, ''))), 1, 8) AS BIGINT) % files AS INTEGER) AS warc_file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
           || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') || '>'
           || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
           || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10)
           || chr(13) || chr(10) AS record
  FROM pages, n
), d AS (
  SELECT page_id, mark, warc_file, CAST(strlen(record) AS BIGINT) AS length,
         sha256(record) AS digest
  FROM r
)
SELECT page_id, warc_file,
       CAST(coalesce(sum(length) OVER (PARTITION BY warc_file ORDER BY page_id, digest
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset,
       length, digest,
       CASE WHEN mark IN {_in(ALTERED + SHORTENED)} THEN 'corrupt'
            WHEN mark IN {_in(LOST)} THEN 'missing' ELSE 'ok' END AS status
FROM d
""",
    "op12_chat": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), e AS (
  SELECT *, regexp_replace(txt, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS esc,
         replace(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), chr(10), '{chat.LINE}')
           AS esc_role,
         role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, role, txt) AS opens
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), ''
              ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT)
         AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY turn NULLS FIRST, role, txt)
              FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + CASE WHEN opens
              THEN {len(chat.START) + 1 + len(chat.END)} + length(esc_role)
              ELSE {len(chat.AND)} END) AS BIGINT) AS formatted_chars,
       count(*) FILTER (WHERE opens) AS n_blocks
FROM e GROUP BY conv_id
""",
}
