"""The queries of this subpackage and their SQL; each reads whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers package keeps a file; executors have the package as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.quality import with_quality

    rated, name = with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", f"{name}.*")


@query
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tallyframe.llm.prefix_bpe import digests

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.feistel import shard

    return shard(table(spark, sf_dir, "documents"), shards=24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.toxicity import fit, held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "held_out", scored(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.secret_scan import KINDS, listed, train, with_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, base, every = with_spans(docs, train(docs))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col(base)), 256).alias("base_sha256"), listed(F.col(every)).alias("spans")
    )


@query
def op9_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.chat import format_chats, learned_text, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).selectExpr("CAST(-7 AS BIGINT) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    chats = format_chats(rows.unionByName(hostile)).withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", learned_text(F.col("segments")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


_CONTROLS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE]", "[TEXT]", "[/ROLE]")


def _escapes(column: str) -> str:
    """SQL for the characters that escaping adds."""
    marks = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROLS)]
    return " + ".join(marks)


SQL["op9_chat_machine"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), ordered AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    7 + length(text) + {_escapes("text")}
      + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 ELSE 23 + length(role) + {_escapes("role")} END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM ordered GROUP BY conv_id
"""


@query
def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.multi_index import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


@query
def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.cuckoo import dedup

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op11_cuckoo_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.bag_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op12_bag_search"] = f"""
WITH words AS (
  SELECT d, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS d, * FROM documents)
), item_terms AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), lengths AS (
  SELECT d, doc_id, count(*) AS n FROM words GROUP BY ALL
), totals AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM lengths
), counted AS (
  SELECT d, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, documents
), scored AS (
  SELECT item_id, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length)))) AS BIGINT) AS score
  FROM counted JOIN lengths USING (d) JOIN weighted USING (term) JOIN item_terms USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.merkle import audit

    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return audit(docs, tampered).withColumnRenamed("id", "doc_id")


def _merkle_sql(source_levels: int = 6, top_levels: int = 3) -> str:
    """Each level spelled out: enough for 16 ** 6 rows a source and 16 ** 3 sources."""

    def levels(name: str, count: int) -> list[str]:
        out = []
        for j in range(count):
            run = "PARTITION BY g, rank // 16 ORDER BY rank ROWS BETWEEN"
            out.append(f"""{name}_runs{j} AS (SELECT g, rank, n,
    coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j})""")
            out.append(f"""{name}{j + 1} AS (SELECT g, rank // 16 AS rank, any_value(n + 15) // 16 AS n,
    CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY rank)) END AS digest FROM {name}{j} GROUP BY g, rank // 16)""")
        return out

    def climbed(name: str, count: int, start: str, at: str) -> list[str]:
        return [
            f"""{name}_fold{j + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold, f.proof || s.l || s.r AS proof)
  FROM {start if j == 0 else f"{name}_fold{j}"} f JOIN {name}_runs{j} s ON s.g = f.{at}g AND s.rank = f.{at}rank // {16**j})"""
            for j in range(count)
        ]

    import zlib

    steps = [zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)]  # the step of the checksum for each byte
    bytes_of = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295], {bytes_of}), lambda c, b: xor(c // 256, ({steps})[xor(c & 255, b) + 1])), 4294967295)"
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars")))
    parts = [
        f"""leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({head} || {framed("text")}) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {framed(lower)}) ELSE sha256({head} || {framed("text")}) END AS found FROM documents)""",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "a0 AS (SELECT g, rank, n, leaf AS digest FROM ranked)",
        *levels("a", source_levels),
        f"subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS place FROM a{source_levels})",
        "b0 AS (SELECT '' AS g, place AS rank, count(*) OVER () AS n, digest FROM subroots)",
        *levels("b", top_levels),
        "started AS (SELECT r.*, s.place AS toprank, '' AS topg, s.digest AS subroot, r.found AS fold, '' AS proof FROM ranked r JOIN subroots s USING (g))",
        *climbed("a", source_levels, "started", ""),
        *climbed("b", top_levels, f"a_fold{source_levels}", "top"),
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified
FROM b_fold{top_levels} JOIN b{top_levels} t ON true"""


SQL["op13_merkle_manifest"] = _merkle_sql()
