"""The registered queries of the operators and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import bpe, exact_dedup, fst_tokens, packing, perm_index, reply_trees, runs, secrets, sharding, simhash, spelling, toxicity, warc
from flowlab.llm.common import new_path, table, text_or_empty, written

WORDS = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
SHARDS = 40
THRESHOLD = 0.7


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal payloads the row with the least page_id is the response, rows with a null id last; of rows that repeat that id, one."""
    path = new_path(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    records = warc.read_warc(spark, path)
    whole = F.col("record_type") == "response"
    records = records.withColumn("n_bytes", F.when(whole, F.octet_length("payload").cast("long"))).withColumn("digest", F.when(whole, F.sha2("payload", 256)))
    text = F.when(F.col("record_type") == "metadata", F.col("payload").cast("string"))
    records = records.withColumn("page_id", F.regexp_extract(text, r"page-id: (-?\d+)", 1).try_cast("long")).drop("payload", "header")
    records = written(records, "records")  # each kind of record reads it once; the archives are parsed only here
    captures = written(warc.resolve_revisits(warc.assemble(records)), "captures")
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.n_bytes", "original.response.n_bytes").alias("payload_bytes"),
        F.coalesce("response.digest", "original.response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("original.metadata.page_id").alias("refers_to"),
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), CAPACITY)
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digested, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_span_text(base).cast("binary"), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    placed = sharding.histogram_shards(rows, SHARDS, F.col("text_key"), "doc_id", "bytes")
    return placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fst_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return counted.withColumn("over_limit", F.col("n_tokens") > CAPACITY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode_ids(encoded, ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def in_training() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"), in_training())
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup.exact_dedup(docs, exact_dedup.earlier_half(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perm_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows. With h = crc32(doc_id) and g = h div 10, where 10 divides h the words from a = g % n on repeat the first
    1 + (n - a) div (3 + g % 8) of them (words joined by one space); all other texts, and those with a null id or without words, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("chosen"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a))), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text of ``with_periods``; a null id plants nothing, null and empty texts have no runs."""
    found = runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.expr("reduce(runs, cast(null as struct<start: long, length: long, period: long>), (x, y) -> if(x is null or y.length * x.period > x.length * y.period, y, x))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7. Rows with a null conv_id are one conversation; null turns come first, equal turns by role and text; null roles are empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    quoting = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = reply_trees.chain_messages(rows.unionByName(quoting), "conv_id", "turn", "role", "text")
    formatted = written(reply_trees.format_trees(messages), "conversations")
    back = reply_trees.read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words; in rows with a null id no word loses a letter."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slip=spelling.hashed_slip))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlab.llm.pipeline import run  # which uses this module's parameters

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_pack, op3_secrets, op4_shard, op5_token_counts, op6_simhash, op7_byte_bpe, op8_toxicity, op9_exact_dedup, op10_permutation_index, op11_runs, op12_reply_trees, op13_spelling, pipeline)}

ORACLES: dict[str, str] = {
    "op1_warc": r"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
g as (select *, min(page_id) over (partition by payload_digest) as first_id, row_number() over (partition by payload_digest order by page_id nulls last) as place from d)
select page_id, payload_bytes, payload_digest,
 case when payload_bytes >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and place > 1 then first_id end as refers_to
from g""",
    "op12_reply_trees": r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, 8 + length(url_encode(role)) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/s>|s>|INST\]|/INST\])')) as size from rows),
told as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
 coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as lost, cast(sum(size) as bigint) as formatted_chars from sized group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(lost) as loss_chars, sha256(lost) as loss_sha256, formatted_chars from told""",
    "op9_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select doc_id, sha256(t) as text_sha256 from n)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
 doc_id is not distinct from min(doc_id) over (partition by text_sha256) as kept, text_sha256 from g""",
}
