"""Named queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import is_held_out, scored, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import default_path, encode

    path = default_path(spark)
    tokens = encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_copies import near_copies

    return near_copies(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256")
    )


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    text = main_text(_table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import _spans
    from .personal_data import BASE, with_personal_data

    spans = F.col("spans")
    found = with_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select(
        "doc_id",
        *(_spans.count(spans, kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(_spans.text(_spans.base(spans, BASE)), 256).alias("base_sha256"),
        _spans.text(spans).alias("spans"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, train

    docs = _table(spark, sf_dir, "documents")
    forest = train(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return judge(docs, forest)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import _spans
    from .secrets import BASE, find_secrets

    spans = F.col("spans")
    return find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(_spans.count(spans, kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(_spans.text(_spans.base(spans, BASE)), 256).alias("base_sha256"),
        _spans.text(spans).alias("spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", "block", "slot", "offset", "in_mix")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, loss_text, read_turns

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    record = F.to_variant_object(F.struct("conv_id", "turn", "role", "text"))
    chats = format_chats(rows.unionByName(own).select(record.alias("record")))
    read = chats.select(
        F.col("conversation").cast("long").alias("conv_id"),
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(said, ""), "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each text, those of every tenth one (by a hash of its id) repeated from a place on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("words")
    g, a, p = F.col("g"), F.col("a"), F.col("p")
    chosen = docs.select("doc_id", "text", h.alias("h"), words.alias("words")).select(
        "*", F.floor(F.col("h") / 10).alias("g"), ((F.col("h") % 10 == 0) & (n > 0)).alias("chosen")
    )
    chosen = chosen.select("*", F.when(F.col("chosen"), g % n).alias("a"))
    chosen = chosen.select("*", F.when(F.col("chosen"), 1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
    again = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("chosen"), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapse_runs

    found = collapse_runs(made_periodic(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    cells = ("start", "length", "period")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in cells)), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["l"]).alias("length"),
        best["period"].alias("period"),
        F.try_divide(-1000 * best["l"] - (-1000 * best["l"]) % best["period"], best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(line, ""), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations, frequent_phrases

    return collocations(frequent_phrases(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_near_vectors": op2_near_vectors,
    "op3_personal_data": op3_personal_data,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_near_copies": op7_near_copies,
    "op8_repeats": op8_repeats,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_chat": op11_chat,
    "op12_periodic": op12_periodic,
    "op13_phrases": op13_phrases,
}

_MARKS = r"(<)(\\*(?:<SYS>>|</SYS>>|s>|/s>|\|role\|>|\|text\|>|\|end\|>))|(\[)(\\*(?:/?INST\]))"

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op11_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_MARKS}'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 23 + length(role) + len(regexp_extract_all(role, '{_MARKS}')) END AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2),
    lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
  FROM worded, range(1, 5) AS lengths(words)),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, words, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM counts, range(1, 4) AS places(k) WHERE words >= 2 AND k < words),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.lang = w.lang AND c.words > w.words
      AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ') AND 100::HUGEINT * c.f >= 80::HUGEINT * w.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
}
