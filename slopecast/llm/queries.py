"""The queries of the operators; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.llm import audio, chat, chunks, collocations, language, negatives, outliers, pfair, pseudonyms, quality, simhash, templates, tokens
from slopecast.llm.common import crc_of_id, load_table, text_or_empty

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(load_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def word_vocabulary() -> str:
    """Place of the vocabulary of the token-id query; the file stays where its package is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document in the binary id files."""
    return tokens.token_table(load_table(spark, sf_dir, "documents"), word_vocabulary())


@query
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, and the passage's kind."""
    found = templates.contaminated(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.max("matched").alias("matched"), F.max("n_windows").alias("n_windows"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("passages")
    )


@query
def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and position of every document in the mix of the sources."""
    docs = load_table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", F.xxhash64(text_or_empty("text")).alias("digest"))  # the texts only break ties
    plan = pfair.schedule(narrow, text_col="digest")
    names = {"__epoch": "epoch", "__block": "block", "__release": "release", "__deadline": "deadline", "__slot": "slot", "__position": "position"}
    return plan.select("doc_id", "source", *[F.col(a).alias(b) for a, b in names.items()])


def language_rows(id_col: str = "doc_id") -> Column:
    """Rows that the language model may learn from; null ids are left out."""
    return F.coalesce(crc_of_id(id_col) % 3 != 1, F.lit(False))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = load_table(spark, sf_dir, "documents")
    model = language.learn(docs, language_rows())
    found = docs.select("doc_id", F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), language.identified(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents: place and length in bytes, first document, repeated bytes."""
    found = chunks.repeated_passages(load_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.col("first_id").alias("first_doc_id"), "repeated_bytes")


@query
def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = load_table(spark, sf_dir, "documents")
    held = crc_of_id("doc_id") % 5 == 0
    model = quality.learn(docs, load_table(spark, sf_dir, "labels"), F.coalesce(~held, F.lit(False)))
    found = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), quality.scored(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


#: Key of the pseudonym query; a deployment passes its own secret.
PSEUDONYM_KEY = "slopecast-pseudonyms"


@query
def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with pseudonyms, and the values found, for every document."""
    found = load_table(spark, sf_dir, "documents").select("doc_id", pseudonyms.pseudonymised("text", PSEUDONYM_KEY).alias("found"))
    return found.select("doc_id", "found.text", F.size("found.kinds").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kinds")), ",").alias("kinds"))


@query
def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through its audio carrier and back."""
    return audio.documents_as_audio(load_table(spark, sf_dir, "documents"))


def chat_vocabulary() -> str:
    """Place of the byte-level vocabulary of the chat query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TURNS = f"""(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{chat.END}{chat.START}assistant ok' FROM range(2) r(n))"""
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
ORACLE["op5_chat_tokens"] = f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(escaped_role) + length(escaped) + {len(chat.START) + len(chat.END) + 2}) AS BIGINT) AS formatted_chars
    FROM (SELECT *, {_ESCAPED.format('text')} AS escaped, {_ESCAPED.format(_ROLE)} AS escaped_role FROM {_TURNS}) GROUP BY conv_id"""


@query
def op5_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that says control strings, read from their token rows."""
    turns = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = f"{chat.END}{chat.START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(turns.union(more), chat_vocabulary())


@query
def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and whether its group's robust estimate keeps it."""
    found = outliers.judged(load_table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(F.col("id").alias("doc_id"), *base, "distance")


_PIECES = r"""(SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))"""
ORACLE["op12_quotient_collocations"] = f"""WITH pieces AS MATERIALIZED {_PIECES},
    grams AS MATERIALIZED (SELECT lang, ws[i:i + size - 1] AS g, count(*) AS f FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM pieces, range(1, {collocations.LONGEST + 1}) AS s(size) WHERE len(ws) >= size) GROUP BY ALL),
    often AS MATERIALIZED (SELECT * FROM grams WHERE f >= {collocations.LEAST_COUNT}),
    cuts AS (SELECT p.lang, p.g, p.f AS a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(p.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS k FROM often WHERE len(g) > 1) p
        JOIN often x ON x.lang = p.lang AND x.g = p.g[1:k] JOIN often y ON y.lang = p.lang AND y.g = p.g[k + 1:len(p.g)]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    covers AS (SELECT lang, g[i:i + size - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, size, unnest(range(1, len(g) - size + 2)) AS i
        FROM often, range(2, {collocations.LONGEST}) AS s(size) WHERE len(g) > size) GROUP BY ALL),
    kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.g = b.g
        WHERE NOT coalesce(100 * CAST(c.longer AS HUGEINT) >= {collocations.COVERED} * CAST(b.a AS HUGEINT), false)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM grams n WHERE n.lang = ranked.lang AND len(n.g) = 1) AS n, score, CAST(k AS INTEGER) AS cut
    FROM ranked WHERE rank <= {collocations.TOP}"""


@query
def op12_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language by the worst of their cuts."""
    return collocations.collocations(load_table(spark, sf_dir, "documents"))


_SCORE = "CAST(list_inner_product(a.q, b.q) AS BIGINT)"
ORACLE["op13_multi_index_negatives"] = f"""WITH used AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
    anchors AS (SELECT * FROM used WHERE vec_id % 50 = 0),
    scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_SCORE} AS score FROM anchors a JOIN used b ON a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
    ranked AS (SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        WHERE {negatives.LOW} * CAST(positive_score AS HUGEINT) <= 100 * CAST(n.score AS HUGEINT) AND 100 * CAST(n.score AS HUGEINT) <= {negatives.HIGH} * CAST(positive_score AS HUGEINT))
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {negatives.NEGATIVES}"""


@query
def op13_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row's label counts as the next one."""
    rows = load_table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("id") % 50 == 0)
