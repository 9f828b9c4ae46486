"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import byte_bpe, chat, conversation_repair, fuzzy_lines, neighbours, ngram_join, packing, phrases, quality_classifier, quality_rules, repeated_spans, secret_scan, subword_lm
from shelfmark.llm.scratch import written
from shelfmark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that have a near copy earlier."""
    kept = fuzzy_lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and digest both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(documents, path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


#: Windows of 50 words, the first document of each, and the words that no earlier document's window covers.
ORACLES["op3_repeated_spans"] = r"""WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS f FROM spans GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM spans JOIN firsts USING (s) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""


@query
def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 50 words cover which start in an earlier document."""
    kept = repeated_spans.remove(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document."""
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def span_text(spans) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secret spans of every document, and the digest of the base ones."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and its likelihood ratio against documents labelled good."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().hint("merge")
    ratios = quality_rules.fit(documents.join(good, "doc_id", "left_semi"), documents)
    return quality_rules.judge(documents, ratios).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the pieces of all documents."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = F.crc32("ids").alias("ids_crc32")
    return packing.pack(written(cut.select("doc_id", "piece", "start", "length", digest), "pieces"))


#: Tools that the derived calls name, with their schemas; calls of "forecast" are to an unknown tool.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}}, "required": ["query"], "additionalProperties": False},
    "lookup": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query", "limit"]},
}


def tool_tables(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, tools) that stand in for logged tool use, derived from every turn of every conversation.

    Each assistant turn makes a call about its whole text; the turn after it, if the user
    speaks, is the result. Every other call of a conversation uses the result of the one before.
    """
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    spoken = conversations.where("role = 'assistant'")
    kind = F.pmod(F.col("conv_id") + turn, F.lit(5))
    body = F.to_json(F.struct(F.pmod(turn * 3 + F.col("conv_id"), F.lit(8)).alias("limit"), F.col("text").alias("query")))
    calls = spoken.select(
        "conv_id",
        name(turn).alias("call_id"),
        "turn",
        F.when(kind < 2, "search").when(kind < 4, "lookup").otherwise("forecast").alias("tool"),
        F.when(F.pmod(F.col("conv_id"), F.lit(17)) == 3, F.concat(body, F.lit(","))).otherwise(body).alias("arguments"),
        F.when(F.pmod(turn, F.lit(4)) >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("uses"),
    )
    results = conversations.where("role = 'user' AND turn > 0").select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    tools = spark.createDataFrame([(k, json.dumps(v)) for k, v in TOOLS.items()], "tool string, schema string")
    return calls, results, tools


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as canonical JSON rows, with tool calls derived from their turns."""
    conversations = table(spark, sf_dir, "conversations")
    return chat.link(conversations, *tool_tables(spark, conversations))


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that a model may learn from: those of documents that are not held out."""
    return labels.where(~quality_classifier.held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(documents, training_labels(table(spark, sf_dir, "labels")))
    scored = quality_classifier.score(documents, model)
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


#: Phrases of 1 to 4 words within pieces, their counts, the lowest cut of each, and the best 2000 of each language.
ORACLES["op11_phrases"] = r"""WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
named AS (SELECT lang, k AS m, ws, array_to_string(ws, ' ') AS phrase, f FROM counts),
cuts AS (SELECT lang, m, ws, phrase, f, unnest(range(1, m)) AS k FROM named WHERE m >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, c.k, l.f AS l, r.f AS r, ((2000000::hugeint * c.f) // (l.f::hugeint + r.f))::bigint AS score
  FROM cuts c JOIN named l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN named r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, f, ws, m, s, unnest(range(1, m - s + 2)) AS i FROM named, (SELECT unnest(range(2, 4)) AS s) WHERE m > s),
holders AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS within FROM parts GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN holders h USING (lang, phrase) WHERE h.within IS NULL OR 100 * h.within::hugeint < 80 * o.a::hugeint)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the word and the subword model."""
    vocab = subword_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return subword_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab)


def _least_way(s: str, moves: list[tuple[str, str, str]]) -> str:
    """SQL of the least of some ways: (state before, added cost, edit), as strings that sort by cost and audit."""
    ways = [f"format('{{:09d}}', {s}[{q}][1:9]::bigint + {cost}) || {s}[{q}][10:] || '{edit}'" for q, cost, edit in moves]
    return ", ".join(ways)


def _repair_sql() -> str:
    """Plain dynamic programming over the rows of each conversation: four ways, one to each state, row by row."""
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
    more = "3 * x[3]::int"
    when = lambda test, state, cost, edit: f"CASE WHEN x[2] = '0' AND {test} THEN {_least_way('s', [(state, cost, edit)])} END"
    delete = lambda q: _least_way("s", [(q, "4", "D")])
    to_user = ", ".join(f"{when("x[1] = 'u'", q, more, 'K')}, {when('true', q, f'3 + {more}', 'R')}" for q in "124")
    rows = f"[{delete('1')}, least({delete('2')}, {when("x[1] = 's'", '1', more, 'K')}), least({delete('3')}, {to_user}), least({delete('4')}, {when("x[1] = 'a'", '3', more, 'K')}, {when('true', '3', f'3 + {more}', 'R')})]"
    users = f"[s[1], s[2], least(s[3], {_least_way('s', [('1', '3', 'I'), ('2', '3', 'I'), ('4', '3', 'I')])}), s[4]]"
    helpers = f"[s[1], s[2], s[3], least(s[4], {_least_way('s', [('3', '3', 'I')])})]"
    return rf"""WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (
  SELECT *, substr(role, 1, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
judged AS (
  SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS same, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (same) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list([ini, (blank OR same)::int::varchar, cut::int::varchar] ORDER BY i) AS items FROM judged GROUP BY conv_id),
ways AS (
  SELECT * EXCLUDE items, list_reduce(
    list_prepend(['000000000', NULL, NULL, NULL], flatten(list_prepend([['+u'], ['+a']], list_transform(items, lambda x: [x, ['+u'], ['+a']])))),
    lambda s, x: CASE x[1] WHEN '+u' THEN {users} WHEN '+a' THEN {helpers} ELSE {rows} END) AS s FROM convs),
best AS (SELECT * EXCLUDE s, least(s[1], s[4]) AS way FROM ways),
letters AS (SELECT conv_id, way[10:] AS audit, unnest(range(1, len(way) - 8)) AS p FROM best),
edits AS (SELECT conv_id, p, audit[p] AS e, count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
staying AS (
  SELECT e.conv_id, p, e, role, text, ini, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS nth
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i AND e.e <> 'I' WHERE e <> 'D'),
shifted AS (SELECT *, max((nth = 1 AND e = 'K' AND ini = 's')::int) OVER (PARTITION BY conv_id) AS o FROM staying),
turns AS (SELECT conv_id, p, CASE WHEN e = 'K' THEN role WHEN (nth - o) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM shifted),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS lines FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
  coalesce(illegal, 0)::bigint AS illegal, coalesce(way[1:9]::bigint, 0) AS cost, coalesce(way[10:], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLES["op13_conversation_repair"] = _repair_sql()


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted faults."""
    hurt = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repaired_digest(hurt)
