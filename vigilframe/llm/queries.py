"""Registered queries of the operators of this folder, with production parameters, and checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.llm import cascade, filter_audit, language, mixing, packing, prefix_trie, quotes, separators, signature_join, sketch, suffix_dedup, toxicity, url_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCUMENT_END = 65_535  # no id of the vocabulary
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


WORD_LIST = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

QUOTES_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m),
normal AS (SELECT conv_id, turn, trim(regexp_replace(lower(line), '[\s[:punct:]]+', ' ', 'g'), ' ') AS norm FROM lines),
said AS (SELECT DISTINCT conv_id, turn, norm FROM normal WHERE norm <> ''),
around AS (SELECT conv_id, turn, role, text, lag(turn) OVER w AS one, lag(turn, 2) OVER w AS two FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
quoted AS (
  SELECT a.conv_id, a.turn, 1 AS level, n.norm FROM around a JOIN normal n ON n.conv_id = a.conv_id AND n.turn = a.one
  UNION ALL SELECT a.conv_id, a.turn, 2, n.norm FROM around a JOIN normal n ON n.conv_id = a.conv_id AND n.turn = a.two),
sources AS (SELECT q.conv_id, q.turn, q.norm, max(s.turn) AS source FROM (SELECT DISTINCT conv_id, turn, norm FROM quoted) q
  JOIN said s ON s.conv_id = q.conv_id AND s.norm = q.norm AND s.turn < q.turn GROUP BY ALL),
linked AS (SELECT q.*, s.source FROM quoted q LEFT JOIN sources s USING (conv_id, turn, norm)),
votes AS (SELECT conv_id, turn, source, count(*) AS votes FROM linked WHERE level = 1 AND source IS NOT NULL GROUP BY ALL),
reply AS (SELECT conv_id, turn, max_by(source, votes * 1000000 + source) AS reply FROM votes GROUP BY ALL),
total AS (SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked, max(level) AS max_level,
  coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ','), '') AS quoted_turns FROM linked GROUP BY ALL)
SELECT a.conv_id, a.turn, a.role, coalesce(r.reply, a.one) AS reply_to, coalesce(t.quoted_turns, '') AS quoted_turns,
  coalesce(t.n_quoted, 0) AS n_quoted, coalesce(t.n_linked, 0) AS n_linked, coalesce(t.max_level, 0)::INTEGER AS max_level,
  trim(a.text, chr(10) || ' ') AS own_text
FROM around a LEFT JOIN reply r USING (conv_id, turn) LEFT JOIN total t USING (conv_id, turn)
"""


@register("op1_quotation_linking", QUOTES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return quotes.linked_messages(messages, quotes.mail_lines(messages))


@register("op1_reply_threads")
def op1_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(op1(spark, sf_dir))


@register("op2_url_template_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judged_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op3_threshold_sketch")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


JOIN_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = n.doc_id) AS component_id,
  (SELECT count(*) FROM both_ways WHERE a = n.doc_id)::BIGINT AS n_links FROM n
"""


@register("op4_signature_tree_join", JOIN_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked_documents(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORD_LIST})::BIGINT AS size,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
g AS (SELECT *, length(bin(size))::BIGINT AS level, u / (1 - u) AS odds FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * level)::BIGINT AS level_sum, min(level) AS low, max(level) AS high FROM g GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS fill
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(3 * source_size::DOUBLE, weight * max(fill) OVER ()) AS target FROM f),
e AS (SELECT g.*, t.source_size, t.target, target / source_size AS ratio,
    CASE WHEN high > low THEN (level - level_sum / source_size) / (high - low) ELSE 0.0 END AS tilt FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0.0, least(3.0, ratio + least(ratio, 3 - ratio) * tilt)) ELSE 0.0 END AS expected FROM e),
r AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS rest FROM x),
k AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN odds / (rest / (1 - rest)) END AS rank FROM r),
c AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS left_over,
    sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k),
q AS (SELECT *, whole + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= left_over THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies, source FROM q
"""


@register("op5_pareto_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


@register("op6_separator_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = separators.with_file(docs)
    found = separators.documents_in(separators.blocks_of_files(placed, TOKENIZER, DOCUMENT_END), DOCUMENT_END)
    # Which document lies at which place is known here, as the files were made from this table.
    names = placed.select("doc_id", "file").withColumn(
        "doc_index", F.row_number().over(Window.partitionBy("file").orderBy("doc_id")).cast("long") - 1)
    return found.join(names, ["file", "doc_index"], "left").select("doc_id", "file", "doc_index", "start", "n_tokens")


@register("op7_rule_cascade")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judged(table(spark, sf_dir, "documents"))


@register("op8_lexicon_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learnt(docs, labels.where(~language.in_fold(F.col("doc_id"), 4, 2)))
    return toxicity.scored(docs, model).select(
        "doc_id", language.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@register("op9_naive_bayes_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learnt(docs.where(F.col("doc_id").isNotNull() & ~language.in_fold(F.col("doc_id"), 5, 0)))
    return language.with_language(docs, model).select(
        "doc_id", language.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


@register("op10_tournament_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1)


TRIE_SQL = r"""
WITH m AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
  [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 6 AS share FROM m),
g AS (SELECT c.conv_id, m.place, m.role, m.text FROM c JOIN m ON m.conv_id = c.base AND m.place < c.share),
n AS (SELECT conv_id, count(*) AS given FROM g GROUP BY 1),
b AS (SELECT * FROM g UNION ALL SELECT m.conv_id, m.place - share + coalesce(given, 0), role, text
  FROM m JOIN c USING (conv_id) LEFT JOIN n USING (conv_id) WHERE m.place >= share),
p AS (SELECT conv_id, place + 1 AS depth, length(text) AS len, md5(string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (
  PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS path FROM b
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
o AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len FROM p GROUP BY ALL),
u AS (SELECT o.*, r.path AS above, r.conv_id AS parent_conv_id FROM o LEFT JOIN p ON p.conv_id = o.conv_id AND p.depth = o.depth - 1 LEFT JOIN o r ON r.path = p.path),
k AS (SELECT above AS path, count(*) AS n_children FROM u WHERE above IS NOT NULL GROUP BY 1),
x AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN k USING (path)),
s AS (SELECT p.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.len) AS saved FROM x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY 1),
l AS (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY 1),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY 1)
SELECT u.conv_id, u.depth::BIGINT AS depth, u.parent_conv_id, u.n_convs, x.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM u JOIN x USING (path) JOIN s USING (path) LEFT JOIN e USING (path)
"""


@register("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


AUDIT_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORD_LIST} AS words FROM documents),
f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
  100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT p, array_to_string(list_transform(p, lambda k: chr((64 + k)::INTEGER)), '') AS filter_order, k AS step, p[k] AS filter FROM o, x),
r AS (SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS fail,
  len(list_filter(p[1:step - 1], lambda k: fails[k])) = 0 AS there, len(list_filter(fails, lambda q: q)) = 1 AS single FROM d, s),
t AS (SELECT part, filter_order, step::INTEGER AS step, filter,
  sum(CASE WHEN there AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN there AND fail THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fail AND NOT there THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fail AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN there AND fail THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN there AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t
"""


@register("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_suffix_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
