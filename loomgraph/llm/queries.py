"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, licenses, mixing, negatives, pseudonyms, quality, repeats, simhash, tokens, toxicity, variants
from .storage import read_table


#: Keys are secrets of a run; this one is for the registered query.
PSEUDONYM_KEY = b"loomgraph registered query"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.formatted(read_table(spark, sf_dir, "conversations"), chat.TOOLS)
    return out.select("conv_id", "turn", "role", F.sha2("json", 256).alias("json_sha256"), "n_calls", "n_valid", "n_answered")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"))


#: Where the public tokenizers' files are; a parameter of the operator.
def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = tokens.write(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read(files)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.ledger(read_table(spark, sf_dir, "documents"))
    base_failed = ~quality.verdict(quality.BASE)
    kept = quality.verdict(quality.DEFAULT)
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (kept & ~base_failed).alias("kept"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_licenses")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(read_table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_decontaminate": op2_decontaminate,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard": op6_jaccard,
    "op7_tokens": op7_tokens,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_simhash": op11_simhash,
    "op12_variants": op12_variants,
    "op13_negatives": op13_negatives,
}

_OP1 = """
SELECT conv_id, turn, role,
       sha256('{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || '}') AS json_sha256,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_answered
FROM conversations
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"

_OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
item_windows AS (
  SELECT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, v.k, item_id FROM doc_windows v JOIN item_windows x ON v.win = x.win AND v.k = x.k),
positions AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN positions p USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

_OP9 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines
  FROM documents),
m AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM windows),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE k > 1) GROUP BY doc_id),
f AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 40 * n_words) AS kept
FROM f
"""


def _op10() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(licenses.TEMPLATES.items()))
    cut = "array_to_string(w[i:i + 4], ' ')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
t AS (SELECT name, regexp_extract_all(lower(text), '{_ALNUM}') AS w FROM (VALUES {values}) AS v(name, text)),
ds AS (SELECT DISTINCT doc_id, {cut} AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
ts AS (SELECT DISTINCT name, {cut} AS sh FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
n AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
found AS (SELECT doc_id, name FROM ds JOIN ts USING (sh) JOIN n USING (name) GROUP BY doc_id, name, n HAVING count(*) * 100 >= n * 75),
got AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, count(*) AS n FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses FROM d LEFT JOIN got USING (doc_id)
"""


_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: CRC-32 over bytes by a table of 256 entries that a rule makes; near words by equal wildcard keys.
_OP12 = f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
bytes AS (
  SELECT w, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''),
         lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END)) AS b
  FROM runs),
hashed AS (
  SELECT w, n, CASE WHEN b IS NOT NULL THEN xor(list_reduce(b, lambda c, x: xor(c >> 8, CAST(t.t[(xor(c, x) & 255) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT)), 4294967295) END AS h
  FROM bytes, t),
words AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
wild AS (SELECT word, n, left(word, i - 1) || '*' || substring(word, i + 1) AS k FROM places),
cut AS (SELECT DISTINCT word, n, left(word, i - 1) || substring(word, i + 1) AS k FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.k = b.k AND a.word != b.word
  UNION ALL SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.k = w.word
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.k = w.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 5 * n),
path AS (
  SELECT word, word AS last, 0 AS hop FROM words
  UNION ALL SELECT p.word, f.form, p.hop + 1 FROM path p JOIN forms f ON f.word = p.last)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) JOIN (SELECT word, arg_max(last, hop) AS root FROM path GROUP BY word) r USING (word)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat": _OP1,
    "op2_decontaminate": _OP2,
    "op6_jaccard": _OP6,
    "op9_quality": _OP9,
    "op10_licenses": _op10(),
    "op12_variants": _OP12,
    "op13_negatives": _OP13,
}
