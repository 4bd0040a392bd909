"""The operators of this subpackage as registered queries over the driver tables, with SQL twins where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limnos.llm.decontaminate import report as decontamination_report
from limnos.llm.divergence import LEAST_DOCS, TOP
from limnos.llm.divergence import audit as divergence_audit
from limnos.llm.embeddings import near_duplicates as near_duplicate_vectors
from limnos.llm.language import predict as predict_language
from limnos.llm.licenses import report as license_report
from limnos.llm.line_rules import LEAST_WORDS, LOSS, PHRASE_WORDS, PHRASES, REPEATED, STUB
from limnos.llm.line_rules import report as line_report
from limnos.llm.mixing import schedule
from limnos.llm.near_dedup import near_duplicates
from limnos.llm.quality import score_quality
from limnos.llm.sharding import shard
from limnos.llm.token_counts import count_tokens
from limnos.llm.toxicity import score_toxicity
from limnos.llm.vector_codes import report as code_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    """Path of the vocabulary file; the environment may name another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, "byte_bpe_50k.json")
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"


@query("op6_near_dedup", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.t),
c AS (SELECT doc_id, min(t) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query("op8_decontaminate", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, item_id, i, dw.n FROM dw JOIN bw USING (n, g)),
marked AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN held USING (r)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary())


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op9_embedding_dedup", """
WITH RECURSIVE u AS (SELECT r, vec_id, i, embedding[i] AS x FROM (SELECT row_number() OVER () AS r, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL)),
v AS (SELECT r, any_value(vec_id) AS vec_id, list(CAST(x AS DOUBLE) ORDER BY i) AS e FROM u GROUP BY r
      HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND sum(CAST(x AS DOUBLE) * x) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS t FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.t),
c AS (SELECT vec_id, min(t) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(_table(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


_MARKS = r"[!-/:-@\[-`{-~]"
_PHRASES = "|".join(PHRASES)


@query("op13_line_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1) GROUP BY r),
l AS (SELECT r, i, t[i] AS line, regexp_extract_all(t[i], '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT r, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS t FROM d))),
m AS (SELECT r, line, w, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l WHERE len(w) > 0),
x AS (SELECT row_number() OVER () AS k, r, line, w, again FROM m),
y AS (SELECT k, count(*) AS n, sum(length(u)) AS chars, count(*) FILTER (WHERE regexp_matches(u, '{_MARKS}{{2}}')) AS noisy,
             count(*) FILTER (WHERE NOT regexp_matches(u, '[0-9A-Za-z]|[^\x00-\x7F]')) AS lone FROM (SELECT k, unnest(w) AS u FROM x) GROUP BY k),
z AS (SELECT r, chars, again, again OR 2 * noisy > n OR (n <= {STUB} AND NOT regexp_matches(w[-1], '([.!?:;]|[^\x00-\x7F])$')) OR (lone >= 2 AND 5 * lone > n)
             OR (n <= {PHRASE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}')) AS fails FROM x JOIN y USING (k)),
s AS (SELECT r, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_failed,
             CAST(coalesce(sum(chars) FILTER (WHERE fails), 0) AS BIGINT) AS lost_chars FROM z GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed,
             coalesce(lost_chars, 0) AS lost_chars FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * lost_chars <= {LOSS} * word_chars AS kept FROM b""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


@query("op12_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
own AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY o.lang, source, o.term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(own.n, 0) + 1) // (g.total + l.v) AS p,
             1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(_table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 2) -> str:
    """Assignments and means of every round as one chain of tables."""
    sql = """WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT r, (i - 1) // (len(e) // 16) AS part, (i - 1) % (len(e) // 16) AS pos, e[i] AS f FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM k)),
good AS (SELECT row_number() OVER (ORDER BY r) - 1 AS entry, r FROM x GROUP BY r HAVING bool_and(f IS NOT NULL AND isfinite(f))),
y AS (SELECT r, part, pos, CAST(floor(256 * CAST(f AS DOUBLE)) AS BIGINT) AS v FROM x JOIN good USING (r)),
b0 AS (SELECT part, entry, pos, v FROM y JOIN good USING (r) WHERE entry < 64)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS (SELECT r, part, entry, d FROM (SELECT r, y.part, entry, sum((y.v - b.v) * (y.v - b.v)) AS d FROM y JOIN b{i} b ON y.part = b.part AND y.pos = b.pos GROUP BY r, y.part, entry)
       QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT y.part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM y JOIN a{i} a ON a.r = y.r AND a.part = y.part GROUP BY y.part, entry, pos),
b{i + 1} AS (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM b{i} LEFT JOIN m{i} USING (part, entry, pos))"""
    return sql + f""",
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (r)"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(_table(spark, sf_dir, "embeddings"))
