"""The registered queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.llm.common import documents, labels, query
from chronolith.llm import (bpe_codec, hidden_markov, line_dedup as lines, near_dedup as near, packing, piece_sampling,
                            quality_classifier as quality, quality_rules as rules, ranked_search, token_alignment, token_counts as tokens,
                            toxicity as toxic, winnowing)

# --- 1 ---------------------------------------------------------------------------

NEAR_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM
    (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
    WHERE 100 * n_common >= 85 * (nx.n + ny.n - n_common)),
e2 AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e2.y, r.root FROM r JOIN e2 ON e2.x = r.x WHERE r.root < e2.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""


@query("op1_near_dedup", NEAR_SQL)
def op1(spark, sf_dir):
    return near.near_dedup(documents(spark, sf_dir))


# --- 2, 3, 4 ------------------------------------------------------------------------

@query("op2_toxicity")
def op2(spark, sf_dir):
    return toxic.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), keep=["doc_id"])


@query("op3_hidden_markov")
def op3(spark, sf_dir):
    return hidden_markov.hmm_scores(documents(spark, sf_dir))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    return quality.quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir), keep=["doc_id"])


# --- 5 ---------------------------------------------------------------------------


@query("op5_token_counts")
def op5(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir))


# --- 7 ---------------------------------------------------------------------------

@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return packing.best_fit_packing(documents(spark, sf_dir))


# --- 8 ---------------------------------------------------------------------------

@query("op8_piece_sampling")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    out = piece_sampling.decode(piece_sampling.encode_sampled(docs, keep=["doc_id", "text_sha256"]))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                      F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
                      F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("lossless"))


# --- 6 ---------------------------------------------------------------------------

_MARKS = "[^#*$%&|<>{}\\[\\]=~^_»›•·]+"
QUALITY_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM
        (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS MATERIALIZED (SELECT rid, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM
        (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
v AS (SELECT rid, line, length(line) AS n,
        length(regexp_replace(line, '{_MARKS}', '', 'g'))
          <= {rules.MAX_MARK_SHARE} * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))
        AND (len(ws) >= {rules.MIN_WORDS_WITHOUT_STOP} OR contains('{rules.STOPS.replace("'", "''")}', right(ws[-1], 1)))
        AND NOT regexp_matches(lower(line), '{"|".join(rules.BOILERPLATE)}')
        AND regexp_matches(line, '\\p{{L}}') AS ok FROM l),
s AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(n) AS chars,
        coalesce(sum(n) FILTER (WHERE ok), 0) AS kept_chars FROM v GROUP BY rid),
b AS (SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(s.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, s.chars, s.kept_chars
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(kept_chars >= {rules.MIN_KEPT_SHARE} * chars, true) AS kept
FROM b
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark, sf_dir):
    return rules.quality_rules(documents(spark, sf_dir)).drop("clean_text")


# --- 9 ---------------------------------------------------------------------------

_BARE = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
LINE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, source, t, unnest(string_split(t, chr(10))) AS line,
                   generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
p AS (SELECT source, line, count(DISTINCT t) AS pages FROM (SELECT source, t, {_BARE} AS line FROM l)
      WHERE line <> '' GROUP BY 1, 2),
h AS (SELECT source, count(DISTINCT t) AS total FROM d GROUP BY 1),
bad AS (SELECT p.source, p.line FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source
        WHERE pages >= {lines.MIN_PAGES} AND pages > {lines.MAX_RATIO} * total)
SELECT l.doc_id, count(*) FILTER (WHERE {_BARE.replace('line', 'l.line')} <> '') AS n_lines,
       count(bad.line) AS n_dropped,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE bad.line IS NULL), '')) AS clean_md5
FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND {_BARE.replace('line', 'l.line')} = bad.line
GROUP BY l.rid, l.doc_id
"""


@query("op9_line_dedup", LINE_SQL)
def op9(spark, sf_dir):
    out = lines.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5"))


# --- 10 --------------------------------------------------------------------------

@query("op10_fingerprints")
def op10(spark, sf_dir):
    return winnowing.fingerprints(documents(spark, sf_dir))


# --- 11 --------------------------------------------------------------------------

@query("op11_pair_alignment")
def op11(spark, sf_dir):
    out = token_alignment.align_tokens(documents(spark, sf_dir), groups="sha256")
    return out.withColumnRenamed("groups", "groups_sha256")


# --- 12 --------------------------------------------------------------------------

@query("op12_bpe_round_trip")
def op12(spark, sf_dir):
    out = bpe_codec.bpe_round_trip(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


# --- 13 --------------------------------------------------------------------------

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SEARCH_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
n AS MATERIALIZED (SELECT count(*) FILTER (WHERE len(ts) > 0) AS texts, sum(len(ts))::BIGINT AS total FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
t AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, n GROUP BY term, texts),
p AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(ts) * texts) // total)))) AS gain
      FROM t JOIN w USING (term) JOIN d USING (rid), n),
s AS (SELECT item_id, rid, sum(gain)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op13_ranked_search", SEARCH_SQL)
def op13(spark, sf_dir):
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
