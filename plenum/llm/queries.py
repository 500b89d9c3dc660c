"""One query for each operator over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import bpe, decontam, fim, htmlmain, linededup, lm, packing, pii, quality, runs, simhash, toxicity, urlrules
from plenum.llm.common import bind, table, words_of

#: The words of a text in DuckDB.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _fold(folds: int):
    """The remainder that decides whether a document may be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_fold(4) != 2)
    scored = toxicity.classify(docs, labels)
    # a row without an id has no label, so it is never learned from
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned measures are needed of every text, so the cascade can only skip the others here; the pipeline's stage skips all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, measures=quality.BASE)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.BASE, failed.alias("base_failed"), "kept")


OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(string_split(text, chr(10))) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_capitals > word_chars OR 2 * n_dup_lines > n_lines) AS kept
FROM b"""

#: The key of the registered query; a real run passes its own secret.
PII_KEY = "an example key"

#: The rules of the contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"VALUES {', '.join(str(r) for r in URL_RULES)} AS rules(host, path, verdict)")
    judged = urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5 = rf"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(5) == 1, F.lit(True))
    model = lm.fit(docs.where(~held_out))
    scored = lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p, len(w) AS size FROM w),
dg AS (SELECT doc_id, size, p, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g
  FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
bt AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS p, len(w) AS n FROM b),
bg AS (SELECT item_id, n, p, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g
  FROM bt WINDOW o AS (PARTITION BY item_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, item_id, n, unnest(generate_series(least(greatest(0, dg.p - n + 4), greatest(0, size - n)), least(dg.p - 1, greatest(0, size - n)))) AS start FROM dg JOIN bg USING (g)),
x AS (SELECT s.doc_id, s.item_id, s.n, s.start, dg.g, count(*) AS c FROM s JOIN dg ON dg.doc_id = s.doc_id AND dg.p > s.start AND dg.p <= s.start + s.n - 4 AND dg.g IS NOT NULL GROUP BY ALL),
y AS (SELECT item_id, g, count(*) AS c FROM bg WHERE g IS NOT NULL GROUP BY ALL),
met AS (SELECT doc_id, item_id, n, start, sum(least(x.c, y.c)) AS m FROM x JOIN y USING (item_id, g) GROUP BY ALL),
mine AS (SELECT doc_id, item_id, n, start, sum(c) AS a FROM x GROUP BY ALL),
theirs AS (SELECT item_id, sum(c) AS b FROM y GROUP BY item_id),
j AS (SELECT doc_id, item_id, n, start, m / (a + b - m) AS similarity FROM met JOIN mine USING (doc_id, item_id, n, start) JOIN theirs USING (item_id) WHERE 9 * m >= 4 * (a + b))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words, CAST(similarity AS DOUBLE) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM j) WHERE r = 1"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlmain.extract_main(pages).select("page_id", "url", "text", "n_chars")


OP10 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br)(?:\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&amp;', '&') AS t FROM t),
e AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\x{A0}]+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e"""


def _sha256(text):
    return F.sha2(text.cast("binary"), 256)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(back).alias("restored_sha256"))


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS t,
  CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
k AS (SELECT *, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS k1, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS k2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(list_slice(t, 1, k1), '') AS p, array_to_string(list_slice(t, k1 + 1, k2), '') AS m, array_to_string(list_slice(t, k2 + 1, len(t)), '') AS s FROM k)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""

def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = bpe.decode(encoded, vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(listed).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _planted(words):
    """The contract's texts: of one document in ten, by its id, the words from some place on are made to repeat."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    g = F.floor(h / 10)

    def repeated(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    return bind(words, lambda w: F.when((h % 10 == 0) & (F.size(w) > 0), repeated(w)).otherwise(w))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(_planted(words_of(F.col("text"))), " ").alias("text"))
    found = runs.periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    picked = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"))
    length = -F.col("best.size")
    return picked.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        _sha256(F.col("listed")).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {"op11_bpe": op11_bpe, "op12_periodic_runs": op12_periodic_runs, "op13_fim": op13_fim, "op4_packing": op4_packing, "op6_pii": op6_pii, "op7_gru_lm": op7_gru_lm, "op8_decontamination": op8_decontamination, "op10_html_text": op10_html_text, "op9_line_dedup": op9_line_dedup, "op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_quality_rules": op3_quality_rules, "op5_url_rules": op5_url_rules}
ORACLES = {"op13_fim": OP13, "op10_html_text": OP10, "op8_decontamination": OP8, "op9_line_dedup": OP9, "op3_quality_rules": OP3, "op5_url_rules": OP5}
