"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.llm import chat, clustering, decontaminate, exact_dedup, language, lexical, near_dup, packing, quality_model, quality_rules, suffix_dedup, tokens, toxicity
from scenegrid.llm.tables import read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))
    written = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), " ") for c in ("repeated", "removed")}
    return found.withColumns(written)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity")  # two places may be equally similar


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Rounds written out one after another; every distance is measured."""
    distance = "list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT".format(dim=dim)
    out = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT v.vec_id, v.v, c.k, {distance} AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY {distance}, c.k) AS r FROM v, c{i} c) WHERE r = 1)")
        if i < rounds:
            out.append(
                f"""m{i} AS (SELECT k, list(m ORDER BY i) AS c FROM (
  SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT k, unnest(range(1, {dim} + 1)) AS i, unnest(v) AS x FROM a{i}) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
            )
    return ",\n".join(out) + f"""
SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_quality_rules,
        op3_near_duplicates,
        op4_suffix_dedup,
        op5_best_fit_packing,
        op6_language_id,
        op7_decontamination,
        op8_quality_classifier,
        op9_token_ids,
        op10_toxicity,
        op11_exact_dedup,
        op12_lexical_search,
        op13_centroid_clustering,
    )
}

ORACLE_SQL = {
    "op2_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words
    OR 2 * n_dup_lines > length(t) - length(translate(t, chr(10), '')) + 1
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > 3 * length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
    OR 10 * (length(t) - length(translate(t, '!?', ''))) > 3 * n_words) AS kept
FROM b""",
    "op3_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 4
), b AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM b GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS met FROM b x JOIN b y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE met >= 0.8 * (p.n + q.n - met)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a""",
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
twice AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS gone, count(*) OVER (PARTITION BY h) AS c FROM win),
lit AS (SELECT doc_id, i, gone FROM twice WHERE c > 1),
sorts AS (SELECT doc_id, i, 'repeated' AS kind FROM lit UNION ALL SELECT doc_id, i, 'removed' FROM lit WHERE gone),
runs AS (SELECT *, i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL AS new FROM sorts WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, kind ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, kind, (min(i))::INT AS start, (max(i) + 50)::INT AS "end" FROM numbered GROUP BY doc_id, kind, run)
SELECT doc_id, (sum("end" - start) FILTER (WHERE kind = 'repeated'))::BIGINT AS n_repeated_words, (coalesce(sum("end" - start) FILTER (WHERE kind = 'removed'), 0))::BIGINT AS n_removed_words,
  string_agg(start || '-' || "end", ' ' ORDER BY start) FILTER (WHERE kind = 'repeated') AS repeated, coalesce(string_agg(start || '-' || "end", ' ' ORDER BY start) FILTER (WHERE kind = 'removed'), '') AS removed
FROM spans GROUP BY doc_id""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, i, list_slice(w, i + 1, i + least(5, len(w))) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT item_id, i, list_slice(w, i + 1, i + least(5, len(w))) AS g FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
laid AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(ds.i - bs.i, len(d.w) - len(b.w))) AS start FROM ds JOIN bs USING (g) JOIN d USING (doc_id) JOIN b USING (item_id)),
x AS (SELECT doc_id, item_id, start, ds.g, count(*) AS c FROM laid JOIN b USING (item_id) JOIN ds USING (doc_id) WHERE ds.i >= start AND ds.i <= start + greatest(0, len(b.w) - 5) GROUP BY ALL),
y AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL),
m AS (SELECT doc_id, item_id, start, sum(least(x.c, y.c)) AS met FROM x JOIN y USING (item_id, g) GROUP BY ALL),
n AS (SELECT doc_id, item_id, start, sum(c) AS n FROM x GROUP BY ALL), k AS (SELECT item_id, sum(c) AS n FROM y GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, met / (n.n + k.n - met) AS similarity FROM m JOIN n USING (doc_id, item_id, start) JOIN k USING (item_id))
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity FROM j WHERE similarity >= 0.8 GROUP BY doc_id, item_id""",
    "op11_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r""",
    "op12_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
n AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM n),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l))))::BIGINT AS score FROM b JOIN p USING (term) JOIN f USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_centroid_clustering": _clustering_sql(),
}
