"""Registered queries of the subpackage: one for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.chat_format import expand_examples, format_conversations, formatted_text, loss_text, read_turns, unescape
from fieldloom.llm.common import table
from fieldloom.llm.decontamination import leaks
from fieldloom.llm.fill_in_middle import TOKEN, fill_in_middle, restore
from fieldloom.llm.language_id import language_id
from fieldloom.llm.license_scan import HEADER_BREAK, LICENCE_FILE, STOP, TERM_BREAK, THRESHOLD, UNIT_BREAK, license_scan, template_weights, vocabulary
from fieldloom.llm.line_dedup import line_dedup
from fieldloom.llm.packing import pack
from fieldloom.llm.pii import personal_data
from fieldloom.llm.quality import METRICS, MIN_GROUP, SPREAD, quality_rules
from fieldloom.llm.resampling import resample
from fieldloom.llm.set_join import set_join
from fieldloom.llm.simhash import near_duplicates
from fieldloom.llm.substring_dedup import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


# ---- 3: quality rules

def _ratio_sql(metric: str) -> str:
    over, scale, under, _, _ = METRICS[metric]
    return f"({over} * {scale} // greatest({under}, 1))"


def _bucket_sql(value: str) -> str:
    return f"({value} - {value} % CAST(pow(2, greatest(length(bin({value})) - 10, 0)) AS BIGINT))"


def _quality_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {_bucket_sql(_ratio_sql(m))} AS bucket FROM measured WHERE NOT base_failed" for m in METRICS)

    def quartiles(name: str, by: str) -> str:
        return f"""{name} AS (
            SELECT {by} metric, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS q1,
                   min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS q3
            FROM (SELECT {by} metric, bucket, sum(n) OVER (PARTITION BY {by} metric ORDER BY bucket) AS below,
                         sum(n) OVER (PARTITION BY {by} metric) AS total
                  FROM (SELECT {by} metric, bucket, sum(n) AS n FROM sketch GROUP BY {by} metric, bucket)) GROUP BY {by} metric)"""

    pick = lambda c: f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{c} WHEN l.total >= {MIN_GROUP} THEN l.{c} ELSE e.{c} END"
    fences = []
    for m, (_, _, _, least, low) in METRICS.items():
        reach = f"{SPREAD} * greatest(q3 - q1, {least})"
        fences.append(f"max(CASE WHEN metric = '{m}' THEN q3 + {reach} END) AS {m}_high")
        if low:
            fences.append(f"max(CASE WHEN metric = '{m}' THEN q1 - {reach} END) AS {m}_low")
    beyond = [f"{_bucket_sql(_ratio_sql(m))} > {m}_high" for m in METRICS] + [
        f"{_bucket_sql(_ratio_sql(m))} < {m}_low" for m, (*_, low) in METRICS.items() if low]
    space = "[\\x20\\x09-\\x0D]"
    return rf"""
    WITH split AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
    repeats AS (
        SELECT doc_id, sum(least(3, coalesce(i - lag_i, 3))) AS n_repeat_words
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS lag_i FROM windows WHERE n > 1) GROUP BY doc_id),
    measured AS (
        SELECT s.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_text_lines,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
               len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
        FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id),
    sketch AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({pairs}) GROUP BY lang, source, metric, bucket),
    {quartiles('own', 'lang, source,')}, {quartiles('per_lang', 'lang,')}, {quartiles('per_all', '')},
    fences AS (
        SELECT lang, source, {', '.join(fences)}
        FROM (SELECT o.lang, o.source, o.metric, {pick('q1')} AS q1, {pick('q3')} AS q3
              FROM own o JOIN per_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric
              JOIN per_all e ON o.metric = e.metric) GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce({' OR '.join(beyond)}, FALSE) AS kept
    FROM measured m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
    """


@query("op3_quality_rules", _quality_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and adaptive verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


# ---- 5: line dedup

@query("op5_line_dedup", r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in the largest doc_id only."""
    out = line_dedup(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


# ---- 10: chat formatting

@query("op10_chat_format", r"""
    WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    escaped AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM escaped GROUP BY conv_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, expanded into examples, and read back."""
    hard = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = format_conversations(turns)
    # the loss under each example's mask; the last example is the conversation up to its last reply
    examples = expand_examples(formatted).select(
        F.col("conv_id").alias("of"), F.struct("example", unescape(loss_text(F.col("segments"))).alias("loss")).alias("e"),
        F.when(F.col("last"), F.struct(formatted_text(F.col("segments")).alias("text"), F.size("segments").alias("n"))).alias("last"))
    replies = examples.groupBy("of").agg(F.sort_array(F.collect_list("e")).alias("es"), F.max("last").alias("last")).select(
        "of", F.array_join(F.transform("es", lambda e: e["loss"]), "").alias("loss"), "last")
    # what comes after the last reply is nobody's context
    done = F.coalesce("last.n", F.lit(0))
    rest = formatted_text(F.slice("segments", done + 1, F.greatest(F.size("segments") - done, F.lit(0))))
    whole = formatted.join(replies, formatted.conv_id.eqNullSafe(replies["of"]), "left").select(
        "conv_id", "loss", F.concat(F.coalesce("last.text", F.lit("")), rest).alias("formatted"))
    joined = whole.select("conv_id", "loss", "formatted", read_turns(F.col("formatted")).alias("turns"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.coalesce("loss", F.lit(""))
    return joined.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# ---- 6: SimHash near-dedup

@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- 8: substring dedup

@query("op8_substring_dedup", r"""
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    starts AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
    counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM starts),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM counted WHERE n > 1),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
    marked AS (SELECT p.*, g.i IS NOT NULL AS gone FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i)
    SELECT s.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM split s LEFT JOIN marked m ON s.doc_id = m.doc_id GROUP BY s.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows that start anywhere else are removed."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


# ---- 2: benchmark decontamination

@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its place."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 4: packing

@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in length buckets and token-budget batches."""
    return pack(table(spark, sf_dir, "documents"))


# ---- 1: language identification

@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    out = language_id(docs, docs.where(~F.col("held_out")), carry=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


# ---- 7: licence scan

def document_path(doc_id: str) -> str:
    """A file path for a document: source, two levels of folders of 1,000 and of 100 documents, and every hundredth is the folder's LICENSE."""
    return (
        f"concat(source, '/d', CAST(floor({doc_id} / 1000) AS BIGINT), '/d', CAST(floor({doc_id} / 100) AS BIGINT), '/', "
        f"CASE WHEN {doc_id} % 100 = 0 THEN concat('LICENSE.', {doc_id}) ELSE concat({doc_id}, '.txt') END)")


def _license_sql() -> str:
    idf, rare = vocabulary()
    quoted = lambda x: "'" + x + "'"
    idf_rows = ", ".join(f"({quoted(w)}, {v!r}::DOUBLE)" for w, v in idf.items())
    weights = ", ".join(f"({n}, {quoted(x)}, {quoted(w)}, {s!r}::DOUBLE)" for n, x, w, s in template_weights())
    stop = ", ".join(map(quoted, STOP))
    return rf"""
    WITH files AS (SELECT doc_id, {document_path('doc_id')} AS path, text FROM documents),
    idf AS (SELECT * FROM (VALUES {idf_rows}) AS t(word, idf)),
    templates AS (SELECT * FROM (VALUES {weights}) AS t(template, licence, word, share)),
    parts AS (SELECT path, 0 AS kind, string_split_regex(coalesce(text, ''), '{HEADER_BREAK}') AS p FROM files
              UNION ALL SELECT path, 1, string_split_regex(coalesce(text, ''), '{UNIT_BREAK}') FROM files
              UNION ALL SELECT path, 2, [coalesce(text, '')] FROM files WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}')),
    said AS (SELECT path, kind, unnest(p) AS said, generate_subscripts(p, 1) - 1 AS unit FROM parts),
    units AS (SELECT path, kind, unit, list_filter(list_transform(string_split_regex(lower(said), '{TERM_BREAK}'), lambda w: trim(w, '.-')),
                    lambda w: w <> '' AND w NOT IN ({stop})) AS words FROM said),
    used AS (SELECT path, kind, unit, unnest(words) AS word FROM units WHERE list_has_any(words, (SELECT list(word) FROM idf))),
    weighed AS (SELECT path, kind, unit, u.word, count(*) * coalesce(any_value(idf), {rare!r}) AS w FROM used u LEFT JOIN idf i ON u.word = i.word
                GROUP BY path, kind, unit, u.word),
    norms AS (SELECT path, kind, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY path, kind, unit),
    cosine AS (SELECT w.path, w.kind, w.unit, licence, round(sum(w * share) / any_value(norm), 3) AS score
               FROM weighed w JOIN templates t ON w.word = t.word JOIN norms n ON w.path = n.path AND w.kind = n.kind AND w.unit = n.unit
               GROUP BY w.path, w.kind, w.unit, template, licence),
    found AS (SELECT path, licence, score FROM cosine WHERE score >= {THRESHOLD}
              QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, kind, unit, licence) = 1),
    declared AS (SELECT regexp_replace(path, '/[^/]*$', '') AS home, licence, score FROM found
                 WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}')
                 QUALIFY row_number() OVER (PARTITION BY home ORDER BY score DESC, licence, path) = 1),
    up AS (SELECT f.path, d.licence, d.score, d.home FROM files f JOIN declared d ON starts_with(f.path, d.home || '/')
           QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.home) DESC) = 1)
    SELECT f.doc_id, f.path, coalesce(o.licence, u.licence) AS licence, coalesce(o.score, u.score) AS score,
           CASE WHEN o.path IS NOT NULL THEN 'header' WHEN u.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
           CASE WHEN o.path IS NOT NULL THEN f.path ELSE u.home END AS origin_path
    FROM files f LEFT JOIN found o ON f.path = o.path LEFT JOIN up u ON f.path = u.path
    """


@query("op7_license_scan", _license_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or its folder's."""
    # concat skips a null in the query's SQL and is null in Spark, where all such rows would be one file
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    files = docs.select("doc_id", F.expr(document_path("doc_id")).alias("path"), "text")
    out = license_scan(files)
    return files.select("doc_id", "path").join(out, "path", "left").select("doc_id", "path", "licence", "score", "origin", "origin_path")


# ---- 9: personal data

@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base digest and all spans of every document."""
    out = personal_data(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(F.encode(said("base"), "utf-8"), 256).alias("base_sha256"), said("spans").alias("spans"))


# ---- 11: importance resampling toward the benchmark

@query("op11_importance_resampling", r"""
    WITH crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) r(i))),
    said AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
             UNION ALL SELECT NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    used AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM said),
    bytes AS (SELECT w, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) AS b
              FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM used))),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
               FROM bytes, crc_table),
    placed AS (SELECT doc_id, bucket FROM used JOIN hashed USING (w)),
    cells AS (SELECT bucket, count(doc_id) AS s, count(*) - count(doc_id) AS t FROM placed GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS gain
              FROM cells),
    weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM placed JOIN gains USING (bucket)
                WHERE doc_id IS NOT NULL GROUP BY doc_id),
    scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                                      / 4294967296::DOUBLE))) AS BIGINT) AS score
               FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
    ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
    SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
    FROM scored s LEFT JOIN ordered o ON s.doc_id = o.doc_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn with the benchmark's words as target."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# ---- 12: n-gram Jaccard join

@query("op12_ngram_jaccard_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of five-word shingles, and its component."""
    return set_join(table(spark, sf_dir, "documents"))


# ---- 13: fill in the middle

@query("op13_fill_in_middle", rf"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS u,
               list_transform(range(0, 4), lambda k: CAST('0x' || substr(sha256('42:' || doc_id), 8 * k + 1, 8) AS BIGINT)) AS h FROM documents),
    drawn AS (
        SELECT *, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parts AS (
        SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
               coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
               AS output_sha256, sha256(text) AS restored_sha256
    FROM parts
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents rearranged, and the texts rebuilt from the output."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
