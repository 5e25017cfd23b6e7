"""Queries of the operators in this folder over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import ann, classifier, language, merkle, mixing, neardup, packing, quality, substrings, suffixes, tokenfiles, toxicity, whitening
from pageloom.llm.common import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(r"""
    WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    words AS (SELECT doc_id, lang, unnest(ws) AS word FROM docs),
    grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 2], ' ')) AS n FROM docs, unnest(range(1, len(ws) - 1)) t(i)),
    inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, range(0, 3) r(k) WHERE n > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
    same_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    patterns AS (SELECT * FROM (VALUES (0, '[^a-z]'), (1, '[^A-Z]'), (2, '[^0-9]'), (3, '[^\x20\x09\x0B\x0C\x0D]'), (4, '[^\n]'), (5, '[^.,:;!?''"()\-]'),
                 (6, '[^#*$%&|<>]'), (7, '[\x{80}-\x{10FFFF}a-zA-Z0-9\x20\x09-\x0D.,:;!?''"()\-#*$%&|<>]'), (8, '[\x00-\x7F]')) v(class, other)),
    chars AS (SELECT doc_id, lang, class, length(regexp_replace(t, other, '', 'g')) AS n FROM docs, patterns),
    common AS (SELECT lang, word, sum(1) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) AS place FROM words GROUP BY lang, word
               QUALIFY place <= 40),
    places AS (SELECT lang, word, place, n FROM common
               UNION ALL SELECT lang, NULL, 41, count(*) - (SELECT sum(c.n) FROM common c WHERE c.lang IS NOT DISTINCT FROM w.lang) FROM words w GROUP BY lang),
    own AS (SELECT doc_id, w.lang, coalesce(place, 41) AS place, count(*) AS n FROM words w LEFT JOIN common c ON c.lang IS NOT DISTINCT FROM w.lang AND c.word = w.word GROUP BY ALL),
    bins AS (SELECT doc_id, 'c' AS kind, n, sum(n) OVER (PARTITION BY lang, class) AS ref FROM chars
             UNION ALL SELECT d.doc_id, 'w', coalesce(o.n, 0), p.n FROM docs d JOIN places p ON p.lang IS NOT DISTINCT FROM d.lang
             LEFT JOIN own o ON o.doc_id = d.doc_id AND o.place = p.place),
    shares AS (SELECT doc_id, kind, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS p, ref / nullif(sum(ref) OVER (PARTITION BY doc_id, kind), 0) AS q FROM bins),
    far AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d
            FROM shares GROUP BY doc_id, kind),
    counted AS (
        SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(i.n, 0)::BIGINT AS n_repeat_words
        FROM docs LEFT JOIN same_lines l USING (doc_id) LEFT JOIN inside i USING (doc_id))
    SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(x.d <= 0.30 AND y.d <= 0.43, false) AS kept
    FROM counted c LEFT JOIN far x ON x.doc_id = c.doc_id AND x.kind = 'c' LEFT JOIN far y ON y.doc_id = c.doc_id AND y.kind = 'w'
""")
def op3_quality_rules(spark, folder):
    return quality.quality_verdicts(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS h
        FROM documents),
    ranked AS (
        SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
               WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM sized GROUP BY source),
    filled AS (
        SELECT *, sum(source_size) OVER () AS whole,
               coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
        FROM ranked WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
    level AS (
        SELECT *, 3 * source_size <= (whole - before)::DOUBLE / weights_left * weight AS stops FROM filled),
    target AS (
        SELECT source AS s, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE
               (whole - min(before) FILTER (NOT stops) OVER ())::DOUBLE / max(weights_left) FILTER (NOT stops) OVER () * weight END AS target
        FROM level),
    taken AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS fold,
               sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING)
               - sum(size) OVER (PARTITION BY source, h) / 2.0 AS middle
        FROM sized JOIN target ON source IS NOT DISTINCT FROM s)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * (fold + CASE WHEN middle <= target - fold * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM taken
""")
def op4_source_mixing(spark, folder):
    mix = mixing.mixed_copies(documents(spark, folder))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM docs, unnest(range(1, len(ws) - 11)) t(i)),
    least AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (win), range(0, 13) r(k) WHERE least < doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM docs),
    kept AS (SELECT words.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS rest
             FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
""")
def op2_substring_dedup(spark, folder):
    kept = substrings.without_repeats(documents(spark, folder))
    # The words that are left, joined by one space.
    words = F.regexp_replace(F.col("kept"), r"[\x20\x09-\x0D]+", " ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(words).cast("binary"), 256).alias("kept_sha256"))


@query("""
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    strings AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS m FROM docs, unnest(range(0, len(x) // 2 - 99)) t(i)),
    firsts AS (SELECT m, min({'d': doc_id, 'i': i}) AS f FROM strings GROUP BY m),
    hits AS (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh
             FROM strings JOIN firsts USING (m) WHERE f.d < doc_id OR f.d = doc_id AND f.i < i),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
    pieces AS (SELECT doc_id, a, b, substr(x, 2 * lag(b, 1, 0) OVER w + 1, 2 * (a - lag(b, 1, 0) OVER w)) AS piece
               FROM spans JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
    rest AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM docs LEFT JOIN rest USING (doc_id)
""")
def op10_suffix_array_dedup(spark, folder):
    return suffixes.without_repeated_bytes(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) t(i)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS c FROM docs UNION SELECT b, c FROM reach JOIN both_ways ON a = doc_id WHERE c < b)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
    FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
""")
def op8_near_dedup(spark, folder):
    return neardup.near_duplicates(documents(spark, folder), percent=85)


@query()
def op1_packing(spark, folder):
    return packing.packed(documents(spark, folder)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op6_token_files(spark, folder):
    out = scratch_dir(spark, "token-files")
    tokenfiles.write_token_files(documents(spark, folder), out)
    return tokenfiles.read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op5_quality_classifier(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = classifier.quality_scores(documents(spark, folder), labels)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query()
def op7_nearest_neighbours(spark, folder):
    return ann.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), every=50)


@query()
def op9_lm_scoring(spark, folder):
    return language.scores(documents(spark, folder))


@query(r"""
    WITH RECURSIVE bits AS (SELECT b, k, v FROM (SELECT unnest(range(256)) AS b), (SELECT 0 AS k), LATERAL (SELECT b AS v)
                            UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
    docs AS (
        SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
                       lambda s, c: xor(s >> 8, t[(xor(s, c) & 255) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
        FROM documents, crc),
    leaves AS (
        SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
               sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf, sha256(concat(head, coalesce(strlen(changed) || ':' || changed, '-'))) AS bad
        FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                               coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM docs)),
    low AS (
        SELECT source, n, 0 AS level, pos, leaf AS h FROM leaves
        UNION ALL SELECT source, n, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 3 ** level GROUP BY source, n, level, pos // 3),
    subroots AS (
        SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT source, arg_max(h, level) AS subroot FROM low GROUP BY source)),
    high AS (
        SELECT n, 0 AS level, pos, subroot AS h FROM subroots
        UNION ALL SELECT n, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 3 ** level GROUP BY n, level, pos // 3),
    root AS (SELECT h AS root FROM high ORDER BY level DESC LIMIT 1),
    nodes AS (SELECT source, false AS top, level, pos, h FROM low UNION ALL SELECT NULL, true, level, pos, h FROM high),
    runs AS (SELECT source, top, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL),
    climb AS (
        SELECT doc_id, source, false AS top, 0 AS level, pos, n, bad AS h, '' AS proof FROM leaves
        UNION ALL
        SELECT c.doc_id, c.source, c.top OR c.n <= 3 ** c.level, CASE WHEN c.top OR c.n > 3 ** c.level THEN c.level + 1 ELSE 0 END,
               CASE WHEN c.top OR c.n > 3 ** c.level THEN c.pos // 3 ELSE s.pos END, CASE WHEN c.top OR c.n > 3 ** c.level THEN c.n ELSE s.n END,
               CASE WHEN c.n > 3 ** c.level THEN sha256(array_to_string(r.hs[:c.pos % 3], '') || c.h || array_to_string(r.hs[c.pos % 3 + 2:], '')) ELSE c.h END,
               c.proof || CASE WHEN c.n > 3 ** c.level THEN array_to_string(r.hs[:c.pos % 3], '') || array_to_string(r.hs[c.pos % 3 + 2:], '') ELSE '' END
        FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
        JOIN runs r ON r.top = c.top AND (c.top OR r.source IS NOT DISTINCT FROM c.source) AND r.level = c.level AND r.run = c.pos // 3
        WHERE NOT c.top OR c.n > 3 ** c.level),
    done AS (SELECT * FROM climb WHERE top AND n <= 3 ** level)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source JOIN done USING (doc_id), root
""")
def op13_merkle_manifest(spark, folder):
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    made = merkle.manifest(documents(spark, folder), tampered={"text": F.when(even, cut).otherwise(F.col("text"))})
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.text_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", "verified")


@query()
def op11_whitening(spark, folder):
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query()
def op12_toxicity(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.toxicity_scores(documents(spark, folder), labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
