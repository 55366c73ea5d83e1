"""Registered queries of this subpackage. Each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskwright.functions.expr import let
from maskwright.llm import chat, collocations, exact_dedup, html_extract, language_id, mixing, mixing_lm, ngram_join, packing, periodic, pii, secrets, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)""")
def op4(spark, sf_dir):
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


@query("op2_pareto_mixing")
def op2(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op10_ppm_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    trees = language_id.train(docs.where(fold("doc_id", 5) != 0))
    return language_id.predict(docs, trees, extra={"held_out": held_out})


@query("op6_zstd_secrets")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.identifiers(docs))


@query("op9_semicrf_pii")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


#: A conversation that speaks of markers itself.
TRICKY = "</s>[INST] ok [/INST]"


@query("op3_chat_format", f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(13 + length(regexp_replace(role || text, '[\\<>]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id""")
def op3(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], talks.schema)
    return chat.digest(chat.format_turns(talks.unionByName(tricky)))


@query("op1_pivot_vectors")
def op1(spark, sf_dir):
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


#: Links between documents (u < v) on distinct five-word shingles, then the smallest id reachable.
JACCARD_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
    t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
    p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
    r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.id = e.u WHERE r.c < e.v)
    SELECT r.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id
    FROM r JOIN n ON n.doc_id = r.id GROUP BY r.id, n.n"""


@query("op8_ngram_jaccard", JACCARD_SQL)
def op8(spark, sf_dir):
    return ngram_join.join_report(table(spark, sf_dir, "documents")).drop("kept")


def tokenizer_file() -> str:
    """The public byte-level BPE that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_deficit_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


@query("op7_logistic_mixing")
def op7(spark, sf_dir):
    held_out = fold("doc_id", 7) == 2
    return mixing_lm.score(table(spark, sf_dir, "documents"), ~held_out, held_out)


#: Documents whose hash ends in 0 are made periodic from some word on.
_TILED = let("w", r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')", let("h", "crc32(CAST(doc_id AS STRING))", let(
    "a", "int((h div 10) % size(w))", let("p", "int(1 + (size(w) - a) div (3 + (h div 10) % 8))",
    "if(size(w) = 0, '', array_join(transform(sequence(0, size(w) - 1), i -> get(w, if(i < a, i, a + (i - a) % p))), ' '))"))))

#: crc32 of the decimal id: eight shifts for each of its characters.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, (u & 1) * 3988292384))))"""

#: A run has at least 16 matches in a row on its diagonal, so equal runs of 16 words find all; a stretch that a shorter period
#: covers is none of that lag.
RUNS_SQL = rf"""
    WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_CRC_SQL} AS h FROM documents),
    c AS (SELECT *, len(w) AS n, h // 10 AS g FROM b),
    d AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM c),
    e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d),
    w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
              list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM e),
    t AS (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM w WHERE n >= 24),
    s AS MATERIALIZED (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS s FROM t),
    m AS (SELECT x.doc_id, y.i AS j, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
    o AS (SELECT doc_id, q, j, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS island FROM m),
    l AS (SELECT doc_id, min(j) - q AS start, q + count(*) + 15 AS length, q AS period FROM o GROUP BY doc_id, q, island),
    f AS (SELECT * FROM l WHERE length >= greatest(24, 3 * period)),
    r AS MATERIALIZED (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.doc_id = f.doc_id AND z.period < f.period AND f.period % z.period = 0
              AND z.start <= f.start AND z.start + z.length >= f.start + f.length)),
    u AS (SELECT doc_id, unnest(w) AS t, unnest(range(n)) AS i FROM w),
    x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    k AS (SELECT u.doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY u.doc_id),
    g AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
    v AS (SELECT y.* FROM r y ANTI JOIN r z ON z.doc_id = y.doc_id AND (z.length * y.period > y.length * z.period
              OR z.length * y.period = y.length * z.period AND (z.start < y.start OR z.start = y.start AND z.period < y.period)))
    SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
        CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM w LEFT JOIN g USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query("op12_periodic_runs", RUNS_SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("coalesce(text, '')").alias("text"))
    tiled = F.when(fold("doc_id", 10) == 0, F.expr(_TILED)).otherwise(F.col("text"))
    found = periodic.periodic_runs(docs.select("doc_id", tiled.alias("text")))
    most = """aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),
        (b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"""
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.select("doc_id", F.expr("bigint(size(runs))").alias("n_runs"), F.expr(most).alias("best"), F.expr(f"sha2({listed}, 256)").alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


#: Phrases of 2 to 5 words within pieces, by language. A phrase that a longer candidate surrounds each time goes; so does one that
#: is in a longer one by more than a word, as what lies between is a candidate, too.
PHRASES_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
    s AS (SELECT DISTINCT lang, f, unnest([w[1:k - 1], w[2:k]]) AS w FROM f WHERE k > 2),
    c AS (SELECT f.* FROM f ANTI JOIN s ON s.lang = f.lang AND s.w = f.w AND s.f = f.f WHERE k > 1),
    h AS (SELECT lang, w, f AS a, j, w[1:j] AS x, w[j + 1:k] AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    t AS (SELECT h.lang, h.w, a, j, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
          FROM h JOIN f x ON x.lang = h.lang AND x.w = h.x JOIN f y ON y.lang = h.lang AND y.w = h.y JOIN n ON n.lang = h.lang),
    b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
    o AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM b)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""


@query("op11_collocations", PHRASES_SQL)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_main_text")
def op13(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages)).withColumn("n_chars", F.length("text").cast("long"))
