"""Registered queries: each operator over whole tables, next to SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, functions as F

import maskwright as mw
from maskwright.operators import external, large_text, policy, redact, report, resolve_table
from maskwright.rules import PROFILES, ALWAYS_ON, Detector, Rule, default_rules, profiles_dataframe, rules_for_profile, strict_ipv6 as strict_rules
from maskwright.sources.patterns import read_patterns
from maskwright.sources.scratch import shared_folder
from maskwright.sources.text import spread
from maskwright.streaming import watch, write_back
from suite import oracle, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATTERN_FILE = str(Path(__file__).resolve().with_name("patterns.json"))
RULES = default_rules()
BY_LABEL = {r.label: r for r in RULES}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def source(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the text queries; its table name is replaced by the parquet file."""
    table = re.search(r"FROM (\w+)$", sql).group(1)
    return spark.sql(re.sub(r"FROM \w+$", "FROM {t}", sql), t=spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_out(df: DataFrame, *keys: str) -> DataFrame:
    """Findings under names that are no SQL keywords."""
    return df.select(*keys, F.col("start").alias("span_start"), F.col("end").alias("span_end"), "original", "label")


CORPUS = f"SELECT 'd' || CAST(id AS STRING) AS id, source, text FROM ({texts.DOCUMENTS}) UNION ALL SELECT 'o' || CAST(id AS STRING), source, text FROM ({texts.ORDER_LOG})"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, log = source(spark, sf_dir, texts.DOCUMENTS), source(spark, sf_dir, texts.ORDER_LOG)
    return (docs.select(F.concat(F.lit("d"), "id").alias("id"), "source", "text")
            .unionAll(log.select(F.concat(F.lit("o"), "id").alias("id"), "source", "text")))


# ------------------------------------------------------------------ detection, one query per rule
def _detect(rule: Rule):
    @query(f"detect_{rule.label}", oracle.with_recursive(
        oracle.located(CORPUS, [rule]),
        select="SELECT id, s AS span_start, e AS span_end, txt AS original, lab AS label FROM found"))
    def run(spark, sf_dir):
        return spans_out(mw.raw_findings(corpus(spark, sf_dir), ["id"], "text", [rule]), "id")


for _rule in RULES:
    _detect(_rule)


@query("candidates_by_label", oracle.with_recursive(
    oracle.located(CORPUS, RULES),
    select="SELECT cat AS category, lab AS label, count(*) AS n FROM found GROUP BY ALL"))
def candidates_by_label(spark, sf_dir):
    """All detectors united, before overlaps are resolved."""
    return (mw.raw_findings(corpus(spark, sf_dir), ["id"], "text").groupBy("category", "label")
            .agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ sanitizing
def _sanitize(name: str, sql: str, rules: list[Rule], min_confidence: float = 0.0):
    @query(name, oracle.with_recursive(
        oracle.kept(sql, rules, min_confidence), oracle.clean(), select="SELECT id, clean_text, n AS total_matches FROM clean"))
    def run(spark, sf_dir):
        df = corpus(spark, sf_dir) if sql is CORPUS else source(spark, sf_dir, sql)
        return mw.sanitize(df, "text", rules, min_confidence).select("id", "clean_text", "report.total_matches")


_sanitize("sanitize_documents", texts.DOCUMENTS, RULES)
_sanitize("sanitize_conversations", texts.CONVERSATIONS, RULES)
_sanitize("sanitize_pages", texts.PAGES, RULES)
_sanitize("sanitize_order_log", texts.ORDER_LOG, RULES)
_sanitize("threshold_080", CORPUS, RULES, 0.80)
_sanitize("threshold_095", CORPUS, RULES, 0.95)
for _profile in PROFILES:
    _sanitize(f"profile_{_profile}", CORPUS, rules_for_profile(_profile))
_sanitize("profile_k8s_without_pii", CORPUS, rules_for_profile("k8s", pii=False))


@query("resolved_spans", oracle.with_recursive(
    oracle.kept(CORPUS, RULES),
    select="SELECT id, s AS span_start, e AS span_end, txt AS original, lab AS label FROM kept"))
def resolved_spans(spark, sf_dir):
    return spans_out(report.findings(mw.with_spans(corpus(spark, sf_dir), "text"), ["id"]), "id")


_MARKERS = ", ".join(f"'{r}'" for r in dict.fromkeys(r.replacement for r in RULES))


@query("sanitize_large_files", oracle.with_recursive(
    oracle.kept(texts.ORDER_LOG, RULES), oracle.clean(), f"m AS (SELECT unnest([{_MARKERS}]) AS marker)",
    select="""SELECT marker, CAST(sum((length(clean_text) - length(replace(clean_text, marker, ''))) // length(marker)) AS BIGINT) AS n,
    CAST(sum(length(clean_text) + 1) AS BIGINT) AS n_chars FROM clean, m GROUP BY marker"""))
def sanitize_large_files(spark, sf_dir):
    """The order log as files, masked in ranges: how often each replacement stands in them, and their length."""
    folder = shared_folder(spark, "large-files")
    source(spark, sf_dir, texts.ORDER_LOG).select("text").write.text(folder)
    masked = large_text.mask_large_files(spark, folder)
    counted = masked.select(F.length("clean_text").cast("long").alias("chars"), F.expr(f"""inline(transform(array({_MARKERS}), m -> named_struct(
        'marker', m, 'k', (length(clean_text) - length(replace(clean_text, m, ''))) div length(m))))"""))
    return counted.groupBy("marker").agg(F.sum("k").alias("n"), F.sum("chars").alias("n_chars"))


@query("redact_single_rule", f"""SELECT id, regexp_replace(text, {oracle.quoted(BY_LABEL['ipv4_address'].pattern)},
    '[IP_ADDRESS]', 'g') AS clean_text FROM ({CORPUS})""")
def redact_single_rule(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir), "text", [BY_LABEL["ipv4_address"]]).select("id", "clean_text")


_OVERLAP = ("SELECT o_orderkey AS id, 'url=https://db' || CAST(o_orderkey AS STRING) || '.prod.internal:8443/x host=db'"
            " || CAST(o_orderkey AS STRING) || '.prod.internal http://10.0.0.1/y 10.0.0.1' AS text FROM orders")


@query("overlap_url_host_ip", "SELECT o_orderkey AS id, 'url=[INTERNAL_URL] host=[INTERNAL_HOSTNAME] [INTERNAL_URL]"
       " [IP_ADDRESS]' AS clean_text FROM orders")
def overlap_url_host_ip(spark, sf_dir):
    """A URL wins over the host or address inside it."""
    return mw.sanitize(source(spark, sf_dir, _OVERLAP)).select("id", "clean_text")


@query("dry_run", f"SELECT id, text AS clean_text, length(text) AS n_chars FROM ({CORPUS})")
def dry_run(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir), dry_run=True).select(
        "id", "clean_text", F.length("clean_text").cast("bigint").alias("n_chars"))


@query("sql_function", oracle.with_recursive(
    oracle.kept(CORPUS, rules_for_profile("k8s")), oracle.clean(),
    select="SELECT source, count(*) AS n_docs, CAST(sum(length(clean_text)) AS BIGINT) AS n_chars FROM clean GROUP BY source"))
def sql_function(spark, sf_dir):
    """Masking called from SQL."""
    mw.register_sql(spark, rules_for_profile("k8s"), name="mask_k8s")
    return spark.sql("SELECT source, count(*) AS n_docs, sum(length(mask_k8s(text))) AS n_chars FROM {t} GROUP BY source",
                     t=corpus(spark, sf_dir))


# ------------------------------------------------------------------ user rules and detectors
CUSTOM = [Rule("custom", "order_ref", r"order \d+", "[ORDER]", 0.75, 10), Rule("custom", "role", r"role/r\d+", "[CUSTOM]", 1.0, 10),
          Rule("custom", "custom", r"(?i)BEARER [0-9a-f]{6}", "[CUSTOM]", 1.0, 10)]


@query("custom_rules", oracle.with_recursive(
    oracle.kept(texts.ORDER_LOG, default_rules(CUSTOM)), oracle.clean(),
    select="SELECT id, clean_text, n AS total_matches FROM clean"))
def custom_rules(spark, sf_dir):
    """User rules from a pattern file, next to the built-in ones."""
    rules = default_rules(read_patterns(spark, f"file://{PATTERN_FILE}"))
    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text", rules).select(
        "id", "clean_text", "report.total_matches")


@query("custom_rules_python_engine", f"""SELECT id, regexp_replace(text, '(?P<word>order|password)[ =](?P<rest>[a-z0-9]+)',
    '[X]', 'g') AS clean_text FROM ({texts.ORDER_LOG})""")
def custom_rules_python_engine(spark, sf_dir):
    """A pattern in Python-only syntax."""
    rule = Rule("custom", "named", r"(?P<word>order|password)[ =](?P<rest>[a-z0-9]+)", "[X]", 1.0, 10)
    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text", [rule]).select("id", "clean_text")


@query("custom_rules_long_repeats", "SELECT doc_id AS id, '[X]' || repeat('bc', CAST(500 + doc_id % 3 AS BIGINT)) || doc_id AS clean_text FROM documents")
def custom_rules_long_repeats(spark, sf_dir):
    """A repeated group that would overflow the Java matcher."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), F.expr("concat(repeat('bc', int(9500 + doc_id % 3)), doc_id)").alias("text"))
    return mw.sanitize(docs, "text", [Rule("custom", "long", "(?:a|bc){9000}", "[X]", 1.0, 10)]).select("id", "clean_text")


@query("sanitize_invalid_utf8", "SELECT doc_id AS id, repeat(chr(65533) || 'ab ', 20) || doc_id || ' [REDACTED] and a tail that stays' || chr(65533) AS clean_text FROM documents")
def sanitize_invalid_utf8(spark, sf_dir):
    """Truncated characters before a secret do not move the mask."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.expr("""concat(
        repeat(concat(CAST(unhex('E2') AS STRING), 'ab '), 20), doc_id, ' password=hunter2secret and a tail that stays',
        CAST(unhex('F09F98') AS STRING))""").alias("text"))
    return mw.sanitize(docs).select("id", "clean_text")


_ITEM = "'item ' || lpad(CAST(p_partkey AS STRING), 7, '0')"
_ITEM_LINES = """SELECT l_orderkey * 10 + l_linenumber AS id, 'ship item ' || lpad(CAST(l_partkey AS STRING), 7, '0') || 'b of item '
    || lpad(CAST(l_suppkey AS STRING), 7, '0') || '; ITEM 0000001, item 9999999x, host=db' || CAST(l_suppkey AS STRING) || '.corp' AS text FROM lineitem"""


@query("custom_rules_many", """
    WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 9 THEN '[P9]' ELSE '[P' || p_partkey % 10 || ']' END AS r FROM part)
    SELECT l_orderkey * 10 + l_linenumber AS id, 'ship ' || a.r || CASE WHEN l_partkey % 10 = 9 THEN 'b' ELSE '' END || ' of ' || coalesce(b.r, 'item ' || lpad(CAST(l_suppkey AS STRING), 7, '0'))
        || '; ITEM 0000001, item 9999999x, host=[INTERNAL_HOSTNAME]' AS clean_text,
        CAST(2 + (b.r IS NOT NULL)::INT AS INT) AS total_matches
    FROM lineitem JOIN p a ON a.k = l_partkey LEFT JOIN p b ON b.k = l_suppkey""")
def custom_rules_many(spark, sf_dir):
    """A rule for every part, as a table, beside the built-in ones; every tenth needs Python's matcher."""
    number = F.col("p_partkey") % 10
    rules = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_ord"), F.expr(f"if(p_partkey % 10 = 9, '(?P<item>' || {_ITEM} || ')', {_ITEM} || '[a-z]?')").alias("pattern"),
        F.concat(F.lit("[P"), number, F.lit("]")).alias("replacement"), F.concat(F.lit("part_"), number).alias("label"))
    out = mw.sanitize(source(spark, sf_dir, _ITEM_LINES), "text", [*default_rules(), mw.RuleTable.of(spark, rules)])
    return out.select("id", "clean_text", F.col("report.total_matches").cast("int").alias("total_matches"))


_V6 = """SELECT o_orderkey AS id, 'at 14:32:' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ' from 2001:db8::' || CAST(o_orderkey % 10000 AS STRING)
    || ', ::ffff:10.0.' || CAST(o_custkey % 256 AS STRING) || '.1 and fe80:0:0:0:1:2:3:4:5, a::b::c or ' || substr(md5(CAST(o_orderkey AS STRING)), 1, 4) || ':1:2:3:4:5:6:7' AS text FROM orders"""


@query("strict_ipv6", """SELECT o_orderkey AS id, 'at 14:32:' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')
    || ' from [IP_ADDRESS], [IP_ADDRESS] and fe80:0:0:0:1:2:3:4:5, a::b::c or [IP_ADDRESS]' AS clean_text FROM orders""")
def strict_ipv6(spark, sf_dir):
    """Only whole, valid IPv6 addresses; clock times stay."""
    return mw.sanitize(source(spark, sf_dir, _V6), "text", strict_rules(rules_for_profile("network", pii=False))).select("id", "clean_text")


@query("resolved_findings", oracle.with_recursive(
    oracle.kept(CORPUS, RULES),
    select="SELECT id, s AS span_start, e AS span_end, txt AS original, lab AS label FROM kept"))
def resolved_findings(spark, sf_dir):
    """Overlaps resolved in the findings table, not in the rows of texts."""
    found = mw.raw_findings(corpus(spark, sf_dir), ["id"], "text", rank=True)
    return spans_out(resolve_table.resolve_findings(found, ["id"], "rank"), "id")


@query("replacement_is_literal", f"SELECT id, replace(text, 'order ', '$1\\0{{x}} ') AS clean_text FROM ({texts.ORDER_LOG})")
def replacement_is_literal(spark, sf_dir):
    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text",
                       [Rule("custom", "literal", "order ", "$1\\0{x} ", 1.0, 10)]).select("id", "clean_text")


@query("zero_length_matches", f"""SELECT id, '[LINE]' || replace(text, chr(10), chr(10) || '[LINE]') AS clean_text
    FROM ({texts.ORDER_LOG})""")
def zero_length_matches(spark, sf_dir):
    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text",
                       [Rule("custom", "line", r"(?m)^", "[LINE]", 1.0, 10)]).select("id", "clean_text")


@query("user_detector", f"""SELECT id, '[HEAD]' || substr(text, 6) AS clean_text FROM ({texts.ORDER_LOG})""")
def user_detector(spark, sf_dir):
    """A detector given as a Column function; of its two overlapping spans the surer one wins."""
    def column(text):
        def span(end, label, replacement, confidence):
            return F.struct(F.lit(0).alias("start"), F.lit(end).alias("end"), F.substring(text, 1, end).alias("original"),
                            F.lit(replacement).alias("replacement"), F.lit("test").alias("category"),
                            F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        return F.array(span(10, "wide", "[WIDE]", 0.7), span(5, "head", "[HEAD]", 1.0))
    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text", [Detector("test", column, 1)]).select("id", "clean_text")


@query("analyzer_detector", f"""SELECT id, CASE length(regexp_extract(text, '^order [0-9]+')) % 3
    WHEN 0 THEN regexp_replace(text, '^order [0-9]+', '[PERSON]') WHEN 1 THEN regexp_replace(text, '^order [0-9]+', '[WEIRD_ENTITY]')
    ELSE text END AS clean_text FROM ({texts.ORDER_LOG})""")
def analyzer_detector(spark, sf_dir):
    """An analyzer object made once per Python worker; addresses are left to the network rules."""
    class OrderAnalyzer:  # local, so that it travels to the workers by value
        def analyze(self, text, language):
            kinds = ("PERSON", "WEIRD_ENTITY", "IP_ADDRESS")
            return [SimpleNamespace(entity_type=kinds[len(m.group()) % 3], start=m.start(), end=m.end(), score=0.8)
                    for m in re.finditer(r"^order \d+", text)]

    return mw.sanitize(source(spark, sf_dir, texts.ORDER_LOG), "text", [external.analyzer(OrderAnalyzer)]).select("id", "clean_text")


# ------------------------------------------------------------------ entities and dictionaries
_ENTITY = "CASE id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'WEIRD_ENTITY' WHEN 2 THEN 'IP_ADDRESS' ELSE 'US_SSN' END"


@query("external_entities", f"""SELECT id, CASE id % 4 WHEN 0 THEN '[PERSON]' WHEN 1 THEN '[WEIRD_ENTITY]' WHEN 2 THEN 'order'
    ELSE '[SSN]' END || substr(text, 6) AS clean_text FROM ({texts.ORDER_LOG})""")
def external_entities(spark, sf_dir):
    """An entity table found elsewhere, joined by key."""
    log = source(spark, sf_dir, texts.ORDER_LOG)
    entities = log.select("id", F.expr(_ENTITY).alias("entity_type"), F.lit(0).alias("start"), F.lit(5).alias("end"),
                          F.lit(0.85).alias("score"))
    with_found = external.attach_entities(log, "id", "text", entities)
    none = [Rule("custom", "none", "no such text", "", 1.0, 10)]
    return mw.sanitize(with_found, "text", none, external="external").select("id", "clean_text")


@query("dictionary_locations", """
    WITH t AS (SELECT c_custkey AS id, 'ship to ' || n_name || ', ' || r_name || '; bill ' || n_name AS text, n_name, r_name
               FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT id, 'LOCATION' AS entity_type, 8 AS span_start, 8 + length(n_name) AS span_end FROM t
    UNION ALL SELECT id, 'LOCATION', 10 + length(n_name), 10 + length(n_name) + length(r_name) FROM t
    UNION ALL SELECT id, 'LOCATION', 17 + length(n_name) + length(r_name), length(text) FROM t""")
def dictionary_locations(spark, sf_dir):
    """Places from the nation and region tables, found by a phrase join."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = (table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("c_custkey").alias("id"), F.expr(
                  "'ship to ' || n_name || ', ' || r_name || '; bill ' || n_name").alias("text")))
    terms = nation.select("n_name").unionAll(region.select("r_name"))
    found = external.dictionary_entities(placed, "id", "text", terms, "LOCATION")
    return found.select("id", "entity_type", F.col("start").cast("bigint").alias("span_start"),
                        F.col("end").cast("bigint").alias("span_end"))


@query("dictionary_persons_masked", """SELECT l_orderkey * 10 + l_linenumber AS id,
    'call [PERSON] about 10' || ' or mail [EMAIL]' AS clean_text FROM lineitem""")
def dictionary_persons_masked(spark, sf_dir):
    """Names of several words from the supplier table, masked together with rule findings."""
    lines = spread(table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), "l_suppkey"), by="id").select(
        "id", F.expr("'call supplier#' || lpad(l_suppkey, 9, '0') || ' about 10 or mail a@b.org'").alias("text"))
    found = external.dictionary_entities(lines, "id", "text", table(spark, sf_dir, "supplier").select("s_name"), "PERSON")
    with_found = external.attach_entities(lines, "id", "text", found)
    return mw.sanitize(with_found, "text", external="external").select("id", "clean_text")


_CALLS = """SELECT o_orderkey AS id, 'call CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' or Customer#' || lpad(CAST(o_orderkey AS STRING), 9, '0')
    || ' on supplier#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS text FROM orders"""


@query("dictionary_many_names", """
    WITH t AS (SELECT o_orderkey AS id, 'customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS a, 'customer#' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS b,
                   'supplier#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS c FROM orders),
         n AS (SELECT lower(c_name) AS n FROM customer UNION SELECT lower(s_name) FROM supplier),
         f AS (SELECT id, a AS x, 5 AS span_start FROM t UNION ALL SELECT id, b, 27 FROM t UNION ALL SELECT id, c, 49 FROM t)
    SELECT id, CAST(span_start AS BIGINT) AS span_start, CAST(span_start + length(x) AS BIGINT) AS span_end FROM f JOIN n ON x = n""")
def dictionary_many_names(spark, sf_dir):
    """All customers and suppliers by name; phrases meet the names behind a Bloom filter."""
    names = table(spark, sf_dir, "customer").select("c_name").unionAll(table(spark, sf_dir, "supplier").select("s_name"))
    found = external.dictionary_entities(source(spark, sf_dir, _CALLS), "id", "text", names, "PERSON", few=0)
    return found.select("id", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"))


# ------------------------------------------------------------------ reports
_KEPT = oracle.kept(CORPUS, RULES)


@query("report_by_label", oracle.with_recursive(
    _KEPT, select="SELECT cat AS category, lab AS label, count(*) AS n FROM kept GROUP BY ALL"))
def report_by_label(spark, sf_dir):
    return report.label_counts(mw.with_spans(corpus(spark, sf_dir), "text"))


@query("report_by_source_category", oracle.with_recursive(
    _KEPT, select="SELECT source, cat AS category, count(*) AS n FROM kept JOIN docs USING (id) GROUP BY ALL"))
def report_by_source_category(spark, sf_dir):
    return (report.label_counts(mw.with_spans(corpus(spark, sf_dir), "text"), ["source"])
            .groupBy("source", "category").agg(F.sum("n").alias("n")))


@query("rollup_source", oracle.with_recursive(
    _KEPT, select="""SELECT source, cat AS category, lab AS label, count(*) AS n_spans, count(DISTINCT id) AS n_docs
    FROM kept JOIN docs USING (id) GROUP BY GROUPING SETS ((source, cat, lab), (source, cat), (source))"""))
def rollup_source(spark, sf_dir):
    return report.rollup(mw.with_spans(corpus(spark, sf_dir), "text"), ["source"])


@query("report_per_text", oracle.with_recursive(_KEPT, oracle.clean(), """
    labels AS (SELECT id, string_agg(lab || '=' || c, ',' ORDER BY lab) AS by_label
               FROM (SELECT id, lab, count(*) AS c FROM kept GROUP BY ALL) GROUP BY id),
    cats AS (SELECT id, string_agg(cat || '=' || c, ',' ORDER BY cat) AS by_category
             FROM (SELECT id, cat, count(*) AS c FROM kept GROUP BY ALL) GROUP BY id)""",
    select="""SELECT id, n AS total_matches, n = 0 AS is_clean, coalesce(by_label, '') AS by_label,
    coalesce(by_category, '') AS by_category FROM clean LEFT JOIN labels USING (id) LEFT JOIN cats USING (id)"""))
def report_per_text(spark, sf_dir):
    def flat(c):
        return F.expr(f"array_join(transform(array_sort(map_entries(report.{c})), e -> concat(e.key, '=', e.value)), ',')").alias(c)
    return mw.sanitize(corpus(spark, sf_dir)).select(
        "id", "report.total_matches", "report.is_clean", flat("by_label"), flat("by_category"))


def _line(prefix: str, empty: str, some: str) -> str:
    return oracle.with_recursive(_KEPT, oracle.clean(), """
    labels AS (SELECT id, string_agg(lab || '=' || c, ', ' ORDER BY lab) AS by_label
               FROM (SELECT id, lab, count(*) AS c FROM kept GROUP BY ALL) GROUP BY id)""",
        select=f"""SELECT id, CASE WHEN n = 0 THEN '{prefix}{empty}' ELSE '{prefix}{some.split('N')[0]}' || n
        || '{some.split('N')[1]}' || by_label END AS message FROM clean LEFT JOIN labels USING (id)""")


@query("summary_line", _line("", "No sensitive content detected.", "Detected N sensitive value(s): "))
def summary_line(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir)).select("id", report.summary().alias("message"))


@query("summary_line_dry_run", _line("Dry run: ", "No sensitive content detected.", "Detected N sensitive value(s): "))
def summary_line_dry_run(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir), dry_run=True).select("id", report.summary(dry_run=True).alias("message"))


@query("masked_message", _line("", "Clipboard is clean — nothing was masked.", "Masked N value(s): "))
def masked_message(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir)).select("id", report.masked_message().alias("message"))


@query("table_totals", oracle.with_recursive(_KEPT, oracle.clean(), select="""SELECT count(*) AS n_docs,
    CAST(sum(n) AS BIGINT) AS total_matches, count(*) FILTER (n = 0) AS n_clean FROM clean"""))
def table_totals(spark, sf_dir):
    return report.totals(mw.with_spans(corpus(spark, sf_dir), "text"))


@query("dirtiest_documents", oracle.with_recursive(_KEPT, oracle.clean(), select=
       "SELECT id, n AS total_matches FROM clean ORDER BY n DESC, id LIMIT 20"))
def dirtiest_documents(spark, sf_dir):
    return report.dirtiest(mw.with_spans(corpus(spark, sf_dir), "text"), "id", 20)


@query("clean_documents", oracle.with_recursive(_KEPT, select="SELECT id, source FROM docs ANTI JOIN kept USING (id)"))
def clean_documents(spark, sf_dir):
    return mw.with_spans(corpus(spark, sf_dir), "text").where(F.size("spans") == 0).select("id", "source")


@query("profile_coverage", oracle.with_recursive(
    oracle.located(CORPUS, RULES),
    f"p(profile, category) AS (VALUES {', '.join(repr((p, c)) for p, cs in PROFILES.items() for c in (*cs, *ALWAYS_ON))})",
    select="SELECT profile, count(*) AS n FROM found JOIN p ON cat = category GROUP BY profile"))
def profile_coverage(spark, sf_dir):
    """Spans each profile would look at."""
    found = mw.raw_findings(corpus(spark, sf_dir), ["id"], "text").groupBy("category").agg(F.count("*").alias("n"))
    return found.join(profiles_dataframe(spark), "category").groupBy("profile").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ documented extensions
@query("style_redact", oracle.with_recursive(_KEPT, oracle.clean("'[REDACTED]'"), select="SELECT id, clean_text FROM clean"))
def style_redact(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir), style="redact").select("id", "clean_text")


@query("style_fake", oracle.with_recursive(_KEPT, oracle.clean(
    "(substr(txt, 1, 4) || repeat('X', length(txt) - 4))"), select="SELECT id, clean_text FROM clean"))
def style_fake(spark, sf_dir):
    return mw.sanitize(corpus(spark, sf_dir), style="fake").select("id", "clean_text")


_NETWORK = rules_for_profile("network")


@query("change_review", oracle.with_recursive(
    oracle.kept(texts.ORDER_LOG, _NETWORK), oracle.clean(), """
    b AS (SELECT id, unnest(string_split(text, chr(10))) AS before, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM clean),
    a AS (SELECT id, unnest(string_split(clean_text, chr(10))) AS after, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM clean)""",
    select="SELECT id, line_no, before, after FROM b JOIN a USING (id, line_no) WHERE before <> after"))
def change_review(spark, sf_dir):
    masked = mw.with_spans(source(spark, sf_dir, texts.ORDER_LOG), "text", _NETWORK)
    return redact.line_changes(masked, ["id"], "text").withColumn("line_no", F.col("line_no").cast("bigint"))


_POLICIES = [("src0", "aws", 0.0), ("src1", "network", 0.9), ("src2", "K8S", 0.0), ("src3", None, 0.95)]


@query("policy_per_source", oracle.with_recursive(
    oracle.located(CORPUS, RULES),
    "pol(source, profile, floor) AS (VALUES ('src0', 'aws', 0.0), ('src1', 'network', 0.9), ('src2', 'k8s', 0.0), ('src3', NULL, 0.95))",
    f"pc(profile, cat) AS (VALUES {', '.join(repr((p, c)) for p, cs in PROFILES.items() for c in (*cs, *ALWAYS_ON))})",
    """allowed AS (SELECT f.* FROM found f JOIN docs d USING (id) LEFT JOIN pol USING (source)
        WHERE f.conf >= coalesce(pol.floor, 0) AND (pol.profile IS NULL OR EXISTS (
          SELECT 1 FROM pc WHERE pc.profile = pol.profile AND pc.cat = f.cat)))""",
    oracle.walk("allowed"), oracle.clean(), select="SELECT id, clean_text FROM clean"))
def policy_per_source(spark, sf_dir):
    policies = spark.createDataFrame(_POLICIES, "source STRING, profile STRING, min_confidence DOUBLE")
    return policy.sanitize_by_policy(corpus(spark, sf_dir), "text", "source", policies).select("id", "clean_text")


@query("audit_log", oracle.with_recursive(
    _KEPT, select="""SELECT id, s AS span_start, e AS span_end, sha256(txt) AS original_sha256, rep AS replacement, cat AS category,
    lab AS label, conf AS confidence FROM kept"""))
def audit_log(spark, sf_dir):
    return policy.audit_log(mw.with_spans(corpus(spark, sf_dir), "text"), ["id"]).withColumnsRenamed(
        {"start": "span_start", "end": "span_end"})


#: A key for checking; it stands in the plan. Pads of its block for the SQL.
_KEY = b"a key for checks"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("audit_log_keyed", oracle.with_recursive(
    _KEPT, select=f"""SELECT id, s AS span_start, e AS span_end, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(txt)))) AS original_hmac,
    rep AS replacement, cat AS category, lab AS label, conf AS confidence FROM kept"""))
def audit_log_keyed(spark, sf_dir):
    return policy.audit_log(mw.with_spans(corpus(spark, sf_dir), "text"), ["id"], key=_KEY).withColumnsRenamed(
        {"start": "span_start", "end": "span_end"})


# ------------------------------------------------------------------ change detection
_CLEAN_EVENT = """CASE WHEN text LIKE 'password=secret%' OR text = 'password=[IP_ADDRESS]' THEN '[REDACTED]'
    WHEN text = 'password=10.0.0.1' THEN 'password=[IP_ADDRESS]' WHEN text LIKE 'ip 10.%' THEN 'ip [IP_ADDRESS]' ELSE text END"""
_LOOP = f"""WITH RECURSIVE ev AS (
      SELECT session, seq, text, {_CLEAN_EVENT} AS clean_text, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn
      FROM ({texts.EVENT_TEXTS})),
    run AS (
      SELECT session, CAST(0 AS BIGINT) AS rn, '' AS last, false AS processed FROM (SELECT DISTINCT session FROM ev)
      UNION ALL
      SELECT ev.session, ev.rn, CASE WHEN ev.text <> '' AND ev.text <> run.last THEN ev.clean_text ELSE ev.text END,
             ev.text <> '' AND ev.text <> run.last
      FROM run JOIN ev ON ev.session = run.session AND ev.rn = run.rn + 1),
    done AS (SELECT ev.*, processed, processed AND clean_text <> text AS masked FROM ev JOIN run USING (session, rn))"""
_EVENT_RULES = rules_for_profile("k8s", pii=False)


@query("change_detection", f"{_LOOP} SELECT session, seq, clean_text, processed, masked FROM done")
def change_detection(spark, sf_dir):
    """Sanitize on change; the hot session is cut into buckets."""
    events = source(spark, sf_dir, texts.EVENT_TEXTS)
    return watch.watch_table(events, "session", "seq", "text", _EVENT_RULES, bucket_width=1000).select(
        "session", "seq", "clean_text", "processed", "masked")


@query("masked_events", f"{_LOOP} SELECT session, seq, text, clean_text FROM done WHERE masked")
def masked_events(spark, sf_dir):
    """Only what has to be written back."""
    events = source(spark, sf_dir, texts.EVENT_TEXTS)
    return watch.watch_table(events, "session", "seq", "text", _EVENT_RULES, bucket_width=1000).where("masked").select(
        "session", "seq", "text", "clean_text")


@query("watched_sessions", f"{_LOOP} SELECT session, seq, clean_text FROM done WHERE masked AND session % 2 = 0")
def watched_sessions(spark, sf_dir):
    """Watch mode is on for some sessions only, by a settings table."""
    events = source(spark, sf_dir, texts.EVENT_TEXTS)
    settings = events.select("session").distinct().withColumn("watch_mode", F.col("session") % 2 == 0)
    out = watch.watch_table(watch.watched(events, settings, "session"), "session", "seq", "text", _EVENT_RULES, bucket_width=1000)
    return out.where("masked").select("session", "seq", "clean_text")


@query("on_demand", f"SELECT session, seq, {_CLEAN_EVENT} AS clean_text FROM ({texts.EVENT_TEXTS}) WHERE text <> ''")
def on_demand(spark, sf_dir):
    return watch.on_demand(source(spark, sf_dir, texts.EVENT_TEXTS), "text", _EVENT_RULES).select("session", "seq", "clean_text")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(re.sub(r"FROM \w+$", "FROM {t}", texts.EVENT_TEXTS), t=raw)


@query("stream_sanitize", f"{_LOOP} SELECT session, seq, text, clean_text FROM done WHERE masked")
def stream_sanitize(spark, sf_dir):
    """The event table as a stream through the stateful watcher into files."""
    out = shared_folder(spark, "stream")
    stream = watch.watch_stream(_event_stream(spark, sf_dir), "session", "seq", "text", _EVENT_RULES)
    watch.start_watch(stream, f"{out}/data", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("session", "seq", "text", "clean_text")


@query("stream_stateless", f"SELECT session, seq, {_CLEAN_EVENT} AS clean_text FROM ({texts.EVENT_TEXTS})")
def stream_stateless(spark, sf_dir):
    out = shared_folder(spark, "stream")
    stream = mw.sanitize(_event_stream(spark, sf_dir), "text", _EVENT_RULES).select("session", "seq", "clean_text")
    watch.start_watch(stream, f"{out}/data", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("session", "seq", "clean_text")


_BY_DAY = """SELECT CAST(day AS VARCHAR) AS day, label, count(*) AS n FROM (
    SELECT CAST(ts AS DATE) AS day, CASE WHEN text LIKE 'ip 10.%' THEN 'ipv4_address' ELSE 'password' END AS label
    FROM (SELECT ts, CASE event_id % 4 WHEN 0 THEN 'password=secret' || CAST(user_id AS STRING) WHEN 1 THEN 'ip 10.0.0.' || CAST(user_id % 256 AS STRING)
          WHEN 2 THEN event_type ELSE 'pwd=x' END AS text FROM events) WHERE text LIKE 'ip 10.%' OR text LIKE 'p%wd=%' OR text LIKE 'password=%') GROUP BY ALL"""


def _timed_events(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("""CASE event_id % 4 WHEN 0 THEN 'password=secret' || user_id
        WHEN 1 THEN 'ip 10.0.0.' || (user_id % 256) WHEN 2 THEN event_type ELSE 'pwd=x' END""").alias("text"))


@query("masked_by_day", _BY_DAY)
def masked_by_day(spark, sf_dir):
    """Masked values by day of the event and label."""
    counted = write_back.masked_by_window(_timed_events(table(spark, sf_dir, "events")), "ts", "text", _EVENT_RULES)
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "label", "n")


@query("stream_write_back", f"SELECT session, seq, {_CLEAN_EVENT} AS clean_text FROM ({texts.EVENT_TEXTS})")
def stream_write_back(spark, sf_dir):
    """The event table as a stream, written batch by batch with a ledger."""
    out = shared_folder(spark, "stream")
    stream = mw.sanitize(_event_stream(spark, sf_dir), "text", _EVENT_RULES).select("session", "seq", "clean_text")
    write_back.start_write_back(stream, out, f"{out}/checkpoint", available_now=True).awaitTermination()
    return write_back.written(spark, out).select("session", "seq", "clean_text")
