"""Queries of the document-analytics operators and the SQL they are checked against.

The SQL restates each operator for a second engine over the same tables; patterns
and word lists are taken from the operators' tables so that both sides read the
same fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lab, legal, rollups, vectors
from ..session import table
from ..sources import files, sinks

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
q = tx.quoted
BS = chr(92)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def _n_present(low: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda p: contains({low}, p)))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _match(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def _ladder(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_match(x, p)} THEN {q(v)}" for p, v in rules) + f" ELSE {default} END"


# ---- text functions -------------------------------------------------------------------------------------------------
def _chain_query(name: str, rules: tx.Rules) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "ocr_results").select("ocr_id", tx.cleaned(F.col("text"), rules).alias("cleaned"))

    f.__name__ = f"text_{name}"
    f.__doc__ = f"The clean-up chain {name} over all scanned texts."
    query(f"SELECT ocr_id, {tx.as_sql('text', rules)} AS cleaned FROM ocr_results")(f)


for _name, _rules in tx.CHAINS.items():
    _chain_query(_name, _rules)


@query(r"""SELECT ocr_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS sentences FROM ocr_results""")
def text_sentences(spark, d):
    """Sentences of every scanned text."""
    return table(spark, d, "ocr_results").select("ocr_id", tx.sentences(F.col("text")).alias("sentences"))


@query(r"""
WITH t AS (SELECT ocr_id, text, len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) AS h, len(regexp_extract_all(text, '[\p{L}\p{N}_]')) AS n FROM ocr_results)
SELECT ocr_id, CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 'unknown' WHEN h / n > 0.3 THEN 'hindi' WHEN h / n > 0.1 THEN 'hindi-english' ELSE 'english' END AS script,
  len(regexp_extract_all(text, '\S+')) AS words FROM t""")
def text_script(spark, d):
    """Language by script, and words, of every scanned text."""
    return table(spark, d, "ocr_results").select("ocr_id", tx.script_language(F.col("text")).alias("script"), tx.word_count(F.col("text")).cast("long").alias("words"))


@query(r"""
WITH l AS (SELECT ocr_id, unnest(string_split(text, chr(10))) AS line FROM ocr_results),
f AS (SELECT *, length(line) AS n, len(regexp_extract_all(line, '\p{L}')) AS letters, len(regexp_extract_all(line, '[^\p{L}\p{N} .,;:''"\-()]')) AS odd FROM l)
SELECT ocr_id, count(*) AS n_lines, count(*) FILTER (WHERE n = 0 OR letters < n * 0.3 OR n < 10 OR NOT (regexp_matches(lower(line), 'xz|qx|zx|jq|vx') OR odd > n * 0.15 OR regexp_matches(' ' || lower(line) || ' ', ' [qxz] '))) AS n_clean
FROM f GROUP BY ocr_id""")
def text_clean_lines(spark, d):
    """Lines of each scanned text that need no correction."""
    lines = table(spark, d, "ocr_results").select("ocr_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("ocr_id").agg(F.count("*").alias("n_lines"), F.count_if(tx.line_is_clean(F.col("line"))).alias("n_clean"))


@query(f"""
WITH t AS (SELECT ocr_id, text AS b, {tx.as_sql("text", tx.STANDARD)} AS a FROM ocr_results WHERE text IS NOT NULL)
SELECT ocr_id, len(regexp_extract_all(b, '\\S+')) AS words_before, len(regexp_extract_all(a, '\\S+')) AS words_after, length(b) AS chars_before, length(a) AS chars_after,
  CASE WHEN length(b) > 0 THEN round((1 - length(a) / length(b)) * 100, 1) ELSE 0.0 END AS reduction FROM t""")
def text_correction_stats(spark, d):
    """What the standard clean-up changed in each scanned text."""
    t = table(spark, d, "ocr_results").where("text is not null")
    s = t.select("ocr_id", tx.correction_stats(F.col("text"), tx.cleaned(F.col("text"), tx.STANDARD)).alias("s"))
    return s.select("ocr_id", F.col("s.words_before").cast("long").alias("words_before"), F.col("s.words_after").cast("long").alias("words_after"), F.col("s.chars_before").cast("long").alias("chars_before"), F.col("s.chars_after").cast("long").alias("chars_after"), "s.reduction")


@query()
def text_ascii(spark, d):
    """Documents decomposed and reduced to ASCII."""
    return table(spark, d, "documents").select("doc_id", tx.ascii_only(F.col("text")).alias("ascii"))


@query()
def text_without_garbage(spark, d):
    """Scanned texts without runs of special characters and unlikely consonants."""
    return table(spark, d, "ocr_results").select("ocr_id", tx.without_garbage(F.col("text")).alias("cleaned"))


# ---- classification, clauses, risk ------------------------------------------------------------------------------------
@query(f"""
WITH c AS (SELECT doc_id, {_n_present("lower(text)", legal.LEGAL_INDICATORS)} AS l, {_n_present("lower(text)", legal.MEDICAL_INDICATORS)} AS m FROM documents)
SELECT doc_id, CASE WHEN l > m THEN 'legal' WHEN m > l THEN 'medical' ELSE 'unknown' END AS document_type, l AS n_legal, m AS n_medical FROM c""")
def classify_document_type(spark, d):
    """Type of each document by the indicators present."""
    low = F.lower("text")
    return table(spark, d, "documents").select(
        "doc_id", legal.document_type(F.col("text")).alias("document_type"), legal.n_present(low, legal.LEGAL_INDICATORS).cast("long").alias("n_legal"), legal.n_present(low, legal.MEDICAL_INDICATORS).cast("long").alias("n_medical")
    )


def _score(weights: dict[float, str]) -> str:
    one = lambda k: f"(length(lower(text)) - length(replace(lower(text), {q(k)}, ''))) / {len(k)}" if "/" in k else f"len(regexp_extract_all(lower(text), {q(chr(92) + 'b' + k + chr(92) + 'b')}))"
    return " + ".join(f"{w} * least({one(k)}, 5)" for w, ks in weights.items() for k in ks.split("|"))


_DOMAIN = f"""
WITH s AS (SELECT doc_id, {_score(legal.LEGAL_WEIGHTS)} AS a, {_score(legal.MEDICAL_WEIGHTS)} AS b FROM documents),
n AS (SELECT doc_id, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS l, CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5 END AS m FROM s)
SELECT doc_id, CASE WHEN m > l + 0.1 THEN 'medical' WHEN l > m + 0.1 THEN 'legal' ELSE 'unknown' END AS domain, round(l, 6) AS legal_score, round(m, 6) AS medical_score,
  CASE WHEN l > m THEN '[LEGAL]' ELSE '[MEDICAL]' END AS token FROM n"""


@query(_DOMAIN)
def classify_domain(spark, d):
    """Domain of each document by weighted keywords, and the marker it gets."""
    t = table(spark, d, "documents").select("doc_id", legal.keyword_score(F.col("text"), legal.LEGAL_WEIGHTS).alias("a"), legal.keyword_score(F.col("text"), legal.MEDICAL_WEIGHTS).alias("b"))
    j = t.select("doc_id", legal.judged_domain(F.col("a"), F.col("b")).alias("d"))
    return j.select("doc_id", "d.domain", F.round("d.legal_score", 6).alias("legal_score"), F.round("d.medical_score", 6).alias("medical_score"), legal.domain_token(F.col("d")).alias("token"))


@query(f"""
WITH d AS ({_DOMAIN}) SELECT d.domain, lower(coalesce(t.document_type, 'unknown')) AS expected, count(*) AS n, count(*) FILTER (WHERE d.domain = lower(coalesce(t.document_type, 'unknown'))) AS agreeing
FROM d JOIN documents t USING (doc_id) GROUP BY ALL""")
def classify_domain_check(spark, d):
    """Detected against stated domain."""
    t = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("document_type", F.lit("unknown"))).alias("expected"))
    return classify_domain(spark, d).join(t, "doc_id").groupBy("domain", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("domain") == F.col("expected")).alias("agreeing"))


def _filler(x: str) -> str:
    low = f"lower({_strip(x)})"
    clean = f"regexp_replace({low}, '[\\s\\n]+', ' ', 'g')"
    words = f"list_filter(regexp_extract_all({low}, '[a-z]+'), lambda w: length(w) > 2)"
    found = " OR ".join(_match(clean, f"(?i){p}") for p in legal.FILLER)
    verb = " OR ".join(_match(low, p) for p in legal.VERBS)
    labels = f"len(list_filter({words}, lambda w: list_contains({_list(legal.LABEL_WORDS)}, w)))"
    return f"(length({clean}) < 50 OR len({words}) < 8 OR {found} OR {labels} / len({words}) > 0.5 OR (NOT ({verb}) AND len({words}) < 20))"


@query(f"SELECT clause_id, {_filler('content')} AS filler FROM clauses")
def clause_filler(spark, d):
    """Whether each clause is filler."""
    return table(spark, d, "clauses").select("clause_id", legal.is_filler(F.col("content")).alias("filler"))


_W = legal.RISK_WORDS
_HIT = {k: f"list_filter({_list(v)}, lambda p: contains(lower(content), p))" for k, v in _W.items()}
_RISK = f"CASE WHEN len({_HIT['high']}) > 0 THEN 'high' WHEN len({_HIT['medium']}) > 0 THEN 'medium' WHEN len({_HIT['low']}) > 0 THEN 'low' ELSE 'none' END"


@query(f"SELECT clause_id, {_RISK} AS level, CASE WHEN len({_HIT['high']}) > 0 THEN ({_HIT['high']})[1:1] ELSE list_concat({_HIT['medium']}, {_HIT['low']}) END AS keywords FROM clauses WHERE content IS NOT NULL")
def clause_risk(spark, d):
    """Risk of each clause by its words."""
    return table(spark, d, "clauses").where("content is not null").select("clause_id", legal.clause_risk(F.col("content")).alias("r")).select("clause_id", "r.level", "r.keywords")


_SIX = "list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')[1:6]"


@query(f"""SELECT clause_id, {_ladder("lower(content)", legal.TYPES, "'general'")} AS clause_type,
  {_ladder("lower(content)", legal.TITLES, f"array_to_string({_SIX}, ' ') || CASE WHEN len({_SIX}) = 6 THEN '...' ELSE '' END")} AS title FROM clauses WHERE content IS NOT NULL""")
def clause_type_title(spark, d):
    """Type and title of each clause by what it says."""
    c = F.col("content")
    return table(spark, d, "clauses").where("content is not null").select("clause_id", legal.clause_type(c).alias("clause_type"), legal.clause_title(c).alias("title"))


_LEGAL_RISK = f"""
WITH t AS (SELECT clause_id, doc_id, lower(content) AS x FROM clauses WHERE content IS NOT NULL),
n AS (SELECT *, try_cast(regexp_extract(x, 'forfeit.*?(\\d+)\\s*%', 1) AS BIGINT) AS pct, try_cast(regexp_extract(x, '(\\d+)\\s*month.*?(?:rent|penalty)', 1) AS BIGINT) AS months,
  try_cast(regexp_extract(x, '(\\d+)\\s*days?\\s*(?:notice|prior)', 1) AS BIGINT) AS days, {_n_present("x", legal.CRITICAL_PHRASES)} > 0 AS harsh, {_n_present("x", legal.HIGH_PHRASES)} > 0 AS heavy,
  {_n_present("x", legal.PROTECTIONS)} > 0 AS safe FROM t),
i AS (SELECT *, 2 * harsh::int + 2 * coalesce(pct >= 100, false)::int AS c, heavy::int + coalesce(pct >= 50 AND pct < 100, false)::int + coalesce(months >= 3, false)::int + coalesce(days <= 7, false)::int AS h0,
  coalesce(months = 2, false)::int + coalesce(days > 7 AND days <= 14, false)::int AS m FROM n),
l AS (SELECT *, CASE WHEN safe THEN greatest(h0 - 1, 0) ELSE h0 END AS h FROM i),
r AS (SELECT *, CASE WHEN c >= 2 THEN 'critical' WHEN h >= 2 THEN 'high' WHEN h >= 1 OR m >= 1 THEN 'medium' ELSE 'low' END AS level,
  list_filter([CASE WHEN harsh THEN 'Extreme penalties or complete rights waiver' END, CASE WHEN heavy THEN 'Short notice or heavy penalties' END,
    CASE WHEN pct >= 100 THEN 'Tenant must forfeit ' || pct || '% of deposit' WHEN pct >= 50 THEN 'Tenant may forfeit ' || pct || '% of deposit' END,
    CASE WHEN months >= 3 THEN months || ' months penalty' END, CASE WHEN days <= 7 THEN 'Only ' || days || ' days notice required' END], lambda x: x IS NOT NULL) AS points FROM l)
SELECT clause_id, doc_id, level, CASE level WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END AS score, array_to_string(points[1:3], '; ') AS explanation FROM r"""


@query(_LEGAL_RISK)
def clause_legal_risk(spark, d):
    """Risk, score and explanation of each clause by its terms."""
    t = table(spark, d, "clauses").where("content is not null")
    return t.select("clause_id", "doc_id", legal.legal_risk(F.col("content")).alias("r")).select("clause_id", "doc_id", "r.level", "r.score", "r.explanation")


@query(f"""
WITH r AS ({_LEGAL_RISK}), g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE level = 'critical') AS c, count(*) FILTER (WHERE level = 'high') AS h, count(*) FILTER (WHERE level = 'medium') AS m, avg(score) AS s FROM r GROUP BY doc_id)
SELECT doc_id, n AS total, c AS critical, h AS high, m AS medium, round(s, 6) AS mean_score,
  CASE WHEN c > 0 THEN 'critical' WHEN h >= 2 THEN 'high' WHEN h >= 1 OR m >= 3 THEN 'medium' WHEN m >= 1 THEN 'low' ELSE 'none' END AS by_counts,
  CASE WHEN c > 0 OR h >= 2 THEN 'critical' WHEN h > 0 OR m >= 3 THEN 'high' WHEN m > 0 THEN 'medium' ELSE 'low' END AS by_strict,
  CASE WHEN s >= 0.7 THEN 'critical' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.3 THEN 'medium' WHEN s >= 0.1 THEN 'low' ELSE 'none' END AS by_mean FROM g""")
def document_risk(spark, d):
    """Risk of each document by the three policies."""
    r = clause_legal_risk(spark, d)
    g = rollups.risk_histogram(r, "doc_id", "level").join(r.groupBy("doc_id").agg(F.avg("score").alias("s")), "doc_id")
    counts = {k: F.col(k) for k in rollups.LEVELS}
    return g.select(
        "doc_id", "total", "critical", "high", "medium", F.round("s", 6).alias("mean_score"), legal.document_risk(counts).alias("by_counts"), legal.document_risk(counts, policy="strict").alias("by_strict"),
        legal.document_risk(mean=F.col("s"), policy="mean").alias("by_mean"),
    )


@query(f"SELECT clause_id, round(pow(1.15, {_n_present('lower(content)', legal.BOOSTS['critical'][1])}), 6) AS critical, round(pow(1.1, {_n_present('lower(content)', legal.BOOSTS['high'][1])}), 6) AS high FROM clauses WHERE content IS NOT NULL")
def clause_risk_boost(spark, d):
    """Factors by which words of a clause raise its risk."""
    return table(spark, d, "clauses").where("content is not null").select("clause_id", legal.risk_boost(F.col("content")).alias("b")).select("clause_id", "b.critical", "b.high")


def _missing(p: str, g: int = 0) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(original, ''), {q(p)}, {g})), lambda x: NOT list_contains(regexp_extract_all(coalesce(simplified, ''), {q(p)}, {g}), x)))"


def _periods(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '(?i)\\b\\d+\\s*(?:day|month|year|week)s?\\b'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '(?i)s$', '')))"


@query(f"""
WITH e AS (SELECT result_id, list_filter({_missing(r"\b\d+(?:\.\d+)?\b")}, lambda n: length(n) >= 2 OR contains(n, '.')) AS n, {_missing(r"(?i)(?:rs\.?|₹|inr)\s*([\d,]+)", 1)} AS m,
  {_missing(r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b")} AS t, len(list_filter({_periods("original")}, lambda x: NOT list_contains({_periods("simplified")}, x))) > 0 AS periods FROM clause_results)
SELECT result_id, array_to_string(n[1:3], ', ') AS numbers, array_to_string(m[1:3], ', ') AS money, array_to_string(t[1:2], ', ') AS dates, periods, len(n) = 0 AND len(m) = 0 AND len(t) = 0 AND NOT periods AS preserved FROM e""")
def simplification_entities(spark, d):
    """Numbers, amounts, dates and periods of a clause that its simplification lost."""
    e = table(spark, d, "clause_results").select("result_id", legal.entity_check(F.col("original"), F.col("simplified")).alias("e"))
    return e.select("result_id", "e.*")


def _all(p: str, pre: str, post: str) -> str:
    return f"list_transform(regexp_extract_all(original, {q(p)}, 1), lambda x: {q(pre)} || x || {q(post)})"


_TERMS = [(r"(?i)(?:rs\.?|₹|inr)\s*([0-9,]+)", "₹", ""), (r"(?i)([0-9,]+)\s*(?:rupees|rs)", "₹", ""), (r"(?i)(\d+)\s*(?:month|months)", "", " months"), (r"(?i)(\d+)\s*(?:day|days)", "", " days"), (r"(?i)(\d+)\s*(?:year|years)", "", " years"), (r"(\d+(?:\.\d+)?)\s*%", "", "%")]


@query(f"""
WITH a AS (SELECT result_id, flatten([{", ".join(_all(*t) for t in _TERMS)}]) AS a FROM clause_results WHERE original IS NOT NULL)
SELECT result_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:8] AS key_terms FROM a""")
def clause_key_terms(spark, d):
    """Amounts, periods and percentages of each clause, at most eight."""
    return table(spark, d, "clause_results").where("original is not null").select("result_id", legal.key_terms(F.col("original")).alias("key_terms"))


@query()
def law_references(spark, d):
    """Laws cited in each clause, the citation with a year preferred (lazy patterns: checked on a fixture)."""
    return legal.law_references(table(spark, d, "clauses"), "clause_id", "content")


_SECTION_OF = "CASE WHEN s = '' THEN NULL " + " ".join(f"WHEN {_match('s', '(?i)' + p)} THEN {q(k)}" for p, k, _ in legal.SECTIONS) + " WHEN upper(s) = s AND lower(s) <> s AND length(s) > 5 AND length(s) < 100 AND NOT regexp_matches(substring(s, 1, 5), '\\d') THEN 'header' END"
_KINDS = {k: t for _, k, t in legal.SECTIONS} | {"header": "header"}
_SECTIONS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, {_strip("content")} AS s FROM l), k AS (SELECT *, {_SECTION_OF} AS t FROM m),
n AS (SELECT *, count(t) OVER (PARTITION BY doc_id ORDER BY line) AS section_no FROM k)
SELECT doc_id, section_no, arg_min(t, line) AS section_type, CASE arg_min(t, line) {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _KINDS.items())} END AS clause_type,
  min(line) + 1 AS start_line, max(line) + 1 AS end_line, substring(arg_min(s, line), 1, 100) AS title, {_strip("string_agg(content, chr(10) ORDER BY line)")} AS content FROM n WHERE section_no > 0 GROUP BY doc_id, section_no"""


@query(_SECTIONS)
def document_sections(spark, d):
    """The sections of each document."""
    s = legal.sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", "section_no", "section_type", "clause_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "title", "content")


@query()
def document_clauses(spark, d):
    """The clauses of each document: sections, the long ones by sentences, without filler."""
    return legal.segment(table(spark, d, "documents"), "doc_id", "text")


_SENT = "string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""
WITH s AS (SELECT clause_id, unnest({_SENT}) AS raw, generate_subscripts({_SENT}, 1) AS p FROM clauses WHERE content IS NOT NULL),
c AS (SELECT clause_id, p, {_strip("raw")} AS content FROM s), k AS (SELECT * FROM c WHERE length(content) > 30 AND NOT {_filler("content")})
SELECT clause_id, row_number() OVER (PARTITION BY clause_id ORDER BY p) AS clause_no, {_ladder("lower(content)", legal.TYPES, "'general'")} AS clause_type, {_RISK} AS risk_level, content FROM k""")
def logical_clauses(spark, d):
    """Each meaningful sentence of a clause as a clause of its own."""
    return legal.logical_clauses(table(spark, d, "clauses"), ["clause_id"], "content").drop("title").withColumn("clause_no", F.col("clause_no").cast("long"))


# ---- laboratory -------------------------------------------------------------------------------------------------------
def _flag_sql(value: str, low: str, high: str, test: str) -> str:
    lows = " ".join(f"WHEN {q(t)} THEN {a}" for t, (a, _) in lab.CRITICAL.items() if a is not None)
    highs = " ".join(f"WHEN {q(t)} THEN {b}" for t, (_, b) in lab.CRITICAL.items() if b is not None)
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'unknown' WHEN {value} < CASE {test} {lows} END THEN 'critical_low' WHEN {value} > CASE {test} {highs} END THEN 'critical_high' WHEN {value} < {low} THEN 'low' WHEN {value} > {high} THEN 'high' WHEN {low} IS NOT NULL OR {high} IS NOT NULL THEN 'normal' ELSE 'unknown' END"


# RE2 knows word boundaries of ASCII only: letters of any script are spelled out
_MARK = "CASE WHEN raw_text IS NULL THEN 'unknown' " + " ".join(f"WHEN {_match('upper(raw_text)', p.replace(BS + 'b(', '(^|[^' + BS + 'p{L}' + BS + 'p{N}_])(').replace(')' + BS + 'b', ')($|[^' + BS + 'p{L}' + BS + 'p{N}_])'))} THEN {q(v)}" for p, v in lab.FLAG_MARKS) + " ELSE 'unknown' END"


@query(f"SELECT result_id, {_flag_sql('value', 'ref_low', 'ref_high', 'test_name_standardized')} AS calculated, {_MARK} AS printed FROM test_results")
def lab_flags(spark, d):
    """Calculated and printed flag of each result."""
    t = table(spark, d, "test_results")
    return t.select("result_id", lab.calculated_flag(F.col("value"), F.col("ref_low"), F.col("ref_high"), F.col("test_name_standardized")).alias("calculated"), lab.printed_flag(F.col("raw_text")).alias("printed"))


@query(f"""
WITH t AS (SELECT result_id, {_match("reference_range", lab.RANGES[0])} AS two, regexp_extract(reference_range, {q(lab.RANGES[0])}, 1) AS a, regexp_extract(reference_range, {q(lab.RANGES[0])}, 2) AS b,
  regexp_extract(reference_range, {q(lab.RANGES[1])}, 1) AS s, regexp_extract(reference_range, {q(lab.RANGES[1])}, 2) AS v FROM test_results WHERE reference_range IS NOT NULL)
SELECT result_id, CASE WHEN two THEN try_cast(a AS DOUBLE) WHEN s IN ('>', '≥') THEN try_cast(v AS DOUBLE) END AS low, CASE WHEN two THEN try_cast(b AS DOUBLE) WHEN s IN ('<', '≤') THEN try_cast(v AS DOUBLE) END AS high FROM t""")
def lab_reference_ranges(spark, d):
    """Reference range of each result as numbers."""
    t = table(spark, d, "test_results").where("reference_range is not null").select("result_id", lab.reference_range(F.col("reference_range")).alias("r"))
    return t.select("result_id", "r.low", "r.high")


@query()
def lab_lines(spark, d):
    """Results read from the lines of the scanned texts."""
    return lab.parse_lines(table(spark, d, "ocr_results"), "ocr_id", "text", lab.names_of(table(spark, d, "lab_units")))


@query(f"""
WITH f AS (SELECT report_id, {_flag_sql("value", "ref_low", "ref_high", "test_name_standardized")} AS flag FROM test_results)
SELECT report_id, count(*) AS total_tests, count(*) FILTER (WHERE flag IN ('low', 'high', 'critical_low', 'critical_high')) AS abnormal_count, count(*) FILTER (WHERE flag IN ('critical_low', 'critical_high')) AS critical_count FROM f GROUP BY report_id""")
def lab_report_counts(spark, d):
    """Tests, abnormal and critical ones of each report."""
    t = table(spark, d, "test_results")
    return lab.report_counts(t.withColumn("flag", lab.calculated_flag(F.col("value"), F.col("ref_low"), F.col("ref_high"), F.col("test_name_standardized"))), "report_id")


_ALIASES = """a AS (SELECT lower(alias) AS alias, standard, row_number() OVER (ORDER BY standard, p) AS ord FROM
  (SELECT test_name_standardized AS standard, unnest(list_concat([test_name_standardized], coalesce(aliases, []))) AS alias, generate_subscripts(list_concat([test_name_standardized], coalesce(aliases, [])), 1) AS p FROM lab_units) WHERE alias IS NOT NULL)"""


@query(f"""
WITH {_ALIASES}, n AS (SELECT DISTINCT lower(test_name) AS n FROM test_results WHERE test_name IS NOT NULL),
e AS (SELECT n, arg_min(standard, ord) AS s FROM n JOIN a ON n = alias GROUP BY n), x AS (SELECT n.n, arg_min(standard, ord) AS s FROM n JOIN a ON contains(n.n, alias) OR contains(alias, n.n) GROUP BY n.n)
SELECT n.n AS test_name, coalesce(e.s, x.s) AS standard FROM n LEFT JOIN e ON e.n = n.n LEFT JOIN x ON x.n = n.n""")
def lab_standard_names(spark, d):
    """Standard name of each spelling of a test."""
    names = table(spark, d, "test_results").where("test_name is not null").select(F.lower("test_name").alias("_n")).distinct()
    return lab.standard_names(names, lab.names_of(table(spark, d, "lab_units"))).select(F.col("_n").alias("test_name"), "standard")


@query("""
WITH l AS (SELECT row_id, report_id, row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC, row_id DESC) AS rn FROM medical_reports)
SELECT l.report_id, l.row_id, count(t.result_id) AS n_results FROM l LEFT JOIN test_results t ON t.report_id = l.report_id WHERE rn = 1 GROUP BY ALL""")
def lab_latest_reports(spark, d):
    """The last delivery of each report with the number of its results, reports without any included."""
    latest = rollups.first_by(table(spark, d, "medical_reports").select("report_id", "row_id", "received_at"), ["report_id"], F.desc("received_at"), F.desc("row_id"))
    n = table(spark, d, "test_results").groupBy("report_id").agg(F.count("*").alias("n"))
    return latest.join(n, "report_id", "left").select("report_id", "row_id", F.coalesce("n", F.lit(0)).alias("n_results"))


# ---- roll-ups, windows, top-k -----------------------------------------------------------------------------------------
@query("""SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE lower(risk_level) = 'critical') AS critical, count(*) FILTER (WHERE lower(risk_level) = 'high') AS high, count(*) FILTER (WHERE lower(risk_level) = 'medium') AS medium,
  count(*) FILTER (WHERE lower(risk_level) = 'low') AS low, count(*) FILTER (WHERE lower(risk_level) = 'none') AS none FROM clauses GROUP BY doc_id""")
def clause_risk_histogram(spark, d):
    """Clauses of each document by stated risk."""
    return rollups.risk_histogram(table(spark, d, "clauses"), "doc_id", "risk_level")


@query("""SELECT method, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL) AS succeeded, count(*) FILTER (WHERE text IS NULL) AS failed, coalesce(sum(word_count), 0) AS words, round(coalesce(sum(confidence), 0.0), 6) AS seconds, round(avg(confidence), 6) AS mean_seconds
FROM ocr_results GROUP BY method""")
def batch_by_method(spark, d):
    """Batch of scans by extraction method (confidence stands for the time, which scans lack)."""
    return rollups.batch_summary(table(spark, d, "ocr_results"), "method", F.col("text").isNotNull(), F.col("word_count").cast("long"), F.col("confidence"))


@query("""SELECT document_type AS method, count(*) AS n, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failed, count(clauses) AS words, round(coalesce(sum(processing_time), 0.0), 6) AS seconds,
  round(avg(processing_time), 6) AS mean_seconds FROM processing_results GROUP BY document_type""")
def batch_by_type(spark, d):
    """Batch of processed documents by type."""
    t = table(spark, d, "processing_results").withColumn("method", F.col("document_type"))
    return rollups.batch_summary(t, "method", F.col("success"), F.col("clauses").isNotNull().cast("long"), F.col("processing_time"))


@query("""SELECT test_name_standardized AS test, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(stddev_pop(value) / nullif(avg(value), 0), 6) AS variation, round(median(value), 6) AS median FROM test_results GROUP BY 1""")
def value_variation(spark, d):
    """Mean, deviation, variation and median of each test's values."""
    return rollups.variation(table(spark, d, "test_results").withColumnRenamed("test_name_standardized", "test"), "test", "value")


@query("""
WITH w AS (SELECT lower(unnest(regexp_extract_all(content, '[A-Za-z]{4,}'))) AS word, clause_type FROM clauses WHERE content IS NOT NULL), c AS (SELECT clause_type, word, count(*) AS n FROM w GROUP BY ALL)
SELECT clause_type, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY clause_type ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5""")
def top_words(spark, d):
    """The five most frequent words of each clause type."""
    w = table(spark, d, "clauses").where("content is not null").select("clause_type", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    n = w.groupBy("clause_type", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return rollups.top_by(n, ["clause_type"], 5, F.desc("n"), F.col("word")).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT clause_id, doc_id, id, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY id, clause_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM clauses""")
def clause_offsets(spark, d):
    """Where each clause would begin in its document, by the lengths before it."""
    t = table(spark, d, "clauses").select("clause_id", "doc_id", "id", "content")
    w = Window.partitionBy("doc_id").orderBy("id", "clause_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("clause_id", "doc_id", "id", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)).alias("offset"))


@query("""
WITH n AS (SELECT clause_id, doc_id, count(*) FILTER (WHERE risk_level = 'high') OVER (PARTITION BY doc_id ORDER BY clause_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, coalesce(risk_level = 'high', false) AS w FROM clauses)
SELECT clause_id, doc_id, w AND k <= 3 AS taken FROM n""")
def high_risk_quota(spark, d):
    """The first three high-risk clauses of each document."""
    return rollups.quota(table(spark, d, "clauses").select("clause_id", "doc_id", "risk_level"), "doc_id", "clause_id", F.col("risk_level") == "high", 3).select("clause_id", "doc_id", "taken")


@query("""
WITH g AS (SELECT doc_id, count(*) FILTER (WHERE lower(risk_level) IN ('high', 'critical')) AS n, bool_or(contains(lower(coalesce(content, '')), 'forfeit') AND contains(lower(coalesce(content, '')), 'deposit')) AS f, bool_or(contains(lower(coalesce(content, '')), 'without notice')) AS s FROM clauses GROUP BY doc_id),
m AS (SELECT doc_id, list_filter([CASE WHEN n > 0 THEN n || ' high-risk clauses need review' END, CASE WHEN f THEN 'The deposit may be forfeited' END, CASE WHEN s THEN 'The agreement may end without notice' END], lambda x: x IS NOT NULL) AS m FROM g)
SELECT doc_id, CASE WHEN len(m) > 0 THEN array_to_string(m, '; ') ELSE 'No special concerns' END AS messages FROM m""")
def document_recommendations(spark, d):
    """Advice on each document from its clauses."""
    return rollups.recommendations(table(spark, d, "clauses"), "doc_id", "content", "risk_level")


@query("""SELECT clause_id, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY clause_id) AS rn FROM clauses) WHERE rn = 1""")
def clauses_first(spark, d):
    """The first delivery of each clause of a document."""
    return rollups.first_by(table(spark, d, "clauses"), ["doc_id", "id"], F.col("clause_id")).select("clause_id", "content")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE flag = c) AS correct, round(avg((coalesce(flag = c, false))::int), 6) AS accuracy FROM (SELECT lower(flag) AS flag, " + _flag_sql("value", "ref_low", "ref_high", "test_name_standardized") + " AS c FROM test_results)")
def flag_agreement(spark, d):
    """How often stated flags agree with calculated ones."""
    t = table(spark, d, "test_results")
    return rollups.agreement(t, F.lower("flag"), lab.calculated_flag(F.col("value"), F.col("ref_low"), F.col("ref_high"), F.col("test_name_standardized")))


@query("SELECT c.doc_id, c.clause_id FROM clauses c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id AND d.document_type = 'legal')")
def clauses_of_legal_documents(spark, d):
    """Semi-join: clauses of legal documents."""
    return table(spark, d, "clauses").join(table(spark, d, "documents").where("document_type = 'legal'"), "doc_id", "left_semi").select("doc_id", "clause_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.doc_id = d.doc_id)")
def documents_without_clauses(spark, d):
    """Anti-join: documents without a clause."""
    return table(spark, d, "documents").join(table(spark, d, "clauses").select("doc_id"), "doc_id", "left_anti").select("doc_id")


# ---- vectors ------------------------------------------------------------------------------------------------------------
_CENTROIDS = """c AS (SELECT label, list(m ORDER BY p) AS centroid FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL) GROUP BY label)"""


@query(f"WITH {_CENTROIDS} SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM c")
def label_centroids(spark, d):
    """Mean embedding of each label."""
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, c)
SELECT vec_id, arg_max(label, s) AS label, round(max(s), 6) AS similarity FROM s GROUP BY vec_id""")
def nearest_centroid(spark, d):
    """The label whose centroid is most similar to each embedding."""
    e = table(spark, d, "embeddings")
    b = vectors.best_prototype(e.select("vec_id", "embedding"), "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", "centroid", least=-1.0)
    return b.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""
WITH p AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
f AS (SELECT vec_id, label, CASE WHEN prev IS NULL OR list_cosine_similarity(prev::DOUBLE[], embedding::DOUBLE[]) <= 0.3 THEN 1 ELSE 0 END AS s FROM p)
SELECT vec_id, label, sum(s) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS island FROM f""")
def embedding_islands(spark, d):
    """Neighbouring embeddings of a label merged while similar."""
    return vectors.islands(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3).select("vec_id", "label", "island")


# ---- sources and sinks ---------------------------------------------------------------------------------------------------
def _ext(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN lower(string_split({x}, '.')[-1]) ELSE '' END"


@query(f"""WITH n AS (SELECT ocr_id, document_name || '.' || coalesce(method, '') AS name FROM ocr_results), e AS (SELECT ocr_id, {_ext("name")} AS ext FROM n)
SELECT ocr_id, CASE ext {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in files.KINDS.items())} ELSE 'unknown' END AS kind, ext IN ({", ".join(map(q, files.ALLOWED))}) AS allowed FROM e""")
def input_kinds(spark, d):
    """Kind of input by extension, and whether it is accepted."""
    name = F.concat("document_name", F.lit("."), F.coalesce("method", F.lit("")))
    return table(spark, d, "ocr_results").select("ocr_id", files.input_kind(name).alias("kind"), files.is_allowed(name).alias("allowed"))


@query("""
WITH r AS (SELECT report_id, list([test_name, value_raw] ORDER BY result_id) AS rows FROM test_results WHERE test_name IS NOT NULL AND value_raw IS NOT NULL GROUP BY report_id)
SELECT report_id, '| test | value |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) AS markdown,
  'test | value' || chr(10) || array_to_string(list_transform(rows, lambda x: array_to_string(x, ' | ')), chr(10)) AS plain FROM r""")
def report_tables(spark, d):
    """Results of each report as a markdown and a plain table."""
    t = table(spark, d, "test_results").where("test_name is not null and value_raw is not null")
    g = t.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("result_id", "test_name", "value_raw"))), lambda x: F.array(x["test_name"], x["value_raw"])).alias("rows"))
    head = F.array(F.lit("test"), F.lit("value"))
    return g.select("report_id", sinks.as_markdown(head, F.col("rows")).alias("markdown"), sinks.as_plain(head, F.col("rows")).alias("plain"))


@query()
def legal_responses(spark, d):
    """The JSON response of each document with its clauses and their number."""
    c = table(spark, d, "clauses").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "clause_id", "clause_type", "title", "risk_level"))).alias("clauses"))
    return c.select("doc_id", sinks.legal_response(F.col("doc_id"), F.lit("legal"), F.col("clauses"), F.struct(F.size("clauses").alias("total_clauses"))).alias("response"))
