"""Queries of the medical, lexicon, grouping and pipeline operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import explain, grouping, lab, legal, lexicon, medical, pipelines, rollups, vectors
from ..session import table
from .registry import _CENTROIDS, _LEGAL_RISK, _flag_sql, _list, _n_present, _score, _strip, q

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_V = ", ".join(f"try_cast(regexp_extract(x, {q(p)}, 1) AS DOUBLE) AS v{i}" for i, (p, *_) in enumerate(medical.VALUES))
_OFF = [f"CASE WHEN v{i} < {a} THEN ({a} - v{i}) / {a} WHEN v{i} > {b} THEN (v{i} - {b}) / {b} ELSE 0.0 END" for i, (_, a, b, _n) in enumerate(medical.VALUES)]


@query(f"""
WITH t AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL), v AS (SELECT *, {_V} FROM t),
o AS (SELECT *, ({_n_present("x", medical.DANGER)} > 0)::int + {" + ".join(f"(({o}) > 0.5)::int" for o in _OFF)} + regexp_matches(x, 'stage\\s*[34]')::int AS c, {" + ".join(f"(({o}) > 0.2 AND ({o}) <= 0.5)::int" for o in _OFF)} AS h FROM v)
SELECT doc_id, CASE WHEN c >= 1 THEN 'critical' WHEN h >= 1 THEN 'high' ELSE 'low' END AS level, CASE WHEN c >= 1 THEN 0.95 WHEN h >= 1 THEN 0.75 ELSE 0.25 END AS score FROM o""")
def medical_risk(spark: SparkSession, d: str) -> DataFrame:
    """Medical risk of each document by words and values."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", medical.medical_risk(F.col("text")).alias("r")).select("doc_id", "r.level", "r.score")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """Typical bounds as general ranges, a quarter wider as critical ones; women's lower bound a tenth lower."""
    u = table(spark, d, "lab_units").where("typical_low is not null").select(F.col("test_name_standardized").alias("test"), "typical_low", "typical_high")
    row = lambda sex, f: u.select("test", F.lit(sex).alias("sex"), (F.col("typical_low") * f).alias("low"), F.col("typical_high").alias("high"), (F.col("typical_low") * 0.5).alias("critical_low"), (F.col("typical_high") * 1.5).alias("critical_high"))
    return row("general", 1.0).unionByName(row("female", 0.9))


_SEX = "CASE lower(trim(patient_gender)) WHEN 'male' THEN 'male' WHEN 'm' THEN 'male' WHEN 'female' THEN 'female' WHEN 'f' THEN 'female' ELSE 'general' END"


@query(f"""
WITH r AS (SELECT test_name_standardized AS test, 'general' AS sex, typical_low AS low, typical_high AS high, typical_low * 0.5 AS cl, typical_high * 1.5 AS ch FROM lab_units WHERE typical_low IS NOT NULL
  UNION ALL SELECT test_name_standardized, 'female', typical_low * 0.9, typical_high, typical_low * 0.5, typical_high * 1.5 FROM lab_units WHERE typical_low IS NOT NULL),
p AS (SELECT report_id, {_SEX} AS sex FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC, row_id DESC) AS rn FROM medical_reports) WHERE rn = 1),
j AS (SELECT t.result_id, t.value AS v, coalesce(o.low, g.low) AS lo, coalesce(o.high, g.high) AS hi, coalesce(o.cl, g.cl) AS cl, coalesce(o.ch, g.ch) AS ch FROM test_results t LEFT JOIN p USING (report_id)
  LEFT JOIN r o ON o.test = t.test_name_standardized AND o.sex = coalesce(p.sex, 'general') LEFT JOIN r g ON g.test = t.test_name_standardized AND g.sex = 'general'),
k AS (SELECT *, CASE WHEN v < lo THEN (lo - v) / lo * 100 WHEN v > hi THEN (v - hi) / hi * 100 ELSE 0.0 END AS off FROM j)
SELECT result_id, CASE WHEN v IS NULL OR lo IS NULL OR hi IS NULL THEN 'unknown' WHEN v < cl OR v > ch THEN 'critical' WHEN v BETWEEN lo AND hi THEN 'normal' WHEN off > 50 THEN 'high' WHEN off > 25 THEN 'moderate' ELSE 'mild' END AS level,
  CASE WHEN v IS NULL OR lo IS NULL OR hi IS NULL THEN 0.0 ELSE round(off, 6) END AS deviation FROM k""")
def lab_abnormality(spark, d):
    """Abnormality of each result against the range of its test and the patient's sex."""
    p = rollups.first_by(table(spark, d, "medical_reports").select("report_id", "row_id", "received_at", "patient_gender"), ["report_id"], F.desc("received_at"), F.desc("row_id")).select("report_id", "patient_gender")
    t = table(spark, d, "test_results").select("result_id", "report_id", "test_name_standardized", "value").join(p, "report_id", "left")
    return medical.assess(t, _ranges(spark, d), "test_name_standardized", "value", "patient_gender").select("result_id", "level", "deviation")


def _first(x: str, ps: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {q(p)}, 1), '')" for p in ps) + ")"


@query(f"""
WITH p AS (SELECT ocr_id, {_first("text", medical.AGE_PATTERNS)} AS age, lower(regexp_extract(text, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(male|female|m|f)($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])', 2)) AS g, {_first("text", medical.DATE_PATTERNS)} AS date FROM ocr_results WHERE text IS NOT NULL)
SELECT ocr_id, age, CASE WHEN g IN ('m', 'male') THEN 'male' WHEN g <> '' THEN 'female' END AS gender, date FROM p""")
def patient_details(spark, d):
    """Age, sex and date as they stand first in each scanned text."""
    p = table(spark, d, "ocr_results").where("text is not null").select("ocr_id", medical.patient_details(F.col("text")).alias("p"))
    return p.select("ocr_id", "p.age", "p.gender", "p.date")


@query(r"""
WITH l AS (SELECT ocr_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM ocr_results WHERE text IS NOT NULL)
SELECT ocr_id, len(l) >= 3 AND coalesce(len(list_filter(l[1:200], lambda x: regexp_matches(x, '\d'))) / nullif(len(l), 0), 0) > 0.3 AS tabular FROM l""")
def tabular_texts(spark, d):
    """Whether each scanned text looks like a table."""
    return table(spark, d, "ocr_results").where("text is not null").select("ocr_id", medical.looks_tabular(F.col("text")).alias("tabular"))


@query(f"""SELECT result_id, coalesce(length(simplified) >= 15 AND length(simplified) <= length(original) * 2.5 AND NOT regexp_matches(lower(simplified), '^(simplify|legal text)')
  AND {_strip("lower(simplified)")} <> {_strip("lower(original)")} AND {_n_present("lower(simplified)", medical.FAILURES)} = 0, false) AS valid FROM clause_results""")
def valid_rewrites(spark, d):
    """Whether each simplification is usable."""
    return table(spark, d, "clause_results").select("result_id", medical.rewrite_is_valid(F.col("original"), F.col("simplified")).alias("valid"))


@query(f"""SELECT ocr_id, CASE WHEN confidence < 0.7 THEN 'low_confidence' WHEN lower(language) IN ('hindi', 'hindi-english') THEN 'multilingual' WHEN word_count < 5 AND length({_strip("text")}) > 50 THEN 'sparse_extraction' ELSE 'none' END AS reason FROM ocr_results""")
def scan_fallback(spark, d):
    """Why each scan should be read again by another engine."""
    t = table(spark, d, "ocr_results")
    return t.select("ocr_id", medical.fallback_reason(F.col("confidence"), F.lower("language"), F.col("word_count"), F.col("text"), 0.7).alias("reason"))


@query(f"""
WITH n AS (SELECT report_id, result_id, CASE WHEN contains(lower(test_name_standardized), 'hemoglobin') AND lower(flag) = 'low' THEN 'Low hemoglobin: ask about anemia' WHEN contains(lower(test_name_standardized), 'glucose') AND lower(flag) = 'high' THEN 'High blood sugar: watch the diet'
  WHEN contains(lower(test_name_standardized), 'creatinine') AND lower(flag) = 'high' THEN 'High creatinine: ask about the kidneys' END AS m, lower(flag) IN ('low', 'high') AS ab FROM test_results),
r AS (SELECT report_id, m, row_number() OVER (PARTITION BY report_id ORDER BY result_id) AS r FROM n WHERE m IS NOT NULL), k AS (SELECT report_id, list(m ORDER BY r) AS ms FROM r WHERE r < 5 GROUP BY report_id),
c AS (SELECT report_id, count(*) FILTER (WHERE ab) AS n FROM n GROUP BY report_id)
SELECT c.report_id, CASE WHEN n = 0 THEN 'All results within normal ranges' ELSE array_to_string(list_concat([n || ' abnormal results'], coalesce(ms, [])), '; ') END AS messages FROM c LEFT JOIN k ON k.report_id = c.report_id""")
def lab_advice(spark, d):
    """Advice on each report."""
    return medical.advice(table(spark, d, "test_results"), "report_id", "test_name_standardized", "flag", "result_id")


@query(f"SELECT clause_id, list_filter({_list(grouping.KEYWORDS)}, lambda k: contains(lower(content), k))[1:5] AS keywords FROM clauses WHERE content IS NOT NULL")
def clause_keywords(spark, d):
    """The first five key words of each clause."""
    return table(spark, d, "clauses").where("content is not null").select("clause_id", grouping.keywords(F.col("content")).alias("keywords"))


@query()
def clause_sentences(spark, d):
    """Sentences of each clause, abbreviations and numbers respected."""
    return table(spark, d, "clauses").select("clause_id", F.posexplode(grouping.clause_sentences(F.col("content"))).alias("sentence_no", "sentence"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, try_cast(regexp_extract(line, '^(\d+)[.)]', 1) AS BIGINT) AS n FROM l), g AS (SELECT *, count(n) OVER (PARTITION BY doc_id ORDER BY p) AS item FROM m)
SELECT doc_id, item - 1 AS item_no, max(n) AS number, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY p), '^\d+[.)]\s*', ''), '^\s+|\s+$', '', 'g') AS content FROM g WHERE item > 0 GROUP BY doc_id, item""")
def numbered_items(spark, d):
    """The numbered items of each document."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(grouping.numbered_items(F.col("text"))).alias("item_no", "i"))
    return t.select("doc_id", F.col("item_no").cast("long").alias("item_no"), "i.number", "i.content")


@query()
def sentence_clusters(spark, d):
    """Embeddings of a label as one document's sentences in average-linkage clusters."""
    return grouping.clusters(table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 40)), "doc", "vec_id", "embedding")


@query()
def sentence_merges(spark, d):
    """The same merged with the mean of what precedes."""
    return grouping.merged(table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 40)), "doc", "vec_id", "embedding", 0.3)


@query(f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label AS other, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, c)
SELECT vec_id, count(*) AS n_near, round(max(s), 6) AS best FROM s WHERE s > 0.2 GROUP BY vec_id""")
def near_prototypes(spark, d):
    """How many prototypes each embedding resembles, and the best similarity."""
    e = table(spark, d, "embeddings")
    one = vectors.centroids(e, "label", "embedding").agg(F.collect_list("centroid").alias("cs"))
    near = e.join(F.broadcast(one)).select("vec_id", F.filter(F.transform("cs", lambda c: vectors.cosine(F.col("embedding"), c)), lambda s: s > 0.2).alias("s"))  # one row of prototypes
    return near.where(F.size("s") > 0).select("vec_id", F.size("s").cast("long").alias("n_near"), F.round(F.array_max("s"), 6).alias("best"))


# ---- lexicon ----------------------------------------------------------------------------------------------------------
@query("SELECT ocr_id, text FROM ocr_results")
def masked_round_trip(spark, d):
    """Texts after masking what must be kept and restoring it: themselves."""
    spans = lexicon.kept_spans(F.col("text"))
    return table(spark, d, "ocr_results").select("ocr_id", lexicon.restored(lexicon.masked(F.col("text"), spans), spans).alias("text"))


@query(f"SELECT ocr_id, {', '.join(f'len(list_distinct(regexp_extract_all(text, {q(p)})))::BIGINT AS n{i}' for i, (p, _) in enumerate(lexicon.KEPT))} FROM ocr_results WHERE text IS NOT NULL")
def kept_counts(spark, d):
    """Distinct spans of each kind to be kept."""
    t = table(spark, d, "ocr_results").where("text is not null")
    return t.select("ocr_id", *[F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long").alias(f"n{i}") for i, (p, _) in enumerate(lexicon.KEPT)])


@query()
def corrected_texts(spark, d):
    """Scanned texts with spacing corrected, kept spans untouched."""
    return table(spark, d, "ocr_results").select("ocr_id", lexicon.corrected(F.col("text"), tx.SPACING).alias("corrected"))


_WORDS = "SELECT lower(unnest(regexp_extract_all(content, '[A-Za-z]{5,}'))) AS w FROM clauses WHERE content IS NOT NULL"
_SCAN_WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(content, '[A-Za-z]{5,}'))) AS w FROM clauses WHERE content IS NOT NULL AND risk_level = 'critical'"


@query(f"""
WITH d AS (SELECT w AS term, count(*) AS n FROM ({_WORDS}) GROUP BY w HAVING count(*) >= 30), s AS ({_SCAN_WORDS}),
p AS (SELECT s.w, d.term, d.n, levenshtein(s.w, d.term) AS x FROM s, d WHERE abs(length(s.w) - length(d.term)) <= 2 AND levenshtein(s.w, d.term) <= 2)
SELECT w AS word, term, x AS distance FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY x, n DESC, term) AS r FROM p) WHERE r = 1""")
def nearest_words(spark, d):
    """For each word of critical clauses the nearest frequent word of all clauses."""
    word = lambda t: t.select(F.explode(F.transform(F.regexp_extract_all("content", F.lit("[A-Za-z]{5,}"), F.lit(0)), F.lower)).alias("word"))
    c = table(spark, d, "clauses").where("content is not null")
    dictionary = word(c).groupBy(F.col("word").alias("term")).agg(F.count("*").alias("n")).where("n >= 30")
    return lexicon.nearest_words(word(c.where("risk_level = 'critical'")), "word", dictionary).withColumn("distance", F.col("distance").cast("long"))


@query("""
WITH d AS (SELECT lower(test_name_standardized) AS k, test_name_standardized AS key, list_transform(coalesce(aliases, []), lambda a: lower(a)) AS a, row_number() OVER (ORDER BY test_name_standardized) AS ord FROM lab_units),
t AS (SELECT DISTINCT lower(trim(test_name)) AS t FROM test_results WHERE trim(coalesce(test_name, '')) <> ''),
e AS (SELECT t, arg_min(key, ord) AS x FROM t JOIN d ON t = k GROUP BY t), f AS (SELECT t, arg_min(key, ord) AS x FROM t JOIN d ON list_contains(a, t) GROUP BY t), g AS (SELECT t, arg_min(key, ord) AS x FROM t JOIN d ON contains(t, k) OR contains(k, t) GROUP BY t)
SELECT t.t AS test_name, coalesce(e.x, f.x, g.x) AS key, CASE WHEN e.x IS NOT NULL THEN 'exact' WHEN f.x IS NOT NULL THEN 'alias' WHEN g.x IS NOT NULL THEN 'partial' ELSE 'none' END AS tier
FROM t LEFT JOIN e ON e.t = t.t LEFT JOIN f ON f.t = t.t LEFT JOIN g ON g.t = t.t""")
def looked_up_tests(spark, d):
    """Each spelling of a test looked up in tiers."""
    from pyspark.sql import Window

    u = table(spark, d, "lab_units").select(F.col("test_name_standardized").alias("key"), "aliases")
    return lexicon.looked_up(table(spark, d, "test_results"), "test_name", u.withColumn("ord", F.row_number().over(Window.orderBy("key"))))


# ---- pipelines ----------------------------------------------------------------------------------------------------------
@query()
def pipeline_legal(spark, d):
    """Every document through the legal pipeline."""
    return pipelines.legal_documents(table(spark, d, "documents"), "doc_id", "text")


@query()
def pipeline_medical(spark, d):
    """Every scanned text through the medical pipeline."""
    return pipelines.medical_documents(table(spark, d, "ocr_results"), "ocr_id", "text", lab.names_of(table(spark, d, "lab_units")))


@query("""
WITH p AS (SELECT doc_id, lower(risk_level) AS level, count(*) AS n, sum(risk_score) AS s FROM clause_results WHERE risk_level IS NOT NULL GROUP BY ALL)
SELECT doc_id, printf('%d clauses, mean risk %.6f (%s)', sum(n)::BIGINT, coalesce(sum(s), 0) / sum(n), string_agg(level || ': ' || n, ', ' ORDER BY n DESC, level)) AS report FROM p GROUP BY doc_id""")
def simplification_reports(spark, d):
    """One line on each document's simplification."""
    return pipelines.simplification_report(table(spark, d, "clause_results"), "doc_id", "risk_level", "risk_score")


@query("SELECT lower(risk_level) AS level, count(*) AS n FROM clauses GROUP BY ALL")
def risk_order(spark, d):
    """Clauses by stated risk, most frequent first."""
    return pipelines.histogram(table(spark, d, "clauses").select(F.lower("risk_level").alias("level")), "level")


@query("SELECT doc_id, lower(coalesce(text, '')) AS output FROM documents")
def model_hook(spark, d):
    """A model plugged into a plan: here one that writes in lower case."""
    return table(spark, d, "documents").select("doc_id", pipelines.with_model(F.coalesce("text", F.lit("")), lambda s: s.str.lower()).alias("output"))


@query(f"""
WITH r AS ({_LEGAL_RISK}), t AS (SELECT doc_id, clause_id, level, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, clause_id) AS rank FROM r)
SELECT doc_id, clause_id, level, rank FROM t WHERE rank <= 3""")
def riskiest_clauses(spark, d):
    """The three riskiest clauses of each document."""
    t = table(spark, d, "clauses").where("content is not null").select("doc_id", "clause_id", legal.legal_risk(F.col("content")).alias("r")).select("doc_id", "clause_id", "r.level", "r.score")
    return rollups.top_by(t, ["doc_id"], 3, F.desc("score"), F.col("clause_id")).select("doc_id", "clause_id", "level", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH f AS (SELECT result_id, test_name_standardized AS t, value AS v, unit AS u, ref_low AS lo, ref_high AS hi, {_flag_sql("value", "ref_low", "ref_high", "test_name_standardized")} AS flag FROM test_results WHERE test_name_standardized IS NOT NULL)
SELECT result_id, flag, CASE WHEN flag LIKE 'critical%' THEN 'critical' WHEN flag IN ('low', 'high') THEN 'abnormal' ELSE flag END AS bucket FROM f""")
def lab_buckets(spark, d):
    """Each result's flag and the bucket a response shows it in."""
    t = table(spark, d, "test_results").where("test_name_standardized is not null")
    flag = lab.calculated_flag(F.col("value"), F.col("ref_low"), F.col("ref_high"), F.col("test_name_standardized"))
    return t.select("result_id", flag.alias("flag")).withColumn("bucket", F.when(F.col("flag").startswith("critical"), "critical").when(F.col("flag").isin("low", "high"), "abnormal").otherwise(F.col("flag")))


# ---- explanations -------------------------------------------------------------------------------------------------------
@query()
def law_explanations(spark, d):
    """Each citation of a clause in plain words, each distinct one explained once."""
    laws = legal.law_references(table(spark, d, "clauses"), "clause_id", "content")
    one = laws.select("law", "section", "article", "year").distinct()
    told = one.withColumn("explanation", explain.law_explanation(F.col("law"), F.col("section"), F.col("article"), F.col("year")))
    return laws.join(told, ["law", "section", "article", "year"]).select("clause_id", "law", "explanation")


@query("""
WITH f AS (SELECT clause_id, content, regexp_extract(content, 'Section\\s+\\d+[A-Za-z]?') AS m FROM clauses WHERE content IS NOT NULL), p AS (SELECT *, strpos(content, m) AS pl FROM f WHERE m <> '')
SELECT clause_id, m AS citation, regexp_replace(substring(content, greatest(1, pl - 100), pl + length(m) + 100 - greatest(1, pl - 100)), '^\\s+|\\s+$', '', 'g') AS context FROM p""")
def citation_contexts(spark, d):
    """The first section cited in each clause with its surroundings."""
    t = table(spark, d, "clauses").where("content is not null").select("clause_id", "content", F.regexp_extract("content", r"Section\s+\d+[A-Za-z]?", 0).alias("citation")).where("citation <> ''")
    return t.select("clause_id", "citation", explain.context(F.col("content"), F.col("citation")).alias("context"))


@query("""
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, abs(embedding[3]::DOUBLE) AS k, abs(embedding[4]::DOUBLE) AS l FROM embeddings),
p AS (SELECT vec_id, 0.35 * k / (k + l + 0.001) + 0.65 * exp(5 * a) / (exp(5 * a) + exp(5 * b)) AS x, 0.35 * l / (k + l + 0.001) + 0.65 * exp(5 * b) / (exp(5 * a) + exp(5 * b)) AS y FROM e),
n AS (SELECT vec_id, x / (x + y) AS x, y / (x + y) AS y FROM p)
SELECT vec_id, CASE WHEN greatest(x, y) < 0.55 THEN 'unknown' WHEN x > y THEN 'legal' ELSE 'medical' END AS domain, round(CASE WHEN greatest(x, y) < 0.55 THEN 1 - greatest(x, y) ELSE greatest(x, y) END, 6) AS confidence FROM n""")
def ensemble_domains(spark, d):
    """The ensemble of scores (numbers of each embedding stand for the similarities and keyword sums)."""
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    e = table(spark, d, "embeddings").select("vec_id", explain.ensemble((F.abs(v[2]), F.abs(v[3])), (v[0], v[1])).alias("e"))
    return e.select("vec_id", "e.domain", F.round("e.confidence", 6).alias("confidence"))


@query("""SELECT result_id, CASE WHEN contains(lower(risk_level), 'critical') THEN 'critical' WHEN contains(lower(risk_level), 'high') THEN 'high' WHEN contains(lower(risk_level), 'medium') THEN 'medium' WHEN contains(lower(risk_level), 'low') THEN 'low' ELSE 'none' END AS shown,
  'Risk: ' || risk_level || ' (' || floor(risk_score * 100 + 0.5)::BIGINT || '%)' AS summary FROM clause_results""")
def shown_levels(spark, d):
    """How each simplified clause's risk is shown."""
    return table(spark, d, "clause_results").select("result_id", explain.shown_level(F.col("risk_level")).alias("shown"), explain.summary_line(F.col("risk_level"), F.col("risk_score")).alias("summary"))


@query("SELECT result_id, coalesce(contains(lower(array_to_string(errors, ' ')), 'medical'), false) AS wrong FROM processing_results")
def wrong_domains(spark, d):
    """Results refused since the document belongs to the other domain."""
    return table(spark, d, "processing_results").select("result_id", explain.wrong_domain(F.col("errors"), "medical").alias("wrong"))


@query(f"""
WITH t AS (SELECT result_id, regexp_replace(regexp_replace(original, '\\b(Rs|Mr|Mrs|Dr|No)\\.', '\\1', 'g'), 'w\\.e\\.f\\.?', 'from', 'g') AS t FROM clause_results WHERE original IS NOT NULL)
SELECT result_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip("s")}), lambda s: s <> '') AS sentences FROM t""")
def short_sentences(spark, d):
    """Sentences of each original clause for rewriting."""
    return table(spark, d, "clause_results").where("original is not null").select("result_id", explain.short_sentences(F.col("original")).alias("sentences"))


@query(f"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, {_score(legal.LEGAL_WEIGHTS)} AS a FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(a / sqrt(greatest(n, 1)), 6) AS legal_density FROM w""")
def legal_density(spark, d):
    """Legal keywords of each document for its length."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.round(explain.density(legal.keyword_score(F.col("text"), legal.LEGAL_WEIGHTS), tx.word_count(F.col("text"))), 6).alias("legal_density"))


@query("""SELECT language, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE text IS NULL OR text = '') / count(*) AS empty_share FROM ocr_results GROUP BY language""")
def confidence_means(spark, d):
    """Mean confidence and share of empty scans by stated language."""
    t = table(spark, d, "ocr_results")
    return t.groupBy("language").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), (F.count_if(F.col("text").isNull() | (F.col("text") == "")) / F.count("*")).alias("empty_share"))
