"""Legal text: document type, domain, clauses, their type, title, risk, key terms and entities.

Rule tables are literal arrays folded inside one projection (no join, no shuffle);
segmentation is a generator followed by windows over one document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Indicators, patterns and weights, in the order in which they count.
LEGAL_INDICATORS = "agreement|contract|landlord|tenant|lessor|lessee|hereby|whereas|witnesseth|party|parties|rent|lease|rental|premises|property|term|termination|notice period|security deposit".split("|")
MEDICAL_INDICATORS = (
    "patient|test|result|blood|sample|specimen|hemoglobin|glucose|cholesterol|mg/dl|g/dl|reference range|normal|abnormal|laboratory|pathologist|doctor|hospital|clinic|lab|cells/cumm|million/cumm|report"
).split("|")
SECTIONS = [
    (r"^\s*(\d+)\s*[.\)]\s*(.+)", "numbered", "terms"), (r"^\s*\((\d+)\)\s*(.+)", "numbered", "terms"), (r"^\s*([IVXLC]+)\s*[.\)]\s*(.+)", "roman", "terms"), (r"^\s*([A-Z])\s*[.\)]\s*(.+)", "lettered", "terms"),
    (r"^\s*(WHEREAS|WITNESSETH|NOW THEREFORE)", "preamble", "header"), (r"^\s*(ARTICLE|SECTION|CLAUSE)\s+(\d+|[IVXLC]+)", "article", "terms"), (r"^\s*(SCHEDULE|ANNEXURE|APPENDIX)", "schedule", "terms"),
    (r"^\s*(RENT(?:AL)?|MONTHLY RENT|PAYMENT)", "rent", "rent_payment"), (r"^\s*(SECURITY DEPOSIT|DEPOSIT|CAUTION)", "deposit", "security_deposit"), (r"^\s*(TERM(?:INATION)?|DURATION|PERIOD)", "term", "termination"),
    (r"^\s*(MAINTENANCE|REPAIRS|UPKEEP)", "maintenance", "maintenance"), (r"^\s*(NOTICE|TERMINATION|EVICTION)", "termination", "termination"), (r"^\s*(PENALTY|PENALTIES|FINE|DAMAGES)", "penalties", "penalties"),
    (r"^\s*(OBLIGATION|RESPONSIBILITIES|DUTIES)", "obligations", "obligations"), (r"^\s*(DISPUTE|ARBITRATION|JURISDICTION)", "dispute", "dispute"), (r"^\s*(SIGNATURE|SIGNED|WITNESS)", "signatures", "signatures"),
]
RISK_WORDS = {
    "high": "penalty|penalties|fine|fines|damages|forfeit|forfeiture|eviction|evict|terminate immediately|breach|violation|liable|liability|indemnify|indemnification|legal action|court|lawsuit|sue".split("|"),
    "medium": "notice period|lock-in|lock in|minimum period|security deposit|caution deposit|advance|increase|revision|escalation|restriction|prohibited|not allowed|obligation|must|shall|required".split("|"),
    "low": "maintenance|repair|upkeep|electricity|water|utility|inspection|access".split("|"),
}
FILLER = [
    r"witness[es]*[:\s]*$", r"in\s+witness\s+whereof", r"as\s+witness", r"witnessed\s+by", r"before\s+me.*witness", r"signed?[:\s]*$", r"signature[s]?[:\s]*$",
    r"sign(ed|ature)?\s*(by|of)?\s*(landlord|tenant|lessor|lessee|party)", r"executed\s+(at|on|by)", r"duly\s+executed", r"^\s*(first|second|1st|2nd|third|3rd)\s+party\s*:?",
    r"^\s*(landlord|tenant|lessor|lessee|owner|occupant)\s*:?\s*$", r"^\s*party\s+(of\s+the\s+)?(first|second)\s+part", r"^\s*name[:\s]*$", r"^\s*address[:\s]*$", r"^\s*phone[:\s]*$", r"^\s*date[:\s]*$",
    r"^\s*place[:\s]*$", r"^\s*seal[:\s]*$", r"^\s*\d+\.?\s*$", r"^\s*[a-z]\)?\s*$", r"^\s*_+\s*$", r"^\s*\.+\s*$", r"^\s*\(\s*\)\s*$", r"^\s*\[\s*\]\s*$", r"^\s*(schedule|annexure|appendix)\s*[a-z0-9]*\s*$",
    r"^\s*for\s+and\s+on\s+behalf\s+of", r"^\s*signed\s+sealed\s+and\s+delivered", r"^\s*in\s+the\s+presence\s+of",
]
LABEL_WORDS = (
    "witness witnesses landlord tenant lessor lessee party parties signed signature name date place address phone seal executed presence behalf first second third owner occupant mr mrs ms sri smt shri dr prop proprietor"
).split()
VERBS = [
    r"\b(shall|will|must|may|should|can|would|could)\b", r"\b(agree|pay|maintain|provide|ensure|comply|notify|terminate|vacate|return)\b",
    r"\b(is|are|was|were|has|have|had)\b.*\b(responsible|liable|required|entitled|obligated)\b",
]
TITLES = [
    (r"\b(rent|monthly\s+rent|payment.*landlord)\b", "Rent Payment Terms"), (r"\b(security\s+deposit|advance|caution\s+deposit)\b", "Security Deposit"),
    (r"\bperiod\s+of\s+(this\s+)?(agreement|tenancy)\b", "Tenancy Period"), (r"\b(terminat|vacat|surrender)\b", "Termination & Vacancy"), (r"\b(notice|three\s+months?\s+notice)\b", "Notice Period"),
    (r"\bpro[\-\s]?rat", "Pro-rated Rent"), (r"\b(tax|municipal|assessment|rates)\b", "Taxes & Assessments"), (r"\b(electric|water|utility)\b", "Utilities & Charges"),
    (r"\b(condition|wear\s+and\s+tear|maintenance)\b", "Property Condition & Maintenance"), (r"\b(sublet|let\s+out|assign)\b", "Subletting Restrictions"), (r"\b(waste|damage)\b", "Property Care"),
    (r"\bagree[ds]?\s+and\s+declare[ds]?\b", "Agreement Declaration"),
]
TYPES = [
    (r"\b(rent|monthly\s+rent|payment.*landlord|rupees|rs\.?)\b", "rent_payment"), (r"\b(security\s+deposit|advance|caution)\b", "security_deposit"), (r"\b(terminat|notice\s+period|vacat|evict)\b", "termination"),
    (r"\b(maintain|repair|upkeep|condition)\b", "maintenance"), (r"\b(penalty|fine|forfeit|damages)\b", "penalties"), (r"\b(obligation|shall|must|agree)\b", "obligations"),
    (r"\b(dispute|arbitrat|jurisdiction|court)\b", "dispute"),
]
CRITICAL_PHRASES = "forfeit 100%|forfeit entire|forfeit all|waive all rights|waives all rights|no right to|no legal recourse|immediate eviction|immediate termination|within 24 hours|without notice|without any notice".split("|")
HIGH_PHRASES = "forfeit|forfeiture|7 days|7-day|14 days|14-day|non-refundable|penalty equivalent to 2|penalty of 2|any time without|at any time".split("|")
PROTECTIONS = "fully refundable|full refund|30 days notice|60 days notice|mutual agreement|written consent".split("|")
SCORES = {"critical": 0.95, "high": 0.75, "medium": 0.50, "low": 0.25, "none": 0.05}
BOOSTS = {
    "critical": (1.15, "forfeit|forthwith|immediately|waive|unlimited|unconditional|absolute|irrevocable|no recourse".split("|")),
    "high": (1.1, "penalty|liable|damages|compensation|breach|default|terminate|evict|legal action|court".split("|")),
}
LEGAL_WEIGHTS = {
    3.0: "agreement|contract|landlord|tenant|lessor|lessee|lease|witnesseth", 2.5: "rental|premises|whereas|hereinafter|notice period|eviction|evict|indemnify|indemnification|security deposit|caution deposit|lock-in|lock in period",
    2.0: "rent|hereby|herein|thereof|therein|aforementioned|enforceable|binding|annexure|termination|terminate|breach|violation|penalty|penalties|damages|liable|liability|advance rent|monthly rent|notarized|stamp duty|jurisdiction|arbitration|dispute resolution",
    1.5: "property|party|parties|executed|clause|article|schedule|signature|signed|witness|registration|court", 1.0: "section|law",
}
MEDICAL_WEIGHTS = {
    3.0: "pathology|pathologist|reference range|normal range|hemoglobin|haemoglobin|platelet|hematocrit|haematocrit|cbc|complete blood count|blood sugar|creatinine|cholesterol|triglycerides|bilirubin|mg/dl|g/dl|gm/dl|cells/cumm|million/cumm|tsh|liver function|kidney function|lipid profile|urinalysis",
    2.5: "patient|specimen|laboratory|diagnosis|diagnostic|abnormal|rbc|wbc|glucose|urea|/cumm|iu/l|meq/l|mmol/l|thyroid", 2.0: "sample|investigation|blood|fasting|u/l|hospital|clinic|clinical|urine|critical|elevated|decreased",
    1.5: "test|result|results|doctor|lab|medical", 1.0: "normal|high|low",
}


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_any(low: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def n_present(low: Column, phrases: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)))


def first_match(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first pattern that is found; ``default`` where none is."""
    out = default
    for p, v in reversed(rules):
        out = F.when(text.rlike(p), F.lit(v)).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    """``legal``, ``medical`` or ``unknown`` (a tie), by the number of indicators present."""
    low = F.lower(text)
    a, b = n_present(low, LEGAL_INDICATORS), n_present(low, MEDICAL_INDICATORS)
    return F.when(a > b, "legal").when(b > a, "medical").otherwise("unknown")


def keyword_score(text: Column, weights: dict[float, str], cap: int | None = 5) -> Column:
    """Sum of weight times occurrences (whole words; raw text for units with a slash), each at most ``cap`` times."""
    low, total = F.lower(text), F.lit(0.0)
    for w, words in weights.items():
        for k in words.split("|"):
            n = (F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k) if "/" in k else F.when(F.contains(low, F.lit(k)), F.regexp_count(low, F.lit(rf"\b{k}\b"))).otherwise(0)  # most words are absent, and told so without a pattern
            total = total + w * (F.least(n, F.lit(cap)) if cap else n)
    return total


def domain(text: Column) -> Column:
    """Domain by keywords: struct of ``domain, confidence, legal_score, medical_score``; no keyword gives 0.5 each."""
    a, b = keyword_score(text, LEGAL_WEIGHTS), keyword_score(text, MEDICAL_WEIGHTS)
    return judged_domain(a, b)


def judged_domain(a: Column, b: Column) -> Column:
    total = a + b
    legal, medical = F.when(total > 0, a / total).otherwise(0.5), F.when(total > 0, b / total).otherwise(0.5)
    name = F.when(medical > legal + 0.1, "medical").when(legal > medical + 0.1, "legal").otherwise("unknown")
    return F.struct(name.alias("domain"), F.greatest(legal, medical).alias("confidence"), legal.alias("legal_score"), medical.alias("medical_score"))


def domain_token(d: Column) -> Column:
    """The marker of a judged domain; an unknown one takes the higher score's, medical on a tie."""
    return F.when(d["domain"] == "legal", "[LEGAL]").when(d["domain"] == "medical", "[MEDICAL]").when(d["legal_score"] > d["medical_score"], "[LEGAL]").otherwise("[MEDICAL]")


def is_filler(text: Column) -> Column:
    """Whether a clause says nothing: too short, a signature or witness block, mostly labels, or without a verb."""
    low = F.lower(stripped(text))
    clean = F.regexp_replace(low, r"[\s\n]+", " ")
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    labels = F.size(F.filter(words, lambda w: w.isin(LABEL_WORDS)))
    verb = low.rlike(VERBS[0]) | low.rlike(VERBS[1]) | low.rlike(VERBS[2])
    found = F.lit(False)
    for p in FILLER:
        found = found | clean.rlike(f"(?i){p}")
    n = F.size(words)
    return (F.length(clean) < 50) | (n < 8) | found | (labels / n > 0.5) | (~verb & (n < 20))


def clause_risk(text: Column) -> Column:
    """Struct of ``level, keywords``: the first high word alone, else all medium and low ones; ``none`` without any."""
    low = F.lower(text)
    hit = {k: F.filter(F.array(*map(F.lit, v)), lambda p: F.contains(low, p)) for k, v in RISK_WORDS.items()}
    level = F.when(F.size(hit["high"]) > 0, "high").when(F.size(hit["medium"]) > 0, "medium").when(F.size(hit["low"]) > 0, "low").otherwise("none")
    return F.struct(level.alias("level"), F.when(F.size(hit["high"]) > 0, F.slice(hit["high"], 1, 1)).otherwise(F.concat(hit["medium"], hit["low"])).alias("keywords"))


def clause_type(text: Column) -> Column:
    return first_match(F.lower(text), TYPES, F.lit("general"))


def clause_title(text: Column) -> Column:
    """A title by the first pattern found, else the first six words."""
    words = F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 6)
    plain = F.array_join(words, " ")
    return first_match(F.lower(text), TITLES, F.when(F.size(words) == 6, F.concat(plain, F.lit("..."))).otherwise(plain))


def legal_risk(text: Column) -> Column:
    """Struct of ``level, score, points``: additive indicators of harsh terms, lessened by protections."""
    low = F.lower(text)
    num = lambda p: F.regexp_extract(low, p, 1).try_cast("long")
    pct, months, days = num(r"forfeit.*?(\d+)\s*%"), num(r"(\d+)\s*month.*?(?:rent|penalty)"), num(r"(\d+)\s*days?\s*(?:notice|prior)")
    one = lambda c: F.when(c, 1).otherwise(0)
    harsh, heavy = has_any(low, CRITICAL_PHRASES), has_any(low, HIGH_PHRASES)
    critical = 2 * one(harsh) + 2 * one(pct >= 100)
    high = one(heavy) + one((pct >= 50) & (pct < 100)) + one(months >= 3) + one(days <= 7)
    high = F.when(has_any(low, PROTECTIONS), F.greatest(high - 1, F.lit(0))).otherwise(high)
    medium = one(months == 2) + one((days > 7) & (days <= 14))
    level = F.when(critical >= 2, "critical").when(high >= 2, "high").when((high >= 1) | (medium >= 1), "medium").otherwise("low")
    points = F.filter(F.array(
        F.when(harsh, "Extreme penalties or complete rights waiver"), F.when(heavy, "Short notice or heavy penalties"),
        F.when(pct >= 100, F.format_string("Tenant must forfeit %d%% of deposit", pct)).when(pct >= 50, F.format_string("Tenant may forfeit %d%% of deposit", pct)),
        F.when(months >= 3, F.format_string("%d months penalty", months)), F.when(days <= 7, F.format_string("Only %d days notice required", days)),
    ), lambda x: x.isNotNull())
    return F.struct(level.alias("level"), risk_score(level).alias("score"), F.array_join(F.slice(points, 1, 3), "; ").alias("explanation"))


def risk_score(level: Column) -> Column:
    """The score of a level; 0 for unknown ones."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCORES.items() for x in p]), level), F.lit(0.0))


def risk_boost(text: Column) -> Column:
    """Factors by which words raise the critical and high levels."""
    low = F.lower(text)
    return F.struct(*[F.round(F.pow(F.lit(f), n_present(low, ws)), 6).alias(k) for k, (f, ws) in BOOSTS.items()])


def document_risk(counts: dict[str, Column] | None = None, mean: Column | None = None, policy: str = "counts") -> Column:
    """Risk of a document: ``counts`` and ``strict`` go by the numbers of critical, high and medium clauses, ``mean`` by the mean score."""
    if policy == "mean":
        return F.when(mean >= 0.7, "critical").when(mean >= 0.5, "high").when(mean >= 0.3, "medium").when(mean >= 0.1, "low").otherwise("none")
    c, h, m = counts["critical"], counts["high"], counts["medium"]
    if policy == "strict":
        return F.when((c > 0) | (h >= 2), "critical").when((h > 0) | (m >= 3), "high").when(m > 0, "medium").otherwise("low")
    return F.when(c > 0, "critical").when(h >= 2, "high").when((h >= 1) | (m >= 3), "medium").when(m >= 1, "low").otherwise("none")


def entity_check(original: Column, simplified: Column) -> Column:
    """Struct of missing numbers (two characters or more, or decimal), amounts, dates and periods, and ``preserved``."""
    get = lambda c, p, g=0: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(g)))
    missing = lambda p, g=0: F.array_sort(F.array_except(get(original, p, g), get(simplified, p, g)))
    numbers = F.filter(missing(r"\b\d+(?:\.\d+)?\b"), lambda n: (F.length(n) >= 2) | F.contains(n, F.lit(".")))
    money, dates = missing(r"(?i)(?:rs\.?|₹|inr)\s*([\d,]+)", 1), missing(r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b")
    period = lambda c: F.transform(get(c, r"(?i)\b\d+\s*(?:day|month|year|week)s?\b"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"(?i)s$", ""))
    periods = F.array_except(period(original), period(simplified))
    return F.struct(
        F.array_join(F.slice(numbers, 1, 3), ", ").alias("numbers"), F.array_join(F.slice(money, 1, 3), ", ").alias("money"), F.array_join(F.slice(dates, 1, 2), ", ").alias("dates"),
        (F.size(periods) > 0).alias("periods"), ((F.size(numbers) == 0) & (F.size(money) == 0) & (F.size(dates) == 0) & (F.size(periods) == 0)).alias("preserved"),
    )


def key_terms(text: Column, most: int = 8) -> Column:
    """Amounts, periods and percentages, each once, in the order of their kinds, at most ``most``."""
    get = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    put = lambda a, pre, post: F.transform(a, lambda x: F.concat(F.lit(pre), x, F.lit(post)))
    parts = [
        put(get(r"(?i)(?:rs\.?|₹|inr)\s*([0-9,]+)"), "₹", ""), put(get(r"(?i)([0-9,]+)\s*(?:rupees|rs)"), "₹", ""), put(get(r"(?i)(\d+)\s*(?:month|months)"), "", " months"),
        put(get(r"(?i)(\d+)\s*(?:day|days)"), "", " days"), put(get(r"(?i)(\d+)\s*(?:year|years)"), "", " years"), put(get(r"(\d+(?:\.\d+)?)\s*%"), "", "%"),
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


# How laws are cited; names are bounded (16 words of 40 letters), so that no text makes the search explode (kind, pattern, group of the name, of the year, of the section, of the article, ending of the name).
LAWS = [
    ("act", r"(?:The\s+)?([A-Za-z]{2,40}+(?:\s{1,3}(?:[A-Za-z]{1,40}+|&)){0,15}?)\s+Act[,\s]+(\d{4})", 1, 2, 0, 0, " Act"),
    ("section_of_act", r"Section\s+(\d+[A-Za-z]?(?:\s*\([a-z0-9]+\))?)\s+of\s+(?:the\s+)?([A-Z][a-zA-Z\s]+?Act)", 2, 0, 1, 0, ""),
    ("section", r"under\s+Section\s+(\d+[A-Za-z]?(?:\s*\([a-z0-9]+\))?)", 0, 0, 1, 0, "(Referenced Law)"), ("article", r"Article\s+(\d+[A-Za-z]?(?:\s*\([a-z0-9]+\))?)", 0, 0, 0, 1, "Constitution of India"),
    ("rules", r"(?:The\s+)?([A-Za-z]{2,40}+(?:\s{1,3}[A-Za-z]{1,40}+){0,15}?)\s+Rules[,\s]+(\d{4})", 1, 2, 0, 0, " Rules"), ("code", r"(?:The\s+)?(Indian\s+Penal\s+Code|Code\s+of\s+Civil\s+Procedure|Code\s+of\s+Criminal\s+Procedure|Indian\s+Evidence\s+Act)", 1, 0, 0, 0, ""),
]


def _citations(text: Column, order: int, kind: str, pattern: str, name: int, year: int, section: int, article: int, end: str) -> Column:
    """All citations of one kind in a text, as structs."""
    whole = f"(?i)(?<![A-Za-z])(?:{pattern})"

    def one(m: Column) -> Column:
        part = lambda n: F.regexp_extract(m, whole, n) if n else F.lit("")
        law = F.concat(F.trim(part(name)), F.lit(end))
        return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), law.alias("law"), part(year).alias("year"), part(section).alias("section"), part(article).alias("article"), m.alias("reference"))

    # the text is searched once; groups are taken from the matches
    return F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), one)


def law_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, law, year, section, article, reference``: each cited law of a text once, the citation with a year first.

    Null and empty texts give no row; repeated rows share their citations.
    """
    some = docs.where(F.col(text).rlike("(?i)act|section|article|rules|code")).select(key, F.col(text).alias("_t"))
    found = [_citations(F.col("_t"), i, *rule) for i, rule in enumerate(LAWS)]
    flat = some.select(key, F.posexplode(F.concat(*found)).alias("pos", "r")).select(key, "pos", "r.*")
    same = F.replace(F.replace(F.lower("law"), F.lit("the "), F.lit("")), F.lit(" act"), F.lit(""))
    w = Window.partitionBy(key, "same").orderBy(F.when(F.col("year") == "", 1).otherwise(0), "ord", "pos")
    return flat.withColumn("same", same).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "kind", "law", "year", "section", "article", F.trim("reference").alias("reference"))


def section_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, content, section_type``: every line of a text (from 0), with the section type where it begins one."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    s = stripped(F.col("content"))
    n = F.length(s)
    header = (F.upper(s) == s) & (F.lower(s) != s) & (n > 5) & (n < 100) & ~F.substring(s, 1, 5).rlike(r"\d")
    kind = first_match(s, [(f"(?i){p}", k) for p, k, _ in SECTIONS], F.when(header, "header"))
    return lines.withColumn("section_type", F.when(s != "", kind))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section_no, section_type, clause_type, start_line, end_line, title, content``: the sections of each text.

    Lines before the first boundary belong to no section.  Documents are split by ``key`` only; repeated keys mix.
    """
    lines = section_lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("line")
    numbered = lines.withColumn("section_no", F.count("section_type").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("section_no > 0")
    kinds = {k: t for _, k, t in SECTIONS} | {"header": "header"}
    g = numbered.groupBy(key, "section_no").agg(
        F.min_by("section_type", "line").alias("section_type"), (F.min("line") + 1).alias("start_line"), (F.max("line") + 1).alias("end_line"),
        F.substring(stripped(F.min_by("content", "line")), 1, 100).alias("title"),
        stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")).alias("content"),
    )
    return g.withColumn("clause_type", F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), "section_type"))


def logical_clauses(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``*keys, clause_no, clause_type, title, risk_level, content``: sentences over 30 characters that aren't filler, each a clause."""
    parts = rows.select(*keys, F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("p", "s")).withColumn("content", stripped(F.col("s"))).where((F.length("content") > 30) & ~is_filler(F.col("content")))
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    c = F.col("content")
    return parts.select(*keys, no.alias("clause_no"), clause_type(c).alias("clause_type"), clause_title(c).alias("title"), clause_risk(c)["level"].alias("risk_level"), "content")


def segment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Clauses of each text: its sections, those over 500 characters by sentences, without filler, numbered anew."""
    s = sections(docs, key, text)
    short = s.where((F.length("content") <= 500) & ~is_filler(F.col("content"))).select(key, "section_no", F.lit(0).alias("sub"), "clause_type", "title", clause_risk(F.col("content"))["level"].alias("risk_level"), "start_line", "end_line", "content")
    long = logical_clauses(s.where(F.length("content") > 500), [key, "section_no"], "content").select(key, "section_no", F.col("clause_no").alias("sub"), "clause_type", "title", "risk_level", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "content")
    no = F.row_number().over(Window.partitionBy(key).orderBy("section_no", "sub"))
    return short.unionByName(long).withColumn("clause_no", no).drop("section_no", "sub")
