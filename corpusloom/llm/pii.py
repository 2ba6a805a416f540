"""Personal information in free text: found, scored and replaced by typed placeholders.

Regular expressions propose spans; checksum validators (Luhn, Verhoeff, mod 97)
confirm numbers; words near a span raise or lower its score.  A span whose score
reaches ``KEEP`` is a mention.  Where spans overlap, the better score wins, then
the longer span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least score of a mention, and how many characters before and after a span count as its context.
KEEP, BEFORE, AFTER = 0.5, 40, 24
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_GAP = r"(?:\s+|[-‐‑]\s*)"  # inside a number: blanks, a line end, or a hyphen
_BREAK = r"(?:[-‐‑¬­]\s*\n\s*)"  # a word broken across lines
_UP = "A-ZÀ-ÖØ-ÞŠŽ"
_DEV = r"[ऀ-ॣ॰-ॿ]"
_TAM = r"[஀-௥]"
_LATIN = rf"(?:[{_UP}](?:[^\W_]|['’\-‐‑¬­](?=[^\W_])|{_BREAK}(?=[a-zß-ÿ]))+)"
_INDIC = rf"(?:(?:{_DEV}|[‌‍])(?:{_DEV}|[‌‍]|{_BREAK})*|{_TAM}(?:{_TAM}|{_BREAK})*)"
_INITIAL = rf"(?:[{_UP}]\.)"
_NAME = rf"(?:{_LATIN},\s+{_LATIN}(?:\s+{_INITIAL}(?!\s+[{_UP}][a-z]+\s+[a-z]))?|(?:{_INITIAL}\s+){{0,2}}{_LATIN}(?:\s+(?:{_INITIAL}(?=\s+[{_UP}])|{_LATIN})){{0,3}})"
_DEVNAME = rf"(?:{_INDIC}(?:\s+{_INDIC}){{0,3}}?)"

# ---- spans that have a shape of their own -------------------------------------------------------------------------
_AT = re.compile(r"@|[(\[]\s*at\s*[)\]]", re.I)
_LOCAL = re.compile(r"[^\W_](?:[\w.+\-]*[\w+])?\s?$")
_DOMAIN = re.compile(r"\s?[^\W_][\w]*(?:-\s*\w+)*(?:(?:\.|\s?[(\[]\s*dot\s*[)\]]\s?)[^\W\d_](?:[\w]|-(?=\w))*)+", re.I)
_DIGITS = re.compile(r"(?:\+|\((?=[\d+]))?[0-9०-९](?:[\s().\-‐‑]{0,3}[0-9०-९]){6,18}")
_CODED = re.compile(rf"\b(?:[A-Z]{{5}}\d{{4}}[A-Z]|[A-Z]{{2}}{_GAP}\d{{2}}{_GAP}\d{{4}}{_GAP}\d{{7}}|[A-Z]\d{{7,8}}|[A-Z]{{2}}\d{{2}}(?:\s?[A-Z0-9]{{4}}){{2,7}}(?:\s?[A-Z0-9]{{1,3}})?)\b")
_DATE = re.compile(r"\d{1,2}[-./]\d{1,2}[-./]\d{4}|\d{4}[-./]\d{1,2}[-./]\d{1,2}")
_ID_SHAPE = re.compile(rf"\d{{4}}{_GAP}?\d{{4}}{_GAP}?\d{{4}}(?:{_GAP}?\d{{4}})?|\d{{3}}[-‐‑]\s*\d{{2}}[-‐‑]\s*\d{{4}}")
_PHONE_SHAPE = re.compile(
    r"(?:(?:\+|\(?00)\d{1,3}\)?|0)[\s.\-‐‑]{0,3}\(?\d{2,5}\)?(?:[\s.\-‐‑]{0,3}\d{2,8}){1,4}|[6-9]\d{3}(?:[\s.\-‐‑]{0,2}\d{2,6}){1,3}|\(\d{2,5}\)(?:[\s.\-‐‑]{0,3}\d{2,8}){1,4}"
)

# Words that speak for a kind when they stand before (or, after "|", behind) a span.
_PHONE_WORDS = re.compile(r"(?:phone|mobile|tel\b|telef|call|reach|contact|registered number|whats ?app|fax|फ़ोन|फोन|मोबाइल|संपर्क|दूरभाष|joignable|atiende|erreichbar|unter|ligue|llam|தொலைபேசி|phone kar)", re.I)
_ID_WORDS = re.compile(r"(?:\buid\b|\bid\b|card|identity|identit|identific|passport|licen[cs]e n|aadhaa?r|\bpan\b|ssn|ausweis|documento|dni\b|पहचान|आधार|ओळख|அடையாள|carte)", re.I)
_NOT_PERSON = re.compile(r"(?:receipt|challan|meter|barcode|accession|invoice|registry|report|bearing|case file|sample|voucher|cheque|order|रसीद|पंजीकरण|नोंदणी|पावती|பதிவு|ரசீது|panjikaran|raseed|unter der nummer|con el número|sous le numéro|reçu|quittung|recibo)", re.I)

# ---- addresses ------------------------------------------------------------------------------------------------------
_PLACE = rf"(?:(?:{_LATIN}|\d+[A-Z]?|[A-Z](?=[\s,]))(?:\s+(?:{_LATIN}|\d{{1,3}}[A-Z]?(?![\d])|[A-Z](?=[\s,])))*)"
_POSTAL = r"(?:,?\s+PIN\s*(?:code)?\s*:?\s*\d{3}\s?\d{3}|\s*[-–‐‑]\s*\d{3}\s?\d{3}|,\s+[A-Z]{2}\s+\d{5}|\s+\d{6})(?!\d)"
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Marg|Nagar|Bend|Drive|Way|Court|Square|Terrace|Close|Path|Gali|Mandi|Chowk|Crescent|Row|Boulevard|Salai|Rasta)"
_ADDRESS = re.compile(
    rf"(?:(?:\bH\.?\s?No\.?|\bHouse\s+No\.?|\bPlot(?:\s+No\.?)?|\bFlat(?:\s+No\.?)?|\bApt\.?|\bDoor\s+No\.?)\s+\d+(?:[/-]\d+)?[A-Z]?|(?<![\d/.,])\b\d{{1,4}}[A-Z]?(?=\s+{_LATIN}))"
    rf"(?:,\s+|\s+)(?:{_PLACE},\s+){{0,4}}?{_PLACE}(?:{_POSTAL}|(?=\s*[.;।)]|\s+[a-z(]|\s*\n\s*\n|\s*$|,\s+[a-z]))"
)
_ADDRESS_DEV = re.compile(
    rf"(?:मकान|प्लॉट|फ्लैट|फ़्लैट|घर|सदनिका)\s+(?:नं|क्र|क्रमांक|नंबर)\.?\s*[\d०-९]+(?:[/-][\d०-९]+)?[A-Z]?(?:,\s+{_INDIC}(?:\s+{_INDIC})*?)*?(?:,\s+{_INDIC})(?:\s+{_INDIC}){{0,2}}?(?:\s*[-–‐‑]\s*[\d०-९]{{3}}\s?[\d०-९]{{3}}|(?=\s+(?:है|में|पर|येथे|आहे)))"
)
_NUMBERED_START = re.compile(r"(?:H\.?\s?No|House|Plot|Flat|Apt|Door|मकान|प्लॉट|फ्लैट|फ़्लैट|घर|सदनिका)")
_HAS_STREET = re.compile(rf"\b{_STREET}\b|Sector\s+\d|Ward\s+\d|Residency|Apartments|Enclave|Towers")
_HAS_POSTAL = re.compile(rf"{_POSTAL}$")
_ADDRESS_WORDS = re.compile(r"(?:resid|address|posted to|lives? at|living at|wohnhaft|domicili|demeurant|पता|पत्ता|முகவரி|situated|delivered to)", re.I)

# ---- names ----------------------------------------------------------------------------------------------------------
# Titles (not part of a name).
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Smt|Shri|Sri|Kum|Prof|Adv|Master|MASTER|Baby\s+of|BABY\s+OF|Herr|Frau|Mme|Mlle|Sra|Sr|Srta|Don|Doña|श्रीमती|श्री|डॉ|कुमारी|सुश्री|திரு|திருமதி)"
_DEV_END = r"(?=\s+(?:का|की|के|ने|को|से|है|हैं|और|यांचा|यांनी|यांचे|यांना|आहे)(?![ऀ-ॿ])|\s*[,।;:(/<\[]|\s*$)"
# Cues before a name, all beginning with a capital so that the search skips quickly; those in lower case are looked up as they are.
_LEFT = re.compile(
    rf"(?:{_TITLE}\.?|(?:Contact\s+person|Patient(?:\s+name)?|Name|Nominee|Tenant|Lessee|Landlord|Lessor|Attn|Signatory)\s*:|Guarantor:?|Witness\s+\d+:?|I,|Nominee\s+is|Signed\s+by|Referred\s+by|As\s+told\s+by|On\s+behalf\s+of)\s+(?=[{_UP}])"
)
_LEFT_FRENCH = re.compile(rf"(?:locataire|bailleur|propriétaire|occupant|patient|par|à),?\s+M\.\s+(?=[{_UP}])")
_LEFT_LOWER = ("nominee is ", "signed by ", "told by ", "referred by ", "on behalf of ")
_RIGHT = (
    " may be reached", " may be contacted", ", residing at", ", resides at", " residing at", " resides at", ", hereby ", " holds card", " holds passport", " holds licen",
    " over the telephone", ", est joignable", ", ist unter", ", atiende", " (ID ", "; phone", ", mobile", ", phone", ", email", ", e-mail",
)
_TITLES = re.compile(rf"(?:{_TITLE}\.?\s+)+")
_NAME_HERE, _NAME_END = re.compile(_NAME), re.compile(rf"(?<![^\W_])(?:{_NAME})$")
_DEV_LEFT = ("श्री ", "श्रीमती ", "डॉ ", "डॉ. ", "सुश्री ", "कुमारी ", " का नाम ", " नाव ")
_DEV_HERE = re.compile(rf"(?:(?:श्रीमती|श्री|डॉ\.?|कुमारी|सुश्री)\s+)?(?P<c>{_DEVNAME}){_DEV_END}")
# Words that end the name of an organisation, or are roles, not people.
_ORGANISATION = re.compile(
    r"\b(?:Housing|Finance|Clinics?|Diagnostics|Holdings|Traders|Stores|Estates|Society|Hospital|Lab(?:oratory|s)?|Pathology|Bank|Ltd|Limited|Pvt|Inc|LLP|GmbH|Company|Co-operative|Corporation|Trust|University|Department|Office|Court|Act|Code|Registry|Desk|"
    r"Tenant|Landlord|Lessee|Lessor|Licensee|Licensor|Owner|Occupant|Party|Parties|Witness|Schedule|Section|Article|Clause|Agreement|Deed|Services|Associates|Imaging|Centre|Center|Medicals?|Reed)\b"
)
_BAD_START = re.compile(r"(?:Guarantor|Nominee|Witness|Tenant|Lessee|Lessor|Landlord|The|This|That|A|An|In|On|At|For|By|To|And|Or|If|No|Any|All|Each|Such|Both|Either|Neither|Send|Call|Please|Kindly|Notice|Notices|Stamp|Rent|Interest|Upon|Contact|Patient|Correspondence|Case|Receipt)\b,?\s+")


def luhn(digits: str) -> bool:
    """Luhn check of a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod-97 check of an account code such as an IBAN."""
    s = re.sub(r"\s", "", code).upper()
    return s[4:].isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def verhoeff(digits: str) -> bool:
    """Verhoeff check: permutations of the dihedral group of ten elements."""

    def times(a: int, b: int) -> int:
        return (a + b) % 5 + 5 * (b > 4) if a < 5 else (a - b) % 5 + 5 * (b < 5)

    def permute(n: int, x: int) -> int:
        for _ in range(n % 8):
            x = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x]
        return x

    c = 0
    for i, d in enumerate(reversed(digits)):
        c = times(c, permute(i, int(d)))
    return c == 0


_SENTENCE_END = re.compile(r"[^\W\d_]{4,}[.।?!]\s+")


def _near(t: str, s: int) -> str:
    """The text before ``s`` that may be its context, within its sentence."""
    x = t[max(0, s - BEFORE) : s]
    ends = [m.end() for m in _SENTENCE_END.finditer(x)]
    return x[ends[-1] :] if ends else x


_ASCII_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")


def _emails(t: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _AT.finditer(t):
        left = _LOCAL.search(t, max(0, m.start() - 66), m.start())
        right = _DOMAIN.match(t, m.end())
        if left and right:
            yield "email", left.start(), right.end(), 0.95


def _numbers(t: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _DIGITS.finditer(t):
        s, e = m.start(), m.end()
        if s and (t[s - 1].isalnum() or t[s - 1] in "/*#₹$€" or (t[s - 1] in "-.," and s > 1 and t[s - 2].isalnum())):
            continue
        raw = m.group().translate(_ASCII_DIGITS)
        if _DATE.match(raw):
            continue
        near, after = _near(t, s), t[e : e + AFTER]
        for kind, shape in (("id_number", _ID_SHAPE), ("phone", _PHONE_SHAPE)):
            f = shape.match(raw)
            if not f or (len(raw) > f.end() and raw[f.end()].isdigit()):
                continue
            end = s + f.end()
            if end == e and (t[e : e + 1].isalnum() or (t[e : e + 1] == "/" and t[e + 1 : e + 2].isdigit())):
                continue
            digits = re.sub(r"\D", "", f.group())
            negative = bool(_NOT_PERSON.search(near[-26:]))
            if kind == "id_number":
                ok = luhn(digits) if len(digits) == 16 else verhoeff(digits) or luhn(digits) if len(digits) == 12 else True
                score = (0.5 if len(digits) in (9, 12) else 0.3) + 0.2 * ok + 0.35 * bool(_ID_WORDS.search(near)) - 0.5 * negative - 0.3 * bool(_PHONE_WORDS.search(near[-14:]))
            else:
                if not 10 <= len(digits) <= 14:
                    continue
                strong = raw[0] in "+(" or raw.startswith("0") or len(digits) == 10
                score = 0.35 + 0.2 * strong + 0.35 * bool(_PHONE_WORDS.search(near) or _PHONE_WORDS.search(after)) - 0.5 * negative - 0.3 * bool(_ID_WORDS.search(near[-18:]))
            if score >= KEEP:
                yield kind, s, end, min(score, 1.0)
                break


def _coded(t: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _CODED.finditer(t):
        s, e = m.span()
        if (s and t[s - 1] in "/-*#") or t[e : e + 1] == "/":
            continue
        near, x = _near(t, s), m.group()
        shape = 0.55 if re.fullmatch(r"[A-Z]{5}\d{4}[A-Z]", x) else 0.5 if not x[1].isdigit() and "-" in x or " " in x and len(re.sub(r"\D", "", x)) == 13 else 0.35
        if re.fullmatch(r"[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?", x):
            shape = 0.9 if len(re.sub(r"\s", "", x)) >= 15 and mod97(x) else 0.1
        score = shape + 0.35 * bool(_ID_WORDS.search(near)) - 0.5 * bool(_NOT_PERSON.search(near[-26:]))
        if score >= KEEP:
            yield "id_number", s, e, min(score, 1.0)


def _addresses(t: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _ADDRESS.finditer(t):
        s, e = m.span()
        x = m.group()
        numbered, cue = bool(_NUMBERED_START.match(x)), bool(_ADDRESS_WORDS.search(_near(t, s)))
        score = 0.3 * numbered + 0.35 * bool(_HAS_POSTAL.search(x)) + 0.3 * cue + 0.2 * bool(_HAS_STREET.search(x)) - 0.3 * ("," not in x)
        if score >= KEEP:
            yield "address", s, e, min(score, 1.0)
    if "न" in t or "प" in t:
        for m in _ADDRESS_DEV.finditer(t):
            yield "address", m.start(), m.end(), 0.9


def _places(t: str, word: str) -> Iterator[int]:
    at = t.find(word)
    while at >= 0:
        yield at
        at = t.find(word, at + 1)


def _parts(name: str) -> int:
    """Words and initials of a name."""
    return sum(any(c.isalpha() for c in w) for w in name.split())


def _names(t: str) -> Iterator[tuple[str, int, int, float]]:
    t = t.replace("\n", " ")  # same offsets
    starts = [m.end() for m in _LEFT.finditer(t) if not (m.start() and t[m.start() - 1].isalnum())]
    starts += [m.end() for m in _LEFT_FRENCH.finditer(t)] if " M. " in t else []
    starts += [i + len(w) for w in _LEFT_LOWER for i in _places(t, w)]
    for s in starts:
        if x := _TITLES.match(t, s):
            s = x.end()
        m = _NAME_HERE.match(t, s)
        if m and len(max(m.group().split(), key=len)) > 2:
            yield "name", s, m.end(), 0.65 + 0.1 * (_parts(m.group()) > 1) - 0.6 * bool(_ORGANISATION.search(m.group()))
    for w in _RIGHT:
        for e in _places(t, w):
            m = _NAME_END.search(t, max(0, e - 90), e)
            if not m:
                continue
            s, x = m.start(), m.group()
            while b := _BAD_START.match(x) or _TITLES.match(x):
                s, x = s + b.end(), x[b.end() :]
            if _parts(x) > 1:
                yield "name", s, e, 0.7 - 0.6 * bool(_ORGANISATION.search(x))
    if "्" in t or "ड" in t or "न" in t:
        for w in _DEV_LEFT:
            for i in _places(t, w):
                m = _DEV_HERE.match(t, i + len(w)) if not (i and w[0] != " " and "ऀ" <= t[i - 1] <= "ॿ") else None
                if m:
                    yield "name", m.start("c"), m.end("c"), 0.8


_PROPOSERS = (_emails, _numbers, _coded, _addresses, _names)


def mentions(text: str) -> list[tuple[str, int, int, float]]:
    """The mentions of a text, in order and without overlap: (kind, start, end, score)."""
    found = sorted((p for f in _PROPOSERS for p in f(text) if p[3] >= KEEP), key=lambda p: (-p[3], p[1] - p[2], p[1]))
    return _disjoint(found)


def _disjoint(found: list) -> list:
    taken: list = []
    for p in found:
        if all(p[2] <= q[1] or p[1] >= q[2] for q in taken):
            taken.append(p)
    return sorted(taken, key=lambda p: p[1])


_FIELD_CUT = re.compile(r"\s*(?:[/<\[(|;]|\b[WDSC]\s*/\s*[Oo]\b\.?|\b(?:aged?|Age)\b|,?\s+\d)")
_FIELD_TITLE = re.compile(rf"^(?:\s|(?:{_TITLE}|MR|MRS|MS|DR|SMT|SHRI|Smt|मास्टर|बेबी)\.?(?=\s))+", re.I)
_RELATION = re.compile(r"\b[WDSC]\s*/\s*O\b\.?\s*", re.I)


def name_field_mentions(text: str) -> list[tuple[str, int, int, float]]:
    """The mentions of a field that is to hold a person's name and may hold more."""
    found = [p for f in (_emails, _numbers, _coded, _addresses) for p in f(text)]
    starts = [0] + [m.end() for m in _RELATION.finditer(text)]
    for at in starts:
        part = text[at:]
        skip = _FIELD_TITLE.match(part).end() if _FIELD_TITLE.match(part) else 0
        cut = _FIELD_CUT.search(part, skip)
        x = part[skip : cut.start() if cut else len(part)].rstrip(" ,;-\t\n")
        lead = len(x) - len(x.lstrip())
        if sum(c.isalpha() for c in x) > 1 and not _ORGANISATION.search(x):
            found.append(("name", at + skip + lead, at + skip + len(x), 0.9))
    return _disjoint(sorted(found, key=lambda p: (-p[3], p[1] - p[2], p[1])))


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each mention replaced by its placeholder."""
    out, at = [], 0
    for kind, s, e, _ in found:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*out, text[at:]])


def find(rows: DataFrame, key: str, text: str, field: bool = False) -> DataFrame:
    """``key, mentions, redacted``: mentions as ``array<struct<kind, start, end, mention, score>>``, and the text without them.

    ``field`` says that the column is to hold a person's name.  ``mention`` has each run of white space made one
    space.  Texts are searched whole, each row for itself (no shuffle), once per distinct value of a batch.  Null
    texts stay null with no mentions, empty ones empty; repeated rows give rows each; extra columns are ignored.
    """
    search = name_field_mentions if field else mentions

    def run(batches):
        for b in batches:
            codes, distinct = pd.factorize(b["t"])
            done = []
            for t in distinct:
                f = search(t)
                done.append(([{"kind": k, "start": s, "end": e, "mention": " ".join(t[s:e].split()), "score": round(float(x), 3)} for k, s, e, x in f], redact(t, f)))
            done.append(([], None))
            yield pd.DataFrame({"k": b["k"], "mentions": [done[c][0] for c in codes], "redacted": [done[c][1] for c in codes]})

    given = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return given.mapInPandas(run, "k long, mentions array<struct<kind:string,start:int,end:int,mention:string,score:double>>, redacted string").withColumnRenamed("k", key)
