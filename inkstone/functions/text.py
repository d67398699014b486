"""Text as Column expressions: normalisation, protection of dots, sentences, tokens, predicates.

Everything here stays in the JVM.  Patterns take Unicode letters as (?U) or by
property, so that accented words are whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]"
DOT = "<PERIOD>"
# fixed values: abbreviations whose dot ends no sentence
ABBREVIATIONS = (
    "AIR", "SCC", "SCR", "Cr", "Cr.L.J", "L.J", "All", "Mad", "Cal", "Bom", "Del", "SC", "ILR", "Comp", "Cas", "SCALE", "JT", "Supp", "KLT", "CTC",
    "v", "vs", "Ors", "Anr", "No", "Nos", "Art", "Arts", "Sec", "Secs", "Cl", "para", "paras", "Ref", "App", "Appl", "Govt", "Ltd", "Pvt", "Corp",
    "Hon'ble", "Hon", "Mr", "Mrs", "Ms", "Dr", "Prof", "C.J", "C.J.I", "J", "JJ", "ibid", "id", "viz", "e.g", "i.e", "al", "etc",
)
# fixed values: citation shapes whose dots end no sentence
CITATIONS = (
    r"(?iU)\bA\.?I\.?R\.?\s*(?:\d{4})?\s*(?:[A-Z][A-Za-z.]*)?\s*(?:\d+)?",
    r"(?iU)\(\d{4}\)\s*\d*\s*S\.?C\.?C\.?(?:\s*\(Supp\))?\s*\d+",
    r"(?iU)[\[\(]\d{4}[\]\)]\s*\d*\s*S\.?C\.?R\.?\s*\d+",
    r"(?iU)\b(?:Sec|Secs|Art|Arts|S|cl)\.\s*\d+",
    r"(?iU)\b(?:v|vs)\.",
    r"(?iU)\bNo\.\s*\d+",
    r"(?U)\b[A-Z]\.(?=\s*[A-Z])",
)
# fixed values: marks of scanning errors
OCR_MARKERS = ("vil Appeal", "minal Appeal", "rit Petition", "pecial Leave", "ivil Appeal")
# fixed values: nouns of proceedings, and fragments before them that are words
OCR_NOUNS = ("Appeal", "Petition", "Application", "Suit", "Reference", "Revision")
OCR_ALLOWED = ("in", "the", "this", "an", "cross", "first", "second", "leave")
# fixed values: English words without weight; legal terms such as "held" are not among them
STOPWORDS = tuple("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())


def lit_list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def normalize_ws(t: Column) -> Column:
    """ST1: line ends to \\n, runs of space and tab to one space."""
    return F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{WS}+|{WS}+$", "")


def is_blank(t: Column) -> Column:
    """PF1."""
    return t.isNull() | (F.length(strip(t)) == 0)


def is_near_empty(t: Column, least: int = 50) -> Column:
    """PF2: under ``least`` characters without the white space around them."""
    return F.length(strip(F.coalesce(t, F.lit("")))) < least


def protect_dates(t: Column) -> Column:
    """ST2: the dots inside day.month.year; white space before the year goes."""
    return F.regexp_replace(t, r"(?U)\b(\d{1,2}(?:/\d{1,2})?)\.(\d{1,2})\.\s*(\d{2,4})\b", f"$1{DOT}$2{DOT}$3")


def protect_decimals(t: Column) -> Column:
    """ST6: (digits).(digits), not overlapping."""
    return F.regexp_replace(t, r"([0-9]+)\.([0-9]+)", f"$1{DOT}$2")


def protect_matches(t: Column, pattern: str) -> Column:
    """ST3: every dot inside a match, as matches are marked, split off and replaced."""
    marked = F.regexp_replace(t, f"({pattern})" if not pattern.startswith("(?") else pattern[: pattern.index(")") + 1] + "(" + pattern[pattern.index(")") + 1 :] + ")", "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.when(F.instr(p, "\u0002") > 0, F.concat(F.replace(F.substring_index(p, "\u0002", 1), F.lit("."), F.lit(DOT)), F.substring_index(p, "\u0002", -1))).otherwise(p))
    return F.array_join(parts, "")


def protect_abbreviations(t: Column) -> Column:
    """ST5: all abbreviations in one pass, longest first; sequential passes give the same, as a match ends with its dot."""
    longest = sorted(ABBREVIATIONS, key=lambda a: (-len(a), a))
    return protect_matches(t, r"(?iU)\b(?:" + "|".join(a.replace(".", r"\.") for a in longest) + r")\.")


def protect_citations(t: Column) -> Column:
    """ST8: dates, citations, abbreviations, decimals; null is empty."""
    t = protect_dates(F.coalesce(t, F.lit("")))
    for p in CITATIONS:
        t = protect_matches(t, p)
    return protect_decimals(protect_abbreviations(t))


def restore(t: Column) -> Column:
    """ST7."""
    return F.replace(t, F.lit(DOT), F.lit("."))


def rule_sentences(t: Column) -> Column:
    """ST9 by rule: array of trimmed sentences that end with . ! or ? before white space."""
    cut = F.split(F.regexp_replace(normalize_ws(F.coalesce(t, F.lit(""))), rf"([.!?]){WS}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) > 0)


def legal_sentences(t: Column) -> Column:
    """ST9 with the dots of citations protected first."""
    return F.transform(rule_sentences(protect_citations(t)), restore)


def _whole(t: Column, word: str) -> Column:
    """Whole words of a form in lower case, without stopwords; one pass of one pattern, and a hash look-up a word."""
    found = F.regexp_extract_all(F.lower(t), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def tokens_a(t: Column) -> Column:
    """ST10: letters and digits, no stopwords; the lemma is the word."""
    return _whole(t, r"[\p{L}\p{N}]++")


def tokens_b(t: Column) -> Column:
    """ST11: words of two or more a-z, no stopwords."""
    return _whole(t, "[a-z]{2,}+")


def tokens_rouge(t: Column) -> Column:
    """ST14 without stemming."""
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def word_count(t: Column) -> Column:
    """ST19."""
    return F.size(F.filter(F.split(t, rf"{WS}+"), lambda w: F.length(w) > 0))


def ngrams(tokens: Column, n: int) -> Column:
    """ST18: runs of n tokens, joined by a space."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def ellipsis(t: Column, most: int = 110) -> Column:
    """PF15: one line of at most ``most`` characters."""
    s = F.regexp_replace(strip(t), "[\r\n]", " ")
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def snippet(t: Column) -> Column:
    """PF5's sample: the first 150 and the last 80 characters."""
    return F.concat(F.substring(t, 1, 150), F.lit(" ... "), F.substring(t, -80, 80))


def ner_proxy(t: Column) -> Column:
    """ST15 by rule: the number of runs of capitalised words."""
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"))


def entities_proxy(t: Column) -> Column:
    """ST16 by rule: (text, label) of those runs."""
    return F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(\b[A-Z][a-z]+(?: [A-Z][a-z]+)*)")), lambda e: F.struct(e.alias("text"), F.lit("PROXY").alias("label")))


# fixed values: the three patterns below, and the prefix of 3,000 characters in which they look
def ocr_truncated(t: Column) -> Column:
    """PF6: the first line of the prefix that begins with a fragment before a proceeding's noun."""
    found = F.lower(F.regexp_extract(F.substring(t, 1, 3000), rf"(?:^|\n){WS}*([a-z]{{1,5}}){WS}+(?:{'|'.join(OCR_NOUNS)})\b", 1))
    return (found != "") & ~found.isin(*OCR_ALLOWED)


def ocr_symbols(t: Column) -> Column:
    """PF7: three or more symbols in a row."""
    return F.substring(t, 1, 3000).rlike(r"[^\p{L}\p{N}_ \t\n\r\f.,;:?!'\"]{3,}")


def ocr_spaced(t: Column) -> Column:
    """PF8: five or more single letters at the start of a line."""
    return F.substring(t, 1, 3000).rlike(rf"(?:^|\n){WS}*(?:[a-zA-Z]{WS}+){{4,}}[a-zA-Z]")


def ocr_marker(t: Column) -> Column:
    """PF9: any of the markers; it over-fires, as they are parts of right words."""
    out = F.lit(False)
    for m in OCR_MARKERS:
        out = out | F.contains(t, F.lit(m))
    return out


def length_bucket(m: Column) -> Column:
    """PF3."""
    return F.when(m < 20, "short").when(m <= 500, "medium").otherwise("long")


def audit_flag(m: Column) -> Column:
    """PF4."""
    return F.when(m < 20, "few").when(m > 500, "many").otherwise("ok")


def budget(m: Column, share: float = 0.05, least: int = 3) -> Column:
    """TK3: at least 3, else 5 % of the sentences, half to even."""
    return F.greatest(F.lit(least), F.bround(F.lit(share).cast("double") * m).cast("int"))
