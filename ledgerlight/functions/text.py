"""Text predicates and normalisers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and patterns that results hang on.
BOILERPLATE_MARKERS = ("safe harbor statement", "forward-looking statements", "forward looking statements", "table of contents", "disclaimer")
BOILERPLATE_BLOCK = r"(?i)regd\.?\s*&?\s*corporate office|registered office|corporate office|\bcin\s*:|\bwebsite\s*:|\bemail\s*:|\bphone\s*:|\bfax\s*:|\btel\s*:"
PAGE_TYPES = (
    ("auditor_report", ("independent auditor", "review report", "sre 2410", "chartered accountants", "udin", "we have reviewed the accompanying", "auditor's responsibility", "review engagements", "audit opinion")),
    ("security_cover", ("statement of security cover", "debenture trustee", "security cover")),
    ("board_notice", ("outcome of board meeting", "intimation under regulation", "trading window")),
)
SECTIONS = (
    ("management discussion and analysis", "Management Discussion & Analysis"), ("management discussion", "Management Discussion & Analysis"),
    ("financial highlights", "Financial Highlights"), ("financial results", "Financial Results"), ("balance sheet", "Balance Sheet"),
    ("statement of assets", "Balance Sheet"), ("statement of liabilities", "Balance Sheet"), ("income statement", "Income Statement"),
    ("statement of profit", "Income Statement"), ("profit and loss", "Income Statement"), ("cash flow", "Cash Flow"), ("notes to accounts", "Notes"),
    ("notes", "Notes"), ("risk factors", "Risk Factors"), ("guidance", "Guidance"), ("outlook", "Outlook"), ("segment", "Segment Information"),
    ("share capital", "Share Capital"), ("earnings call", "Earnings Call"), ("question and answer", "Q&A"), ("conference call", "Conference Call"),
)
NOISE = (
    r"\S+@\S+\.\S+", r"\bwww\.\S+", r"\bCIN\s*:?\s*[A-Z0-9]{15,25}", r"Regd\.?\s*&?\s*Corporate Office.*", r"Registered Office.*",
    r"Copyright\s*(\(c\)|©)?.*", r"Page\s+\d+\s+of\s+\d+",
)
MOJIBAKE = (("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("â€¢", "-"), ("Â®", "®"), ("Â©", "©"), ("Â°", "°"), ("Â", ""))
FILLERS = ("uh", "um", "you know", "sort of", "kind of", "okay")
SPOKEN_TERMS = (
    ("ebit da", "EBITDA"), ("e bit da", "EBITDA"), ("gross n p a", "Gross NPA"), ("net n p a", "Net NPA"), ("a u m", "AUM"), ("profit after tax", "PAT"),
    ("year on year", "YoY"), ("quarter on quarter", "QoQ"), ("p p o p", "PPOP"), ("return on assets", "ROA"), ("return on equity", "ROE"), ("c a s a", "CASA"),
    ("net interest margin", "NIM"), ("c a g r", "CAGR"), ("earnings per share", "EPS"), ("book value", "Book Value"), ("operating margin", "Operating Margin"),
    ("provision coverage ratio", "PCR"), ("cost of funds", "Cost of Funds"), ("assets under management", "AUM"), ("gross non performing assets", "Gross NPA"),
    ("net non performing assets", "Net NPA"), ("credit access gramm in", "CreditAccess Grameen's"), ("credit access gramm", "CreditAccess Grameen"),
    ("motilaal oswal", "Motilal Oswal"), ("motilal orstral", "Motilal Oswal"), ("delicacies", "delinquencies"), ("cut-em-as", "customers"),
    ("cut income ratio", "cost-to-income ratio"), ("oricial poisoning", "overall provisioning"), ("a&m position", "ALM position"),
    ("easier coverage", "ECL coverage"), ("easier provisioning", "ECL provisioning"),
)
OPERATOR_SAYS = r"next question is from the line of|please go ahead|please show a hand|ladies and gentlemen|welcome to the|we will now begin the question"
ANALYST_SAYS = r"thank you for the opportunity|thanks for the opportunity|thank you for giving me the opportunity|thank you for giving the opportunity"
NUMERIC_WORDS = (
    r"\b(how much|how many|what was|what is|what are|total|revenue|profit|income|margin|ebitda|growth|percentage|percent|rate|amount|figures?|"
    r"value|pat|pbt|eps|disburs|volume|gmv|expense|cost|tax|billing|yoy|qoq|quarter[\s-]on[\s-]quarter|quarter[\s-]over[\s-]quarter|"
    r"year[\s-]on[\s-]year|year[\s-]over[\s-]year|sequentially|rs\.?|million|billion|crore|lakh)\b|₹"
)
QUALITATIVE_WORDS = r"\b(what did management say|why|outlook|risk|guidance|highlight|strategy|opinion|sentiment|milestone|initiative|management)\b"
SYNONYMS = (
    ("revenue", "income sales turnover"), ("profit", "PAT earnings net income"), ("margin", "profitability"), ("growth", "increase change"),
    ("guidance", "outlook forecast"), ("eps", "earnings per share"), ("ebitda", "operating profit"), ("expenses", "costs expenditure"),
)
COMPANY_WORDS = r"\b(limited|ltd|incorporated|inc|corp|corporation|company|co)\b"
REFUSAL = (
    r"(?i)\b(does not contain|no information|not (?:explicitly )?(?:mentioned|available|stated|found|provided)|cannot find|could not find|"
    r"unable to (?:find|determine)|not present in the (?:evidence|text|data))\b"
)
ABSTAINS = (
    "does not contain", "doesn't contain", "not contain this information", "cannot determine", "can't determine", "no information", "not available in the",
    "unable to determine", "not found in the", "insufficient evidence", "does not provide", "did not provide", "did not contain", "did not mention",
    "does not mention", "was not provided", "was not discussed", "were not discussed", "was not mentioned", "were not mentioned",
)
METRIC_ALIASES = (
    ("revenue from operations", ("revenue from operations", "revenue")), ("revenue", ("revenue from operations", "revenue")),
    ("net profit", ("net profit", "profit after tax", "profit for the period")), ("profit after tax", ("profit after tax", "net profit")),
    ("basic eps", ("basic eps", "earnings per share")), ("earnings per share", ("earnings per share", "basic eps")), ("ebitda", ("ebitda",)),
    ("pat", ("pat", "profit after tax", "net profit")),
)
CONTACT_CELLS = ("registered office", "cin", "website", "email", "phone", "fax", "tel", "gstin", "toll free")


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each, so that the optimizer does not copy long expressions into their uses."""
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("t_")).select("t_.*")


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether one of the needles stands in the text."""
    return reduce(lambda a, b: a | b, [text.contains(x) for x in needles])


def hits(text: Column, needles: tuple[str, ...]) -> Column:
    """How many of the needles stand in the text."""
    return reduce(lambda a, b: a + b, [text.contains(x).cast("int") for x in needles])


def squash(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key(text: Column) -> Column:
    """Lower case with single spaces; null gives ''."""
    return F.lower(squash(F.coalesce(text, F.lit(""))))


def company_key(name: Column) -> Column:
    """Company name without brackets, signs and legal forms."""
    flat = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\([^)]*\)", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r"[^a-z0-9]+", " "), COMPANY_WORDS, " ")
    return F.regexp_replace(flat, r"[^a-z0-9]", "")


def same_company(a: Column, b: Column) -> Column:
    """Equal keys, or one within the other; an empty key matches nothing."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def signature(text: Column, size: int = 300) -> Column:
    """The first letters and digits, for near-duplicate collapse."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", ""), 1, size)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def clean_evidence(text: Column) -> Column:
    """Repairs mis-decoded signs, drops contact and page noise, squeezes blanks."""
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    text = F.regexp_replace(text, "â€.", "")
    for pattern in NOISE:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def clean_speech(text: Column) -> Column:
    """White space and filler words of a transcript; a filler goes where it stands between spaces, one pass per filler."""
    flat = F.regexp_replace(text, r"\s+", " ")
    for word in FILLERS:
        flat = F.replace(flat, F.lit(f" {word} "), F.lit(" "))
    return F.trim(flat)


def spoken_terms(text: Column) -> Column:
    """Spelled-out terms and known mishearings, replaced in declared order wherever they stand, whatever their case."""
    for said, meant in SPOKEN_TERMS:
        text = F.regexp_replace(text, rf"(?i)\Q{said}\E", meant)
    return text


def speaker_role(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(OPERATOR_SAYS), "Operator").when(low.rlike(ANALYST_SAYS), "Analyst")


def statement_type(text: Column) -> Column:
    """Standalone or Consolidated where exactly one of the words stands in the text."""
    a, b = text.rlike(r"(?i)\bstandalone\b"), text.rlike(r"(?i)\bconsolidated\b")
    return F.when(a & ~b, "Standalone").when(b & ~a, "Consolidated")


def statement_heading(text: Column) -> Column:
    """The kind named in a results heading, else the first kind before 'financial' or 'results', standalone first."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    m = F.regexp_extract(low, r"statement of .*?\b(standalone|consolidated)\b .*?\bfinancial results\b", 1)
    return F.when(m != "", m).when(low.rlike(r"\bstandalone\b\s+(?:financial|results)"), "standalone").when(low.rlike(r"\bconsolidated\b\s+(?:financial|results)"), "consolidated")


def is_numeric_question(q: Column) -> Column:
    """More numeric than qualitative hits."""
    count = lambda p: F.size(F.regexp_extract_all(F.lower(q), F.lit(p), 0))
    return count(NUMERIC_WORDS) > count(QUALITATIVE_WORDS)


def expand_synonyms(q: Column) -> Column:
    """The question with synonyms of its whole words appended."""
    extra = [F.when(q.rlike(rf"(?i)\b{w}\b"), F.lit(more)) for w, more in SYNONYMS]
    return F.concat_ws(" ", q, *extra)


def is_boilerplate_chunk(text: Column, most: int = 600) -> Column:
    return (F.length(text) <= most) & any_of(F.lower(text), BOILERPLATE_MARKERS)


def is_boilerplate_block(text: Column, most: int = 300) -> Column:
    return (F.length(text) <= most) & (F.size(F.regexp_extract_all(text, F.lit(BOILERPLATE_BLOCK), 0)) >= 2)


def page_type(text: Column, least: int = 2) -> Column:
    """The type with most keyword hits, the first declared on ties, if it has at least two; else financial_statement."""
    low = F.lower(text)
    scores = [hits(low, words) for _, words in PAGE_TYPES]
    best = F.greatest(*scores)
    out = None
    for (name, _), score in zip(PAGE_TYPES, scores, strict=True):
        fits = (score == best) & (best >= least)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("financial_statement")


def section_of(text: Column) -> Column:
    """The first declared section whose words stand in the text."""
    low = F.lower(text)
    out = None
    for words, name in SECTIONS:
        out = F.when(low.contains(words), name) if out is None else out.when(low.contains(words), name)
    return out


def is_heading(text: Column, font: Column, bold: Column) -> Column:
    """Large type, short bold lines, capitals or numbered headings, unless mostly signs."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1))
    shape = (font >= 13) | (bold & (font >= 10) & (F.length(text) < 90) & ~text.endswith(".")) | ((F.upper(text) == text) & (F.length(text) < 80) & text.rlike("[A-Z]")) | text.rlike(r"^\d+(\.\d+)*[.)]?\s+[A-Z]")
    return shape & (letters >= 0.6)


def requested_statement(question: Column, stated: Column | None = None) -> Column:
    """The statement type stated beside the question, else named in it, else consolidated for numeric questions."""
    q = F.coalesce(question, F.lit(""))
    out = F.when(q.rlike(r"(?i)\bstandalone\b"), "standalone").when(q.rlike(r"(?i)\bconsolidated\b"), "consolidated").when(is_numeric_question(q), "consolidated")
    return out if stated is None else F.coalesce(F.when(F.lower(stated).isin("standalone", "consolidated"), F.lower(stated)), out)


def statement_tag(title: Column, section: Column, document: Column, text: Column) -> Column:
    """'**[Standalone figures]**' and a new line, or the like, where the parts name one kind; else ''."""
    kind = statement_type(F.concat_ws(" ", title, section, document, F.substring(text, 1, 500)))
    return F.coalesce(F.concat(F.lit("**["), kind, F.lit(" figures]**\n")), F.lit(""))


def metric_phrases(question: Column) -> Column:
    """Spellings of the metrics named in a question, the longest first, once each."""
    low = F.lower(F.coalesce(question, F.lit("")))
    found = F.flatten(F.array(*[F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in METRIC_ALIASES]))
    ranked = F.array_sort(F.transform(F.array_distinct(found), lambda x: F.struct(-F.length(x), F.array_position(F.array_distinct(found), x), x.alias("x"))))
    return F.transform(ranked, lambda r: r["x"])


def is_refusal(answer: Column) -> Column:
    """A 'not found' answer instead of an attempt."""
    return F.coalesce(answer, F.lit("")).rlike(REFUSAL)


def abstained(answer: Column) -> Column:
    """The scores' wider test of a declined answer."""
    return any_of(F.lower(F.coalesce(answer, F.lit(""))), ABSTAINS)


def is_tiny(text: Column, most: int = 15) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")) <= most


def stripped_length(text: Column) -> Column:
    """Length without white space at the ends."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def is_boilerplate_table(headers: Column, rows: Column, most: int = 300) -> Column:
    """A small table of contact details: two pattern hits in its cells, or two cells with a contact word."""
    cells = F.filter(F.transform(F.flatten(F.concat(F.array(headers), rows)), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")), lambda c: c != "")
    flat = F.array_join(cells, " ")
    hits_ = F.size(F.regexp_extract_all(flat, F.lit(BOILERPLATE_BLOCK), 0))
    return (F.size(cells) > 0) & (F.length(flat) <= most) & ((hits_ >= 2) | (F.size(F.filter(cells, lambda c: any_of(F.lower(c), CONTACT_CELLS))) >= 2))


def split_companies(names: Column) -> Column:
    """The companies of a field that joins several; a single one, or none, stays as it is."""
    parts = F.filter(F.transform(F.split(names, r"(?i)\s+(?:vs\.?|versus|and)\s+|\s*/\s*|\s*,\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(names))


def all_companies(names: Column) -> Column:
    return F.coalesce(names, F.lit("")).rlike(r"(?i)^\s*all(?:\s+companies)?\s*$")
