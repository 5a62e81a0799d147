"""Text functions: numbers and units in prose, categories, markup, identifiers, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that mean "not told".
UNDISCLOSED = r"^\s*(\[\s*[●•*]?\s*\]|nil|n\.?a\.?|-+|—|not\s+(ascertainable|available|applicable|disclosed))\s*$"


def undisclosed(text: Column) -> Column:
    return F.lower(text).rlike(UNDISCLOSED)


def amount(text: Column) -> Column:
    """A number as Indian filings write it: digit groups of any size, (1,234.5) negative, a currency before, /- after; null if none."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?i)^(₹|rs\.?|inr)\s*", ""))
    bare = F.regexp_replace(bare, r"\s*/-$", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.startswith("-")
    digits = F.regexp_replace(F.regexp_replace(bare, r"^\(|\)$|^[-+]", ""), r"[,\s]", "")
    value = F.when(digits.rlike(r"^(\d+(\.\d*)?|\.\d+)$"), F.expr("true")).otherwise(F.lit(False))
    number = F.when(value, digits).try_cast("double")
    return F.when(~F.coalesce(undisclosed(text), F.lit(True)), F.when(negative, -number).otherwise(number))


#: Units by their words.
UNIT_WORDS = {"lakh": "INR_LAKHS", "crore": "INR_CRORES", "million": "INR_MILLIONS", "billion": "INR_BILLIONS", "thousand": "INR_THOUSANDS"}
_WORDS = "lakhs?|crores?|millions?|billions?|thousands?"


def unit(text: Column) -> Column:
    """The money unit that a heading declares; null if none.

    A statement ("amounts are stated in Rs. lakhs") wins over a bracket ("(₹ in
    crore)"), and that over any "in lakhs", "₹ in lakhs", "amount in lakhs", for
    which lakhs come before crores, millions, billions and thousands.
    """
    low = F.lower(text)
    stated = F.regexp_extract(low, rf"\b(?:amounts?|figures?|sums?)\s*(?:are\s*|is\s*)?(?:stated\s*|expressed\s*|presented\s*)?in\s+(?:inr|rs\.?|₹)?\s*({_WORDS})\b", 1)
    bracket = F.regexp_extract(low, rf"\(\s*(?:in\s+)?(?:inr|rs\.?|₹)\s*(?:in\s*)?({_WORDS})\s*\)", 1)
    named = F.create_map(*[F.lit(x) for kv in UNIT_WORDS.items() for x in kv])
    of = lambda word: F.try_element_at(named, F.regexp_replace(word, "s$", ""))
    loose = F.lit(None).cast("string")
    for word, name in reversed(UNIT_WORDS.items()):
        sign = r"|\bin\s+₹\s+millions?\b|₹\s+millions?\b" if word == "million" else r"|\brs\.?\s*in\s*" + word + r"s?\b" if word in ("lakh", "crore") else ""
        loose = F.when(low.rlike(rf"\bin\s+{word}s?\b{sign}"), name).otherwise(loose)
    return F.coalesce(of(F.nullif(stated, F.lit(""))), of(F.nullif(bracket, F.lit(""))), loose)


#: How many crore a unit is.
UNITS = {"INR_CRORES": 1.0, "INR_LAKHS": 0.01, "INR_MILLIONS": 0.1, "INR_BILLIONS": 100.0}


def in_crore(value: Column, unit_name: Column) -> Column:
    """Scaled to crore; an unknown unit is an error."""
    factor = F.lit(None).cast("double")
    for name, scale in UNITS.items():
        factor = F.when(unit_name == name, scale).otherwise(factor)
    return F.when(factor.isNotNull(), value * factor).otherwise(F.raise_error(F.concat(F.lit("unknown unit "), unit_name)).cast("double"))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, out: str = "category", most: int = 1000) -> DataFrame:
    """`rows` with the category of the longest prefix that their text starts with; prefixes: (prefix, category), each prefix once.

    The text's own starts of the prefixes' lengths are looked up by hash, which
    spares comparing every pair: in a literal map for up to `most` prefixes, else
    by a join for each length, of which there are few.
    """
    sizes = sorted((r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()), reverse=True)
    if not sizes:
        return rows.withColumn(out, F.lit(None).cast("string"))
    table = prefixes.limit(most + 1).collect()
    if len(table) <= most:
        known = F.create_map(*[F.lit(x) for r in table for x in (r["prefix"], r["category"])])
        return rows.withColumn(out, F.coalesce(*[F.try_element_at(known, F.substring(text, 1, n)) for n in sizes]))
    for n in sizes:
        side = prefixes.where(F.length("prefix") == n).select(F.col("prefix").alias(f"__p{n}"), F.col("category").alias(f"__c{n}"))
        rows = rows.join(side, F.substring(text, 1, n) == side[f"__p{n}"], "left")
    return rows.withColumn(out, F.coalesce(*[f"__c{n}" for n in sizes])).drop(*[f"__{k}{n}" for n in sizes for k in "pc"])


def is_elimination(text: Column) -> Column:
    return text.rlike(r"(?i)\beliminat(ed|ion|ions|ing)\b")


def is_revenue(category: Column) -> Column:
    return category.startswith("sale_of_")


#: The entities that pages use.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&euro;": "€", "&pound;": "£", "&#8377;": "₹", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """Lines of a page: scripts and styles gone, a line break for each tag, entities told, white space single, no empty lines."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", "\n")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(out, r"\r\n|[\n\r\x0B\f]"), lambda x: F.btrim(F.regexp_replace(x, r"[\s\u00a0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Other names of benchmarks.
BENCHMARKS = {"NIFTY50_TRI": "NIFTY_50_TRI", "NIFTY50": "NIFTY_50", "^NSEI": "NIFTY_50", "NIFTY_50_INDEX": "NIFTY_50"}


def benchmark_symbol(symbol: Column) -> Column:
    """Upper case, an underscore for each blank, other names of a benchmark made one."""
    bare = F.replace(F.upper(F.trim(symbol)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BENCHMARKS.items() for x in kv]), bare), bare)


def is_benchmark(symbol: Column) -> Column:
    return F.upper(symbol).contains("NIFTY")


def evaluation_id(ipo_id: Column, mode: Column, moment: Column, digest: Column) -> Column:
    return F.concat_ws("-", ipo_id, F.upper(mode), F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"), F.substring(digest, 1, 12))


def issuer_key(name: Column) -> Column:
    """A company's name without a closing Limited or Ltd, in capital letters and digits only."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.trim(name), r"(?i)\b(?:limited|ltd\.?)\s*$", "")), "[^A-Z0-9]", "")


def is_issuer_heading(text: Column, company: Column) -> Column:
    """Whether a heading is the company's own "<name> IPO ..."."""
    before = F.element_at(F.split(text, r"(?i)\s+IPO\b", 2), 1)
    return text.rlike(r"(?i)\s+IPO\b") & (issuer_key(before) == issuer_key(company))


#: Sections of a filing by their headings, in order of precedence.
SECTIONS = [
    ("the_offer", r"\bTHE\s+OFFER\b"),
    ("capital_structure", r"\bCAPITAL\s+STRUCTURE\b"),
    ("objects_of_the_offer", r"\bOBJECTS\s+OF\s+(?:THE\s+)?(?:OFFER|ISSUE)\b"),
    ("basis_for_offer_price", r"\bBASIS\s+(?:FOR|OF)\s+(?:THE\s+)?(?:OFFER|ISSUE)\s+PRICE\b"),
    ("industry_overview", r"\bINDUSTRY\s+OVERVIEW\b"),
    ("our_business", r"\bOUR\s+BUSINESS\b"),
    ("our_management", r"\b(?:OUR|THE)\s+MANAGEMENT\b"),
    ("promoters", r"\bOUR\s+PROMOTER(?:S|\s+AND\s+PROMOTER\s+GROUP)?\b"),
    ("restated_financials", r"\b(?:RESTATED\s+(?:CONSOLIDATED\s+)?FINANCIAL\s+INFORMATION|(?:RESTATED\s+)?(?:CONSOLIDATED\s+)?FINANCIAL\s+STATEMENTS)\b"),
    ("financial_indebtedness", r"\b(?:FINANCIAL\s+INDEBTEDNESS|CAPITALISATION\s+STATEMENT)\b"),
    ("litigation", r"\bOUTSTANDING\s+LITIGATION\b"),
    ("contingent_liabilities", r"\bSUMMARY\s+OF\s+CONTINGENT\s+LIABILITIES\b"),
    ("related_party", r"\bSUMMARY\s+OF\s+RELATED\s+PARTY\b"),
    ("offer_structure", r"\bOFFER\s+STRUCTURE\b"),
]


def section(heading: Column) -> Column:
    """The section that a heading opens, by the first pattern that fits; null if none does."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        found = F.when(heading.rlike("(?i)" + pattern), name).otherwise(found)
    return found


#: What leaves a board, and the words for it in order of precedence.
EXITS = ("resignation", "cessation", "retirement", "term_expiry")
BOARD_EVENTS = [
    ("resignation", "resign"),
    ("retirement", "retire|superannuat"),
    ("term_expiry", r"term\s+(?:of\s+(?:his|her|their)\s+office\s+)?(?:expired|expiry)|expiry\s+of\s+(?:the\s+|his\s+|her\s+)?term|completion\s+of\s+(?:his|her|their)\s+term|termination\s+of\s+(?:the\s+|his\s+|her\s+)?term|end\s+of\s+(?:the\s+|his\s+|her\s+)?term"),
    ("cessation", "cessation|ceased"),
    ("appointment", "appoint|regularis|regulariz|designat|induct|elevat"),
]


def board_event(reason: Column) -> Column:
    """What a filed reason tells of a board member; the most specific statement wins, `other` if none."""
    found = F.lit("other")
    for name, pattern in reversed(BOARD_EVENTS):
        found = F.when(F.lower(F.coalesce(reason, F.lit(""))).rlike(pattern), name).otherwise(found)
    return found


def is_exit(event: Column) -> Column:
    return F.coalesce(event.isin(*EXITS), F.lit(False))


def displayed_premium(shown: Column, sign: str = "₹") -> Column:
    """(state, amount) of a displayed grey-market value: MISSING (null or "Not quoted yet"), ZERO, AMOUNT or MALFORMED."""
    bare = F.trim(shown)
    mark = r"\s*%" if sign == "%" else ""
    front = r"(?:₹\s*)?" if sign != "%" else ""
    fits = bare.rlike(rf"^[+-]?\s*{front}[+-]?\s*\d+(?:,\d+)*(?:\.\d+)?{mark}$") & ~bare.rlike(r"[+-].*[+-]")
    value = F.regexp_replace(bare, r"[₹,%\s+]", "").try_cast("double")
    state = F.when(shown.isNull() | (bare == "Not quoted yet"), "MISSING").when(~fits | value.isNull(), "MALFORMED").when(value == 0, "ZERO").otherwise("AMOUNT")
    return F.struct(state.alias("state"), F.when(state.isin("ZERO", "AMOUNT"), value).alias("amount"))


def redacted_header(text: Column) -> Column:
    """Bearer tokens and key parameters hidden."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")
    return F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s&,;]+", "$1[REDACTED]")


def without_secret_keys(values: Column) -> Column:
    """A map without keys that name credentials."""
    return F.map_filter(values, lambda k, v: ~F.lower(k).rlike("(api_?key|token|secret|password|authorization|cookie)"))


def allowed_host(url: Column, hosts: list[str]) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("https", "http") & host.isin(hosts), F.lit(False))


def contains_text(column: Column, wanted: str) -> Column:
    """Case-insensitive substring; % and _ stand for themselves."""
    return F.lower(column).contains(wanted.lower())
