"""Text functions as Column -> Column; no Python UDFs, so they stay in generated code.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII by default; patterns that must see Unicode carry ``(?U)``.
Null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no identity.
PLACEHOLDERS = [
    "", "-", "--", ".", "..", "/", "n/a", "n/a.", "na", "n.a.", "n.a", "none", "no", "nil", "null", "redacted",
    "not provided", "not applicable", "self", "individual", "private", "anonymous", "confidential", "x", "xx", "test", "asdf",
]

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk net.uk sch.uk me.uk com.au net.au org.au edu.au gov.au co.jp or.jp ne.jp ac.jp go.jp lg.jp "
    "com.cn org.cn net.cn gov.cn edu.cn ac.cn co.kr or.kr go.kr re.kr ac.kr co.in org.in net.in gov.in ac.in "
    "com.br org.br gov.br edu.br co.za org.za gov.za ac.za co.nz org.nz govt.nz ac.nz com.tw org.tw gov.tw edu.tw "
    "com.sg org.sg gov.sg edu.sg com.mx gob.mx com.ar gob.es"
).split()
MORE_SUFFIXES = ["net.br", "eco.br"]

# Names and patterns of citation signals, in order; the last is weak on its own.
URL_PATTERN = r"""(?i)(?:https?://|www\.)[^\s<>"')\]]+"""
SIGNALS = [
    ("url", URL_PATTERN),
    ("doi", r"(?i)\b(?:doi:\s*|https?://(?:dx\.)?doi\.org/)10\.\d{4,9}/\S+"),
    ("etal", r"(?i)\bet\.?\s+al\b\.?"),
    ("peer_review", r"(?i)peer[-\s]?review"),
    ("pdf", r"(?i)\.pdf\b"),
    ("preprint", r"(?i)\b(?:arxiv|ssrn|zenodo|biorxiv|preprint)\b"),
    ("journal", r"(?i)\bjournals?\b"),
    ("paren_year", r"\((?:[^()]{0,40}?,\s*)?(?:19|20)\d{2}[a-z]?\)"),
]
WEAK_SIGNALS = ["paren_year"]

# Rows of letter keys.
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def norm_text(text: Column) -> Column:
    """Invisible characters dropped, space separators plain, line ends ``\\n``, runs collapsed, ``["..."]`` unwrapped."""
    steps = [
        (r"\p{Cf}", ""), (r"[\p{Zs}&&[^ ]]", " "), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r" *\n *", "\n"),
    ]
    out = reduce(lambda c, s: F.regexp_replace(c, *s), steps, text_or_empty(text))
    out = strip(out)
    inner = F.regexp_extract(out, r'^\["(.*)"\]$', 1)
    return F.when(out.rlike(r'^\["(.*)"\]$'), strip(inner)).otherwise(out)


def strip(text: Column) -> Column:
    """White space (Unicode) off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def norm_key(text: Column) -> Column:
    """Loose key of an option label."""
    out = F.translate(F.lower(norm_text(text)), "–—−’‘", "---''")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")


def normalize(text: Column) -> Column:
    """Lower case, white space runs to one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha1(text)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truncate(text: Column, limit: int) -> Column:
    """Collapsed; if longer than ``limit`` cut one short, trailing space off, and an ellipsis."""
    one = collapse(text)
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…"))).otherwise(one)


def quote_cut(text: Column, limit: int = 600) -> Column:
    """Cut at the last space before ``limit``; the text itself if it fits."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), head))


def checked_quote(text: Column, limit: int = 600, strict: bool = False) -> Column:
    """(quote, warning): the cut quote, and what was cut, or null; ``strict`` (second edition) raises instead."""
    cut = quote_cut(text, limit)
    long = F.length(text) > limit
    warning = F.when(long, F.concat(F.lit("quote "), F.length(text).cast("string"), F.lit(" chars, truncated to "), F.length(cut).cast("string"), F.lit(f" (limit {limit})")))
    if strict:
        cut = F.when(long, F.raise_error(F.concat(F.lit("quote of "), F.length(text).cast("string"), F.lit(f" chars, limit {limit}")))).otherwise(cut)
    return F.struct(cut.alias("quote"), warning.alias("warning"))


def story(text: Column, start: str, end: str, limit: int = 600) -> Column:
    """(quote, problem) of a slice between markers: no answer, no start, no end after it, or too long a quote."""
    slice_ = between_markers(text, start, end)
    problem = (
        F.when(text.isNull() | (text == ""), "no answer").when(F.locate(start, text) == 0, "no start marker").when(slice_.isNull(), "no end marker")
        .when(F.length(slice_) > limit, "too long")
    )
    return F.struct(F.when(problem.isNull(), slice_).alias("quote"), problem.alias("problem"))


def between_markers(text: Column, start: str, end: str) -> Column:
    """From ``start`` up to and with the next ``end``; null if either is missing."""
    at = F.locate(start, text)
    stop = F.locate(end, F.substr(text, at + len(start)))
    return F.when((at > 0) & (stop > 0), F.substr(text, at, F.lit(len(start) + len(end) - 1) + stop))


def find_urls(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(URL_PATTERN), F.lit(0))


def registrable_domain(url: Column, strict: bool = False, more_suffixes: list[str] | None = None) -> Column:
    """Registrable domain of a URL, empty if unusable; ``strict`` drops ``www.`` and asks for a plausible TLD."""
    host = F.regexp_replace(text_or_empty(url), r"(?i)^https?://", "")
    host = F.regexp_extract(host, r"^[^/?#]*", 0)
    host = F.lower(F.regexp_extract(F.regexp_extract(host, r"[^@]*$", 0), r"^[^:]*", 0))
    host = F.regexp_replace(host, r"""^[.,;:!'"]+|[.,;:!'"]+$""", "")
    if strict:
        host = F.regexp_replace(host, r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    known = two.isin([*TWO_LABEL_SUFFIXES, *(MORE_SUFFIXES if strict else []), *(more_suffixes or [])])
    domain = F.when(known & (n >= 3), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)
    fine = (n >= 2) & ~F.replace(host, F.lit("."), F.lit("")).rlike(r"^\d*$")
    if strict:
        fine = fine & F.element_at(labels, -1).rlike(r"^\p{L}{2,24}$")
    return F.when(F.when(n >= 2, fine).otherwise(False), domain).otherwise("")


def classify_domain(domain: Column, exact: dict[str, str], suffixes: list[tuple[str, str]]) -> Column:
    """Class by exact name, else by the first suffix rule that fits, else ``other``."""
    out = F.lit("other")
    for end, name in reversed(suffixes):
        out = F.when(domain.endswith(end), F.lit(name)).otherwise(out)
    if exact:
        out = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in exact.items() for x in kv)), domain), out)
    return out


def signals(text: Column) -> Column:
    """Names of the citation signals in a text, in their fixed order."""
    return F.array_compact(F.array(*(F.when(text_or_empty(text).rlike(p), F.lit(n)) for n, p in SIGNALS)))


def has_hard_signal(names: Column) -> Column:
    return F.size(F.array_except(names, F.array(*(F.lit(x) for x in WEAK_SIGNALS)))) > 0


def word_count(text: Column) -> Column:
    one = collapse(text)
    return F.when(one == "", 0).otherwise(F.size(F.split(one, " ")))


def likely_truncated(length: Column, limit: int = 4000, band: int = 0) -> Column:
    """At the cap, or up to ``band`` characters under it."""
    return length >= limit - band


def verbatim_in(quote: Column, stored: Column, gap: str = r"\[…\]") -> Column:
    """True if the quote's parts between gap marks occur in ``stored``, in order and without overlap."""
    parts = F.filter(F.transform(F.split(quote, gap), lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(
        parts,
        F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok")),
        lambda s, p: F.when(
            s["ok"] & (F.position(p, stored, s["at"]) > 0),
            F.struct((F.position(p, stored, s["at"]) + F.length(p)).alias("at"), F.lit(True).alias("ok")),
        ).otherwise(F.struct(s["at"].alias("at"), F.lit(False).alias("ok"))),
        lambda s: s["ok"],
    )


def vowel_ratio(text: Column) -> Column:
    letters = F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}]", "")
    return F.when(F.length(letters) == 0, 0.0).otherwise(F.length(F.regexp_replace(letters, "[^aeiou]", "")) / F.length(letters))


def is_single_repeated_character(text: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(text)), "[^0-9a-z]", "").rlike(r"^(.)\1*$")


def keyboard_pattern() -> str:
    """Three keys in a row, each next to the one before on one row of the keyboard, in either direction."""
    runs = sorted({row[a] + row[b] + row[c] for row in KEY_ROWS for b in range(len(row)) for a in (b - 1, b + 1) for c in (b - 1, b + 1) if 0 <= a < len(row) and 0 <= c < len(row)})
    # first letters apart, so that a place in a text is tried against each of them once and not against every run
    ends = {two: "".join(x[2] for x in runs if x[:2] == two) for two in sorted({x[:2] for x in runs})}
    return "|".join(f"{first}(?:{'|'.join(f'{two[1]}[{last}]' for two, last in ends.items() if two[0] == first)})" for first in sorted({two[0] for two in ends}))


def has_keyboard_run(text: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z]", "").rlike(keyboard_pattern())


def is_gibberish(text: Column, max_chars: int = 20, min_vowels: float = 0.30) -> Column:
    x = strip(text_or_empty(text))
    mashed = is_single_repeated_character(x) | (vowel_ratio(x) < min_vowels) | has_keyboard_run(x)
    return (x != "") & (F.length(x) < max_chars) & mashed


def is_placeholder(text: Column) -> Column:
    return normalize(text).isin(PLACEHOLDERS)


def is_substantive(text: Column, min_chars: int = 20, min_words: int = 4, min_vowels: float = 0.2) -> Column:
    """Prose: long enough, with enough distinct words of three letters, and vowels (y counts)."""
    x = F.lower(strip(text_or_empty(text)))
    words = F.array_distinct(F.regexp_extract_all(x, F.lit("[a-z]{3,}"), F.lit(0)))
    letters = F.regexp_replace(x, "[^a-z]", "")
    share = F.when(F.length(letters) > 0, F.length(F.regexp_replace(letters, "[^aeiouy]", "")) / F.length(letters)).otherwise(0.0)
    return (F.length(x) >= min_chars) & (F.size(words) >= min_words) & (share >= min_vowels)


# fixed values
REFERENCE_PATTERN = r"(?i)question[s]?\s*(\d{1,3})(?:\s*(?:[-–&,]|and|to)\s*(\d{1,3}))?"
SHORT_REFERENCE_PATTERN = r"\bQ\.?\s?(\d{1,3})\b"


def question_references(text: Column, own: Column, low: int = 3, high: int = 183, span: int = 12) -> Column:
    """Sorted numbers of the questions a text refers to, ranges of up to ``span`` expanded, without its own."""
    x = text_or_empty(text)
    first = F.regexp_extract_all(x, F.lit(REFERENCE_PATTERN), F.lit(1))
    second = F.regexp_extract_all(x, F.lit(REFERENCE_PATTERN), F.lit(2))

    def pair(a: Column, b: Column) -> Column:
        a, b = a.cast("int"), F.when(b != "", b).cast("int")
        near = (b > a) & (b - a <= span)
        return F.when(near, F.sequence(a, F.when(near, b).otherwise(a))).otherwise(F.array_compact(F.array(a, b)))

    ranged = F.flatten(F.zip_with(first, second, pair))
    short = F.transform(F.regexp_extract_all(x, F.lit(SHORT_REFERENCE_PATTERN), F.lit(1)), lambda v: v.cast("int"))
    every = F.array_distinct(F.concat(ranged, short))
    return F.array_sort(F.filter(every, lambda v: (v >= low) & (v <= high) & (v != own)))


def question_header(text: Column) -> dict[str, Column]:
    """Number, sub number, wording without its number, and id of a column header."""
    pattern = r"^\s*(\d{1,3})(?:\.(\d))?\.?\s*"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    sub = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("int")
    name = F.concat(F.format_string("Q%03d", number), F.when(sub.isNotNull(), F.concat(F.lit("_"), sub.cast("string"))).otherwise(""))
    return {"question_number": number, "sub_number": sub, "wording": strip(F.regexp_replace(text, pattern, "")), "question_id": F.when(number.isNotNull(), name)}


# Roles by the wording of a question; the first that is found wins.
ROLE_PATTERNS = [
    ("other_specify", r"""(?i)if you (selected|answered)\s*["'“]?other|^if you selected .other"""),
    ("reasons_support", r"(?i)reasons?\s+(for|of)\s+support"),
    ("reasons_oppose", r"(?i)why you are not support|not supportive|reasons?\s+(for|of)\s+concern|your concerns"),
    ("basis", r"(?i)basis for your assessment|basis for the assessment"),
    (
        "comment",
        r"(?i)please provide (any )?(additional )?(comments|context|explanations|further details|additional feedback)|additional comments"
        r"|additional context|please briefly explain|please explain why|please describe|please provide details",
    ),
]
# Roles by how a question opens: role, pattern, group or text of the condition, group of the parent.
OPENING_ROLES = [
    ("other_specify", r"""(?i)^if you (?:selected|answered)\s*["“‘']?\s*other\b""", "", None),
    ("comment", r"""(?i)^if you answered\s*["“‘']?\s*(yes|no)\s*["”’']?\s*to question\s*(\d{1,3})""", 1, 2),
    ("comment", r"(?i)^if you selected any of these approaches", "selected", None),
    ("comment", r"(?i)^please explain your answer to question\s*(\d{1,3})", "", 1),
    ("comment", r"(?i)^please provide context regarding your answer to question\s*(\d{1,3})", "", 1),
    ("comment", r"(?i)^please provide (?:any )?(?:additional )?(?:comments?|context|explanations?|further details|additional explanation)", "", None),
    ("comment", r"(?i)^for the additionality tests you selected.*?please provide commentary", "selected", None),
]


def role_anywhere(number: Column, text: Column, is_multi: Column, is_free: Column, profile: tuple[int, int] = (3, 17)) -> Column:
    """Role by patterns found anywhere; a reasons question that is no multi-select, or asks for comments, is a comment."""
    out = F.when(is_free, F.lit("free_text_primary")).otherwise("primary")
    asks = text.rlike(r"(?i)^\s*\d+\.\s*please provide (any )?(additional )?comments")
    for role, pattern in reversed(ROLE_PATTERNS):
        found = F.when(~asks & is_multi, F.lit(role)).otherwise("comment") if role.startswith("reasons") else F.lit(role)
        out = F.when(text.rlike(pattern), found).otherwise(out)
    return F.when(number.between(*profile), F.lit("profile")).otherwise(out)


def role_at_start(number: Column, text: Column, is_free: Column, profile: tuple[int, int] = (3, 17)) -> Column:
    """(role, condition, parent) by how the wording opens."""

    def found(role: object, condition: object, parent: object) -> Column:
        return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), condition.alias("condition"), parent.cast("int").alias("parent"))

    none = F.lit(None)
    out = F.when(number.between(*profile), found("profile", F.lit(""), none)).otherwise(
        found(F.when(is_free, "free_text_primary").otherwise("primary"), F.lit(""), none)
    )
    for role, pattern, condition, group in reversed(OPENING_ROLES):
        said = F.lower(F.regexp_extract(text, pattern, condition)) if isinstance(condition, int) else F.lit(condition)
        parent = F.nullif(F.regexp_extract(text, pattern, group), F.lit("")) if group else none
        out = F.when(text.rlike(pattern), found(role, said, parent)).otherwise(out)
    return out


def join_ids(ids: Column) -> Column:
    """Numbers sorted as numbers, joined by ``|``."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), "|")


def split_ids(text: Column) -> Column:
    return F.transform(F.filter(F.split(text_or_empty(text), r"\|"), lambda x: x != ""), lambda x: x.try_cast("bigint"))


def int_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text.cast("string")).try_cast("int"), F.lit(0))


def parse_year(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}$"), text.try_cast("int"))


def iso_date_in(text: Column) -> Column:
    """The date of a ``YYYY.MM.DD`` in a file name; null without one."""
    return F.try_to_date(F.regexp_extract(text, r"(\d{4}\.\d{2}\.\d{2})", 1), "yyyy.MM.dd")


def attribution(name: Column, redacted: Column, kind: Column, country: Column) -> Column:
    who = F.when(redacted, F.lit("Redacted")).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("Not provided")))
    return F.concat(who, F.lit(" — "), F.coalesce(kind, F.lit("")), F.lit(", "), F.coalesce(country, F.lit("")))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first ``(name, pattern)`` found, letters of either case."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike("(?iu)" + pattern), F.lit(name)).otherwise(out)
    return out


def is_not_applicable(text: Column) -> Column:
    return normalize(text).rlike(r"^(n\s*/?\s*a|not applicable|none|nil|no comments?)\.?$")


def short_label(text: Column, limit: int = 40) -> Column:
    """Parenthesised tails off, then clipped."""
    return truncate(F.regexp_replace(text_or_empty(text), r"\s*\([^)]*\)\s*$", ""), limit)


def humanise(text: Column) -> Column:
    words = F.trim(F.regexp_replace(text_or_empty(text), "[_-]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Lower-case letters that decompose (NFKD, marks off) to one plain letter or digit, what they become, then the marks; and
    the Latin ligatures, which become several."""
    one, several, marks = {}, {}, ""
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.combining(c):
            marks += c
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain and c == c.lower() and plain.isascii() and plain.isalnum():
            if len(plain) == 1:
                one[c] = plain
            elif code < 0x250 or 0xFB00 <= code < 0xFB07:
                several[c] = plain
    return "".join(one) + marks, "".join(one.values()), several


_DECOMPOSED, _PLAIN, _LIGATURES = _decompositions()
# fixed values
_LEGAL = r"inc|llc|ltd|limited|plc|gmbh|ag|sa|sas|bv|nv|spa|srl|oy|ab|as|co|corp|corporation|company|pty|llp|lp|kk|kg|group|holding|holdings|international"
_CJK = r"[⺀-鿿가-힯＀-￯]"


def unaccented(text: Column) -> Column:
    """Lower case, in full compatibility decomposition and without marks; letters that do not decompose stay as they are."""
    x = F.translate(F.lower(text_or_empty(text)), _DECOMPOSED, _PLAIN)
    for c, plain in _LIGATURES.items():
        x = F.replace(x, F.lit(c), F.lit(plain))
    return x


def entity_key(name: Column, min_chars: int = 3) -> Column:
    """Key of an organisation across data sets: no CJK, accents, parentheses, titles, legal forms or leading "the".

    What is left of fewer than ``min_chars`` characters is no key: empty."""
    x = F.regexp_replace(text_or_empty(name), _CJK, " ")
    x = unaccented(x)
    for pattern in (r"\([^)]*\)", r"^.*?\bon behalf of\b", r"\b(dr|mr|mrs|ms|prof)\b\.?", "[^a-z0-9]+", rf"\b(?:{_LEGAL})\b", r"^\s*the\b"):
        x = F.regexp_replace(x, pattern, " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(x) >= min_chars, x).otherwise("")


def short_text(text: Column, n: int = 120) -> Column:
    """The first ``n`` characters, whatever they are."""
    return F.substring(text, 1, n)
