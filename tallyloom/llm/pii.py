"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and mail addresses.

DataFrame functions only. A match becomes a list of small integers, each with its own radix (a digit 10, an
octet 256, a letter 26, a year 200, ...), so whatever the rounds produce has the same format. Rounds add a
keyed hash of one half to the other half, place by place modulo the radix, and so can be undone. Equal
values map to equal pseudonyms whatever document or separators they come in; check digits are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "iso_date": _EDGE + r"(?<![-.])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])" + _END + r"(?!-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + _END,
    "ssn": _EDGE + r"(?<!-)(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END + r"(?!-[0-9])",
    "ip": _EDGE + r"(?<!\.)(?:" + _OCTET + r"\.){3}" + _OCTET + _END + r"(?!\.[0-9])",
}
#: Digit groups of 13 digits or more together, as far as the next match of another kind; ``_card`` looks for cards in them.
_OTHER = "(?!" + "|".join(p for kind, p in PATTERNS.items() if kind != "email") + ")"
_GROUP = r"[0-9]++" + _END + r"(?!\.[0-9])(?!-" + _OTHER + r"[0-9]++(?:[A-Za-z]|\.[0-9]))"
PATTERNS["card"] = _EDGE + r"(?<![-.])(?=[0-9](?:[ \-]?[0-9]){12})" + _GROUP + r"(?:[ \-]" + _OTHER + _GROUP + ")*+"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Without mail addresses a match starts with one of a few characters, which is quick to tell at each place.
_NUMBERS = r"(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "email") + ")"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Sum over a digit string whose last digit is the check digit, by Luhn's rule."""
    return F.aggregate(
        F.transform(F.reverse(_ints(digits)), lambda d, i: F.when(i % 2 == 0, d).otherwise((d * 2).cast("int") - F.when(d > 4, 9).otherwise(0))),
        F.lit(0), lambda s, d: s + d.cast("int"),
    )


def feistel(values: Column, radices: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Keyed permutation of integer lists, place by place below ``radices``; ``undo`` turns it back.

    A list of one has an empty second half, so its value is shifted by a constant of the key.
    """
    cut = F.ceil(F.size(values) / 2).cast("int")

    def half(x: Column, second: bool) -> Column:
        return F.slice(x, cut + 1, F.size(x) - cut) if second else F.slice(x, F.lit(1), cut)

    def shifted(side: Column, other: Column, radix: Column, step: Column) -> Column:
        mask = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), F.array_join(other, ",")), 512)
        moved = F.transform(side, lambda v, i: F.conv(F.substr(mask, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        return F.zip_with(F.zip_with(side, moved, lambda v, m: (v - m) if undo else (v + m)), radix, lambda v, r: F.pmod(v, r).cast("int"))

    start = F.struct(half(values, False).alias("l"), half(values, True).alias("r"))
    left, right = half(radices, False), half(radices, True)
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(
        steps,
        start,
        lambda s, k: F.when(k % 2 == 0, F.struct(shifted(s["l"], s["r"], left, k).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], right, k).alias("r"))
        ),
        lambda s: F.concat(s["l"], s["r"]),
    )


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one, by those of ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substr(digits, s["at"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))
        ),
        lambda s: s["out"],
    )


def _permuted_digits(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """Digits permuted; a first digit of an area or exchange code stays 0-1 or 2-9 if ``kind`` is phone."""
    values = _ints(digits)
    if kind == "phone":
        low = F.transform(values, lambda v, i: F.when(((i == 0) | (i == 3)) & (v >= 2), 2).otherwise(0))
        radix = F.transform(values, lambda v, i: F.when((i == 0) | (i == 3), F.when(v >= 2, 8).otherwise(2)).otherwise(10))
    else:
        low, radix = F.transform(values, lambda v: F.lit(0)), F.transform(values, lambda v: F.lit(10))
    moved = feistel(F.zip_with(values, low, lambda v, b: (v - b).cast("int")), F.transform(radix, lambda r: r.cast("int")), key, kind, undo)
    return F.array_join(F.zip_with(moved, low, lambda v, b: (v + b).cast("string")), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card_runs(m: Column) -> Column:
    """Runs of whole digit groups of ``m`` that pass Luhn's check, none over another, by place.

    Runs grouped as cards are go first, then other groupings: those without groups of one or two digits, and the
    longest run from the start. So a card next to a short number is found whatever the two make together."""

    def ranked(x: Column) -> Column:
        g, s, last = x["g"], x["s"], F.size(x["g"]) - 1

        def own(r: Column) -> Column:
            return F.slice(g, r["i"] + 1, r["j"] - r["i"] + 1)

        def rank(r: Column) -> Column:
            even = F.size(F.array_distinct(F.slice(s, r["i"] + 1, r["j"] - r["i"]))) <= 1
            shape = F.when(even, F.array_join(F.transform(own(r), lambda c: F.length(c).cast("string")), "-")).otherwise("")
            usual = (r["i"] == r["j"]) | shape.isin("4-4-4-4", "4-6-5", "4-6-4")
            return F.when(usual & r["d"].rlike("^[2-6]"), 0).when(usual, 1).when(shape == "4-4-4-4-3", 2).otherwise(3)

        def good(r: Column, first: Column) -> Column:
            tiny = F.exists(own(r), lambda c: F.length(c) < 3)
            return (~tiny | ((r["i"] == 0) & (r["j"] == first))) & (luhn_sum(r["d"]) % 10 == 0)

        def runs(i: Column) -> Column:
            each = F.transform(F.sequence(i, F.least(last, i + 18)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(g, i + 1, j - i + 1), "").alias("d")))
            return F.filter(each, lambda r: F.length(r["d"]).between(13, 19))

        # the longest run from the start ends at the last group that leaves 19 digits at most
        first = _let(runs(F.lit(0)), lambda x: F.coalesce(F.array_max(F.transform(x, lambda r: r["j"])), F.lit(-1)))
        fit = _let(first, lambda end: F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.filter(runs(i), lambda r: good(r, end)))))
        return F.array_sort(
            F.transform(fit, lambda r: _let(rank(r), lambda k: F.struct(k.alias("k"), F.when(k == 3, -F.length(r["d"])).otherwise(0).alias("n"), r["i"].alias("i"), r["j"].alias("j"), r["d"].alias("d"), F.length(F.array_join(F.slice(g, F.lit(1), r["i"]), "")).alias("at"))))
        )

    parts = F.struct(F.split(m, "[ -]").alias("g"), F.filter(F.split(F.regexp_replace(m, "[0-9]+", ""), ""), lambda c: c != "").alias("s"))
    chosen = _let(_let(parts, ranked), lambda runs: F.aggregate(
        runs, F.slice(runs, 1, 0), lambda kept, r: F.when(F.exists(kept, lambda k: (k["i"] <= r["j"]) & (r["i"] <= k["j"])), kept).otherwise(F.concat(kept, F.array(r)))
    ))
    return F.array_sort(F.transform(chosen, lambda r: F.struct(r["at"].alias("at"), r["d"].alias("d"))))


def _card(m: Column, key: str, undo: bool) -> Column:
    """All cards among the digit groups of ``m``. Where digits beside a pseudonym happen to make a card of the same or
    a better rank with some of its groups, ``undo`` may take that one instead."""

    def number(d: Column) -> Column:
        body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", undo)
        return _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("int").cast("string")))

    def placed(runs: Column) -> Column:
        return _let(_digits(m), lambda d: F.aggregate(
            runs, d, lambda out, r: F.concat(F.substr(out, F.lit(1), r["at"]), number(r["d"]), F.substr(out, r["at"] + F.length(r["d"]) + 1, F.length(out)))
        ))

    return _let(_card_runs(m), lambda runs: F.when(F.size(runs) > 0, _refill(m, placed(runs))).otherwise(m))


def _phone(m: Column, key: str, undo: bool) -> Column:
    d = _digits(m)
    head = F.substr(d, F.lit(1), F.length(d) - 10)
    return _refill(m, F.concat(head, _permuted_digits(F.substring(d, -10, 10), key, "phone", undo)))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    # areas 001-665 and 667-899 are numbered 0-897, groups 01-99, serials 0001-9999
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    x = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", undo)
    back = F.when(x[0] >= 665, x[0] + 2).otherwise(x[0] + 1)
    return F.format_string("%03d-%02d-%04d", back, x[1] + 1, x[2] + 1)


def _ip(m: Column, key: str, undo: bool) -> Column:
    values = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    return F.array_join(F.transform(feistel(values, F.transform(values, lambda v: F.lit(256)), key, "ip", undo), lambda v: v.cast("string")), ".")


_FIRST_DAY, _DAYS = "1900-01-01", 73049  # 1900-01-01 to 2099-12-31


def _date(m: Column, key: str, undo: bool) -> Column:
    """Days since 1900 in 271 x 270 places, permuted again until they name a day up to 2099."""
    day = F.try_to_date(m, "yyyy-MM-dd")
    n = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))

    def once(v: Column) -> Column:
        x = feistel(F.array(F.floor(v / 270).cast("int"), (v % 270).cast("int")), F.array(F.lit(271), F.lit(270)), key, "date", undo)
        return (x[0] * 270 + x[1]).cast("int")

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.lit(_DAYS), lambda s, k: F.when((k > 1) & (s < _DAYS), s).otherwise(once(F.when(k == 1, n).otherwise(s))))
    return F.when(day.isNull() | (F.date_format(day, "yyyy-MM-dd") != m), m).otherwise(F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), walked), "yyyy-MM-dd"))


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz")


def _email(m: Column, key: str, undo: bool) -> Column:
    """The local part's letters and digits permuted, each within its class; cases and the domain stay.

    Addresses that differ in case only have pseudonyms that differ in case only, so they stay linked."""
    chars = F.filter(F.split(F.substring_index(m, "@", 1), ""), lambda c: c != "")

    def place(c: Column) -> Column:
        return F.greatest(*(F.instr(F.lit(own), F.lower(c)) for own in _CLASSES))

    def size(c: Column) -> Column:
        out = F.lit(1)
        for own in _CLASSES:
            out = F.when(F.instr(F.lit(own), F.lower(c)) > 0, len(own)).otherwise(out)
        return out

    values = F.transform(chars, lambda c: F.greatest(place(c) - 1, F.lit(0)).cast("int"))
    moved = feistel(values, F.transform(chars, lambda c: size(c).cast("int")), key, "email", undo)

    def char(c: Column, v: Column) -> Column:
        out = c
        for own in _CLASSES:
            new = F.substr(F.lit(own), v + 1, F.lit(1))
            out = F.when(F.instr(F.lit(own), F.lower(c)) > 0, F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(out)
        return out

    return F.concat(F.array_join(F.zip_with(chars, moved, char), ""), F.substr(m, F.instr(m, "@"), F.length(m)))


_MAKERS = {"email": _email, "iso_date": _date, "phone": _phone, "ssn": _ssn, "ip": _ip, "card": _card}


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match; itself if it does not validate (Luhn's check, the calendar)."""
    out = m
    for kind, pattern in reversed((PATTERNS | {"card": r"[0-9](?:[ \-]?[0-9]){12,}+"}).items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), _MAKERS[kind](m, key, undo)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """All columns of ``docs``, the text with pseudonyms, and ``n_changed`` (long).

    Null texts stay null with 0 changes, empty ones empty. Every occurrence in the whole text is replaced.
    ``undo`` with the same key gives the first texts back. Repeated rows are treated alike; no rows give no
    rows. An input column named ``n_changed`` is replaced, others stay whatever their names. The domain of a mail
    address, passwords and access keys stay in clear.
    """
    base = docs.drop(*(c for c in ("n_changed",) if c in docs.columns and c not in (id_col, text_col)))
    text = F.col(text_col)
    pattern = F.when(F.contains(text, F.lit("@")), _ANY).otherwise(_NUMBERS)
    found = base.withColumn("_m", F.regexp_extract_all(text, pattern, F.lit(0)))
    made = found.withColumn("_p", F.when(F.size("_m") > 0, F.transform("_m", lambda m: pseudonym(m, key, undo))))
    pieces = F.split(text, pattern, -1)
    # one piece more than matches: each piece, then its pseudonym
    joined = F.array_join(F.zip_with(pieces, F.col("_p"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("_m", "_p", lambda a, b: a != b), lambda x: x))
    some = F.col("_p").isNotNull()
    return made.withColumns(
        {text_col: F.when(some, joined).otherwise(text), "n_changed": F.when(some, changed).otherwise(0).cast("long")}
    ).drop("_m", "_p")
