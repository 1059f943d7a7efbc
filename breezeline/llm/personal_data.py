"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for IBANs), and words nearby move the score. A span's place comes from
splitting the text at the matches and adding lengths up.

The patterns have no repeated groups, which would recurse in Java for every
repetition: separators that may stand inside a match are first replaced, one
for one, by a mark. A text's own marks become a third character before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")  # fixed values: the kinds, in order of rank
KINDS = (*BASE, "iban", "ssn")

SPAN = "struct<kind:string,start:long,end:long,score:double>"
_FOUND = "array<struct<start:long,rank:int,kind:string,end:long,score:double>>"

_LABEL = "[A-Za-z0-9-]"
_LOCAL = "[A-Za-z0-9._%+\\x02-]"
#: a match starts where a run starts, or where the match before it ended
_EMAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\\x02[A-Za-z0-9\\x02-]*+"
_IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "[0-9][0-9\\x01]++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_IBAN = "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
_SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: words within ``NEAR`` characters before a span that speak for its kind
_CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": "\\bip\\b|server|host|address",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|tax",
}
NEAR = 40
LEAST = 0.5  # extra kinds need this score; base kinds stay whatever theirs is
_START = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(match: Column, least: int, most: int) -> Column:
    n = F.length(_digits(match))
    return (n >= least) & (n <= most)


def _luhn(match: Column) -> Column:
    """The Luhn check of 14 to 19 digits; from the right, every second digit is doubled."""
    digits = _digits(match)

    def add(total, place):
        d = F.substring(digits, place, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - place) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(_between(match, 14, 19), total % 10 == 0).otherwise(False)


def _parts_fit(match: Column) -> Column:
    """Four parts of at most 255 each, whatever zeros lead them."""
    parts = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _mod_97(match: Column) -> Column:
    turned = F.concat(F.substring(match, 5, 40), F.substring(match, 1, 4))

    def add(rest, sign):
        digit = (sign >= "0") & (sign <= "9")
        return F.when(digit, rest * 10 + F.ascii(sign) - 48).otherwise(rest * 100 + F.ascii(sign) - 55) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), add) == 1


#: kind: (text the pattern runs on, pattern, check, characters without which there is no match)
_RULES: dict[str, tuple[str, str, Callable[[Column], Column], str | None]] = {
    "email": ("dotted", _EMAIL, lambda m: F.lit(True), "@"),
    "ip": ("plain", _IP, _parts_fit, None),
    "card": ("joined", _CARD, _luhn, None),
    "phone": ("plain", _PHONE, lambda m: _between(m, 10, 15), "+"),
    "iban": ("plain", _IBAN, _mod_97, None),
    "ssn": ("plain", _SSN, lambda m: F.lit(True), None),
}


def _spans(kind: str, rank: int, text: Column, source: Column, matches: Column) -> Column:
    """The confirmed matches of a kind with their places and scores."""
    _, pattern, check, _ = _RULES[kind]
    pieces = F.slice(F.split(source, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match")))

    def add(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        near = F.lower(F.substring(text, F.greatest(start - NEAR + 1, F.lit(1)).cast("int"), F.least(start, F.lit(NEAR)).cast("int")))
        score = F.lit(_START[kind]) + F.when(near.rlike(_CONTEXT[kind]), 0.2).otherwise(0.0)
        good = check(pair["match"])
        if kind not in BASE:
            good = good & (score >= LEAST)
        one = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            end.alias("end"), score.cast("double").alias("score"),
        )
        found = F.when(good, F.concat(state["found"], F.array(one).cast(_FOUND))).otherwise(state["found"])
        return F.struct(end.cast("long").alias("at"), found.alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("found"))
    return F.when(
        F.size(matches) > 0, F.aggregate(pairs, start, add, lambda state: state["found"])
    ).otherwise(F.array().cast(_FOUND))


def with_personal_data(docs: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the column ``into``: array of (kind, start, end, score) by start, then kind.

    Places are code points, end exclusive; a null or empty text has no span. Every
    row gets its own result, so ids may be null or repeated, and all other columns
    stay as they are (one named like ``into`` is replaced).
    """
    marks = "\u0001\u0002"
    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    row = F.struct(*kept).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(text.rlike("[\\x01\\x02]"), F.translate(text, marks, "\u0003\u0003")).otherwise(text)
    step = docs.select(row, clean.alias("plain"))
    dotted = F.when(
        F.contains(F.col("plain"), F.lit("@")), F.regexp_replace("plain", f"\\.(?={_LABEL})", "\u0002")
    )
    joined = F.regexp_replace("plain", "(?<=[0-9])[\\x20-](?=[0-9])", "\u0001")
    step = step.select("row", "plain", dotted.alias("dotted"), joined.alias("joined"))
    matches = []
    for kind, (source, pattern, _, needs) in _RULES.items():
        found = F.regexp_extract_all(F.col(source), F.lit(pattern), F.lit(0))
        if needs:
            found = F.when(F.contains(F.col("plain"), F.lit(needs)), found)
        matches.append(F.coalesce(found, F.array().cast("array<string>")).alias(f"m_{kind}"))
    step = step.select("row", "plain", "dotted", "joined", *matches)
    arrays = [
        _spans(kind, rank, F.col("plain"), F.col(_RULES[kind][0]), F.col(f"m_{kind}"))
        for rank, kind in enumerate(KINDS)
    ]
    ordered = F.array_sort(F.concat(*arrays))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return step.select("row", spans.alias("spans")).select("row.*", F.col("spans").alias(into))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names it."""
    kind = "struct<at:long,parts:array<string>>"

    def add(state, span):
        before = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        new = F.struct(span["end"].alias("at"), F.concat(state["parts"], F.array(before, label)).alias("parts"))
        wider = F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["parts"].alias("parts"))
        return F.when(span["start"] >= state["at"], new.cast(kind)).otherwise(wider.cast(kind))

    def end(state):
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")).cast(kind)
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, end)).otherwise(text)
