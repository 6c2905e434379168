"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

Everything is a column expression over one text. A pattern runs at most twice over a text, once for the
matches and once for the pieces between them; the running sum of their lengths gives the positions. Patterns are
written so that no input makes them backtrack more than linearly or recurse: repeated groups are
possessive, and a run of word characters is only tried from its start (or from the end of the match before).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import free_name, whole_text

# Characters before and after a span in which context words count, the score one adds (or takes, if it speaks against
# the kind), and the score to be kept.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.5
_BLOCK = 64

_LOCAL = "[A-Za-z0-9._%+-]"

# Lengths of account numbers by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The first letter of a possible account number; all of the number, by a look ahead, is group 1.

    Only the letter is taken, so that a number is also found inside or behind what looks like one and is none. The
    length is that of the country. For countries that are not in the registry it is that of the whole run.
    """
    each = [
        rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}+"
        for length, countries in IBAN_LENGTHS.items()
    ]
    other = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=((?:{'|'.join([*each, other])})(?![A-Za-z0-9])))[A-Z]"


@dataclass(frozen=True)
class Kind:
    """A kind of data: ``possible`` is a cheap test whether a text can hold any.

    With ``ahead`` the pattern takes one character, and its group 1 is the match. ``against`` are words that speak against the
    kind; they count for kinds that this method adds.
    """

    name: str
    pattern: str
    possible: str
    score: float
    context: str
    base: bool
    ahead: bool = False
    against: str = ""


# Kinds in the order of the output; those that are not base are additions of this method.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write to", True),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6, "ip|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.9, "card|visa|credit|pay|carte|tarjeta|karte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "call|phone|tel|fax|mobil", True),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|konto|compte|cuenta|bank", False, ahead=True, against="serial|product|order"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social security|taxpayer", False, against="serial|product|order|invoice|part|case"),
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, number: total + number)


def _running_sums(numbers: Column) -> Column:
    """Inclusive running sums of a non-empty array, in blocks so that long arrays stay cheap."""

    def within(numbers: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(numbers) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = _let(sums, lambda s: F.transform(blocks, lambda b: _total(F.slice(s, F.lit(1), b))))

        def each(before: Column) -> Column:
            def upto(i: Column) -> Column:
                block = (i / _BLOCK).cast("int")
                return F.get(before, block) + _total(F.slice(numbers, block * _BLOCK + 1, i % _BLOCK + 1))

            return F.transform(F.sequence(F.lit(0), F.size(numbers) - 1), upto)

        return _let(before, each)

    return _let(numbers, within)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(letters: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 checksum."""

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(letters, (i + 4) % F.length(letters) + 1, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(0), F.length(letters) - 1), F.lit(0), add) == 1


def _confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        # Leading zeros do not count towards the value.
        parts = F.transform(F.split(match, r"\."), lambda part: F.ltrim(part, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind.name == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        letters = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(letters).between(15, 34) & _mod97(letters)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def _spans_of(text: Column, number: int, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(int(kind.ahead)))
    pieces = F.split(text, kind.pattern, -1)

    def placed(found: Column) -> Column:
        def taken(match: Column) -> Column:
            return F.lit(1) if kind.ahead else F.length(match)

        lengths = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(found)), found, lambda piece, match: F.length(piece) + taken(match)
        )
        pairs = F.arrays_zip(found.alias("match"), _running_sums(lengths).alias("upto"))

        def span(pair: Column) -> Column:
            match = pair.getField("match")
            start = pair.getField("upto") - taken(match)
            end = start + F.length(match)
            before = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
            near = F.lower(F.concat(before, F.lit("\n"), F.substring(text, end + 1, F.lit(CONTEXT_CHARS))))
            bonus = F.when(near.rlike(rf"\b(?:{kind.context})"), CONTEXT_BONUS).otherwise(0.0)
            if kind.against:
                bonus = bonus - F.when(near.rlike(rf"\b(?:{kind.against})"), CONTEXT_BONUS).otherwise(0.0)
            score = F.when(_confirmed(kind, match), F.least(F.lit(1.0), F.lit(kind.score) + bonus)).otherwise(0.0)
            return F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), score.alias("score"))

        return F.when(F.size(found) > 0, F.transform(pairs, span)).otherwise(F.array().cast(_SPAN))

    spans = F.filter(_let(found, placed), lambda s: s.getField("score") >= MIN_SCORE)
    possible = F.contains(text, F.lit("@")) if kind.possible == "@" else text.rlike(kind.possible)
    return F.when(possible, spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, kind, end, score).

    Positions are code points, the end exclusive; ``kind`` is the place in ``KINDS``. Of each kind the matches are
    the leftmost ones that do not overlap (account numbers may); matches that fail their check are dropped and not tried
    again. Base kinds that pass are always kept; the others need ``MIN_SCORE`` with their context.
    Null and empty texts have none.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans_of(whole, number, kind) for number, kind in enumerate(KINDS)]))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    each = F.transform(
        found, lambda s: F.concat_ws(":", F.get(names, s.getField("kind")), s.getField("start"), s.getField("end"))
    )
    return F.array_join(each, ",")


def scores(found: Column) -> Column:
    """The spans' scores in hundredths, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.round(s.getField("score") * 100).cast("int").cast("string")), ",")


def base_only(found: Column) -> Column:
    extra = [number for number, kind in enumerate(KINDS) if not kind.base]
    return F.filter(found, lambda s: ~s.getField("kind").isin(extra))


def count_of(found: Column, name: str) -> Column:
    number = [kind.name for kind in KINDS].index(name)
    return F.size(F.filter(found, lambda s: s.getField("kind") == number)).cast("long")


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are masked together."""
    names = F.array(*[F.lit(f"[{kind.name.upper()}]") for kind in KINDS])

    def part(i: Column) -> Column:
        span = F.get(found, i)
        begin = F.coalesce(F.array_max(F.transform(F.slice(found, F.lit(1), i), lambda s: s.getField("end"))), F.lit(0))
        start = F.coalesce(span.getField("start"), F.length(text))
        plain = F.substring(text, begin + 1, F.greatest(start - begin, F.lit(0)))
        mask = F.when(start >= begin, F.get(names, span.getField("kind")))
        return F.concat(plain, F.coalesce(mask, F.lit("")))

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.size(found)), part), "")
    return F.when(F.size(found) > 0, whole).otherwise(text)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans of every row of ``docs`` (doc_id, text); other columns are not read."""
    return docs.select("doc_id", spans(whole_text()).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and, where there is one, ``n_chars`` counted again.

    Rows without any, null texts among them, are unchanged.
    """
    name = free_name(docs, "_spans")
    found = docs.withColumn(name, spans(F.col("text")))
    changed = F.size(name) > 0
    out = found.withColumn("text", F.when(changed, masked(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
