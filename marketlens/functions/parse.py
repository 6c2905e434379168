"""Scraped text to typed values, one column expression per field.

All are built-in expressions: no Python runs per row, and they can be used
unchanged in batch and in streams. Text that does not parse becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker for "not found" in scraped records, the bullet
# between the info fields, the star after a rating, the currency sign.
MISSING = "N/A"
BULLET = "•"
STAR = "★"
CURRENCY = "R$"
FREE = "grátis"

# Blanks a scraped page puts around values, the no-break space included.
BLANKS = " \t\r\n\f\u000b\u00a0"
BLANK_CLASS = r"[ \t\r\n\f\x0B\x{00A0}]"

# The patterns the fields are recognised by.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
FIRST_NUMBER = r"(\d+\.?\d*)"
FIRST_INTEGER = r"(\d+)"
MINUTES_RANGE = rf"(\d+)-(\d+){BLANK_CLASS}*min"
MINUTES_SINGLE = rf"(\d+){BLANK_CLASS}*min"
PRICE_IN_TEXT = rf"(R\${BLANK_CLASS}*\d+[.,]\d{{2}})"
MIN_ORDER_LABEL = rf"R\${BLANK_CLASS}*(\d+[.,]?\d*)"
MIN_ORDER_IN_TEXT = (
    rf"(?iu)mínimo.*?R\${BLANK_CLASS}*(\d+[.,]?\d*)",
    rf"(?iu)pedido.*?R\${BLANK_CLASS}*(\d+[.,]?\d*)",
)
MIN_ORDER_DETAIL = rf"R\${BLANK_CLASS}*([\d,]+)"
REVIEWS_IN_TEXT = (
    r"\((\d+)\)",
    rf"(?iu)(\d+){BLANK_CLASS}*avalia",
    rf"(?iu)(\d+){BLANK_CLASS}*review",
)


def strip(value: Column) -> Column:
    """Remove blanks (tabs, newlines and no-break spaces too) at both ends."""
    return F.btrim(value, F.lit(BLANKS))


def known(value: Column) -> Column:
    """The text, or NULL when it is the not-found marker."""
    return F.when(value != MISSING, value)


def capture(value: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL when nothing matches.

    NULL rather than ``''`` also spares the casts that follow: in ANSI mode a text
    that is no number costs an exception, caught or not.
    """
    return F.try_element_at(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)), F.lit(1))


def number(value: Column, type_name: str) -> Column:
    """Plain decimal notation to ``type_name``; anything else is NULL."""
    return F.when(value.rlike(NUMBER), value.try_cast(type_name))


def amount(value: Column) -> Column:
    """``R$ 3,50`` to 3.50. ``1.234,50`` has two points after the swap and is NULL."""
    plain = strip(F.replace(F.replace(value, F.lit(CURRENCY), F.lit("")), F.lit(","), F.lit(".")))
    return number(plain, "decimal(10,2)")


def split_info(value: Column) -> Column:
    """``rating • kind • distance`` to a struct of three trimmed texts."""
    parts = F.split(F.when(value != MISSING, value), BULLET)

    def part(position: int) -> Column:
        return F.coalesce(strip(F.try_element_at(parts, F.lit(position))), F.lit(MISSING))

    return F.struct(part(1).alias("rating"), part(2).alias("kind"), part(3).alias("distance"))


def parse_rating(value: Column, detail: Column | None = None) -> Column:
    """Rating as decimal(2,1): the first number of ``detail`` if it has one, else ``value`` without its star."""
    text = strip(F.replace(known(value), F.lit(STAR), F.lit("")))
    if detail is not None:
        text = F.coalesce(capture(detail, FIRST_NUMBER), text)
    return number(text, "decimal(2,1)")


def parse_minutes(value: Column, fallback: Column | None = None) -> Column:
    """``a-b min`` to the floored middle, else ``a min``; ``fallback`` is only searched for a range."""

    def middle(text: Column) -> Column:
        low = capture(text, MINUTES_RANGE, 1).try_cast("bigint")
        high = capture(text, MINUTES_RANGE, 2).try_cast("bigint")
        return F.floor((low + high) / 2).try_cast("int")

    single = capture(value, MINUTES_SINGLE).try_cast("int")
    minutes = F.when(capture(value, MINUTES_RANGE).isNotNull(), middle(value)).otherwise(single)
    return minutes if fallback is None else F.coalesce(minutes, middle(fallback))


def parse_fee(value: Column) -> Column:
    """Delivery fee: free of charge or ``0`` is 0.00, otherwise the amount."""
    free = (value == "0") | (F.lower(value) == FREE)
    return F.when(free, F.lit(0).cast("decimal(10,2)")).otherwise(amount(known(value)))


def parse_price(value: Column, whole_text: Column | None = None) -> Column:
    """Price text to an amount; without one, the first price inside the item's whole text."""
    text = known(value)
    if whole_text is not None:
        text = F.coalesce(text, capture(whole_text, PRICE_IN_TEXT))
    return amount(text)


def parse_min_order(label: Column, whole_text: Column | None = None) -> Column:
    """Minimum order from its label, else from the patterns in the card's whole text."""
    found = [capture(label, MIN_ORDER_LABEL)]
    if whole_text is not None:
        found += [capture(whole_text, pattern) for pattern in MIN_ORDER_IN_TEXT]
    return number(F.replace(F.coalesce(*found), F.lit(","), F.lit(".")), "decimal(10,2)")


def parse_min_order_detail(value: Column) -> Column:
    """Minimum order as shown on a detail page (digits and commas only)."""
    return number(F.replace(capture(value, MIN_ORDER_DETAIL), F.lit(","), F.lit(".")), "decimal(10,2)")


def parse_reviews(label: Column, whole_text: Column | None = None) -> Column:
    """Review count: first integer of its label, else from the patterns in the card's whole text."""
    found = [capture(label, FIRST_INTEGER)]
    if whole_text is not None:
        found += [capture(whole_text, pattern) for pattern in REVIEWS_IN_TEXT]
    return F.coalesce(*found).try_cast("int")


def parse_reviews_detail(value: Column) -> Column:
    """Review count of a detail page, where ``1.234`` and ``1,234`` mean 1234."""
    plain = F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    return capture(plain, FIRST_INTEGER).try_cast("int")


def slug(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit("-"))


def resolve_link(href: Column, name: Column, city: Column, base_url: str, region: str = "sp") -> Column:
    """Absolute link: as given, completed by the base address, or built from city and name."""
    given = F.nullif(known(href), F.lit(""))
    built = F.concat(F.lit(f"{base_url}/delivery/"), slug(city), F.lit(f"-{region}/"), slug(name))
    return F.when(given.startswith("/"), F.concat(F.lit(base_url), given)).otherwise(F.coalesce(given, built))


def pick_description(candidates: Column, name: Column, primary: Column | None = None) -> Column:
    """The primary text if found, else the first candidate that reads like a description."""
    usable = F.filter(
        candidates,
        lambda text: (F.length(text) > 10) & ~text.contains(CURRENCY) & (text != name),
    )
    first = F.try_element_at(usable, F.lit(1))
    return known(first if primary is None else F.coalesce(known(primary), first))
