"""From scraped records to new, typed, numbered rows.

A batch carries a unique ``pos`` column, the order its records arrived in. The
first record of a key wins, records whose key is in the table already are
duplicates, and a key with a missing part equals no other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import parse
from marketlens.functions.numeric import percent
from marketlens.operators.numbering import with_position
from marketlens.sources.scratch import materialise

# --- typing of scraped records ----------------------------------------------


def parse_cards(cards: DataFrame, base_url: str, as_of: str) -> DataFrame:
    """Typed restaurant rows of scraped cards (all columns text, but ``pos``)."""
    rating = F.coalesce(parse.known(F.col("rating_txt")), parse.split_info(F.col("info_txt"))["rating"])
    return cards.select(
        "pos",
        F.col("nome").alias("name"),
        F.col("categoria").alias("category"),
        parse.parse_rating(rating).alias("rating"),
        parse.parse_minutes(F.col("time_txt"), F.col("fee_txt")).alias("delivery_time"),
        parse.parse_fee(F.col("fee_txt")).alias("delivery_fee"),
        F.col("cidade").alias("city"),
        parse.resolve_link(F.col("href"), F.col("nome"), F.col("cidade"), base_url).alias("link"),
        parse.parse_reviews_detail(F.col("reviews_txt")).alias("reviews"),
        parse.parse_min_order(F.col("min_txt")).alias("min_order"),
        F.lit(as_of).cast("timestamp").alias("scraped_at"),
    )


def accept_products(staging: DataFrame) -> DataFrame:
    """Scraped products that have a name of more than two characters."""
    name = F.col("nome")
    return staging.where((name != parse.MISSING) & (F.length(name) > 2))


def parse_products(staging: DataFrame, as_of: str) -> DataFrame:
    """Typed product rows of scraped products."""
    return accept_products(staging).select(
        "pos",
        "restaurant_id",
        "restaurant_name",
        "category",
        F.col("nome").alias("name"),
        parse.known(F.col("descricao")).alias("description"),
        parse.parse_price(F.col("preco")).alias("price"),
        F.lit(as_of).cast("timestamp").alias("scraped_at"),
    )


# --- categories from pages --------------------------------------------------

# An address may stand in double quotes, in single ones or in none.
ANCHOR = r"""(?is)<a\b[^>]*?\bhref=(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
TAG = r"(?s)<[^>]*>"


def extract_links(pages: DataFrame, base_url: str, marker: str = "/delivery/", min_len: int = 2) -> DataFrame:
    """Anchors of each page whose address contains ``marker`` and whose text is longer than ``min_len``."""
    found = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("pos", "anchor")
    )
    parts = found.select(
        "page_id",
        "pos",
        # Of the three groups all but one are empty.
        F.concat(*[F.regexp_extract("anchor", ANCHOR, group) for group in (1, 2, 3)]).alias("href"),
        F.regexp_replace(F.regexp_extract("anchor", ANCHOR, 4), TAG, "").alias("text"),
    )
    href = F.col("href")
    link = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href))
    return parts.where(href.contains(marker) & (F.length("text") > min_len)).select(
        "page_id", "pos", parse.strip(F.col("text")).alias("nome"), link.alias("link")
    )


# Terms that mark a single restaurant, and terms that mark a category.
DENY_TERMS = [
    "mcdonald", "méqui", "burger", "delivery", "drive", "moo", "house", "kibon", "açaí-", "gourmet",
    "best", "mccafé", "chickens", "sobremesas", "dia todo", "fast food", "macarrão",
]
ALLOW_TERMS = [
    "pizza", "japonesa", "brasileira", "açaí", "árabe", "doces", "bolos", "saudável", "pastel", "italiana",
    "sorvetes", "carnes", "bebidas", "lanches", "mercado", "promoções", "chinesa", "mexicana", "hamburguer",
    "comida", "restaurante", "lanche", "doce",
]
SHORT_NAME = 15


def _any_of(terms: Sequence[str]) -> str:
    return "|".join(re.escape(term) for term in terms)


def filter_categories(links: DataFrame, order: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """Links that name a category, each name once, where it occurs first."""
    lowered = F.lower("nome")
    wanted = lowered.rlike(_any_of(ALLOW_TERMS)) | (F.length("nome") <= SHORT_NAME)
    return first_per_key(links.where(~lowered.rlike(_any_of(DENY_TERMS)) & wanted), [F.col("nome")], order)


# --- new rows ---------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key.

    Spark limits each map task to its own first row per key before the shuffle,
    so copies of a frequent key do not gather in one task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def _key(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


RESTAURANT_KEY = {"name": _key, "city": _key}
PRODUCT_KEY = {"name": _key, "restaurant_id": F.col, "category": _key}
CATEGORY_KEY = {"categorias": _key}

RESTAURANT_REQUIRED = ("name", "category", "city")
PRODUCT_REQUIRED = ("name",)
CATEGORY_REQUIRED = ("categorias", "links")


def _complete(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for column in columns:
        ok = ok & F.col(column).isNotNull()
    return ok


def new_rows(
    existing: DataFrame, batch: DataFrame, key: dict, required: Sequence[str], order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Rows of the batch that are to be saved, without ids; of equal keys the first in ``order``, which has no ties."""
    names = [f"_key{i}" for i in range(len(key))]
    values = [make(column) for column, make in key.items()]
    keyed = batch.where(_complete(required)).withColumns(dict(zip(names, values)))
    # Used three times below: written once, so that the batch is parsed and ranked once.
    firsts = materialise(first_per_key(keyed.where(_complete(names)), [F.col(n) for n in names], order))
    known = existing.select([v.alias(n) for n, v in zip(names, values)])
    # The table is reduced to the batch's keys first: a small batch is broadcast by its measured size and the table is
    # not shuffled. Distinct then, so that a key travels once per map task.
    known = known.join(firsts.select(names), names, "left_semi").distinct()
    new = firsts.join(known, names, "left_anti").select(batch.columns)
    if set(key) <= set(required):
        return new
    # Rows with an incomplete key match nothing and are always new: they never move.
    return new.unionByName(keyed.where(~_complete(names)).select(batch.columns))


def assign_ids(rows: DataFrame, existing: DataFrame, order: Sequence[str] = ("pos",), key: str = "id") -> DataFrame:
    """Number rows in ``order`` (columns), continuing after the highest id of the table."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    numbered = with_position(rows, [F.asc(column) for column in order], "_at")
    kind = existing.schema[key].dataType
    return numbered.withColumn(key, (F.col("_at") + highest + 1).cast(kind)).drop("_at")


def _insert(
    existing: DataFrame, batch: DataFrame, key: dict, required: Sequence[str], order: Sequence[str] = ("pos",)
) -> DataFrame:
    rows = assign_ids(new_rows(existing, batch, key, required, order), existing, order)
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema.fields])


def insert_new_restaurants(existing: DataFrame, batch: DataFrame, city: str | None = None) -> DataFrame:
    """New restaurants, keyed by name and city; ``city`` overrides the batch's own."""
    if city is not None:
        batch = batch.withColumn("city", F.lit(city))
    return _insert(existing, batch, RESTAURANT_KEY, RESTAURANT_REQUIRED)


def insert_new_products(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """New products, keyed by name, restaurant and category."""
    return _insert(existing, batch, PRODUCT_KEY, PRODUCT_REQUIRED)


def insert_new_categories(
    existing: DataFrame, links: DataFrame, as_of: str, order: Sequence[str] = ("pos",)
) -> DataFrame:
    """New categories of a link list (nome, link and the columns of ``order``), keyed by name."""
    batch = links.select(
        *order,
        F.col("nome").alias("categorias"),
        F.col("link").alias("links"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    return _insert(existing, batch, CATEGORY_KEY, CATEGORY_REQUIRED, order)


def refresh(existing: DataFrame, links: DataFrame, as_of: str, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The category table replaced by a link list, numbered from 1."""
    return insert_new_categories(existing.limit(0), links, as_of, order)


def label_rows(existing: DataFrame, batch: DataFrame, key: dict, required: Sequence[str]) -> DataFrame:
    """The batch with each row's ``outcome``: saved, duplicate or error (a required value is missing)."""
    saved = new_rows(existing, batch, key, required).select("pos", F.lit(True).alias("_saved"))
    outcome = (
        F.when(~_complete(required), "error").when(F.col("_saved"), "saved").otherwise("duplicate").alias("outcome")
    )
    return batch.join(saved, "pos", "left").select(*batch.columns, outcome)


def count_run(
    existing: DataFrame, batch: DataFrame, key: dict, required: Sequence[str], order: Sequence[str] = ("pos",)
) -> DataFrame:
    """What ``run_counters`` says of the labelled batch, without labelling its rows: they are only counted."""
    saved = new_rows(existing, batch, key, required, order).agg(F.count(F.lit(1))).scalar()
    counted = batch.agg(F.count(F.lit(1)).alias("_total"), F.count_if(~_complete(required)).alias("errors"))
    return counted.withColumn("saved", saved).select(
        "saved",
        (F.col("_total") - F.col("saved") - F.col("errors")).alias("duplicates"),
        "errors",
        F.coalesce(percent(F.col("saved"), F.col("_total")), F.lit(0.0)).alias("efficiency"),
    )


def run_counters(labelled: DataFrame) -> DataFrame:
    """Saved, duplicate and failed rows of a run, and saved rows in percent of all."""

    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    total = F.count(F.lit(1))
    return labelled.agg(
        n("saved").alias("saved"),
        n("duplicate").alias("duplicates"),
        n("error").alias("errors"),
        F.coalesce(percent(n("saved"), total), F.lit(0.0)).alias("efficiency"),
    )
