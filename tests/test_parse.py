"""Edge cases of the scraped texts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions import parse
from marketlens.functions.checks import is_valid


def evaluate(spark, texts, make):
    rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)]
    width = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"c{k} string" for k in range(width))
    frame = spark.createDataFrame(rows, schema)
    columns = [F.col(f"c{k}") for k in range(width)]
    return [row["v"] for row in frame.select("i", make(*columns).alias("v")).orderBy("i").collect()]


def test_rating(spark):
    texts = ["4.5 ★", "★ 4.0", "5", "Novidade", "N/A", "", None, "4.5\n", "99.9"]
    expected = ["4.5", "4.0", "5.0", None, None, None, None, "4.5", None]
    got = evaluate(spark, texts, parse.parse_rating)
    assert got == [None if e is None else Decimal(e) for e in expected]


def test_rating_detail_wins(spark):
    got = evaluate(spark, [("3.0", "nota 4.7 (20)"), ("3.0", "nova"), ("3.0", None)], parse.parse_rating)
    assert got == [Decimal("4.7"), Decimal("3.0"), Decimal("3.0")]


def test_minutes(spark):
    texts = ["30-45 min", "30-46min", "20 min", "Hoje 25-35 min", "Agendado", None, "99999999999-1 min", "40 min"]
    assert evaluate(spark, texts, parse.parse_minutes) == [37, 38, 20, 30, None, None, None, 40]


def test_minutes_fallback_is_a_range_only(spark):
    got = evaluate(spark, [("N/A", "10-20 min • R$ 3"), ("N/A", "15 min")], parse.parse_minutes)
    assert got == [15, None]


def test_fee(spark):
    texts = ["Grátis", "GRÁTIS", "0", "R$ 3,50", "R$ 7,00", "R$5", "R$ 1.234,50", "N/A", "", "a combinar", None]
    expected = ["0.00", "0.00", "0.00", "3.50", "7.00", "5.00", None, None, None, None, None]
    assert evaluate(spark, texts, parse.parse_fee) == [None if e is None else Decimal(e) for e in expected]


def test_price_falls_back_on_the_whole_text(spark):
    pairs = [("N/A", "Pizza R$ 15,90 grande"), (None, "R$ 8"), ("R$ 9,99", "R$ 1,00")]
    assert evaluate(spark, pairs, parse.parse_price) == [Decimal("15.90"), None, Decimal("9.99")]


def test_min_order(spark):
    pairs = [
        ("Mínimo R$ 25,00", ""),
        ("", "MÍNIMO de R$ 30"),
        ("", "pedido a partir de R$ 12,5"),
        ("", "mínimo\nR$ 30"),
        (None, None),
    ]
    got = evaluate(spark, pairs, parse.parse_min_order)
    assert got == [Decimal("25.00"), Decimal("30.00"), Decimal("12.50"), None, None]


def test_min_order_detail(spark):
    texts = ["Pedido mínimo R$ 20,00", "R$ 1,2,3", "R$ ,"]
    assert evaluate(spark, texts, parse.parse_min_order_detail) == [Decimal("20.00"), None, None]


def test_reviews(spark):
    pairs = [("(234)", ""), ("", "nota (12)"), ("", "77 Avaliações"), ("", "5 reviews"), ("novo", "novo")]
    assert evaluate(spark, pairs, parse.parse_reviews) == [234, 12, 77, 5, None]
    assert evaluate(spark, ["1.234 avaliações", "1,5 mil"], parse.parse_reviews_detail) == [1234, 15]


def test_split_info(spark):
    got = evaluate(spark, ["4.5 • Pizza • 2 km", "4.5", "N/A", None], parse.split_info)
    assert [tuple(row) for row in got] == [
        ("4.5", "Pizza", "2 km"),
        ("4.5", "N/A", "N/A"),
        ("N/A", "N/A", "N/A"),
        ("N/A", "N/A", "N/A"),
    ]


def test_link(spark):
    rows = [("/x/1", "A B", "Rio Claro"), ("https://e.org/2", "A", "C"), ("N/A", "A B", "Rio Claro"), (None, "Z", "C")]
    got = evaluate(spark, rows, lambda h, n, c: parse.resolve_link(h, n, c, "https://e.com"))
    assert got == [
        "https://e.com/x/1",
        "https://e.org/2",
        "https://e.com/delivery/rio-claro-sp/a-b",
        "https://e.com/delivery/c-sp/z",
    ]


def test_description(spark):
    rows = [
        ("N/A", "curta", "texto com R$ 5,00", "uma descrição longa", "Prato"),
        ("própria", "uma descrição longa", None, None, "Prato"),
        ("N/A", "Prato muito bom", None, None, "Prato muito bom"),
    ]
    got = evaluate(spark, rows, lambda p, a, b, c, n: parse.pick_description(F.array(a, b, c), n, p))
    assert got == ["uma descrição longa", "própria", None]


@pytest.mark.parametrize(
    ("type_name", "good", "bad"),
    [
        ("INTEGER", ["1", " -5 ", "+7"], ["1.0", "", "x", None]),
        ("DECIMAL(10,2)", ["1", "2.50", ".5", "1e3"], ["1,5", "", None]),
        ("BOOLEAN", ["Sim", "não", "N", "1", "TRUE"], ["yes", "2", None]),
        ("DATE", ["2024-01-31", "aaaa-bb-cc"], ["2024/01/31", "2024-1-1", None]),
        ("VARCHAR(20)", ["", "x"], [None]),
    ],
)
def test_is_valid(spark, type_name, good, bad):
    assert evaluate(spark, good + bad, lambda v: is_valid(v, type_name)) == [True] * len(good) + [False] * len(bad)
