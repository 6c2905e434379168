"""Account numbers and what may follow them."""

import pytest
from pyspark.sql import functions as F

from marketlens.llm import pii

SPACED, PLAIN = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
# Per country of another length: published examples.
OTHERS = [
    "NO93 8601 1117 947", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "CH93 0076 2011 6238 5295 7", "GB29 NWBK 6016 1331 9268 19",
    "ES91 2100 0418 4502 0005 1332", "PT50 0002 0123 1234 5678 9015 4", "FR14 2004 1010 0505 0001 3M02 606",
    "PL61 1090 1014 0000 0712 1981 2874", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
]


def ibans(make, cases):
    found = pii.find(make(list(enumerate(cases)))).select("doc_id", pii.joined(F.col("spans")).alias("spans"))
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in found.collect()}
    return [[cases[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i]] for i in range(len(cases))]


def test_whatever_follows(make):
    tails = [" BIC COBADEFF", " The sum", " I pay", " 25 euros", ".", " is", "", " 2", f" {PLAIN}", "\n7", ", A"]
    cases = [f"pay é😀 {number}{tail}" for number in [SPACED, PLAIN, *OTHERS] for tail in tails]
    expected = [[number] + [PLAIN] * (PLAIN in tail) for number in [SPACED, PLAIN, *OTHERS] for tail in tails]
    assert ibans(make, cases) == expected


@pytest.mark.parametrize("head", ["REF AB12 ", "NO12 345 ", "AB12 34 CD56 ", "A1 ", "DE88 "])
def test_whatever_comes_before(make, head):
    assert ibans(make, [head + SPACED + " Then"]) == [[SPACED]]


def test_what_is_none(make):
    assert ibans(make, [SPACED[:-1] + "1 A", PLAIN + "7", "x" + PLAIN, PLAIN[:-1], "DE89 3704"]) == [[]] * 5


def test_masked(make):
    (row,) = pii.mask(make([(1, f"to {SPACED} BIC COBADEFF")])).collect()
    assert (row.text, row.n_chars) == ("to [IBAN] BIC COBADEFF", 22)


def test_context_on_both_sides(make):
    number = "078-05-1120"
    cases = [
        (1, f"{number} is my social security number"),
        (2, f"SSN {number}"),
        (3, f"see {number} there"),
        (4, f"order {number} of the taxpayer"),
        (5, "SSN " + "x" * 50 + f" {number} " + "x" * 50 + " ssn"),
        (6, "YE15 CBYE 0001 0188 6123 4567 8901 23"),
        (7, "mail a@b.org"),
    ]
    frame = pii.find(make(cases)).select("doc_id", pii.joined(pii.F.col("spans")).alias("spans"), pii.scores(pii.F.col("spans")).alias("scores"))
    found = {r.doc_id: (r.spans.split(":")[0], r.scores) for r in frame.collect()}
    assert found[1] == found[2] == ("ssn", "70") and found[3] == found[4] == found[5] == ("", "")
    assert found[7] == ("email", "100")
    # Thirty characters: the length of its country.
    assert "YE" in pii.IBAN_LENGTHS[30]
