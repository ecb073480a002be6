"""Text and scalar functions, one by one."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text



@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.canonical(F.lit("2010 CACM  3")), "2010 CMAC 3"),
        (lambda: text.canonical(F.lit("2004 CFPI 5")), "2004 FCT 5"),
        (lambda: text.canonical(F.lit("2004 CRTFP 5")), "2004 FPSLREB 5"),
        (lambda: text.canonical(F.lit("[1992] 1 CSC 9 x")), "[1992] 1 CSC 9 x"),
        (lambda: text.case_citations(F.lit("[1992]1 S.C.R.986, [1992] 2 S. C. R. 5 and [1993] 3 SCR 7")), ["[1992] 1 SCR 986", "[1992] 2 SCR 5", "[1993] 3 SCR 7"]),
        (lambda: text.party_key(F.lit("Re: O'Brien Ltd. v. The Queen")), ("ltd", "queen")),
        (lambda: text.party_key(F.lit("no versus here")), None),
        (lambda: text.normalize(F.lit(" “A.B.”—x\n y’s ")), "\"ab\"-x y's"),
        (lambda: F.sort_array(text.content_words(F.lit("The U.S. courts, the COURTS and of 12345"))), ["12345", "courts"]),
        (lambda: text.overlap(F.lit("and the of"), F.lit("x")), 1.0),
        (lambda: text.overlap(F.lit("rent unpaid"), F.lit("unpaid wages")), 0.5),
        (lambda: text.heard_date(F.lit("May 6, 2004")), date(2004, 5, 6)),
        (lambda: text.heard_date(F.lit("6 May 2004")), date(2004, 5, 6)),
        (lambda: text.heard_date(F.lit("soon")), None),
        (lambda: text.search_query([F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("b"))]), "a; b"),
        (lambda: text.polymorphic(F.lit('{"en": "x", "fr": "y"}')), "x"),
        (lambda: text.polymorphic(F.lit('{"fr": "y"}')), "y"),
        (lambda: text.polymorphic(F.lit("plain")), "plain"),
        (lambda: text.corpus_seed(F.lit("TCC"), F.lit("2009 TCC 12")), ("cci-tcc", "2009tcc12")),
        (lambda: text.corpus_seed(F.lit("SCC"), F.lit("2020 ONCA 391")), None),
        (lambda: text.title_case(F.lit("AN ACT OF the king")), "An Act of the King"),
        (lambda: text.long_date(F.lit("2001-02-03").cast("date")), "February 3, 2001"),
        (lambda: text.law_code(F.lit("R.S.O. 1990, c. H-8")), "RSO1990cH8"),
        (lambda: text.strip_header(F.lit("Court\nDecision Content\n\n Body")), "Body"),
        (lambda: text.strip_header(F.lit("x" * 6000 + "Decision Content y")), "x" * 6000 + "Decision Content y"),
        (lambda: text.language_fallback([("en", F.lit(" "), F.lit("c")), ("fr", F.lit("t"), F.lit("d"))]), ("fr", "t", "d")),
        (lambda: text.text_hash(F.lit("a \n b ")) == text.text_hash(F.lit("a b")), True),
        (lambda: F.transform(text.regulation_refs(F.lit("O.Reg. 7/2015; O. Reg. 7/15, R.R.O. 1990, Reg. 194")), lambda r: r["alias"]), ["150007", "900194"]),
    ],
)
def test_function(spark, column, expected):
    found = spark.range(1).select(column().alias("x")).first()["x"]
    assert (tuple(found) if isinstance(expected, tuple) else found) == expected


def test_nulls(spark):
    rows = spark.createDataFrame([(None,)], "t string")
    t = F.col("t")
    out = rows.select(text.clean(t), text.normalize(t), text.case_citations(t), text.canonical(t), text.key_terms(t), text.leaks(t, t), text.heard_date(t), text.party_key(t), text.strip_header(t)).first()
    assert not any(x for x in out if not isinstance(x, list)) and len(out) == 9
