"""Rules of whole briefs on a small one."""

from datetime import date

from pyspark.sql import functions as F

from citeloom.operators import briefs

ITEMS = "doc_id int, section string, idx int, anchor int, text string, role string, kind string, issue_id string, issue_ids array<string>"


def test_structure_warnings(spark):
    rows = [
        (1, "issues", 0, 1, "Whether the lease ended early", None, None, "i1", None),
        (1, "issues", 1, 2, "Whether notice was needed", None, None, "i2", None),
        (1, "facts", 0, 1, "the tenant left", None, "event", None, []),
        (1, "facts", 1, 1, "the rent stopped", None, "event", None, ["i9"]),
        (1, "ratio", 0, 3, "the appellant must pay", "reasoning", None, None, ["i1"]),
        (1, "ratio", 1, 3, "a two-part test asks about notice", "rule", None, None, ["i2"]),
        (1, "decision", 0, 3, "lease ended", None, "conclusion", "i1", None),
        (1, "decision", 1, 3, "bananas are yellow", None, "conclusion", "i2", None),
        (1, "decision", 2, 3, "a two-part test asks about notice", None, "other", "i7", None),
        (1, "law", 0, 3, " ", None, None, None, None),
        (2, "issues", 0, 1, "Whether x", None, None, "a", None),
        (2, "issues", 1, 1, "Whether y", None, None, "a", None),
    ]
    items = spark.createDataFrame(rows, ITEMS)
    found = spark.createDataFrame([(1, 1, "plain"), (1, 2, "as held in 2001 SCC 4"), (1, 3, "the trial judge erred")], "doc_id int, anchor int, text string")
    parties = spark.createDataFrame([(1, "Maple Ltd.")], "doc_id int, name string")
    out = {(r["doc_id"], r["section"], r["idx"], r["message"]) for r in briefs.structure_warnings(items, found, parties).collect()}
    assert out == {
        (1, "issues", 1, "anchored to a paragraph that reviews another case"),
        (1, "facts", 0, "not tied to any issue"),
        (1, "facts", 1, "refers to an unknown issue"),
        (1, "ratio", 0, "applies the rule to this case's parties"),
        (1, "ratio", 0, "ratio does not start with the rule"),
        (1, "law", 0, "no proposition given for the authority"),
        (1, "decision", 2, "decision refers to an unknown issue"),
        (1, "decision", 1, "does not read as an answer to its issue"),
        (1, "decision", 2, "repeats a ratio item"),
        (1, "decision", None, "the rule is a staged test, but no stage has its own answer"),
        (2, "issues", None, "issue ids repeat"),
        (2, "decision", None, "issue has no decision"),
    }
    assert briefs.structure_warnings(items.limit(0), found, parties).count() == 0


def test_preliminary_law_and_cascade(spark):
    rows = [(1, "2004 CSC 7", "2004-05-06", "2004 SCC 8", date(2004, 5, 7), "Heard: May 6, 2004"), (2, None, "soon", None, None, "")]
    heads = spark.createDataFrame(rows, "doc_id int, citation string, decision_date string, record_citation string, record_date date, header string")
    assert {tuple(r) for r in briefs.preliminary_warnings(heads, F.col("header")).collect()} == {
        (1, "citation differs from the record's"), (1, "date differs from the record's"), (1, "date is the hearing date, not the date of decision"),
    }
    law = spark.createDataFrame([(1, 0, 2, "s. 5 of the Rent Act", "R", "5", date(2000, 1, 1)), (1, 1, 1, "Roe v. Doe, 2001 SCC 4", None, None, date(2000, 1, 1))], "doc_id int, idx int, anchor int, authority string, code string, section_no string, decision_date date")
    docs = spark.createDataFrame([(1, "the Rent Act binds; see other things")], "doc_id int, text string")
    found = spark.createDataFrame([(1, 1, "the Rent Act binds"), (1, 4, "see other things")], "doc_id int, anchor int, text string")
    sections = spark.createDataFrame([("R", "5", date(2010, 1, 1))], "code string, section_no string, in_force_start date")
    out = {r["idx"]: tuple(r)[2:] for r in briefs.law_checks(law, docs, found, sections).collect()}
    assert out == {0: (True, True, date(2010, 1, 1), True), 1: (False, False, None, False)}
    items = spark.createDataFrame(
        [(1, "issues", 0, 1, "Whether the lease ended", None, None, "i1", None), (1, "issues", 1, 1, "Whether interest is due", None, None, "i2", None), (1, "decision", 0, 1, "d", None, "conclusion", "i2", None), (1, "facts", 0, 1, "f", None, None, None, ["i2"]), (1, "facts", 1, 1, "g", None, None, None, ["i1", "i2"]), (1, "law", 0, 1, "l", None, None, None, None)],
        ITEMS,
    )
    undecided = spark.createDataFrame([(1, "Whether interest is due")], "doc_id int, text string")
    kept = {(r["section"], r["idx"], tuple(r["issue_ids"] or ())) for r in briefs.drop_undecided(items, undecided).collect()}
    assert kept == {("issues", 0, ()), ("facts", 1, ("i1",)), ("law", 0, ())}
