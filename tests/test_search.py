"""Composed searches, sections and citator operators on small literal inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import citator, evaluation, search


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame(
        [(1, 10, "red fox runs", [1.0, 0.0]), (2, 10, "blue hen", [0.0, 1.0]), (3, 11, "red hen", [0.7, 0.7]), (4, 12, "green", [0.0, 1.0]), (5, 13, None, None)],
        "chunk_id long, case_id long, text string, embedding array<double>",
    )
    meta = spark.createDataFrame([(10, "SCC", 3), (11, "FC", 0), (12, "X", 0), (13, "X", 9)], "case_id long, court string, cited_by_count long")
    edges = spark.createDataFrame([(10, 13), (11, 13), (12, 13), (10, 99), (11, 99)], "src long, dst long")
    return {"chunks": chunks, "meta": meta, "edges": edges}


def test_search_modes_and_graph(spark, corpus):
    queries = spark.createDataFrame([(1, "red fox", [1.0, 0.1])], "query_id int, text string, vector array<double>")
    order = lambda **kw: [r["case_id"] for r in search.search(queries=queries, **corpus, **kw).orderBy("final_rank").collect()]
    assert order(mode="lexical") == [10, 11]
    assert order(mode="vector")[0] == 10
    assert order()[0] == 10 and 13 in order() and 99 not in order()  # 13 comes in through three seeds; 99 is no case
    assert order(allowed=corpus["meta"].where("court = 'FC'")) == [11]
    assert order(k=1) == [10]
    none = search.search(queries=queries.limit(0), **corpus)
    assert none.count() == 0


def test_scorer_decides_the_head_and_null_scores_fail_the_gate(spark, corpus):
    queries = spark.createDataFrame([((7, 0), "red", [1.0, 0.0]), ((7, 1), "hen", [0.0, 1.0])], "query_id struct<scenario_id: int, list_no: int>, text string, vector array<double>")

    def scorer(pairs):
        return pairs.select("query_id", "case_id", F.when(F.col("case_id") == 12, 5.0).otherwise(-3.0).alias("rerank_score"))

    found = search.search(queries=queries, scorer=scorer, **corpus)
    lists = search.gated_lists(found)
    assert {r["item"] for r in lists.where("list_no = 1").collect()} == {12}
    groups = search.search_scenario(queries=queries, scorer=scorer, k=3, lead=1, **corpus).collect()
    assert [r["item"] for r in groups if r["group_no"] == 1] == [12]
    assert all(r["is_pointer"] for r in groups if r["group_no"] == 1)
    flat = search.flat_list(spark.createDataFrame([(7, 0, "a", 1), (7, 1, "b", 1), (7, 1, "a", 2), (7, 2, "c", 1)], "scenario_id int, group_no int, item string, position int"))
    assert [r["item"] for r in flat.orderBy("place").collect()] == ["a", "b", "c"]


def test_scenario_queries(spark):
    rows = spark.createDataFrame([(1, "x" * 5000, "both", ["one", " ", None, "two"]), (2, None, "c", None)], "scenario_id int, text string, combined string, issues array<string>")
    out = sorted((*r["query_id"], len(r["text"]), r["text"][:4]) for r in search.scenario_queries(rows).collect())
    assert out == [(1, 0, 4000, "xxxx"), (1, 1, 4, "both"), (1, 2, 3, "one"), (1, 3, 3, "two"), (2, 1, 1, "c")]


@pytest.mark.parametrize("bad", [{"query": " "}, {"query": "q" * 4001}, {"k": 0}, {"k": 51}, {"mode": "x"}, {"courts": ("A1",)}, {"date_from": date(2002, 1, 2), "date_to": date(2002, 1, 1)}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        search.Request(**{"query": "q", **bad})


def test_request_filters_are_optional_and_inclusive(spark):
    cases = spark.createDataFrame([(1, "SCC", date(2000, 1, 1)), (2, "FC", date(2001, 1, 1)), (3, "SCC", None)], "case_id int, court string, decision_date date")
    ids = lambda **kw: sorted(r["case_id"] for r in search.Request("q", **kw).allowed(cases).collect())
    assert ids() == [1, 2, 3] and ids(courts=("scc",)) == [1, 3] and ids(date_from=date(2000, 1, 1), date_to=date(2000, 1, 1)) == [1]


def test_supported_sections(spark):
    rows = [(1, 0, 1, "A", "1", 0, 0, None), (1, 0, 2, "B", "2", 4, 0, None), (1, 1, 1, "B", "3", 1, 0, -4.0), (1, 1, 2, "B", "4", 1, 0, -5.0), (1, 1, 3, "C", "5", 1, 0, 9.0), (1, 2, 1, "D", "6", 1, 1, 0.0), (1, 2, 2, "N", "7", 0, 0, 0.0)]
    sections = spark.createDataFrame(rows, "scenario_id int, list_no int, rank int, code string, section_no string, cited_by_count int, n_seeds int, rerank_score double")
    named = spark.createDataFrame([(1, "N")], "scenario_id int, code string")
    assert sorted(r["section_no"] for r in search.supported_sections(sections, named).collect()) == ["2", "3", "6", "7"]


def test_citator(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(citator.corpus_citations(F.lit("2001 CanLII 5 (ON CA), 2003 ONCA 7, [1999] 2 SCR 817"))) == ["2003 ONCA 7", "[1999] 2 SCR 817"]
    assert one(citator.describe(F.lit("T"), F.lit(None), F.lit("k"))) == "T. k"
    assert one(citator.tolerant_date(F.lit("2001-02-30"))) is None and one(citator.tolerant_date(F.lit("2001-2-3"))) is None
    scored = spark.createDataFrame([(1, "a", 1, -4.0), (1, "b", 2, None), (1, "c", 3, 2.0), (1, "d", 4, -4.5)], "query_id int, candidate string, rank int, rerank_score double")
    assert [r["candidate"] for r in citator.best_candidates(scored, 5).orderBy("final_rank").collect()] == ["c", "a"]
    assert one(text.key_terms(F.lit("s. 78.1(1) of the Highway Act, s. 3"))) == ["highway act"] and one(text.key_terms(F.lit("Act"))) == []
    assert one(text.leaks(F.lit("Mr. Lopez saw 2001 SCC 4"), F.lit("Lopez v. Canada"))) == ["2001 SCC 4", "Lopez"]
    assert one(text.related_query(F.array(F.lit("Whether he may"), F.lit("who")), F.array(F.lit("he fell")))) == "he may; who; he fell"


def test_evaluation_of_texts_and_briefs(spark):
    docs = spark.createDataFrame([(1, "a passage here"), (2, "A passage"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("x", "a passage"), ("y", "passage"), ("z", ""), ("w", None), ("v", "passage")], "item_id string, text string")
    assert sorted(map(tuple, evaluation.containing(docs, asked).collect())) == [("v", 1), ("v", 2), ("x", 1), ("y", 1), ("y", 2)]
    assert evaluation.containing(docs, asked.limit(0)).count() == 0
    pairs = spark.createDataFrame([(1, "pdf", "a b c", "a c"), (2, "pdf", None, "")], "query_id int, fmt string, original string, extracted string")
    assert {r["query_id"]: r["score"] for r in evaluation.word_agreement(pairs).collect()} == {1: 0.8, 2: 1.0}
    gold = spark.createDataFrame([(1, "facts", 1, 2), (1, "law", 1, 9)], "doc_id int, section string, least int, most int")
    terms = spark.createDataFrame([(1, "facts", "R. v. X", True), (1, "facts", "secret", False)], "doc_id int, section string, term string, wanted boolean")
    items = spark.createDataFrame([(1, "facts", "r v x was cited")], "doc_id int, section string, text string")
    assert tuple(evaluation.brief_scores(gold, terms, items).first()) == (1, 4, 3)
