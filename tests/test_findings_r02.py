"""One small test for each finding of the round: whole results, and steps whose rows don't grow with pairs or copies."""

import numpy as np
from pyspark.sql import functions as F

from citeloom.functions import chunking, text
from citeloom.operators import lexical, lookup, search, vector
from citeloom.plans import catalog


def test_key_terms_of_long_citation_numbers(spark):
    said = spark.createDataFrame([("Roe v. Doe, 2001 SCC 1234567",)], "t string")
    assert said.select(text.key_terms(F.col("t"))).first()[0] == ["2001 scc 1234567"]


def test_four_way_citing_ranks_a_brand_and_type_once(spark, tmp_path):
    """Twenty targets of one brand and type share one ranking; its rows aren't multiplied by the targets before."""
    parts = [(i, "b" if i % 2 == 0 else "c", "t") for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, p) for k in range(60) for p in (k, k + 2)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, float(k % 7)) for k in range(60)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    df = catalog.QUERIES["four_way_citing"](spark, str(tmp_path))
    best = sorted((-float(k % 7), k) for k in range(0, 60, 2))[:20]
    want = {(t, k, -p, n + 1) for t in range(0, 400, 20) for n, (p, k) in enumerate(best)}
    assert {tuple(r) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line or "WindowGroupLimit" in line]
    assert windows and all("target" not in line for line in windows)


def test_by_name_scores_a_pair_of_texts_once(spark):
    """Copies of a name and of a query aren't scored again; first cases by citations, then id, as without a limit."""
    cases = spark.createDataFrame([(i, ("red ring", "red rings", "old bolt")[i % 3], i * 7 % 5) for i in range(60)], "case_id long, name string, cited_by_count int")
    asked = spark.createDataFrame([(str(i), "red ring") for i in range(8)], "query_id string, text string")
    found = lookup.by_name(cases, asked, limit=4)
    all_of = lookup.by_name(cases, asked)
    assert all_of.count() == 8 * 40
    want = {}
    for r in all_of.collect():
        want.setdefault(r["query_id"], []).append((-r["score"], -r["cited_by_count"], r["case_id"]))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((-r["score"], -r["cited_by_count"], r["case_id"]))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:4] for q, v in want.items()}
    python = found._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1].splitlines()[1]
    assert "case_id" not in python and "query_id" not in python


def test_task_keeps_k_rows_a_query_whatever_the_copies():
    """Blocks of copies leave k rows a query, the smaller ids, where every copy was sent on before."""
    from citeloom.operators.best import Best, sortable

    import pyarrow as pa

    best = Best(3, 4)
    for at in range(6000, 0, -2000):
        names, _ = sortable(pa.array(range(at - 1, at - 2001, -1)))
        best.add(0, np.zeros((3, 2000)), names, 6)
        best.add(1, np.full((2, 2000), np.nan), names, 6)
    rows = [(int(q), int(i), v) for qs, ids, vs in best.rows() for q, i, v in zip(qs, ids, vs)]
    assert rows == [(q, i, 0.0) for q in range(3) for i in range(4)]


def test_cosine_topk_of_named_items_and_copies(spark):
    rows = [(f"n{i:04d}", [1.0, 0.0]) for i in range(3000)] + [("far", [0.0, 1.0]), ("gone", None), ("bad", [1.0, None])]
    items = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "query_id int, query array<float>")
    out = vector.cosine_topk(items, asked, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["item_id"], r["dist"]) for r in out) == [(1, 1, "n0000", 0.0), (1, 2, "n0001", 0.0), (2, 1, "far", 0.0), (2, 2, "n0000", 1.0)]


def test_nearest_chunk_of_every_case(spark, tmp_path):
    """All labels for all queries, no third of them."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=5)], i % 7) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = catalog.QUERIES["nearest_chunk_per_case"](spark, str(tmp_path)).collect()
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, c): min((round(1 - float(v[q] @ v[i]), 6) + 0.0, i) for i in range(c, 200, 7)) for q in range(0, 200, 20) for c in range(7)}
    assert {(r["query_id"], r["case_id"]): r["chunk_id"] for r in out} == {k: x[1] for k, x in want.items()} and len(out) == 70
    assert all(abs(r["dist"] - want[r["query_id"], r["case_id"]][0]) < 2e-6 for r in out)


def test_bm25_makes_no_row_of_a_query_and_document(spark):
    """Scores equal the rule's, whatever the blocks; what leaves the tasks is k rows a query, joined or summed with nothing."""
    import math
    import re

    docs = [(i, " ".join(f"W{j}" for j in range(i % 9 + 1) for _ in range(i % 3 + 1))) for i in range(700)] + [(700, None), (701, "")]
    asked = [(1, "w0 w3, w3"), (2, "w8 zzz"), (3, "zzz"), (4, None), (1, "w7")]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, text string")
    toks = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, toks.values())) / len(toks)
    want = set()
    for query, terms in ((1, ("w0", "w3", "w7")), (2, ("w8",))):
        score = {}
        for t in terms:
            df = sum(t in x for x in toks.values())
            for i, x in toks.items():
                if n := x.count(t):
                    score[i] = score.get(i, 0) + math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items() if i % 2)[:5]
        want |= {(query, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    allowed = d.where("doc_id % 2 = 1").select("doc_id")
    for limit in (5_000, 1):
        assert {tuple(r) for r in lexical.bm25_topk(d, q, 5, allowed, query_limit=limit).collect()} == want
    plan = lexical.bm25_topk(d, q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan


def test_supported_sections_sorts_once(spark):
    """Named laws, laws of list 0 or with seeds, and laws that are null, by one window instead of joins with copies of the table."""
    rows = [(1, 0, 1, c, f"{c}{n}", n % 2, n % 3, 0.0 - n * 3) for c in ("a", "b", None) for n in range(4)] + [(1, 1, 1, c, f"{c}{n}", n % 2, n % 3, 0.0 - n * 3) for c in ("a", "b", "d", None) for n in range(4)]
    sections = spark.createDataFrame(rows, "scenario_id int, list_no int, rank int, code string, section_no string, cited_by_count int, n_seeds int, rerank_score double")
    named = spark.createDataFrame([(1, "d"), (1, "d"), (1, None), (2, "a")], "scenario_id int, code string")
    df = search.supported_sections(sections, named)
    want = []
    for r in rows:
        told = r[3] == "d"
        kept = told or r[5] > 0
        held = r[3] is not None and (told or any(x[3] == r[3] and x[5] > 0 and (x[1] == 0 or x[6] > 0) for x in rows))
        if kept and (r[1] == 0 or held and r[7] > -5):
            want.append((r[1], r[3], r[4]))
    assert sorted(map(str, ((r["list_no"], r["code"], r["section_no"]) for r in df.collect()))) == sorted(map(str, want))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_chunks_leave_a_batch_in_parts(spark):
    """A batch of many texts isn't held as one table of chunks."""
    rows = [(i, " ".join(f"word{i} is here." for _ in range(200))) for i in range(40)] + [(40, None), (41, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = chunking.chunks(docs).collect()
    want = [(i, n, None, None, w) for i, t in rows[:40] for n, w in enumerate(chunking.windows(t))]
    assert sorted(map(tuple, out)) == want
    texts = [(i, t * 20) for i, t in rows[:40]]
    parts = list(chunking.chunk_parts(texts, 10_000))
    assert len(parts) == 40 and max(sum(len(c[4]) for c in p) for p in parts) < 2 * len(texts[-1][1])
