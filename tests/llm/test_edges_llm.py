"""Edge cases of the training-data operators and the pipeline against brute force."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import language_id, sharding
from citeloom.llm.common import keyed_join, spread_join
from citeloom.llm.html_lstm import labeller, training_pages
from citeloom.llm.near import shingle_similarity
from citeloom.llm.token_counts import section_tokens
from citeloom.llm.topk import top_products

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(words[x] for x in rng.integers(0, vocabulary, n))


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS)


# --- joins ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_keyed_join_with_and_without_broadcast(spark, how, limit):
    left = spark.createDataFrame([(i, i % 3 if i % 5 else None, "mine") for i in range(40)], "id int, k int, _salt string")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    out = keyed_join(left, right, ["k"], how, F.col("id"), broadcast_rows=limit)
    plain = left.join(right, ["k"], how)
    assert out.columns == plain.columns and sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))


def test_spread_join_of_a_hot_key(spark):
    left = spark.createDataFrame([(i, 0 if i < 300 else i) for i in range(320)], "id int, k int")
    right = spark.createDataFrame([(k, "v" * 9) for k in range(330)], "k int, v string")
    out = spread_join(left, right, "k", F.col("id"), key_rows=16)
    assert sorted(r["id"] for r in out.collect()) == list(range(320)) and out.columns == ["k", "id", "v"]


# --- operators ------------------------------------------------------------------------------------------------------


def test_language_profiles_of_long_and_far_texts(monkeypatch):
    text = prose(1, 300) + " Ünï \U0001d400\U0001d401 日本"
    whole = language_id.profile(text)
    monkeypatch.setattr(language_id, "_PART", 37)
    parts = language_id.profile(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert int(whole[1].sum()) == len(language_id.codes(text)) - 2
    assert (language_id.codes("\U0001d400") > 0).sum() == 1 and (language_id.codes("1 \U0001f600") > 0).sum() == 0


def test_language_stage_rejects_by_score_and_keeps_all_without_labels(spark):
    texts = [prose(2, 60), prose(2, 80), "12 34", None, "", "zzzzq"]
    docs = documents(spark, texts)
    model = language_id.learn(docs.where("doc_id < 2"), F.lit(True))
    kept = {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    assert {0, 1} <= kept and not kept & {2, 3, 4}
    assert {r["doc_id"] for r in language_id.keep_identified(docs, model, least=1.01).collect()} == set()
    none = language_id.learn(documents(spark, texts, None), F.lit(True))
    assert {r["doc_id"] for r in language_id.keep_identified(docs, none).collect()} == {0, 1, 5}


@pytest.mark.parametrize("seed", range(3))
def test_shards_reach_the_least_capacity(spark, seed):
    """The largest shard of the table's result is that of the best contiguous cut, over every way to cut its order."""
    rng = np.random.default_rng(seed)
    texts = [("t%d " % (i % 9)) * int(rng.integers(1, 30)) for i in range(14)] + ["same"] * 6
    out = sharding.shard_by_bytes(documents(spark, texts), shards=4).collect()
    size = {r["doc_id"]: r["size"] for r in out}
    groups = {}
    for r in out:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    filled = [sum(size[r["doc_id"]] for r in out if r["shard"] == s) for s in range(4)]
    # The order of the atomic groups is by shard; within a shard any order gives the same or a better cut.
    atoms = [[sum(size[d] for d, t in enumerate(texts) if t == g) for g, s in groups.items() if s == {shard}] for shard in range(4)]
    best = None
    for orders in itertools.islice(itertools.product(*(itertools.permutations(a) for a in atoms)), 200):
        line = [x for part in orders for x in part]
        for cuts in itertools.combinations_with_replacement(range(len(line) + 1), 3):
            edges = [0, *cuts, len(line)]
            most = max(sum(line[a:b]) for a, b in itertools.pairwise(edges))
            best = most if best is None else min(best, most)
    assert sum(filled) == sum(size.values())
    assert max(filled) >= best and max(filled) <= best + max(max(a, default=0) for a in atoms)


def test_token_counts_against_the_tokenizer_s_offsets(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["one\n two\n\nthree", "", None, "\n\n", "no newline at all", "é\nü ß\n☃ 日本\n", "tabs\t\n\t and  spaces \n x", prose(4, 300).replace(" ", "\n", 40)]
    out = section_tokens(documents(spark, texts), BPE, "first").collect()
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        ends = [i + 1 for i, b in enumerate(raw) if b == 10]
        ends = ends if ends and ends[-1] == len(raw) else [*ends, len(raw)]
        counts = [0] * len(ends)
        at = 0
        for piece in tok.encode(t or "", add_special_tokens=False).ids:
            counts[next(i for i, e in enumerate(ends) if at < e)] += 1
            at += len(tok.decode([piece]).encode()) if "�" not in tok.decode([piece]) else len(tok.id_to_token(piece))
        mine = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["section"])
        assert [r["n_tokens"] for r in mine] == counts and [r["start_byte"] + r["n_bytes"] for r in mine] == ends
    assert section_tokens(documents(spark, texts).limit(0), BPE).count() == 0


def test_top_products_repeated_ids_dimensions_and_blocks(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [2.0, 2.0, 5.0]), (2, [0.5]), (3, [-1.0, 0.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = top_products(df, df.where("vec_id % 50 = 0"), 3)
    assert out.where("query_id = 50").count() == 3 and out.where("query_id = vec_id").count() == 0
    assert sorted(r["score"] for r in out.where("query_id = 50").collect()) == [196608, 262144, 262144]
    whole = sorted(map(tuple, top_products(df, df, 3).collect()))
    monkeypatch.setattr("citeloom.llm.topk.QUERY_BLOCK", 2)
    assert sorted(map(tuple, top_products(df, df, 3).collect())) == whole
    with pytest.raises(Exception, match="64 bits"):
        top_products(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"), df, 3).collect()


def test_html_pages_without_telling_elements():
    """Pages of which no element is called article or main are labelled as well as the others."""
    model, right, total = labeller(), 0, 0
    for page, labels in training_pages(250, seed=991):
        if not any("article" in n or "main" in n for b in page for n in b.path):
            right += int(((model.label([page])[0] >= 0.5) == labels).sum())
            total += len(labels)
    assert total > 1000 and right / total > 0.98


# --- pipeline -------------------------------------------------------------------------------------------------------


def brute_pipeline(texts, kept_languages):
    """What the first four stages leave: texts by id, from definitions only."""
    left = {i: t for i, t in enumerate(texts) if i in kept_languages}
    norm = {}
    for i, t in left.items():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = {i: left[i] for i in norm.values()}
    root = {i: i for i in left}
    for a, b in itertools.combinations(left, 2):
        if shingle_similarity(left[a], left[b]) >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    words = {i: t.split() for i, t in left.items()}
    first = {}
    for i, w in words.items():
        for at in range(len(w) - 49):
            first.setdefault(tuple(w[at : at + 50]), i)
    out = {}
    for i, w in words.items():
        gone = {at + k for at in range(len(w) - 49) if first[tuple(w[at : at + 50])] < i for k in range(50)}
        if not gone:
            out[i] = left[i]
        elif len(gone) < len(w):
            out[i] = " ".join(x for at, x in enumerate(w) if at not in gone)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    body, shared = prose(31, 220), prose(32, 70)
    texts = [body, body.replace(" ", "  ", 5), None, "", " \n", "12 34 !", prose(33, 90)]
    for n in range(6):
        words = body.split()
        words[20 + 30 * n] = f"changed{n}"
        texts.append(" ".join(words))
        texts.append(f"{prose(40 + n, 50)} {shared} {prose(60 + n, 30)}")
    texts.append(shared)
    docs = documents(spark, texts)
    for column in ("_new", "_spans", "_salt", "part", "key", "fp"):
        docs = docs.withColumn(column, F.lit("x"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = corpus_pipeline.language_id(spark, now, str(tmp_path))
    languages = {r["doc_id"] for r in now.collect()}
    assert languages == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    expected = brute_pipeline(texts, languages)
    found = {r["doc_id"]: r for r in now.collect()}
    assert {i: r["text"] for i, r in found.items()} == expected and all(r["n_chars"] == len(r["text"]) and r["_new"] == "x" for r in found.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, t in expected.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        mine = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids)
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine]
    assert {r["doc_id"] for r in packed} == set(expected)


def test_pipeline_of_an_empty_and_an_unlabelled_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    documents(spark, [prose(1, 30), None, "7"], None).write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "plain")).collect()} == {0}
