"""SQL for DuckDB that gives the rows of the queries in ``catalog``."""

from __future__ import annotations

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _bm25(k: int, allowed: str = "") -> str:
    return f"""
        WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
        len AS (SELECT doc_id, len(toks) AS dl FROM d),
        tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
        s AS (
            SELECT query_id, doc_id,
                   round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN tot {allowed} GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {k}"""


def _cosine(k: int, source: str = "embeddings", name: str = "c") -> str:
    return f"""
        {name}v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {source}),
        {name}s AS (
            SELECT q.vec_id AS query_id, i.vec_id AS item_id,
                   round(1 - list_inner_product(i.e, q.e) / (sqrt(list_inner_product(i.e, i.e)) * sqrt(list_inner_product(q.e, q.e))), 6) + 0.0::DOUBLE AS dist
            FROM {name}v q JOIN {name}v i ON q.vec_id % 20 = 0),
        {name} AS (
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS INTEGER) AS rank FROM {name}s)
            WHERE rank <= {k})"""


_HITS = f"""
        half AS (SELECT vec_id, embedding[1:8] AS embedding FROM embeddings), {_cosine(50, "embeddings", "f")}, {_cosine(50, "half", "h")},
        hits AS (
            SELECT query_id, 'vector' AS source, rank, item_id AS chunk_id, label AS case_id FROM f JOIN embeddings ON vec_id = item_id
            UNION ALL
            SELECT query_id, 'lexical', rank, item_id, label FROM h JOIN embeddings ON vec_id = item_id)"""

_SEEDS = """
        seeds AS (
            SELECT * FROM (
                SELECT o_orderpriority AS query_id, o_orderkey AS src,
                       CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS seed_rank
                FROM orders)
            WHERE seed_rank <= 30)"""


def _support(rank: int) -> str:
    return f"""
        g AS (
            SELECT query_id, dst, count(*) AS n_seeds, round(sum(1.0::DOUBLE / (60 + seed_rank)), 12) AS support
            FROM seeds JOIN (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem) USING (src)
            WHERE seed_rank <= {rank} GROUP BY ALL HAVING count(*) >= 2),
        graph AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY support DESC, dst) AS INTEGER) AS graph_rank FROM g)"""


_KEYS = "keys AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1)"

_LISTS = """
        lists AS (
            SELECT CAST(floor(conv_id / 5) AS BIGINT) AS grp, CAST(conv_id % 5 AS INTEGER) AS list_no, turn + 1 AS rank,
                   CAST(length(text) % 17 AS INTEGER) AS item
            FROM conversations WHERE text IS NOT NULL)"""


def _interleave(k: str) -> str:
    return f"""
        firsts AS (SELECT grp, item, min({{'rank': rank, 'list_no': list_no}}) AS met FROM lists GROUP BY ALL),
        inter AS (
            SELECT * FROM (SELECT grp, item, CAST(row_number() OVER (PARTITION BY grp ORDER BY met, item) AS INTEGER) AS position FROM firsts)
            WHERE position <= {k})"""


_MERGED = f"""
        {_interleave("11")},
        head AS (SELECT grp, item, min(rank) AS position FROM lists WHERE list_no = 0 AND rank <= 3 GROUP BY ALL),
        parts AS (
            SELECT grp, item, position, 0 AS part FROM head
            UNION ALL SELECT grp, item, position, 1 FROM inter ANTI JOIN head USING (grp, item)),
        merged AS (
            SELECT * FROM (
                SELECT grp, item, CAST(row_number() OVER (PARTITION BY grp ORDER BY part, position) AS INTEGER) AS position FROM parts)
            WHERE position <= 8)"""

# Stop words as the original has them.
_STOP = (
    "['the','and','for','that','was','with','his','her','this','not','are','which','from','has','had','have','its','one',"
    "'any','but','all','who','him','she','they','them','their','there','been','will','would','were','what','when','where',"
    "'than','then','into','also','only','such','may','can','could','should','shall','our','out']"
)


def _words(text: str) -> str:
    folded = f"lower(replace(translate({text}, '‘’“”–—‑', chr(39) || chr(39) || '\"\"---'), '.', ''))"
    return f"list_filter(list_distinct(regexp_extract_all({folded}, '[a-z0-9]+')), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


# What the orders' sentences cite, told from the keys and not from the text.
_CITED = """
        c AS (
            SELECT o_orderkey AS id, o_orderkey AS k, CAST(year(o_orderdate) AS VARCHAR) AS y,
                   ['CSC','CF','CAF','CFPI','CCI','CACM','TCDP','CCRI','TCCE','CRTFP','TSS','ONCA','SCC','FCA','BCSC'][o_orderkey % 15 + 1] AS court,
                   ['SCC','FC','FCA','FCT','TCC','CMAC','CHRT','CIRB','CITT','FPSLREB','SST','ONCA','SCC','FCA','BCSC'][o_orderkey % 15 + 1] AS english
            FROM orders),
        regs AS (
            SELECT id, 'O. Reg. ' || (k % 900 + 1) || '/' || right(y, 2) AS citation, right(y, 2) || lpad(CAST(k % 900 + 1 AS VARCHAR), 4, '0') AS alias FROM c
            UNION ALL SELECT id, 'R.R.O. 1990, Reg. ' || (k % 1100 + 1), '90' || lpad(CAST(k % 1100 + 1 AS VARCHAR), 4, '0') FROM c)"""

_CORPUS = """
        chunks AS (SELECT doc_id AS chunk_id, doc_id // 4 AS case_id FROM documents),
        meta AS (
            SELECT case_id, ['SCC', 'FCA', 'FC', 'ONCA'][case_id % 4 + 1] AS court, coalesce(n, 0) AS cited_by_count
            FROM (SELECT DISTINCT case_id FROM chunks)
            LEFT JOIN (SELECT l_partkey % 997 AS dst, count(DISTINCT l_orderkey % 997) AS n FROM lineitem GROUP BY 1) ON dst = case_id),
        prior AS (
            SELECT case_id, 0.002::DOUBLE * map {'SCC': 1.0::DOUBLE, 'FCA': 0.6, 'FC': 0.4, 'ONCA': 0.2}[court] + 0.004::DOUBLE * ln(1 + cited_by_count::DOUBLE) / ln(10001::DOUBLE) AS p FROM meta),
        edges AS (SELECT DISTINCT l_orderkey % 997 AS src, l_partkey % 997 AS dst FROM lineitem WHERE l_partkey % 997 IN (SELECT case_id FROM meta))"""

_FUSED = """
        ranks AS (
            SELECT query_id, source, case_id, row_number() OVER (PARTITION BY query_id, source ORDER BY r, case_id) AS cr
            FROM (SELECT query_id, source, case_id, min(rank) AS r FROM hits GROUP BY ALL)),
        sums AS (
            SELECT query_id, case_id, round(sum(1.0::DOUBLE / (60 + cr)), 12) AS score, min(cr) FILTER (WHERE source = 'lexical') AS lr, min(cr) FILTER (WHERE source = 'vector') AS vr
            FROM ranks GROUP BY ALL),
        fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lr NULLS LAST, vr NULLS LAST, case_id) AS position FROM sums)"""


def _graph(name: str, seeds: int) -> str:
    return f"""
        {name} AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, dst) AS graph_rank
            FROM (SELECT query_id, dst, round(sum(1.0::DOUBLE / (60 + position)), 12) AS support
                  FROM fused JOIN edges ON src = case_id WHERE position <= {seeds} GROUP BY ALL HAVING count(*) >= 2))"""


#: A hybrid search of all passages, reranked: relation ``blended`` with final_rank.
_HYBRID = f"""
        lex AS ({_bm25(200)}), {_CORPUS},
        asked AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
        vecs AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM chunks)),
        dists AS (
            SELECT query_id, chunk_id, round(1 - list_inner_product(v.e, a.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(a.e, a.e))), 6) AS dist
            FROM asked a, vecs v),
        near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank FROM dists),
        hits AS (
            SELECT query_id, source, rank, chunk_id, case_id FROM (
                SELECT query_id, 'lexical' AS source, rank, doc_id AS chunk_id FROM lex
                UNION ALL SELECT query_id, 'vector', rank, chunk_id FROM near WHERE rank <= 200) JOIN chunks USING (chunk_id)),
        {_FUSED}, {_graph("g20", 20)}, {_graph("g30", 30)},
        grown AS (
            SELECT coalesce(f.query_id, g.query_id) AS query_id, coalesce(f.case_id, g.dst) AS case_id, round(coalesce(score, 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0), 12) AS score
            FROM fused f FULL JOIN g20 g ON f.query_id = g.query_id AND f.case_id = g.dst),
        scored AS (SELECT query_id, case_id, round(score + coalesce(p, 0), 12) AS score FROM grown LEFT JOIN prior USING (case_id)),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY r, chunk_id) AS n
            FROM (SELECT query_id, case_id, chunk_id, min(rank) AS r FROM hits GROUP BY ALL)),
        fresh AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_rank, dst) AS n
            FROM g30 g WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = g.query_id AND f.case_id = g.dst)),
        close AS (
            SELECT query_id, case_id, arg_min(chunk_id, {{'d': dist, 'c': chunk_id}}) AS chunk_id
            FROM dists JOIN chunks USING (chunk_id) GROUP BY ALL),
        pool AS (
            SELECT f.query_id, f.case_id, chunk_id FROM fused f JOIN best b ON f.query_id = b.query_id AND f.case_id = b.case_id WHERE position <= 40 AND n <= 2
            UNION ALL SELECT f.query_id, dst, chunk_id FROM fresh f JOIN close c ON f.query_id = c.query_id AND f.dst = c.case_id WHERE n <= 20),
        judged AS (SELECT query_id, case_id, CAST(max((chunk_id * 37 + case_id * 11) % 101 - 50) AS DOUBLE) AS rerank_score FROM pool GROUP BY ALL),
        placed AS (
            SELECT *, position > 40 AS tail FROM (
                SELECT query_id, case_id, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS position
                FROM scored LEFT JOIN judged USING (query_id, case_id))),
        again AS (
            SELECT *, CASE WHEN NOT tail AND rerank_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, tail, rerank_score IS NULL ORDER BY rerank_score DESC, position) END AS rr FROM placed),
        mixed AS (SELECT query_id, case_id, rerank_score, tail, position, round(CASE WHEN tail THEN score ELSE 1.0::DOUBLE / (60 + position) + coalesce(1.0::DOUBLE / (60 + rr), 0) END, 12) AS score FROM again),
        blended AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tail, score DESC, position) AS INTEGER) AS final_rank FROM mixed)"""

ORACLES: dict[str, str] = {
    "group_count_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "filtered_semi_join": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "case_filter_dates": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'""",
    "anti_join_unlabelled": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "exists_sample_filter": """SELECT doc_id, n_chars FROM documents d WHERE lang = 'en' AND length(text) BETWEEN 500 AND 20000
        AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0)""",
    "edge_in_degree": """SELECT p_partkey, coalesce(n, 0) AS cited_by_count FROM part
        LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "distinct_on_best": """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, p_brand FROM (
            SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
            ORDER BY l_partkey, l_extendedprice DESC, l_orderkey, l_linenumber) JOIN part ON p_partkey = l_partkey""",
    "four_way_citing": """SELECT target, o_orderkey, o_totalprice, rank FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM (
                SELECT DISTINCT t.p_partkey AS target, o_orderkey, o_totalprice FROM part t JOIN part s USING (p_brand, p_type)
                JOIN lineitem ON l_partkey = s.p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE t.p_partkey % 20 = 0)) WHERE rank <= 20""",
    "ambiguous_key_drop": f"WITH {_KEYS} SELECT * FROM keys",
    "citation_resolve": f"""WITH {_KEYS} SELECT DISTINCT l_orderkey AS src, k.p_partkey AS dst FROM lineitem
        JOIN part p ON p.p_partkey = l_partkey JOIN keys k USING (p_brand, p_type, p_size) WHERE l_orderkey <> k.p_partkey""",
    "year_fallback_resolve": """WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders),
        k AS (SELECT o_custkey, y, min(o_orderkey) AS id FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY ALL HAVING count(DISTINCT o_orderkey) = 1),
        r AS (SELECT o.o_orderkey AS src, coalesce(a.id, b.id) AS dst FROM o
              LEFT JOIN k a ON a.o_custkey = o.o_custkey AND a.y = o.y LEFT JOIN k b ON b.o_custkey = o.o_custkey AND b.y = o.y - 1
              WHERE o_orderpriority = '5-LOW')
        SELECT src, dst FROM r WHERE dst IS NOT NULL AND dst <> src""",
    "range_with_fallback": """SELECT ref_id, l_linenumber, covers FROM (
            SELECT DISTINCT ON (o_orderkey) o_orderkey AS ref_id, l_linenumber,
                   l_quantity <= o_totalprice / 10 AND o_totalprice / 10 <= l_extendedprice AS covers
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY o_orderkey, covers DESC, l_linenumber)""",
    "or_join_union": """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        OR o_orderkey IN (SELECT c_custkey FROM customer)""",
    "first_wins_edges": """SELECT src, dst, source, position FROM (
            SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS source, l_linenumber AS position,
                   row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY instr('RAN', l_returnflag), l_linenumber) AS n FROM lineitem) WHERE n = 1""",
    "best_confidence_edges": """SELECT src, dst, confidence, position FROM (
            SELECT l_orderkey AS src, l_suppkey AS dst, l_discount AS confidence, l_linenumber AS position,
                   row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_discount DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""",
    "section_counts_written_back": """SELECT p_partkey, coalesce(n, 0) AS cited_by_count FROM part LEFT JOIN (
            SELECT p_brand, p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) USING (p_brand, p_type)""",
    "group_min_edges": "SELECT l_orderkey, p_brand, min(p_partkey) AS first_part FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "ingest_stats": """SELECT coalesce(source, 'total') AS source, count(*) AS rows, count(*) FILTER (WHERE length(text) > 0) AS loadable,
        count(text) - count(DISTINCT text) AS dups, round(avg(length(coalesce(text, ''))), 3) AS avg_chars FROM documents GROUP BY ROLLUP (source)""",
    "stratified_sample": """SELECT doc_id, source, rn FROM (SELECT doc_id, source, CAST(row_number() OVER (
            PARTITION BY source ORDER BY md5('seed1:' || doc_id), doc_id) AS INTEGER) AS rn FROM documents) WHERE rn <= 3""",
    "latest_wins_upsert": """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "hourly_rolling": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS queries FROM events GROUP BY 1)
        SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, queries,
               CAST(sum(queries) OVER (ORDER BY hour RANGE BETWEEN INTERVAL 86399 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS used_24h FROM h""",
    "ttl_filter": "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 30 DAYS GROUP BY 1",
    "clean_text": r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(
            replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t\x{00A0}]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS clean_md5 FROM documents""",
    "overlap_words": f"""WITH w AS (SELECT doc_id, {_words("text")} AS a, {_words("substring(text, 1, 400)")} AS b FROM documents)
        SELECT doc_id, CAST(len(a) AS INTEGER) AS n_words,
               round(CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 6) AS overlap,
               round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE
                          ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM w""",
    "content_hash_dedupe": r"""SELECT sha256(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS content_hash, min(doc_id) AS doc_id
        FROM documents GROUP BY 1""",
    "neutral_citation_extract": f"""WITH {_CITED}
        SELECT id, 0 AS pos, y || ' ' || court || ' ' || (k % 99999 + 1) AS raw, y || ' ' || english || ' ' || (k % 99999 + 1) AS canonical FROM c
        UNION ALL SELECT id, 1, r, r FROM (SELECT id, '[' || y || '] ' || (k % 3 + 1) || ' SCR ' || (k % 9999 + 1) AS r FROM c)""",
    "regulation_refs_extract": f"WITH {_CITED} SELECT id, citation, alias FROM regs",
    "json_section_explode": """SELECT event_id, key AS section_no, json_extract_string(props, '$."' || key || '"') AS text
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    "title_expansion": """SELECT p_partkey, p_name AS title FROM part UNION SELECT p_partkey, lower(p_name) FROM part WHERE len(string_split(p_name, ' ')) >= 2
        UNION SELECT p_partkey, replace(p_brand, 'Brand#', 'Brand ') FROM part""",
    "bm25_topk": _bm25(10),
    "bm25_filtered": _bm25(5, "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "cosine_topk": f"WITH {_cosine(20)} SELECT query_id, item_id, dist, rank FROM c",
    "rrf_fuse": f"""WITH {_HITS},
        ranks AS (
            SELECT query_id, source, case_id, row_number() OVER (PARTITION BY query_id, source ORDER BY r, case_id) AS cr
            FROM (SELECT query_id, source, case_id, min(rank) AS r FROM hits GROUP BY ALL)),
        s AS (
            SELECT query_id, case_id, round(sum(1.0::DOUBLE / (60 + cr)), 12) AS score, CAST(min(cr) FILTER (WHERE source = 'lexical') AS INTEGER) AS lexical_rank,
                   CAST(min(cr) FILTER (WHERE source = 'vector') AS INTEGER) AS vector_rank FROM ranks GROUP BY ALL)
        SELECT query_id, case_id, round(score, 9) AS score, lexical_rank, vector_rank, CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST, case_id) AS INTEGER) AS position FROM s""",
    "best_passages": f"""WITH {_HITS},
        m AS (SELECT query_id, case_id, chunk_id, string_agg(DISTINCT source, ',' ORDER BY source) AS matched_by, min(rank) AS best_rank FROM hits GROUP BY ALL)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, case_id ORDER BY best_rank, chunk_id) AS INTEGER) AS passage_no FROM m)
        WHERE passage_no <= 3""",
    "seed_support": f"WITH {_SEEDS}, {_support(30)} SELECT query_id, dst, n_seeds, round(support, 9) AS support, graph_rank FROM graph",
    "graph_expand": f"""WITH {_SEEDS}, {_support(20)},
        base AS (SELECT query_id, CAST(seed_rank AS BIGINT) AS case_id, round(1.0::DOUBLE / (60 + seed_rank), 12) AS score FROM seeds WHERE seed_rank <= 10),
        g2 AS (SELECT query_id, dst AS case_id, n_seeds, graph_rank FROM graph)
        SELECT query_id, case_id, round(coalesce(score, 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0), 9) AS score, n_seeds, graph_rank
        FROM base FULL JOIN g2 USING (query_id, case_id)""",
    "authority_prior": """SELECT p_partkey, round(0.002::DOUBLE * [1.0::DOUBLE, 0.6, 0.4, 0.2][p_partkey % 4 + 1] + 0.004::DOUBLE * ln(1 + n::DOUBLE) / ln(10001::DOUBLE), 9) AS prior
        FROM (SELECT p_partkey, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)""",
    "rerank_blend": f"""WITH {_cosine(60)},
        p AS (SELECT query_id, item_id AS case_id, round(1.0::DOUBLE / (60 + rank), 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank), 12) DESC, item_id) AS position FROM c),
        t AS (SELECT *, position > 40 AS is_tail, CASE WHEN case_id % 3 <> 0 THEN case_id * 37 % 101 END AS rs FROM p),
        r AS (SELECT *, CASE WHEN NOT is_tail AND rs IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY query_id, is_tail, rs IS NULL ORDER BY rs DESC, position) AS INTEGER) END AS rerank_rank FROM t),
        b AS (SELECT *, round(CASE WHEN is_tail THEN score ELSE 1.0::DOUBLE / (60 + position) + coalesce(1.0::DOUBLE / (60 + rerank_rank), 0) END, 12) AS s FROM r)
        SELECT query_id, case_id, round(s, 9) AS score, is_tail, rerank_rank,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY is_tail, s DESC, position) AS INTEGER) AS final_rank FROM b""",
    "section_rank": f"""WITH {_SEEDS},
        e AS (SELECT DISTINCT l_orderkey AS src, p_brand, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
        cnt AS (SELECT p_brand, p_size, count(*) AS n FROM e GROUP BY ALL),
        l AS (SELECT * FROM (
            SELECT 'lexical' AS source, p_brand, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
            UNION ALL SELECT 'vector', p_brand, p_size, row_number() OVER (ORDER BY p_name, p_partkey) FROM part) WHERE rank <= 50),
        lr AS (SELECT source, p_brand, p_size, row_number() OVER (PARTITION BY source ORDER BY r, p_brand, p_size) AS cr
               FROM (SELECT source, p_brand, p_size, min(rank) AS r FROM l GROUP BY ALL)),
        txt AS (SELECT query_id, p_brand, p_size, ts FROM (SELECT DISTINCT query_id FROM seeds),
                (SELECT p_brand, p_size, round(sum(1.0::DOUBLE / (60 + cr)), 12) AS ts FROM lr GROUP BY ALL)),
        g AS (SELECT query_id, p_brand, p_size, count(*) AS n_seeds, round(sum(1.0::DOUBLE / (60 + seed_rank)), 12) AS support
              FROM seeds JOIN e USING (src) WHERE seed_rank <= 20 GROUP BY ALL HAVING count(*) >= 2),
        gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY support DESC, p_brand, p_size) AS INTEGER) AS graph_rank FROM g),
        s AS (SELECT query_id, p_brand, p_size, n_seeds, graph_rank, round(coalesce(ts, 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0)
                     + 0.004::DOUBLE * ln(1 + coalesce(n, 0)::DOUBLE) / ln(20001::DOUBLE), 12) AS sc
              FROM txt FULL JOIN gr USING (query_id, p_brand, p_size) LEFT JOIN cnt USING (p_brand, p_size))
        SELECT * FROM (SELECT query_id, p_brand, p_size, round(sc, 9) AS score, n_seeds, graph_rank,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, p_brand, p_size) AS INTEGER) AS section_rank FROM s) WHERE section_rank <= 40""",
    "interleave": f"WITH {_LISTS}, {_interleave('10')} SELECT grp, item, position FROM inter",
    "merge_issues": f"WITH {_LISTS}, {_MERGED} SELECT grp, item, position FROM merged",
    "merge_group": f"""WITH {_LISTS}, {_MERGED},
        own AS (SELECT * FROM (SELECT grp, list_no AS group_no, item, CAST(row_number() OVER (PARTITION BY grp, list_no ORDER BY r, item) AS INTEGER) AS position
                FROM (SELECT grp, list_no, item, min(rank) AS r FROM lists WHERE list_no > 0 GROUP BY ALL)) WHERE position <= 3),
        al AS (SELECT grp, 0 AS group_no, item, position FROM merged UNION ALL SELECT grp, group_no, item, position FROM own),
        fs AS (SELECT grp, item, min({{'g': group_no, 'p': position}}) AS f FROM al GROUP BY ALL),
        nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY f, item) AS INTEGER) AS number FROM fs)
        SELECT grp, group_no, item, position, number, {{'g': group_no, 'p': position}} <> f AS is_pointer FROM al JOIN nb USING (grp, item)""",
    "cocitation_pool": f"""WITH {_SEEDS},
        c AS (SELECT query_id, src, seed_rank - 1 AS i, l_suppkey AS candidate, max(year(l_shipdate)) AS y
              FROM seeds JOIN lineitem ON l_orderkey = src WHERE seed_rank <= 8 GROUP BY ALL),
        d AS (SELECT l_orderkey AS src, count(DISTINCT l_suppkey) AS deg FROM lineitem GROUP BY 1),
        s AS (SELECT query_id, candidate, round(sum(1.0::DOUBLE / (1 + 0.1::DOUBLE * i) / sqrt(deg)), 9) AS score, count(*) AS n_cites, CAST(max(y) AS INTEGER) AS year
              FROM c JOIN d USING (src) GROUP BY ALL)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_cites DESC, year DESC, candidate) AS INTEGER) AS rank FROM s) WHERE rank <= 12""",
    "citing_threshold": f"""WITH {_SEEDS} SELECT query_id, l_suppkey AS dst, count(DISTINCT src) AS n FROM seeds JOIN lineitem ON l_orderkey = src
        WHERE src <> l_suppkey GROUP BY ALL HAVING count(DISTINCT src) >= 2""",
    "regulation_citing_counts": f"WITH {_CITED} SELECT citation, count(DISTINCT id) AS n FROM regs GROUP BY 1 HAVING count(DISTINCT id) >= 2",
    "search_hybrid": f"WITH {_HYBRID} SELECT query_id, case_id, round(score, 9) AS score, rerank_score, final_rank FROM blended WHERE final_rank <= 20",
    "search_lexical": f"""WITH {_CORPUS},
        lex AS ({_bm25(200, "WHERE doc_id IN (SELECT doc_id FROM documents WHERE (doc_id // 4) % 4 IN (0, 2))")}),
        hits AS (SELECT query_id, 'lexical' AS source, rank, case_id FROM lex JOIN chunks ON chunk_id = doc_id), {_FUSED},
        s AS (SELECT query_id, case_id, round(score + p, 12) AS score FROM fused JOIN prior USING (case_id)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS INTEGER) AS final_rank FROM s)
        SELECT query_id, case_id, round(score, 9) AS score, final_rank FROM r WHERE final_rank <= 10""",
    "scenario_groups": f"""WITH {_HYBRID},
        lists AS (
            SELECT query_id // 4 AS grp, CAST(query_id % 4 AS INTEGER) AS list_no, final_rank AS rank, case_id AS item
            FROM blended WHERE final_rank <= 20 AND (query_id % 4 = 0 OR rerank_score > -2)),
        {_interleave("13")},
        head AS (SELECT grp, item, min(rank) AS position FROM lists WHERE list_no = 0 AND rank <= 3 GROUP BY ALL),
        parts AS (SELECT grp, item, position, 0 AS part FROM head UNION ALL SELECT grp, item, position, 1 FROM inter ANTI JOIN head USING (grp, item)),
        merged AS (
            SELECT * FROM (SELECT grp, item, CAST(row_number() OVER (PARTITION BY grp ORDER BY part, position) AS INTEGER) AS position FROM parts) WHERE position <= 10),
        own AS (
            SELECT * FROM (SELECT grp, list_no AS group_no, item, CAST(row_number() OVER (PARTITION BY grp, list_no ORDER BY rank, item) AS INTEGER) AS position FROM lists WHERE list_no > 0)
            WHERE position <= 3),
        al AS (SELECT grp, 0 AS group_no, item, position FROM merged UNION ALL SELECT grp, group_no, item, position FROM own),
        fs AS (SELECT grp, item, min({{'g': group_no, 'p': position}}) AS f FROM al GROUP BY ALL),
        nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY f, item) AS INTEGER) AS number FROM fs)
        SELECT grp AS scenario_id, group_no, item, position, number, {{'g': group_no, 'p': position}} <> f AS is_pointer FROM al JOIN nb USING (grp, item)""",
    "section_pool": f"""WITH {_HITS},
        sup AS (SELECT label, count(*) AS n_seeds, min(vec_id) AS item FROM embeddings GROUP BY 1),
        a AS (
            SELECT query_id, CASE source WHEN 'lexical' THEN 0 ELSE 1 END AS part, rank, chunk_id AS item FROM hits
            UNION ALL SELECT vec_id, 2, row_number() OVER (PARTITION BY vec_id ORDER BY n_seeds DESC, item), item FROM embeddings, sup WHERE vec_id % 20 = 0),
        m AS (SELECT query_id, item, min({{'p': part, 'r': rank}}) AS met FROM a WHERE rank <= 10 GROUP BY ALL)
        SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY met, item) AS INTEGER) AS place FROM m""",
    "section_scope": """SELECT p_partkey, CASE WHEN p_size = 7 THEN 'constitution' ELSE 'act' END AS kind, p_brand AS code FROM part
        WHERE left(p_name, 1) IN ('a', 'b') OR p_size = 7 OR p_brand IN ('Brand#12', 'Brand#34')""",
    "supported_sections": """WITH n AS (SELECT o_orderkey AS s, o_custkey % 10 AS code FROM orders),
        l AS (
            SELECT l_orderkey AS s, l_linenumber - 1 AS list_no, l_suppkey % 10 AS code, l_partkey AS section_no, l_partkey % 3 AS cited, l_quantity > 40 AS seeded,
                   CASE WHEN l_partkey % 5 > 0 THEN l_quantity - 20 END AS score FROM lineitem),
        k AS (SELECT * FROM l WHERE cited > 0 OR EXISTS (SELECT 1 FROM n WHERE n.s = l.s AND n.code = l.code)),
        h AS (SELECT s, code FROM n UNION SELECT s, code FROM k WHERE list_no = 0 OR seeded)
        SELECT s AS scenario_id, CAST(list_no AS INTEGER) AS list_no, code, section_no FROM k
        WHERE list_no = 0 OR (score > -5 AND EXISTS (SELECT 1 FROM h WHERE h.s = k.s AND h.code = k.code))""",
    "uncovered_regulations": f"""WITH {_CITED} SELECT citation, count(DISTINCT id) AS n_cases FROM regs
        WHERE citation NOT IN (SELECT 'O. Reg. ' || p_partkey || '/95' FROM part) GROUP BY 1""",
    "related_cases": f"""WITH {_cosine(6)} SELECT * FROM (
            SELECT query_id, item_id AS case_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM c WHERE item_id <> query_id) WHERE rank <= 5""",
    "issue_labels": f"""WITH {_LISTS},
        own AS (SELECT grp, list_no, item, row_number() OVER (PARTITION BY grp, list_no ORDER BY r, item) AS n FROM (SELECT grp, list_no, item, min(rank) AS r FROM lists WHERE list_no > 0 GROUP BY ALL))
        SELECT grp AS scenario_id, item, string_agg(CAST(list_no AS VARCHAR), ',' ORDER BY list_no) AS issues FROM own WHERE n <= 3 GROUP BY ALL""",
    "unique_seeds": f"""WITH {_LISTS},
        f AS (SELECT grp, item, min({{'r': rank, 'l': list_no}}) AS met FROM lists GROUP BY ALL)
        SELECT * FROM (SELECT grp AS query_id, item AS seed, CAST(row_number() OVER (PARTITION BY grp ORDER BY met, item) - 1 AS INTEGER) AS seed_index FROM f) WHERE seed_index < 8""",
    "candidate_links": """SELECT lower(c.n_name) AS database_id, 'c' || s_suppkey AS case_id, d.n_name AS court_name,
            'https://www.canlii.org/en/' || coalesce(lower(r_name), 'on') || '/' || lower(c.n_name) || '/doc/' || (s_suppkey % 30 + 1990) || '/c' || s_suppkey || '/c' || s_suppkey || '.html' AS url
        FROM supplier JOIN nation c ON c.n_nationkey = s_nationkey
        LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE lower(r_name) = 'asia' AND lower(n_name) <> 'china') d ON d.n_nationkey = s_nationkey""",
    "candidate_metadata": """WITH m AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1 HAVING min(o_orderkey) % 2 = 0)
        SELECT c_custkey AS case_id, CASE WHEN k % 3 > 0 THEN 'title ' || k ELSE c_name END AS title, coalesce(CAST(k AS VARCHAR), 'old') AS citation,
               CASE WHEN k % 4 = 0 THEN 'long link' ELSE 'link' END AS url, CASE WHEN k % 7 > 0 THEN DATE '2001-02-03' END AS decision_date,
               concat_ws('. ', CASE WHEN k % 3 > 0 THEN 'title ' || k ELSE c_name END, CASE WHEN k % 5 > 0 THEN 'words' END) AS described
        FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
    "cited_authorities": f"""WITH {_SEEDS},
        n AS (SELECT query_id, l_suppkey AS dst, count(DISTINCT src) AS n FROM seeds JOIN lineitem ON l_orderkey = src WHERE src <> l_suppkey GROUP BY ALL HAVING count(DISTINCT src) >= 2),
        k AS (SELECT *, CASE WHEN dst % 3 = 0 AND dst IN (SELECT s_suppkey FROM supplier) THEN dst END AS corpus_id FROM n)
        SELECT * FROM (SELECT query_id, dst, n, corpus_id, CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY n DESC, corpus_id IS NOT NULL, 't' || (dst % 7), dst) AS INTEGER) AS rank FROM k WHERE corpus_id IS NULL OR corpus_id % 2 = 1) WHERE rank <= 15""",
    "corpus_citations": """SELECT o_orderkey AS id, '2003 ONCA ' || o_orderkey || '; [1999] 2 SCR ' || o_orderkey AS citations,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
    "case_statutes": """SELECT l_orderkey, p_brand, min(l_linenumber) AS line, any_value(n) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
        JOIN (SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) USING (p_brand) WHERE l_orderkey % 20 = 0 GROUP BY ALL""",
    "summaries_of_cases": """SELECT user_id, event_type, min(event_id) AS first_event, coalesce(max(value) > 50, false) AS loaded FROM events GROUP BY ALL""",
    "nearest_chunk_per_case": """WITH d AS (
            SELECT q.vec_id AS query_id, c.label AS case_id, c.vec_id AS chunk_id,
                   round(1 - list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS dist
            FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0)
        SELECT DISTINCT ON (query_id, case_id) query_id, case_id, chunk_id, dist FROM d ORDER BY query_id, case_id, dist, chunk_id""",
    "law_kinds": """SELECT p_type, count(*) AS laws, CAST(sum(length(p_name)) AS BIGINT) AS chars, count(*) FILTER (WHERE regexp_matches(p_name, '[aeiou]{2}')) AS with_pair
        FROM part WHERE p_size >= 5 AND p_brand NOT IN ('Brand#11', 'Brand#55') GROUP BY 1""",
    "key_terms": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2001 scc ' || p_partkey WHEN 1 THEN lower(p_name) || ' act' ELSE '' END AS terms FROM part""",
    "leaked_words": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, lower(string_split(p_name, ' ')[-1]) AS told FROM part)
        SELECT p_partkey, array_to_string(list_filter(ws, lambda x: length(x) >= 4 AND (lower(x) = told OR lower(x) IN ('tenant', 'left'))), ',') AS leaked FROM w""",
    "merge_strategies": f"""WITH {_LISTS},
        ls AS (SELECT grp, list_no, item, min(rank) AS rank FROM lists GROUP BY ALL),
        st(strategy, lead) AS (VALUES ('lead3', 3), ('lead0', 0)),
        firsts AS (SELECT grp, item, min({{'rank': rank, 'list_no': list_no}}) AS met FROM ls GROUP BY ALL),
        inter AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY met, item) AS position FROM firsts),
        parts AS (
            SELECT strategy, grp, item, 0 AS part, rank AS position FROM st JOIN ls ON list_no = 0 AND rank <= lead
            UNION ALL SELECT strategy, grp, item, 1, position FROM st JOIN inter i ON position <= 8 + lead
                WHERE NOT EXISTS (SELECT 1 FROM ls WHERE ls.grp = i.grp AND ls.item = i.item AND list_no = 0 AND rank <= lead)),
        m AS (SELECT * FROM (SELECT strategy, grp, item, row_number() OVER (PARTITION BY strategy, grp ORDER BY part, position) AS rank FROM parts) WHERE rank <= 8),
        g AS (SELECT DISTINCT strategy, grp, item FROM ls, st WHERE item % 5 = 0)
        SELECT strategy, grp AS query_id, count(*) AS n_gold, round(count(*) FILTER (WHERE rank <= 5)::DOUBLE / count(*), 9) AS recall_5, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS mrr
        FROM g LEFT JOIN m USING (strategy, grp, item) GROUP BY ALL""",
    "statute_gold": """WITH r AS (
            SELECT o_custkey AS doc_id, p_brand AS code, p_size % 2 AS section_no, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(*) >= 2)
        SELECT doc_id, code, section_no, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, code, section_no) AS INTEGER) AS place FROM r) WHERE place <= 3""",
    "section_references": """WITH s AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS form, CAST(o_orderkey % 200 + 1 AS VARCHAR) AS a, '(' || (o_orderkey % 9 + 1) || ')' AS b FROM orders)
        SELECT doc_id, ['I-3.3', 'I-2.5', 'I-3.3', 'RSO1990cI2'][form + 1] AS code, a AS section_no, CASE WHEN form % 2 = 0 THEN b ELSE '' END AS pinpoint,
               CAST([6, 62, 28, 55][form + 1] AS INTEGER) AS start, CASE WHEN form = 2 THEN 0.8::DOUBLE ELSE 1.0 END AS confidence FROM s""",
    "ndcg_recall_mrr": f"""WITH h AS ({_bm25(10)}),
        gold AS (SELECT item_id AS query_id, doc_id AS item, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        j AS (SELECT g.*, h.rank, row_number() OVER (PARTITION BY g.query_id ORDER BY gain DESC, item) AS ir FROM gold g LEFT JOIN h ON h.query_id = g.query_id AND h.doc_id = g.item)
        SELECT query_id, count(*) AS n_gold, round(count(*) FILTER (WHERE rank <= 5)::DOUBLE / count(*), 9) AS recall_5,
               round(count(*) FILTER (WHERE rank <= 10)::DOUBLE / count(*), 9) AS recall_10, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS mrr,
               round(sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ir <= 10 THEN gain / log2(ir + 1) ELSE 0 END), 9) AS ndcg_10
        FROM j GROUP BY query_id""",
    "mean_metrics_by_group": "SELECT doc_id % 2 AS split, round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic, count(*) AS n FROM labels GROUP BY 1",
    "config_grid": """WITH cfg AS (SELECT CAST(row_number() OVER (ORDER BY g, p, r) - 1 AS INTEGER) AS config_id, g, p, r
            FROM (VALUES (0.0::DOUBLE), (0.5), (1.0)) a(g), (VALUES (0.0::DOUBLE), (0.002)) b(p), (VALUES (0.0::DOUBLE), (1.0)) c(r)),
        s AS (SELECT config_id, p_size % 5 AS q, p_partkey, p_partkey % 7 = 0 AS gold, round(1.0::DOUBLE / (60 + p_size) + g * (p_partkey % 11) / 1000
                     + p * (p_partkey % 3) + r * (p_partkey % 7 = 0)::INTEGER / 100, 9) AS sc FROM part, cfg),
        k AS (SELECT *, row_number() OVER (PARTITION BY config_id, q ORDER BY sc DESC, p_partkey) AS rank FROM s),
        m AS (SELECT config_id, round(avg(1.0::DOUBLE / f), 9) AS mrr FROM (SELECT config_id, q, min(rank) AS f FROM k WHERE gold GROUP BY ALL) GROUP BY 1),
        b AS (SELECT config_id FROM m JOIN cfg USING (config_id) WHERE mrr >= (SELECT max(mrr) FROM m) - 0.01::DOUBLE ORDER BY g + p + r, config_id LIMIT 1)
        SELECT config_id, mrr, config_id IN (SELECT config_id FROM b) AS chosen FROM m""",
}
