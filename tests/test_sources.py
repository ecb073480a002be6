"""Parsers, sinks, briefs, lookup, streaming and the catalog itself."""

from pyspark.sql import functions as F

from citeloom.operators import briefs, lookup
from citeloom.plans import catalog
from citeloom.sources import readers, sinks
from citeloom.streaming import counters

LAW = b"""<Statute><Identification><ShortTitle>Test Act</ShortTitle><Chapter><ConsolidatedNumber>T-1</ConsolidatedNumber></Chapter></Identification>
<Body><Heading level="1"><TitleText>Part I</TitleText></Heading>
<Section><MarginalNote>Note</MarginalNote><Label>5</Label><Subsection><Label>(1)</Label><Text>One.</Text></Subsection><Subsection><Label>(2)</Label><Text>Two.</Text></Subsection></Section>
<Section><Label>6</Label><Text><Repealed>gone</Repealed></Text></Section></Body></Statute>"""


def test_law_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(LAW)
    (tmp_path / "b.xml").write_bytes(b"<broken")
    rows = readers.laws(spark, str(tmp_path)).collect()
    assert [(r["code"], r["kind"], r["section_label"], r["marginal_note"], r["hierarchy_path"], r["text"]) for r in rows] == [("T-1", "act", "5(1)-(2)", "Note", "Part I", "One.\nTwo.")]


def test_regulation_html(spark):
    html = '<p class="heading1-e">Part A</p><p class="headnote-e">Scope</p><p class="section"><b>2.</b> (1) Applies. <span class="citation">O. Reg. 1/2</span></p><p class="clause">(a) more</p><p class="section"><b>x</b> tail</p>'
    out = readers.regulation_sections(spark.createDataFrame([(1, html), (2, None), (3, "<p>no</p>")], "page_id long, html string")).collect()
    assert [(r["section_no"], r["marginal_note"], r["heading"], r["text"]) for r in out] == [("2", "Scope", "Part A", "2. (1) Applies.\n(a) more\nx tail")]


def test_acts_and_decisions(spark, tmp_path):
    spark.createDataFrame([("S.O. 2000, c. 1", "An Act", '{"2": "b  b", "1": "a"}'), (None, "x", "{}")], "citation_en string, name_en string, unofficial_sections_en string").write.parquet(str(tmp_path / "acts"))
    assert [(r["code"], r["section_no"], r["text"]) for r in readers.acts(spark, str(tmp_path / "acts")).orderBy("position").collect()] == [("SO2000c1", "2", "b b"), ("SO2000c1", "1", "a")]
    rows = [("2001 SCC 1", None, "Header Decision Content  Body", None), (None, "2001 CSC 2", None, "Texte"), ("2001 SCC 3", None, " ", None)]
    spark.createDataFrame(rows, "citation_en string, citation_fr string, unofficial_text_en string, unofficial_text_fr string").write.parquet(str(tmp_path / "d"))
    assert sorted((r["lang"], r["text"]) for r in readers.decisions(spark, str(tmp_path / "d")).collect()) == [("en", "Body"), ("fr", "Texte")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "c.md").write_text(" ")
    assert {r["path"][-5:]: r["error"] for r in readers.plain_files(spark, str(tmp_path)).collect()} == {"a.txt": None, "b.bin": "unsupported", "/c.md": "empty"}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, updated_at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, v string, updated_at int")
    assert sorted((r["id"], r["v"]) for r in sinks.upsert(old, new, ["id"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["id"] for r in sinks.insert_absent(old, new, ["id"]).collect()] == [3]
    path = str(tmp_path / "t")
    sinks.rebuild(old, path, ["id"])
    sinks.rebuild(new.where("id = 3"), path, ["id"])
    assert spark.read.parquet(path).count() == 3
    sinks.log_run(spark, str(tmp_path / "log"), "job", "running")
    sinks.log_run(spark, str(tmp_path / "log"), "job", "done")
    assert [r["status"] for r in sinks.job_states(spark.read.parquet(str(tmp_path / "log"))).collect()] == ["done"]


def test_briefs(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "the tenant paid rent"), (1, 1, 2, "costs follow")], "doc_id int, chunk_no int, para_no int, text string")
    items = spark.createDataFrame([(1, "issues", 0, 1, "Whether the tenant paid"), (1, "issues", 1, 9, "unrelated words")], "doc_id int, section string, idx int, anchor int, text string")
    names = spark.createDataFrame([(1, "party", 0, "The TENANT"), (1, "party", 1, "Nobody")], "doc_id int, kind string, idx int, name string")
    docs = spark.createDataFrame([(1, "The tenant paid rent. Costs follow.")], "doc_id int, text string")
    verified = briefs.verify_items(items, briefs.anchors(chunks))
    row = briefs.summary(verified, briefs.names_in_text(names, docs)).first()
    assert row["problems"] == 2 and not row["too_long"]
    assert {(w["idx"], w["message"]) for w in row["warnings"]} == {(1, "anchor does not exist"), (1, "issue is not a whether question")}
    issues = spark.createDataFrame([(1, 0, "Whether he owes rent"), (1, 1, "Whether costs are due")], "doc_id int, idx int, text string")
    assert [r["idx"] for r in briefs.decided_issues(issues, issues.limit(0)).collect()] == [0]
    assert briefs.markdown(items).first()["markdown"].startswith("## Issues\n- Whether the tenant paid (¶1)")


def test_lookup_cascade(spark):
    cases = spark.createDataFrame([(1, "2001 SCC 7", None, "Kazemi Estate v. Iran", "state immunity", 5), (2, "2002 FC 1", "2001 SCC 9", "Doe v. Roe", "tax appeal", 3)], "case_id int, citation string, citation2 string, name string, text string, cited_by_count int")
    asked = spark.createDataFrame([("a", "2001  CSC 9"), ("b", "kazemi"), ("c", "immunity zz"), ("d", "none")], "query_id string, text string")
    assert sorted((r["query_id"], r["stage"], r["case_id"]) for r in lookup.lookup(cases, asked).collect()) == [("a", 0, 2), ("b", 1, 1), ("c", 2, 1)]


def test_hourly_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "view") for i in range(6)], "i int, event_type string").select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, i * 25)").alias("ts"), "event_type")
    rows.write.parquet(str(tmp_path / "in"))
    stream = counters.hourly(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["queries"] for r in spark.sql("select * from hours").collect()) == [1, 2, 3]


def test_catalog_matches_its_sql_keys():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


PAGE = """<html><body><h2>Menu</h2><main id="docCont">
<h2 class="Title-of-Act">Constitution Act, 1867</h2><p class="MarginalNote"><span class="wb-invisible">Marginal note:</span>Short title</p>
<p class="Section"><span class="sectionLabel">1</span> This Act may be cited<sup>(1)</sup>.</p>
<h2>Canada Act 1982</h2><p class="Section"><span class="sectionLabel">9</span> not of ours</p>
<h2>CONSTITUTION ACT, 1982</h2><h3 class="Part">Part I</h3><h3 class="Subheading">Legal Rights</h3>
<p class="MarginalNote">Proceedings</p><p class="Section"><strong><span class="sectionLabel">11</span></strong> Any person charged has the right</p>
<ul class="ProvisionList"><li><p>(a) to be informed; and</p></li><li>(b) to be tried.</li></ul>
<p class="Section"><span class="sectionLabel">12</span> Repealed</p><ul class="ProvisionList"><li>(a) gone too</li></ul>
<p class="Section">no label</p><h2 class="scheduleLabel">Schedule</h2><p class="Section"><span class="sectionLabel">3</span> x</p></main><p class="Section">after</p></body></html>"""


def test_constitution_page(spark):
    found = readers.parse_constitution(PAGE)
    assert [(s["code"], s["section_no"], s["marginal_note"], s["heading"]) for s in found] == [("CONST-1867", "1", "Short title", ""), ("CONST-1982", "11", "Proceedings", "Legal Rights")]
    assert found[0]["text"] == "1 This Act may be cited." and found[1]["text"] == "11 Any person charged has the right (a) to be informed; and (b) to be tried."
    rows = readers.constitution(spark.createDataFrame([(PAGE,), (None,), ("<p>",)], "html string")).collect()
    assert [r["chunk_no"] for r in rows] == [0, 0] and rows[1]["text"].startswith("Constitution Act, 1982, s. 11 — Proceedings\n11 Any")
    assert readers.parse_constitution("") == []


def test_uploaded_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.DOCX").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b" caf\xe9 \n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    out = {r["path"][-5:]: (r["text"], r["error"]) for r in readers.plain_files(spark, str(tmp_path)).collect()}
    assert out == {".docx": ("one two\nthree", None), ".DOCX": (None, "unreadable"), "c.txt": ("caf�", None), "d.pdf": (None, "unsupported")}


def test_fixtures_and_object_store(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "a", "phase": 1, "citations_resolved": true, "expected_authorities": [{"citation": "2001 SCC 1", "kind": "case"}, {"kind": "statute"}, {"kind": "case", "in_corpus": false}]}\n{"id": "b", "phase": 9, "citations_resolved": true}\n{"id": "c", "phase": 1}\n')
    rows = readers.fixtures(spark, str(tmp_path / "s.json"), 2).collect()
    assert [(r["id"], r["split"], [g["citation"] for g in r["gold"]]) for r in rows] == [("a", "tune", ["2001 SCC 1"])]
    store = str(tmp_path / "objects")
    first = sinks.put_objects(spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary"), store)
    again = sinks.put_objects(spark.createDataFrame([(bytearray(b"y"),), (bytearray(b"z"),)], "content binary"), store)
    assert first.count() == 2 and again.count() == 1 and sinks.objects(spark, store).count() == 3
    sinks.json_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"a":1,"b":null}']
    cache = spark.createDataFrame([("k", 1, "2024-01-01"), ("k", 2, "2024-01-20"), ("old", 3, "2023-01-01")], "key string, v int, at string").selectExpr("key", "v", "timestamp(at) as fetched_at")
    cache.write.parquet(str(tmp_path / "cache"))
    new = spark.createDataFrame([("k", 9), ("old", 8)], "key string, v int")
    assert {(r["key"], r["v"]) for r in sinks.cached(new, str(tmp_path / "cache"), ["key"], "2024-01-31", 30).collect()} == {("k", 2), ("old", 8)}
    assert sinks.cached(new, str(tmp_path / "none"), ["key"], "2024-01-31", 30).count() == 2


def test_gates_and_lines(spark):
    from pyspark.sql import functions as F

    from citeloom.functions import text

    rows = spark.createDataFrame([("other_province", ["q"]), ("unknown", ["when?", "who?"]), ("unknown", None), ("ontario", ["when?"])], "j string, c array<string>")
    out = [(r["g"]["status"], r["g"]["message"], r["courts"]) for r in rows.select(text.jurisdiction_gate(F.col("j"), F.col("c")).alias("g"), text.case_courts(F.col("j")).alias("courts")).collect()]
    assert out == [("unsupported_jurisdiction", "other province matters are not covered", None), ("needs_clarification", "when?; who?", None), ("ok", None, None), ("ok", "when?", ["ONCA", "SCC"])]
    one = spark.range(1).select(text.party_line(F.lit("Ann"), F.lit(" "), F.lit("Tenant")).alias("p"), text.decision_line(F.lit(""), F.lit("yes")).alias("d"), text.with_fallback(F.lit(" "), F.array(F.lit("rent"))).alias("q")).first()
    assert tuple(one) == ("Ann – tenant", "yes", "rent")
