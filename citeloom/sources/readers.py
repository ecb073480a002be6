"""Sources: decision Parquet, Acts as JSON maps, law XML, regulation HTML, plain files and evaluation fixtures."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeloom.functions import text
from citeloom.functions.chunking import MAX_CHARS, windows

Unit = tuple[str | None, str | None, str]


def decisions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Decision rows with language fallback, header stripped and text cleaned; rows without any text are left out."""
    df = spark.read.parquet(path)
    pick = text.language_fallback([(x, F.col(f"unofficial_text_{x}"), F.col(f"citation_{x}")) for x in ("en", "fr")])
    out = df.select(pick.alias("d"), *[c for c in df.columns if c.startswith(("name_", "document_date_", "url_", "cases_cited_"))])
    out = out.where("d is not null").select("d.lang", "d.citation", text.clean(text.strip_header(F.col("d.text"))).alias("text"), *out.columns[1:]).where("text != ''")
    return out.limit(limit) if limit else out


def cited_lists(spark: SparkSession, path: str) -> DataFrame:
    """(citation, raw) from both languages' lists of cited cases, each once."""
    df = spark.read.parquet(path)
    both = F.array_union(*[F.coalesce(f"cases_cited_{x}", F.array().cast("array<string>")) for x in ("en", "fr")])
    return df.select(F.coalesce("citation_en", "citation_fr").alias("citation"), F.explode(both).alias("raw")).where("citation is not null and raw is not null")


def acts(spark: SparkSession, path: str) -> DataFrame:
    """One row a section of Acts stored as a JSON map from section number to text, in the map's own order."""
    df = spark.read.parquet(path).where("citation_en is not null and name_en is not null and unofficial_sections_en is not null")
    entries = F.map_entries(F.from_json("unofficial_sections_en", "map<string,string>"))
    rows = df.select(text.law_code(F.col("citation_en")).alias("code"), F.col("name_en").alias("title"), F.posexplode(entries).alias("position", "e"))
    return rows.select("code", "title", "position", F.col("e.key").alias("section_no"), text.clean(F.col("e.value")).alias("text"))


def pack_units(units: list[Unit], section_no: str, limit: int = MAX_CHARS) -> list[Unit]:
    """Units (label, note, text) joined into chunks of at most ``limit`` characters, labelled "97(1)-(3)".

    A note holds until the next one; a chunk takes the note of its first unit; longer units become windows.
    """
    out: list[Unit] = []
    held: list[tuple[str | None, str]] = []
    note = first_note = None

    def name(labels: list[str]) -> str:
        return section_no + (labels[0] if labels else "") + (f"-{labels[-1]}" if len(labels) > 1 else "")

    def close() -> None:
        if held:
            out.append((name([x for x, _ in held if x]), first_note, "\n".join(t for _, t in held)))
            held.clear()

    for label, own_note, body in units:
        note = own_note or note
        if len(body) > limit:
            close()
            out += [(name([label] if label else []), note, w) for w in windows(body)]
            continue
        if held and sum(len(t) for _, t in held) + len(body) > limit:
            close()
        if not held:
            first_note = note
        held.append((label, body))
    close()
    return out


def _flat(element: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip() if element is not None else ""


def parse_law(content: bytes) -> dict | None:
    """Title, kind, code and chunks of one law file; repealed sections are left out; None if it isn't a law."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return None
    kind = {"Statute": "act", "Regulation": "regulation"}.get(root.tag)
    head = root.find("Identification")
    if kind is None or head is None:
        return None
    title = _flat(head.find("ShortTitle")) or _flat(head.find("LongTitle"))
    code = _flat(head.find("InstrumentNumber")) or _flat(head.find(".//ConsolidatedNumber")) or _flat(head.find("Chapter"))
    chunks, path = [], []
    for element in root.find("Body") if root.find("Body") is not None else []:
        if element.tag == "Heading":
            level = int(element.get("level", "1"))
            path = [*path[: level - 1], _flat(element.find("TitleText")) or _flat(element)]
        elif element.tag == "Section":
            number = _flat(element.find("Label"))
            if not number or element.find(".//Repealed") is not None:
                continue
            note = _flat(element.find("MarginalNote")) or None
            units: list[Unit] = [(None, note, _flat(element.find("Text")))] if element.find("Text") is not None else []
            for sub in element.findall("Subsection"):
                body = " ".join(_flat(x) for x in sub if x.tag not in ("Label", "MarginalNote"))
                units.append((_flat(sub.find("Label")) or None, _flat(sub.find("MarginalNote")) or note, body))
            for label, chunk_note, body in pack_units([u for u in units if u[2]], number):
                chunks.append({"section_no": number, "section_label": label, "marginal_note": chunk_note, "hierarchy_path": " > ".join(path), "text": body})
    return {"title": title, "kind": kind, "code": code, "chunks": chunks}


SECTIONS = "path string, title string, kind string, code string, chunk_no int, section_no string, section_label string, marginal_note string, hierarchy_path string, text string"


def laws(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all law XML files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                if law := parse_law(bytes(content)):
                    rows += [{"path": p, "title": law["title"], "kind": law["kind"], "code": law["code"], "chunk_no": i, **c} for i, c in enumerate(law["chunks"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return files.mapInPandas(run, SECTIONS)


class _Paragraphs(HTMLParser):
    """(class, text, bold text) of a page's paragraphs, amendment-history spans left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str]] = []
        self.name: str | None = None
        self.text: list[str] = []
        self.bold: list[str] = []
        self.in_bold = self.skip = 0

    def close_paragraph(self) -> None:
        if self.name is not None:
            flat = lambda x: re.sub(r"\s+", " ", "".join(x)).strip()
            self.rows.append((self.name, re.sub(r"(?:\s*;)+\s*$", "", flat(self.text)), flat(self.bold)))
        self.name, self.text, self.bold = None, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":
            self.close_paragraph()
            self.name = dict(attrs).get("class") or ""
        elif tag == "span" and (self.skip or dict(attrs).get("class") == "citation"):
            self.skip += 1
        elif tag == "b":
            self.in_bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.close_paragraph()
        elif tag == "span" and self.skip:
            self.skip -= 1
        elif tag == "b" and self.in_bold:
            self.in_bold -= 1

    def handle_data(self, data: str) -> None:
        if self.name is not None and not self.skip:
            self.text.append(data)
            if self.in_bold:
                self.bold.append(data)


def parse_regulation(html: str) -> list[dict]:
    """Sections of a regulation page: number, note before it, part heading, paragraphs."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close_paragraph()
    out: list[dict] = []
    note = heading = None
    for name, body, bold in parser.rows:
        number = bold.rstrip(".")
        if not body:
            continue
        if name.startswith("heading1"):
            heading = body
        elif name.startswith("headnote"):
            note = body
        elif name.startswith("section") and re.fullmatch(r"\d+(?:\.\d+)*", number):
            out.append({"section_no": number, "marginal_note": note, "heading": heading, "paragraphs": [body]})
            note = None
        elif out:
            out[-1]["paragraphs"].append(body)
    return out


def regulation_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).where(F.col("html").contains("section"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, s["section_no"], s["marginal_note"], s["heading"], "\n".join(s["paragraphs"])) for p, h in zip(b["page_id"], b["html"], strict=True) for s in parse_regulation(h)]
            yield pd.DataFrame(found, columns=["page_id", "section_no", "marginal_note", "heading", "text"])

    return rows.mapInPandas(run, f"page_id {dict(rows.dtypes)['page_id']}, section_no string, marginal_note string, heading string, text string")


# --- the Constitution Acts page -------------------------------------------------------------------------------------


class _Rows(HTMLParser):
    """The page's content elements as flat rows (tag, classes, text, label); what a section or list holds is its own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, frozenset[str], str, str]] = []
        self.depth = self.inside = self.hidden = self.kept = 0  # open tags; depths where content, a hidden part, a row began
        self.label_at = 0
        self.row: tuple[str, frozenset[str]] = ("", frozenset())
        self.parts: list[str] = []
        self.label: list[str] = []
        self.tags: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "hr", "input", "meta", "link", "li", "p", "ul", "ol", "div", "dd", "dt", "td"):
            self.parts.append(" ")  # a list's items don't run together
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        values = dict(attrs)
        classes = frozenset((values.get("class") or "").split())
        self.tags.append(tag)
        self.depth += 1
        if values.get("id") == "docCont":
            self.inside = self.depth
        if not self.hidden and (tag == "sup" or any("wb-invisible" in c for c in classes)):
            self.hidden = self.depth
        if self.inside and not self.kept and tag in ("h2", "h3", "p", "ul"):
            self.kept, self.row, self.parts, self.label = self.depth, (tag, classes), [], []
        if self.kept and not self.label_at and tag == "span" and "sectionLabel" in classes:
            self.label_at = self.depth

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.tags:
            return
        while self.tags:
            closed = self.tags.pop()
            if self.kept == self.depth:
                clean = lambda parts: " ".join("".join(parts).split())
                self.rows.append((*self.row, clean(self.parts), clean(self.label)))
                self.kept = 0
            self.hidden = 0 if self.hidden == self.depth else self.hidden
            self.inside = 0 if self.inside == self.depth else self.inside
            self.label_at = 0 if self.label_at == self.depth else self.label_at
            self.depth -= 1
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.kept and not self.hidden:
            self.parts.append(data)
            if self.label_at:
                self.label.append(data)


def parse_constitution(html: str) -> list[dict[str, str | None]]:
    """Sections of the Constitution Acts: ``code, title, section_no, marginal_note, heading, text``.

    An Act begins at its title and ends at the next title or schedule; a marginal note belongs to the section behind it,
    a list to the section before it; repealed sections go.
    """
    reader = _Rows()
    reader.feed(html)
    reader.close()
    out: list[dict[str, str | None]] = []
    act = note = None
    heading = ""
    open_section = False
    for tag, classes, said, label in reader.rows:
        if tag == "h2" and (not classes or classes & {"Title-of-Act", "scheduleLabel"}):
            year = re.fullmatch(r"CONSTITUTION ACT, (\d{4})", said.upper())
            act = year[1] if year and "scheduleLabel" not in classes else None
            heading, note, open_section = "", None, False
        elif act is None:
            continue
        elif classes & {"Part", "Subheading"}:
            heading, open_section = said, False
        elif "MarginalNote" in classes:
            note, open_section = said, False
        elif "Section" in classes:
            open_section = bool(label)
            if label:
                out.append({"code": f"CONST-{act}", "title": f"Constitution Act, {act}", "section_no": label, "marginal_note": note, "heading": heading, "text": said})
            note = None
        elif "ProvisionList" in classes and open_section:
            out[-1]["text"] = f"{out[-1]['text']} {said}"
    return [s for s in out if s["text"] and "Repealed" not in s["text"][:40]]


def constitution(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row a chunk of the Acts: ``code, title, section_no, chunk_no, marginal_note, heading, text`` with its header line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["code", "title", "section_no", "chunk_no", "marginal_note", "heading", "text"]
        for b in batches:
            found = []
            for s in (s for h in b["html"] for s in parse_constitution(h)):
                header = f"{s['title']}, s. {s['section_no']}" + (f" — {s['marginal_note']}" if s["marginal_note"] else "")
                found += [(s["code"], s["title"], s["section_no"], n, s["marginal_note"], s["heading"], f"{header}\n{w}") for n, w in enumerate(windows(s["text"]))]
            yield pd.DataFrame(found, columns=names)

    rows = pages.select(F.col(html_col).alias("html")).where("html is not null")
    return rows.mapInPandas(run, "code string, title string, section_no string, chunk_no int, marginal_note string, heading string, text string")


# --- uploaded files -------------------------------------------------------------------------------------------------

_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a DOCX file, one a line; None where it can't be read as one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORDS}t")) for p in body.iter(f"{_WORDS}p"))


@F.pandas_udf(StringType())
def _docx(content: pd.Series) -> pd.Series:
    return content.map(lambda c: docx_text(bytes(c)) if c is not None else None)


def plain_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content_hash, text, error``: text, Markdown and DOCX files with a content hash as their key.

    Bytes that aren't UTF-8 become replacement characters; texts are trimmed.  ``error`` tells files of unsupported kind,
    unreadable ones and those without text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    plain, docx = kind.isin("txt", "md"), kind == "docx"
    raw = F.when(plain, F.make_valid_utf8(F.col("content").cast("string"))).when(docx, _docx(F.when(docx, F.col("content"))))
    body = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return files.select("path", F.sha2("content", 256).alias("content_hash"), body.alias("text")).withColumn(
        "error", F.when(~F.lower("path").rlike(r"\.(txt|md|docx)$"), "unsupported").when(F.col("text").isNull(), "unreadable").when(F.col("text") == "", "empty")
    )


def fixtures(spark: SparkSession, path: str, max_phase: int) -> DataFrame:
    """Evaluation scenarios up to a phase whose citations are resolved, from JSON lines; only gold cases in the corpus stay."""
    gold = "array<struct<citation: string, name: string, kind: string, relevance: string, court: string, in_corpus: boolean>>"
    rows = spark.read.schema(f"id string, phase int, scenario string, split string, citations_resolved boolean, expected_authorities {gold}").json(path)
    kept = rows.where((F.col("phase") <= max_phase) & F.col("citations_resolved"))
    cases = F.filter(F.coalesce("expected_authorities", F.array().cast(gold)), lambda a: (a["kind"] == "case") & F.coalesce(a["in_corpus"], F.lit(True)))
    return kept.select("id", "phase", F.coalesce("scenario", F.lit("")).alias("scenario"), F.coalesce("split", F.lit("tune")).alias("split"), cases.alias("gold"))


def catalog_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Row counts, from Parquet footers."""
    return spark.createDataFrame([(name, spark.read.parquet(p).count()) for name, p in sorted(paths.items())], "name string, rows long")
