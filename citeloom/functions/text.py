"""Text and scalar functions as Column expressions: everything here stays inside whole-stage codegen or HOFs.

Patterns use explicit ASCII classes, so that Java and SQL engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Citation patterns, French court codes and their English forms, stop words, decision-header marks.
NEUTRAL = r"\b([0-9]{4})\s+([A-Z][A-Za-z]{1,9})\s+([0-9]{1,5})\b"
#: The same with a number of any length: an authority may be numbered beyond 99,999, as CanLII's are.
NEUTRAL_LONG = NEUTRAL.replace("{1,5}", "+")
SCR = r"\[([0-9]{4})\]\s*([0-9])\s*S\.?\s*C\.?\s*R\.?\s*([0-9]{1,4})"
FRENCH_COURTS = {
    "CSC": "SCC", "CF": "FC", "CAF": "FCA", "CFPI": "FCT", "CCI": "TCC", "CACM": "CMAC",
    "TCDP": "CHRT", "CCRI": "CIRB", "TCCE": "CITT", "CRTFP": "FPSLREB", "TSS": "SST",
}
O_REG = r"O\.?\s*Reg\.?\s*([0-9]{1,4})/([0-9]{2,4})"
RRO_REG = r"R\.?R\.?O\.?\s*([0-9]{4}),?\s*Reg\.?\s*([0-9]{1,4})"
HEADER_MARKS = ("Decision Content", "Contenu de la décision")
HEADER_REACH = 6000
STOP_WORDS = (
    "the and that for was with his her this not are which from has had have its one any but all "
    "who him she they them their there been were will would what when where than then into also "
    "only such may can could should shall our out"
).split()


def clean(text: Column) -> Column:
    """NUL dropped, line ends unified, blanks collapsed, lines trimmed, blank lines dropped."""
    t = F.regexp_replace(text, "\x00", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_header(text: Column) -> Column:
    """The text behind the first header mark within its first HEADER_REACH characters, left-trimmed."""
    head = F.substring(text, 1, HEADER_REACH)
    out = text
    for mark in reversed(HEADER_MARKS):
        at = F.instr(head, mark)
        out = F.when(at > 0, F.regexp_replace(text.substr(at + len(mark), F.length(text)), r"^\s+", "")).otherwise(out)
    return out


def language_fallback(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Struct (lang, text, citation) of the first language whose text and citation are both there."""
    out = F.lit(None).cast("struct<lang:string,text:string,citation:string>")
    for lang, text, citation in reversed(pairs):
        there = (F.coalesce(F.trim(text), F.lit("")) != "") & (F.coalesce(F.trim(citation), F.lit("")) != "")
        out = F.when(there, F.struct(F.lit(lang).alias("lang"), text.alias("text"), citation.alias("citation"))).otherwise(out)
    return out


def _zipped(text: Column, pattern: str, groups: int, build) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    names = [f"g{i}" for i in range(groups)]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, names, strict=True)])
    return F.transform(zipped, lambda z: build(*[z[n] for n in names]))


def neutral_citations(text: Column, pattern: str = NEUTRAL) -> Column:
    return _zipped(text, pattern, 3, lambda y, c, n: F.concat_ws(" ", y, c, n))


def scr_citations(text: Column) -> Column:
    return _zipped(text, SCR, 3, lambda y, v, p: F.concat(F.lit("["), y, F.lit("] "), v, F.lit(" SCR "), p))


def case_citations(text: Column, neutral: str = NEUTRAL) -> Column:
    return F.concat(neutral_citations(text, neutral), scr_citations(text))


def canonical(citation: Column) -> Column:
    """French court code of a three-token citation replaced by the English one; blanks collapsed."""
    parts = F.split(F.trim(F.regexp_replace(citation, r"\s+", " ")), " ")
    courts = F.create_map(*[F.lit(x) for pair in FRENCH_COURTS.items() for x in pair])
    code = F.coalesce(courts[F.element_at(parts, 2)], F.element_at(parts, 2))
    return F.when(F.size(parts) == 3, F.concat_ws(" ", parts[0], code, parts[2])).otherwise(F.array_join(parts, " "))


def party_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def party_key(style: Column) -> Column:
    """Struct (left, right) around the first "v": the word before it and the word after it, a leading "the" skipped."""
    left = F.regexp_extract(style, r"(?i)(\S+)\s+v\.?\s", 1)
    right = F.regexp_extract(style, r"(?i)\S+\s+v\.?\s+(?:the\s+)?(\S+)", 1)
    key = F.struct(party_word(left).alias("left"), party_word(right).alias("right"))
    return F.when((party_word(left) != "") & (party_word(right) != ""), key)


def regulation_refs(text: Column) -> Column:
    """Distinct struct (citation, alias) of both regulation forms; alias is the two-digit year and four-digit number."""

    def ontario(n: Column, y: Column) -> Column:
        return F.struct(F.concat(F.lit("O. Reg. "), n.cast("int").cast("string"), F.lit("/"), F.substring(y, -2, 2)).alias("citation"), F.concat(F.substring(y, -2, 2), F.lpad(n, 4, "0")).alias("alias"))

    def revised(y: Column, n: Column) -> Column:
        return F.struct(F.concat(F.lit("R.R.O. "), y, F.lit(", Reg. "), n.cast("int").cast("string")).alias("citation"), F.concat(F.substring(y, -2, 2), F.lpad(n, 4, "0")).alias("alias"))

    return F.array_distinct(F.concat(_zipped(text, O_REG, 2, ontario), _zipped(text, RRO_REG, 2, revised)))


def normalize(text: Column) -> Column:
    """Quotes and dashes folded, dots removed, lower case, white space collapsed."""
    t = F.translate(text, "‘’“”–—‑", "''\"\"---")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, r"\.", "")), r"\s+", " "))


def content_words(text: Column) -> Column:
    """Distinct words of the normalised text that are longer than two characters and no stop words."""
    words = F.array_distinct(F.regexp_extract_all(normalize(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in STOP_WORDS]))


def overlap(item: Column, anchor: Column) -> Column:
    """Share of the item's content words that the anchor has; 1.0 without any."""
    a, b = content_words(item), content_words(anchor)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(left: Column, right: Column) -> Column:
    a, b = content_words(left), content_words(right)
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed and trimmed."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256)


#: A pinpoint in front of a law's name, as in "ss. 12 and 14(2) of the ...".
PINPOINT = r"(?i)^\s*(?:ss?\.|sections?|rules?|r\.|articles?|art\.)\s*[\w.()]+(?:\s*(?:,|and|to|-)\s*[\w.()]+)*\s+of\s+(?:the\s+)?"


def key_terms(authority: Column) -> Column:
    """What must be found of an authority: its citations, else its leading name of at least four characters."""
    cited = F.transform(case_citations(authority, NEUTRAL_LONG), normalize)
    name = normalize(F.split(F.regexp_replace(authority, PINPOINT, ""), r",|\(|\bss?\.?\s*\d|\bsection\b").getItem(0))
    return F.when(F.size(cited) > 0, cited).when(F.length(name) >= 4, F.array(name)).otherwise(F.array().cast("array<string>"))


#: Words of party names that give nothing away (fixed values).
GENERIC = (
    "canada attorney general minister citizenship immigration queen king the and inc ltd employment social development "
    "commission insurance revenue national public safety emergency preparedness treasury board refugees canadian agency "
    "service services union council government"
).split()


def leaks(scenario: Column, name: Column) -> Column:
    """Citations in a scenario, and words of a decision's name that stand in it: what would give the decision away."""
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'\-]{3,}"), F.lit(0))
    said = F.concat(F.lit(" "), F.regexp_replace(F.lower(scenario), "[^a-z0-9_]+", " "), F.lit(" "))
    plain = lambda w: F.concat(F.lit(" "), F.regexp_replace(F.lower(w), "[^a-z0-9_]+", " "), F.lit(" "))
    given = F.filter(words, lambda w: ~F.lower(w).isin(*GENERIC) & said.contains(plain(w)))
    return F.concat(case_citations(scenario), given)


def related_query(issues: Column, events: Column) -> Column:
    """A brief's issues without their "Whether" and its events, joined."""
    return F.array_join(F.concat(F.transform(issues, lambda q: F.regexp_replace(q, r"(?i)^\s*whether\s+", "")), events), "; ")


def law_code(citation: Column) -> Column:
    return F.regexp_replace(citation, "[^A-Za-z0-9]", "")


def heard_date(text: Column) -> Column:
    """The first date format that fits."""
    return F.coalesce(*[F.try_to_date(text, f) if hasattr(F, "try_to_date") else F.to_date(text, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy")])


def search_query(parts: list[Column]) -> Column:
    """Lists of terms joined with "; ", empty ones left out."""
    return F.array_join(F.filter(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])), lambda x: F.trim(x) != ""), "; ")


def with_fallback(query: Column, areas: Column) -> Column:
    """The query, or the areas of law where there is none."""
    return F.when(F.trim(F.coalesce(query, F.lit(""))) != "", query).otherwise(F.array_join(F.coalesce(areas, F.array().cast("array<string>")), "; "))


#: Courts whose decisions bind in a province's matters, jurisdictions covered and not (fixed values).
BINDING_COURTS = {"ontario": ["ONCA", "SCC"]}
SCOPED, NOT_COVERED = ("federal", "ontario"), ("other_province",)


def case_courts(jurisdiction: Column) -> Column:
    """Courts that a search is narrowed to; null where it isn't."""
    out = F.lit(None).cast("array<string>")
    for name, courts in BINDING_COURTS.items():
        out = F.when(jurisdiction == name, F.array(*map(F.lit, courts))).otherwise(out)
    return out


def jurisdiction_gate(jurisdiction: Column, clarifications: Column) -> Column:
    """Struct (status, message): unsupported jurisdictions stop a search, and questions do where it is unknown."""
    asked = F.array_join(F.coalesce(clarifications, F.array().cast("array<string>")), "; ")
    status = F.when(jurisdiction.isin(*NOT_COVERED), "unsupported_jurisdiction").when((jurisdiction == "unknown") & (asked != ""), "needs_clarification").otherwise("ok")
    message = F.when(jurisdiction.isin(*NOT_COVERED), F.concat(F.regexp_replace(jurisdiction, "_", " "), F.lit(" matters are not covered"))).otherwise(F.nullif(asked, F.lit("")))
    return F.struct(status.alias("status"), message.alias("message"))


def party_line(name: Column, as_written: Column, label: Column) -> Column:
    """A party with its status as the decision writes it, else by its label."""
    return F.concat(name, F.lit(" – "), F.lower(F.coalesce(F.nullif(F.trim(as_written), F.lit("")), label)))


def decision_line(step: Column, answer: Column) -> Column:
    return F.concat_ws(": ", F.nullif(step, F.lit("")), answer)


def issue_queries(issues: Column, most: int = 10) -> Column:
    return F.slice(F.filter(issues, lambda x: x.isNotNull() & (F.trim(x) != "")), 1, most)


def polymorphic(value: Column) -> Column:
    """A JSON field that is a string or an object by language: English first, else the first value, else as it is."""
    values = F.from_json(value, "map<string,string>")
    return F.when(value.startswith("{"), F.coalesce(values["en"], F.element_at(F.map_values(values), 1))).otherwise(value)


def display_name(name: Column) -> Column:
    """Dots dropped behind initials and abbreviations of a case name."""
    return F.regexp_replace(F.regexp_replace(name, r"\b([A-Z])\.(?=\s|[A-Z]\.|$|,)", "$1"), r"\b(v|Inc|Ltd|Co|Corp|Ltée|Attorney Gen|No)\.", "$1")


def long_date(value: Column) -> Column:
    return F.date_format(value, "MMMM d, yyyy")


def title_case(title: Column) -> Column:
    """Words capitalised but for small ones behind the first."""
    small = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "under", "with"]
    words = F.split(F.lower(F.trim(title)), r"\s+")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(small), w).otherwise(F.initcap(w))), " ")


def corpus_seed(court: Column, citation: Column) -> Column:
    """Struct (database_id, case_id) of a neutral citation of a known court; null otherwise."""
    databases = {"SCC": ("SCC", "csc-scc"), "FCA": ("FCA", "fca"), "FC": ("FC", "fct"), "TCC": ("TCC", "cci-tcc"), "ONCA": ("ONCA", "onca")}
    out = F.lit(None).cast("struct<database_id:string,case_id:string>")
    for name, (code, database) in databases.items():
        fits = (court == name) & citation.rlike(rf"^[0-9]{{4}} {code} [0-9]{{1,5}}$")
        out = F.when(fits, F.struct(F.lit(database).alias("database_id"), F.lower(F.regexp_replace(citation, " ", "")).alias("case_id"))).otherwise(out)
    return out
