"""Verification of structured briefs against their source, by joins on items and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text

# What a brief may hold in words, the overlap that an item needs with its anchor and where it needs it.
MAX_WORDS, LEAST_OVERLAP, UNDECIDED_JACCARD = 500, 0.5, 0.8
OVERLAP_SECTIONS = ("facts", "ratio", "decision")


def anchors(chunks: DataFrame) -> DataFrame:
    """``doc_id, anchor, text``: paragraph numbers where the document has them, else the passages' own numbers."""
    numbered = F.max(F.col("para_no").isNotNull()).over(Window.partitionBy("doc_id"))
    return chunks.withColumn("_n", numbered).select("doc_id", F.when(F.col("_n"), F.col("para_no")).otherwise(F.col("chunk_no") + 1).alias("anchor"), "text").where("anchor is not null")


def verify_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """Each item with ``anchor_ok`` and its ``overlap`` with the anchor's text: ``items(doc_id, section, idx, anchor, text)``."""
    joined = items.join(found.groupBy("doc_id", "anchor").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("anchor_text")), ["doc_id", "anchor"], "left")
    return joined.withColumn("anchor_ok", F.col("anchor_text").isNotNull()).withColumn("overlap", F.when(F.col("anchor_ok"), F.round(text.overlap(F.col("text"), F.col("anchor_text")), 6)))


def names_in_text(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Parties and authorities with ``found_in_document`` after normalising: ``names(doc_id, kind, idx, name)``."""
    bodies = docs.select("doc_id", text.normalize(F.col("text")).alias("_body"))
    wanted = text.normalize(F.col("name"))
    return names.join(bodies, "doc_id", "left").withColumn("found_in_document", F.coalesce((wanted != "") & F.col("_body").contains(wanted), F.lit(False))).drop("_body")


def rule_warnings(items: DataFrame) -> DataFrame:
    """``doc_id, section, idx, message`` for every departure of verified items from the format."""
    issue = F.col("section") == "issues"
    rules: list[tuple[Column, str]] = [
        (~F.col("anchor_ok"), "anchor does not exist"),
        (issue & ~F.lower(F.trim("text")).startswith("whether"), "issue is not a whether question"),
        (F.col("section").isin(*OVERLAP_SECTIONS) & F.col("anchor_ok") & (F.col("overlap") < LEAST_OVERLAP), "wording is far from its anchor"),
        (F.trim(F.coalesce("text", F.lit(""))) == "", "item is empty"),
    ]
    messages = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(m)) for rule, m in rules]), lambda m: m.isNotNull())
    return items.select("doc_id", "section", "idx", F.explode(messages).alias("message"))


def summary(items: DataFrame, names: DataFrame) -> DataFrame:
    """Per document: problems (missing anchors, names not in the text), warnings, words."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    a = items.groupBy("doc_id").agg(F.sum((~F.col("anchor_ok")).cast("int")).alias("missing_anchors"), F.sum(words).alias("words"))
    b = names.groupBy("doc_id").agg(F.sum((~F.col("found_in_document")).cast("int")).alias("missing_names"))
    w = rule_warnings(items).groupBy("doc_id").agg(F.collect_list(F.struct("section", "idx", "message")).alias("warnings"))
    out = a.join(b, "doc_id", "left").join(w, "doc_id", "left")
    return out.select("doc_id", (F.col("missing_anchors") + F.coalesce("missing_names", F.lit(0))).alias("problems"), "words", (F.col("words") > MAX_WORDS).alias("too_long"), "warnings")


def decided_issues(issues: DataFrame, undecided: DataFrame) -> DataFrame:
    """Issues without those also listed as undecided and, beside others, those about costs."""
    pairs = issues.join(undecided.select("doc_id", F.col("text").alias("_u")), "doc_id")
    same = pairs.where(text.jaccard(F.col("text"), F.col("_u")) >= UNDECIDED_JACCARD).select("doc_id", "idx").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    costs = F.col("text").rlike(r"(?i)\bcosts?\b") & (F.col("_n") > 1)
    return issues.withColumn("_n", n).where(~costs).drop("_n").join(same, ["doc_id", "idx"], "left_anti")


def new_items(old: Column, new: Column) -> Column:
    """Items of ``new`` that ``old`` lacks, repeats counted."""
    return F.size(F.filter(new, lambda x: ~F.array_contains(old, x)))


def markdown(items: DataFrame) -> DataFrame:
    """One Markdown text a document: sections in order, items as bullets with their anchors."""
    line = F.concat(F.lit("- "), F.col("text"), F.coalesce(F.concat(F.lit(" (¶"), F.col("anchor").cast("string"), F.lit(")")), F.lit("")))
    parts = items.groupBy("doc_id", "section").agg(F.min("idx").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    whole = F.sort_array(F.collect_list(F.struct("at", "section", F.concat(F.lit("## "), F.initcap("section"), F.lit("\n"), F.col("body")).alias("md"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(whole, lambda x: x["md"]), "\n\n").alias("markdown"))


# --- rules of the brief as a whole ----------------------------------------------------------------------------------

#: Words that show what an item is about (fixed values): a role of this case, the court below, a test in stages.
CASE_ROLE = r"(?i)\bthe (appellant|respondent|plaintiff|defendant|applicant|trial judge|appeal judge|motion judge|application judge|trial court|court below|lower court)s?\b"
COURT_BELOW = r"(?i)\bthe (trial|appeal|motion|application|hearing) judge\b|\bthe (court below|lower court|trial court)\b"
STAGED = r"(?is)\bfirst\b.*\bsecond\b|\b(two|three|four)[- ](stage|step|part|prong)|\(1\).*\(2\)|\(a\).*\(b\)|\bstages?\b"
QUESTION = r"(?i)^\s*(specifically,?\s*)?whether\s+"
SAME, REVIEW_REACH = 0.9, 250


def _question_words(question: Column) -> Column:
    return text.content_words(F.regexp_replace(question, QUESTION, ""))


def _warn(rows: DataFrame, rule: Column | str, message: str, whole: bool = False) -> DataFrame:
    """Warnings of one rule; those of a whole section have no index."""
    idx = F.lit(None).cast("int") if whole else F.col("idx").cast("int")
    return rows.where(rule).select("doc_id", "section", idx.alias("idx"), F.lit(message).alias("message"))


def structure_warnings(items: DataFrame, found: DataFrame, parties: DataFrame) -> DataFrame:
    """``doc_id, section, idx, message``: departures of a brief from its format that need more than one item.

    ``items(doc_id, section, idx, anchor, text, role, kind, issue_id, issue_ids)``: ``issue_id`` is an issue's own id or the
    one that a decision answers, ``issue_ids`` those of a fact or ratio, ``text`` a law item's proposition;
    ``found(doc_id, anchor, text)`` are the document's anchors, ``parties(doc_id, name)``.  All joins are within a document.
    """
    at = found.groupBy("doc_id", "anchor").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("_at"))
    known = items.where("section = 'issues'").groupBy("doc_id").agg(F.collect_list("issue_id").alias("_ids"))
    names = parties.select("doc_id", text.normalize(F.col("name")).alias("_name")).where(F.length("_name") >= 4).groupBy("doc_id").agg(F.collect_set("_name").alias("_names"))
    none = F.array().cast("array<string>")
    rows = items.join(at, ["doc_id", "anchor"], "left").join(known, "doc_id", "left").join(names, "doc_id", "left")
    rows = rows.withColumn("_ids", F.coalesce("_ids", none)).withColumn("_names", F.coalesce("_names", none)).withColumn("issue_ids", F.coalesce("issue_ids", none))
    section = lambda *which: F.col("section").isin(*which)
    reasoning = section("ratio") & (F.col("role") == "reasoning")
    said = text.normalize(F.col("text"))
    of_this_case = F.col("text").rlike(CASE_ROLE) | F.exists("_names", lambda n: said.contains(n))
    reviewed = F.size(text.case_citations(F.substring("_at", -REVIEW_REACH, REVIEW_REACH))) > 0
    out = [
        _warn(rows, section("issues") & reviewed, "anchored to a paragraph that reviews another case"),
        _warn(rows, section("facts", "ratio") & (F.size("issue_ids") == 0), "not tied to any issue"),
        _warn(rows, section("facts", "ratio") & (F.size(F.array_except("issue_ids", "_ids")) > 0), "refers to an unknown issue"),
        _warn(rows, reasoning & of_this_case, "applies the rule to this case's parties"),
        _warn(rows, reasoning & ~of_this_case & F.col("_at").rlike(COURT_BELOW), "comes from a paragraph about the court below"),
        _warn(rows, section("law") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "no proposition given for the authority"),
        _warn(rows, section("decision") & ~F.array_contains("_ids", F.col("issue_id")), "decision refers to an unknown issue"),
    ]
    issues = items.where("section = 'issues'").select("doc_id", "section", "idx", "issue_id", F.col("text").alias("question"))
    answers = items.where("section = 'decision'").select("doc_id", "issue_id", "section", "idx", "kind", F.col("text").alias("answer"))
    ratios = items.where("section = 'ratio'").select("doc_id", "idx", "role", "text", "issue_ids")
    # Each issue: one conclusion, and a step where its rule is a test in stages.
    counts = answers.groupBy("doc_id", "issue_id").agg(F.count_if(F.col("kind") == "conclusion").alias("conclusions"), F.count_if(F.col("kind") == "step").alias("steps"))
    staged = ratios.where((F.col("role") == "rule") & F.col("text").rlike(STAGED)).select("doc_id", F.explode("issue_ids").alias("issue_id")).distinct().withColumn("staged", F.lit(True))
    each = issues.select("doc_id", F.lit("decision").alias("section"), "idx", "issue_id").join(counts, ["doc_id", "issue_id"], "left").join(staged, ["doc_id", "issue_id"], "left")
    out += [
        _warn(each, F.col("conclusions").isNull(), "issue has no decision", whole=True),
        _warn(each, F.col("conclusions") != 1, "issue has not one conclusion", whole=True),
        _warn(each, F.coalesce("staged", F.lit(False)) & (F.coalesce("steps", F.lit(0)) == 0), "the rule is a staged test, but no stage has its own answer", whole=True),
    ]
    repeated = issues.groupBy("doc_id", "section").agg((F.count("issue_id") - F.countDistinct("issue_id")).alias("_n"))
    out.append(_warn(repeated.withColumn("idx", F.lit(0)), "_n > 0", "issue ids repeat", whole=True))
    asked = answers.join(issues.select("doc_id", "issue_id", "question"), ["doc_id", "issue_id"])
    out.append(_warn(asked, (F.col("kind") == "conclusion") & (F.size(F.array_intersect(_question_words(F.col("question")), text.content_words(F.col("answer")))) == 0), "does not read as an answer to its issue"))
    both = answers.join(ratios.select("doc_id", F.col("text").alias("_ratio")), "doc_id")
    out.append(_warn(both, (text.overlap(F.col("answer"), F.col("_ratio")) >= SAME) & (text.overlap(F.col("_ratio"), F.col("answer")) >= SAME), "repeats a ratio item").distinct())
    first = ratios.groupBy("doc_id").agg(F.min_by("role", "idx").alias("_role")).withColumn("section", F.lit("ratio")).withColumn("idx", F.lit(0))
    out.append(_warn(first, F.col("_role") != "rule", "ratio does not start with the rule"))
    words = F.sum(F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")))
    length = items.groupBy("doc_id").agg(words.alias("_words")).withColumn("section", F.lit("brief")).withColumn("idx", F.lit(0))
    out.append(_warn(length, F.col("_words") > MAX_WORDS, "longer than one page", whole=True))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


def preliminary_warnings(briefs: DataFrame, header: Column) -> DataFrame:
    """``doc_id, message``: what a brief says of the case itself against the record.

    ``briefs(doc_id, citation, decision_date, record_citation, record_date, ...)``; ``header`` is the case's header.
    """
    given = text.canonical(F.get(text.case_citations(F.col("citation")), 0))
    said = F.try_to_date(F.col("decision_date"), "yyyy-MM-dd")
    heard = text.heard_date(F.nullif(F.regexp_extract(header, r"(?im)^\s*heard\s*(?:on\b)?\s*:?\s*(.+?)\.?\s*$", 1), F.lit("")))
    rules = [
        (given != F.col("record_citation"), "citation differs from the record's"),
        (said != F.col("record_date"), "date differs from the record's"),
        (said == heard, "date is the hearing date, not the date of decision"),
    ]
    messages = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(m)) for rule, m in rules]), lambda m: m.isNotNull())
    return briefs.select("doc_id", F.explode(messages).alias("message"))


def law_checks(law: DataFrame, docs: DataFrame, found: DataFrame, sections: DataFrame) -> DataFrame:
    """Law items with ``found_in_document``, ``found_in_anchor`` (the paragraph or one beside it), and the sections they name.

    ``law(doc_id, idx, anchor, authority, code, section_no, decision_date)``, ``sections(code, section_no,
    in_force_start)``; ``in_force_after_decision`` says that the stored wording is younger than the decision.
    """
    beside = found.select("doc_id", F.explode(F.array(F.col("anchor") - 1, F.col("anchor"), F.col("anchor") + 1)).alias("anchor"), "text")
    near = beside.groupBy("doc_id", "anchor").agg(text.normalize(F.array_join(F.collect_list("text"), " ")).alias("_near"))
    bodies = docs.select("doc_id", text.normalize(F.col("text")).alias("_body"))
    joined = law.join(near, ["doc_id", "anchor"], "left").join(bodies, "doc_id", "left").join(sections, ["code", "section_no"], "left")
    holds = lambda c: F.coalesce(F.exists(text.key_terms(F.col("authority")), lambda x: F.col(c).contains(x)), F.lit(False))
    after = F.coalesce(F.col("in_force_start") > F.col("decision_date"), F.lit(False))
    return joined.select("doc_id", "idx", holds("_body").alias("found_in_document"), holds("_near").alias("found_in_anchor"), F.col("in_force_start"), after.alias("in_force_after_decision"))


def reverify(items: DataFrame, names: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """All stored briefs verified again in one job: ``summary`` of ``verify_items`` and ``names_in_text``."""
    return summary(verify_items(items, anchors(chunks)), names_in_text(names, docs))


def drop_undecided(items: DataFrame, undecided: DataFrame) -> DataFrame:
    """Items without undecided issues and what belongs to them alone.

    Issues go by ``decided_issues``; a decision on one goes with it; facts and ratios lose its id and go if none is left.
    """
    issues = items.where("section = 'issues'").select("doc_id", "idx", "text", "issue_id")
    kept = decided_issues(issues, undecided).groupBy("doc_id").agg(F.collect_set("issue_id").alias("_kept"))
    rows = items.join(kept, "doc_id", "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))
    owned = F.col("section").isin("issues", "decision")
    left = F.array_intersect("issue_ids", "_kept")
    gone = (owned & ~F.array_contains("_kept", F.col("issue_id"))) | (~owned & (F.size("issue_ids") > 0) & (F.size(left) == 0))
    return rows.where(~F.coalesce(gone, F.lit(False))).withColumn("issue_ids", F.when(F.size("issue_ids") > 0, left).otherwise(F.col("issue_ids"))).drop("_kept")
