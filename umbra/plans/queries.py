"""The engine's queries over whole tables, or over the inline fixtures where no table holds such values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import audit_shape, digits, endpoint, residual_shape, slug, value_shape
from ..operators import evaluate as E
from ..operators import replace as R
from ..operators import structured as S
from ..operators.detect import detect, entities, with_context
from ..operators.propagate import residuals, seeds
from ..operators.verify import summary, values
from ..sources import docx, tables
from . import fixtures as X
from . import forms as F_
from .redaction import redact_units

Query = Callable[[SparkSession, str], DataFrame]
TYPES4 = ("CREDIT_CARD", "EMAIL", "IP", "PHONE")


def _spans(units: DataFrame, spans) -> DataFrame:
    rows = units.select("doc_id", "seq", F.explode(spans).alias("s"))
    return rows.select("doc_id", "seq", "s.start", "s.end", F.col("s.text").alias("value"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.document_units(spark, folder)


def _structured(units: DataFrame) -> DataFrame:
    return entities(detect(units, contextual=False))


def units_scan(spark, folder):
    return _documents(spark, folder).select("doc_id", "unit_id", "seq", F.length("text").cast("long").alias("n_chars"))


def units_stats(spark, folder):
    u = _documents(spark, folder)
    per = u.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"), F.min_by("unit_id", "seq").alias("first_id"), F.max_by("unit_id", "seq").alias("last_id"))
    return per


def full_text(spark, folder):
    return tables.full_text(_documents(spark, folder)).select("doc_id", F.md5("text").alias("text_md5"))


def neighbor_context(spark, folder):
    return with_context(_documents(spark, folder)).select("doc_id", "seq", F.md5("context").alias("context_md5"))


def email_spans(spark, folder):
    return _spans(_documents(spark, folder), S.emails(F.col("text")))


def email_domains(spark, folder):
    domain = F.lower(F.substring_index("value", "@", -1)).alias("domain")
    return email_spans(spark, folder).groupBy(domain).agg(F.count("*").alias("n"))


def ipv4_spans(spark, folder):
    return _spans(_documents(spark, folder), S.ipv4(F.col("text")))


def card_candidates(spark, folder):
    rows = _documents(spark, folder).select("doc_id", "seq", F.explode(S.card_candidates(F.col("text"))).alias("s"))
    return rows.select("doc_id", "seq", "s.start", "s.end", "s.value")


def card_spans(spark, folder):
    return _spans(_documents(spark, folder), S.cards(F.col("text")))


def phone_spans(spark, folder):
    return _spans(_documents(spark, folder), S.phones(F.col("text")))


def structured_entities(spark, folder):
    return _structured(_documents(spark, folder)).select("doc_id", "seq", "type", "start", "end", "text", "detector")


def entity_counts_by_type(spark, folder):
    return _structured(_documents(spark, folder)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def rollup_source_type(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "lang")
    rows = _structured(_documents(spark, folder)).select("doc_id", "type").join(docs, "doc_id")
    return rows.rollup("lang", "type").agg(F.count("*").alias("n"))


def pii_density(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    n = _structured(_documents(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n"))
    by = docs.join(n, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.coalesce("n", F.lit(0))).alias("entities"), F.sum("chars").alias("chars"))
    return by.withColumn("per_mb", F.round(F.col("entities") * 1e6 / F.col("chars"), 6))


def labels_vs_pii(spark, folder):
    labels = tables.table(spark, folder, "labels")
    n = _structured(_documents(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return labels.join(n, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count("n").alias("docs_with_pii"), F.sum(F.coalesce("n", F.lit(0))).alias("entities"))


def pages_text_pii(spark, folder):
    rows = _structured(tables.page_units(spark, folder))
    kinds = spark.createDataFrame([(t,) for t in TYPES4], "type string")
    return kinds.join(rows.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages")), "type", "left").fillna(0)


def conversations_pii(spark, folder):
    units = tables.turn_units(spark, folder)
    found = detect(units, contextual=False)
    return found.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size("spans")).cast("long").alias("entities"))


def mapping_serials(spark, folder):
    return R.serials(_structured(_documents(spark, folder))).select("doc_id", "type", "key", "serial")


def replacement_values(spark, folder):
    rows = R.replacements(_structured(_documents(spark, folder)))
    return rows.where(F.col("type").isin("EMAIL", "IP")).select("doc_id", "seq", "type", "start", "text", "replacement")


def redacted_documents(spark, folder):
    """Everything found becomes its type in brackets, so that SQL can say it too; values: replacement_values."""
    units = _documents(spark, folder)
    marks = _structured(units).withColumn("replacement", F.concat(F.lit("["), F.col("type"), F.lit("]")))
    return R.redact(units, marks).select("doc_id", "seq", F.md5("text").alias("text_md5"))


def residual_check(spark, folder):
    """How many values there were, and in how many places they still are."""
    done = redact_units(_documents(spark, folder), contextual=False, context=False)
    originals = values(done.entities)
    left = residuals(originals, done.units)
    return originals.agg(F.count("*").alias("originals")).crossJoin(left.agg(F.count("*").alias("residual")))  # one row each


def value_shapes(spark, folder):
    rows = _structured(_documents(spark, folder))
    return rows.groupBy("type", value_shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


def luhn_numbers(spark, folder):
    rows = card_candidates(spark, folder).select(digits(F.col("value")).alias("digits"))
    return rows.groupBy(F.length("digits").alias("length"), F.call_function("luhn_check", "digits").alias("valid")).agg(F.count("*").alias("n"))


def truth_chunks(spark, folder):
    return E.chunk_manifest(E.chunked(_documents(spark, folder)))


def form_local_entities(spark, folder):
    """All nine types over a form for each customer, before anything is propagated."""
    found = entities(detect(with_context(F_.forms(spark, folder))))
    return found.select("doc_id", "seq", "type", "start", "end", "text", "detector")


def form_entities(spark, folder):
    done = redact_units(F_.forms(spark, folder))
    return done.entities.select("doc_id", "seq", "type", "start", "end", "text", "detector", "identity")


def form_redacted(spark, folder):
    return redact_units(F_.forms(spark, folder)).units.select("doc_id", "seq", "text")


def form_summary(spark, folder):
    done = redact_units(F_.forms(spark, folder))
    row = summary(done.entities, done.units)
    return row.select("paragraph_like_units_checked", "prediction_count", "distinct_predicted_values", "residual_original_value_count", "passed")


def form_scores(spark, folder):
    """What is found in the forms, scored against what was put in."""
    units = F_.forms(spark, folder)
    found = redact_units(units).entities.select(F.xxhash64("doc_id", "unit_id", "start").alias("id"), "doc_id", "type", "text", "unit_id")
    m = E.by_type(F_.truth(spark, folder), found)
    return m.select("type", "ground_truth", "detected", "TP", "FP", "FN", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def order_scores(spark, folder):
    """Items of orders scored within documents."""
    m = E.by_type(*F_.order_items(spark, folder))
    return m.select("type", "ground_truth", "detected", "TP", "FP", "FN", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def order_unmatched(spark, folder):
    missed, wrong = E.unmatched(*F_.order_items(spark, folder))
    side = lambda df, name: df.groupBy(F.lit(name).alias("side"), "doc_id", F.upper("type").alias("type")).agg(F.count("*").alias("n"))
    return side(missed, "truth").union(side(wrong, "prediction"))


def document_audit_gaps(spark, folder):
    """Shapes of e-mail addresses and phone numbers in the documents that no detector took."""
    units = _documents(spark, folder)
    return E.audit_gaps(units, _structured(units)).select("doc_id", "unit_id", "type", "start", "end", "shape")


def document_merge(spark, folder):
    """E-mail addresses as records without offsets, given their offsets again."""
    units = _documents(spark, folder)
    records = _structured(units).where("type = 'EMAIL'").select(F.col("start").cast("long").alias("id"), "doc_id", "unit_id", "type", "text")
    return E.validate(E.merge(records, units)[0], units).select("doc_id", "unit_id", "text", "start", "end", "problem")


def demo_scores(spark, folder):
    """The package of 49 units, found, scored against its 26 annotations."""
    found = redact_units(docx.read_units(X.demo_package(spark))).entities
    found = found.withColumn("id", F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "start"))).drop("doc_id", "context")
    m = E.by_type(X.demo_truth(spark), found)
    return m.select("type", "ground_truth", "detected", "TP", "FP", "FN")


def _fixture(texts, spans) -> Query:
    def query(spark, folder):
        return _spans(X.lines(spark, texts), spans(F.col("text")))

    return query


def _resolved(texts, kind: str) -> Query:
    def query(spark, folder):
        rows = entities(detect(X.lines(spark, texts))).where(F.col("type") == kind)
        return rows.select("doc_id", "text", "detector")

    return query


def local_entities(spark, folder):
    """Contextual and structured values of the multi-unit fixture, with neighbour context."""
    return entities(detect(with_context(X.documents(spark)))).select("doc_id", "seq", "type", "text", "detector")


def _propagated(spark: SparkSession) -> DataFrame:
    return redact_units(X.documents(spark)).entities


def seed_values(spark, folder):
    return seeds(detect(with_context(X.documents(spark)))).select("doc_id", "type", "value")


def propagated_entities(spark, folder):
    return _propagated(spark).where(F.col("detector").startswith("document-") & (F.col("detector") != "document-cross-unit")).select("doc_id", "seq", "type", "text", "detector")


def cross_unit_entities(spark, folder):
    return _propagated(spark).where("detector = 'document-cross-unit'").select("doc_id", "seq", "type", "text", "identity")


def redacted_fixture(spark, folder):
    return redact_units(X.documents(spark)).units.select("doc_id", "seq", "text")


def verification_summary(spark, folder):
    done = redact_units(X.documents(spark))
    return summary(done.entities, done.units)


def evaluate_by_type(spark, folder):
    m = E.by_type(X.truth(spark), X.predictions(spark))
    return m.select("type", "ground_truth", "detected", "TP", "FP", "FN", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def evaluate_totals(spark, folder):
    m = E.totals(E.by_type(X.truth(spark), X.predictions(spark)))
    return m.select("ground_truth", "detected", "TP", "FP", "FN", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def unmatched_truth(spark, folder):
    return E.unmatched(X.truth(spark), X.predictions(spark))[0].select("id", "type")


def unmatched_predictions(spark, folder):
    return E.unmatched(X.truth(spark), X.predictions(spark))[1].select("id", "type")


def audit_gaps(spark, folder):
    return E.audit_gaps(X.audited(spark), X.marked(spark))


def audit_predictions(spark, folder):
    return E.audit_predictions(X.guessed(spark), X.audited(spark), X.marked(spark)).select("unit_id", "type", "reason", audit_shape(F.col("text")).alias("shape"))


def audit_misses(spark, folder):
    return E.audit_misses(X.guessed(spark), X.audited(spark), X.marked(spark)).select("unit_id", "type", "start", "end")


def audit_summary(spark, folder):
    row = E.audit_summary(X.guessed(spark), X.audited(spark), X.marked(spark))
    lists = {c: F.array_join(c, " ").alias(c) for c in ("annotations", "email_units", "phone_units")}
    return row.select(*(lists.get(c, F.col(c)) for c in row.columns))


def truth_validate(spark, folder):
    return E.validate(X.marked(spark), X.audited(spark)).select("unit_id", "type", "start", "problem")


def truth_merge(spark, folder):
    return E.merge(X.records(spark), X.audited(spark))[0].select("unit_id", "type", "text", "start", "end")


def truth_rejects(spark, folder):
    return E.merge(X.records(spark), X.audited(spark))[1].select("id", "reason")


def scalar_shapes(spark, folder):
    names = tables.table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("v"))
    return names.select("c_custkey", value_shape(F.col("v")).alias("shape"), residual_shape(F.col("v")).alias("residual"), audit_shape(F.col("v")).alias("audit"), slug(F.col("v")).alias("slug"))


def url_endpoints(spark, folder):
    return tables.table(spark, folder, "pages").groupBy(endpoint(F.col("url")).alias("endpoint")).agg(F.count("*").alias("n"))


def docx_units(spark, folder):
    """A package built here, read by the same reader as files."""
    content = docx.build(["Contact person", "Maya Verlin", ""], ["head ann@mail.example"], ["foot"], 'HYPERLINK "mailto:ann@mail.example"', "mailto:ann@mail.example")
    packages = spark.createDataFrame([("fixture.docx", bytearray(content))], "path string, content binary")
    return docx.read_units(packages).select("part", "unit_id", "seq", "text")


def docx_redaction(spark, folder):
    content = docx.build(["Contact person", "Maya Verlin", ""], ["head ann@mail.example"], ["foot"], 'HYPERLINK "mailto:ann@mail.example"', "mailto:ann@mail.example")
    packages = spark.createDataFrame([("fixture.docx", bytearray(content))], "path string, content binary")
    done = redact_units(docx.read_units(packages))
    return docx.read_units(docx.write_packages(packages, done.replaced)).select("unit_id", "seq", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        units_scan, units_stats, full_text, neighbor_context, email_spans, email_domains, ipv4_spans, card_candidates, card_spans, phone_spans, structured_entities, entity_counts_by_type,
        rollup_source_type, pii_density, labels_vs_pii, pages_text_pii, conversations_pii, mapping_serials, replacement_values, redacted_documents, residual_check, value_shapes, luhn_numbers,
        truth_chunks, local_entities, seed_values, propagated_entities, cross_unit_entities, redacted_fixture, verification_summary, evaluate_by_type, evaluate_totals, unmatched_truth,
        demo_scores, form_local_entities, form_entities, form_redacted, form_summary, form_scores, order_scores, order_unmatched, document_audit_gaps, document_merge, unmatched_predictions, audit_gaps, audit_predictions, audit_misses, audit_summary, truth_validate, truth_merge, truth_rejects, scalar_shapes, url_endpoints, docx_units, docx_redaction,
    )
} | {
    "ssn_spans": _fixture(X.SSN, S.ssns),
    "dob_spans": _fixture(X.BIRTHS, S.births),
    "ipv6_spans": _fixture(X.IPV6, S.ipv6),
    "address_spans": _resolved(X.ADDRESSES, "ADDRESS"),
    "org_spans": _resolved(X.FIRMS, "ORG"),
    "person_spans": _resolved(X.PERSONS, "PERSON"),
}
