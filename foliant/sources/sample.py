"""A small corpus of three invented contracts, for trying the engine without any files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CONTRACTS = {
    "mutual_nda.pdf": ("Mutual Non-Disclosure Agreement", "Harbour Mills Ltd", "Quill Logistics Ltd", ["Purpose", "Confidential Information", "Exclusions", "Duty Of Care", "Permitted Disclosure", "Return Of Material", "Term", "Governing Law"]),
    "service_levels.pdf": ("Service Level Agreement", "Tern Hosting Ltd", "Harbour Mills Ltd", ["Services", "Availability", "Response Times", "Maintenance", "Credits", "Reporting", "Escalation", "Termination"]),
    "ip_assignment.pdf": ("Assignment Of Intellectual Property", "Osprey Design Ltd", "Quill Logistics Ltd", ["Assignment", "Works", "Moral Rights", "Consideration", "Warranties", "Further Assurance", "Records", "Costs", "Entire Agreement"]),
}
_FORMS = (
    "{a} shall observe this clause towards {b} for {n} months from {n} March 2023.",
    "Where a breach lasts more than {n} days, {b} may claim Rs. {m},000 (rupees {n} thousand and more) from {a}.",
    "Notices under this clause are given in writing and take effect on the {n}th day.",
)


def sample_pages(spark: SparkSession) -> DataFrame:
    """(document, page, raw_text, ocr_confidence, extraction_method, blocks): four clauses to a
    page, each with its heading."""
    rows = []
    for document, (title, a, b, clauses) in _CONTRACTS.items():
        for page, start in enumerate(range(0, len(clauses), 4), 1):
            parts = [title] if page == 1 else []
            for i, name in enumerate(clauses[start : start + 4], start + 1):
                parts.append(f"Clause {i}: {name}\n" + " ".join(f.format(a=a, b=b, n=3 * i + 2, m=15 * i) for f in _FORMS))
            rows.append((document, page, "\n\n".join(parts), 1.0, "native", []))
    return spark.createDataFrame(rows, "document string, page int, raw_text string, ocr_confidence double, extraction_method string, blocks array<struct<text:string,bbox:array<double>,confidence:double>>")
