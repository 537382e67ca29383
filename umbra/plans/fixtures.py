"""Inline relations with invented values, for what no table of the corpus holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..schema import UNIT

SSN = ("SSN 123456789", "SSN 000-12-3456", "id 219-09-9999 on file", "call 219099999 now", "social security 219 09 9999", "666-12-3456", "219-00-1234", "219-09-0000")
BIRTHS = (
    "Date of Birth: 14/08/1998", "Date of Birth: 1998-08-14", "Date of Birth: Aug 14, 1998", "Date of Birth: 14th August 1998", "Filing date: 12/01/2025 Date of Birth: 14/08/1998",
    "D.O.B.: 14/08/1998", "born 31/02/1998", "DOB 05.06.1977; filing date: 01/02/2003", "15/07/1980 DOB", "Order 12/01/2025",
)
IPV6 = ("at 2001:db8::1 now", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "fe80::1::2", "12:30:45", "ab::cd:ef")
ADDRESSES = (
    "Registered office: 14C, Fern Park, Norvale, Norvale 110001; telephone +91-98123-45670", "Address: 123 Example Street, +91 9812345670", "Norvale - 411 038", "One Harbour Centre",
    "5 each thereafter", "1 (Norvale)", "listed at 45.50 per share", "Plot No. 12, Alder Road, Norvale 411038",
)
FIRMS = (
    "The promoters of our Company are BRAMBLE FAMILY TRUST and OSPREY FAMILY TRUST.", "RISK FACTORS", "USE OF PROCEEDS", "This is the QXE Limited and also The Larkspur Bank Limited",
    "Our suppliers include Hollin Copper; Wend Power Limited; and Tarn Steel", "our Company",
)
PERSONS = (
    "Contact Maya Verlin by post", "500 shares allotted to Tarun N. Velmora, 500 shares allotted to Kiran Subra Oslin", "transfer of shares to Kiran Oslin from DM Feld and Ganesh BO.",
    "Mr. Ravi Kumar, Director", "Any transfer of shares by the dematerialised account holders shall be made", "Risk Factors and General Information",
)
#: Documents of several units: a label before its value, a name in capitals, names split over units.
DOCUMENTS = (
    (1, ("Date of Birth", "14/08/1998")),
    (2, ("Contact person", "Maya Verlin", "as told by MAYA VERLIN today")),
    (3, ("The promoters are BRAMBLE FAMILY TRUST and OSPREY FAMILY TRUST.", "BRAMBLE", "FAMILY TRUST", "OSPREY", "FAMILY TRUST")),
    (4, ("Mr. Tarun Velmora, Director", "signed by Tarun", "Velmora for all", "tarun velmora@mail.example")),
)


def lines(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, "body", "body:p0000", 0, t) for i, t in enumerate(texts)], UNIT)


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, "body", f"body:p{i:04d}", i, t) for d, texts in DOCUMENTS for i, t in enumerate(texts)], UNIT)


ITEM = "id long, type string, text string, unit_id string, context string"
TRUTH = (
    (0, "PERSON", "Maya Verlin", "body:p1", None), (1, "EMAIL", "m@mailbox.example", "body:p2", None), (2, "PHONE", "+1 202 555 0147", "body:p3", None),
    (3, "ORG", "Bramble  Trust", "body:p5", None), (4, "ORG", "Bramble Trust", "body:p6", None), (5, "IP", "203.0.113.9", "body:p7", "server 203.0.113.9 down"),
)
PREDICTIONS = (
    (0, "PERSON", "MAYA VERLIN", "/body:p1", None), (1, "PERSON", "m@mailbox.example", "body:p2", None), (2, "PHONE", "+1 202 555 0147", "body:p3", None), (3, "ORG", "Osprey Trust", "body:p4", None),
    (4, "ORG", "bramble trust", "body:p5", None), (5, "ORG", "bramble trust", "body:p9", None), (6, "IP", "203.0.113.9", "body:p7", "203.0.113.9"),
)


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUTH), ITEM)


def predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PREDICTIONS), ITEM)


#: Units of one document for the checks of annotations.
AUDITED = (("u1", "write to ann@mail.example or bo@mail.example"), ("u2", "call +1 202 555 0147 or 98123 45670"), ("u3", "Maya Verlin. Maya Verlin met Maya Verlin Oslin"))
MARKED = (("u1", "EMAIL", "ann@mail.example", 9, 25), ("u2", "PHONE", "+1 202 555 0147", 5, 20), ("u3", "PERSON", "Maya Verlin", 0, 11), ("u3", "PERSON", "Nobody", 3, 9), ("u9", "PERSON", "X", 0, 1))
GUESSED = (("u1", "EMAIL", "bo@mail.example"), ("u2", "PHONE", "+1 202 555 0147"), ("u3", "ORG", "Verlin"), ("u3", "PERSON", "Lost Name"))
RECORDS = (
    (0, "u3", "PERSON", "Maya Verlin"), (1, "u3", "PERSON", "Maya Verlin"), (2, "u3", "PERSON", "Maya Verlin Oslin"), (3, "u3", "PERSON", "Maya Verlin"), (4, "u1", "SSN", "x"),
    (5, "u7", "ORG", "x"), (6, "u1", "EMAIL", "no@where.example"), (7, "u1", "EMAIL", "ann@mail.example"), (8, "u1", "EMAIL", "ann@mail.example"),
)


def audited(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AUDITED), "unit_id string, text string")


def marked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MARKED), "unit_id string, type string, text string, start int, end int")


def guessed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GUESSED), "unit_id string, type string, text string")


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECORDS), "id long, unit_id string, type string, text string")


#: A package of 49 units: label and value cells as paragraphs, a header, a footer, a field code and a link; numbers that are no
#: personal data. After the bar: the values to be found, in order, with their types.
DEMO = (
    ("Prospectus of a company that does not exist", ""), ("All values are made up.", ""), ("Company and contact", ""), ("Company", ""), ("Bramble Technologies Pvt. Ltd.", "ORG"), ("Contact person", ""),
    ("Maya Verlin", "PERSON"), ("Registered office", ""), ("14C, Fern Park, Norvale, Norvale 110001", "ADDRESS"), ("E-mail", ""), ("maya.verlin@mailbox.example", "EMAIL"), ("Telephone", ""),
    ("+91 98123 45670", "PHONE"), ("Date of Birth", ""), ("14/08/1998", "DOB"), ("The company, {Bramble Technologies Pvt. Ltd.}, says that {Maya Verlin} is whom to ask.", "ORG PERSON"),
    ("Registered office: {14C, Fern Park, Norvale, Norvale 110001}; telephone {+91-98123-45670}.", "ADDRESS PHONE"), ("Write to {maya.verlin@mailbox.example} today", "EMAIL"), ("Values for checks", ""),
    ("Field", ""), ("Value", ""), ("Social Security Number", ""), ("219-09-9999", "SSN"), ("Credit card", ""), ("4111 1111 1111 1111", "CREDIT_CARD"), ("IP address", ""), ("192.168.7.20", "IP"),
    ("Second company", ""), ("Larkspur Foods Limited", "ORG"), ("Signatures", ""), ("Director: {Kiran Oslin}", "PERSON"), ("Signatory: {Maya Verlin}", "PERSON"), ("Partner: {Kiran Oslin}", "PERSON"),
    ("Controls", ""), ("Order 123456789", ""), ("Invoice 1234567890123456", ""), ("Revenue 2025", ""), ("Page 123", ""), ("Ticket #12345", ""), ("Filing date: 12/01/2025", ""),
    ("Transaction date: 01/02/2026", ""), ("More contacts", ""), ("Letters may go to {Maya Verlin} at {14C, Fern Park, Norvale, Norvale 110001}.", "PERSON ADDRESS"),
    ("{Larkspur Foods Limited} is another company.", "ORG"), ("Other phone: {+1-202-555-0147}", "PHONE"), ("Host: {192.168.7.20}", "IP"),
)
DEMO_HEAD, DEMO_FOOT = ("{Bramble Technologies Pvt. Ltd.} | {+91 98123 45670}", "ORG PHONE"), ("Made up | Contact: {maya.verlin@mailbox.example} | Page", "EMAIL")


def _plain(line: str) -> str:
    return line.replace("{", "").replace("}", "")


def demo_package(spark: SparkSession) -> DataFrame:
    """(path, content) of the package."""
    from ..sources.docx import build

    link = "mailto:maya.verlin@mailbox.example"
    content = build([_plain(t) for t, _ in DEMO], [_plain(DEMO_HEAD[0])], [_plain(DEMO_FOOT[0])], f'HYPERLINK "{link}"', link)
    return spark.createDataFrame([("demo.docx", bytearray(content))], "path string, content binary")


def demo_truth(spark: SparkSession) -> DataFrame:
    rows = []
    for unit, (line, kinds) in [*((f"word/document.xml:p{i:04d}", x) for i, x in enumerate(DEMO)), ("word/header1.xml:p0000", DEMO_HEAD), ("word/footer1.xml:p0000", DEMO_FOOT)]:
        held = re.findall(r"\{(.*?)\}", line) or [line]
        rows += [(len(rows) + i, kind, value, unit, None) for i, (kind, value) in enumerate(zip(kinds.split(), held))]
    return spark.createDataFrame(rows, ITEM)
