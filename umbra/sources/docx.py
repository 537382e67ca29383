"""DOCX packages with the standard library: units of their paragraphs, and spans written back into their runs.

A package is one row of a binaryFile scan and is read in the task that has it; only paragraphs leave the task.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from posixpath import basename, dirname, join, normpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
# Header and footer kinds of a section in reading order.
STORIES = tuple((what, kind) for what in ("headerReference", "footerReference") for kind in ("default", "first", "even"))
NOTES = ("/footnotes.xml", "/endnotes.xml", "/comments.xml")
LINK = re.compile(r"(?i)HYPERLINK\s+\"([^\"]*)\"")


def w(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def relationships(package: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id to (kind, target) of a part's relationships."""
    name = join(dirname(part), "_rels", basename(part) + ".rels")
    if name not in package.namelist():
        return {}
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], r.get("Target", "")) for r in ET.fromstring(package.read(name)).iter(f"{{{REL}}}Relationship")}


def story_parts(package: zipfile.ZipFile) -> list[str]:
    """The main part, then headers and footers of each section, then notes and comments; each once."""
    names = package.namelist()
    main = next((t.lstrip("/") for k, t in relationships(package, "").values() if k == "officeDocument"), "word/document.xml")
    if main not in names:
        return []
    rels = relationships(package, main)
    parts = [main]
    for section in ET.fromstring(package.read(main)).iter(w("sectPr")):
        for what, kind in STORIES:
            for ref in section.findall(w(what)):
                if ref.get(w("type"), "default") == kind and (target := rels.get(ref.get(f"{{{DOC_REL}}}id"))):
                    parts.append(target[1].lstrip("/") if target[1].startswith("/") else normpath(join(dirname(main), target[1])))
    parts += [n for n in names if n.endswith(NOTES)]
    return [p for p in dict.fromkeys(parts) if p in names]


def text_nodes(paragraph: ET.Element) -> tuple[str, list[tuple[ET.Element, int, int]]]:
    """The text of a paragraph, and its text nodes with their places in it. Tabs and breaks are one character."""
    out, nodes, at = [], [], 0
    for node in paragraph.iter():
        if node.tag == w("t"):
            piece = node.text or ""
            nodes.append((node, at, at + len(piece)))
        elif node.tag in (w("br"), w("cr")):
            piece = "\n"
        elif node.tag == w("tab"):
            piece = "\t"
        else:
            continue
        out.append(piece)
        at += len(piece)
    return "".join(out), nodes


def package_units(content: bytes) -> Iterator[tuple[str, str, int, str]]:
    """(part, unit_id, seq, text); paragraph numbers begin anew in each part, empty paragraphs count."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        seq = 0
        for part in story_parts(package):
            for i, p in enumerate(ET.fromstring(package.read(part)).iter(w("p"))):
                yield part, f"{part}:p{i:04d}", seq, text_nodes(p)[0]
                seq += 1


def set_text(node: ET.Element, value: str) -> None:
    node.text = value
    if value != value.strip():
        node.set(SPACE, "preserve")
    else:
        node.attrib.pop(SPACE, None)


def write_span(paragraph: ET.Element, start: int, end: int, replacement: str) -> bool:
    """The replacement goes to the first run of the span, the others lose their part of it. False without a run."""
    met = [(n, a, z) for n, a, z in text_nodes(paragraph)[1] if a < end and start < z]
    for k, (node, a, z) in enumerate(met):
        text = node.text or ""
        set_text(node, (text[: max(0, start - a)] + replacement if k == 0 else "") + text[min(z, end) - a :])
    return bool(met)


def swapped(value: str, emails: dict[str, str]) -> str:
    for old, new in emails.items():
        value = re.sub(re.escape(old), lambda _: new, value, flags=re.IGNORECASE)  # noqa: B023
    return value


def rewrite(content: bytes, changes: dict[str, list[tuple[int, int, str]]], emails: dict[str, str]) -> bytes:
    """The package with spans of its units replaced, and e-mail addresses in links and field codes.

    ``changes``: unit_id to (start, end, replacement). The result is opened again before it is returned.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        stories = set(story_parts(package))
        for name in package.namelist():
            data = package.read(name)
            if name in stories:
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
                    if not re.fullmatch(r"ns\d+", prefix):
                        ET.register_namespace(prefix, uri)
                root = ET.fromstring(data)
                for i, p in enumerate(root.iter(w("p"))):
                    for start, end, text in sorted(changes.get(f"{name}:p{i:04d}", ()), reverse=True):
                        write_span(p, start, end, text)
                for node in root.iter():
                    if node.tag == w("instrText") and node.text:
                        node.text = swapped(node.text, emails)
                    for attribute in (w("instr"), "instr"):
                        if node.get(attribute):
                            node.set(attribute, swapped(node.get(attribute), emails))
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            elif name.endswith(".rels") and emails:
                root = ET.fromstring(data)
                for r in root.iter(f"{{{REL}}}Relationship"):
                    if r.get("Type", "").endswith("/hyperlink"):
                        r.set("Target", swapped(r.get("Target", ""), emails))
                ET.register_namespace("", REL)
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            made.writestr(name, data)
    if sum(1 for _ in package_units(out.getvalue())) != sum(1 for _ in package_units(content)):
        raise ValueError("the written package does not open as the one it was made from")
    return out.getvalue()


def links(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return [t for n in package.namelist() if n.endswith(".rels") for r in ET.fromstring(package.read(n)).iter(f"{{{REL}}}Relationship") if r.get("Type", "").endswith("/hyperlink") for t in [r.get("Target", "")]]


# ---- as DataFrames ------------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_units(packages: DataFrame) -> DataFrame:
    """(path, content) to units; doc_id is the hash of the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                yield pd.DataFrame([(doc_id, *u) for u in package_units(content)], columns=["doc_id", "part", "unit_id", "seq", "text"])

    return packages.selectExpr("xxhash64(path) AS doc_id", "content").mapInPandas(run, "doc_id long, part string, unit_id string, seq int, text string")


def read_members(packages: DataFrame) -> DataFrame:
    """(doc_id, member, content) of XML members, undecodable bytes left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(doc_id, n, z.read(n).decode("utf-8", "ignore")) for n in z.namelist() if n.endswith((".xml", ".rels"))]
                yield pd.DataFrame(rows, columns=["doc_id", "member", "content"])

    return packages.selectExpr("xxhash64(path) AS doc_id", "content").mapInPandas(run, "doc_id long, member string, content string")


def write_packages(packages: DataFrame, replaced: DataFrame) -> DataFrame:
    """(path, content) and replaced entities to (path, content) of redacted packages."""
    from pyspark.sql import functions as F

    listed = replaced.groupBy("doc_id").agg(F.collect_list(F.struct("unit_id", "start", "end", "replacement", "type", "text")).alias("changes"))
    rows = packages.selectExpr("path", "content", "xxhash64(path) AS doc_id").join(listed, "doc_id", "left").select("path", "content", "changes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for content, changes in zip(pdf["content"], pdf["changes"]):
                changes = [] if changes is None else list(changes)
                by_unit: dict[str, list] = {}
                for c in changes:
                    by_unit.setdefault(c["unit_id"], []).append((c["start"], c["end"], c["replacement"]))
                made.append(rewrite(content, by_unit, {c["text"]: c["replacement"] for c in changes if c["type"] == "EMAIL"}))
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    return rows.mapInPandas(run, "path string, content binary")


def page_packages(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path) of PDF files and their units, one for each page, to (path, content) of packages: a heading for each page, then its
    lines. A file without units gives an empty package."""
    from pyspark.sql import functions as F

    pages = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "unit_id", "text"))).alias("pages"))
    rows = files.selectExpr("path", "xxhash64(path) AS doc_id").join(pages, "doc_id", "left").select("path", "pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for pages in pdf["pages"]:
                lines = []
                for p in () if pages is None else pages:
                    lines += [f"Source page {p['unit_id'].rsplit('-', 1)[-1]}", *((p["text"] or "").splitlines() or [""])]
                made.append(build(lines))
            yield pd.DataFrame({"path": [re.sub(r"(?i)\.pdf$", ".docx", p) for p in pdf["path"]], "content": made})

    return rows.mapInPandas(run, "path string, content binary")


def build(paragraphs: list[str], header: list[str] = (), footer: list[str] = (), field: str = "", link: str = "") -> bytes:
    """A small package, for fixtures: paragraphs of the body, a header, a footer, a field code and a link target."""
    from xml.sax.saxutils import escape, quoteattr

    para = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    head = f'xmlns:w="{MAIN}" xmlns:r="{DOC_REL}"'
    code = f"<w:p><w:fldSimple w:instr={quoteattr(field)}><w:r><w:t>link</w:t></w:r></w:fldSimple></w:p>" if field else ""
    refs = "".join(f'<w:{k}Reference w:type="default" r:id="r{i}"/>' for i, (k, x) in enumerate((("header", header), ("footer", footer)), 1) if x)
    rel = lambda i, kind, target, more="": f'<Relationship Id="r{i}" Type="{DOC_REL}/{kind}" Target={quoteattr(target)}{more}/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="{REL}">{rel(1, "officeDocument", "word/document.xml")}</Relationships>')
        z.writestr("word/document.xml", f"<w:document {head}><w:body>{''.join(map(para, paragraphs))}{code}<w:sectPr>{refs}</w:sectPr></w:body></w:document>")
        rels = [rel(i, k, f"{k}1.xml") for i, (k, x) in enumerate((("header", header), ("footer", footer)), 1) if x]
        rels += [rel(9, "hyperlink", link, ' TargetMode="External"')] if link else []
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{REL}">{"".join(rels)}</Relationships>')
        for k, tag, x in (("header", "hdr", header), ("footer", "ftr", footer)):
            if x:
                z.writestr(f"word/{k}1.xml", f"<w:{tag} {head}>{''.join(map(para, x))}</w:{tag}>")
    return out.getvalue()
