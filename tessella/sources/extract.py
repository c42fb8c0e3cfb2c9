"""Text of downloaded files, by a registry of extractors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 50


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _xml_texts(data: bytes, end: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in ElementTree.fromstring(data).iter() if p.tag.endswith(end)]


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(t for t in _xml_texts(z.read("word/document.xml"), "}p") if t)


def _pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        return "\n\n".join("\n".join(t for t in _xml_texts(z.read(n), "}p") if t) for n in slides)


def _xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = _xml_texts(z.read("xl/sharedStrings.xml"), "}si") if "xl/sharedStrings.xml" in names else []
        out = []
        for n in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    out.append("\t".join(cells))
        return "\n".join(out)


#: Extractors by file ending.  PDF and images need a provider: register one with the same signature.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": _plain, "md": _plain, "csv": _plain, "json": _plain, "log": _plain, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


# Endings that only a provider can read.
PROVIDED = ("pdf", "png", "jpg", "jpeg", "gif", "webp")


def register(extractor: Callable[[bytes], str], *endings: str) -> None:
    """Makes `extractor` read files of these endings, such as those of `PROVIDED`."""
    EXTRACTORS.update(dict.fromkeys((e.lower().lstrip(".") for e in endings), extractor))


def unread(files: DataFrame) -> DataFrame:
    """(ending, n) of files that would be left out for want of an extractor."""
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(~end.isin(*EXTRACTORS)).groupBy(end.alias("ending")).agg(F.count("*").alias("n"))


def extract_texts(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, content, extraction_method) of binary files (path, content); unreadable files, those without an extractor
    and texts under 50 characters are left out."""
    known = extractors or EXTRACTORS

    def run(batches):
        for b in batches:
            paths, texts, how = [], [], []
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                end = p.rpartition(".")[2].lower()
                try:
                    text = known[end](data.as_py()).strip() if end in known and data.is_valid else ""
                except Exception:  # a broken file is not the job's end
                    continue
                if len(text) >= LEAST:
                    paths.append(p), texts.append(text), how.append(end)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(how, pa.string())], ["path", "content", "extraction_method"])

    known_ends = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*known)
    return files.where(known_ends).select("path", "content").mapInArrow(run, "path string, content string, extraction_method string")
