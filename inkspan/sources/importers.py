"""Readers of raw editions: each gives units without a seq of their own source;
``build_corpus`` puts them together, chooses witnesses and accounts for all.

Files are read by Spark (``read.text`` or ``binaryFile``), so any path that Spark
can read will do.  Line formats are parsed by Column expressions; XML and books of
prose go one file to a row of ``mapInPandas``.
"""

from __future__ import annotations

import io
import json
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkspan.functions.tokens import count_words, script_words
from inkspan.operators import witness

UNITS = "language string, collection string, book string, book_title string, chapter string, verse string, text string, source string, witness string, has_gap boolean, reference_author string, supplied_frac double, place long"

#: New Testament books by number, 40 to 66.
NT_BOOKS = "MATT MARK LUKE JOHN ACTS ROM 1COR 2COR GAL EPH PHIL COL 1THESS 2THESS 1TIM 2TIM TITUS PHLM HEB JAS 1PET 2PET 1JOHN 2JOHN 3JOHN JUDE REV".split()
#: Ligatures and sacred names of the manuscripts.
LIGATURES = {"ϛ": "στ", "ȣ": "ου"}


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, place, value): the lines of text files in order."""
    whole = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


def _finish(df: DataFrame, **constant: object) -> DataFrame:
    filled = {"witness": None, "has_gap": False, "reference_author": None, "supplied_frac": 0.0, "book_title": F.col("book")} | constant
    for name, value in filled.items():
        if name not in df.columns:
            df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    types = dict(x.rsplit(" ", 1) for x in UNITS.split(", "))
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()]).where(F.trim("text") != "")


def original_hand(text: Column) -> Column:
    """What the first hand wrote: of a correction group the x{...} reading or else
    the first, without the transcription's own marks and breaks."""
    out = F.regexp_replace(text, r"x\{([^}]*)\}(?:[a-z0-9]?\{[^}]*\})*", "$1")
    out = F.regexp_replace(out, r"\{([^}]*)\}(?:[a-z0-9]?\{[^}]*\})*", "$1")
    out = F.regexp_replace(out, r"[/|\\]\d*", "")
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[%~^*+=&$\[\]0-9]", ""), r"\s+", " "))


def manuscripts(spark: SparkSession, paths: str | list[str], skip: tuple[str, ...] = ("01",)) -> DataFrame:
    """Lines "BBCCCVVV text", a file a manuscript."""
    rows = lines(spark, paths).withColumn("witness", F.regexp_replace("file", r"\.txt$", "")).where(~F.col("witness").isin(*skip))
    m = lambda i: F.regexp_extract("value", r"^(\d\d)(\d\d\d)(\d\d\d)\s+(.*)$", i)
    names = F.array(*map(F.lit, NT_BOOKS))
    parsed = rows.where(m(1) != "").withColumn("n", m(1).cast("int") - 39).where(F.col("n").between(1, len(NT_BOOKS)))
    body = m(4)
    return _finish(
        parsed.select("witness", "place", F.element_at(names, F.col("n")).alias("book"), m(2).cast("int").cast("string").alias("chapter"), m(3).cast("int").cast("string").alias("verse"),
                      original_hand(body).alias("text"), body.contains("^").alias("has_gap"), (F.length(body) - F.length(F.replace(body, F.lit("~"), F.lit("")))).alias("supplied")).withColumn("supplied_frac", F.col("supplied") / F.greatest(F.lit(1), F.size(F.split("text", " ")))),
        language="grc", collection="NT", source="cntr")


def token_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines "book.chapter.verse token" in files "NN.Name.txt": tokens joined by
    verse, verses in the order of their first token."""
    rows = lines(spark, paths).where(F.col("file").rlike(r"^\d"))
    m = lambda i: F.regexp_extract("value", r"^([^. ]*)\.([^. ]*)\.([^. ]*) (.+)$", i)
    book = F.upper(F.regexp_replace(F.regexp_replace("file", r"^\d+\.", ""), r"\.txt$", ""))
    by = rows.where(m(4) != "").select(book.alias("book"), m(2).alias("chapter"), m(3).alias("verse"), "place", m(4).alias("token")).groupBy("book", "chapter", "verse")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), " ")
    return _finish(by.agg(F.min("place").alias("place"), text.alias("text")), language="grc", collection="LXX", source="swete_lxx", witness="Swete")


def referenced_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines "chapter.verse text"; Latin headings are left out."""
    rows = lines(spark, paths)
    m = lambda i: F.regexp_extract("value", r"^([0-9A-Za-z.]*\d[0-9A-Za-z.]*)\s+(.+)$", i)
    kept = rows.where((m(2) != "") & ~F.replace(m(2), F.lit(" "), F.lit("")).rlike("^[A-Z]+$"))
    ref = m(1)
    book = F.upper(F.regexp_replace(F.regexp_replace("file", r"\.txt$", ""), r"^\d+-", ""))
    chapter = F.when(ref.contains("."), F.substring_index(ref, ".", 1)).otherwise(ref)
    verse = F.when(ref.contains("."), F.regexp_replace(ref, r"^[^.]*\.", "")).otherwise("1")
    return _finish(kept.select(book.alias("book"), chapter.alias("chapter"), verse.alias("verse"), m(2).alias("text"), "place"), language="grc", collection="noncanonical", source="apostolic_fathers", witness="Lake")


def inscriptions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Numbered lines in sections headed "=== title (note)": one unit a section,
    always gapped; bracketed letters count as reconstructed."""
    order = Window.partitionBy("file").orderBy("place")
    rows = lines(spark, paths).withColumn("head", F.when(F.col("value").startswith("==="), F.trim(F.substring_index(F.regexp_replace("value", "^[= ]+|[= ]+$", ""), "(", 1))))
    titled = rows.withColumn("title", F.coalesce(F.last("head", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.regexp_replace("file", r"\.txt$", "")))
    raw = F.regexp_replace(F.regexp_extract("value", r"^\d\d\s+(.*?)(?:\s+<-.*)?$", 1), "([א-ת])/[א-ת]", "$1")
    letters = lambda x: F.length(F.regexp_replace(x, "[^א-ת]", ""))
    kept = titled.where(F.col("value").rlike(r"^\d\d\s")).select("file", "title", "place", raw.alias("raw"))
    inside = F.aggregate(F.regexp_extract_all("raw", F.lit(r"\[([^\]]*)\]"), F.lit(1)), F.lit(""), lambda a, x: F.concat(a, x))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.replace(F.regexp_replace("raw", r"[\[\]]", ""), F.lit("..."), F.lit(" ")).alias("t")))), lambda x: x["t"]), " ")
    by = kept.groupBy("file", "title").agg(F.min("place").alias("place"), text.alias("text"), (F.sum(letters(inside)) / F.greatest(F.lit(1), F.sum(letters(F.col("raw"))))).alias("supplied_frac"))
    book = F.upper(F.when(F.col("file").startswith("nash"), F.lit("NASH")).otherwise(F.substring_index("title", " ", 1)))
    return _finish(by.withColumn("book", book).withColumn("book_title", F.col("title")).withColumn("has_gap", F.lit(True)), language="hbo", collection="inscriptions", chapter="1", verse="1", source="inscriptions", witness=F.substring("book", 1, 1))


def piped(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines "sura|aya|text"."""
    rows = lines(spark, paths)
    m = lambda i: F.regexp_extract("value", r"^(\d+)\|(\d+)\|(.+)$", i)
    return _finish(rows.where(m(3) != "").select(F.concat(F.lit("Q"), F.lpad(m(1), 3, "0")).alias("book"), F.lit("1").alias("chapter"), m(2).alias("verse"), m(3).alias("text"), "place"), language="arb", collection="Quran", source="quran", witness="T")


def _files(spark: SparkSession, paths: str | list[str], parse: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    names = [x.rsplit(" ", 1)[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [{"place": i, "witness": None, "has_gap": False, "reference_author": None, "supplied_frac": 0.0} | r for i, r in enumerate(parse(path.rsplit("/", 1)[-1], content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, UNITS)


def parse_reports(name: str, content: bytes) -> Iterator[dict]:
    """Reports as JSON {hadiths: [{hadithnumber, reference: {book}, text}]}; a work
    of book 0 is kept as unassigned; tags are cut from the text."""
    for r in json.loads(content)["hadiths"]:
        number = (r.get("reference") or {}).get("book", 0)
        code = f"{'BUKH' if 'bukhari' in name.lower() else 'QUDS'}{int(number):02d}"
        text = re.sub(r"<[^>]+>", " ", r.get("text") or "").strip()
        if text:
            yield {"language": "arb", "collection": "Bukhari" if code.startswith("BUKH") else "Hadith Qudsi", "book": code, "book_title": f"Book {number}" if number else "Unassigned", "chapter": "1", "verse": f"{r['hadithnumber']:g}", "text": text, "source": "hadith"}


def morphology_codes(name: str, content: bytes) -> Iterator[dict]:
    """(book, chapter, verse, pos, morph) of the words of OSIS XML, without notes."""
    for _, e in ET.iterparse(io.BytesIO(content)):
        if e.tag.rsplit("}", 1)[-1] != "verse" or not e.get("osisID"):
            continue
        todo, pos = [e], 0
        while todo:
            node = todo.pop()
            kind = node.tag.rsplit("}", 1)[-1]
            if kind == "w":
                book, chapter, verse = (e.get("osisID").split(".") + ["1", "1"])[:3]
                yield {"book": book.upper(), "chapter": chapter, "verse": verse, "pos": pos, "morph": node.get("morph")}
                pos += 1
            elif kind != "note":
                todo += reversed(node)
        e.clear()


def morphology(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, chapter, verse, pos, morph) of OSIS files; see operators.morphology."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(morphology_codes(path, content)), columns=["book", "chapter", "verse", "pos", "morph"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "book string, chapter string, verse string, pos int, morph string")


def parse_osis(name: str, content: bytes) -> Iterator[dict]:
    """Verses of OSIS XML: words in order without those of notes, joined by a
    maqaf without a space."""
    for _, e in ET.iterparse(io.BytesIO(content)):
        tag = e.tag.rsplit("}", 1)[-1]
        if tag != "verse" or not e.get("osisID"):
            continue
        out: list[str] = []

        def walk(node: ET.Element) -> None:
            for child in node:
                kind = child.tag.rsplit("}", 1)[-1]
                if kind == "note":
                    continue
                if kind == "w":
                    out.append("".join(child.itertext()).replace("/", ""))
                elif kind == "seg" and "".join(child.itertext()).strip() == "־":
                    out.append("־")
                else:
                    walk(child)

        walk(e)
        text = re.sub(r"\s*־\s*", "־", " ".join(out)).strip()
        book, chapter, verse = (e.get("osisID").split(".") + ["1", "1"])[:3]
        if text:
            yield {"language": "hbo", "collection": "Tanakh", "book": book.upper(), "book_title": book, "chapter": chapter, "verse": verse, "text": text, "source": "oshb", "witness": "L"}
        e.clear()


def strip_markers(text: str) -> str:
    """What stands between the START and END lines of a distributed text."""
    start = re.search(r"\*\*\*\s*START OF.*?\*\*\*", text)
    end = re.search(r"\*\*\*\s*END OF", text)
    return text[start.end() if start else 0 : end.start() if end else len(text)]


HEADING = re.compile(r"^(chapter|book|part|volume|canto|letter|stave|section|act|scene)\b[\s.:]*[ivxlcdm\d]*\.?|^[ivxlcdm]+\.?$|^\d+\.?$", re.I)


def parse_prose(name: str, content: bytes, author: str | None = None, title: str | None = None) -> Iterator[dict]:
    """Blank-line paragraphs of a book; a heading begins a chapter if paragraphs
    came before it."""
    chapter, verse, code = 1, 0, re.sub(r"\W", "", name.rsplit(".", 1)[0]).upper()
    for block in re.split(r"\n\s*\n", strip_markers(content.decode("utf-8").replace("\r\n", "\n"))):
        raw = " ".join(re.sub(r"\[Illustration[^\]]*\]", "", block).split())
        if not raw:
            continue
        if len(raw) < 80 and HEADING.match(raw) or len(raw) < 60 and raw.isupper():
            if verse:
                chapter, verse = chapter + 1, 0
            continue
        verse += 1
        yield {"language": "eng", "collection": "English", "book": code, "book_title": title or code, "chapter": str(chapter), "verse": str(verse), "text": raw, "source": "english", "reference_author": author}


#: Papers of each certain author of the Federalist.
FEDERALIST = {"Jay": (2, 3, 4, 5, 64), "Madison": (10, 14, *range(37, 49)), "disputed": (*range(49, 59), 62, 63), "joint": (18, 19, 20)}


def parse_federalist(name: str, content: bytes) -> Iterator[dict]:
    """Papers headed "FEDERALIST No. n" as books; disputed and joint papers have no
    author."""
    by = {n: a for a, numbers in FEDERALIST.items() for n in numbers}
    parts = re.split(r"(?im)^\s*(?:the\s+)?federalist\.?\s+no\.?\s*(\d+)\.?\s*$", strip_markers(content.decode("utf-8").replace("\r\n", "\n")))
    seen = set()
    for number, body in zip(map(int, parts[1::2]), parts[2::2], strict=True):
        if number in seen:
            continue
        seen.add(number)
        author = by.get(number, "Hamilton")
        for i, block in enumerate((x for x in (" ".join(p.split()) for p in re.split(r"\n\s*\n", body)) if x and not x.isupper()), 1):
            yield {"language": "eng", "collection": "Federalist", "book": f"FED{number:02d}", "book_title": f"Federalist {number}", "chapter": "1", "verse": str(i), "text": block, "source": "english", "reference_author": None if author in ("disputed", "joint") else author}


def packed_sentences(text: str, target: int = 25, least: int = 10) -> list[str]:
    """Sentences packed up to ``target`` words; a last part below ``least`` joins
    the one before."""
    out: list[str] = []
    held: list[str] = []
    for s in re.split(r"(?<=[.;·!?])\s+", text.strip()):
        held.append(s)
        if sum(len(x.split()) for x in held) >= target:
            out.append(" ".join(held))
            held = []
    if held:
        rest = " ".join(held)
        if out and len(rest.split()) < least:
            out[-1] += " " + rest
        elif rest:
            out.append(rest)
    return out


def _kept_text(node: ET.Element, skip: set[str]) -> Iterator[str]:
    """The text of a node in order, without that inside skipped elements."""
    yield node.text or ""
    for child in node:
        if child.tag not in skip:
            yield from _kept_text(child, skip)
        yield child.tail or ""


def parse_tei(name: str, content: bytes) -> Iterator[dict]:
    """Leaf text parts of a TEI edition, packed to units of about 25 words."""
    root = ET.fromstring(content)
    ns = root.tag.rsplit("}", 1)[0] + "}" if "}" in root.tag else ""
    leaves = [d for d in root.iter(f"{ns}div") if not d.findall(f".//{ns}div")] or [root]
    code = re.sub(r"\W", "", name.split(".xml")[0]).upper()
    for i, d in enumerate(leaves, 1):
        for j, text in enumerate(packed_sentences(" ".join("".join(_kept_text(d, {f"{ns}{x}" for x in ("note", "bibl", "head", "teiHeader", "del")})).split())), 1):
            yield {"language": "grc", "collection": "First1K", "book": code, "book_title": code, "chapter": d.get("n") or str(i), "verse": str(j), "text": text, "source": "first1k"}


def parse_codex(name: str, content: bytes) -> Iterator[dict]:
    """Verses (ab elements) of a TEI transcription, as the first hand wrote them:
    of an app only the original reading, without notes, running titles and margins;
    the share of supplied words and gaps are told."""
    skip, book, chapter = {"note", "fw"}, "UNK", "0"
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def word(e: ET.Element) -> str:
        return e.get("norm") or re.sub(r"\s+", "", "".join(_kept_text(e, {c.tag for c in e.iter() if local(c) in skip})))

    def first_hand(e: ET.Element, supplied: bool) -> Iterator[tuple[str, str, bool]]:
        for c in e:
            kind = local(c)
            if kind in skip or kind == "seg" and c.get("type") == "margin" or kind == "rdg" and c.get("type") != "orig":
                continue
            if kind in ("w", "pc", "gap"):
                yield kind, word(c) if kind == "w" else (c.text or "").strip(), supplied
            else:
                yield from first_hand(c, supplied or kind == "supplied")

    for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        kind = local(e)
        if event == "start":
            if kind == "div" and e.get("type") == "book":
                book = (e.get("{http://www.w3.org/XML/1998/namespace}id") or "").rsplit("-", 1)[-1] or e.get("n") or "UNK"
            elif kind == "div" and e.get("type") == "chapter":
                chapter = e.get("n") or "0"
        elif kind == "ab":
            m = re.match(r"^V-B\d+K(\d+)V(\d+)-\d+-([A-Z0-9]+)$", e.get("{http://www.w3.org/XML/1998/namespace}id") or "")
            at, verse, code = m.groups() if m else (chapter, e.get("n") or "0", book)
            parts = list(first_hand(e, False))
            words = [x for x in parts if x[0] == "w" and x[1]]
            text = ""
            for k, t, _ in parts:
                text += (" " if k == "w" and text else "") + t if t else ""
            e.clear()
            if words and verse != "0":
                yield {"language": "grc", "collection": "Sinaiticus", "book": code, "book_title": code, "chapter": at, "verse": verse, "text": text, "source": "sinaiticus", "witness": "S", "has_gap": any(k == "gap" for k, _, _ in parts), "supplied_frac": sum(x[2] for x in words) / len(words)}


def html_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles or tags; common entities read."""
    out = html
    for tag in ("script", "style", "nav", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/h\d|/li|/tr)[^>]*>", "\n"), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[\n ]*", "\n"), r"^\s+|\s+$", "")


def json_reports(spark, paths):
    return _files(spark, paths, parse_reports)


def osis(spark, paths):
    return _files(spark, paths, parse_osis)


def prose(spark, paths):
    return _files(spark, paths, parse_prose)


def federalist(spark, paths):
    return _files(spark, paths, parse_federalist)


def codex(spark, paths):
    return _files(spark, paths, parse_codex)


def tei(spark, paths):
    return _files(spark, paths, parse_tei)


#: Readers in the order in which their units are put together.
READERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "codex-sinaiticus": ("codex-sinaiticus/sinaiticus_full_v*.xml", codex), "cntr": ("cntr/class1/*.txt", manuscripts), "vaticanus": ("vaticanus/swete/*.txt", token_lines), "first1kgreek": ("first1kgreek/*.xml", tei),
    "apostolic-fathers": ("apostolic-fathers/texts/*.txt", referenced_lines), "oshb": ("oshb/*.xml", osis), "inscriptions": ("inscriptions/*.txt", inscriptions),
    "quran": ("quran/*.txt", piped), "hadith": ("hadith/*.json", json_reports), "federalist": ("english/federalist*.txt", federalist), "english": ("english/pg*.txt", prose),
}


#: Sources of which each file is a version of the whole edition.
VERSIONED = {"codex-sinaiticus"}


def build_corpus(spark: SparkSession, raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units of primary witnesses, accounts of sources, choices of witnesses) of a
    folder of raw editions.  Every source is tried before one error lists those
    that failed; a source without files is missing."""
    found, accounts, failed = [], [], []
    for k, (name, (pattern, reader)) in enumerate(READERS.items()):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{raw}/{pattern}")
        present = sorted(str(f.getPath()) for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))
        if not present:
            accounts.append((name, "missing", 0))
            continue
        # of several versions of one edition the last by name is read
        paths = present[-1] if name in VERSIONED else f"{raw}/{pattern}"
        try:
            units = reader(spark, paths).withColumn("source_dir", F.lit(name)).withColumn("ordinal", F.lit(k))
            n = units.count()
            if not n:
                raise ValueError("a present source gave no text")
            found.append(units)
            accounts.append((name, "ok", n))
        except Exception as e:  # noqa: BLE001 - all sources are tried, then one error tells of all
            failed.append(f"{name}: {type(e).__name__}: {e}")
    if failed:
        raise ValueError("the corpus can't be built: " + "; ".join(failed))
    if not found:
        raise ValueError(f"no source found in {raw}")
    units = found[0]
    for u in found[1:]:
        units = units.unionByName(u)
    units = units.withColumn("text", nfc("text")).withColumn("witness", F.coalesce("witness", F.lit("?")))
    units = units.withColumn("n_tokens", count_words(script_words(F.col("text"), F.col("language"), any_script=True))).withColumn("book_title", F.coalesce("book_title", "book"))
    units = units.withColumn("seq", F.row_number().over(Window.partitionBy("source_dir").orderBy("witness", "book", "place")) + F.col("ordinal").cast("long") * (1 << 40))
    chosen = witness.choices(units)
    kept = witness.numbered(witness.primary(units, chosen), ["language", "collection", "book", "witness", "chapter", "verse"])
    table = spark.createDataFrame(accounts, "source_dir string, status string, parsed_units long")
    counts = kept.groupBy("source_dir").agg(F.count("*").alias("selected_units"))
    report = table.join(counts, "source_dir", "left").fillna(0, ["selected_units"]).withColumn("alternate_units", F.col("parsed_units") - F.col("selected_units"))
    return kept.drop("ordinal", "place"), report, chosen
