"""DOCX packages as relations.

A package is read as one binary row; tasks unzip it and walk its parts, and everything after that is
relational: nodes in document order with their parents, from which paragraphs, fields, bookmarks,
objects and counts are queries. Only this scan is Python.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.operators import ordered
from docloom.sources.stored import bound_batches

NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "urn:schemas-microsoft-com:office:office": "o",
    "urn:schemas-microsoft-com:vml": "v",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
}
WORD_PARTS = r"^word/.*\.xml$"
#: Of these elements a node knows the nearest one that it stands in, or is, by its node number.
AROUND = {"w:p": "p", "w:r": "r", "w:tbl": "tbl", "w:tr": "tr", "w:tc": "tc", "w:style": "style", "w:sectPr": "sect", "w:pPr": "ppr", "w:rPr": "rpr", "w:lvl": "lvl", "w:abstractNum": "abstract"}
#: top: the child of the part's first body that a node stands in, or is.
NODES = "doc_id string, part string, node int, parent int, depth int, tag string, attrs map<string,string>, text string, sha256 string" + "".join(f", {c} int" for c in (*AROUND.values(), "top"))
#: What stands in a paragraph's text for elements that are no text.
BREAKS = {"w:tab": b"\t", "w:br": b"\n", "w:cr": b"\n"}
OBJECTS = "doc_id string, kind string, name string, sha256 string"
#: Bytes of a part that are parsed at once; bytes of a part up to which it is parsed once, its nodes held until it has turned out to be sound.
CHUNK, SMALL_PART = 1 << 16, 1 << 20
#: Nodes of an Arrow batch, and about as many characters of them; with CHUNK these bound a worker's memory, whatever a package's size.
NODE_ROWS, NODE_CHARS = 4000, 2 << 20


def packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content, for files that are named .docx."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def opened(content: bytes | None) -> zipfile.ZipFile | str:
    """A package, or what is wrong with it."""
    if not content:
        return "empty"
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return "not_a_zip"
    return package if "word/document.xml" in package.NameToInfo else "no_main_part"


def fault_of(content: bytes | None) -> str | None:
    found = opened(content)
    return found if isinstance(found, str) else None


def part_of(package: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """The root of a part; None where it is damaged, encrypted or no XML."""
    try:
        return ElementTree.fromstring(package.read(name))
    except DAMAGE:
        return None


#: What a damaged, encrypted or otherwise unreadable part raises.
DAMAGE = (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, LookupError, ValueError)


class _Nothing:
    """A parser's target that keeps nothing."""

    def close(self):
        return None


def _parsed_into(package: zipfile.ZipFile, name: str, target):
    """Feeds a part to a parser piece by piece, and gives the target back after each piece; raises one of DAMAGE."""
    parser = ElementTree.XMLParser(target=target)
    with package.open(name) as raw:
        while piece := raw.read(CHUNK):
            parser.feed(piece)
            yield target
    parser.close()
    yield target


def is_sound(package: zipfile.ZipFile, name: str) -> bool:
    """Whether a part can be read to its end; nothing of it is held."""
    try:
        for _ in _parsed_into(package, name, _Nothing()):
            pass
    except DAMAGE:
        return False
    return True


def part_faults(content: bytes) -> list[str]:
    """Faults of a package that opens: one for each part below word/ that cannot be read."""
    package = zipfile.ZipFile(io.BytesIO(content))
    return [f"bad_part:{name}" for name in sorted(package.namelist()) if re.match(WORD_PARTS, name) and not is_sound(package, name)]


def _each(batch: pa.RecordBatch):
    """The packages of a batch, one at a time."""
    docs, contents = batch.column("doc_id"), batch.column("content")
    for i in range(batch.num_rows):
        yield docs[i].as_py(), contents[i].as_py()


def faults(files: DataFrame) -> DataFrame:
    """doc_id, fault of the packages, and of the parts of packages, that cannot be read; the other scans leave these out."""

    def run(batches):
        for batch in batches:
            found = []
            for doc, content in _each(batch):
                whole = fault_of(content)
                found += [(doc, f) for f in ([whole] if whole else part_faults(content))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["doc_id", "fault"])

    return files.mapInArrow(run, "doc_id string, fault string")


def short_name(name: str) -> str:
    space, _, local = name[1:].partition("}") if name.startswith("{") else ("", "", name)
    return f"{NAMESPACES[space]}:{local}" if space in NAMESPACES else local


def walk(root: ElementTree.Element):
    """(node, parent, depth, element) in document order."""
    for n, parent, depth, element, _ in walk_around(root):
        yield n, parent, depth, element


def walk_around(root: ElementTree.Element):
    """(node, parent, depth, element, the nodes of AROUND that it stands in and its top) in document order. The cell of an outer table is
    not that of a table within."""
    stack, n, body = [(root, -1, 0, (None,) * (len(AROUND) + 1))], 0, None
    places = {tag: i for i, tag in enumerate(AROUND)}
    while stack:
        element, parent, depth, around = stack.pop()
        if parent == body:
            around = (*around[:-1], n)
        if (i := places.get(name := short_name(element.tag))) is not None:
            around = around[:i] + (n,) + around[i + 1 :]
        if body is None and name == "w:body":
            body = n
        yield n, parent, depth, element, around
        stack += [(child, n, depth + 1, around) for child in reversed(element)]
        n += 1


class _Rows:
    """A parser's target: nodes as rows of NODES, in document order, each as soon as its text is whole. Only what is open is held, and the rows of a
    formula until it ends, since its hash stands in its own row. ``hashed``: rows end with the hash of a paragraph's text, and those of paragraphs come
    when these end."""

    def __init__(self, doc: str, part: str, hashed: bool = False):
        self.doc, self.part, self.n, self.chars = doc, part, 0, 0
        self.hashed, self.body = hashed, None
        #: Of each open paragraph the hash of its text so far, where hashes are wanted.
        self.paragraphs: list = []
        self.rows: list[list] = []
        #: Of each open element its row, the pieces of its text (None once the row is told), and what it stands in.
        self.open: list[list] = []
        self.formulas: list[tuple[ElementTree.TreeBuilder, list]] = []
        self.names: dict[str, str] = {}

    def _name(self, name: str) -> str:
        if name not in self.names:
            self.names[name] = short_name(name)
        return self.names[name]

    def _tell(self, top: list) -> None:
        if top[1] is not None:
            text = "".join(top[1])
            top[0][7] = text or None
            self.chars += len(text)
            if self.paragraphs and top[0][5] == "w:t":
                self.paragraphs[-1].update(text.encode())
            if not (self.hashed and top[0][5] == "w:p"):
                self.rows.append(top[0])
            top[1] = None

    def start(self, tag: str, attrs: dict) -> None:
        parent, depth, around = -1, 0, (None,) * (len(AROUND) + 1)
        if self.open:
            top = self.open[-1]
            self._tell(top)
            parent, depth, around = top[0][2], top[0][4] + 1, top[2]
        name = self._name(tag)
        if parent == self.body:
            around = (*around[:-1], self.n)
        if (i := _PLACES.get(name)) is not None:
            around = around[:i] + (self.n,) + around[i + 1 :]
        if self.body is None and name == "w:body":
            self.body = self.n
        row = [self.doc, self.part, self.n, parent, depth, name, [(self._name(k), v) for k, v in attrs.items()], None, None, *around]
        if self.hashed:
            row.append(None)
            if name == "w:p":
                self.paragraphs.append(hashlib.sha256())
            elif self.paragraphs and name in BREAKS:
                self.paragraphs[-1].update(BREAKS[name])
        self.open.append([row, [], around])
        self.n += 1
        if name == "m:oMath":
            self.formulas.append((ElementTree.TreeBuilder(), row))
        for builder, _ in self.formulas:
            builder.start(tag, attrs)

    def data(self, text: str) -> None:
        if self.open[-1][1] is not None:
            self.open[-1][1].append(text)
        for builder, _ in self.formulas:
            builder.data(text)

    def end(self, tag: str) -> None:
        top = self.open.pop()
        self._tell(top)
        if self.hashed and top[0][5] == "w:p":
            top[0][-1] = self.paragraphs.pop().digest()
            self.rows.append(top[0])
        for builder, _ in self.formulas:
            builder.end(tag)
        if self.formulas and self.formulas[-1][1] is top[0]:
            whole = self.formulas.pop()[0].close()
            top[0][8] = hashlib.sha256(ElementTree.canonicalize(ElementTree.tostring(whole, encoding="unicode")).encode()).hexdigest()

    def close(self):
        return None

    def taken(self) -> tuple[list[list], int]:
        """The rows that are ready, and their characters."""
        if self.formulas:
            return [], 0
        found, self.rows, self.chars = (self.rows, self.chars), [], 0
        return found


_PLACES = {tag: i for i, tag in enumerate(AROUND)}


def _part_rows(package: zipfile.ZipFile, doc: str, part: str, hashed: bool = False):
    """Pieces (rows, characters) of the nodes of a part; none of a part that cannot be read to its end."""
    if package.getinfo(part).file_size <= SMALL_PART:
        try:
            for target in _parsed_into(package, part, _Rows(doc, part, hashed)):
                pass
        except DAMAGE:
            return
        yield target.taken()
    elif is_sound(package, part):
        for target in _parsed_into(package, part, _Rows(doc, part, hashed)):
            yield target.taken()


NODE_SCHEMA = pa.schema(
    [("doc_id", pa.string()), ("part", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("sha256", pa.string())]
    + [(c, pa.int32()) for c in (*AROUND.values(), "top")]
)


def nodes(files: DataFrame, parts: str = WORD_PARTS, hashed: bool = False) -> DataFrame:
    """The nodes of the parts whose names match; others are not parsed, parts that cannot be read are left out. sha256 stands for formulas only.
    ``hashed``: with text_sha256, the bytes of the hash of a paragraph's text, so that this text need not move to be compared.

    Parts are parsed as streams: a worker holds what is open of one part, and one batch of nodes, which small packages share."""
    wanted = re.compile(parts)
    schema = NODE_SCHEMA.append(pa.field("text_sha256", pa.binary())) if hashed else NODE_SCHEMA
    bound_batches(files.sparkSession)

    def found(batches):
        for batch in batches:
            for doc, content in _each(batch):
                if not isinstance(package := opened(content), str):
                    for part in sorted(x for x in package.namelist() if wanted.match(x)):
                        yield from _part_rows(package, doc, part, hashed)

    def arrow(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held, chars = [], 0
        for rows, more in found(batches):
            held += rows
            chars += more
            if len(held) >= NODE_ROWS or chars >= NODE_CHARS:
                for i in range(0, len(held), NODE_ROWS):
                    yield arrow(held[i : i + NODE_ROWS])
                held, chars = [], 0
        if held:
            yield arrow(held)

    return files.mapInArrow(run, NODES + ", text_sha256 binary" * hashed)


def _parsed(df: DataFrame) -> DataFrame:
    return df if "tag" in df.columns else nodes(df)


def objects(files: DataFrame) -> DataFrame:
    """Media and embedded files of each package, with their hashes."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in _each(batch):
                if not fault_of(content):
                    package = zipfile.ZipFile(io.BytesIO(content))
                    for name in sorted(package.namelist()):
                        for kind in ("media", "embeddings"):
                            if name.startswith(f"word/{kind}/"):
                                rows.append((doc, kind, name, hashlib.sha256(package.read(name)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["doc_id", "kind", "name", "sha256"])

    return files.mapInArrow(run, OBJECTS)


#: Kind of token that an element gives; those of a field character come from its type.
KIND = {"w:t": "text", "w:delText": "text", "w:tab": "tab", "w:br": "break", "w:cr": "break", "w:instrText": "instr"}
PARAGRAPHS = "doc_id string, part string, pos int, style string, tokens array<struct<kind:string,text:string>>"


def tokens_of(paragraph: ElementTree.Element) -> list[tuple[str, str | None]]:
    """What stands in a paragraph, in order; the text of a simple field is its result and has a kind of its own."""
    out = []

    def visit(element: ElementTree.Element, simple: bool) -> None:
        tag = short_name(element.tag)
        if tag == "w:fldChar":
            out.append((next((v for k, v in element.attrib.items() if short_name(k) == "w:fldCharType"), ""), None))
        elif tag in KIND:
            out.append(("simple_text" if simple and KIND[tag] == "text" else KIND[tag], element.text or ""))
        for child in element:
            visit(child, simple or tag == "w:fldSimple")

    visit(paragraph, False)
    return out


def paragraph_tokens(files: DataFrame, parts: str = K.CONTENT_PART) -> DataFrame:
    """A row for each paragraph of the parts whose names match, those in text boxes within others too."""
    wanted = re.compile(parts)
    schema = pa.schema([("doc_id", pa.string()), ("part", pa.string()), ("pos", pa.int32()), ("style", pa.string()), ("tokens", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))])

    def run(batches):
        for batch in batches:
            for doc, content in _each(batch):
                if fault_of(content):
                    continue
                package, rows = zipfile.ZipFile(io.BytesIO(content)), []
                for part in sorted(x for x in package.namelist() if wanted.match(x)):
                    if (root := part_of(package, part)) is None:
                        continue
                    found = [e for *_, e in walk(root) if short_name(e.tag) == "w:p"]
                    for pos, p in enumerate(found):
                        styles = [v for q in p for e in q for k, v in e.attrib.items() if short_name(q.tag) == "w:pPr" and short_name(e.tag) == "w:pStyle" and short_name(k) == "w:val"]
                        tokens = [{"kind": k, "text": t} for k, t in tokens_of(p)]
                        rows.append((doc, part, pos, styles[0] if styles else None, tokens))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, PARAGRAPHS)


def paragraphs(files: DataFrame) -> DataFrame:
    """doc_id, part, pos, style, text: authored text, without the results of fields."""
    return paragraph_tokens(files).withColumn("text", ordered.text_outside_results(F.col("tokens"))).drop("tokens")


def fields(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, part, instruction of every field, simple and complex; ``parsed``: what nodes() gave, if it is at hand."""
    simple = (nodes(files) if parsed is None else parsed).where("tag = 'w:fldSimple'").select("doc_id", "part", F.trim(F.col("attrs")["w:instr"]).alias("instruction")).where("instruction <> ''")
    in_paragraphs = paragraph_tokens(files, r"^word/.*\.xml$").withColumn("instruction", F.explode(ordered.field_instructions(F.col("tokens"))))
    return simple.unionByName(in_paragraphs.select("doc_id", "part", "instruction"))


def bookmarks(files: DataFrame) -> DataFrame:
    """Of packages, or of their nodes."""
    return _parsed(files).where("tag = 'w:bookmarkStart'").select("doc_id", F.col("attrs")["w:name"].alias("name")).distinct()


def counts(files: DataFrame) -> DataFrame:
    """Elements of each kind that a document holds, and whether it has notes and comments."""
    tag, has = F.col("tag"), lambda part: F.max((F.col("part") == part).cast("int"))
    return _parsed(files).groupBy("doc_id").agg(
        F.count_if(tag.isin("w:fldChar", "w:fldSimple")).alias("fields"), F.count_if(F.rlike(tag, F.lit("(^|:)oMath$"))).alias("equations"),
        F.count_if(tag == "w:drawing").alias("drawings"), F.count_if(tag == "w:txbxContent").alias("text_boxes"),
        has("word/footnotes.xml").alias("footnotes"), has("word/endnotes.xml").alias("endnotes"), has("word/comments.xml").alias("comments"),
    )


def formulas(files: DataFrame) -> DataFrame:
    return _parsed(files).where("sha256 is not null").select("doc_id", F.lit("omml").alias("kind"), "part", "sha256")
