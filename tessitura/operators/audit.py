"""Audit: secret scan with lines, hashes, manifests, property changes."""

from __future__ import annotations

import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.expr import Col, col, nonempty

#: What the scan looks for; without look-around, so that Java and RE2 agree.
RULES = {
    "OAUTH_TOKEN": r"\b(?:y[01]_|gh[pousr]_|github_pat_)[A-Za-z0-9_-]{24,}",
    "PRIVATE_KEY": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "JWT": r"\beyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}",
    "CREDENTIAL": r"""(?i)(?:access_token|refresh_token|device_code|user_code|password|cookie|authorization)["']?\s*[:=]\s*["'][^"'\r\n]{4,}["']""",
    "SIGNED_AUDIO": r"""https?://[^\s"<>]+(?:/get-mp3/|/get-opus/|[?&](?:sign|signature|token|expires)=)[^\s"<>]+""",
}
PRIVATE_PARTS = r"(^|/)(\.venv|\.runtime|\.aws|node_modules|\.env[^/]*)(/|$)"
PRIVATE_SUFFIX = r"\.(db|sqlite|sqlite3|log|pem|key|bundle)$"


def secret_lines(docs: DataFrame, rules: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, category, line``: a row per finding in the whole content, with the line it begins in, from one.

    A finding may reach over lines. Texts with a NUL are BINARY, line 0; a null text is empty. One pass over the
    texts: each rule's findings come in order, so line feeds are counted once per rule. Rules are regular
    expressions without look-around, over ASCII classes.
    """
    patterns = {name: re.compile(rule, re.ASCII) for name, rule in (rules or RULES).items()}
    field = pa.field("category", pa.string())

    def findings(body: str) -> Iterator[tuple[str, int]]:
        if "\0" in body:
            yield "BINARY", 0
            return
        for name, pattern in patterns.items():
            line, last = 1, 0
            for hit in pattern.finditer(body):
                line, last = line + body.count("\n", last, hit.start()), hit.start()
                yield name, line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, lines = [], [], []
            for row, body in enumerate(batch.column(1)):
                for name, line in findings(body.as_py() or ""):
                    rows.append(row), names.append(name), lines.append(line)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, field.type), pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "category", "line"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, category string, line int")


#: Kinds of objects in a version store.
KINDS = ("blob", "tree", "commit", "tag")
#: What stands for a commit's path, and the suffixes of images.
METADATA = "(commit metadata)"
IMAGES = r"\.(png|jpg|jpeg|webp)$"


def loose_objects(files: DataFrame) -> DataFrame:
    """``object, kind, size, content`` of a version store's loose objects, from files (path, content) as ``binaryFile`` reads them.

    An object's id is the two last parts of its path; its file is compressed and begins with kind and size. What is no
    such file, or is damaged, is no object. Packed objects are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    head, _, body = zlib.decompress(data.as_py() or b"").partition(b"\0")
                    kind, size = head.decode("ascii").split(" ")
                except (ValueError, zlib.error):
                    continue
                if kind in KINDS and size == str(len(body)):
                    for column, value in zip(out, ("".join(path.as_py().rsplit("/", 2)[-2:]), kind, len(body), body), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["object", "kind", "size", "content"])

    return files.select("path", "content").where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38}$")).mapInArrow(run, "object string, kind string, size long, content binary")


def object_findings(objects: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """:func:`secret_lines` of objects (object, kind, name, content): blobs that are no images, and commits."""
    scanned = objects.where((F.col("kind") == "commit") | ((F.col("kind") == "blob") & ~is_image("name")))
    return secret_lines(scanned.select("object", F.make_valid_utf8(F.col("content").cast("string")).alias("text")), rules, "object", "text")


def object_label(name: Col) -> Column:
    """The path of a blob, or what stands for one in the metadata of a commit."""
    return nonempty(name, METADATA)


def is_image(name: Col) -> Column:
    return F.lower(F.coalesce(col(name), F.lit(""))).rlike(IMAGES)


def audit_counts(objects: DataFrame, findings: DataFrame) -> DataFrame:
    """``kind, scanned, images, findings``: counters of objects (object, kind, name) and of findings (object)."""
    by_object = findings.groupBy("object").agg(F.count(F.lit(1)).alias("n"))
    rows = objects.join(by_object, "object", "left")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("scanned"), F.count_if((F.col("kind") == "blob") & is_image("name")).alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def is_private_path(path: Column) -> Column:
    return path.rlike(PRIVATE_PARTS) | F.lower(path).rlike(PRIVATE_SUFFIX)


def payload_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` of files (path, content) as ``binaryFile`` reads them."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """Manifest lines ``sha256  path``, one per distinct path."""
    return files.select(F.concat_ws("  ", F.sha2(F.col(content).cast("binary"), 256), F.col(path)).alias("line")).distinct()


def write_snapshot(lines: DataFrame, path: str, column: str = "line") -> None:
    """Sorted distinct lines as text; the order runs over files by name."""
    lines.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: ADDED, REMOVED or CHANGED between manifests (path, sha256)."""
    a, b = old.select("path", F.col("sha256").alias("a")), new.select("path", F.col("sha256").alias("b"))
    both = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED").alias("change"))


def missing_required(entries: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths that a manifest or listing lacks."""
    return required.select("path").distinct().join(entries.select("path"), "path", "left_anti")


def distinct_files(files: DataFrame) -> DataFrame:
    """Each path once, sorted."""
    return files.select("path").distinct().orderBy("path")


def archive_listing(archives: DataFrame) -> DataFrame:
    """``archive, entry, size`` of the files in tar (plain or compressed) and zip archives (path, content) as ``binaryFile`` reads them.

    What is no archive, or null, has no entries; one that is cut off or damaged has those before the damage.
    """

    def entries(content: bytes) -> list[tuple[str, int]]:
        found: list[tuple[str, int]] = []
        try:
            if zipfile.is_zipfile(io.BytesIO(content)):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found += ((i.filename, i.file_size) for i in z.infolist() if not i.is_dir())
            else:
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    found += ((m.name, m.size) for m in t if m.isfile())
        except (OSError, EOFError, ValueError, NotImplementedError, zlib.error, lzma.LZMAError, tarfile.TarError, zipfile.BadZipFile):
            pass
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = entries(batch.column(1)[i].as_py() or b"")
                columns = [[batch.column(0)[i].as_py()] * len(found), [n for n, _ in found], [n for _, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["archive", "entry", "size"])

    return archives.select("path", "content").mapInArrow(run, "archive string, entry string, size long")


def is_frozen(changed: DataFrame, untracked: DataFrame) -> bool:
    """Whether a tree has neither changed nor untracked paths."""
    return changed.select("path").union(untracked.select("path")).isEmpty()


def property_changes(old: DataFrame, new: DataFrame, quiet: tuple[str, ...] = ("position",)) -> DataFrame:
    """Properties (object, name, value) of ``new`` that differ from ``old``; properties that only ``old`` has and quiet ones are not given."""
    before = old.select("object", "name", F.col("value").alias("__old"))
    return new.where(~F.col("name").isin(*quiet)).join(before, ["object", "name"], "left").where(~F.col("value").eqNullSafe(F.col("__old"))).select("object", "name", "value")
