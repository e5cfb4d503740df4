"""Scans and sinks with declared schemas: JSON lines, directories of JSON, whole texts, CSV, manifests; incremental ingest by checksum."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict``: the first malformed line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of lines that are no JSON. Only a writer's last, cut-off line is expected here; blank lines are none."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return rows.where("trim(line) <> '' AND try_parse_json(line) IS NULL")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """As ``write_jsonl`` under ``path``, but readers (``read_replaced``) always find whole rows, the old or the new: each call writes a folder of its own and then puts the file ``current``, which names
    it, in place by one rename. The folder before the last is deleted."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at("current").toUri(), conf)
    name = f"rows-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{name}")
    old = current_rows(df.sparkSession, path)
    fs = at("current").getFileSystem(conf)
    out = fs.create(at(f"_{name}"), True)
    out.write(bytearray(f"{name} {old or ''}".encode()))
    out.close()
    replace = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at(f"_{name}"), at("current"), replace)
    for s in fs.listStatus(at("")):
        n = s.getPath().getName()
        if n.startswith("rows-") and n not in (name, old):
            fs.delete(s.getPath(), True)


def current_rows(spark: SparkSession, path: str) -> str | None:
    """The folder that ``replace_jsonl`` put in place last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(f"{path}/current").first()[0].split(" ")[0]


def read_replaced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, f"{path}/{current_rows(spark, path)}", schema)


def with_image_paths(df: DataFrame, folder: str, column: str = "image_path") -> DataFrame:
    """Relative image paths resolved against the folder of the rows; absolute ones, URLs and nulls stay."""
    p = F.col(column)
    return df.withColumn(column, F.when(p.rlike("^(/|[a-z][a-z0-9+.-]*:)"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-line ledgers, one file each a task; a cut-off last line is left out, any other malformed line is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    rows = files.select("file", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line")).where("trim(line) <> ''")
    bad = F.expr("try_parse_json(line) IS NULL")
    # A writer that was cut off leaves no line end, so that its line is the last of the split.
    rows = rows.where(~(bad & (F.col("i") == F.col("n") - 1)))
    return rows.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file_name, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled as spreadsheets expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def file_topics(texts: DataFrame, ranges: list[tuple[int, int, str]]) -> DataFrame:
    """``read_texts`` with ``number``, ``title`` and ``topic``: a file is named 012_title.txt, and ranges of numbers have topics; null outside them."""
    n = F.nullif(F.regexp_extract("file_name", r"^(\d+)", 1), F.lit("")).cast("int")
    topic = F.coalesce(*[F.when(n.between(a, b), F.lit(t)) for a, b, t in ranges], F.lit(None).cast("string"))
    return texts.select("*", n.alias("number"), F.regexp_replace(F.regexp_replace("file_name", r"^\d+[_ -]*", ""), r"\.txt$", "").alias("title"), topic.alias("topic"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, bytes, sha256, text`` of the files in zip archives and tar.gz archives, one archive a task; ``text`` is null where it is no UTF-8."""
    ddl = "archive string, member string, bytes bigint, sha256 string, text string"

    def run(batches):
        import hashlib
        import io
        import tarfile
        import zipfile

        import pandas as pd

        def row(archive, name, body):
            try:
                text = body.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            return archive, name, len(body), hashlib.sha256(body).hexdigest(), text

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
                        for name, body in members:
                            yield pd.DataFrame([row(archive, name, body)], columns=["archive", "member", "bytes", "sha256", "text"])
                else:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                        for m in t:
                            if m.isfile():
                                yield pd.DataFrame([row(archive, m.name, t.extractfile(m).read())], columns=["archive", "member", "bytes", "sha256", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


def manifest_faults(members: DataFrame, listed: DataFrame) -> DataFrame:
    """Members that a manifest (``member, bytes, sha256``) does not list as they are, and listed ones that are missing: ``member, fault``."""
    want = listed.select("member", F.col("bytes").alias("__b"), F.col("sha256").alias("__h"))
    x = members.select("member", "bytes", "sha256").join(want, "member", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("__h").isNull(), "unlisted").when((F.col("bytes") != F.col("__b")) | (F.col("sha256") != F.col("__h")), "changed")
    return x.select("member", fault.alias("fault")).where("fault IS NOT NULL")


#: What articles in XML are made of: sections, their headings, the elements that are passages, and headings of sections without prose (fixed values).
SECTION, HEADING, PASSAGES = "sec", "title", ("p", "list", "table-wrap")
NO_PROSE = "references|review questions|disclosure|continuing education"


class Passages:
    """Table function of one XML article: a row for each passage that is a direct part of a section. The article is read as a stream of tags; a section's place in it is a stack."""

    def eval(self, text: str, section: str, heading: str, passages: list, no_prose: str, least: int):
        import re
        import xml.etree.ElementTree as ET

        parser = ET.XMLPullParser(("start", "end"))
        parser.feed(text)
        parser.close()
        path, sections, found, titles = [], [], [], {}
        for event, node in parser.read_events():
            inside = bool(sections) and len(path) == sections[-1]["depth"]
            if event == "start":
                if inside:
                    sections[-1]["parts"] += 1
                if node.tag == section and "body" in path:
                    sections.append({"depth": len(path) + 1, "parts": -1, "id": node.get("id"), "name": "", "rows": []})
                path.append(node.tag)
                continue
            path.pop()
            inside = bool(sections) and len(path) == sections[-1]["depth"]
            if node.tag == heading:
                words = "".join(node.itertext())
                if inside and not sections[-1]["name"]:
                    sections[-1]["name"] = words
                kind = "own" if path[-2:] == ["book-part-meta", "title-group"] else "any"
                if node.text:
                    titles.setdefault(kind, node.text)
            if inside and node.tag in passages:
                body = " ".join(" ".join(node.itertext()).split())
                if len(body) >= least:
                    sections[-1]["rows"].append((sections[-1]["parts"], body))
            if node.tag == section and sections and sections[-1]["depth"] == len(path) + 1:
                done = sections.pop()
                if not re.search(no_prose, done["name"], re.IGNORECASE):
                    found += [(done["id"] or done["name"], place, done["name"], body) for place, body in done["rows"]]
        title = titles.get("own") or titles.get("any")
        for at, place, name, body in found:
            yield at, place, title, name, body


def xml_passages(members: DataFrame, least: int = 80, section: str = SECTION, heading: str = HEADING, passages: tuple[str, ...] = PASSAGES, no_prose: str = NO_PROSE) -> DataFrame:
    """``member, section, place, title, text``: the passages of the sections of XML articles (``member, text``), white space collapsed, ``place`` counted among the section's parts.

    Sections whose heading matches ``no_prose`` are left out (those inside them are judged by their own), as are passages under ``least`` code points. ``title`` is the article's and the section's.
    """
    read = F.udtf(Passages, returnType="section string, place int, article string, heading string, text string")
    args = [F.col("t").outer(), *[F.lit(x) for x in (section, heading)], F.array(*[F.lit(x) for x in passages]), F.lit(no_prose), F.lit(least)]
    x = members.where("text IS NOT NULL").select("member", F.col("text").alias("t")).lateralJoin(read(*args))
    return x.select("member", "section", "place", F.concat(F.coalesce("article", "member"), F.lit(" -- "), "heading").alias("title"), "text")


def xml_rows(texts: Column, tag: str, schema: str) -> Column:
    """The elements of one name in an XML text, each as a struct of ``schema`` (attributes begin with _): for catalogues that come whole, such as members of archives.
    Catalogues in files of their own are read by ``spark.read.format("xml")`` with this name as ``rowTag``."""
    return F.transform(F.regexp_extract_all(texts, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0)), lambda x: F.from_xml(x, schema, {"mode": "FAILFAST"}))


def topic_catalogue(members: DataFrame, language: str, tag: str = "health-topic") -> DataFrame:
    """``member, id, title, url, summary, groups`` of a catalogue's topics in one language; ``groups`` are ``id, name`` of all groups that a topic is in."""
    group = "array<struct<_VALUE:string,_id:string>>"
    schema = f"`_id` string, `_title` string, `_url` string, `_language` string, `full-summary` string, `group` {group}"
    x = members.where("text IS NOT NULL").select("member", F.explode(xml_rows(F.col("text"), tag, schema)).alias("t")).where(F.col("t._language") == language)
    groups = F.transform(F.coalesce(F.col("t.group"), F.array().cast(group)), lambda g: F.struct(g["_id"].alias("id"), g["_VALUE"].alias("name")))
    return x.select("member", F.col("t._id").alias("id"), F.col("t._title").alias("title"), F.col("t._url").alias("url"), F.col("t.full-summary").alias("summary"), groups.alias("groups"))


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow files and streams, one file a task, batch by batch. Only the columns of ``schema`` are taken."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                file = pa.ipc.open_file(data) if data.slice(0, 6).to_pybytes() == b"ARROW1" else pa.ipc.open_stream(data)
                parts = (file.get_batch(i) for i in range(file.num_record_batches)) if hasattr(file, "get_batch") else iter(file)
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in want], schema=want)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def image_facts(content: Column) -> Column:
    """``bytes, sha256, kind, width, height`` of an image from its first bytes; kind is null for anything but PNG, JPEG and GIF, sizes are those of PNG and GIF headers."""
    head = F.hex(F.substring(content, 1, 24))
    kind = F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg").when(F.startswith(head, F.lit("474946383")), "gif")

    def number(digits: Column) -> Column:
        return F.conv(digits, 16, 10).cast("int")

    def gif(at: int) -> Column:  # little-endian
        return number(F.concat(F.substring(head, at + 2, 2), F.substring(head, at, 2)))

    return F.struct(
        F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"), kind.alias("kind"),
        F.when(kind == "png", number(F.substring(head, 33, 8))).when(kind == "gif", gif(13)).alias("width"),
        F.when(kind == "png", number(F.substring(head, 41, 8))).when(kind == "gif", gif(17)).alias("height"),
    )


def embedded_images(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``image`` (see ``image_facts``) and ``image_path`` in place of an embedded image (``struct<bytes, path>``)."""
    facts = F.when(F.col(f"{column}.bytes").isNotNull(), image_facts(F.col(f"{column}.bytes")))
    return rows.select(*[c for c in rows.columns if c not in (column, "image", "image_path")], facts.alias("image"), F.col(f"{column}.path").alias("image_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def new_files(found: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a manifest: files that the ledger lacks, and files whose checksum has changed since (these must not be ingested again)."""
    old = ledger.select(F.col("path"), F.col("sha256").alias("__old"))
    both = found.join(old, "path", "left")
    return both.where("__old IS NULL").drop("__old"), both.where("__old <> sha256").drop("__old")


def html_to_text(html):
    """Text nodes joined by blanks, scripts, styles and comments dropped, entities of the five basic characters decoded, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def page_text(html, most: int = 2000):
    """A page's text: scripts and styles out, lines stripped and cut at double blanks, empty ones dropped, cut to ``most`` with three dots."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    parts = F.flatten(F.transform(F.split(x, "\n"), lambda line: F.split(F.trim(line), "  ")))
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " ")
    return F.when(F.length(joined) > most, F.concat(F.substr(joined, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(joined)


def markdown_table(df: DataFrame) -> DataFrame:
    """One column ``line``: each row as a line of a Markdown table, bars escaped; nulls are empty. The header is ``markdown_header(df)``."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
