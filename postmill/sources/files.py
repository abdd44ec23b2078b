"""Files: name lists, configuration, Markdown tables, back-ups, résumés; and the parts of parsing that need Python."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import POSTING


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """``name``: the normal forms of the lines, without comments and blanks; a missing file is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "name string")
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    return lines.select(text.normalize_text(F.col("value")).alias("name")).where("name <> ''").distinct()


def commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True)
    return reader.csv(path, header=True, **({"schema": schema} if schema else {}))


def config_rows(spark: SparkSession, sections: dict[str, list[dict]], keys: tuple[str, ...] = ("token", "tenant", "site")) -> DataFrame:
    """Boards of a configuration that was read on the driver: ``source`` and its fields, the first of equal keys."""
    rows, seen = [], set()
    for source, boards in sections.items():
        for board in boards:
            mark = (source, *(board.get(k) for k in keys))
            if mark not in seen:
                seen.add(mark)
                rows.append((source, *(board.get(k) for k in keys), board.get("name"), json.dumps(board)))
    return spark.createDataFrame(rows, ", ".join(["source string", *(f"{k} string" for k in keys), "name string", "data string"]))


def markdown_table(rows: DataFrame, body: str) -> DataFrame:
    """``line, cells, url`` of each table row of a text, without header and separator rows; the first link of any cell."""
    lines = rows.select(F.posexplode(F.split(body, r"\r?\n")).alias("line", "raw")).where("trim(raw) like '|%'")
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    found = lines.select("line", cells.alias("cells"), F.nullif(F.regexp_extract("raw", r"(https?://[^\s)|]+)", 1), F.lit("")).alias("url"))
    rule = F.forall("cells", lambda c: F.regexp_like(c, F.lit(r"^:?-+:?$")))
    return found.where(~rule & (F.lower(F.get("cells", F.lit(0))) != "date"))


def export_backup(postings: DataFrame, path: str, backend: str, model: str) -> None:
    """Compressed JSON lines of postings with vectors, and a one-row manifest beside them."""
    size = F.max(F.size("embedding"))
    head = postings.agg(F.count("*").alias("count"), F.coalesce(size, F.lit(0)).alias("dim")).select(F.lit(backend).alias("backend"), F.lit(model).alias("model"), "dim", "count")
    head.write.mode("overwrite").json(f"{path}/manifest")
    postings.write.mode("overwrite").json(f"{path}/rows", compression="gzip")


def import_backup(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Postings of a back-up; one whose vectors have another size than ``dim`` is refused."""
    manifest = spark.read.json(f"{path}/manifest").first()
    if dim is not None and manifest.dim not in (0, dim):
        raise ValueError(f"the back-up's vectors have {manifest.dim} numbers, not {dim}")
    return spark.read.schema(POSTING).json(f"{path}/rows")


def ranked_csv(rows: DataFrame, order: list, path: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True)


#: The field of a vendor's section that lists its boards.
BOARD_FIELDS = {"greenhouse": "companies", "lever": "companies", "ashby": "companies", "rippling": "companies", "workable": "accounts"}


def discovered_yaml(boards: DataFrame, path: str) -> None:
    """Writes discovered ``ats, slug`` as a configuration, a section a vendor; a registry of boards, so the driver holds it. JSON is YAML."""
    found = boards.where(F.col("ats").isin(list(BOARD_FIELDS))).groupBy("ats").agg(F.sort_array(F.collect_set("slug")).alias("slugs")).orderBy("ats").collect()
    sections = {r.ats: {BOARD_FIELDS[r.ats]: [{"token": s, "type": "for_profit"} for s in r.slugs]} for r in found}
    with open(path, "w", encoding="utf-8") as out:
        out.write("# Written by discovery; safe to delete.\n" + json.dumps({"sources": sections}, indent=1) + "\n")


def read_config(path: str) -> dict:
    """A configuration file: JSON, with comment lines, or YAML where its library is installed."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        return json.loads("\n".join(line for line in body.split("\n") if not line.lstrip().startswith("#")))
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is not JSON, and no YAML library is installed") from e
        return yaml.safe_load(body) or {}


def missing_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*rows.columns)


def copy_table(rows: DataFrame, keys: list[str], url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Appends over JDBC the rows whose keys a table lacks."""
    existing = rows.sparkSession.read.jdbc(url, table, properties=properties or {})
    missing_rows(rows, existing, keys).write.jdbc(url, table, mode="append", properties=properties or {})


@F.pandas_udf(T.StringType())
def decode_entities(raw: pd.Series) -> pd.Series:
    """All character references of HTML, for texts beyond ``functions.text.unescape``."""
    return raw.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def fix_mojibake(raw: pd.Series) -> pd.Series:
    """Undoes UTF-8 that was read as Windows-1252 or Latin-1, as often as it makes text shorter and valid."""

    def fix(x: str | None) -> str | None:
        while x and re.search("[ÂÃâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]", x):
            for codec in ("cp1252", "latin-1"):
                try:
                    better = x.encode(codec).decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                break
            else:
                return x
            x = better
        return x

    return raw.map(fix)


@F.pandas_udf(T.StringType())
def flatten_json(raw: pd.Series) -> pd.Series:
    """Keys and leaves of JSON, a line each."""

    def lines(x: object, out: list[str]) -> list[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                out.append(str(k))
                lines(v, out)
        elif isinstance(x, list):
            for v in x:
                lines(v, out)
        elif x is not None:
            out.append(str(x))
        return out

    def flat(x: str | None) -> str | None:
        try:
            return "\n".join(lines(json.loads(x), [])) if x else None
        except ValueError:
            return None

    return raw.map(flat)


@F.pandas_udf(T.StringType())
def resume_text(path: pd.Series, content: pd.Series) -> pd.Series:
    """Text of résumé files by their extension: txt, md, json and docx; null for others and for broken ones."""

    def read(name: str, data: bytes | None) -> str | None:
        if data is None:
            return None
        kind = name.rpartition(".")[2].lower()
        try:
            if kind in ("txt", "md"):
                return data.decode("utf-8", "replace")
            if kind == "json":
                return flatten_json.func(pd.Series([data.decode("utf-8", "replace")]))[0]
            if kind == "docx":
                tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
                w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
                return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return None

    return pd.Series([read(p, c) for p, c in zip(path, content)])


def resumes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", resume_text("path", "content").alias("text"))


HEADINGS = ["summary", "objective", "profile", "experience", "work experience", "professional experience", "employment", "education", "skills", "technical skills", "projects", "certifications", "publications", "awards", "achievements", "languages", "interests", "volunteering", "references"]


def resume_sections(rows: DataFrame, body: str) -> DataFrame:
    """Adds ``sections``: heading and content, in order; text before the first heading is "Additional information"."""
    lines = F.split(F.coalesce(F.col(body), F.lit("")), r"\r?\n")
    is_heading = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[:#*_]+", " "))).isin(HEADINGS)
    rows = rows.withColumn("_lines", F.concat(F.array(F.lit("Additional information")), lines))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | is_heading(F.get("_lines", i)))
    rows = rows.withColumn("_starts", starts)
    part = F.transform("_starts", lambda s, k: F.struct(F.trim(F.regexp_replace(F.get("_lines", s), r"[:#*_]+", " ")).alias("heading"), F.trim(F.array_join(F.slice("_lines", s + 2, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s - 1), "\n"), F.lit(" \n")).alias("content")))
    return rows.withColumn("sections", F.filter(part, lambda x: x["content"] != "")).drop("_lines", "_starts")
