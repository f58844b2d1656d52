"""Files of many kinds: SQL texts, delimited text of unknown encoding, archives, workbooks, vector files, configurations, snapshots."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried, and separators.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
SEPARATORS = ";,|\t"


def _whole(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """Small files (configurations, SQL texts) as the driver needs them."""
    return [(r.path, bytes(r.content)) for r in spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").collect()]


def sql_text(spark: SparkSession, path: str) -> str:
    """The text of one SQL file without a byte order mark; an empty one raises."""
    text = _whole(spark, path)[0][1].decode("utf-8-sig").strip()
    if not text:
        raise ValueError(f"{path} is empty")
    return text


def sql_views(spark: SparkSession, tables: dict[str, DataFrame], queries: dict[str, str]) -> dict[str, DataFrame]:
    """The results of named SQL texts over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return {name: spark.sql(text) for name, text in queries.items()}


def sniffed(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of delimited text by its first bytes: the first encoding that reads them, and the separator most frequent in the first line."""
    cut = head[: head.rfind(b"\n") + 1] or head
    encoding = next(e for e in ENCODINGS if _reads(cut, e))
    line = cut.decode(encoding).split("\n", 1)[0]
    return encoding, max(SEPARATORS, key=line.count)


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def robust_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header as text columns, whatever its encoding and separator; names are trimmed, in upper case.

    The whole of each file decides its encoding, since a letter beyond ASCII may come late: tasks read the bytes and
    tell which of the encodings cannot be.
    """

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniffed(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"encoding": [e for e, _ in found], "sep": [s for _, s in found]})

    seen = spark.read.format("binaryFile").load(path).select("content").mapInArrow(tried, "encoding string, sep string").distinct().collect()  # at most encodings x separators rows
    if len({r.sep for r in seen}) != 1:
        raise ValueError(f"{path}: {len(seen)} kinds of files")
    encoding = max((r.encoding for r in seen), key=ENCODINGS.index)
    df = spark.read.csv(path, header=True, sep=seen[0].sep, encoding="UTF-8" if encoding.startswith("utf") else "ISO-8859-1", inferSchema=False)
    if encoding == "cp1252":
        # Spark reads no cp1252; it differs from ISO-8859-1 in these bytes alone.
        low = "".join(chr(b) for b in range(0x80, 0xA0) if _reads(bytes([b]), encoding))
        high = low.encode("latin-1").decode(encoding)
        df = df.select(*[F.translate(F.col(f"`{c}`"), low, high).alias(c.translate(str.maketrans(low, high))) for c in df.columns])
    return df.toDF(*[c.lstrip("\ufeff").strip().upper() for c in df.columns])


def archive_members(spark: SparkSession, path: str, wanted: str = "basico") -> DataFrame:
    """(archive, member, line, text): of each ZIP archive the lines of its CSV member whose name has ``wanted``, else of the first CSV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    csvs = sorted(m for m in z.namelist() if m.lower().endswith(".csv"))
                    if not csvs:
                        raise ValueError(f"{name}: no CSV member")
                    member = next((m for m in csvs if wanted in m.lower()), csvs[0])
                    data = z.read(member)
                text = data.decode(next(e for e in ENCODINGS if _reads(data, e))).splitlines()
                for low in range(0, len(text), 10_000):
                    part = text[low : low + 10_000]
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(part), "member": [member] * len(part), "line": pa.array(range(low, low + len(part)), pa.int64()), "text": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line long, text string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_rows(content: bytes, sheets: tuple[str, ...]) -> Iterator[tuple[str, int, dict[str, str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in tree("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").find("m:sheets", _NS):
            if sheets and sheet.get("name") not in sheets:
                continue
            for k, row in enumerate(tree(f"xl/{target[sheet.get(_REL)]}").iter(f"{{{_NS['m']}}}row")):
                cells = {}
                for c in row.findall("m:c", _NS):
                    kind, v = c.get("t"), c.findtext("m:v", None, _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else v
                    if text is not None:
                        cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if kind == "s" else text
                yield sheet.get("name"), k, cells


def workbook_rows(spark: SparkSession, path: str, sheets: tuple[str, ...] = ()) -> DataFrame:
    """(file, sheet, row, cells): the rows of the named sheets (all, if none is named) of workbooks, cells as text by column letter. A workbook must fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = list(_sheet_rows(content.as_py(), sheets))
                for low in range(0, len(held), 10_000):
                    part = held[low : low + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([p[0] for p in part]), pa.array([p[1] for p in part], pa.int64()), pa.array([list(p[2].items()) for p in part], pa.map_(pa.string(), pa.string()))], ["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, sheet string, row long, cells map<string,string>")


def sheet_table(rows: DataFrame, sheet: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A sheet whose first row is its header, names trimmed and in upper case, as a table of the wanted ``columns`` (all, if none is named); a wanted column that is missing is null."""
    here = rows.filter(F.col("sheet") == sheet)
    head = here.filter("row = 0").select("cells").first()
    if head is None:
        raise ValueError(f"no sheet {sheet}")
    place = {v.strip().upper(): k for k, v in head.cells.items()}
    at = lambda c: F.try_element_at("cells", F.lit(place[c])) if c in place else F.lit(None).cast("string")
    return here.filter("row > 0").select(*[at(c).alias(c) for c in (columns or tuple(place))])


def excluded_codes(spark: SparkSession, path: str, column: str = "COD_IBGE") -> DataFrame:
    """(municipality_code): the distinct codes of an exclusion list, a workbook's first sheet or delimited text, to seven digits; rows without digits go."""
    from ..functions.values import code_padded, digits

    if path.lower().endswith(".xlsx"):
        rows = workbook_rows(spark, path)
        df = sheet_table(rows, rows.select("sheet").first().sheet, (column,))
    else:
        df = robust_csv(spark, path)
    return df.select(F.col(column).cast("string").alias("c")).filter(digits(F.col("c")) != "").select(code_padded(F.col("c"), 7).alias("municipality_code")).distinct()


def geojson_features(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """(file, feature, properties map, kind, ring): features of GeoJSON collections, one row for each outer ring of a polygon or multipolygon, and one without a ring for others.

    A document of another type raises. With ``missing_ok`` a path without files gives an empty table. Numbers and texts
    of the properties become text. Each document must fit in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                document = json.loads(content.as_py().decode("utf-8-sig"))
                if not isinstance(document, dict) or document.get("type") != "FeatureCollection" or not isinstance(document.get("features"), list):
                    raise ValueError(f"{name}: no feature collection")
                rows = []
                for i, feature in enumerate(document["features"]):
                    g = feature.get("geometry") or {}
                    parts = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else [None]
                    said = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in (feature.get("properties") or {}).items() if v is not None]
                    rows += [(name, i, said, g.get("type"), [{"lon": p[0], "lat": p[1]} for p in part[0]] if part else None) for part in parts]
                for low in range(0, len(rows), 1000):
                    cols = list(zip(*rows[low : low + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(cols[0])), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.map_(pa.string(), pa.string())), pa.array(list(cols[3]), pa.string()), pa.array(list(cols[4]), kind)], ["file", "feature", "properties", "kind", "ring"])

    schema = "file string, feature long, properties map<string,string>, kind string, ring array<struct<lon:double,lat:double>>"
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(folder, created): folders under ``root`` that hold both a result workbook and a GeoJSON, the newest first. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "modificationTime")
    both = named.groupBy("folder").agg(F.count_if(F.col("file").rlike(r"^resultado_.*\.xlsx$")).alias("books"), F.count_if(F.col("file").rlike(r"\.geojson$")).alias("maps"), F.max("modificationTime").alias("created"))
    return both.filter("books > 0 and maps > 0").select("folder", "created").orderBy(F.desc("created"), "folder")


def rebalance_config(spark: SparkSession, path: str) -> dict:
    """A checked rebalancing configuration: its regions (name, areas, states, target), tolerances, passes and seed."""
    try:
        raw = json.loads(_whole(spark, path)[0][1].decode("utf-8-sig"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    return checked_config(raw)


def checked_config(raw: dict) -> dict:
    """Raises on missing or empty fields, values out of range, and a region, area or state that stands twice."""
    if not isinstance(raw, dict) or not isinstance(raw.get("regions"), list):
        raise ValueError("a list of regions is missing")
    regions, seen = [], {"region": set(), "area": set(), "state": set()}
    for i, r in enumerate(raw["regions"]):
        if not isinstance(r, dict):
            raise ValueError(f"region {i} is no object")
        texts = lambda c, r=r: [str(x).strip() for x in r.get(c, []) if str(x).strip()]
        one = {"name": str(r.get("name") or "").strip(), "areas": texts("areas"), "states": [s.upper() for s in texts("ufs")], "target": r.get("targetPoles")}
        whole = isinstance(one["target"], int) and not isinstance(one["target"], bool) and one["target"] > 0
        if not (one["name"] and one["areas"] and one["states"] and whole):
            raise ValueError(f"region {i} needs a name, areas, states and a positive whole target")
        for kind, values in (("region", [one["name"]]), ("area", one["areas"]), ("state", one["states"])):
            for x in values:
                if x in seen[kind]:
                    raise ValueError(f"{kind} {x} stands twice")
                seen[kind].add(x)
        regions.append(one)
    out = {"regions": regions, "tolerance": float(raw.get("balanceTolerancePct", 20)) / 100, "p90_increase": float(raw.get("maxP90IncreasePct", 10)) / 100, "passes": int(raw.get("maxAssignmentPasses", 10)), "seed": int(raw.get("seed", 20260813))}
    if not 0 <= out["tolerance"] < 1 or out["p90_increase"] < 0 or out["passes"] <= 0:
        raise ValueError("a tolerance outside 0 to 100, a negative increase, or no passes")
    return out


def region_maps(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(area, region), (state, region) and (region, target) of a configuration; each has at most some dozen rows."""
    areas = [(a, r["name"]) for r in config["regions"] for a in r["areas"]]
    states = [(s, r["name"]) for r in config["regions"] for s in r["states"]]
    return spark.createDataFrame(areas, "area string, region string"), spark.createDataFrame(states, "state string, region string"), spark.createDataFrame([(r["name"], r["target"]) for r in config["regions"]], "region string, target long")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshot(df: DataFrame, path: str) -> None:
    """Write a table beside ``path`` and put it in its place by renaming, so that readers see the old one or the new one, whole."""
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex[:12]}" for kind in ("new", "old"))
    df.write.parquet(fresh)
    jvm, at, fs = _filesystem(spark, path)
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    if fs.exists(at) and not fs.rename(at, place(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(place(fresh), at):
        raise OSError(f"{fresh} cannot be moved")
    fs.delete(place(old), True)


def created_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it stands already. The file system decides which of several writers is first."""
    _, at, fs = _filesystem(spark, path)
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def cached(load: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table that ``load`` gives, kept as a snapshot at ``path``, with ``stale`` false; if loading fails, the last snapshot with ``stale`` true; without one the error is raised."""
    try:
        df = load()
        snapshot(df, path)
        return df.sparkSession.read.parquet(path).withColumn("stale", F.lit(False))
    except PySparkException:
        spark = SparkSession.active()
        _, at, fs = _filesystem(spark, path)
        if not fs.exists(at):
            raise
        return spark.read.parquet(path).withColumn("stale", F.lit(True))
