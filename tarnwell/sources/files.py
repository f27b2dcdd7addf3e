"""Files: what there is, reading it whatever its format, one table from many files, and writing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.ids import slugify  # noqa: F401
from ..functions.unicode import nfkc

#: Extensions and their formats.
FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "feather": "feather", "arrow": "feather", "xlsx": "xlsx"}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else "csv"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, slug, bytes, modified of the data files under root, by Hadoop's listing; contents stay unread. The
    slug is the first folder under root, or the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    inner = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').split(':', 1)[-1].lstrip('/'))}/", "")
    first = F.regexp_replace(F.element_at(F.split(inner, "/"), 1), r"\.[A-Za-z0-9]+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(first), "[^a-z0-9]+", "-"), "^-|-$", "")
    return files.where(ext.isin(*FORMATS)).select("path", ext.alias("kind"), slug.alias("slug"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def slugs(spark: SparkSession, root: str) -> list[str]:
    return [r.slug for r in catalog(spark, root).select("slug").distinct().orderBy("slug").collect()]


#: Formats that a dataset is made of; plain text is listed but isn't read as one.
DATASET_KINDS = frozenset(FORMATS) - {"txt"}


def discover(spark: SparkSession, root: str, slug: str) -> list[str]:
    """The files of a dataset under root, in order."""
    rows = catalog(spark, root).where((F.col("slug") == slug) & F.col("kind").isin(*sorted(DATASET_KINDS)))
    return [r.path for r in rows.select("path").orderBy("path").collect()]


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    return bool(first) and first[0].v.startswith("[")


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table of a file or folder by its extension; an unknown one is read as CSV. JSON may be lines or one array."""
    kind = fmt or FORMATS.get(extension(path), "csv")
    kind = FORMATS.get(kind, kind)
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind == "json":
        return spark.read.options(multiLine=_is_array(spark, path), **options).json(path)
    if kind in WHOLE_FILES:
        return _read_whole(spark, [path], kind).drop("_source_uri")
    return spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(path)


#: Formats that a task reads a whole file at a time.
WHOLE_FILES = ("feather", "xlsx")


def _tables(content: bytes, kind: str):
    """Record batches of one file."""
    import pyarrow as pa

    if kind == "feather":
        import pyarrow.feather as feather

        return feather.read_table(pa.BufferReader(content)).to_batches(max_chunksize=10_000)
    rows = sheet(content)
    names = [n or f"column_{i}" for i, n in enumerate(rows[0])] if rows else []
    columns = [pa.array([r[i] if i < len(r) else None for r in rows[1:]], pa.string()) for i in range(len(names))]
    return pa.table(columns, names=names).to_batches(max_chunksize=10_000) if names else []


def sheet(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text, row by row; dates are the numbers that the file has."""
    import io
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        root = ElementTree.fromstring(book.read(first))
    out: list[list[str | None]] = []
    for row in (e for e in root.iter() if local(e) == "row"):
        cells: list[str | None] = []
        for c in (e for e in row if local(e) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = len(cells)
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            cells += [None] * (at + 1 - len(cells))
            value = next((e.text for e in c if local(e) == "v"), None)
            kind = c.get("t", "n")
            cells[at] = shared[int(value)] if kind == "s" and value is not None else text(c) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(value) if kind == "b" else value
        out.append(cells)
    return out


def _read_whole(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Files of one format through the executors, each read whole by a task, with _source_uri; columns by name, of the
    types that a first pass over the files' heads finds in all of them, or else text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def head(batches):
        for batch in batches:
            for content in batch.column("content"):
                made = list(_tables(content.as_py(), kind))
                yield pa.record_batch([pa.array([made[0].schema.serialize().to_pybytes() if made else b""], pa.binary())], names=["schema"])

    found = [pa.ipc.read_schema(pa.BufferReader(bytes(r.schema))) for r in files.mapInArrow(head, "schema binary").distinct().collect() if r.schema]
    fields: dict[str, StructField] = {}
    for schema in found:
        for f in from_arrow_schema(schema.remove_metadata()):
            old = fields.get(f.name)
            fields[f.name] = f if old is None or old.dataType == f.dataType else StructField(f.name, StringType())
    shape = StructType([*fields.values(), StructField("_source_uri", StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(shape)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for part in _tables(content.as_py(), kind):
                    own = {n: part.column(n) for n in part.schema.names}
                    columns = [own[f.name].cast(f.type) if f.name in own else pa.nulls(part.num_rows, f.type) for f in want if f.name != "_source_uri"]
                    yield pa.record_batch([*columns, pa.array([path.as_py()] * part.num_rows, pa.string())], schema=want)

    return files.mapInArrow(run, shape)


def read_union(spark: SparkSession, paths: list[str], failed: list | None = None, **options) -> DataFrame:
    """All files as one table: columns by name, missing ones null, and _source_uri. Files of one format and one set of
    columns are read together, CSV as text, which bronze() gives its types. A column of several types is text. Files
    that can't be read are left out, and (path, error) of each goes to failed."""
    failed = [] if failed is None else failed
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        kind = FORMATS.get(extension(path), "csv")
        try:
            if kind == "parquet":
                key = (kind, spark.read.options(**options).parquet(path).schema.json())
            elif kind == "csv":
                key = (kind, *spark.read.options(**{"header": True, **options}).csv(path).columns)
            elif kind == "json":
                key = (kind, _is_array(spark, path))
            else:
                key = (kind,)
            groups.setdefault(key, []).append(path)
        except Exception as e:
            failed.append((path, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
    frames = []
    for (kind, *rest), some in groups.items():
        try:
            if kind in WHOLE_FILES:
                df = _read_whole(spark, some, kind)
            else:
                reader = spark.read.options(**options)
                df = reader.parquet(*some) if kind == "parquet" else reader.options(multiLine=rest[0]).json(some) if kind == "json" else reader.options(**{"header": True, **options}).csv(some)
                df = df.select("*", F.col("_metadata.file_path").alias("_source_uri"))
            if len(df.columns) > 1:
                frames.append(df)
        except Exception as e:
            failed += [(path, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}") for path in some]
    if not frames:
        raise ValueError(f"no readable files: {failed}")
    kinds: dict[str, set] = {}
    for df in frames:
        for c, k in df.dtypes:
            kinds.setdefault(c, set()).add(k)
    text = {c for c, k in kinds.items() if len(k) > 1}
    nested = lambda k: k.startswith(("struct", "array", "map"))
    as_text = lambda c, k: F.to_json(F.col(f"`{c}`")) if nested(k) else F.col(f"`{c}`").cast("string")
    frames = [df.select(*[as_text(c, k).alias(c) if c in text else F.col(f"`{c}`") for c, k in df.dtypes]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample(spark: SparkSession, paths: list[str], rows: int, **options) -> DataFrame:
    """The first rows of the files, in the files' order; as many files as that takes are read."""
    return read_union(spark, paths, **options).limit(rows)


def write_any(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Parquet, JSON lines, CSV with a header, or Arrow files, as a folder of parts."""
    kind = FORMATS.get(fmt or extension(path), "csv")
    writer = df.write.mode("overwrite")
    if kind == "feather":
        _write_feather(df, path)
    else:
        {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", True).csv}[kind](path)


def _write_feather(df: DataFrame, path: str) -> None:
    """A file a task, written by the executors through pyarrow's file systems: the folder must be one that they share."""
    import uuid

    from .storage import Storage

    Storage(df.sparkSession).delete(path)
    mark = uuid.uuid4().hex[:8]

    def run(batches):
        import pyarrow as pa
        import pyarrow.feather as feather
        from pyarrow import fs
        from pyspark import TaskContext

        held = list(batches)
        if held:
            system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}-{mark}.feather") as out:
                feather.write_feather(pa.Table.from_batches(held), out)
        yield pa.record_batch([pa.array([sum(b.num_rows for b in held)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n long").count()


#: Parts of names that hint at dates; the share of values that a date and a number take; the years of dates.
DATE_NAMES, DATE_SHARE, NUMBER_SHARE, YEARS = ("date", "time", "timestamp", "dt", "ts"), 0.60, 0.80, (1970, 2100)


def bronze(df: DataFrame) -> DataFrame:
    """Types by content, from one aggregate over all text columns: dates where the name hints at them and most values are
    of one kind (a date in text, or an epoch in ms or s, of a plausible year); numbers where four in five rows are, unless
    zeros in front say that they are codes; nested columns as JSON text, NaN as null, anything else as it is."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = [c for c, k in kinds.items() if k == "string" and c != "_source_uri"]

    def number(c: str):
        tidy = F.trim(F.regexp_replace(nfkc(F.col(f"`{c}`")), r"\s+", " "))
        return V.number(F.translate(F.regexp_replace(tidy, r"(?<=\d)[,_](?=\d{3}\b)", ""), "\u2212", "-"))

    def dates(c: str) -> list:
        x = F.col(f"`{c}`")
        whole = V.number(F.trim(x))
        ways = [V.parse_robust(F.when(whole.isNull(), x)), V.epoch(whole, "ms"), V.epoch(whole, "s")]
        return [F.when(F.year(w).between(*YEARS), w) for w in ways]

    hinted = [c for c in texts if any(n in c.lower() for n in DATE_NAMES)]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(texts):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count(number(c)).alias(f"x{i}"), F.count(F.when(F.trim(F.col(f"`{c}`")).rlike(r"^0\d+$"), 1)).alias(f"z{i}")]
        aggs += [F.count(w).alias(f"d{i}_{k}") for k, w in enumerate(dates(c))] if c in hinted else []
    row = df.agg(*aggs).first() if texts else None
    made = {}
    for i, c in enumerate(texts):
        if c in hinted and row[f"n{i}"]:
            best = max(range(3), key=lambda k: (row[f"d{i}_{k}"], -k))
            if row[f"d{i}_{best}"] and row[f"d{i}_{best}"] / row[f"n{i}"] >= DATE_SHARE:
                made[c] = dates(c)[best]
                continue
        if row["rows"] and not row[f"z{i}"] and row[f"x{i}"] / row["rows"] >= NUMBER_SHARE:
            made[c] = number(c)
    out = []
    for c, kind in kinds.items():
        x = F.col(f"`{c}`")
        if c in made:
            x = made[c]
        elif kind.startswith(("struct", "array", "map")):
            x = F.to_json(x)
        elif kind in ("double", "float"):
            x = F.when(~F.isnan(x), x)
        out.append(x.alias(c))
    return df.select(*out)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as one column a field, named parent.child; deeper ones and others stay."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{k.name}`").alias(f"{f.name}.{k.name}") for k in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def without_zones(df: DataFrame) -> DataFrame:
    """Timestamps with a time zone as those of UTC without one."""
    zoned = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
    zone = F.current_timezone()
    return df.withColumns({c: F.convert_timezone(zone, F.lit("UTC"), F.col(f"`{c}`").cast("timestamp_ntz")) for c in zoned})


def append_log(spark: SparkSession, path: str, records: list[dict]) -> None:
    """One JSON line a record, behind what is there."""
    import json

    rows = [(json.dumps(r, sort_keys=True),) for r in records]
    if rows:
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


def schema_report(df: DataFrame) -> DataFrame:
    """name, dtype, missing_pct of each column."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return df.sparkSession.createDataFrame([(c, k, row[f"m{i}"]) for i, (c, k) in enumerate(df.dtypes)], "name string, dtype string, missing_pct double")
