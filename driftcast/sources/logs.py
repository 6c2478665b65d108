"""Readers and sinks for logs, result rows, images and datagrams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the log files; a reader never guesses types.
SEND_LOG = "seq int, mode int, epoch int, holdMs int, sendStartMs double, sendEndMs double, unixMs double, bundle int, `order` string, msgDelay int"
DECODED = """frame int, timeMs double, boardIdx int, x int, y int, w int, h int, seq int, mode int, epoch int, consistent int, exact int,
isLocal int, isFriend int, allZero int, mismatches int, loop int, valid int"""
LOCAL_RUN = "send int, tStartMs double, tEndMs double, datagrams int, bytes int, firstChunk int"
RESULTS = """image string, codec string, cfg string, B int, crc int, cap int, N int, total int, ch string, policy string, `join` string,
seed int, t int, got int, psnr double, ssim double, msssim double, ssimc double, msssimc double"""


def csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of CSV files with a header; lines that begin with # are comments; an empty file gives no rows."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def run_parameters(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of the comment line '# key value key value' of each file."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit("#"))).select(F.input_file_name().alias("file"), "value")
    pairs = F.regexp_extract_all("value", F.lit(r"([A-Za-z]+) ([^ ]+)"), F.lit(0))
    return lines.select("file", F.explode(pairs).alias("p")).select("file", F.substring_index("p", " ", 1).alias("key"), F.substring_index("p", " ", -1).alias("value"))


def send_logs(spark: SparkSession, path: str) -> DataFrame:
    """Send logs, several joined with '+'; the wall clock is the common one."""
    return csv(spark, path.split("+"), SEND_LOG).withColumn("sendStartMs", F.col("unixMs"))


def json_rows(spark: SparkSession, path: str | list[str], schema: str = RESULTS) -> DataFrame:
    """JSON lines; an infinite gain is written as null."""
    return spark.read.schema(schema).json(path)


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files that hold an array of rows each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def infinite(gain: str = "gain"):
    return F.coalesce(F.col(gain), F.lit(float("inf")))


def append(df: DataFrame, path: str, form: str = "json") -> None:
    """Appends rows with the number of their batch, so that readers can let the last one win."""
    df.write.mode("append").format(form).save(path)


def cached(spark: SparkSession, folder: str, label: str, make: Callable[[str], DataFrame]) -> tuple[DataFrame, bool]:
    """The table of a label and whether it was made now: make(label) runs once, later calls read what it wrote.

    Spark's committer puts a marker into a folder that is written whole, so one that broke off is written again.
    """
    path = f"{folder.rstrip('/')}/{quote(label, safe='')}"
    made = False
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
        found = spark.read.parquet(path)
    except AnalysisException:
        made = True
        make(label).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found, made


def latest(df: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The rows of the last batch of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(batch)))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


#: What a cell writes as character references, so that it is one cell of one line and no null.
_REFERENCES = {"&": "&#38;", "|": "&#124;", "\n": "&#10;", "\r": "&#13;"}


def _cell(x: object) -> str:
    if x is None:
        return "-"
    text = "".join(_REFERENCES.get(c, c) for c in str(x))
    if text == "-":
        return "&#45;"
    inner = text.strip()
    blanks = lambda part: "".join(f"&#{ord(c)};" for c in part)
    lead = len(text) - len(text.lstrip())
    return blanks(text[:lead]) + inner + blanks(text[lead + len(inner):])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a table in Markdown; over limit rows it is an error.

    Null is -; bars, ampersands, line ends, blanks at the ends and a lone - are character references.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    line = lambda xs: "| " + " | ".join(map(_cell, xs)) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def write_text(text: str, path: str) -> None:
    """Puts a small text into one file in place of what was there: written beside it, then renamed, so readers see the old or the new one."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    mine = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as out:
        out.write(text.encode())
    fs.move(mine, name)


def replace_history(df: DataFrame, path: str, limit: int = 10) -> None:
    """A history of at most limit rows as one JSON file in place of the old one; more rows are an error."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"a history has {limit} rows at most")
    write_text("[" + ",\n".join(rows) + "]\n", path)


def markdown_rows(spark: SparkSession, path: str) -> DataFrame:
    """cells of each row of the tables in a report, without their heads: null for -, character references decoded."""
    lines = spark.read.text(path, wholetext=True).select(F.transform(F.split("value", "\r?\n"), lambda x: F.btrim(x)).alias("lines"))
    rule = lambda x: x.rlike(r"^\|( *:?-{3,}:? *\|)+$")
    body = F.filter("lines", lambda x, i: F.startswith(x, F.lit("|")) & ~rule(x) & ~F.coalesce(rule(F.get("lines", i + 1)), F.lit(False)))
    rows = lines.select(F.explode(body).alias("line"))
    parts = F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|")

    def decoded(cell):
        for c, reference in {"|": "&#124;", "\n": "&#10;", "\r": "&#13;", "-": "&#45;", " ": "&#32;", "\t": "&#9;", "&": "&#38;"}.items():  # the ampersand last
            cell = F.replace(cell, F.lit(reference), F.lit(c))
        return cell

    return rows.select(F.transform(parts, lambda c: F.when(F.btrim(c) != "-", decoded(F.btrim(c)))).alias("cells"))
