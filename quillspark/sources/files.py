"""Files as tables: texts, folders of markdown, JSON objects, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: folders of the working state, which a directory scan leaves out.
HIDDEN_FOLDERS = (".td", ".td_snapshots", ".git")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, whole; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def directory(spark: SparkSession, root: str, pattern: str = "*.md", hidden: tuple[str, ...] = HIDDEN_FOLDERS) -> DataFrame:
    """(path, text) of all files below ``root`` whose name fits ``pattern``, path counted from there; hidden folders are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    parts = F.split("path", "/")
    return rows.select(path.alias("path"), F.col("value").alias("text")).filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in hidden])))


def natural_key(path: Column) -> Column:
    """Sorts file names by the numbers in them: 2 before 10 (numbers of up to 20 digits)."""
    parts = F.regexp_extract_all(path, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON object (or list of them); anything else raises when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_rows(files: DataFrame, schema: str) -> DataFrame:
    """(file, line, row, bad) of (file, text): the whole text as one JSON object or list, else one object per line.

    Blank lines are passed over.  A line that is no object has a null row and is ``bad``; line is
    0 for a whole text.
    """
    whole = F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<struct<{schema_of(schema)}>>")), F.when(_is_object(F.col("text")), F.array(F.from_json("text", schema))))
    rows = files.select("file", "text", whole.alias("whole"))
    once = rows.filter("whole is not null").select("file", F.lit(0).cast("long").alias("line"), F.explode("whole").alias("row"), F.lit(False).alias("bad"))
    lines = rows.filter("whole is null").select("file", F.posexplode(F.split("text", "\r\n?|\n")).alias("line", "raw")).filter(F.trim("raw") != "")
    good = _is_object(F.col("raw"))
    apart = lines.select("file", (F.col("line") + 1).cast("long").alias("line"), F.when(good, F.from_json("raw", schema)).alias("row"), (~good).alias("bad"))
    return once.union(apart)


def schema_of(ddl: str) -> str:
    """``a int, b string`` as ``a:int,b:string``."""
    return ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(","))


def _json_tokens(text: Column) -> Column:
    """Strings, brackets outside strings, and what is between them."""
    return F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[^"\[\]{}]++|.'), F.lit(0))


def _closes_at(tokens: Column) -> Column:
    """How many tokens it takes until all brackets are closed, 0 if they never are."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    turn = lambda x: F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
    step = lambda s, x: F.struct((s["depth"] + turn(x)).alias("depth"), (s["n"] + 1).alias("n"), F.when((s["end"] == 0) & (s["depth"] + turn(x) == 0), s["n"] + 1).otherwise(s["end"]).alias("end"))
    return F.aggregate(tokens, zero, step, lambda s: s["end"])


def _is_object(text: Column) -> Column:
    """Whether a text is one whole JSON object; the parser alone would not mind what follows it."""
    own = F.trim(F.regexp_replace(text, r"\s+\z", ""))
    tokens = _json_tokens(own)
    return F.coalesce(F.when(own.startswith("{") & own.endswith("}"), F.try_parse_json(own).isNotNull() & (_closes_at(tokens) == F.size(tokens))), F.lit(False))


def salvaged_json(text: Column) -> Column:
    """The first whole JSON object or list in a text with prose or a code fence around it, as text; null if there is none.

    Brackets inside strings do not count.  What is cut off before its end is no answer.
    """
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    own = F.trim(F.when(fenced != "", fenced).otherwise(text))
    start = F.regexp_instr(own, F.lit(r"[\[{]"))
    tokens = _json_tokens(F.substring(own, start, F.length(own)))
    end = _closes_at(tokens)
    found = F.when((start > 0) & (end > 0), F.array_join(F.slice(tokens, 1, end), ""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def canonical_json(row: Column) -> Column:
    """A struct as JSON text for hashing: its fields must stand in the order wanted; nulls are left out."""
    return F.to_json(row)
