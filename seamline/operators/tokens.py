"""Go files as a table of tokens, for detectors that want them one by one.

The built-in detectors read the much smaller segment table; this one is for everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import golang as go
from seamline.operators.segments import FILE_KEY

_BLANK = rf"(?:[ \t\r\n]++|{go.LINE_COMMENT}|{go.BLOCK_COMMENT})*+"
_TOKEN = "|".join([go.IDENT, go.STRING, go.RAW_STRING, go.RUNE, go.NUMBER, go.OPERATOR, "."])
TOKEN = rf"(?s)(?!\z){_BLANK}(?:{_TOKEN}|\z)"


def tokens(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(module, version, dir, path, pos, tok, line) of every code token.

    ``line`` is where the token begins. Blanks and comments before a token travel with it through
    the running count of newlines and are then cut off. One exchange and one sort.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")) if partitions is None else partitions
    sources = files.filter((F.col("ext") == ".go") & go.well_encoded(F.col("content")))
    so_far = W.partitionBy(*FILE_KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        (sources.repartition(n, *FILE_KEY) if n else sources)
        .select("module", "version", "dir", "path",
                F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), 0)).alias("pos", "raw"))
        .withColumn("tok", F.regexp_replace("raw", rf"(?s)^{_BLANK}", ""))
        .withColumn("nl", go.newlines(F.col("raw")))
        .drop("raw")
        .withColumn("line", (F.sum("nl").over(so_far) - go.newlines(F.col("tok")) + 1).cast("int"))
        .drop("nl")
        .filter(F.col("tok") != ""))
