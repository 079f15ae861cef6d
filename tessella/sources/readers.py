"""Readers of semi-structured sources, as expressions over a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_state(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document or array of a file; broken records give nulls."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


#: Steps from HTML to Markdown as SQL has them, in order; ``markup.markdown`` gives the same in one pass.
MARKDOWN = [
    *((f"(?is)<{t}(\\s[^>]*)?>.*?</{t}>", " ") for t in ("head", "script", "style", "nav", "footer", "header", "aside")),
    ("(?is)<pre(\\s[^>]*)?>\\s*<code(\\s[^>]*)?>(.*?)</code>\\s*</pre>", "\n\n```\n$3\n```\n\n"), ("(?is)<code(\\s[^>]*)?>(.*?)</code>", "`$2`"),
    ("(?is)<(strong|b)(\\s[^>]*)?>(.*?)</(strong|b)>", "**$3**"), ("(?is)<(em|i)(\\s[^>]*)?>(.*?)</(em|i)>", "_$3_"), ('(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    *((f"(?is)<h{n}(\\s[^>]*)?>(.*?)</h{n}>", "\n\n" + "#" * n + " $2\n\n") for n in range(1, 7)), ("(?is)<li(\\s[^>]*)?>(.*?)</li>", "\n- $2\n"), ("(?i)</(p|div|tr|ul|ol|table)>|<br\\s*/?>", "\n\n"), ("<[^>]+>", ""),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
BLANKS = [("[ \\t]+", " "), (" ?\\n ?", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")]


def table_of_contents(df: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """Entries with the last heading above them as ``parent``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col(kind) == "heading", F.col(text)), ignorenulls=True).over(w)
    return df.withColumn("parent", heading).where(F.col(kind) != "heading")


def watch(spark: SparkSession, folder: str, schema: str, form: str = "json") -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).format(form).load(folder)
