"""Where a request's text comes from: parsing, precedence, host rules, and the readers for each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import PDF_BYTES, SAMPLED_PDF_BYTES
from tessella.functions import text as T
from tessella.operators import html as H

#: Enumerations and what anything else falls back to; hosts, file types and marks of a verification page.
DEPTHS, EXPORTS, LANGUAGES = ("quick", "deep", "map", "feynman", "book"), ("none", "md", "mm", "html", "all"), ("zh", "en", "auto")
HOSTS, HOST_SUFFIX = ("mp.weixin.qq.com", "weixin.qq.com"), ".weixin.qq.com"
TEXT_FILES, HTML_FILES = r"(?i)\.(txt|md|markdown|text|html|htm|csv|json|log)$", r"(?i)\.(html|htm)$"
ANTIBOT, ANTIBOT_CHARS = "环境异常|完成验证|去验证", 4000


def one_of(c: Column, values: tuple[str, ...], fallback: str) -> Column:
    return F.when(c.isin(*values), c).otherwise(F.lit(fallback))


def _string(raw: Column, path: str) -> Column:
    """A member of a JSON variant if it is a string, else null; '$.x' paths."""
    v = F.try_variant_get(raw, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(raw, path, "string"))


def _boolean(raw: Column, path: str) -> Column:
    v = F.try_variant_get(raw, path, "variant")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(raw, path, "boolean"))


def parse_requests(requests: DataFrame) -> DataFrame:
    """``raw`` JSON into typed fields; fields of another type are dropped, enumerations fall back, batch items that are no objects go."""
    x = requests.withColumn("__v", F.try_parse_json("raw"))
    v = F.col("__v")
    text = {k: _string(v, f"$.{k}").alias(k) for k in ("url", "path", "text", "focus")}
    item = lambda i: F.struct(*[_string(i, f"$.{k}").alias(k) for k in ("title", "url", "path", "text", "focus")])
    items = F.try_variant_get(v, "$.batch", "array<variant>")
    batch = F.transform(F.filter(items, lambda i: F.startswith(F.schema_of_variant(i), F.lit("OBJECT"))), item)
    return x.select(
        *[c for c in requests.columns if c != "raw"], *text.values(), one_of(_string(v, "$.depth"), DEPTHS, "deep").alias("depth"), one_of(_string(v, "$.export"), EXPORTS, "none").alias("export"),
        one_of(_string(v, "$.language"), LANGUAGES, "auto").alias("language"), _boolean(v, "$.refresh").alias("refresh"), _boolean(v, "$.estimate").alias("estimate"), batch.alias("batch"),
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1))


def allowed(url: Column) -> Column:
    return host(url).isin(*HOSTS) | F.endswith(host(url), F.lit(HOST_SUFFIX))


def route_source(requests: DataFrame) -> DataFrame:
    """Adds source_kind, source, error: a link before a path before pasted text; nothing is fetched here."""
    url, path = T.or_else(F.col("url")), T.or_else(F.col("path"))
    kind = F.when(url != "", "url").when((path != "") & F.lower(path).endswith(".pdf"), "pdf").when(path != "", "file").otherwise("text")
    source = F.when(url != "", url).when(path != "", path).otherwise(F.lit(T.PASTED))
    error = (
        F.when((url != "") & ~allowed(url), "host not allowed")
        .when((url == "") & (path != "") & ~F.lower(path).endswith(".pdf") & ~path.rlike(TEXT_FILES), "unsupported file type")
        .when((url == "") & (path == "") & (T.or_else(F.col("text")) == ""), "nothing to analyse")
    )
    return requests.withColumns({"source_kind": kind, "source": source, "error": error})


def antibot(text: Column) -> Column:
    """A verification page instead of the article: marked as such, and short."""
    return text.rlike(ANTIBOT) & (T.units(text) < ANTIBOT_CHARS)


def pasted(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"source": F.lit(T.PASTED), "source_kind": F.lit("text")})


def scan_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text, source_kind, error of whole text files; HTML is reduced to its text, other types get an error."""
    x = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    html = x["path"].rlike(HTML_FILES)
    ok = x["path"].rlike(TEXT_FILES)
    return x.select("path", F.when(html, H.body_text(F.col("text"))).when(ok, F.col("text")).alias("text"), F.lit("file").alias("source_kind"), F.when(~ok, F.lit("unsupported file type")).alias("error"))


def _files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")


def _apart(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, length, content) that are read, and (path, error) of those of more than PDF_BYTES, which are not."""
    return files.where(F.col("length") <= PDF_BYTES), files.where(F.col("length") > PDF_BYTES).select("path", F.lit("file too large").alias("error"))


def read_pdfs(files: DataFrame, stats_only: bool = False) -> DataFrame:
    """path, pages and text or page statistics, error of PDF files (path, length, content)."""
    from tessella.sources import pdf

    fit, large = _apart(files)
    return (pdf.stats(fit) if stats_only else pdf.texts(fit)).unionByName(large, allowMissingColumns=True)


def for_estimate(files: DataFrame) -> DataFrame:
    """path, pages and text, n_pages and sample statistics, error: files of more than SAMPLED_PDF_BYTES are only sampled, the others read whole."""
    from tessella.sources import pdf

    fit, large = _apart(files)
    return pdf.estimates(fit, F.col("length") > SAMPLED_PDF_BYTES).unionByName(large, allowMissingColumns=True)


def scan_pdfs(spark: SparkSession, *paths: str, stats_only: bool = False) -> DataFrame:
    return read_pdfs(_files(spark, paths), stats_only)


def scan_for_estimate(spark: SparkSession, *paths: str) -> DataFrame:
    return for_estimate(_files(spark, paths))


def with_title(title: Column, text: Column) -> Column:
    """The title before a text that does not contain it."""
    return F.when((title != "") & (F.instr(text, title) == 0), F.concat(title, F.lit("\n\n"), text)).otherwise(text)
