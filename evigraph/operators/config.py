"""Configuration checks over rows: env files, endpoints, model and registry responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions import vector as V

# Names that hold secrets, and permissions that allow writing.
SECRET_NAMES = "(?i)KEY|TOKEN|SECRET|PASSWORD"
WRITE_PERMISSIONS = ("write", "read-write")
MAX_ERROR = 400

_ENTRY = r"^\s*(?:export\s+)?([\w.-]+)\s*=\s*(.*?)\s*$"
_QUOTED = r"""^(?:"([^"]*)"|'([^']*)'|`([^`]*)`)"""


def env_entries(lines: DataFrame) -> DataFrame:
    """Adds key and value to lines of env files; comments and lines without a name go.

    Quotes (of three kinds) are taken off; without them the value ends at a # and white space around it goes.
    """
    raw = F.regexp_extract("line", _ENTRY, 2)
    quoted = F.concat(*[F.regexp_extract(raw, _QUOTED, k) for k in (1, 2, 3)])
    value = F.when(raw.rlike(_QUOTED), quoted).otherwise(F.regexp_replace(raw, r"\s*#.*$", ""))
    return lines.withColumn("key", F.regexp_extract("line", _ENTRY, 1)).withColumn("value", value).where("key <> ''")


def env_secrets(entries: DataFrame) -> DataFrame:
    """The entries whose name tells of a secret and whose value isn't empty."""
    return entries.where(F.col("key").rlike(SECRET_NAMES) & (F.col("value") != ""))


def required(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds value and error to names (key): an entry that is missing or empty is an error."""
    found = entries.groupBy("key").agg(F.max("value").alias("value"))
    return names.join(found, "key", "left").withColumn("error", F.when(F.coalesce("value", F.lit("")) == "", F.concat(F.lit("Missing "), "key")))


def endpoint(url: Column, suffix: str = "") -> Column:
    """struct(url, error): an https address without user info, query or fragment, its path ending in the suffix."""
    error = (
        F.when(~url.rlike(r"^(?i)https://[^/?#]"), "not_https").when(url.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "credentials").when(url.rlike(r"\?[^#]"), "query").when(url.rlike(r"#."), "fragment")
    )
    head, path = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    full = F.when(path.endswith(suffix), path).otherwise(F.concat(F.regexp_replace(path, "/$", ""), F.lit(suffix))) if suffix else path
    return F.struct(F.when(error.isNull(), F.concat(head, full)).alias("url"), error.alias("error"))


def response_error(status: Column, body: Column, secrets: Column | None = None) -> Column:
    """Why a response can't be used, or null: not JSON, or another status than 2xx with what its body says, redacted and cut."""
    prefix = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "))
    said = F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message"), F.get_json_object(body, "$.code"), F.lit("Request failed"))
    said = T.redact(said, secrets) if secrets is not None else said
    return F.when(F.try_parse_json(body).isNull(), F.concat(prefix, F.lit("non-JSON response"))).when(~status.between(200, 299), F.concat(prefix, F.substring(said, 1, MAX_ERROR)))


def json_object_error(content: Column, constants: dict[str, str]) -> Column:
    """Why a model's answer isn't the JSON object with exactly these values (as JSON text), or null."""
    keys = F.json_object_keys(content)
    wrong = F.lit(False)
    for key, value in constants.items():
        wrong = wrong | ~F.to_json(F.variant_get(F.try_parse_json(content), f"$.{key}", "variant")).eqNullSafe(F.lit(value))
    return (
        F.when(content.isNull() | (content == ""), "empty").when(F.try_parse_json(content).isNull(), "not_json").when(keys.isNull(), "not_an_object")
        .when(F.size(keys) != len(constants), "key_count").when(wrong, "values")
    )


def embedding_batches(rows: DataFrame, count: int) -> DataFrame:
    """(batch, dimensions, problem) of batches (batch, index, v): as many rows as inputs, indices from 0 without a gap, equal dimensions, finite and not all zero."""
    size = F.size("v")
    sums = rows.groupBy("batch").agg(
        F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.countDistinct("index").alias("distinct"), F.min(size).alias("dimensions"), F.max(size).alias("most"),
        F.every(V.finite("v")).alias("finite"), F.every(V.nonzero("v")).alias("nonzero"),
    )
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct") != F.col("n"))
    problem = F.when(F.col("n") != count, "count").when(gap, "indices").when((F.col("dimensions") < 1) | (F.col("dimensions") != F.col("most")), "dimensions").when(~F.col("finite"), "not_finite").when(~F.col("nonzero"), "zero")
    return sums.select("batch", F.col("dimensions").cast("long").alias("dimensions"), problem.alias("problem"))


def identity(body: Column) -> Column:
    """The user name of a registry's answer; null if it isn't a string."""
    name = F.variant_get(F.try_parse_json(body), "$.username", "variant")
    return F.when(F.schema_of_variant(name) == "STRING", F.get_json_object(body, "$.username"))


def permission_counts(rows: DataFrame, package: str) -> DataFrame:
    """(user, visible, writable, permission) from (user, package, permission); a package that isn't there is not-listed."""
    of = F.max(F.when(F.col("package") == package, F.col("permission")))
    return rows.groupBy("user").agg(F.count("*").alias("visible"), F.count_if(F.col("permission").isin(*WRITE_PERMISSIONS)).alias("writable"), F.coalesce(of, F.lit("not-listed")).alias("permission"))


def uri_component(c: Column) -> Column:
    """Percent encoding of everything but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(c)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out
