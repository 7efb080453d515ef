"""Endpoint columns out of connection URIs, with an error column instead of a failure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
DOCUMENT_STORE_PORT = 27017
DEFAULT_DATABASE = "default"
DEFAULT_AUTH_SOURCE = "admin"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def _query_value(uri: Column, *names: str) -> Column:
    """First non-empty value of the first of the parameters that is present."""
    found = [
        _or_null(F.regexp_extract(uri, rf"[?&]{name}=([^&#]*)", 1)) for name in names
    ]
    return F.try_url_decode(F.coalesce(*found))


def document_store_endpoint(uri: Column) -> Column:
    """Struct of scheme, host, port, username, password, database, auth_source, replica_set,
    use_ssl and error for ``mongodb://`` and ``mongodb+srv://`` URIs."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(uri, r"^[^:]+://([^/?#]*)", 1)
    userinfo = _or_null(F.regexp_extract(authority, r"^(.*)@", 1))
    hostport = F.regexp_replace(authority, r"^.*@", "")
    # A host in brackets holds colons itself.
    bracketed = F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)
    named = F.regexp_extract(hostport, r"^([^\[:,]*)", 1)
    host = _or_null(F.lower(F.when(bracketed != "", bracketed).otherwise(named)))
    port_text = _or_null(F.regexp_extract(hostport, r"^(?:\[[^\]]*\]|[^\[:,]*):(.*)$", 1))
    port = port_text.try_cast("int")
    database = _or_null(
        F.regexp_replace(F.regexp_extract(uri, r"^[^:]+://[^/?#]*(/[^?#]*)", 1), "^/+", "")
    )
    srv = scheme == "mongodb+srv"
    error = (
        F.when(uri.isNull() | (F.trim(uri) == ""), F.lit("empty uri"))
        .when(~scheme.isin("mongodb", "mongodb+srv"), F.lit("unsupported scheme"))
        .when(hostport.contains(","), F.lit("more than one host"))
        .when(host.isNull(), F.lit("missing host"))
        .when(
            port_text.isNotNull() & ~F.coalesce(port.between(0, 65535), F.lit(False)),
            F.lit("bad port"),
        )
        .when(srv & port.isNotNull(), F.lit("port not allowed with srv"))
    )
    ok = error.isNull()
    ssl = F.lower(_query_value(uri, "ssl", "tls"))
    return F.struct(
        F.when(ok, scheme).alias("scheme"),
        F.when(ok, host).alias("host"),
        F.when(ok & ~srv, F.coalesce(port, F.lit(DOCUMENT_STORE_PORT))).alias("port"),
        F.when(ok, _decoded(_or_null(F.regexp_extract(userinfo, r"^([^:]*)", 1)))).alias("username"),
        F.when(ok, _decoded(_or_null(F.regexp_extract(userinfo, r"^[^:]*:(.*)$", 1)))).alias("password"),
        F.when(ok, F.coalesce(database, F.lit(DEFAULT_DATABASE))).alias("database"),
        F.when(ok, F.coalesce(_query_value(uri, "authSource"), F.lit(DEFAULT_AUTH_SOURCE))).alias(
            "auth_source"
        ),
        F.when(ok, _query_value(uri, "replicaSet")).alias("replica_set"),
        F.when(ok, F.coalesce(ssl == "true", F.lit(False))).alias("use_ssl"),
        error.alias("error"),
    )


def _decoded(text: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone."""
    return F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))


def object_store_location(uri: Column) -> Column:
    """Struct of bucket, prefix and error for ``s3://`` URIs."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    bucket = _or_null(F.regexp_extract(uri, r"^[^:]+://([^/?#]*)", 1))
    prefix = F.regexp_replace(F.regexp_extract(uri, r"^[^:]+://[^/?#]*(/[^?#]*)", 1), "^/+", "")
    error = (
        F.when(uri.isNull() | (F.trim(uri) == ""), F.lit("empty uri"))
        .when(scheme != "s3", F.lit("unsupported scheme"))
        .when(bucket.isNull(), F.lit("missing bucket"))
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, bucket).alias("bucket"),
        F.when(ok, prefix).alias("prefix"),
        error.alias("error"),
    )
