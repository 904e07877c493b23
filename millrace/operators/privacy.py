"""Privacy jobs: opt-outs, subject access and deletion, redaction, and verification of chained logs."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col
from millrace.operators.rows import stable

#: The pattern of an address and what stands in its place.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
REDACTED = "redacted@example.com"
#: Parts of headers and keys that hold personal data, secret fields, and what stands for a token.
PERSONAL = ("email", "user", "name")
SECRETS, TOKENS, HIDDEN = ("pw_hash", "pw_salt"), ("token", "access_token", "refresh_token"), "<redacted>"


def without_opted_out(df: DataFrame, opted: DataFrame, user: str | None = "user_id", email: str | None = "email") -> DataFrame:
    """Rows whose user is not opted out (exactly) and whose e-mail is not (in any case). opted: (user_id, email)."""
    if user:
        df = df.join(opted.select(F.col("user_id").cast("string").alias("__o")).where("__o IS NOT NULL").distinct(), col(user).cast("string") == F.col("__o"), "left_anti")
    if email:
        df = df.join(opted.select(F.lower("email").alias("__o")).where("__o IS NOT NULL").distinct(), F.lower(col(email)) == F.col("__o"), "left_anti")
    return df


def subject_rows(tables: Mapping[str, tuple[DataFrame, str]], user: object) -> DataFrame:
    """All rows of one user over tables {name: (table, user column)}: (source, record as JSON)."""
    parts = [df.where(col(c).cast("string") == F.lit(str(user))).select(F.lit(n).alias("source"), F.to_json(F.struct(*[col(x) for x in df.columns])).alias("record")) for n, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def delete_subject(df: DataFrame, user_column: str, user: object, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ids deleted); rows without a user stay."""
    own = F.coalesce(col(user_column).cast("string") == F.lit(str(user)), F.lit(False))
    return df.where(~own), df.where(own).select(col(id_column).alias("deleted_id"))


def strip_secrets(df: DataFrame, secrets: Sequence[str] = SECRETS, tokens: Sequence[str] = TOKENS) -> DataFrame:
    """Secret columns go, filled tokens become a mark; in maps of text likewise."""
    df = df.drop(*secrets)
    for f in df.schema.fields:
        if f.name in tokens:
            df = df.withColumn(f.name, F.when(col(f.name).isNotNull(), F.lit(HIDDEN)))
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.StringType):
            kept = F.map_filter(col(f.name), lambda k, v: ~k.isin(*secrets))
            df = df.withColumn(f.name, F.transform_values(kept, lambda k, v: F.when(k.isin(*tokens), F.lit(HIDDEN)).otherwise(v)))
    return df


def personal_columns(df: DataFrame) -> list[str]:
    """Text columns whose header hints at personal data, or any of whose values holds an e-mail address."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = [c for c in text if any(p in c.lower() for p in PERSONAL)]
    rest = [c for c in text if c not in named]
    if not rest:
        return named
    row = df.agg(*(F.coalesce(F.bool_or(col(c).rlike(EMAIL)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(rest))).first()
    return named + [c for i, c in enumerate(rest) if row[i]]


def redact_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Personal columns become one address; empty values stay."""
    found = personal_columns(df) if columns is None else list(columns)
    return df.withColumns({c: F.when(col(c).isNotNull() & (col(c) != ""), F.lit(REDACTED)).otherwise(col(c)) for c in found})


def redact_text(c: Column) -> Column:
    """E-mail addresses within a text."""
    return F.regexp_replace(c, EMAIL, REDACTED)


def redact_value(c: Column, kind: T.DataType, key: str = "", keys: Sequence[str] = PERSONAL) -> Column:
    """A value with personal data replaced: text under a personal key, addresses in other text, through structs, arrays
    and maps."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.lit(REDACTED)) if any(k in key.lower() for k in keys) else redact_text(c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[redact_value(c[f.name], f.dataType, f.name, keys).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_value(x, kind.elementType, key, keys))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        hit = lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(p) for p in keys])
        return F.transform_values(c, lambda k, v: F.when(hit(k), F.lit(REDACTED)).otherwise(redact_text(v)) if isinstance(kind.valueType, T.StringType) else redact_value(v, kind.valueType, "", keys))
    return c


def redact_nested(df: DataFrame, keys: Sequence[str] = PERSONAL) -> DataFrame:
    """Every column by redact_value, by its name and type."""
    return df.select(*[redact_value(col(f.name), f.dataType, f.name, keys).alias(f.name) for f in df.schema.fields])


def redact_json(df: DataFrame, column: str, schema: str | T.StructType, keys: Sequence[str] = PERSONAL) -> DataFrame:
    """A JSON text column by its schema; text that does not parse has its addresses replaced."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json(col(column), kind, {"mode": "PERMISSIVE"})
    made = F.to_json(redact_value(parsed, kind, "", keys))
    return df.withColumn(column, F.when(parsed.isNotNull() & col(column).startswith("{"), made).otherwise(redact_text(col(column))))


#: The log of no record.
MARK = object()


def chain_digest(secret: str, before: str, body: str) -> str:
    return hmac.new(secret.encode(), (before + body).encode(), hashlib.sha256).hexdigest()


def chain_log(df: DataFrame, log: str, seq: str, body: str, secret: str) -> DataFrame:
    """Write side of a chained log: hmac of each record over the one before it and its body, log by log.

    Each digest needs the one before, so a log is walked in order by the task that has it; logs are spread over tasks
    and only the last digest is held.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, ""
        for rows in batches:
            out = []
            for name, text in zip(rows[log], rows[body], strict=True):
                last = chain_digest(secret, last if name == now else "", text or "")
                now = name
                out.append(last)
            yield rows.assign(hmac=out)

    schema = T.StructType([*df.select(*[col(c) for c in names]).schema.fields, T.StructField("hmac", T.StringType())])
    return df.repartition(col(log)).sortWithinPartitions(col(log), col(seq)).mapInPandas(run, schema)


def verify_chain(df: DataFrame, log: str, seq: str, body: str, secret: str) -> DataFrame:
    """Each record of a chained log (column hmac) with ok: its digest follows from the one before and its body.

    Verification needs the neighbour's stored digest only, so logs are dealt out by range of (log, seq), a long one over any
    number of tasks; the first record of a range takes the last digest of the range before, one row a range. Records of
    one log must differ in seq; a null log is a log, a null body is empty, a record without digest is not ok.
    """
    names = df.columns
    keyed = df.select(*[col(c) for c in names], col(log).cast("string").alias("__log"))
    parts = stable(keyed.repartitionByRange("__log", col(seq)).sortWithinPartitions("__log", col(seq)).withColumn("__part", F.spark_partition_id()))
    last = parts.groupBy("__part").agg(F.max_by(F.struct("__log", "hmac"), F.struct("__log", col(seq))).alias("__last"))
    before = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__lead"))  # a row a range
    lead = before.select("__part", F.col("__lead").isNotNull().alias("__led"), F.col("__lead.__log").alias("__lead_log"), F.col("__lead.hmac").alias("__lead_hmac"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[str | None, str | None]] = {}
        for rows in batches:
            ok = []
            for part, led, lead_log, lead_hmac, name, body, stored in zip(*(rows[c] for c in ("__part", "__led", "__lead_log", "__lead_hmac", "__log", "__body", "hmac")), strict=True):
                at = state.get(part) or ((lead_log, lead_hmac) if led else (MARK, None))
                ok.append(stored == chain_digest(secret, (at[1] or "") if at[0] == name else "", body or ""))
                state = {part: (name, stored)}
            yield rows[names].assign(ok=ok)

    schema = T.StructType([*df.select(*[col(c) for c in names]).schema.fields, T.StructField("ok", T.BooleanType())])
    return parts.join(F.broadcast(lead), "__part").withColumn("__body", col(body).cast("string")).mapInPandas(run, schema)
