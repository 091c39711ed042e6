"""Classes and flags of error messages, and secrets in logged commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeledger import fixed_values as fixed
from cladeledger.functions.text import contains_any


def error_class(message: Column, exception_type: Column | None = None) -> Column:
    """environment, filesystem, transient, data or processing (FN-26)."""
    text = F.lower(message)
    by_message = (
        F.when(contains_any(text, fixed.ENVIRONMENT_PHRASES), "environment")
        .when(contains_any(text, fixed.FILESYSTEM_PHRASES), "filesystem")
        .when(contains_any(text, fixed.TRANSIENT_PHRASES), "transient")
        .when(contains_any(text, fixed.DATA_PHRASES), "data")
        .otherwise("processing")
    )
    if exception_type is None:
        return by_message
    of_file = (
        F.when(contains_any(text, ["permission", "access"]), "filesystem")
        .when(F.contains(text, F.lit("not found")) & F.contains(text, F.lit("datasets")), "environment")
        .when(contains_any(text, ["space", "disk"]), "filesystem")
        .otherwise("processing")
    )
    return (
        F.when(exception_type.isin(*fixed.FILE_EXCEPTIONS), of_file)
        .when(exception_type.isin(*fixed.NETWORK_EXCEPTIONS), "transient")
        .when(exception_type.isin(*fixed.VALUE_EXCEPTIONS), "data")
        .otherwise(by_message)
    )


def is_fatal(kind: Column) -> Column:
    return kind.isin("environment", "filesystem")


def is_retryable(kind: Column) -> Column:
    return kind == "transient"


def is_rate_limit(message: Column) -> Column:
    """A rate-limit message that is not one of the known false alarms (FN-28)."""
    text = F.lower(message)
    return contains_any(text, fixed.RATE_LIMIT_PHRASES) & ~contains_any(text, fixed.RATE_LIMIT_EXCLUSIONS)


def is_retryable_message(message: Column, attempt: Column, max_retries: int = 3) -> Column:
    text = F.lower(message)
    return (attempt < max_retries) & contains_any(text, fixed.RETRYABLE_PHRASES + fixed.RETRYABLE_CODES)


def redacted_command(arguments: Column, inline_form: bool = True) -> Column:
    """The arguments with the value after a secret flag hidden, also ``--flag=value`` (FN-30)."""
    flag, hidden = F.lit(fixed.SECRET_FLAG), F.lit(fixed.REDACTED)

    def step(state: Column, part: Column) -> Column:
        shown = part
        if inline_form:
            inline = F.concat(flag, F.lit("="))
            shown = F.when(F.startswith(part, inline), F.concat(inline, hidden)).otherwise(part)
        return F.struct(
            (~state["hide"] & (part == flag)).alias("hide"),
            F.concat(state["out"], F.array(F.when(state["hide"], hidden).otherwise(shown))).alias("out"),
        )

    start = F.struct(F.lit(False).alias("hide"), F.array().cast("array<string>").alias("out"))
    # Commands without the flag, nearly all of them, are returned as they are.
    concerned = F.exists(arguments, lambda part: F.startswith(part, flag))
    return F.when(concerned, F.aggregate(arguments, start, step, lambda s: s["out"])).otherwise(arguments)
