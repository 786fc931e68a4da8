"""Checks of requests, as columns: what is wrong with each row, null if nothing is.

A table of requests is checked in one projection, before anything is planned from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names look like, and the registries that may be named.
MODEL_NAME = r"^[a-zA-Z0-9][a-zA-Z0-9._/-]*(:[a-zA-Z0-9._-]+)?$"
INTEGRATION_NAME = r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"
VARIABLE_NAME = r"^[A-Z][A-Z0-9_]*$"
HEADER_NAME = r"^[A-Za-z0-9-]+$"
TOOL_NAME = r"^[a-zA-Z0-9_-]+$"
URL = r"^https?://\S+$"
REGISTRIES = ("hf.co", "registry.ollama.ai")
LONGEST_MODEL_NAME = 128


def first_error(*errors: Column) -> Column:
    """The first of several errors that there is."""
    return F.coalesce(*errors)


def text_error(name: str, value: Column, pattern: str, most: int) -> Column:
    """Whether a text is missing, too long, or not of a pattern."""
    return (
        F.when(value.isNull(), F.lit(f"{name} is missing"))
        .when(F.length(value) > most, F.lit(f"{name} has over {most} characters"))
        .when(~value.rlike(pattern), F.lit(f"{name} is invalid"))
    )


def range_error(name: str, value: Column, least: int, most: int) -> Column:
    """Whether a number that is given lies out of its range."""
    return F.when(~value.between(least, most), F.lit(f"{name} is not {least} to {most}"))


def model_name_error(name: Column) -> Column:
    """Whether a name can't be a model's: its form, empty parts, or a registry's host that
    isn't allowed."""
    parts = F.split(name, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", "..")) | (F.size(parts) > 3)
    foreign = (F.size(parts) == 3) & ~F.lower(F.get(parts, F.lit(0))).isin(*REGISTRIES)
    return first_error(text_error("name", name, MODEL_NAME, LONGEST_MODEL_NAME), F.when(odd, "invalid model name"), F.when(foreign, "model registry host not allowed"))


def values_error(param: Column, values: Column) -> Column:
    """Whether values (array<string>) can't be tried for a parameter: names of models, or
    positive whole numbers for any other."""
    bad_names = F.filter(values, lambda v: ~F.coalesce(v.rlike(MODEL_NAME), F.lit(False)))
    bad_numbers = F.exists(values, lambda v: ~F.coalesce(v.rlike("^[0-9]+$") & (v.try_cast("long") >= 1), F.lit(False)))
    return (
        F.when(F.coalesce(F.size(values), F.lit(0)) < 1, F.lit("no values"))
        .when((param == "model") & (F.size(bad_names) > 0), F.concat(F.lit("invalid model names: "), F.array_join(bad_names, ", ", "null")))
        .when((param != "model") & bad_numbers, F.concat(param, F.lit(" values must be positive integers")))
    )


def integration_error(name: Column, url: Column, allowed_tools: Column, timeout_s: Column, max_result_chars: Column) -> Column:
    """Whether an integration can't be created."""
    tools = F.exists(allowed_tools, lambda t: text_error("tool", t, TOOL_NAME, 128).isNotNull())
    return first_error(
        text_error("name", name, INTEGRATION_NAME, 64),
        text_error("url", url, URL, 512),
        F.when(tools, "a tool is invalid"),
        range_error("timeout_s", timeout_s, 1, 300),
        range_error("max_result_chars", max_result_chars, 100, 100_000),
    )
