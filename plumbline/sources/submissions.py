"""Submitted findings: JSON bodies in, checked finding rows out."""

from __future__ import annotations

import json
import math
import re
import sys
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from plumbline import fixed_values as fv
from plumbline.functions.keys import finding_id, severity_rank

# The parsing functions travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ["id", "title", "severity", "confidence", "asvsCategory", "file", "detail", "remediation"]


#: Fields that a finding may have beside those that it must have.
MORE = {"line": "int", "code_snippet": "string"}
#: Limits of the JSON reader: levels of nesting, digits of a number, characters of a name.
DEPTH, DIGITS, NAME = 1000, 1000, 50_000
#: Text that is parsed before its rows are passed on.
FLUSH_BYTES = 1 << 20
INT = range(-(2 ** 31), 2 ** 31)


def _whole(text: str) -> int:
    if len(text.lstrip("-")) > DIGITS:
        raise ValueError("number too long")
    return int(text)


def _fraction(text: str) -> float:
    if len(text) > DIGITS and sum(map(str.isdigit, text.lstrip("-").removeprefix("0"))) > DIGITS:
        raise ValueError("number too long")
    return float(text)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _object(pairs: list[tuple]) -> dict:
    unique = dict(pairs)
    if len(unique) < len(pairs) or max(map(len, unique), default=0) > NAME:
        raise ValueError("repeated or over-long name")
    return unique


def _too_deep(value) -> bool:
    level, depth = [value], 0
    while level := [x for x in level if type(x) in (dict, list)]:
        depth += 1
        if depth > DEPTH:
            return True
        level = [y for x in level for y in (x.values() if type(x) is dict else x)]
    return False


def _reader():
    """text → its first JSON value; ValueError or RecursionError if there is none, or an object repeats a name.

    Every name has a colon, so an object of the plain shape with as many names as colons repeats none, and a number of
    more than ``DIGITS`` digits covers two neighbours of every 500th character. All other texts go through the checked
    reader, which calls Python for each object and number.
    """
    numbers = {"parse_float": _fraction, "parse_constant": _no_constant}
    plain = json.JSONDecoder(**numbers).raw_decode
    checked = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, **numbers).raw_decode
    long_number = re.compile("[0-9][0-9]").search

    def names(value) -> int:
        if type(value) is not dict:
            return 0
        items = value.get("findings")
        return len(value) + (sum([len(f) for f in items if type(f) is dict]) if type(items) is list else 0)

    def read(text: str):
        text = text.lstrip(" \t\r\n")
        sure = len(text) <= NAME and not long_number(text[::DIGITS // 2])
        value, end = plain(text) if sure else checked(text)
        if sure and names(value) != text.count(":", 0, end):
            value, end = checked(text)
        after = text[end:end + 1]
        if type(value) in (int, float) and after and after not in " \t\r\n":
            raise ValueError("no space after a number")
        if (value is None or type(value) is bool) and after and (after.isalnum() or after == "_"):
            raise ValueError("not a word of JSON")
        if text.count("{") + text.count("[") > DEPTH and _too_deep(value):
            raise ValueError("nested too deeply")
        return value

    return read


def _int(value) -> int | None:
    """The value as a 32-bit number where Spark's cast has one: fractions are cut, texts may hold a whole number."""
    if type(value) is str:
        value = value.strip("".join(map(chr, [*range(33), 127])))
        value = int(value) if len(value) < 1000 and re.fullmatch("[+-]?[0-9]+", value) else None
    if type(value) not in (int, bool, float) or value in (math.inf, -math.inf):
        return None
    return int(value) if int(value) in INT else None


def _text_array(values: list) -> pa.Array:
    texts = [v if type(v) is str else None for v in values]
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def _parse(own: int, kept: list[str], most: int):
    """Batches (own columns, value, large) → own columns, header, findings with the kept fields."""
    fields = itemgetter(*FIELDS)

    def findings_of(value) -> list[dict] | None:
        items = value.get("findings") if type(value) is dict else None
        if type(items) is not list:
            return None
        valid = []
        for item in items:
            try:
                "".join(fields(item))  # fails unless all are there and strings
            except (KeyError, TypeError):
                continue
            valid.append(item)
        return valid

    def rows_of(read, batch, texts, large):
        header, valid, ends = [], [], [0]
        columns = {name: [] for name in kept}
        for text, over in zip(texts, large):
            value = found = None
            status = "too_large" if over else "not_json"
            if text is not None:
                try:
                    value = read(text.decode("utf-8", "replace"))
                except (ValueError, RecursionError):
                    pass
                else:
                    found = findings_of(value)
                    status = "no_findings_list" if found is None else "ok"
            top, found = value if type(value) is dict else {}, found or []
            header.append((status, top.get("repo"), top.get("ref"), top.get("commitSha")))
            valid.append(len(found))
            del found[most:]
            for name, values in columns.items():
                key = "codeSnippet" if name == "code_snippet" else name
                values += [f.get(key) for f in found]
            ends.append(ends[-1] + len(found))
        out = [*map(_text_array, zip(*header)), pa.array(valid, pa.int32())]
        if kept:
            arrays = [
                pa.array([v if type(v) is int and v in INT else _int(v) for v in values], pa.int32()) if name == "line"
                else _text_array(values) for name, values in columns.items()
            ]
            out.append(pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, list(columns)),
                mask=pa.array([h[0] != "ok" for h in header])))
        names = ["status", "repo", "ref", "commit_sha", "valid", *["findings"] * bool(kept)]
        return pa.RecordBatch.from_arrays([*batch.columns[:own], *out], [*batch.schema.names[:own], *names])

    def run(batches):
        read = _reader()
        for batch in batches:
            start, size, texts = 0, 0, []
            large = batch.column(own + 1).to_pylist()
            for at, text in enumerate(batch.column(own).cast(pa.binary()), 1):
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= FLUSH_BYTES or at == batch.num_rows:
                    yield rows_of(read, batch.slice(start, at - start), texts, large[start:at])
                    start, size, texts = at, 0, []

    return run


def parse_submissions(bodies: DataFrame, max_bytes: int = fv.MAX_SUBMISSION_BYTES, kept: list[str] | None = None) -> DataFrame:
    """``value`` JSON → header, ``status`` and the first 100 VALID findings as an array.

    A finding is valid when its eight fields are JSON strings; what is valid never depends on ``kept``, the fields of
    the array that the caller reads (all by default; without any there is no array). The body is parsed once, in Python,
    which keeps the types of JSON; over-long bodies never get there.
    """
    kept = [*FIELDS, *MORE] if kept is None else kept
    size = F.octet_length("value")
    sent = bodies.withColumns({
        "__value": F.when(size <= max_bytes, F.col("value")).cast("string"), "__large": size > max_bytes,
    }).drop("value")
    struct = ", ".join(f"{c}: {MORE.get(c, 'string')}" for c in kept)
    header = "status string, repo string, ref string, commit_sha string, valid int" + f", findings array<struct<{struct}>>" * bool(kept)
    own = sent.schema.fields[:-2]
    schema = StructType([*own, *StructType.fromDDL(header).fields])
    return sent.mapInArrow(_parse(len(own), kept, fv.MAX_SUBMISSION_FINDINGS), schema)


def submitted_findings(parsed: DataFrame, key: str = "submission_id") -> DataFrame:
    """One row per accepted finding with its position, and the fields that were kept."""
    names = ["id", "severity", "confidence", "asvsCategory", "title", "file", "line", "detail", "remediation", "code_snippet"]
    there = parsed.schema["findings"].dataType.elementType.names
    rows = parsed.select(key, F.posexplode("findings").alias("ord", "f"))
    return rows.select(
        key, F.col("ord").cast("long").alias("ord"),
        *[F.col(f"f.{c}").alias("asvs_category" if c == "asvsCategory" else c) for c in names if c in there],
    )


def coerce_cli_findings(raw: DataFrame) -> DataFrame:
    """Scanner JSON items with defaults for absent fields, upper-cased severity, and the id.

    The id is computed from the fields as they came, before the defaults, like the ids of the sender.
    """
    default = lambda name, value: F.coalesce(F.col(name), F.lit(value))
    missing = lambda name: F.coalesce(F.col(name), F.lit("undefined"))
    return raw.withColumns(
        {
            "id": finding_id(missing("file"), missing("title"), F.col("line")),
            "title": default("title", "Untitled finding"),
            "severity": F.upper(default("severity", "INFO")),
            "confidence": default("confidence", "heuristic"),
            "asvs_category": default("asvs", "ASVS"),
            "file": default("file", "(unknown)"),
            "detail": default("detail", ""),
            "remediation": default("remediation", ""),
        }
    ).drop("asvs")


def commit_choice(payload_sha: Column, environment_sha: Column) -> Column:
    """The payload's commit unless it is empty."""
    return F.coalesce(F.nullif(payload_sha, F.lit("")), environment_sha)


def submission_result(parsed: DataFrame, active: Column, analysis_ok: Column) -> DataFrame:
    """Enrichment outcome of accepted submissions, with fixed error tokens only.

    A submission without valid findings is ``ok`` for a subscriber but never counts as enriched.
    """
    some = F.size("findings") > 0
    enrichment = F.when(active & (~some | analysis_ok), "ok").otherwise("unavailable")
    error = F.when(~active, "subscription_required").when(some & ~analysis_ok, "unavailable")
    worst = F.coalesce(F.array_max(F.transform("findings", lambda f: severity_rank(f["severity"]))), F.lit(-1))
    return parsed.filter(F.col("status") == "ok").withColumns(
        {
            "enrichment": enrichment, "enrichment_error": error,
            "ai_enriched": (enrichment == "ok") & some,
            "findings_count": F.size("findings").cast("long"),
            "high_count": F.size(F.filter("findings", lambda f: f["severity"] == "HIGH")).cast("long"),
            "worst_rank": worst,
        }
    )


def tag_observations(observations: Column) -> Column:
    """Constant confidence on each observation; null when there is none."""
    tagged = F.transform(
        observations,
        lambda o: F.struct(o["description"].alias("description"), o["severity"].alias("severity"),
                           F.lit("inferred").alias("confidence")),
    )
    return F.when(F.size(observations) > 0, tagged)
