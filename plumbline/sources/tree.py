"""Working trees as files rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.paths import is_ignored_path

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def read_tree(
    spark: SparkSession, root: str, project_depth: int = 0, project_id: str = "project",
    max_bytes: int | None = None, scannable_only: bool = False,
) -> DataFrame:
    """Files below ``root`` as ``files(project_id, file_seq, path, content)``.

    ``scannable_only`` lists code and SQL files alone, so that nothing else is opened; counts of all files
    need the full listing. With ``project_depth=1`` each direct folder of ``root`` is a project. ``root`` is an
    absolute path or a URI. No file is left out for its size unless ``max_bytes`` says so; that limit is a condition
    on ``length``, which the reader applies before it opens a file. Bytes that are not UTF-8 become replacement
    characters. ``file_seq`` is an order key made from the path, so no file has to be numbered or shuffled.
    """
    reader = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    if scannable_only:
        endings = ",".join(e[1:] for e in [*fv.CODE_EXTENSIONS, fv.SQL_EXTENSION])
        reader = reader.option("pathGlobFilter", f"*.{{{endings}}}")
    raw = reader.load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    # Listed paths carry the file system's scheme and host; only what stands behind them is compared with the root.
    base = re.sub(SCHEME, "", root).rstrip("/") + "/"
    relative = F.substring(F.regexp_replace("path", SCHEME, ""), len(base) + 1, 1 << 30)
    rows = raw.select(relative.alias("rel"), "content")
    rows = rows.filter(~is_ignored_path(F.col("rel")))
    if project_depth:
        project, path = F.substring_index("rel", "/", project_depth), F.expr(
            f"substring(rel, length(substring_index(rel, '/', {project_depth})) + 2)"
        )
    else:
        project, path = F.lit(project_id), F.col("rel")
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    # Directory by directory in name order, which is the order of the path with the lowest separator.
    order = F.translate(path, "/", "\u0001")
    return rows.select(
        project.alias("project_id"), order.alias("file_seq"), path.alias("path"), text.alias("content")
    )
