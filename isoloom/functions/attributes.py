"""Text of annotation lines: attributes, chromosome numbers, names, formatted output."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(attributes: Column, tag: str) -> Column:
    """The quoted value of a tag, null if absent. The tag must stand at the start or after a separator."""
    name = re.escape(tag)
    # the literal comes first, as it is searched for fast; one search tells an absent tag from an empty value
    found = F.get(F.regexp_extract_all(attributes, F.lit(f'{name}(?<=(?:^|[;\\s]){name})[ =]"([^"]*)"'), F.lit(1)), F.lit(0))
    return F.when(attributes.contains(tag), found)


def chromosome_number(chr_: Column) -> Column:
    """chrX, chrY, chrM as 22, 23, 24; chr<n> as n - 1; other text counts as number 0."""
    rest = F.substring(chr_, 4, 1000)
    return F.when(rest.startswith("X"), 22).when(rest.startswith("Y"), 23).when(rest.startswith("M"), 24).otherwise(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(rest, "^[0-9]{1,9}", 0), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)) - 1)


def path_name(qname: Column, path: Column) -> Column:
    """The name of an alignment's path: name.path<n>."""
    return F.concat(qname, F.lit(".path"), path.cast("string"))


def coverage_score(cov: Column) -> Column:
    return F.lit(450) + F.lit(50) * cov


def tagged(pairs: list[tuple[str, Column]]) -> Column:
    """tag "value"; for each value that is neither null nor empty."""
    parts = F.array(*[F.when(F.coalesce(F.length(v), F.lit(0)) > 0, F.concat(F.lit(f'{tag} "'), v, F.lit('";'))) for tag, v in pairs])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")


def gtf_line(chr_: Column, source: Column, kind: str, start: Column, end: Column, score: Column, is_rev: Column, attributes: Column) -> Column:
    strand = F.when(is_rev == 1, "-").otherwise("+")
    return F.concat_ws("\t", chr_, source, F.lit(kind), start.cast("string"), end.cast("string"), score.cast("string"), strand, F.lit("."), attributes)
