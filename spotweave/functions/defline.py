"""Defline templates compiled, when the plan is made, into one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens of a template and the columns that they stand for.
TOKENS = {"ac": "run", "si": "spot_id", "ri": "read_id", "sn": "spot_name", "rl": "read_len"}


class TemplateError(ValueError):
    pass


def parse(template: str) -> list[tuple[str, str]]:
    """('text', literal) and ('column', name) parts; a leading @ or > is not part of it; $$ is a dollar."""
    body = template[1:] if template[:1] in "@>" and template else template
    parts: list[tuple[str, str]] = []
    literal, at = "", 0
    while at < len(body):
        if body[at] != "$":
            literal, at = literal + body[at], at + 1
        elif body[at + 1 : at + 2] == "$":
            literal, at = literal + "$", at + 2
        else:
            name = body[at + 1 : at + 3]
            if name not in TOKENS:
                raise TemplateError(f"unsupported token ${name}" if len(name) == 2 else "a template ends within a token")
            if literal:
                parts.append(("text", literal))
            parts.append(("column", TOKENS[name]))
            literal, at = "", at + 3
    if literal:
        parts.append(("text", literal))
    return parts


def compile_template(template: str, columns: dict[str, Column]) -> Column:
    """A missing spot name is empty."""
    pieces = [F.lit(v) if kind == "text" else F.coalesce(columns[v].cast("string"), F.lit("")) for kind, v in parse(template)]
    return F.concat(*pieces) if pieces else F.lit("")


def default_body(run: Column, spot: Column, name: Column | None, length: Column) -> Column:
    """`run.spot name length=n`, the name left out where null."""
    head = F.concat(run, F.lit("."), spot.cast("string"))
    return F.concat_ws(" ", head, *([name] if name is not None else []), F.concat(F.lit("length="), length.cast("string")))


def fastq_record(body: Column, bases: Column, quality: Column) -> Column:
    """Four lines, the third repeating the defline."""
    return F.concat_ws("\n", F.concat(F.lit("@"), body), bases, F.concat(F.lit("+"), body), quality)


def fasta_record(body: Column, bases: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), body), bases)


def output_filename(accession: Column, slot: Column, extension: str = ".fastq", separator: str = "_") -> Column:
    """accession, the read's number for numbered slots, extension."""
    number = F.regexp_extract(slot, r"^read(\d+)$", 1)
    return F.concat(accession, F.when(number != "", F.concat(F.lit(separator), number)).otherwise(""), F.lit(extension))


def compression_key(kind: str, level: int | None = None, threads: int | None = None) -> str:
    return ":".join(str(x) for x in (kind, level, threads) if x is not None)
