"""Scalar column expressions; all compile to Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature families and the name prefixes that belong to them,
# tested in this order.
FAMILIES = {
    "GO": ["go_"],
    "Expression": ["spm_", "tpm_", "dge_", "dia_", "dit_"],
    "Protein Domain": ["mob_", "pfa_", "tmh_", "num_"],
    "Networks": ["ppi_", "pid_", "coe_", "cid_", "ttr_", "tti_", "ttf_", "agn_", "agi_"],
    "Others": [
        "ort_", "phy_", "sin_", "tan_", "pep_", "cin_", "cif_", "gwa_",
        "twa_", "hom_", "ntd_", "gbm_", "con_", "ptm_",
    ],
}

# Fixed value: the date format of run logs.
LOG_TIME = "dd/MM/yyyy HH:mm:ss"


def prefix_of(name: str | Column) -> Column:
    """Text before the first ``_``."""
    return F.substring_index(name, "_", 1)


def family_of(name: str | Column, families: dict[str, list[str]] | None = None) -> Column:
    """Family whose prefix starts the name; other names stay as they are."""
    name = F.col(name) if isinstance(name, str) else name
    known = {p: fam for fam, prefixes in (families or FAMILIES).items() for p in prefixes}
    lookup = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    return F.coalesce(F.try_element_at(lookup, F.concat(prefix_of(name), F.lit("_"))), name)


def pair_key(a: Column, b: Column, sep: str = "_") -> Column:
    """The same text for (a, b) and (b, a)."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def job_id(name: str | Column, n: int = 2) -> Column:
    """The first ``n`` ``_`` tokens, joined."""
    return F.substring_index(name, "_", n)


def gene_of(transcript: str | Column) -> Column:
    """Text before the first ``.``."""
    return F.substring_index(transcript, ".", 1)


def cleaned_ids(cell: str | Column, sep: str = ", ", field: int = 1) -> Column:
    """Take one ``|`` field of every list entry, join by spaces.

    NULL stays NULL. An entry without that field fails the job (ANSI mode).
    """
    cell = F.col(cell) if isinstance(cell, str) else cell
    entries = F.split(cell, F.lit(sep))
    return F.array_join(F.transform(entries, lambda e: F.element_at(F.split(e, r"\|"), field + 1)), " ")


def complement_name(col: str | Column) -> Column:
    """``X_up`` <-> ``X_down``; any other ending fails the job."""
    col = F.col(col) if isinstance(col, str) else col
    return (
        F.when(col.endswith("_up"), F.regexp_replace(col, "_up$", "_down"))
        .when(col.endswith("_down"), F.regexp_replace(col, "_down$", "_up"))
        .otherwise(F.raise_error(F.concat(F.lit("neither _up nor _down: "), col)))
    )


def regulated(qval: str, b: str, up: bool, alpha: float = 0.05) -> Column:
    """1 when significant in the given direction, 0 otherwise and for NULL."""
    side = F.col(b) > 0 if up else F.col(b) < 0
    return F.when((F.col(qval) < alpha) & side, 1).otherwise(0)


def archive_path(run: str | Column) -> tuple[Column, Column]:
    """Archive sub-path of a run accession, and its status."""
    run = F.col(run) if isinstance(run, str) else run
    size = F.length(run)
    known = run.startswith("ERR") | run.startswith("SRR")
    head = F.substring(run, 1, 6)
    path = F.when(known & (size == 9), F.concat(head, F.lit("/"), run, F.lit("/"))).when(
        known & (size == 10), F.concat(head, F.lit("/00"), F.right(run, F.lit(1)), F.lit("/"), run, F.lit("/"))
    )
    status = (
        F.when(~known, "database unrecognised").when(size.isin(9, 10), "ok").otherwise("length unrecognised")
    )
    return path, status


def safe_name(name: str | Column) -> Column:
    """File-safe target name."""
    return F.replace(name, F.lit(":"), F.lit("_"))
