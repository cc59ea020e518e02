"""Registered queries by area, each beside the SQL that gives its rows."""


def load() -> None:
    """Import the modules, which register their queries."""
    from . import alignments, evidence, files, formats, haplotypes, identity, populations, scenarios  # noqa: F401
