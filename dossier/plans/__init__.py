"""Registered queries over the given tables."""

from dossier.plans.registry import ENTRIES

__all__ = ["ENTRIES", "load_all"]


def load_all():
    """Import every plan module so that its queries register."""
    from dossier.plans import (  # noqa: F401
        billing,
        evaluation,
        extraction,
        graph,
        ingest,
        lexical,
        results,
        search,
        streams,
        sync,
        vectors,
        web,
    )

    return ENTRIES
