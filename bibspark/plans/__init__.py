"""Registered queries over the given tables, each with the SQL that tells the same rows."""

from . import bibtex, extra, more, relational, rich, scalar, stored, text

QUERIES = {**bibtex.QUERIES, **relational.QUERIES, **text.QUERIES, **more.QUERIES, **extra.QUERIES, **scalar.QUERIES, **rich.QUERIES, **stored.QUERIES}
ORACLES = {**bibtex.ORACLES, **relational.ORACLES, **text.ORACLES, **more.ORACLES, **extra.ORACLES, **scalar.ORACLES, **rich.ORACLES, **stored.ORACLES}
