"""Registered queries over the shared tables, each with the SQL that checks it."""

from turnmill.queries import artifacts, batches, corpus, curation, evaluation, files, runs, scans, streams

_MODULES = (corpus, scans, files, batches, evaluation, curation, runs, streams, artifacts)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
