"""Registered queries over the story model; importing this package registers them all."""

from . import aggregates, discovery, graphs, history, joins, language, metrics, patterns, phrases, ranking, records, scalars, search, stores, streams, vectors  # noqa: F401
