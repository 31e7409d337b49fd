"""Named queries (one per operator family); importing registers them."""

from tessera.plans import catalog, corpus, evaluate, features, filesets, retrieval, search, services, streams  # noqa: F401
