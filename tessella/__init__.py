"""Search and measurement of mixed document collections on Spark."""

from importlib import import_module

_PLACES = {"Index": "index", "QueryResult": "index", "Options": "operators.search", "HashEmbedder": "operators.providers", "Store": "store"}


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f".{_PLACES[name]}", __name__), name)
    raise AttributeError(name)
