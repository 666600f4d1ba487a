"""millrace: linear pipelines over tables, compiled to one Spark plan."""

from importlib import import_module

__version__ = "0.1.0"

#: Where the public names live; they are imported on first use, so that Python workers load only what they run.
_PLACES = {
    "AggSpec": "operators.stages",
    **dict.fromkeys(("HasType", "NoNulls", "OneOf", "Range", "RowsAtLeast", "RowsAtMost", "Unique"), "operators.quality"),
    "MillraceError": "errors",
    "Pipeline": "plans.pipeline",
    "sql": "plans.sql",
}
__all__ = [*_PLACES]


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_PLACES[name]}", __name__), name)
