"""An analytics engine on Spark for privacy-labelled text datasets."""

from importlib import import_module

#: Where the public names live. They are imported when they are asked for, so that executors which need one module don't load all.
_HOME = {
    "LABELS": "functions.schema",
    "RISKS": "functions.schema",
    "Detection": "operators.detector",
    "Detector": "operators.detector",
    "compare": "operators.metrics",
    "evaluation_report": "operators.metrics",
    "label_f1": "operators.metrics",
    "pattern_predictor": "operators.hook",
    "scan": "operators.hook",
    "scan_with": "operators.hook",
}
__all__ = list(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
