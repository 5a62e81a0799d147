"""Imports every module that registers queries."""

from quillmark.plans import backtest, market, measures, registry, reports, screening, sheets, text, workflow  # noqa: F401
