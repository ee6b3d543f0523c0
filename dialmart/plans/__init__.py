"""Registered queries over the driver's tables, with the SQL that checks them."""

from . import calls, checks, contacts, dialog, distributions, evidence, exchange, findings, intervals, journey, operations, pages, privacy, quality, views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
