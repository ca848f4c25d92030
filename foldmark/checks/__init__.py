"""Registered queries and, wherever SQL can say it, an independent oracle for each."""

from . import annotation, codes, contacts, evaluation, retrieval, sources, tables
from .base import oracle

MODULES = [retrieval, evaluation, annotation, contacts, codes, tables, sources]


def all_queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles():
    return {k: oracle(sql, *views) for m in MODULES for k, (sql, views) in m.ORACLES.items()}
