"""Queries over the tables of a folder, one for each operator, and the SQL that each must agree with."""

from __future__ import annotations

from functools import cache


@cache
def catalogue() -> dict:
    """name -> (query, sql or None)"""
    from panelyard.checks import evaluation, expressions, index, models, relational

    return expressions.all_checks() | evaluation.all_checks() | index.all_checks() | models.all_checks() | relational.all_checks()
