"""Registered queries over the shared tables, each with its SQL twin."""

from tidewake.plans import agreement, contrast, effects, files, frame, further, messages, ratings, text, time

MODULES = [time, contrast, frame, text, agreement, further, messages, ratings, effects, files]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
